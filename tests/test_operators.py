"""Operators on small hand-made rows: missing keys, ties, negative and out-of-range indexes, repeats, expiry at now."""

import pytest
from pyspark.sql import functions as F

from keyloom.functions import placement, registry
from keyloom.functions.numbers import up2
from keyloom.operators import hashes, lists, sets, strings, zsets
from keyloom.plans import state
from keyloom.sources import decode
from keyloom.streaming import changes


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def ten(spark):
    return spark.createDataFrame([("z", f"member{i}", float(i)) for i in range(10)], "key string, member string, score double")


@pytest.fixture(scope="module")
def digits(spark):
    return spark.createDataFrame([("l", i, str(i % 10)) for i in range(20)], "key string, pos long, value string")


@pytest.mark.parametrize(("args", "n"), [((1.0, 4.0, True, True), 2), ((2.0, 3.0), 2), ((None, None), 10), ((3.0, 2.0), 0)])
def test_zcount(ten, args, n):
    assert rows(zsets.count_between(ten, "score", *args)) == [("z", n)]


def test_zlexcount(ten):
    assert rows(zsets.count_between(ten, "member", "member1", "member4", True, True)) == [("z", 2)]
    assert rows(zsets.count_between(ten, "member", "member1", "member4")) == [("z", 4)]


def test_ranges_and_ties(spark, ten):
    assert [r.member for r in zsets.range_by_index(ten, -2, 100).orderBy("rank").collect()] == ["member8", "member9"]
    assert zsets.range_by_index(ten, 5, 2).count() == 0 and zsets.range_by_index(ten, 20, 30).count() == 0
    tied = spark.createDataFrame([("k", "b", 1.0), ("k", "a", 1.0), ("k", "c", 0.5)], "key string, member string, score double")
    assert [r.member for r in zsets.rank(tied).orderBy("rank").collect()] == ["c", "a", "b"]
    assert [r.member for r in zsets.rank(tied, True).orderBy("rank").collect()] == ["b", "a", "c"]
    assert [r.member for r in zsets.pop(tied, 1, True).collect()] == ["b"]


def test_zadd_twice_changes_nothing(spark):
    empty = spark.createDataFrame([], "key string, member string, score double")
    new = spark.createDataFrame([(0, "k", "m0", 0.0), (1, "k", "m1", 1.0)], "idx long, key string, member string, score double")
    once = zsets.add(empty, new)
    assert once.where("changed").count() == 2
    assert zsets.add(once.drop("changed"), new).where("changed").count() == 0
    assert zsets.add(empty, new, "XX").count() == 0


def test_set_algebra(spark):
    s = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("c", "3")], "key string, member string")
    members = lambda kind, *keys: {r.member for r in sets.algebra(s, list(keys), kind).collect()}
    assert members("diff", "a", "missing") == {"1", "2"} and members("inter", "a", "missing") == set() and members("union", "missing", "a") == {"1", "2"}
    assert members("diff", "a", "b") == {"2"} and members("inter", "a", "b") == {"1"} and members("inter", "a", "c") == set()


def test_lists(digits):
    at = lambda **kw: [r.pos for r in lists.positions(digits, "5", **kw).collect()]
    assert at(rank=-1) == [15] and at(rank=2) == [15] and at(rank=2, maxlen=10) == [] and sorted(at(count=0)) == [5, 15]
    assert at(rank=-1, maxlen=3) == []
    assert lists.index(digits, 20).count() == 0 and lists.index(digits, -20).first().value == "0"
    assert lists.trim(digits, 0, -30).count() == 1
    assert [r.value for r in lists.insert(digits, "none", "x").orderBy("pos").collect()] == [str(i % 10) for i in range(20)]
    assert lists.remove(digits, -1, "5").where("value = '5'").first().pos == 5


def test_expiry_at_now_is_visible(spark):
    k = spark.createDataFrame([("a", "1", 0), ("b", "2", 100), ("c", "3", 99)], "key string, value string, expire_at long")
    assert {r.key for r in strings.live(k, 100).collect()} == {"a", "b"}
    assert [r.t for r in k.select(strings.ttl(F.col("expire_at"), 100, 1).alias("t")).collect()] == [-1, 0, -2]
    given = spark.createDataFrame([("a", 7), ("b", 7), ("missing", 7)], "key string, at long")
    assert {(r.key, r.reply) for r in strings.expire(k, given, 100, "NX").collect()} == {("a", 1), ("b", 0)}


def test_what_has_expired_is_missing(spark):
    k = spark.createDataFrame([("a", "1", 0), ("b", "2", 100), ("c", "3", 99)], "key string, value string, expire_at long")
    asked = spark.createDataFrame([(0, "a"), (1, "c"), (2, "b"), (3, "c")], "idx long, key string")
    new = spark.createDataFrame([(0, "c", "new", 0), (1, "a", "new", 0)], "idx long, key string, value string, expire_at long")
    assert [(r.idx, r.value) for r in strings.get(k, asked, 100).orderBy("idx").collect()] == [(0, "1"), (1, None), (2, "2"), (3, None)]
    assert strings.exists(k, asked, 100).first().n == 2
    assert {(r.key, r.value, r.old) for r in strings.put(k, new, 100, "NX").collect()} == {("a", "1", "1"), ("b", "2", "2"), ("c", "new", None)}
    assert {(r.key, r.value) for r in strings.put(k, new, 100, "XX").collect()} == {("a", "new"), ("b", "2")}
    assert rows(strings.take(k, asked, 100)) == [("a", "1"), ("b", "2")]
    assert rows(strings.append(k, new.select("idx", "key", "value"), 100).select("key", "value")) == [("a", "1new"), ("c", "new")]
    assert rows(strings.increase(k, spark.createDataFrame([("c", 5), ("a", 5)], "key string, delta long"), 100)) == [("a", 6), ("c", 5)]
    assert "x" not in {r.key for r in strings.copy(k, spark.createDataFrame([("c", "x")], "src string, dst string"), 100).collect()}
    at = strings.expire_at(F.col("kind"), F.col("n"), 1000)
    kinds = spark.createDataFrame([("EX", 2), ("PX", 2), ("EXAT", 2), ("PXAT", 2), (None, None), ("PERSIST", None)], "kind string, n long")
    assert [r[0] for r in kinds.select(at).collect()] == [3000, 1002, 2000, 2, 0, 0]


def test_algebra_of_a_repeated_key_and_small_scores(spark):
    s = spark.createDataFrame([("a", "1"), ("a", "2")], "key string, member string")
    assert sets.algebra(s, ["a", "a"], "diff").count() == 0 and sets.algebra(s, ["a", "a"], "inter").count() == 2 and sets.algebra(s, ["a", "a"], "union").count() == 2
    z = spark.createDataFrame([("z", "m", 0.00001), ("y", "m", 0.00002)], "key string, member string, score double")
    assert rows(zsets.algebra(z, ["z"], "union")) == [("m", 0.00001)]
    assert rows(zsets.algebra(z, ["z", "z"], "inter", [1.0, 3.0], "max")) == [("m", pytest.approx(0.00003))]
    assert zsets.algebra(z, ["z", "z"], "diff").count() == 0
    assert rows(sets.store_reply(s.limit(0), "d")) == [("d", 0, "del")]
    assert zsets.draw(z, 4, "s").groupBy("key").count().collect()[0][1] == 4
    assert rows(zsets.add_increase(z, z.limit(1).select("key", "member", F.lit(-1.0).alias("score")), "GT").select("member", "reply")) == [("m", None), ("m", None)]


def test_frames():
    assert decode.parse_frames(b"*1\r\n$4\r\na\r\nb\r\n*2\r\n$0\r\n\r\n$1\r\nx\r\n*1\r\n$9\r\ncut") == ([["a\r\nb"], ["", "x"]], 31)
    assert decode.parse_frames(b"") == ([], 0) and decode.parse_frames(b"*1\r") == ([], 0) and decode.parse_frames(b"*0\r\n") == ([[]], 4)
    with pytest.raises(ValueError):
        decode.parse_frames(b"hello\r\n")


def test_bytes(spark):
    df = spark.createDataFrame([("abc",), ("",), (None,)], "v string")
    assert [r[0] for r in df.select(strings.byte_range(F.col("v"), 0, -1)).collect()][:2] == ["abc", ""]
    assert [r[0] for r in df.select(strings.set_range(F.col("v"), 5, "x")).collect()][:2] == ["abc\0\0x", "\0\0\0\0\0x"]
    assert [r[0] for r in spark.createDataFrame([("éé",), ("abcdef",)], "v string").select(strings.set_range(F.col("v"), 2, "é")).collect()] == ["éé", "abéef"]
    assert [str(r[0]) for r in spark.createDataFrame([(1.231,), (-1.231,), (0.0,)], "x double").select(up2(F.col("x"))).collect()] == ["1.24", "-1.24", "0.00"]


def test_hash_increments(spark):
    h = spark.createDataFrame([("h", "f", "1")], "key string, field string, value string")
    d = spark.createDataFrame([("h", "f", 1), ("h", "g", 1)], "key string, field string, delta long")
    assert rows(hashes.increase(h, d)) == [("h", "f", 2), ("h", "g", 1)]


def test_counters_equal_a_fold(spark, data):
    from keyloom.sources.views import Keyspace

    log = Keyspace(spark, data).log
    want: dict = {}
    for r in log.orderBy("seq").collect():
        if r.op == "del":
            want.pop(r.key, None)
        elif r.op == "set":
            want[r.key] = 0
        elif r.op == "incr":
            want[r.key] = want.get(r.key, 0) + r.delta
    assert dict(state.counters(log).collect()) == want


def test_replay_into_parts(spark, data, tmp_path):
    from keyloom.sources.views import NOW_MS, Keyspace

    log = Keyspace(spark, data).log
    schema = log.schema
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for k in range(3):  # a micro-batch each; the last touches one key only
        part = log.where(f"seq % 2 = {k}") if k < 2 else log.where("key = '1'").withColumn("seq", F.col("seq") + 1_000_000)
        part.write.mode("append").parquet(str(tmp_path / "in"))
        changes.replay_into(stream, str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    whole = log.union(log.where("key = '1'").withColumn("seq", F.col("seq") + 1_000_000))
    named = changes.versions(spark, str(tmp_path / "s"), 2)
    got = spark.read.parquet(*[f"{tmp_path}/s/{v}" for v in named.values()])
    assert rows(got.select("key", "seq", "op")) == rows(state.latest(whole).select("key", "seq", "op"))
    assert sum(v.startswith("v2/") for v in named.values()) == 1 and not changes._exists(spark, str(tmp_path / "s/list0"))
    assert rows(changes.replayed(stream, NOW_MS).select("key", "seq")) == rows(state.visible(whole, NOW_MS).select("key", "seq"))


def test_append_and_big_strings(spark, data, tmp_path):
    from keyloom.sources.views import Keyspace

    v = Keyspace(spark, data)
    for k in range(2):
        changes.append(v.log.where(f"seq % 2 = {k}"), str(tmp_path / "log"), 100)
    again = spark.read.parquet(str(tmp_path / "log"))
    assert rows(again) == rows(v.log) and len(again.inputFiles()) > 4
    for k in range(3):
        (tmp_path / f"big{k}").write_bytes(bytes([k]) * 100_000)
    assert rows(v.big_strings(f"{tmp_path}/big*").select("key", F.octet_length("value"))) == [(f"big{k}", 100_000) for k in range(3)]


def test_segments(spark):
    from keyloom.plans import compaction

    df = spark.createDataFrame([(k, k not in (3, 4, 9)) for k in range(20)], "segment long, used boolean")
    want = [(False, 3, 4, 2), (False, 9, 9, 1), (True, 0, 2, 3), (True, 5, 8, 4), (True, 10, 19, 10)]
    assert rows(compaction.runs(df, "used")) == rows(compaction.runs(df, "used", 2)) == sorted(want, key=repr)


def test_packed_length(spark):
    from keyloom.plans import metrics

    pytest.importorskip("zstandard")
    got = spark.createDataFrame([("a" * 1000,), ("",), (None,)], "v string").select(metrics.packed_length(F.col("v")).alias("n")).collect()
    assert got[0].n < 100 and got[1].n < 30 and got[2].n is None


def test_placement_and_registry(spark):
    df = spark.createDataFrame([("{a}x",), ("{a}y",), ("b",)], "key string")
    got = df.select(placement.slot(F.col("key")).alias("s")).collect()
    assert got[0] == got[1]
    assert "reverse_key" in registry.register_all(spark)
    assert spark.sql("select reverse_key('abc') as k").first().k == "cba"
    assert decode.http_argv(F.lit("x")) is not None
