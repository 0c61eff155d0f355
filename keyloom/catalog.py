"""All queries of the keyspace operators and, for each, the SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import placement
from keyloom.functions.numbers import canonical, up2
from keyloom.operators import hashes as H
from keyloom.operators import lists as L
from keyloom.operators import sets as S
from keyloom.operators import strings as K
from keyloom.operators import zsets as Z
from keyloom.plans import compaction, metrics, state
from keyloom.sources import decode
from keyloom.sources.views import LIMITS, NOW_MS, SQL_VIEWS, Keyspace
from keyloom.streaming import changes

_queries: dict[str, Callable[[Keyspace], DataFrame]] = {}
_sql: dict[str, str] = {}


def add(name: str, f: Callable[[Keyspace], DataFrame], sql: str) -> None:
    """``{view}`` in the SQL reads a view of the keyspace."""
    _queries[name] = f
    used = [v for v in SQL_VIEWS if f"{{{v}}}" in sql]
    body = re.sub(rf"\{{({'|'.join(SQL_VIEWS)})\}}", r"kv_\1", sql)
    views = ", ".join(f"kv_{v} AS ({SQL_VIEWS[v]})" for v in used)
    head = next((h for h in ("WITH RECURSIVE ", "WITH ") if body.startswith(h)), "")
    _sql[name] = (f"{head or 'WITH '}{views}" + (", " + body[len(head) :] if head else " " + body)) if used else body


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Keyspace(spark, sf_dir))) for name, f in _queries.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# Sorted sets ---------------------------------------------------------------------------------------------------------

RANKED = "row_number() OVER (PARTITION BY key ORDER BY score, member) - 1"
REVERSED = "row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1"
ASK = [(0, "BUILDING", "Customer#000000001"), (1, "MACHINERY", "Customer#000000003"), (2, "MACHINERY", "nobody"), (3, "nothing", "Customer#000000001"), (4, "MACHINERY", "Customer#000000003")]


def ask(v: Keyspace) -> DataFrame:
    """Requests for real members, a missing one, a missing key and a repeat."""
    return v.rows(ASK, "idx long, key string, member string")


ASK_SQL = "(VALUES " + ", ".join(map(str, ASK)) + ") q(idx, key, member)"

add("zcard", lambda v: v.zset.groupBy("key").agg(F.count("*").alias("n")), "SELECT key, count(*) AS n FROM {zset} GROUP BY 1")
add("zcount", lambda v: Z.count_between(v.zset, "score", 0.0, 5000.0), "SELECT key, count(*) FILTER (WHERE score BETWEEN 0 AND 5000) AS n FROM {zset} GROUP BY 1")
add("zcount_exclusive", lambda v: Z.count_between(v.spend, "score", 100000.0, None, open_low=True), "SELECT key, count(*) FILTER (WHERE score > 100000) AS n FROM {spend} GROUP BY 1")
add("zlexcount", lambda v: Z.count_between(v.spend, "member", "1", "3", False, True), "SELECT key, count(*) FILTER (WHERE member >= '1' AND member < '3') AS n FROM {spend} GROUP BY 1")
add("zscore", lambda v: v.zset.select("key", "member", "score"), "SELECT key, member, score FROM {zset}")
add("zmscore", lambda v: Z.scores(v.zset, ask(v)), f"SELECT q.idx, q.key, q.member, z.score FROM {ASK_SQL} LEFT JOIN {{zset}} z ON z.key = q.key AND z.member = q.member")
add("zrank", lambda v: Z.rank(v.zset), f"SELECT key, member, score, {RANKED} AS rank FROM {{zset}}")
add("zrevrank", lambda v: Z.rank(v.zset, True), f"SELECT key, member, score, {REVERSED} AS rank FROM {{zset}}")
_R = f"SELECT * FROM (SELECT key, {RANKED} AS rank, member, score, count(*) OVER (PARTITION BY key) AS n FROM {{zset}})"
add("zrange_index", lambda v: Z.range_by_index(v.zset, 0, 9), f"SELECT key, rank, member, score FROM ({_R}) WHERE rank BETWEEN 0 AND 9")
add("zrange_neg", lambda v: Z.range_by_index(v.zset, -5, -2), f"SELECT key, rank, member, score FROM ({_R}) WHERE rank BETWEEN n - 5 AND n - 2")
add("zrevrange", lambda v: Z.range_by_index(v.zset, 2, 7, True), f"SELECT * FROM (SELECT key, {REVERSED} AS rank, member, score FROM {{zset}}) WHERE rank BETWEEN 2 AND 7")
add("zrangebyscore", lambda v: Z.range_by_score(v.zset, 1000.0, 2000.0, open_low=True), f"SELECT key, {RANKED} AS rank, member, score FROM {{zset}} WHERE score > 1000 AND score <= 2000")
add("zrangebyscore_limit", lambda v: Z.range_by_score(v.zset, None, None, offset=3, count=4), f"SELECT * FROM (SELECT key, {RANKED} AS rank, member, score FROM {{zset}}) WHERE rank BETWEEN 3 AND 6")
add("zrevrangebyscore", lambda v: Z.range_by_score(v.zset, 1000.0, 2000.0, rev=True), f"SELECT key, {REVERSED} AS rank, member, score FROM {{zset}} WHERE score BETWEEN 1000 AND 2000")
add("zrangebylex", lambda v: Z.range_by_lex(v.spend, "1", "2", offset=1, count=0), "SELECT * FROM (SELECT key, row_number() OVER (PARTITION BY key ORDER BY member) - 1 AS rank, member FROM {spend} WHERE member BETWEEN '1' AND '2') WHERE rank >= 1")
add("zrevrangebylex", lambda v: Z.range_by_lex(v.spend, "1", None, open_low=True, rev=True, count=20), "SELECT * FROM (SELECT key, row_number() OVER (PARTITION BY key ORDER BY member DESC) - 1 AS rank, member FROM {spend} WHERE member > '1') WHERE rank < 20")
add("zrangestore", lambda v: Z.store(Z.range_by_index(v.spend.where("key = 'F'"), 0, 4), "top"), f"SELECT 'top' AS key, member, score FROM (SELECT *, {RANKED} AS rank FROM {{spend}} WHERE key = 'F') WHERE rank < 5")
add("zpopmin", lambda v: Z.pop(v.zset, 3), f"SELECT * FROM (SELECT key, {RANKED} AS rank, member, score FROM {{zset}}) WHERE rank < 3")
add("zpopmax", lambda v: Z.pop(v.zset, 3, True), f"SELECT * FROM (SELECT key, {REVERSED} AS rank, member, score FROM {{zset}}) WHERE rank < 3")
add("zpopmin_rest", lambda v: Z.without(v.zset, Z.pop(v.zset, 3)), f"SELECT key, member, score FROM (SELECT *, {RANKED} AS rank FROM {{zset}}) WHERE rank >= 3")
_MD5 = "row_number() OVER (PARTITION BY key ORDER BY md5('{seed}' || {name}), {name})"
add("zrandmember_det", lambda v: Z.sample(v.zset, 4, "s1"), f"SELECT * FROM (SELECT *, {_MD5.format(seed='s1', name='member')} AS place FROM {{zset}}) WHERE place <= 4")
add("zincrby", lambda v: Z.increase(v.zset, ask(v).select("key", "member", F.lit(2.5).alias("delta"))), f"SELECT coalesce(z.key, d.key) AS key, coalesce(z.member, d.member) AS member, coalesce(score, 0) + coalesce(delta, 0) AS score FROM {{zset}} z FULL JOIN (SELECT key, member, CAST(sum(2.5) AS DOUBLE) AS delta FROM {ASK_SQL} GROUP BY 1, 2) d ON z.key = d.key AND z.member = d.member")


def new_scores(v: Keyspace) -> DataFrame:
    """Two new scores for each spender of F, and one new member for each customer of P."""
    f = v.spend.where("key = 'F'")
    up = f.select((F.col("member").cast("long") * 2).alias("idx"), "key", "member", F.when(F.col("member").cast("long") % 2 == 0, F.col("score") + 1).otherwise(F.col("score") - 1).alias("score"))
    again = up.select((F.col("idx") + 1).alias("idx"), "key", "member", (F.col("score") + 0.5).alias("score"))
    fresh = v.spend.where("key = 'P'").select((F.col("member").cast("long") * 2).alias("idx"), "key", F.concat("member", F.lit("n")).alias("member"), "score")
    return up.union(again).union(fresh)


_NEW = """n0 AS (SELECT CAST(member AS BIGINT) * 2 AS idx, key, member, CASE WHEN CAST(member AS BIGINT) %% 2 = 0 THEN score + 1 ELSE score - 1 END AS score FROM {spend} WHERE key = 'F'),
n1 AS (SELECT * FROM n0 UNION ALL SELECT idx + 1, key, member, score + 0.5 FROM n0 UNION ALL SELECT CAST(member AS BIGINT) * 2, key, member || 'n', score FROM {spend} WHERE key = 'P'),
n2 AS (SELECT key, member, %s AS given FROM n1 GROUP BY 1, 2),
j AS (SELECT coalesce(s.key, n2.key) AS key, coalesce(s.member, n2.member) AS member, score AS was, given, coalesce(given IS NOT NULL AND (%s), false) AS takes FROM {spend} s FULL JOIN n2 ON s.key = n2.key AND s.member = n2.member)
"""
_ZADD = "WITH " + _NEW + "SELECT key, member, CASE WHEN takes THEN given ELSE was END AS score, coalesce(takes AND (was IS NULL OR was <> given), false) AS changed FROM j WHERE was IS NOT NULL OR takes"
for _only, _how, _takes in (("", "arg_max(score, idx)", "true"), ("NX", "arg_min(score, idx)", "was IS NULL"), ("XX", "arg_max(score, idx)", "was IS NOT NULL"), ("GT", "max(score)", "was IS NULL OR given > was"), ("LT", "min(score)", "was IS NULL OR given < was")):
    add(f"zadd{'_' * bool(_only)}{_only.lower()}", lambda v, o=_only: Z.add(v.spend, new_scores(v), o or None), _ZADD % (_how, _takes))
add("zadd_ch", lambda v: Z.add(v.spend, new_scores(v), "GT").groupBy("key").agg(F.count_if("changed").alias("n")), "WITH " + _NEW % ("max(score)", "was IS NULL OR given > was") + "SELECT key, count(*) FILTER (WHERE takes AND (was IS NULL OR was <> given)) AS n FROM j WHERE was IS NOT NULL OR takes GROUP BY 1")
add("zrem", lambda v: Z.without(v.zset, ask(v)), f"SELECT key, member, score FROM {{zset}} z WHERE NOT EXISTS (SELECT 1 FROM {ASK_SQL} WHERE q.key = z.key AND q.member = z.member)")
add("zremrangebyrank", lambda v: Z.without(v.zset, Z.range_by_index(v.zset, 0, -11)), f"SELECT key, member, score FROM ({_R}) WHERE rank > n - 11")
add("zremrangebyscore", lambda v: v.zset.where(~Z.between(F.col("score"), 0.0, 9000.0)), "SELECT * FROM {zset} WHERE NOT score BETWEEN 0 AND 9000")
add("zremrangebylex", lambda v: v.spend.where(~Z.between(F.col("member"), "1", "8", True)), "SELECT * FROM {spend} WHERE NOT (member > '1' AND member <= '8')")
_ALG = "SELECT member, round({fold}, 4) AS score FROM (SELECT member, score * CASE key {case} END AS s FROM {{spend}} WHERE key IN ({keys})) GROUP BY 1{having}"


def r4(found: DataFrame) -> DataFrame:
    """Sums of doubles depend on their order: four places are compared, here and in the SQL."""
    return found.withColumn("score", F.round("score", 4))


def _alg(keys: list[str], weights: list[float], fold: str, having: str = "") -> str:
    return _ALG.format(fold=f"{fold}(s)", case=" ".join(f"WHEN '{k}' THEN {w}" for k, w in zip(keys, weights, strict=True)), keys=", ".join(f"'{k}'" for k in keys), having=having)


for _fold in ("sum", "min", "max"):
    add(f"zinter_{_fold}", lambda v, f=_fold: r4(Z.algebra(v.spend, ["F", "O"], "inter", [2.0, 0.5], f)), _alg(["F", "O"], [2.0, 0.5], _fold, " HAVING count(*) = 2"))
add("zunion_weighted", lambda v: r4(Z.algebra(v.spend, ["F", "O", "P"], "union", [1.0, 2.0, -1.0])), _alg(["F", "O", "P"], [1.0, 2.0, -1.0], "sum"))
_ZDIFF = "SELECT {dst}member, score FROM {{spend}} WHERE key = 'O' AND member NOT IN (SELECT member FROM {{spend}} WHERE key = 'P')"
add("zdiff", lambda v: Z.algebra(v.spend, ["O", "P"], "diff"), _ZDIFF.format(dst=""))
add("zdiffstore", lambda v: Z.store(Z.algebra(v.spend, ["O", "P"], "diff"), "d"), _ZDIFF.format(dst="'d' AS key, "))
add("zinterstore", lambda v: Z.store(r4(Z.algebra(v.spend, ["F", "P"], "inter")), "d"), f"SELECT 'd' AS key, * FROM ({_alg(['F', 'P'], [1.0, 1.0], 'sum', ' HAVING count(*) = 2')})")
add("zunionstore", lambda v: Z.store(r4(Z.algebra(v.spend, ["F", "P"], "union", None, "max")), "d"), f"SELECT 'd' AS key, * FROM ({_alg(['F', 'P'], [1.0, 1.0], 'max')})")
add("zintercard", lambda v: S.size_up_to(Z.algebra(v.spend, ["F", "O", "P"], "inter"), 50), f"SELECT least(count(*), 50) AS n FROM ({_alg(['F', 'O', 'P'], [1.0] * 3, 'sum', ' HAVING count(*) = 3')})")

add("zinter_same", lambda v: r4(Z.algebra(v.spend, ["F", "F"], "inter", [1.0, 2.0])), "SELECT member, round(score + 2 * score, 4) AS score FROM {spend} WHERE key = 'F'")
add("zdiff_same", lambda v: Z.algebra(v.spend, ["F", "F"], "diff"), "SELECT member, score FROM {spend} WHERE false")
add("zadd_incr", lambda v: Z.add_increase(v.spend, v.spend.where("key = 'F'").select("key", "member", F.when(F.col("member").cast("long") % 2 == 0, 1.5).otherwise(-1.5).alias("score")).union(v.rows([("F", "fresh", 2.5)], "key string, member string, score double")), "GT"), "SELECT key, member, CASE WHEN key = 'F' AND CAST(member AS BIGINT) % 2 = 0 THEN score + 1.5 ELSE score END AS score, CASE WHEN key = 'F' AND CAST(member AS BIGINT) % 2 = 0 THEN score + 1.5 END AS reply FROM {spend} UNION ALL SELECT 'F', 'fresh', 2.5, 2.5")
_DRAW = "WITH p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {name}) - 1 AS place, count(*) OVER (PARTITION BY key) AS size FROM {{{view}}}), d AS (SELECT DISTINCT key, size, draw FROM p, range(1, {n} + 1) r(draw)), h AS (SELECT key, draw, CAST('0x' || substr(md5('{seed}:' || key || ':' || draw), 1, 15) AS BIGINT) % size AS place FROM d) SELECT h.draw, p.* EXCLUDE (place, size) FROM h JOIN p ON p.key = h.key AND p.place = h.place"
for _name, _view, _of, _by in (("zrandmember", "zset", "zset", "member"), ("srandmember", "kset", "set", "member"), ("hrandfield", "hash", "hash", "field")):
    add(f"{_name}_repeat", lambda v, of=_of: Z.draw(getattr(v, of), 5, "n"), _DRAW.format(name=_by, view=_view, n=5, seed="n"))

# Sets ----------------------------------------------------------------------------------------------------------------

DAYS = ["click:2024-01-03", "view:2024-01-03", "signup:2024-01-04"]
_IN = ", ".join(f"'{k}'" for k in DAYS)
SASK = [(0, DAYS[0], "1"), (1, DAYS[0], "7"), (2, DAYS[1], "nobody"), (3, "nothing", "1"), (4, DAYS[1], "12")]
SASK_SQL = "(VALUES " + ", ".join(map(str, SASK)) + ") q(idx, key, member)"


def sask(v: Keyspace) -> DataFrame:
    return v.rows(SASK, "idx long, key string, member string")


_SALG = {
    "diff": f"SELECT member FROM {{kset}} WHERE key = '{DAYS[0]}' AND member NOT IN (SELECT member FROM {{kset}} WHERE key IN ('{DAYS[1]}', '{DAYS[2]}'))",
    "inter": f"SELECT member FROM {{kset}} WHERE key IN ({_IN}) GROUP BY 1 HAVING count(*) = 3",
    "union": f"SELECT DISTINCT member FROM {{kset}} WHERE key IN ({_IN})",
}
for _kind, _text in _SALG.items():
    add(f"s{_kind}", lambda v, k=_kind: S.algebra(v.set, DAYS, k), _text)
    add(f"s{_kind}store", lambda v, k=_kind: S.store(S.algebra(v.set, DAYS, k), "dst"), f"SELECT 'dst' AS key, member FROM ({_text})")
add("sdiff_same", lambda v: S.algebra(v.set, [DAYS[0], DAYS[0]], "diff"), "SELECT member FROM {kset} WHERE false")
add("sinter_same", lambda v: S.algebra(v.set, [DAYS[0], DAYS[0]], "inter"), f"SELECT member FROM {{kset}} WHERE key = '{DAYS[0]}'")
for _kind, _text in _SALG.items():
    add(f"s{_kind}store_reply", lambda v, k=_kind: S.store_reply(S.algebra(v.set, DAYS, k), "dst"), f"SELECT 'dst' AS key, count(*) AS n, CASE WHEN count(*) > 0 THEN 'set' ELSE 'del' END AS op FROM ({_text})")
add("sinterstore_empty", lambda v: S.store_reply(S.algebra(v.set, [DAYS[0], "nothing"], "inter"), "dst"), "SELECT 'dst' AS key, CAST(0 AS BIGINT) AS n, 'del' AS op")
add("zinterstore_reply", lambda v: S.store_reply(Z.algebra(v.spend, ["F", "P"], "inter"), "d"), f"SELECT 'd' AS key, count(*) AS n, CASE WHEN count(*) > 0 THEN 'set' ELSE 'del' END AS op FROM ({_alg(['F', 'P'], [1.0, 1.0], 'sum', ' HAVING count(*) = 2')})")
add("sintercard", lambda v: S.size_up_to(S.algebra(v.set, DAYS[:2], "inter"), 10), f"SELECT least(count(*), 10) AS n FROM (SELECT member FROM {{kset}} WHERE key IN ('{DAYS[0]}', '{DAYS[1]}') GROUP BY 1 HAVING count(*) = 2)")
add("sadd", lambda v: S.add(v.set, sask(v)), f"SELECT key, member FROM {{kset}} UNION SELECT key, member FROM {SASK_SQL}")
add("srem", lambda v: S.remove(v.set, sask(v)), f"SELECT key, member FROM {{kset}} EXCEPT SELECT key, member FROM {SASK_SQL}")
add("scard", lambda v: v.set.groupBy("key").agg(F.count("*").alias("n")), "SELECT key, count(*) AS n FROM {kset} GROUP BY 1")
add("smembers", lambda v: v.set.select("key", "member"), "SELECT key, member FROM {kset}")
_SIS = f"SELECT q.idx, q.key, q.member, CAST(s.key IS NOT NULL AS INTEGER) AS found FROM {SASK_SQL} LEFT JOIN {{kset}} s ON s.key = q.key AND s.member = q.member"
add("sismember", lambda v: S.is_member(v.set, sask(v).where("idx < 2")), _SIS + " WHERE q.idx < 2")
add("smismember", lambda v: S.is_member(v.set, sask(v)), _SIS)
add("smove", lambda v: S.move(v.set, v.set.where(F.col("key") == DAYS[0]).where("member like '1%'").select(F.col("key").alias("src"), F.lit(DAYS[1]).alias("dst"), "member").union(v.rows([(DAYS[0], DAYS[2], "nobody")], "src string, dst string, member string"))), f"SELECT DISTINCT CASE WHEN key = '{DAYS[0]}' AND member LIKE '1%' THEN '{DAYS[1]}' ELSE key END AS key, member FROM {{kset}}")
add("srandmember_det", lambda v: Z.sample(v.set, 3, "r"), f"SELECT * FROM (SELECT *, {_MD5.format(seed='r', name='member')} AS place FROM {{kset}}) WHERE place <= 3")
add("spop_det", lambda v: v.set.join(Z.sample(v.set, 3, "p"), ["key", "member"], "left_anti"), f"SELECT key, member FROM (SELECT *, {_MD5.format(seed='p', name='member')} AS place FROM {{kset}}) WHERE place > 3")

# Strings and keys ----------------------------------------------------------------------------------------------------

KASK = [(0, "order:1"), (1, "order:99"), (2, "nothing"), (3, "order:99"), (4, "order:32"), (5, "order:97")]
KASK_SQL = "(VALUES " + ", ".join(map(str, KASK)) + ") q(idx, key)"


def kask(v: Keyspace) -> DataFrame:
    return v.rows(KASK, "idx long, key string")


add("get", lambda v: K.live(v.str, NOW_MS).select("key", "value"), f"SELECT key, value FROM {{str}} WHERE expire_at = 0 OR expire_at >= {NOW_MS}")
add("mget", lambda v: K.get(v.str, kask(v), NOW_MS), f"SELECT q.idx, q.key, s.value FROM {KASK_SQL} LEFT JOIN {{live}} s ON s.key = q.key")
add("exists", lambda v: K.exists(v.str, kask(v), NOW_MS), f"SELECT count(*) AS n FROM {KASK_SQL} JOIN {{live}} s ON s.key = q.key")


def types(v: Keyspace) -> DataFrame:
    """TYPE of every key of five sorts of tables."""
    kinds = {"string": K.live(v.str, NOW_MS), "hash": v.hash, "list": v.list, "set": v.set, "zset": v.zset}
    out = None
    for name, df in kinds.items():
        own = df.select("key").distinct().withColumn("type", F.lit(name))
        out = own if out is None else out.union(own)
    return out


add("type", types, " UNION ALL ".join(f"SELECT DISTINCT key, '{n}' AS type FROM {{{t}}}" for n, t in (("string", "live"), ("hash", "hash"), ("list", "list"), ("set", "kset"), ("zset", "zset"))))
add("type_of", lambda v: K.type_of({"string": K.live(v.str, NOW_MS), "hash": v.hash, "zset": v.zset}, kask(v).union(v.rows([(6, "customer:1"), (7, "BUILDING")], "idx long, key string"))), f"WITH q AS (SELECT * FROM {KASK_SQL} UNION ALL SELECT 6, 'customer:1' UNION ALL SELECT 7, 'BUILDING') SELECT idx, key, CASE WHEN key IN (SELECT key FROM {{live}}) THEN 'string' WHEN key IN (SELECT key FROM {{hash}}) THEN 'hash' WHEN key IN (SELECT key FROM {{zset}}) THEN 'zset' END AS type FROM q")
add("strlen", lambda v: K.live(v.str, NOW_MS).select("key", F.octet_length("value").cast("long").alias("len")), "SELECT key, CAST(strlen(value) AS BIGINT) AS len FROM {live}")
add("strlen_of", lambda v: K.length(v.str, kask(v), NOW_MS), f"SELECT q.idx, q.key, CAST(coalesce(strlen(s.value), 0) AS BIGINT) AS len FROM {KASK_SQL} LEFT JOIN {{live}} s ON s.key = q.key")
add("getrange", lambda v: K.live(v.str, NOW_MS).select("key", K.byte_range(F.col("value"), 2, -2).alias("part"), K.byte_range(F.col("value"), -3, 100).alias("tail"), K.byte_range(F.col("value"), 5, 2).alias("none")), "SELECT key, substr(value, 3, length(value) - 3) AS part, right(value, 3) AS tail, '' AS none FROM {live}")
add("setrange", lambda v: K.live(v.str, NOW_MS).select("key", K.set_range(F.col("value"), 3, "xyz").alias("value")), "SELECT key, left(value, 3) || 'xyz' || substr(value, 7) AS value FROM {live}")
add("append", lambda v: K.append(v.str, v.rows([(2, "order:99", "b"), (1, "order:99", "a"), (1, "order:1", "x"), (1, "new", "c")], "idx long, key string, value string"), NOW_MS), "SELECT 'order:99' AS key, coalesce((SELECT value FROM {live} WHERE key = 'order:99'), '') || 'ab' AS value, CAST(0 AS BIGINT) AS expire_at UNION ALL SELECT 'order:1', coalesce((SELECT value FROM {live} WHERE key = 'order:1'), '') || 'x', 0 UNION ALL SELECT 'new', 'c', 0")
for _name, _delta, _text in (("incr", "1", "1"), ("decr", "-1", "-1"), ("incrby", "delta", "delta"), ("decrby", "-delta", "-delta")):
    add(_name, lambda v, d=_delta: K.increase(v.rows([("1", "100", 0), ("2", "x", 0), ("3", "50", 7)], "key string, value string, expire_at long"), v.log.where("op = 'incr'").select("key", F.expr(d).cast("long").alias("delta")), NOW_MS), f"SELECT key, CAST(sum({_text}) + CASE key WHEN '1' THEN 100 ELSE 0 END AS BIGINT) AS value FROM {{log}} WHERE op = 'incr' GROUP BY key")
_UP = "sign(x) * ceil(abs(CAST(x AS DECIMAL(20,6))) * 100) / 100"
add("incrbyfloat", lambda v: v.table("lineitem").groupBy(F.col("l_orderkey").cast("string").alias("key")).agg(F.sum(up2(F.col("l_discount") * F.when(F.col("l_linenumber") % 2 == 0, -1.0).otherwise(1.0))).cast("double").alias("value")), f"SELECT CAST(k AS VARCHAR) AS key, CAST(sum(CAST({_UP} AS DECIMAL(20,2))) AS DOUBLE) AS value FROM (SELECT l_orderkey AS k, l_discount * CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END AS x FROM lineitem) GROUP BY 1")
NEW = [(1, "order:1", "a", 0), (2, "order:1", "b", 5), (3, "fresh", "c", 0), (4, "fresh", "d", 9), (5, "order:99", "e", 3), (6, "order:99", "f", 0)]
_NEWK = "(VALUES " + ", ".join(map(str, NEW)) + ") q(idx, key, value, expire_at)"


def newk(v: Keyspace) -> DataFrame:
    return v.rows(NEW, "idx long, key string, value string, expire_at long")


_PUT = "WITH n AS (SELECT key, {pick}(value, idx) AS nv, {pick}(expire_at, idx) AS ne FROM " + _NEWK + " GROUP BY 1), j AS (SELECT coalesce(s.key, n.key) AS key, s.value AS old, s.expire_at AS was, nv, ne, n.key IS NOT NULL AND ({cond}) AS takes FROM {{live}} s FULL JOIN n ON s.key = n.key) SELECT key, CASE WHEN takes THEN nv ELSE old END AS value, CASE WHEN takes THEN {exp} ELSE was END AS expire_at, old FROM j WHERE takes OR old IS NOT NULL"
for _name, _args, _pick, _cond, _exp in (("mset", {}, "arg_max", "true", "ne"), ("setnx", {"only": "NX"}, "arg_min", "s.key IS NULL", "ne"), ("set_xx", {"only": "XX"}, "arg_max", "s.key IS NOT NULL", "ne"), ("set_keepttl", {"keep_ttl": True}, "arg_max", "true", "coalesce(was, ne)")):
    add(_name, lambda v, a=_args: K.put(v.str, newk(v), NOW_MS, **a), _PUT.format(pick=_pick, cond=_cond, exp=_exp))
TIMED = [(1, "order:1", "a", "EX", 10), (2, "order:99", "b", "PX", 1500), (3, "fresh", "c", "EXAT", 1_800_000_000), (4, "other", "d", "PXAT", 1_800_000_000_123), (5, "order:32", "e", None, None)]
_TIMED = "(VALUES (1, 'order:1', 'a', 'EX', 10), (2, 'order:99', 'b', 'PX', 1500), (3, 'fresh', 'c', 'EXAT', 1800000000), (4, 'other', 'd', 'PXAT', 1800000000123), (5, 'order:32', 'e', NULL, NULL)) q(idx, key, value, kind, n)"
_AT_KIND = f"CAST(CASE kind WHEN 'EX' THEN {NOW_MS} + n * 1000 WHEN 'PX' THEN {NOW_MS} + n WHEN 'EXAT' THEN n * 1000 WHEN 'PXAT' THEN n ELSE 0 END AS BIGINT)"


def timed(v: Keyspace) -> DataFrame:
    return v.rows(TIMED, "idx long, key string, value string, kind string, n long")


for _name, _only, _cond in (("setex", None, "true"), ("set_ex_nx", "NX", "s.key IS NULL"), ("set_ex_xx", "XX", "s.key IS NOT NULL")):
    add(_name, lambda v, o=_only: K.put_timed(v.str, timed(v), NOW_MS, o), f"WITH n AS (SELECT key, value AS nv, {_AT_KIND} AS ne FROM {_TIMED}), j AS (SELECT coalesce(s.key, n.key) AS key, s.value AS old, s.expire_at AS was, nv, ne, n.key IS NOT NULL AND ({_cond}) AS takes FROM {{live}} s FULL JOIN n ON s.key = n.key) SELECT key, CASE WHEN takes THEN nv ELSE old END AS value, CASE WHEN takes THEN ne ELSE was END AS expire_at, old FROM j WHERE takes OR old IS NOT NULL")
add("set_get", lambda v: K.put(v.str, newk(v), NOW_MS).join(newk(v).select("key").distinct(), "key", "left_semi").select("key", "old"), f"SELECT DISTINCT q.key, s.value AS old FROM {_NEWK} LEFT JOIN {{live}} s ON s.key = q.key")
add("getset", lambda v: K.put(v.str, newk(v), NOW_MS, "XX").join(newk(v).select("key").distinct(), "key", "left_semi").select("key", "value", "old"), f"SELECT s.key, arg_max(q.value, q.idx) AS value, min(s.value) AS old FROM {{live}} s JOIN {_NEWK} ON q.key = s.key GROUP BY 1")
add("getdel", lambda v: K.take(v.str, kask(v), NOW_MS), f"SELECT key, value FROM {{live}} WHERE key IN (SELECT key FROM {KASK_SQL})")
add("del", lambda v: K.delete(v.str, kask(v), NOW_MS), f"SELECT * FROM {{live}} WHERE key NOT IN (SELECT key FROM {KASK_SQL})")
GETEX = [("order:99", "PX", 5000), ("order:1", "EX", 5), ("order:32", "EXAT", 1_800_000_000), ("order:97", "PERSIST", None), ("order:95", None, None), ("order:93", "PXAT", 1_800_000_000_000)]
_GETEX = "(VALUES ('order:99', 'PX', 5000), ('order:1', 'EX', 5), ('order:32', 'EXAT', 1800000000), ('order:97', 'PERSIST', NULL), ('order:95', NULL, NULL), ('order:93', 'PXAT', 1800000000000)) q(key, kind, n)"
add("getex", lambda v: K.get_expire(v.str, v.rows(GETEX, "key string, kind string, n long"), NOW_MS), f"SELECT s.key, s.value, CASE WHEN kind IS NULL THEN s.expire_at ELSE {_AT_KIND} END AS expire_at FROM {{live}} s JOIN {_GETEX} ON q.key = s.key")
PAIRS = [("order:99", "order:7"), ("order:32", "moved"), ("order:1", "gone"), ("nothing", "x"), ("order:97", "order:95")]


def pairs(v: Keyspace) -> DataFrame:
    return v.rows(PAIRS, "src string, dst string")


_PAIRS = "(VALUES " + ", ".join(map(str, PAIRS)) + ") p(src, dst)"
add("copy", lambda v: K.copy(v.str, pairs(v), NOW_MS), f"SELECT * FROM {{live}} UNION ALL SELECT dst, value, expire_at FROM {{live}} s JOIN {_PAIRS} ON src = s.key WHERE dst NOT IN (SELECT key FROM {{live}})")
add("rename", lambda v: K.copy(v.str, pairs(v), NOW_MS, True, True), f"WITH m AS (SELECT src, dst, value, expire_at FROM {{live}} s JOIN {_PAIRS} ON src = s.key) SELECT * FROM {{live}} WHERE key NOT IN (SELECT src FROM m UNION ALL SELECT dst FROM m) UNION ALL SELECT dst, value, expire_at FROM m")
add("ping_echo", lambda v: v.rows([("hello",), ("",)], "arg string").select("arg", F.lit("PONG").alias("ping"), F.col("arg").alias("echo")), "SELECT arg, 'PONG' AS ping, arg AS echo FROM (VALUES ('hello'), ('')) t(arg)")
ODD = ["007", "+5", "1.10", "5f", "abc", "1e2", "", "-0012", "12345678901234567890123", ".5", "1.", "--1"]
add("canonical_value", lambda v: v.rows([(x,) for x in ODD], "value string").select("value", canonical(F.col("value")).alias("canonical")), "SELECT * FROM (VALUES ('007','7'),('+5','5'),('1.10','1.1'),('5f','5.0'),('abc','abc'),('1e2','100.0'),('',''),('-0012','-12'),('12345678901234567890123','12345678901234567890123'),('.5','0.5'),('1.','1.0'),('--1','--1')) t(value, canonical)")
_GIVEN = f"CASE WHEN CAST(substr(key, 7) AS BIGINT) % 3 = 0 THEN NULL ELSE {NOW_MS} + 600000 END"
for _only, _cond in (("", "true"), ("NX", "was = 0"), ("XX", "was <> 0"), ("GT", "was <> 0 AND given > was"), ("LT", "was = 0 OR given < was")):
    add(f"expire{'_' * bool(_only)}{_only.lower()}", lambda v, o=_only: K.expire(v.str, v.str.where(F.substring("key", 7, 20).cast("long") % 3 != 0).select("key", F.lit(NOW_MS + 600_000).alias("at")), NOW_MS, o or None), f"WITH j AS (SELECT key, expire_at AS was, {_GIVEN} AS given FROM {{live}}) SELECT key, CASE WHEN given IS NOT NULL AND ({_cond}) THEN given ELSE was END AS expire_at, CAST(given IS NOT NULL AND ({_cond}) AS INTEGER) AS reply FROM j")
for _name, _unit in (("ttl", 1000), ("pttl", 1)):
    add(_name, lambda v, u=_unit: kask(v).join(v.str, "key", "left").select("idx", "key", K.ttl(F.col("expire_at"), NOW_MS, u).alias("left")).union(v.str.select(F.lit(-1).cast("long"), "key", K.ttl(F.col("expire_at"), NOW_MS, u))), f"WITH a AS (SELECT q.idx, q.key, s.expire_at FROM {KASK_SQL} LEFT JOIN {{str}} s ON s.key = q.key UNION ALL SELECT -1, key, expire_at FROM {{str}}) SELECT idx, key, CASE WHEN expire_at IS NULL THEN -2 WHEN expire_at = 0 THEN -1 WHEN expire_at < {NOW_MS} THEN -2 ELSE CAST(floor((expire_at - {NOW_MS}) / {_unit}) AS BIGINT) END AS left FROM a")
for _name, _unit in (("expiretime", 1000), ("pexpiretime", 1)):
    add(_name, lambda v, u=_unit: kask(v).join(v.str, "key", "left").select("idx", "key", K.expire_time(F.col("expire_at"), NOW_MS, u).alias("at")).union(v.str.select(F.lit(-1).cast("long"), "key", K.expire_time(F.col("expire_at"), NOW_MS, u))), f"WITH a AS (SELECT q.idx, q.key, s.expire_at FROM {KASK_SQL} LEFT JOIN {{str}} s ON s.key = q.key UNION ALL SELECT -1, key, expire_at FROM {{str}}) SELECT idx, key, CASE WHEN expire_at IS NULL THEN -2 WHEN expire_at = 0 THEN -1 WHEN expire_at < {NOW_MS} THEN -2 ELSE expire_at // {_unit} END AS at FROM a")
add("persist", lambda v: K.live(v.str, NOW_MS).select("key", "value", F.lit(0).cast("long").alias("expire_at"), (F.col("expire_at") != 0).cast("int").alias("reply")), "SELECT key, value, CAST(0 AS BIGINT) AS expire_at, CAST(expire_at <> 0 AS INTEGER) AS reply FROM {live}")

# State from the log --------------------------------------------------------------------------------------------------

_LAST = "WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM {log}) WHERE r = 1)"
_ALIVE = f"op <> 'del' AND (expire_at = 0 OR expire_at >= {NOW_MS})"
add("lww_state", lambda v: state.latest(v.log), _LAST + " SELECT key, seq, op, value, expire_at FROM l")
add("visible_keys", lambda v: state.visible(v.log, NOW_MS), f"{_LAST} SELECT key, seq, op, value, expire_at FROM l WHERE {_ALIVE}")
add("dbsize", lambda v: state.visible(v.log, NOW_MS).agg(F.count("*").alias("n")), f"{_LAST} SELECT count(*) AS n FROM l WHERE {_ALIVE}")
add("flush", lambda v: state.latest(state.after_flush(v.log.withColumn("op", F.when(F.col("seq") % 4001 == 4000, "flush").otherwise(F.col("op"))))), "WITH f AS (SELECT *, (SELECT max(seq) FROM {log} WHERE seq % 4001 = 4000) AS fl FROM {log} WHERE seq % 4001 <> 4000), l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM f WHERE fl IS NULL OR seq > fl) SELECT key, seq, op, value, expire_at FROM l WHERE r = 1")
add("counters", lambda v: state.counters(v.log), "WITH r AS (SELECT *, sum(CASE WHEN op IN ('set', 'del') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS run FROM {log} WHERE op IN ('set', 'incr', 'del')), g AS (SELECT key, run, sum(CASE WHEN op = 'incr' THEN delta ELSE 0 END) AS value, count(*) FILTER (WHERE op = 'del') AS dels, count(*) AS n FROM r GROUP BY 1, 2), m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY run DESC) AS k FROM g) SELECT key, CAST(value AS BIGINT) AS value FROM m WHERE k = 1 AND NOT (dels = 1 AND n = 1)")
add("merge_batches", lambda v: state.merge(state.latest(v.log.where("seq % 2 = 0")), v.log.where("seq % 2 <> 0")), _LAST + " SELECT key, seq, op, value, expire_at FROM l")
add("validate_sizes", lambda v: state.valid_sizes(v.zset, 310), "SELECT key, count(*) AS n FROM {zset} GROUP BY 1 HAVING count(*) > 310")
add("validate_limits", lambda v: state.valid(v.str.select("key", "value"), LIMITS | {"value": 8}), "SELECT key, value FROM {str} WHERE strlen(key) <= 256 AND strlen(value) <= 8")

# Hashes --------------------------------------------------------------------------------------------------------------

HASK = [(0, "customer:1", "name"), (1, "customer:2", "nation"), (2, "customer:2", "nofield"), (3, "nobody", "name"), (4, "customer:1", "name")]
HASK_SQL = "(VALUES " + ", ".join(map(str, HASK)) + ") q(idx, key, field)"


def hask(v: Keyspace) -> DataFrame:
    return v.rows(HASK, "idx long, key string, field string")


_HGET = f"FROM {HASK_SQL} LEFT JOIN {{hash}} h ON h.key = q.key AND h.field = q.field"
add("hget", lambda v: v.hash.where("field = 'name'").select("key", "value"), "SELECT key, value FROM {hash} WHERE field = 'name'")
add("hmget", lambda v: H.get(v.hash, hask(v)).select("idx", "key", "field", "value"), f"SELECT q.idx, q.key, q.field, h.value {_HGET}")
add("hmget_wide", lambda v: H.wide(v.hash, ["segment", "nation"]), "SELECT key, max(value) FILTER (WHERE field = 'segment') AS segment, max(value) FILTER (WHERE field = 'nation') AS nation FROM {hash} GROUP BY 1")
add("hgetall", lambda v: v.hash.select("key", "field", "value"), "SELECT key, field, value FROM {hash}")
add("hkeys", lambda v: v.hash.select("key", "field"), "SELECT key, field FROM {hash}")
add("hvals", lambda v: v.hash.select("key", "value"), "SELECT key, value FROM {hash}")
add("hlen", lambda v: v.hash.groupBy("key").agg(F.count("*").alias("n")), "SELECT key, count(*) AS n FROM {hash} GROUP BY 1")
add("hexists", lambda v: H.get(v.hash, hask(v)).select("idx", "key", "field", "found"), f"SELECT q.idx, q.key, q.field, CAST(h.key IS NOT NULL AS INTEGER) AS found {_HGET}")
add("hstrlen", lambda v: H.get(v.hash, hask(v)).select("idx", "key", "field", "len"), f"SELECT q.idx, q.key, q.field, CAST(coalesce(strlen(h.value), 0) AS BIGINT) AS len {_HGET}")


def hnew(v: Keyspace) -> DataFrame:
    return hask(v).withColumn("value", F.concat(F.lit("v"), F.col("idx")))


_HPUT = "WITH n AS (SELECT key, field, {pick}('v' || idx, idx) AS given FROM " + HASK_SQL + " GROUP BY 1, 2) SELECT coalesce(h.key, n.key) AS key, coalesce(h.field, n.field) AS field, coalesce({order}) AS value FROM {{hash}} h FULL JOIN n ON h.key = n.key AND h.field = n.field"
add("hset", lambda v: H.put(v.hash, hnew(v)), _HPUT.format(pick="arg_max", order="given, value"))
add("hsetnx", lambda v: H.put(v.hash, hnew(v), True), _HPUT.format(pick="arg_min", order="value, given"))
add("hdel", lambda v: H.delete(v.hash, hask(v)), f"SELECT key, field, value FROM {{hash}} h WHERE NOT EXISTS (SELECT 1 FROM {HASK_SQL} WHERE q.key = h.key AND q.field = h.field)")
add("hincrby", lambda v: H.increase(v.hash, hask(v).select("key", "field", F.col("idx").alias("delta"))), f"SELECT d.key, d.field, CAST(coalesce(TRY_CAST(h.value AS BIGINT), 0) + delta AS BIGINT) AS value FROM (SELECT key, field, sum(idx) AS delta FROM {HASK_SQL} GROUP BY 1, 2) d LEFT JOIN {{hash}} h ON h.key = d.key AND h.field = d.field")
add("hincrbyfloat", lambda v: H.increase_float(v.hash, v.hash.where("field = 'acctbal'").select("key", "field", F.lit(1.234).alias("delta"))), "SELECT key, field, CAST(CAST(value AS DECIMAL(20,2)) + 1.24 AS DOUBLE) AS value FROM {hash} WHERE field = 'acctbal'")
add("hrandfield_det", lambda v: Z.sample(v.hash, 2, "h"), f"SELECT * FROM (SELECT *, {_MD5.format(seed='h', name='field')} AS place FROM {{hash}}) WHERE place <= 2")

# Lists ---------------------------------------------------------------------------------------------------------------

_LN = "SELECT *, count(*) OVER (PARTITION BY key) AS n FROM {list}"
_DENSE = "SELECT key, row_number() OVER (PARTITION BY key ORDER BY {order}) - 1 AS pos, value FROM ({rows})"
add("llen", lambda v: v.list.groupBy("key").agg(F.count("*").alias("n")), "SELECT key, count(*) AS n FROM {list} GROUP BY 1")
add("lindex", lambda v: L.index(v.list, 3), "SELECT key, value FROM {list} WHERE pos = 3")
add("lindex_neg", lambda v: L.index(v.list, -2), f"SELECT key, value FROM ({_LN}) WHERE pos = n - 2")
add("lrange", lambda v: L.slice_(v.list, 2, 5), "SELECT key, pos, value FROM {list} WHERE pos BETWEEN 2 AND 5")
add("lrange_neg", lambda v: L.slice_(v.list, -4, -2), f"SELECT key, pos, value FROM ({_LN}) WHERE pos BETWEEN n - 4 AND n - 2")
_LPOS = "SELECT key, pos FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos {dir}) AS k FROM {{list}} WHERE value = 'click'{more}) WHERE {cond}"
add("lpos", lambda v: L.positions(v.list, "click"), _LPOS.format(dir="", more="", cond="k = 1"))
add("lpos_rank", lambda v: L.positions(v.list, "click", -2, 2), _LPOS.format(dir="DESC", more="", cond="k BETWEEN 2 AND 3"))
add("lpos_all", lambda v: L.positions(v.list, "click", 1, 0), _LPOS.format(dir="", more="", cond="true"))
add("lpos_maxlen", lambda v: L.positions(v.list, "click", 1, 0, 10), _LPOS.format(dir="", more=" AND pos < 10", cond="true"))
LNEW = [("1", 0, "x"), ("1", 1, "y"), ("nobody", 0, "z")]
_LNEW = "(VALUES " + ", ".join(map(str, LNEW)) + ") q(key, idx, value)"


def lnew(v: Keyspace) -> DataFrame:
    return v.rows(LNEW, "key string, idx long, value string")


def _push(side: int, more: str = "") -> str:
    return _DENSE.format(order="side, place", rows=f"SELECT key, 0 AS side, pos AS place, value FROM {{list}} UNION ALL SELECT key, {side}, {side} * idx, value FROM {_LNEW}{more}")


add("lpush", lambda v: L.push(v.list, lnew(v), True), _push(-1))
add("rpush", lambda v: L.push(v.list, lnew(v)), _push(1))
add("lpushx", lambda v: L.push(v.list, lnew(v), True, True), _push(-1, " WHERE key IN (SELECT key FROM {list})"))
add("rpushx", lambda v: L.push(v.list, lnew(v), False, True), _push(1, " WHERE key IN (SELECT key FROM {list})"))
add("linsert", lambda v: L.insert(v.list, "error", "new"), _DENSE.format(order="pos", rows="SELECT key, CAST(pos AS DOUBLE) AS pos, value FROM {list} UNION ALL SELECT key, min(pos) - 0.5, 'new' FROM {list} WHERE value = 'error' GROUP BY 1"))
add("linsert_after", lambda v: L.insert(v.list, "error", "new", False), _DENSE.format(order="pos", rows="SELECT key, CAST(pos AS DOUBLE) AS pos, value FROM {list} UNION ALL SELECT key, min(pos) + 0.5, 'new' FROM {list} WHERE value = 'error' GROUP BY 1"))
add("lset", lambda v: L.put(v.list, -1, "last"), f"SELECT key, pos, CASE WHEN pos = n - 1 THEN 'last' ELSE value END AS value FROM ({_LN})")
for _name, _n, _cond in (("lrem_head", 2, "a > 2"), ("lrem_tail", -2, "d > 2"), ("lrem_all", 0, "false")):
    add(_name, lambda v, n=_n: L.remove(v.list, n, "view"), _DENSE.format(order="pos", rows=f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, value ORDER BY pos) AS a, row_number() OVER (PARTITION BY key, value ORDER BY pos DESC) AS d FROM {{list}}) WHERE value <> 'view' OR {_cond}"))
add("ltrim", lambda v: L.trim(v.list, 2, -3), _DENSE.format(order="pos", rows=f"SELECT * FROM ({_LN}) WHERE pos BETWEEN 2 AND greatest(n - 3, 0)"))
add("lpop", lambda v: L.pop(v.list, 2), "SELECT key, pos, value FROM {list} WHERE pos < 2")
add("rpop", lambda v: L.pop(v.list, 2, True), f"SELECT key, pos, value FROM ({_LN}) WHERE pos >= n - 2")
_MOVE = "WITH e AS (SELECT key, {end}(pos) AS p FROM {{list}} WHERE key IN ('1', '2') GROUP BY 1), a AS (SELECT l.key, 0 AS side, pos AS place, value FROM {{list}} l LEFT JOIN e ON l.key = e.key WHERE e.p IS NULL OR pos <> p UNION ALL SELECT CASE l.key WHEN '1' THEN '2' ELSE 'fresh' END, {side}, 0, value FROM {{list}} l JOIN e ON l.key = e.key AND pos = p) " + _DENSE.format(order="side, place", rows="SELECT * FROM a")
MOVES = [("1", "2"), ("2", "fresh"), ("nobody", "1")]
add("lmove", lambda v: L.move(v.list, v.rows(MOVES, "src string, dst string"), False, True), _MOVE.format(end="min", side=1))
add("rpoplpush", lambda v: L.move(v.list, v.rows(MOVES, "src string, dst string"), True, False), _MOVE.format(end="max", side=-1))

# Placement, statistics, compaction, decoding -------------------------------------------------------------------------

TAGS = ["a{b}c", "{x}{y}", "plain", "a{}b", "p{q", "a{b}c}d", "}a{", "é{ü}"]
add("hash_tag", lambda v: v.rows([(x,) for x in TAGS], "key string").select("key", placement.hash_tag(F.col("key")).alias("tag")), "SELECT key, CASE WHEN p > 0 AND q > p THEN substr(key, p + 1, q - p - 1) ELSE key END AS tag FROM (SELECT key, CASE WHEN contains(key, '<') THEN length(key) - instr(reverse(key), '<') + 1 ELSE 0 END AS p, CASE WHEN contains(key, '>') THEN length(key) - instr(reverse(key), '>') + 1 ELSE 0 END AS q FROM (VALUES ('a<b>c'), ('<x><y>'), ('plain'), ('a<>b'), ('p<q'), ('a<b>c>d'), ('>a<'), ('é<ü>')) t(key))".replace("<", "{").replace("q {", "q <").replace("q >", "q >").replace(">", "}").replace("p } 0", "p > 0").replace("q } p", "q > p"))
_HASH = "CAST('0x' || substr(md5(key), 1, 15) AS BIGINT) * CASE WHEN substr(md5(key), 16, 1) < '8' THEN 1 ELSE -1 END"
_SLOT = f"CASE WHEN ({_HASH}) > 0 THEN abs((({_HASH}) // {placement.SLOTS // 2 * placement.BUCKETS}) % {placement.SLOTS // 2}) ELSE {placement.SLOTS // 2} + abs((({_HASH}) // {placement.SLOTS // 2 * placement.BUCKETS}) % {placement.SLOTS // 2}) END"
_BUCKET = f"abs(({_HASH}) % {placement.BUCKETS})"
_HKEYS = "(SELECT DISTINCT key FROM {hash})"


def hkeys(v: Keyspace) -> DataFrame:
    return v.hash.select("key").distinct()


for _name, _of, _col, _text in (("slot_of", placement.slot, "slot", _SLOT), ("bucket_of", placement.bucket, "bucket", _BUCKET), ("split_index", placement.split, "split", f"abs((({_HASH}) >> 32) % 3)"), ("wal_group", placement.wal_group, "wal_group", f"{_BUCKET} // {placement.GROUP}")):
    add(_name, lambda v, f=_of, c=_col: hkeys(v).select("key", f(F.col("key")).alias(c)), f"SELECT key, CAST({_text} AS BIGINT) AS {_col} FROM {_HKEYS}")
add("worker_of", lambda v: hkeys(v).select("key", placement.worker(placement.slot(F.col("key"))).alias("worker")), f"SELECT key, CAST(({_SLOT}) % {placement.WORKERS} AS BIGINT) AS worker FROM {_HKEYS}")
add("skew_report", lambda v: placement.skew(hkeys(v)), f"SELECT CAST({_SLOT} AS BIGINT) AS slot, CAST({_BUCKET} // {placement.GROUP} AS BIGINT) AS wal_group, count(*) AS n FROM {_HKEYS} GROUP BY 1, 2")
add("slot_spread", lambda v: placement.skew(hkeys(v)).groupBy("slot").agg(F.sum("n").alias("n")), f"SELECT CAST({_SLOT} AS BIGINT) AS slot, count(*) AS n FROM {_HKEYS} GROUP BY 1")
add("bucket_splits", lambda v: placement.bucket_splits(v.str.select("key"), 32), f"SELECT CAST({_SLOT} AS BIGINT) AS slot, CAST(abs(({_HASH}) % 32) AS BIGINT) AS bucket, count(*) AS n, CASE WHEN count(*) <= 48 THEN 1 WHEN count(*) <= 144 THEN 3 ELSE 9 END AS splits FROM {{str}} GROUP BY 1, 2")
add("volume_of_slot", lambda v: placement.volumes(v.spark.range(placement.SLOTS).select(F.col("id").alias("slot")), "/mnt/a:0-2,/mnt/b:3-6"), "SELECT slot, CASE WHEN slot <= 2 THEN '/mnt/a' WHEN slot <= 6 THEN '/mnt/b' END AS volume FROM range(8) t(slot)")
IPS = ["1.2.3.4", "255.255.255.255", "256.1.1.1", "01.002.3.4", "1.2.3", "1.2.3.4\n", "a.b.c.d"]
add("ipv4", lambda v: v.rows([(x,) for x in IPS], "host string").select("host", placement.is_ipv4(F.col("host")).alias("ok")), "SELECT host, regexp_full_match(host, '(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)(\\.(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)){3}') AS ok FROM (VALUES ('1.2.3.4'), ('255.255.255.255'), ('256.1.1.1'), ('01.002.3.4'), ('1.2.3'), ('1.2.3.4' || chr(10)), ('a.b.c.d')) t(host)")
add("snowflake_parts", lambda v: v.log.select("seq", *placement.snowflake_parts(placement.snowflake(F.col("seq") * 1000, 165, F.col("seq") % 4096))), "SELECT seq, seq * 1000 AS ms, CAST(165 // 32 AS BIGINT) AS centre, CAST(165 % 32 AS BIGINT) AS machine, seq % 4096 AS place FROM {log}")
add("snowflake", lambda v: v.log.select("seq", placement.snowflake(F.col("seq") * 1000, 5, F.col("seq") % 4096).alias("id")), "SELECT seq, (seq * 1000 << 22) | (5 << 12) | (seq % 4096) AS id FROM {log}")
add("key_prefix_counts", lambda v: metrics.prefix_counts(v.str.select("key"), 9), "SELECT left(key, d) AS prefix, count(*) AS n FROM {str}, range(1, 10) r(d) WHERE d <= length(key) GROUP BY 1")
add("prefix_group", lambda v: v.hash.groupBy(F.substring_index("key", ":", 1).alias("prefix")).agg(F.count("*").alias("n")), "SELECT split_part(key, ':', 1) AS prefix, count(*) AS n FROM {hash} GROUP BY 1")
add("cmd_stat", lambda v: v.log.groupBy(F.col("op").alias("cmd")).agg(F.count("*").alias("n")), "SELECT op AS cmd, count(*) AS n FROM {log} GROUP BY 1")
add("latency_percentiles", lambda v: metrics.latency(v.table("events").select(F.col("event_type").alias("cmd"), "value")), "SELECT event_type AS cmd, count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.9) AS p9, quantile_disc(value, 0.999) AS p999 FROM events GROUP BY 1")
add("latency_rolling", lambda v: metrics.rolling_latency(v.table("events").select(F.col("event_type").alias("cmd"), "ts", "value"), "1 day", "12 hours"), "WITH e AS (SELECT event_type AS cmd, value, epoch_us(ts) AS t FROM events), w AS (SELECT cmd, value, (t // 43200000000 + k) * 43200 AS until FROM e, (VALUES (1), (2)) r(k)) SELECT CAST(until AS BIGINT) AS until, cmd, count(*) AS n, quantile_disc(value, 0.9) AS p9 FROM w GROUP BY 1, 2")
_PACKED = "SELECT event_type AS name, strlen(props) AS raw, 3 + event_id % 20 AS packed, event_id % 11 AS us FROM events"
add("compress_stats", lambda v: metrics.compress_stats(v.table("events").select(F.col("event_type").alias("name"), F.octet_length("props").cast("long").alias("raw"), (3 + F.col("event_id") % 20).alias("packed"), (F.col("event_id") % 11).alias("us"))), f"SELECT *, CASE WHEN compressed_count > 0 THEN round(us_total / compressed_count, 6) END AS us_avg, round(stored_total / raw_total, 6) AS ratio FROM (SELECT name, count(*) AS raw_count, count(*) FILTER (WHERE packed < raw) AS compressed_count, CAST(sum(raw) AS BIGINT) AS raw_total, CAST(sum(least(raw, packed)) AS BIGINT) AS stored_total, CAST(coalesce(sum(us) FILTER (WHERE packed < raw), 0) AS BIGINT) AS us_total FROM ({_PACKED}) GROUP BY 1)")
add("memory_sums", lambda v: metrics.memory_sums(v.table("part").select(F.col("p_brand").alias("kind"), F.col("p_size").cast("long").alias("mb"))), "SELECT coalesce(p_brand, 'all') AS kind, CAST(sum(p_size) AS BIGINT) AS mb FROM part GROUP BY ROLLUP (p_brand)")
add("slot_metrics", lambda v: metrics.slot_metrics(v.log, placement.slot(F.col("key")), NOW_MS), f"WITH l AS (SELECT *, CAST({_SLOT} AS BIGINT) AS slot, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM {{log}}), k AS (SELECT slot, max(seq) AS last_seq, count(*) AS changes, count(*) FILTER (WHERE r = 1) AS keys, count(*) FILTER (WHERE r = 1 AND {_ALIVE}) AS live, count(*) FILTER (WHERE op = 'del') AS tombstones FROM l GROUP BY 1) SELECT slot, unnest(['last_seq', 'changes', 'keys', 'live', 'tombstones', 'live_ratio']) AS name, unnest([CAST(last_seq AS DOUBLE), changes, keys, live, tombstones, round(live / changes, 6)]) AS value FROM k")
_SAMPLES = "SELECT event_type AS prefix, event_id AS seq, strlen(props) AS bytes FROM events"
add("compress_sample_groups", lambda v: metrics.sample_groups(v.table("events").select(F.col("event_type").alias("prefix"), F.col("event_id").alias("seq"), F.octet_length("props").cast("long").alias("bytes")), 10, 4096), f"SELECT prefix, count(*) AS taken, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT *, count(*) OVER (PARTITION BY prefix) AS n, sum(bytes) OVER (PARTITION BY prefix ORDER BY seq) AS r FROM ({_SAMPLES})) WHERE n > 10 AND r - bytes < 4096 GROUP BY 1")
add("metrics_text", lambda v: metrics.exposition(v.log.groupBy("op").agg((F.count("*") / 4).alias("value")).select(F.lit("changes").alias("name"), F.create_map(F.lit("op"), F.col("op"), F.lit("db"), F.lit('a"b')).alias("labels"), "value")), """SELECT 'changes' AS name, 0 AS at, '# TYPE changes gauge' AS line UNION ALL SELECT 'changes', 1, 'changes[db="a' || chr(92) || '"b",op="' || op || '"] ' || CAST(count(*) / 4 AS VARCHAR) FROM {log} GROUP BY op""")
_sql["metrics_text"] = _sql["metrics_text"].replace("changes[", "changes{").replace('"] \'', '"} \'')
_MARK = f"WITH m AS (SELECT l.*, seq // 500 AS segment, seq = max(seq) OVER (PARTITION BY key) AND {_ALIVE} AS alive FROM {{log}} l)"
add("segment_liveness", lambda v: compaction.liveness(v.log, 500, NOW_MS), f"{_MARK} SELECT segment, count(*) FILTER (WHERE alive) AS valid, count(*) FILTER (WHERE NOT alive) AS invalid FROM m GROUP BY 1")
add("compaction_live_rows", lambda v: compaction.compacted(v.log, 500, NOW_MS), f"{_MARK} SELECT segment, seq, key FROM m WHERE alive")
add("segment_runs", lambda v: compaction.runs(compaction.liveness(v.log, 20, NOW_MS).select("segment", (F.col("valid") > 0).alias("used")), "used"), f"{_MARK.replace('500', '20')}, s AS (SELECT segment, bool_or(alive) AS used FROM m GROUP BY 1), i AS (SELECT *, segment - row_number() OVER (PARTITION BY used ORDER BY segment) AS g FROM s) SELECT used, min(segment) AS first, max(segment) AS last, count(*) AS n FROM i GROUP BY used, g")
add("segment_contiguous", lambda v: compaction.contiguous(v.log.where("op <> 'del'").select((F.col("seq") % 97).alias("batch"), F.floor(F.col("seq") / 97).cast("long").alias("segment"))), "SELECT seq % 97 AS batch, min(seq // 97) AS first, max(seq // 97) AS last, count(*) AS n, max(seq // 97) - min(seq // 97) + 1 = count(*) AS ok FROM {log} WHERE op <> 'del' GROUP BY 1")
_BLOCK = "SELECT seq // 100 AS grp, seq AS block, seq * 37 % 900 + 100 AS bytes, row_number() OVER (PARTITION BY seq // 100 ORDER BY seq) AS r FROM {log}"
_PACK = f"WITH RECURSIVE b AS ({_BLOCK}), f AS (SELECT grp, block, bytes, r, CAST(grp * 100 AS BIGINT) AS packed, CAST(1 AS BIGINT) AS k, bytes AS held FROM b WHERE r = 1 UNION ALL SELECT b.grp, b.block, b.bytes, b.r, CASE WHEN f.k = 4 OR f.held + b.bytes > 2020 THEN f.packed + 1 ELSE f.packed END, CASE WHEN f.k = 4 OR f.held + b.bytes > 2020 THEN 1 ELSE f.k + 1 END, CASE WHEN f.k = 4 OR f.held + b.bytes > 2020 THEN b.bytes ELSE f.held + b.bytes END FROM f JOIN b ON b.grp = f.grp AND b.r = f.r + 1) SELECT grp AS \"group\", block, bytes, packed, row_number() OVER (PARTITION BY grp, packed ORDER BY block) - 1 AS sub_block FROM f"
add("segment_packing", lambda v: compaction.packed(v.log.select(F.floor(F.col("seq") / 100).cast("long").alias("group"), (F.floor(F.col("seq") / 100) * 100).cast("long").alias("segment"), F.col("seq").alias("block"), (F.col("seq") * 37 % 900 + 100).alias("bytes")), 2048), _PACK)
_MERGED = "SELECT event_type AS slot, event_id // 40 AS segment, user_id % 4 AS wal_group, CAST(event_id AS VARCHAR) AS key FROM events"
add("fifo_merged", lambda v: compaction.oldest_merged(v.table("events").select(F.col("event_type").alias("slot"), F.floor(F.col("event_id") / 40).cast("long").alias("segment"), (F.col("user_id") % 4).alias("wal_group"), F.col("event_id").cast("string").alias("key")), 8, 20, 300), f"WITH m AS ({_MERGED}), w AS (SELECT slot, segment, count(*) AS n, row_number() OVER (PARTITION BY slot ORDER BY segment) AS place FROM m GROUP BY 1, 2), s AS (SELECT slot FROM w GROUP BY 1 HAVING sum(n) >= 300 OR count(*) >= 20) SELECT slot, segment, wal_group, key FROM m WHERE slot IN (SELECT slot FROM s) AND (slot, segment) IN (SELECT slot, segment FROM w WHERE place <= 8)")


def flags(v: Keyspace) -> DataFrame:
    """A flag for each segment of the log, in turn."""
    names = F.array(*[F.lit(n) for n in compaction.FLAGS])
    return compaction.liveness(v.log, 20, NOW_MS).select("segment", F.element_at(names, (F.col("segment") % 7 + 1).cast("int")).alias("flag"), (F.col("segment") * 20).alias("seq"), (F.col("segment") % 128).alias("wal_group"))


_NAMES = "[" + ", ".join(f"'{n}'" for n in compaction.FLAGS) + "]"
_FLAGS = f"SELECT DISTINCT seq // 20 AS segment, {_NAMES}[CAST(seq // 20 % 7 + 1 AS INTEGER)] AS flag, seq // 20 * 20 AS seq, seq // 20 % 128 AS wal_group FROM {{log}}"
add("segment_flags", lambda v: flags(v).groupBy("flag").agg(F.count("*").alias("n")).select("flag", compaction.flag_of(F.col("flag")).cast("long").alias("byte"), F.col("flag").isin(compaction.REUSABLE).alias("reusable"), "n"), f"SELECT flag, CAST(CASE flag WHEN 'init' THEN 100 WHEN 'new_write' THEN 0 WHEN 'reuse_new' THEN 10 WHEN 'merging' THEN 1 WHEN 'merged' THEN -1 WHEN 'merged_and_persisted' THEN -10 ELSE -100 END AS BIGINT) AS byte, flag IN ('init', 'reuse', 'merged_and_persisted') AS reusable, count(*) AS n FROM ({_FLAGS}) GROUP BY 1")
add("segment_flag_steps", lambda v: compaction.next_flags(flags(v), flags(v).select("segment", F.when(F.col("segment") % 2 == 0, "merging").otherwise("new_write").alias("to"))), f"SELECT segment, CASE WHEN segment % 2 = 0 AND flag IN ('new_write', 'reuse_new') THEN 'merging' WHEN segment % 2 = 1 AND flag IN ('init', 'reuse', 'merged_and_persisted') THEN 'new_write' ELSE flag END AS flag FROM ({_FLAGS})")
add("segment_flag_dump", lambda v: compaction.flag_dump(flags(v), 3, 40), f"SELECT segment, segment || ', ' || flag || ', ' || seq || ', ' || wal_group AS line FROM ({_FLAGS}) WHERE segment BETWEEN 3 AND 42")
_LOADED = "SELECT key, 'string' AS type, '' AS element, value FROM {str} UNION ALL SELECT key, 'list', CAST(pos AS VARCHAR), value FROM {list} UNION ALL SELECT key, 'hash', field, value FROM {hash} UNION ALL SELECT key, 'set', member, '' FROM {kset} UNION ALL SELECT key, 'zset', member, CAST(score AS VARCHAR) FROM {zset}"
add("scan_load", lambda v: decode.loaded(v.str, v.list, v.hash, v.set, v.zset), _LOADED)


def copied(v: Keyspace) -> DataFrame:
    """A copy that lost the names of some customers and has another nation for others."""
    at = F.substring("key", 10, 20).cast("long")
    return v.hash.where(~((at % 5 == 0) & (F.col("field") == "name"))).withColumn("value", F.when((at % 7 == 0) & (F.col("field") == "nation"), "x").otherwise(F.col("value")))


def elements(v: Keyspace, hashes: DataFrame) -> DataFrame:
    return decode.loaded(v.str, v.list, hashes, v.set, v.zset)


add("scan_compare", lambda v: decode.differences(elements(v, v.hash), elements(v, copied(v))), "SELECT key, 'hash' AS type, field AS element, value AS here, CASE WHEN field = 'nation' THEN 'x' END AS there FROM {hash} WHERE field = 'name' AND CAST(substr(key, 10) AS BIGINT) % 5 = 0 OR field = 'nation' AND CAST(substr(key, 10) AS BIGINT) % 7 = 0")
add("restore_route", lambda v: decode.routed(types(v).union(v.rows([("s", "stream")], "key string, type string")).select("type").distinct().select(F.concat(F.lit("k:"), "type").alias("key"), "type")), "SELECT 'k:' || type AS key, type, target FROM (VALUES ('string', 'kv_str'), ('list', 'kv_list'), ('set', 'kv_set'), ('zset', 'kv_zset'), ('hash', 'kv_hash'), ('stream', NULL)) t(type, target)")
add("repl_frames", lambda v: v.log.select("seq", decode.replicated(F.concat(F.lit(b"X-REPL"), F.unhex(F.lpad(F.hex("seq"), 16, "0")), F.unhex(F.lpad(F.hex(F.col("seq") % 8), 4, "0")), F.unhex(F.lit("0102")), F.unhex(F.lpad(F.hex(F.octet_length("value").cast("long") + F.when(F.col("seq") % 10 == 0, 5).otherwise(0)), 8, "0")), F.col("value").cast("binary"))).alias("f")).where("f is not null").select("seq", "f.replica", "f.slot", "f.kind", F.col("f.content").cast("string").alias("content")), "SELECT seq, seq AS replica, seq % 8 AS slot, CAST(258 AS BIGINT) AS kind, value AS content FROM {log} WHERE seq % 10 <> 0")
add("basic_auth", lambda v: v.table("customer").select("c_custkey", decode.password_ok(F.concat(F.lit("Basic "), F.base64(F.concat(F.lit("user:"), F.when(F.col("c_custkey") % 2 == 0, "pa:ss").otherwise(F.col("c_name"))).cast("binary"))), "pa:ss").alias("ok")), "SELECT c_custkey, c_custkey % 2 = 0 AS ok FROM customer")
add("config_json", lambda v: state.config_json(v.table("region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("string").alias("value"))), "SELECT '{{' || string_agg('\"' || r_name || '\":\"' || r_regionkey || '\"', ',' ORDER BY r_name) || '}}' AS config FROM region".replace("{{", "{").replace("}}", "}"))
add("readonly_guard", lambda v: state.writable(v.log, v.rows([(1,), (5,)], "slot long"), placement.slot(F.col("key"))).select("seq", "key", "slot"), f"SELECT seq, key, CAST({_SLOT} AS BIGINT) AS slot FROM {{log}} WHERE {_SLOT} NOT IN (1, 5)")
add("scan_flatten", lambda v: decode.flattened(v.list, v.hash), "SELECT key || '_' || pos AS key, value FROM {list} UNION ALL SELECT key || '_' || field, value FROM {hash}")
add("http_argv", lambda v: v.table("pages").select("page_id", F.posexplode(decode.http_argv(F.col("url"))).alias("idx", "arg")).select("page_id", F.col("idx").cast("long").alias("idx"), "arg"), r"WITH q AS (SELECT page_id, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages), s AS (SELECT page_id, string_split(q, '&') AS a FROM q WHERE q <> '') SELECT page_id, unnest(range(len(a))) AS idx, unnest(a) AS arg FROM s")
add("http_body_argv", lambda v: v.str.select("key", F.posexplode(decode.body_argv(F.concat(F.lit("set "), "key", F.lit(" v")))).alias("idx", "arg")).select("key", F.col("idx").cast("long").alias("idx"), "arg"), "SELECT key, unnest([0, 1, 2]) AS idx, unnest(['set', key, 'v']) AS arg FROM {str}")
REQUESTS = [
    (1, ["GET", "a"], [0]), (2, ["mset", "a", "1", "b", "2"], [0, 2]), (3, ["ZINTER", "2", "x", "y", "WEIGHTS", "1", "2"], [1, 2]), (4, ["smove", "s", "d", "m"], [0, 1]), (5, ["DEL", "p", "q", "p"], [0, 1, 2]), (6, ["PING"], []),
    (7, ["SINTERCARD", "2", "x", "y", "LIMIT", "1"], [1, 2]), (8, ["ZUNIONSTORE", "d", "2", "x", "y", "AGGREGATE", "MAX"], [0, 2, 3]), (9, ["zrangestore", "d", "s", "0", "1"], [0, 1]), (10, ["AUTH", "pw"], []), (11, ["SELECT", "1"], []), (12, ["client", "id"], []),
    (13, ["SUBSCRIBE", "c"], []), (14, ["zdiffstore", "d", "1", "x"], [0, 2]), (15, ["MANAGE", "slot", "3", "view-metrics"], []), (16, ["x_repl", "slot", "5", "get"], []), (17, ["SDIFFSTORE", "d", "a", "b"], [0, 1, 2]), (18, ["ZINTERCARD", "x", "y"], []),
]
_KEYS = ", ".join(f"({i}, {k}, '{argv[k + 1]}')" for i, argv, at in REQUESTS for k in at)
add("request_keys", lambda v: decode.keys_of(v.rows([r[:2] for r in REQUESTS], "id long, argv array<string>")), f"SELECT * FROM (VALUES {_KEYS}) t(id, idx, key)")
add("request_slots", lambda v: decode.slot_asked(v.rows([r[:2] for r in REQUESTS], "id long, argv array<string>")), "SELECT * FROM (VALUES (15, 3), (16, 5)) t(id, slot)")


def frames(v: Keyspace) -> DataFrame:
    """Three pipelined requests a key, one with line ends in an argument and one of characters of two bytes; every tenth is cut short."""
    size = lambda c: F.octet_length(c).cast("string")
    value = F.concat("key", F.lit("\r\n$3é"))
    whole = F.concat(F.lit("*2\r\n$3\r\nget\r\n$"), size(F.col("key")), F.lit("\r\n"), "key", F.lit("\r\n*1\r\n$4\r\nping\r\n*2\r\n$4\r\necho\r\n$"), size(value), F.lit("\r\n"), value, F.lit("\r\n"))
    cut = F.substring(F.col("key"), 7, 20).cast("long") % 10 == 0
    return v.str.select("key", F.when(cut, F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole).alias("frame"))


add("framed_argv", lambda v: decode.framed_argv(frames(v)).select("key", F.posexplode("requests").alias("k", "argv")).select("key", F.col("k").cast("long").alias("k"), F.array_join("argv", "|").alias("argv")), "SELECT key, unnest([0, 1]) AS k, unnest(['get|' || key, 'ping']) AS argv FROM {str} UNION ALL SELECT key, 2, 'echo|' || key || chr(13) || chr(10) || '$3é' FROM {str} WHERE CAST(substr(key, 7) AS BIGINT) % 10 <> 0")

# Streams -------------------------------------------------------------------------------------------------------------


class _Streamed(Keyspace):
    """The same views over the events as a stream."""

    def table(self, name: str) -> DataFrame:
        return changes.read_table(self.spark, self.sf_dir, name)


def streamed(v: Keyspace) -> _Streamed:
    return _Streamed(v.spark, v.sf_dir)


add("replay_stream", lambda v: changes.replayed(streamed(v).log), _sql["lww_state"])
add("ttl_evict_stream", lambda v: changes.replayed(streamed(v).log, NOW_MS), _sql["visible_keys"])
SUBSCRIBERS = [("click", "a"), ("click", "b"), ("view", "a"), ("nothing", "c")]
add("pubsub_fanout", lambda v: changes.run_once(changes.fan_out(streamed(v).table("events").select(F.col("event_type").alias("channel"), F.col("event_id").alias("id"), F.col("props").alias("payload")), v.rows(SUBSCRIBERS, "channel string, subscriber string"))), "SELECT s.subscriber, event_type AS channel, event_id AS id, props AS payload, s.receivers FROM events JOIN (SELECT *, count(*) OVER (PARTITION BY channel) AS receivers FROM (VALUES " + ", ".join(map(str, SUBSCRIBERS)) + ") s(channel, subscriber)) s ON s.channel = event_type")


def sessions(v: Keyspace) -> DataFrame:
    """Who subscribes and who leaves: signups and clicks join one of five channels, errors leave it."""
    op = F.when(F.col("event_type") == "error", "unsubscribe").when(F.col("event_type").isin("signup", "click"), "subscribe")
    return v.table("events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("session"), F.concat(F.lit("c"), F.col("event_id") % 5).alias("channel"), op.alias("op")).where("op is not null")


_SESSIONS = "e AS (SELECT event_id AS seq, user_id AS session, 'c' || event_id % 5 AS channel, CASE WHEN event_type = 'error' THEN 'unsubscribe' WHEN event_type IN ('signup', 'click') THEN 'subscribe' END AS op FROM events), m AS (SELECT *, CASE WHEN op = 'subscribe' THEN 1 ELSE 0 END - coalesce(lag(CASE WHEN op = 'subscribe' THEN 1 ELSE 0 END) OVER (PARTITION BY channel, session ORDER BY seq), 0) AS move FROM e WHERE op IS NOT NULL), t AS (SELECT seq, session, channel, op, CAST(sum(move) OVER (PARTITION BY channel ORDER BY seq) AS BIGINT) AS n FROM m)"
add("subscribe_counts", lambda v: changes.subscriptions(sessions(v)), f"WITH {_SESSIONS} SELECT seq, session, channel, op, n FROM t")
add("publish_receivers", lambda v: changes.receivers(v.table("events").where("event_type = 'view'").select(F.col("event_id").alias("seq"), F.concat(F.lit("c"), F.col("event_id") % 5).alias("channel")), sessions(v)), f"WITH {_SESSIONS} SELECT p.seq, p.channel, coalesce((SELECT max_by(t.n, t.seq) FROM t WHERE t.channel = p.channel AND t.seq < p.seq), 0) AS n FROM (SELECT event_id AS seq, 'c' || event_id % 5 AS channel FROM events WHERE event_type = 'view') p")
add("snapshot_bootstrap", lambda v: changes.bootstrap(state.latest(v.log.where("seq < 4000")), v.log.where("seq >= 3500")), _LAST + " SELECT key, seq, op, value, expire_at FROM l")
add("replica_lag", lambda v: changes.lag(v.log.select(placement.slot(F.col("key")).alias("slot"), "seq"), v.log.where("seq % 100 < 90").groupBy(placement.slot(F.col("key")).alias("slot")).agg(F.max("seq").alias("applied")).where("slot <> 2"), 8), f"WITH s AS (SELECT CAST({_SLOT} AS BIGINT) AS slot, seq FROM {{log}}), a AS (SELECT slot, max(seq) AS last, coalesce(max(seq) FILTER (WHERE seq % 100 < 90 AND slot <> 2), -1) AS applied FROM s GROUP BY 1) SELECT slot, last - applied AS lag, last - applied < 8 AS can_read FROM a")
_KINDS = "['wal_v', 'dict', 'one_wal_group_persist', 'dyn_config', 'big_strings', 'chunk_segment_flag_update', 'unknown']"
add("binlog_dispatch", lambda v: changes.dispatched(v.log.select("seq", F.when(F.col("seq") % 3001 == 3000, "flush").otherwise(F.element_at(F.array(*[F.lit(x) for x in _KINDS[2:-2].split("', '")]), (F.col("seq") % 7 + 1).cast("int"))).alias("kind"))), f"WITH k AS (SELECT seq, CASE WHEN seq % 3001 = 3000 THEN 'flush' ELSE {_KINDS}[CAST(seq % 7 + 1 AS INTEGER)] END AS kind FROM {{log}}) SELECT seq, kind, CASE kind WHEN 'wal_v' THEN 'put' WHEN 'one_wal_group_persist' THEN 'put' WHEN 'chunk_segment_flag_update' THEN 'flag' WHEN 'big_strings' THEN 'file' WHEN 'dict' THEN 'dictionary' WHEN 'dyn_config' THEN 'setting' WHEN 'flush' THEN 'flush' END AS target FROM k WHERE kind IN ('dict', 'dyn_config') OR seq >= coalesce((SELECT max(seq) FROM k WHERE kind = 'flush'), -1)")
