"""Requests from text: HTTP query strings and bodies, framed commands, and the keys each command names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the keys stand in the arguments of a command (from 1); others take argument 1.
ALL_KEYS = ["del", "exists", "mget", "sdiff", "sinter", "sunion", "sdiffstore", "sinterstore", "sunionstore"]
ODD_KEYS = ["mset"]
TWO_KEYS = ["smove", "copy", "rename", "rpoplpush", "lmove", "zrangestore"]
COUNTED_KEYS = ["zdiff", "zinter", "zintercard", "zunion", "sintercard"]
STORED_KEYS = ["zdiffstore", "zinterstore", "zunionstore"]
NO_KEYS = ["ping", "echo", "dbsize", "flushdb", "flushall", "config", "info", "publish", "subscribe", "unsubscribe", "auth", "select", "client", "quit", "save", "bgsave", "manage", "x_repl"]


def http_argv(url: Column) -> Column:
    """GET ``?cmd&arg&arg``: the arguments, empty without a query."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.when(query != "", F.split(query, "&")).otherwise(F.array().cast("array<string>"))


def body_argv(body: Column) -> Column:
    """POST and PUT: the arguments of a body, between single spaces."""
    return F.split(body, " ")


def parse_frames(raw: bytes) -> tuple[list[list[str]], int]:
    """The whole requests of ``*n`` frames of ``$len`` arguments, one after the other, and the bytes they take; the rest waits for more.

    Arguments are as long as they say, whatever line ends they hold. Anything but a frame is an error.
    """
    out, at = [], 0
    while at < len(raw):
        if raw[at : at + 1] not in (b"*", b"+"):
            raise ValueError(f"unexpected byte {raw[at]} at {at}")
        end = raw.find(b"\r\n", at)
        if end < 0:
            break
        argv, here = [], end + 2
        for _ in range(int(raw[at + 1 : end])):
            end = raw.find(b"\r\n", here)
            if end < 0:
                break
            if raw[here : here + 1] != b"$":
                raise ValueError(f"unexpected byte {raw[here]} at {here}")
            n = int(raw[here + 1 : end])
            if len(raw) < end + 2 + n + 2:
                break
            argv.append(raw[end + 2 : end + 2 + n].decode("utf-8", "replace"))
            here = end + 2 + n + 2
        else:
            out.append(argv)
            at = here
            continue
        break
    return out, at


def framed_argv(rows: DataFrame, frame: str = "frame") -> DataFrame:
    """Every row with ``requests``, an array of the argument lists that its frames hold, and ``used``, the bytes they take.

    Lengths can only be followed from one to the next, so this is done in Arrow batches.
    """
    others = [c for c in rows.columns if c != frame]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parse_frames(x or b"") for x in b.column(frame).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array([f[0] for f in found], pa.list_(pa.list_(pa.string()))), pa.array([f[1] for f in found], pa.int64())], [*others, "requests", "used"])

    told = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in others)
    return rows.withColumn(frame, F.col(frame).cast("binary")).mapInArrow(run, told + "requests array<array<string>>, used long")


def replicated(frame: Column) -> Column:
    """Of one frame of replication: struct of replica, slot, kind and content; null for anything else, and where it is cut short.

    Fixed values: the keyword X-REPL, 8 bytes of replica, 2 of slot, 2 of kind, 4 of length, big-endian, then the content.
    """
    number = lambda at, n: F.conv(F.hex(F.substring(frame, at, n)), 16, -10).cast("long")
    length = number(19, 4)
    whole = (F.substring(frame, 1, 6) == F.lit(b"X-REPL")) & (F.octet_length(frame) >= 22) & (F.octet_length(frame) >= 22 + length)
    return F.when(whole, F.struct(number(7, 8).alias("replica"), number(15, 2).alias("slot"), number(17, 2).alias("kind"), F.substring(frame, F.lit(23), length.cast("int")).alias("content")))


def keys_of(requests: DataFrame) -> DataFrame:
    """(id, idx, key) of (id, argv): which arguments are keys, by the command."""
    args = requests.select("id", F.lower(F.element_at("argv", 1)).alias("cmd"), F.expr("slice(argv, 2, size(argv))").alias("args"))
    number = lambda at: F.coalesce(F.try_element_at("args", F.lit(at)).try_cast("int"), F.lit(0))
    e = args.select("id", "cmd", number(1).alias("n"), number(2).alias("stored"), F.posexplode("args").alias("idx", "key"))
    is_key = (
        F.when(F.col("cmd").isin(ALL_KEYS), True).when(F.col("cmd").isin(ODD_KEYS), F.col("idx") % 2 == 0).when(F.col("cmd").isin(TWO_KEYS), F.col("idx") < 2)
        .when(F.col("cmd").isin(COUNTED_KEYS), (F.col("idx") >= 1) & (F.col("idx") <= F.col("n")))
        .when(F.col("cmd").isin(STORED_KEYS), (F.col("idx") == 0) | (F.col("idx") >= 2) & (F.col("idx") < 2 + F.col("stored")))
        .when(F.col("cmd").isin(NO_KEYS), False).otherwise(F.col("idx") == 0)
    )
    return e.where(is_key).select("id", F.col("idx").cast("long").alias("idx"), "key")


def slot_asked(requests: DataFrame) -> DataFrame:
    """(id, slot) of requests that name their slot: MANAGE and X_REPL ``slot n``."""
    held = requests.where(F.lower(F.element_at("argv", 1)).isin("manage", "x_repl") & (F.lower(F.try_element_at("argv", F.lit(2))) == "slot"))
    return held.select("id", F.try_element_at("argv", F.lit(3)).try_cast("long").alias("slot")).where("slot is not null")


def password_ok(header: Column, password: str) -> Column:
    """Basic authentication: whether what follows the first colon of the decoded header is the password."""
    told = F.decode(F.unbase64(F.substring(header, 7, 1 << 20)), "UTF-8")
    return F.coalesce(F.substring(told, F.locate(":", told) + 1, F.length(told)) == password, F.lit(False))


def routed(kinds: DataFrame) -> DataFrame:
    """RESTORE: which table takes a (key, type) payload; null for a type that none takes."""
    table = F.create_map(*[F.lit(x) for pair in (("string", "kv_str"), ("list", "kv_list"), ("set", "kv_set"), ("zset", "kv_zset"), ("hash", "kv_hash")) for x in pair])
    return kinds.select("key", "type", F.try_element_at(table, F.col("type")).alias("target"))


def loaded(strings: DataFrame, lists: DataFrame, hashes: DataFrame, sets: DataFrame, zsets: DataFrame) -> DataFrame:
    """Scan and load: elements of all types as (key, type, element, value), to be written in one pass or compared with a copy."""
    return (
        strings.select("key", F.lit("string").alias("type"), F.lit("").alias("element"), "value")
        .union(lists.select("key", F.lit("list"), F.col("pos").cast("string"), "value"))
        .union(hashes.select("key", F.lit("hash"), "field", "value"))
        .union(sets.select("key", F.lit("set"), "member", F.lit("")))
        .union(zsets.select("key", F.lit("zset"), "member", F.col("score").cast("string")))
    )


def differences(one: DataFrame, other: DataFrame) -> DataFrame:
    """Scan, load and compare: elements that only one side has or whose values differ."""
    a, b = (x.select("key", "type", "element", F.col("value").alias(n)) for x, n in ((one, "here"), (other, "there")))
    return a.join(b, ["key", "type", "element"], "full").where(~F.col("here").eqNullSafe(F.col("there")))


def flattened(lists: DataFrame, hashes: DataFrame) -> DataFrame:
    """Collections as one string key an element: ``key_pos`` and ``key_field``."""
    return lists.select(F.concat_ws("_", "key", F.col("pos").cast("string")).alias("key"), "value").union(hashes.select(F.concat_ws("_", "key", "field").alias("key"), "value"))
