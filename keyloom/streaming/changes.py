"""Streams: append and replay of a change log, expiry, and messages to subscribers.

What a stream makes goes to Parquet, and its checkpoint beside it; nothing is gathered on the driver.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.plans.state import latest


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream of the same schema."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def folder(spark: SparkSession) -> str:
    """A folder of its own below ``spark.checkpoint.dir``; local mode has a temporary one where that is unset."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='keyloom-stream-')}"
    path = f"{top.rstrip('/')}/stream-{uuid.uuid4().hex[:12]}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended
        pass


def _ended(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def run_once(stream: DataFrame) -> DataFrame:
    """All rows that there are of a stream without aggregates, by the available-now trigger, appended to Parquet."""
    top = folder(stream.sparkSession)
    _ended(stream.writeStream.format("parquet").option("path", f"{top}/rows").option("checkpointLocation", f"{top}/checkpoint").outputMode("append").trigger(availableNow=True).start())
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{top}/rows")


#: Parts of the state by key; a micro-batch rewrites those that it has changes for.
PARTS = 16


def replay_into(changes: DataFrame, path: str, checkpoint: str, now_ms: int | None = None, parts: int = PARTS):
    """Catch-up of a replica: each micro-batch is merged into the Parquet state at ``path``, last write wins.

    The state lies in parts by the key's hash; a batch rewrites the parts it has changes for, each into a version of its
    own, and names the versions in a list written last, so that a batch repeated after a failure starts from the list
    before it and ends alike. Versions that the last two lists do not name are deleted. With ``now_ms`` what has expired
    by then, and tombstones, go when their part is rewritten, so that the state does not grow with keys that are gone.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fields = batch.select("seq", "key", "op", "value", "expire_at")
        before = versions(spark, path, batch_id - 1)
        own = fields.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
        touched = sorted(r[0] for r in own.select("part").distinct().collect())  # at most ``parts``
        if touched:
            old = [spark.read.schema(fields.schema).parquet(f"{path}/{before[p]}").withColumn("part", F.lit(p)) for p in touched if p in before]
            both = own
            for rows in old:
                both = both.unionByName(rows)
            last = both.groupBy("part", "key").agg(F.max_by(F.struct("seq", "op", "value", "expire_at"), "seq").alias("s")).select("part", "s.seq", "key", "s.op", "s.value", "s.expire_at")
            if now_ms is not None:
                last = last.where((F.col("op") != "del") & ((F.col("expire_at") == 0) | (F.col("expire_at") >= now_ms)))
            last.write.mode("overwrite").partitionBy("part").parquet(f"{path}/v{batch_id}")
        named = before | {p: f"v{batch_id}/part={p}" for p in touched if _exists(spark, f"{path}/v{batch_id}/part={p}")}
        named = {p: v for p, v in named.items() if p not in touched or v.startswith(f"v{batch_id}/")}
        spark.createDataFrame([(p, v) for p, v in sorted(named.items())], "part int, version string").coalesce(1).write.mode("overwrite").parquet(f"{path}/list{batch_id}")
        kept = {v.split("/")[0] for v in [*named.values(), *before.values()]}
        for old_id in range(max(0, batch_id - 2 * parts), batch_id - 1):
            if f"v{old_id}" not in kept:
                _delete(spark, f"{path}/v{old_id}")
            _delete(spark, f"{path}/list{old_id}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def versions(spark: SparkSession, path: str, batch_id: int) -> dict[int, str]:
    """The folder of each part of the state after a batch; none before the first."""
    return dict(spark.read.parquet(f"{path}/list{batch_id}").collect()) if batch_id >= 0 and _exists(spark, f"{path}/list{batch_id}") else {}


def replayed(changes: DataFrame, now_ms: int | None = None) -> DataFrame:
    """The state after all there is of a stream of changes, (seq, key, op, value, expire_at)."""
    spark, top = changes.sparkSession, folder(changes.sparkSession)
    last: list[int] = []
    query = replay_into(changes, f"{top}/state", f"{top}/checkpoint", now_ms)
    _ended(query)
    last = [p["batchId"] for p in query.recentProgress]
    named = versions(spark, f"{top}/state", max(last, default=-1))
    schema = changes.select("seq", "key", "op", "value", "expire_at").schema
    if not named:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{top}/state/{v}" for v in named.values()]).select("key", "seq", "op", "value", "expire_at")


def append(changes: DataFrame, path: str, per_file: int = 100_000) -> None:
    """Binlog append: changes in order of seq, in files of at most so many, never rewritten."""
    changes.sortWithinPartitions("seq").write.mode("append").option("maxRecordsPerFile", per_file).parquet(path)


def bootstrap(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """A replica's state from a snapshot and the changes after it: those of each key later than what the snapshot has of it."""
    return latest(snapshot.select("seq", "key", "op", "value", "expire_at").union(log.select("seq", "key", "op", "value", "expire_at")))


def lag(log: DataFrame, applied: DataFrame, most: int) -> DataFrame:
    """(slot, lag, can_read) of a log (slot, seq) and how far each slot is applied, (slot, applied): readable once fewer than ``most`` are left."""
    ends = log.groupBy("slot").agg(F.max("seq").alias("last"))
    left = F.col("last") - F.coalesce("applied", F.lit(-1))
    return ends.join(applied, "slot", "left").select("slot", left.alias("lag"), (left < most).alias("can_read"))


#: The kinds of replicated content, and what applying one means.
CONTENTS = {"wal_v": "put", "one_wal_group_persist": "put", "chunk_segment_flag_update": "flag", "big_strings": "file", "dict": "dictionary", "dyn_config": "setting", "flush": "flush"}


def dispatched(contents: DataFrame) -> DataFrame:
    """(seq, kind, target) of replicated contents (seq, kind); what comes before the last flush, other than settings and dictionaries, is void."""
    target = F.try_element_at(F.create_map(*[F.lit(x) for pair in CONTENTS.items() for x in pair]), F.col("kind"))
    last = contents.agg(F.max(F.when(F.col("kind") == "flush", F.col("seq"))).alias("flushed"))
    held = contents.join(F.broadcast(last), F.col("flushed").isNull() | (F.col("seq") >= F.col("flushed")) | F.col("kind").isin("dict", "dyn_config"))
    return held.select("seq", "kind", target.alias("target"))


def fan_out(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """PUBLISH: a stream of (channel, id, payload) joined with the static subscribers of its channel, with how many receive it."""
    counted = subscriptions.withColumn("receivers", F.count("*").over(Window.partitionBy("channel")))
    return messages.join(counted, "channel").select("subscriber", "channel", "id", "payload", "receivers")


def subscriptions(log: DataFrame) -> DataFrame:
    """(seq, session, channel, op, n) of SUBSCRIBE and UNSUBSCRIBE: the reply's number, the channel's subscribers after it.

    A session counts once in a channel however often it subscribes, so a change counts if the one before of its session
    and channel, or none, says otherwise.
    """
    on = F.when(F.col("op") == "subscribe", 1).otherwise(0)
    own = Window.partitionBy("channel", "session").orderBy("seq")
    moved = log.withColumn("move", on - F.coalesce(F.lag(on).over(own), F.lit(0)))
    return moved.withColumn("n", F.sum("move").over(Window.partitionBy("channel").orderBy("seq"))).select("seq", "session", "channel", "op", "n")


def receivers(messages: DataFrame, log: DataFrame) -> DataFrame:
    """(seq, channel, n) of PUBLISH: who is subscribed to the channel when the message comes, by one order of both."""
    both = subscriptions(log).select("seq", "channel", "n").unionByName(messages.select("seq", "channel", F.lit(None).cast("long").alias("n")))
    by = Window.partitionBy("channel").orderBy("seq", F.col("n").isNull())
    told = both.withColumn("before", F.last("n", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return told.where("n is null").select("seq", "channel", F.coalesce("before", F.lit(0)).alias("n"))
