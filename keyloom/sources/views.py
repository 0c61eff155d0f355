"""A keyspace as long tables, one row an element, viewed from the star-schema tables.

kv_str (key, value, expire_at), kv_hash (key, field, value), kv_list (key, pos, value), kv_set (key, member),
kv_zset (key, member, score) and kv_log (seq, key, op, value, delta, expire_at). Keys are strings; expire_at is in epoch
milliseconds, 0 for never.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A fixed "now", 2024-01-15: no query reads the clock.
NOW_MS = 1_705_276_800_000

#: Fixed limits of keys, values and collections.
LIMITS = {"key": 256, "value": 32767, "list": 1024, "hash": 4096, "set": 4096, "zset": 4096, "member": 255}


class Keyspace:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def big_strings(self, path: str) -> DataFrame:
        """Big strings, a file each, as (key, value binary): the key is the file's name; the listing prunes by it, and a scan of keys alone reads no file."""
        return self.spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("key"), F.col("content").alias("value"))

    def rows(self, values: list[tuple], schema: str) -> DataFrame:
        """A small literal table, such as a batch of requests."""
        return self.spark.createDataFrame(values, schema)

    @cached_property
    def zset(self) -> DataFrame:
        return self.table("customer").select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("member"), F.col("c_acctbal").alias("score"))

    @cached_property
    def spend(self) -> DataFrame:
        """Sorted sets with common members: what each customer spent, by order status."""
        spent = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
        return self.table("orders").groupBy(F.col("o_orderstatus").alias("key"), F.col("o_custkey").cast("string").alias("member")).agg(spent.alias("score"))

    @cached_property
    def set(self) -> DataFrame:
        return self.table("events").select(F.concat_ws(":", "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("key"), F.col("user_id").cast("string").alias("member")).distinct()

    @cached_property
    def hash(self) -> DataFrame:
        fields = {"name": "c_name", "segment": "c_mktsegment", "acctbal": "c_acctbal", "nation": "c_nationkey"}
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (F.format_string("%.2f", c) if f == "acctbal" else F.col(c).cast("string")).alias("value")) for f, c in fields.items()]))
        return self.table("customer").select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("key"), pairs.alias("p")).select("key", "p.field", "p.value")

    @cached_property
    def list(self) -> DataFrame:
        pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
        return self.table("events").select(F.col("user_id").cast("string").alias("key"), pos.cast("long").alias("pos"), F.col("event_type").alias("value"))

    @cached_property
    def str(self) -> DataFrame:
        """Half the keys expire, around NOW_MS."""
        expire = F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(NOW_MS + (F.col("o_orderkey") % 101 - 50) * 60_000)
        return self.table("orders").select(F.concat(F.lit("order:"), F.col("o_orderkey")).alias("key"), F.col("o_orderpriority").alias("value"), expire.cast("long").alias("expire_at"))

    @cached_property
    def log(self) -> DataFrame:
        """A change log: signup sets, view adds, click appends, error deletes, purchase sets the expiry."""
        kind = F.col("event_type")
        op = F.when(kind == "signup", "set").when(kind == "view", "incr").when(kind == "click", "append").when(kind == "error", "del").otherwise("expire")
        ms = F.unix_millis(F.col("ts").cast("timestamp"))
        return self.table("events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key"), op.alias("op"), F.concat(F.lit("v"), F.col("event_id")).alias("value"), (F.col("event_id") % 7 + 1).alias("delta"), F.when(op == "expire", ms + (F.col("event_id") % 20) * 86_400_000).otherwise(0).cast("long").alias("expire_at"))


#: The same views for the SQL side.
SQL_VIEWS = {
    "zset": "SELECT c_mktsegment AS key, c_name AS member, c_acctbal AS score FROM customer",
    "spend": "SELECT o_orderstatus AS key, CAST(o_custkey AS VARCHAR) AS member, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS score FROM orders GROUP BY 1, 2",
    "kset": "SELECT DISTINCT event_type || ':' || strftime(ts, '%Y-%m-%d') AS key, CAST(user_id AS VARCHAR) AS member FROM events",
    "hash": "SELECT 'customer:' || c_custkey AS key, unnest(['name', 'segment', 'acctbal', 'nation']) AS field, unnest([c_name, c_mktsegment, printf('%.2f', c_acctbal), CAST(c_nationkey AS VARCHAR)]) AS value FROM customer",
    "list": "SELECT CAST(user_id AS VARCHAR) AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS value FROM events",
    "str": f"SELECT 'order:' || o_orderkey AS key, o_orderpriority AS value, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE {NOW_MS} + (o_orderkey % 101 - 50) * 60000 END AS expire_at FROM orders",
    "live": f"SELECT * FROM (SELECT 'order:' || o_orderkey AS key, o_orderpriority AS value, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE {NOW_MS} + (o_orderkey % 101 - 50) * 60000 END AS expire_at FROM orders) WHERE expire_at = 0 OR expire_at >= {NOW_MS}",
    "log": """SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS key, CASE event_type WHEN 'signup' THEN 'set' WHEN 'view' THEN 'incr' WHEN 'click' THEN 'append' WHEN 'error' THEN 'del' ELSE 'expire' END AS op,
        'v' || event_id AS value, event_id % 7 + 1 AS delta, CASE WHEN event_type IN ('signup', 'view', 'click', 'error') THEN 0 ELSE epoch_us(ts) // 1000 + (event_id % 20) * 86400000 END AS expire_at FROM events""",
}
