"""Log-structured index of hashed keys: sorted runs in levels, with filters, merged as they gather."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import Bloom, Workspace, build_bloom


class RunIndex:
    """Runs are bucketed tables in the shared folder, sorted by ``key`` within each bucket, so that runs and batches
    written alike meet bucket by bucket, without a shuffle. Level 0 takes what each batch flushes; once a level holds
    more than ``fanout`` runs they are compacted into one run of the next. ``merge`` names how the values of one key
    become one: associative, commutative aggregates.
    """

    def __init__(self, work: Workspace, key: str, merge: dict[str, Column], fanout: int = 4) -> None:
        self.work, self.key, self.merge, self.fanout = work, key, merge, fanout
        self.buckets = int(work.spark.conf.get("spark.sql.shuffle.partitions"))
        self.mark, self.tables = uuid.uuid4().hex[:12], 0
        self.levels: list[list[tuple[str, DataFrame]]] = [[]]
        self.filter: Bloom | None = None

    def bucketed(self, rows: DataFrame) -> tuple[str, DataFrame]:
        """``rows`` as a table of the index's buckets, and its name; those that come dealt by the key are not dealt again."""
        spark, name = self.work.spark, f"keyloom_{self.mark}_{self.tables}"
        self.tables += 1
        rows.write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", self.work.path(name)).mode("overwrite").saveAsTable(name)
        atexit.register(_forget, spark, name)
        return name, spark.table(name)

    def drop(self, name: str) -> None:
        _forget(self.work.spark, name)
        self.work.drop(name)

    def merged(self, rows: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, rows).groupBy(self.key).agg(*[how.alias(name) for name, how in self.merge.items()])

    def flush(self, run: tuple[str, DataFrame]) -> None:
        """Adds a run made by ``bucketed``, each key once in it, at level 0, and compacts levels that are full."""
        self.levels[0].append(run)
        level = 0
        while len(self.levels[level]) > self.fanout:
            full, self.levels[level] = self.levels[level], []
            if len(self.levels) == level + 1:
                self.levels.append([])
            self.levels[level + 1].append(self.bucketed(self.merged([rows for _, rows in full])))
            for name, _ in full:
                self.drop(name)
            level += 1

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for _, run in level]

    def new(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch`` whose keys no run holds: a merge anti-join against each run in turn."""
        for run in self.runs():
            batch = batch.join(run.select(self.key), self.key, "left_anti")
        return batch

    def note(self, hashes: DataFrame, expected: int) -> None:
        """Adds 64-bit hashes of a run's keys to the index's filter, whose size is that for ``expected`` keys in all."""
        own = build_bloom(hashes, expected)
        self.filter = own if self.filter is None else Bloom(self.filter.words | own.words)

    def old(self, batch: DataFrame, hash_of: Column) -> DataFrame:
        """Keys of ``batch`` that some run holds: those that pass the filter, and only they, are looked up in the runs."""
        if self.filter is None:
            return batch.select(self.key).limit(0)
        noted = self.filter

        def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = np.flatnonzero(noted.has(b.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at))], ["found"])

        kind = batch.schema[self.key].dataType.simpleString()
        maybe = self.work.table(batch.select(self.key, hash_of.alias("h")).mapInArrow(passing, f"found {kind}"), f"maybe-{self.tables}")
        return reduce(DataFrame.union, [run.join(maybe, F.col(self.key) == F.col("found"), "left_semi").select(self.key) for run in self.runs()])


def _forget(spark, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # noqa: BLE001  the session may have ended, and with it its catalogue
        pass
