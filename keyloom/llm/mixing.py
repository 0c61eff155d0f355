"""Mixing sources to target weights by entropy balancing, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import WORD, Workspace, pick

#: Equal sizes of one source are numbered in so many parts at least, and in more where a part would be larger than this.
PARTS, PART_ROWS = 64, 100_000

#: Rates are settled to this fraction of a copy, as whole numbers, so that sums do not depend on their order.
UNIT = 1_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def ranked(work: Workspace, sources: DataFrame) -> DataFrame:
    """``sources`` with their place ``k`` by code point, null last: dealt by ranges, numbered within each, and ranges added up."""
    order = F.col("source").asc_nulls_last()
    dealt = work.table(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "ranged")
    held = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = held.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a range
    place = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return dealt.join(before, F.col("part") == F.col("of")).select("source", "source_size", (F.col("before") + place).alias("k"))


def targets(work: Workspace, sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(source, source_size) with ``target``: the weighted shares, none above ``most`` times its source.

    What is above its limit stops there and the excess goes to the others by weight, round by round, until none is
    above: each round is one sum over the sources, and raises the factor that all weights have in common.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("k") - 1) % len(weights) + 1).cast("int"))
    held = work.table(ranked(work, sources).select("source", "source_size", w.alias("w"), (most * F.col("source_size")).alias("limit")), "weighed")
    total, all_w = held.agg(F.sum("source_size"), F.sum("w")).first()
    factor = share * (total or 0) / (all_w or 1.0)
    while True:
        over = factor * F.col("w") > F.col("limit")
        stopped, left = held.agg(F.coalesce(F.sum(F.when(over, F.col("limit"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0))).first()
        after = (share * (total or 0) - stopped) / left if left else math.inf
        if after <= factor:
            break
        factor = after
        if not left:
            break
    target = F.least(F.col("limit").cast("double"), factor * F.col("w")) if math.isfinite(factor) else F.col("limit").cast("double")
    return held.select("source", "source_size", target.alias("target"))


def rate(size: Column, tilt: Column, most: float) -> Column:
    return F.least(F.lit(float(most)), F.exp(tilt * size))


def balance(work: Workspace, cells: DataFrame, wanted: DataFrame, most: float, tolerance: float = 1e-9, most_rounds: int = 120) -> DataFrame:
    """(source, tilt): Newton's iterations on the dual of the entropy problem, for all sources at once.

    The rates r of the documents minimise the sum of r log r - r under sum of size * r = target for each source and
    r <= most. The dual, sum of exp(tilt * size) - tilt * target where r is below its limit, is convex, and its solution
    gives the exponentially tilted rates r = min(most, exp(tilt * size)). Gradient and curvature are sums over the cells,
    documents of equal source and size, counted; as exact decimals they are the same however the rows are dealt. The
    solution is kept between bounds: a step beyond them halves the interval instead.
    """
    s = F.col("size").cast("double")
    exact = lambda x: F.sum(x.cast("decimal(38,9)")).cast("double")
    start = cells.groupBy("source").agg(exact(F.col("n") * s).alias("all"), exact(F.col("n") * s * s).alias("square"))
    start = start.join(wanted.select(F.col("source").alias("of"), "target"), same(F.col("source"), F.col("of")))
    full = F.col("target") >= most * F.col("all")
    guess = F.log(F.col("target") / F.col("all")) * F.col("all") / F.col("square")
    state = work.table(start.select("source", "target", F.when(full, math.log(most)).otherwise(guess).alias("tilt"), F.lit(-100.0).alias("low"), F.lit(math.log(most)).alias("high"), full.alias("done")), "tilt-0")
    for k in range(1, most_rounds + 1):
        held = cells.join(state.withColumnRenamed("source", "of"), same(F.col("source"), F.col("of"))).withColumn("r", F.exp(F.col("tilt") * s))
        below = F.when(F.col("r") < most, F.col("n") * s * s * F.col("r")).otherwise(0.0)
        sums = held.groupBy("source", "target", "tilt", "low", "high", "done").agg(exact(F.col("n") * s * F.least(F.lit(float(most)), F.col("r"))).alias("words"), exact(below).alias("slope"))
        gap = F.col("words") - F.col("target")
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        moved = sums.withColumns({"low": low, "high": high, "gap": gap, "step": F.col("tilt") - gap / F.when(F.col("slope") > 0, F.col("slope"))})
        inside = F.coalesce((F.col("step") > F.col("low")) & (F.col("step") < F.col("high")), F.lit(False))
        tilt = F.when(inside, F.col("step")).otherwise((F.col("low") + F.col("high")) / 2)
        done = F.col("done") | (F.abs("gap") <= tolerance * F.col("target")) | (F.col("high") - F.col("low") <= 1e-15)
        after = work.table(moved.select("source", "target", F.when(done, F.col("tilt")).otherwise(tilt).alias("tilt"), "low", "high", done.alias("done")), f"tilt-{k}")
        work.drop(f"tilt-{k - 1}")
        state = after
        if after.where("not done").isEmpty():
            return state.select("source", "tilt")
    raise RuntimeError(f"the balance did not settle in {most_rounds} rounds")


def rounded(work: Workspace, cells: DataFrame, tilts: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """(source, size, n, copies): whole copies of each cell, between those of the rate rounded down and up for all its documents.

    Systematic sampling: with the sizes of a source from the largest down, a cell gets the whole numbers that the sum of
    rates passes in it. So sums of copies keep within one of those of rates, and a source within its largest document of
    its target. What is left then goes to one cell of each power of two, the one with most room, from the largest down.
    """
    t, g = tilts.select(F.col("source").alias("t_source"), "tilt"), wanted.select(F.col("source").alias("g_source"), "target")
    units = F.round(rate(F.col("size").cast("double"), F.coalesce("tilt", F.lit(0.0)), most) * UNIT).cast("long")
    held = cells.join(t, same(F.col("source"), F.col("t_source")), "left").select("source", "size", "n", units.alias("units"))
    passed = F.sum(F.col("n") * F.col("units")).over(Window.partitionBy("source").orderBy(F.desc("size")))
    held = held.withColumn("passed", passed).withColumn("copies", F.expr(f"(passed + {UNIT // 2}) div {UNIT} - (passed - n * units + {UNIT // 2}) div {UNIT}"))
    held = work.table(held.withColumn("least", F.expr(f"n * (units div {UNIT})")).withColumn("top", F.expr(f"n * ((units + {UNIT - 1}) div {UNIT})")).drop("passed"), "rounded")

    left = held.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).join(g, same(F.col("source"), F.col("g_source"))).select("source", F.round(F.col("target") - F.col("taken")).cast("long").alias("left"))
    room = held.join(left.withColumnRenamed("source", "l_source"), same(F.col("source"), F.col("l_source")))
    cap = F.when(F.col("left") > 0, F.col("top") - F.col("copies")).otherwise(F.col("copies") - F.col("least"))
    room = room.withColumn("cap", cap).where((F.col("cap") > 0) & (F.col("size") > 0) & (F.col("size") < 2 * F.abs("left")))
    best = room.groupBy("source", "left", F.floor(F.log2("size")).alias("power")).agg(F.max(F.struct("cap", "size")).alias("best"))
    lists = best.groupBy("source", "left").agg(F.sort_array(F.collect_list(F.struct("best.size", "best.cap")), asc=False).alias("cells"))  # one a power of two
    begun = F.struct(F.abs("left").alias("left"), F.expr("cast(array() as array<struct<size:bigint,more:bigint>>)").alias("out"))

    def take(acc: Column, c: Column) -> Column:
        n = F.least(c["cap"], F.greatest(F.lit(0), F.round(acc["left"] / c["size"]).cast("long")))
        return F.struct((acc["left"] - n * c["size"]).alias("left"), F.concat(acc["out"], F.array(F.struct(c["size"].alias("size"), n.alias("more")))).alias("out"))

    given = lists.select("source", F.signum("left").cast("long").alias("sign"), F.explode(F.aggregate("cells", begun, take, lambda acc: acc["out"])).alias("c"))
    given = given.select(F.col("source").alias("c_source"), F.col("c.size").alias("c_size"), (F.col("sign") * F.col("c.more")).alias("more"))
    out = held.join(given, same(F.col("source"), F.col("c_source")) & (F.col("size") == F.col("c_size")), "left")
    return out.select("source", "size", "n", "units", (F.col("copies") + F.coalesce("more", F.lit(0))).alias("copies"))


def mix(docs: DataFrame, weights: list[float] | None = None, share: float = 1.5, most: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs`` as (doc_id, source, size, source_size, target, rate, copies, taken), with the columns of ``keep``.

    ``rate`` is the tilted rate of the row's source and size, and ``copies`` that rate rounded down or up; which rows of
    a cell get the one more is told by the hash of the doc_id. Null and empty texts have size 0, rate 1 and take no
    words; texts of any length are counted whole; a null source is a source, the last; rows that repeat, and rows of one
    doc_id, null or not, are documents of their own; other columns of ``docs`` do not matter; an empty table gives an
    empty one. Rows, sources and sizes alone decide, so reruns agree.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "mix")
    rows = work.table(pick(docs, "doc_id", "source", "text", *keep).select("doc_id", "source", word_count(F.col("text")).alias("size"), *keep), "rows")
    n_parts = max(PARTS, rows.count() // PART_ROWS)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(n_parts)).cast("int"))
    parts = work.table(rows.groupBy("source", "size", "part").agg(F.count("*").alias("n")), "parts")
    cells = work.table(parts.groupBy("source", "size").agg(F.sum("n").alias("n")), "cells")
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    wanted = work.table(targets(work, sources, weights or [3, 1, 2], share, most), "targets")
    tilts = balance(work, cells.where("size > 0"), wanted, most)
    dealt = rounded(work, cells, tilts, wanted, most)

    deal = dealt.select(F.col("source").alias("d_source"), F.col("size").alias("d_size"), (F.col("units") / UNIT).alias("rate"), F.expr("copies div n").alias("each"), (F.col("copies") % F.col("n")).alias("more"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    w = wanted.select(F.col("source").alias("w_source"), "source_size", "target")
    plan = parts.withColumn("before", earlier).join(deal, same(F.col("source"), F.col("d_source")) & (F.col("size") == F.col("d_size"))).join(w, same(F.col("source"), F.col("w_source")))
    plan = work.table(plan.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), F.col("part").alias("p_part"), "before", "rate", "each", "more", "source_size", "target"), "plan")
    work.drop("ranged", "weighed", "rounded", "cells", "targets")

    place = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy(F.xxhash64("doc_id"), "doc_id", *keep))
    out = rows.withColumn("place", place).join(plan, same(F.col("source"), F.col("p_source")) & (F.col("size") == F.col("p_size")) & (F.col("part") == F.col("p_part")))
    copies = F.col("each") + F.when(F.col("before") + F.col("place") <= F.col("more"), 1).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *keep)
