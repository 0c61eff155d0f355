"""Embedding near-dedup by PCA-ordered tiled comparison."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import Workspace, components, pick, small_batches

#: Rows of a tile, leading dimensions by which tiles are cut, rows of the sample that sets the cuts, most cells.
TILE, LEADING, SAMPLE, CELLS = 4096, 8, 20_000, 1024
#: Blocks of tiles are what is shuffled, each to all blocks it may have links with: of so many bytes as doubles at most,
#: so that a vector is sent n / block times, and so many of them at least, so that there are tasks for all.
BLOCK_BYTES, BLOCKS = 32 << 20, 16
#: Rows compared at once within a task, on either side.
ROWS, COLUMNS = 512, 2048
#: Vectors of one length, if they are no more than this, are compared in one task, for all such lengths in one plan.
FEW = 4096
#: Dimensions added before the next test of the bound.
STEPS = (8, 16, 32)
SLACK = 1e-9


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _scaled(v: np.ndarray) -> np.ndarray:
    """Each row by a power of two, which is exact, so that its largest component is near 1 and no square overflows."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def _unit(v: np.ndarray) -> np.ndarray:
    w = _scaled(v)
    return w / np.linalg.norm(w, axis=1)[:, None]


def _axes(rows: DataFrame, dim: int) -> np.ndarray:
    """Principal axes, leading first, of the second moments of all unit vectors; tasks send sums only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            v = _unit(_vectors(b.column(0)))
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["k", "x"])

    got = rows.select("v").mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).toArrow()
    moments = np.zeros(dim * dim)
    moments[got["k"].to_numpy()] = got["x"].to_numpy()
    values, axes = np.linalg.eigh(moments.reshape(dim, dim))
    return axes[:, np.argsort(-values)]


def _cuts(sample: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """A complete binary tree, by level, of (axis, median): each level halves the sample along the axis of most spread."""
    out, parts = [], [np.arange(len(sample))]
    while len(parts) < cells:
        nexts = []
        for p in parts:
            axis = int(sample[p].var(axis=0).argmax()) if len(p) else 0
            cut = float(np.median(sample[p, axis])) if len(p) else 0.0
            out.append((axis, cut))
            left = sample[p, axis] <= cut
            nexts += [p[left], p[~left]]
        parts = nexts
    return out


def _cell_of(points: np.ndarray, cuts: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    if cuts:
        axes, values = np.array([c[0] for c in cuts]), np.array([c[1] for c in cuts])
        for _ in range((len(cuts) + 1).bit_length() - 1):
            at = 2 * at + 1 + (points[np.arange(len(points)), axes[at]] > values[at])
        at -= len(cuts)
    return at


def compare_tiles(x: np.ndarray, y: np.ndarray, threshold: float, raw: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of unit vectors, in PCA order, with cosine at or over the threshold.

    Leading dimensions are summed first for all pairs; by Cauchy and Schwarz the rest adds at most the product of the
    suffix norms, and pairs that cannot reach the threshold go before the next dimensions. The last decision is made
    in double precision on the unrotated vectors ``raw``.
    """
    dim = x.shape[1]
    ends = [s for s in STEPS if s < dim] or [dim]
    norms = lambda v, k: np.sqrt(np.maximum((v[:, k:] ** 2).sum(axis=1), 0.0))
    k = ends[0]
    part = x[:, :k] @ y[:, :k].T
    i, j = np.nonzero(part + np.outer(norms(x, k), norms(y, k)) >= threshold - SLACK)
    sums = part[i, j]
    for lo, hi in zip(ends, ends[1:], strict=False):
        sums += np.einsum("ij,ij->i", x[i, lo:hi], y[j, lo:hi])
        left = sums + norms(x, hi)[i] * norms(y, hi)[j] >= threshold - SLACK
        i, j, sums = i[left], j[left], sums[left]
    a, b = raw[0][i], raw[1][j]
    cosine = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
    left = cosine >= threshold
    return i[left], j[left]


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Gives all that the links (i, j) connect the smallest label among them, in place."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (up := label[label]).tobytes() != label.tobytes():
            label[:] = up


def may_link(centres: tuple[np.ndarray, np.ndarray], radii: tuple[np.ndarray, np.ndarray], threshold: float) -> np.ndarray:
    """Of unit centres and angular radii of two lists of tiles: which pairs can hold vectors with a cosine at the threshold."""
    between = np.arccos(np.clip(centres[0] @ centres[1].T, -1, 1))
    return between - radii[0][:, None] - radii[1][None, :] <= np.arccos(threshold) + 1e-6


def _tiles(unit: np.ndarray, rows: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows in the order of their leading component, cut into tiles, with each tile's centre and radius."""
    order = np.argsort(unit[:, 0], kind="stable")
    parts = [order[k : k + rows] for k in range(0, len(order), rows)]
    centres = np.array([unit[p].mean(axis=0) for p in parts]).reshape(len(parts), -1)
    norms = np.linalg.norm(centres, axis=1)[:, None]
    centres = np.where(norms > 0, centres / np.where(norms > 0, norms, 1), np.eye(1, centres.shape[1]))
    radii = np.array([np.arccos(np.clip((unit[p] @ c).min(initial=1.0), -1, 1)) for p, c in zip(parts, centres, strict=True)])
    return parts, centres, radii


def compare_blocks(v: np.ndarray, side: np.ndarray, axes: np.ndarray, copies: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, label) of the vectors of one block with each other, or of those of side 1 with those of side 2.

    Tiles whose centres lie too far apart are skipped, all others compared.
    """
    raw = _scaled(v)
    unit = raw / np.linalg.norm(raw, axis=1)[:, None] @ axes
    alone = not side.any()
    left = np.flatnonzero(side <= 1)
    right = left if alone else np.flatnonzero(side == 2)
    counts, label = np.zeros(len(v), np.int64), np.arange(len(v))
    if not len(left) or not len(right):
        return counts, label
    rows, r_centres, r_radii = _tiles(unit[left], ROWS)
    columns, c_centres, c_radii = _tiles(unit[right], COLUMNS)
    near = may_link((r_centres, c_centres), (r_radii, c_radii), threshold)
    for k, p in enumerate(rows):
        for m in np.flatnonzero(near[k]).tolist():
            a, b = left[p], right[columns[m]]
            i, j = compare_tiles(unit[a], unit[b], threshold, (raw[a], raw[b]))
            i, j = a[i], b[j]
            if alone:
                i, j = i[i < j], j[i < j]
            np.add.at(counts, i, copies[j])
            np.add.at(counts, j, copies[i])
            _join(label, i, j)
    return counts, label


def _found(node: np.ndarray, counts: np.ndarray, label: np.ndarray) -> pa.Table:
    some = np.flatnonzero(counts)
    return pa.table({"node": node[some], "n": counts[some], "root": node[label[some]]})


def _few(work: Workspace, classes: DataFrame, threshold: float) -> DataFrame:
    """(node, n, root) of (node, copies, v, dim) rows of lengths that FEW vectors have, each length in one task."""

    def meet(table: pa.Table) -> pa.Table:
        v = _vectors(table["v"].combine_chunks())
        unit = _unit(v)
        axes = np.linalg.eigh(unit.T @ unit)[1][:, ::-1] if v.shape[1] <= FEW else np.eye(v.shape[1])
        node = table["node"].to_numpy()
        return _found(node, *compare_blocks(v, np.zeros(len(v), np.int64), axes, table["copies"].to_numpy(), threshold))

    return work.table(classes.groupBy("dim").applyInArrow(meet, "node long, n long, root long"), "links-few")


def _links(work: Workspace, classes: DataFrame, n: int, dim: int, threshold: float, tile: int) -> DataFrame:
    """Of ``n`` rows (node, copies, v) of one length: (node, n, root), numbers of linked vectors, and nodes they are connected with."""
    spark = classes.sparkSession
    axes = _axes(classes, dim)
    leading = min(LEADING, dim)
    sample = _unit(_vectors(classes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("v").toArrow()["v"].combine_chunks())) @ axes
    cells = 1
    while cells * tile < n and cells < CELLS:
        cells *= 2
    cuts = _cuts(sample[:, :leading], cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit = _unit(_vectors(b.column("v"))) @ axes[:, :leading]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("copies"), b.column("v"), pa.array(_cell_of(unit, cuts))], ["node", "copies", "v", "cell"])

    placed = classes.select("node", "copies", "v").mapInArrow(place, f"node long, copies long, v {classes.schema['v'].dataType.simpleString()}, cell long")
    placed = work.table(placed, f"placed-{dim}")
    held = dict(placed.groupBy("cell").count().collect())  # at most CELLS rows
    # Neighbouring cells are one group while they fill no block; a cell of several blocks is cut by hash.
    rows = min(max(1, BLOCK_BYTES // (8 * dim)), max(tile // 4, -(-n // BLOCKS)))
    groups: list[list[int]] = []
    for c in sorted(held):
        if groups and sum(held[x] for x in groups[-1]) + held[c] <= rows:
            groups[-1].append(c)
        else:
            groups.append([c])
    group_of = {c: g for g, cs in enumerate(groups) for c in cs}
    parts = [-(-sum(held[c] for c in cs) // rows) for cs in groups]
    first = np.cumsum([0, *parts]).tolist()
    at = np.array([group_of.get(int(c), -1) for c in _cell_of(sample[:, :leading], cuts)])
    centres = np.array([sample[at == g].mean(axis=0) if (at == g).any() else np.eye(1, dim)[0] for g in range(len(groups))])
    centres /= np.maximum(np.linalg.norm(centres, axis=1)[:, None], 1e-12)

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, wide = np.full((len(groups), leading), np.inf), np.full((len(groups), leading), -np.inf), np.zeros(len(groups))
        for b in batches:
            p = _unit(_vectors(b.column("v"))) @ axes
            of = np.array([group_of[c] for c in b.column("cell").to_pylist()])
            np.minimum.at(low, of, p[:, :leading])
            np.maximum.at(high, of, p[:, :leading])
            np.maximum.at(wide, of, np.arccos(np.clip((p * centres[of]).sum(axis=1), -1, 1)))
        for g in np.flatnonzero(np.isfinite(low[:, 0])).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([g] * leading), pa.array(range(leading)), pa.array(low[g]), pa.array(high[g]), pa.array([wide[g]] * leading)], ["g", "axis", "low", "high", "wide"])

    lows, highs, radii = np.zeros((len(groups), leading)), np.zeros((len(groups), leading)), np.zeros(len(groups))
    boxes = placed.select("v", "cell").mapInArrow(corners, "g long, axis long, low double, high double, wide double").groupBy("g", "axis").agg(F.min("low"), F.max("high"), F.max("wide"))
    for g, k, a, b, r in boxes.collect():
        lows[g, k], highs[g, k], radii[g] = a, b, r
    reach = 2 * (1 - threshold) + SLACK  # squared distance of unit vectors
    gaps = np.maximum(0, np.maximum(lows[:, None] - highs[None], lows[None] - highs[:, None]))
    near = ((gaps**2).sum(axis=2) <= reach) & may_link((centres, centres), (radii, radii), threshold)
    others = [[(first[o], first[o + 1] - 1) for o in np.flatnonzero(near[g]).tolist()] for g in range(len(groups))]
    table = [(c, first[g], parts[g], others[g]) for c, g in group_of.items()]  # at most CELLS rows of as many pairs
    cells_of = spark.createDataFrame(table, "cell long, first long, parts long, others array<struct<lo:long,hi:long>>")
    block = (F.col("first") + F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts"))).alias("block")
    sent = placed.join(F.broadcast(cells_of), "cell").select("node", "copies", "v", block, F.explode(F.flatten(F.transform("others", lambda o: F.sequence(o["lo"], o["hi"])))).alias("other"))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    sent = sent.select("node", "copies", "v", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), side.alias("side"))

    def meet(table: pa.Table) -> pa.Table:
        return _found(table["node"].to_numpy(), *compare_blocks(_vectors(table["v"].combine_chunks()), table["side"].to_numpy(), axes, table["copies"].to_numpy(), threshold))

    found = work.table(sent.groupBy("one", "two").applyInArrow(meet, "node long, n long, root long"), f"links-{dim}")
    work.drop(f"placed-{dim}")
    return found


def near_vectors(rows: DataFrame, threshold: float = 0.95, tile: int = TILE) -> DataFrame:
    """Every row of ``rows`` as (vec_id, n_links, component_id, kept).

    Vectors of one length link at a cosine of at least ``threshold``, in double precision; vectors that are null, empty,
    zero or hold null or non-finite components link with nothing and are their own component. Equal vectors are one
    node with its number of copies, so a group of copies of any size takes one place in a tile. A null vec_id is
    counted as a link of others but names no component unless the group has no other; it is kept only there. Rows that
    repeat are vectors of their own, vectors of any length are compared whole, other columns of ``rows`` do not matter,
    and an empty table gives an empty one.
    """
    small_batches(rows.sparkSession)
    work = Workspace(rows.sparkSession, "embed")
    kind = rows.schema["embedding"].dataType.elementType.typeName()
    v = F.col("embedding") if kind in ("float", "double") else F.col("embedding").cast("array<double>")
    good = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    all_rows = pick(rows, "vec_id", "embedding").select("vec_id", F.when(good, v).alias("v"))
    # A copy's key is 128 bits of its vector; equal keys are taken as equal vectors.
    key = F.when(F.col("v").isNotNull(), F.substring(F.sha2(F.array_join(F.transform("v", lambda x: (x.cast("double") + 0.0).cast("string")), ","), 256), 1, 32))
    all_rows = work.table(all_rows.withColumn("key", key), "rows")
    classes = all_rows.where("v is not null").groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = work.table(classes.withColumn("node", F.conv(F.substring("key", 1, 16), 16, -10).cast("long")).withColumn("dim", F.size("v")), "classes")
    own = F.col("vec_id")
    lengths = dict(classes.groupBy("dim").count().collect())
    large = sorted(d for d, n in lengths.items() if n > min(FEW, tile))  # a plan each: at most one for as many vectors
    found = [_links(work, classes.where(F.col("dim") == d), lengths[d], d, threshold, tile) for d in large]
    if len(large) < len(lengths):
        found.append(_few(work, classes.where(~F.col("dim").isin(large)) if large else classes, threshold))
    if not found:
        return all_rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), own.alias("component_id"), F.lit(True).alias("kept"))
    links = reduce(DataFrame.union, found)
    edges = links.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    counts = links.groupBy(F.col("node").alias("at")).agg(F.sum("n").alias("n"))
    rooted = classes.join(components(work, edges, "a", "b").withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("key", "node", "first_id", "copies", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    told = rooted.join(least, "root").join(counts, F.col("node") == F.col("at"), "left")
    told = work.table(told.select(F.col("key").alias("of"), "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "told")
    work.drop("classes")
    out = all_rows.join(told, F.col("key") == F.col("of"), "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("of").isNull(), own).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", own.eqNullSafe(F.col("component_id")))
