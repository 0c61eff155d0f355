"""SimHash near-dedup by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import Bloom, Workspace, build_bloom, components, few_or_hashed, per_batch, pick, small_batches

SHINGLES_AT_ONCE = 1 << 16

#: Sets are near copies if they share this part, as a fraction, of all that either has.
LEAST = (4, 5)
#: Shingles that a task gathers before it sends them, and about as many as one part of them has where they are counted.
BUNDLE, PART = 1 << 18, 1 << 19
#: Times as many sets of a bucket meet all others in each round.
SPREAD = 8


def shingles(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """The XXH64 of a text's shingles, repeats included; a text of fewer words has one of all it has, a blank one none."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode().lower().split()  # of bytes, both touch ASCII only
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[: -words] + 1))
    return np.fromiter((xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> np.ndarray:
    """Of rows of 64-bit hashes, one a shingle, the bits, lowest first, that over half of them have."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), SHINGLES_AT_ONCE):
        ones += np.unpackbits(hashes[k : k + SHINGLES_AT_ONCE].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return ones * 2 > len(hashes)


def simhash(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit fingerprint of one text as a signed integer: bit k is set if over half the shingles' XXH64 have it."""
    return int(np.packbits(majority(shingles(text, words, seed)), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long): null and blank texts have fingerprint zero, texts of fewer words the hash of all they have."""
    small_batches(docs.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([simhash(t, words, seed) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    return pick(docs, "doc_id", "text").mapInArrow(per_batch(run), "doc_id long, fp long")


def near_fingerprints(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` that connect all within ``radius`` bits, which is 2.

    Each fingerprint emits every variant within half the radius. Two within the radius share one, and all that share
    one are within the radius, so the sorted fingerprints of a variant, 65 at most whatever the data, are chained;
    each link is verified by its distance.
    """
    if radius != 2:
        raise ValueError("the ball is built for a radius of 2 bits")
    ball = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    emitted = distinct.select("fp", F.explode(ball).alias("variant"))
    chained = emitted.withColumn("b", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))).where("b is not null")
    return chained.select(F.col("fp").alias("a"), "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """Every row of ``docs`` as (doc_id, fp, component_id): the smallest doc_id its fingerprint can reach by links.

    Equal fingerprints are one node, so groups of copies of any size cost one ball. Null, empty and blank texts have
    fingerprint zero, long ones are read whole. Rows with a null doc_id get their group's smallest id, null if it has
    none; repeated rows stay repeated; other columns of ``docs`` do not matter; an empty table gives an empty one.
    """
    work = Workspace(docs.sparkSession, "simhash")
    prints = work.table(fingerprints(docs, words, seed), "prints")
    nodes = work.table(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    links = work.table(near_fingerprints(nodes.select("fp"), radius), "links")
    rooted = nodes.join(components(work, links, "a", "b"), nodes.fp == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = work.table(rooted.join(least, "root").select("fp", "component_id"), "classes")
    work.drop("nodes", "links")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


# Near copies by similarity --------------------------------------------------------------------------------------------


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """(row, node, n, fp): the number of the text's shingle set, zero for an empty one, its size and its fingerprint."""
    small_batches(docs.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        from xxhash import xxh64_intdigest

        sets = [np.unique(shingles(t, words)) for t in b.column(1).to_pylist()]
        nodes = np.array([xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
        prints = [int(np.packbits(majority(s), bitorder="little").view(np.int64)[0]) for s in sets]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.int64())], ["row", "node", "n", "fp"])

    return pick(docs, "row", "text").mapInArrow(per_batch(run), "row long, node long, n long, fp long")


def _repeated(docs: DataFrame, words: int, parts: int) -> DataFrame:
    """(tok, df): the shingles that more than one text of (row, text) holds, with the number of such texts.

    Hashes travel as bytes, eight a shingle, dealt into ``parts`` by their value; each task counts what it has first.
    """

    def dealt(sets: list[np.ndarray]) -> pa.RecordBatch:
        toks, counts = np.unique(np.concatenate(sets), return_counts=True)
        part = (toks % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        toks, counts, part = toks[order], counts[order].astype(np.uint64), part[order]
        once, more = [], []
        found, starts = np.unique(part, return_index=True)
        for s, e in zip(starts, [*starts[1:], len(part)], strict=True):
            single = counts[s:e] == 1
            once.append(toks[s:e][single].tobytes())
            more.append(np.column_stack((toks[s:e][~single], counts[s:e][~single])).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["part", "once", "more"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, size = [], 0
        for b in batches:
            for text in b.column(1).to_pylist():
                sets.append(np.unique(shingles(text, words)))
                size += len(sets[-1])
                if size >= BUNDLE:
                    yield dealt(sets)
                    sets, size = [], 0
        if size:
            yield dealt(sets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = defaultdict(list)
        for b in batches:
            for part, once, more in zip(*(c.to_pylist() for c in b.columns), strict=True):
                by[part].append((once, more))
        for bundles in by.values():
            once = np.concatenate([np.frombuffer(x, np.uint64) for x, _ in bundles])
            more = np.concatenate([np.frombuffer(x, np.uint64).reshape(-1, 2) for _, x in bundles])
            toks, counts = np.concatenate((once, more[:, 0])), np.concatenate((np.ones(len(once), np.int64), more[:, 1].astype(np.int64)))
            order = np.argsort(toks)
            toks, counts = toks[order], counts[order]
            starts = np.flatnonzero(np.concatenate(([True], toks[1:] != toks[:-1])))
            toks, df = toks[starts].view(np.int64), np.add.reduceat(counts, starts)
            toks, df = toks[df > 1], df[df > 1]
            for k in range(0, len(toks), SHINGLES_AT_ONCE):
                yield pa.RecordBatch.from_arrays([pa.array(toks[k : k + SHINGLES_AT_ONCE]), pa.array(df[k : k + SHINGLES_AT_ONCE])], ["tok", "df"])

    return pick(docs, "row", "text").mapInArrow(deal, "part long, once binary, more binary").repartition(parts, "part").mapInArrow(count, "tok long, df long")


def least_shared(n: Column) -> Column:
    """The shingles that a set of ``n`` shares at least with a near copy."""
    part, whole = LEAST
    return F.floor((part * n + whole - 1) / whole).cast("long")


def _held(docs: DataFrame, repeated: Bloom, words: int) -> DataFrame:
    """(row, held): of each text of (row, text) that can have a near copy, those shingles that pass the filter; no others can be shared."""
    part, whole = LEAST

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        found, at = [], []
        for k, text in enumerate(b.column(1).to_pylist()):
            held = np.unique(shingles(text, words))
            known = held[repeated.has(held)]
            if len(known) and whole * len(known) >= part * len(held):
                found.append(known.view(np.int64))
                at.append(k)
        if not at:
            return None
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(found, pa.list_(pa.int64()))], ["row", "held"])

    return pick(docs, "row", "text").mapInArrow(per_batch(run), "row long, held array<long>")


def _buckets(held: DataFrame, repeated: DataFrame) -> DataFrame:
    """(tok, node, n, pos, rank): the sets that have a shingle among the first of their own, the rarest first.

    A set of n shingles shares at least m = ceil(4n / 5) with a near copy, so one of its first n - m + 1 in an order that is
    the same for all sets; the first one that both have is among them in either. ``pos`` shingles of the set come before.
    """
    known = held.select("node", "n", F.explode("held").alias("tok")).join(repeated, "tok")
    sets = known.groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("known"))
    firsts = sets.where(F.size("known") >= least_shared(F.col("n"))).withColumn("alone", F.col("n") - F.size("known"))
    rows = firsts.select("node", "n", "alone", F.posexplode(F.slice("known", F.lit(1), (F.size("known") - least_shared(F.col("n")) + 1).cast("int"))).alias("at", "t"))
    rows = rows.select("t.tok", "node", "n", (F.col("alone") + F.col("at")).alias("pos"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("tok").orderBy("pos", "n", "node")))
    return ranked.withColumn("size", F.count("*").over(Window.partitionBy("tok"))).where("size > 1").drop("size")


class _Links:
    """The links found so far between sets, (node, n, held), and what they connect."""

    def __init__(self, work: Workspace, held: DataFrame) -> None:
        self.work, self.held = work, held
        self.links, self.roots, self.tried, self.rounds = None, None, None, 0

    def rooted(self, rows: DataFrame) -> DataFrame:
        """The rows, each with its node's ``root``."""
        if self.roots is None:
            return rows.withColumn("root", F.col("node"))
        return rows.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def seek(self, pairs: DataFrame) -> None:
        """Verifies those of the pairs (a, b), a < b, that were not tried before."""
        self.rounds += 1
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = self.work.table(pairs.distinct(), f"pairs-{self.rounds}")
        self.tried = pairs if self.tried is None else self.tried.union(pairs)
        found = self.work.table(_verified(pairs, self.held), f"links-{self.rounds}")
        if not found.isEmpty():
            self.links = found if self.links is None else self.links.union(found)
            self.roots = self.work.table(components(Workspace(self.work.spark, "similar-roots"), self.links, "a", "b"), f"roots-{self.rounds}")


def _verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets are near copies."""
    part, whole = LEAST
    a, b = held.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("held").alias("held_a")), held.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("held").alias("held_b"))
    both = F.size(F.array_intersect("held_a", "held_b"))
    return pairs.join(a, "a").join(b, "b").where((part + whole) * both >= part * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _alike(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: sets of (node, fp) that operator 3 links, those of equal fingerprints by the first of them."""
    firsts = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    equal = nodes.join(firsts, "fp").where("node <> first").select(F.col("first").alias("x"), F.col("node").alias("y"))
    near = near_fingerprints(firsts.select("fp")).join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select("x", "y")
    return equal.union(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _met(rooted: DataFrame, high: int) -> DataFrame:
    """(a, b), a < b: the buckets' sets of ranks below ``high`` with all after them that no link connects with them yet, where sizes and places leave the least similarity possible."""
    part, whole = LEAST
    x, y = rooted.where(F.col("rank") < high).alias("x"), rooted.alias("y")
    n = F.col("x.n") + F.col("y.n")
    sizes = whole * F.least("x.n", "y.n") >= part * F.greatest("x.n", "y.n")
    places = (part + whole) * F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= part * n
    met = x.join(y, (F.col("x.tok") == F.col("y.tok")) & (F.col("x.rank") < F.col("y.rank")) & (F.col("x.root") != F.col("y.root")) & sizes & places)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def similar_documents(docs: DataFrame, words: int = 5) -> DataFrame:
    """Every row of ``docs``, (row, text), as (row, group): alike for texts that links of similarity LEAST or more connect.

    Exact. Texts of one shingle set are one node, so groups of copies of any size cost one. A text of whose shingles fewer
    than LEAST are in any other text has no link. The others are linked by operator 3's fingerprints first, each link
    verified by the Jaccard similarity of the whole sets. What these leave apart meets by prefixes: all near copies share
    one of their rarest shingles. In such a bucket the first set meets all that are not connected with it yet, then the
    next SPREAD of those that are still apart, and so on until a bucket is connected or all its pairs were tried: nothing
    is capped, and a large group costs few times its size where its links connect it.
    Null and blank texts have an empty set and are one group; texts of fewer words have one shingle of all their words;
    long texts are read whole; repeated rows and rows without other columns are nothing special; no rows give no rows.
    """
    work = Workspace(docs.sparkSession, "similar")
    sketches = work.table(_sketches(docs, words), "sketches")
    nodes = work.table(sketches.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.min("row").alias("of")), "nodes")
    n_nodes, n_shingles = nodes.count(), sketches.agg(F.sum("n")).first()[0] or 0
    repeated = work.table(_repeated(docs, words, 1 + n_shingles // PART), "repeated")
    known = build_bloom(repeated.select("tok"), repeated.count())
    held = work.table(_held(docs, known, words).join(few_or_hashed(nodes, n_nodes), F.col("row") == F.col("of")).select("node", "n", "fp", "held"), "held")

    found = _Links(work, held.select("node", "n", "held"))
    found.seek(_alike(held.select("node", "fp")))
    left, low, wide = work.table(_buckets(held, repeated), "buckets"), 1, 1
    while not left.isEmpty():
        found.seek(_met(found.rooted(left), low + wide))
        low, wide = low + wide, wide * SPREAD
        by = Window.partitionBy("tok")
        apart = found.rooted(left.where(F.col("rank") >= low)).withColumn("apart", F.min("root").over(by) != F.max("root").over(by))
        left = work.table(apart.where("apart").drop("root", "apart"), f"left-{low}")
    work.drop("nodes", "held", "repeated", "buckets")
    if found.roots is None:
        return sketches.select("row", F.col("node").alias("group"))
    return sketches.select("row", "node").join(found.roots, "node", "left").select("row", F.coalesce("root", "node").alias("group"))
