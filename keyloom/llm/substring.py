"""Substring dedup with prefix-partitioned suffix trees over words.

The suffixes of the corpus are those of its word sequences. A suffix tree over all would have an internal node at depth
``window`` or more for each passage of that many words that repeats. Three passes build only what those nodes need:

1. Every window of 13 words holds prefixes of 5 words; the one of smallest hash is its anchor, the same wherever the
   window stands. Anchors are counted by document. One that a single document holds heads a branch with no node that
   two documents share, and is left out.
2. The suffixes of windows whose anchor repeats are sent to the group of their prefix: the anchor, or, where so many
   documents hold it that its group would not fit in memory, the longer prefix of the whole window.
3. Each group's tree is walked, and nodes of full depth keep the smallest document below them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import Bloom, Workspace, build_bloom, pick, small_batches

#: Words of the first prefix, and most documents for one group of it.
PREFIX, GROUP = 5, 5_000
#: Places of lost words that may be sent to all executors; of more, texts are shuffled to theirs.
SENT_BYTES = 4 << 20

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_blank = np.zeros(256, bool)
_blank[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of a batch of texts, all at once: ``hashes`` and, by word, the number of its text in ``doc``."""

    powers = _powers(1, BASE)

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_binary()) if texts.null_count == 0 else pa.array([x or b"" for x in texts.cast(pa.large_binary()).to_pylist()], pa.large_binary())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        lo, hi = int(offsets[0]), int(offsets[-1])
        raw = np.frombuffer(data, np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
        bounds = offsets - lo
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = ~_blank[raw]
        # A text's end ends its last word: a blank is put between texts.
        step = np.diff(inside)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        cut = bounds[1:-1]
        cut = cut[(cut > 0) & (cut < len(raw))]
        if len(cut):
            joined = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
            joined = np.unique(joined)
            starts, ends = np.sort(np.concatenate([starts, joined])), np.sort(np.concatenate([ends, joined]))
        # Polynomial hash of each word's bytes, low power first: Horner's sums over the longest word at most.
        value = np.zeros(len(starts), np.uint64)
        length = ends - starts
        order = np.argsort(-length, kind="stable")
        left = np.searchsorted(-length[order], -np.arange(1, int(length.max(initial=0)) + 1), side="right")
        if len(left) <= 256:
            for k, n in enumerate(left.tolist()):
                at = order[:n]
                value[at] = value[at] * BASE + raw[starts[at] + k] + np.uint64(1)
        else:  # some very long word: hash it apart
            for k, n in enumerate(left[:256].tolist()):
                at = order[:n]
                value[at] = value[at] * BASE + raw[starts[at] + k] + np.uint64(1)
            for at in order[: int(left[256])].tolist():
                value[at] = np.frombuffer(hashlib.blake2b(raw[starts[at] : ends[at]].tobytes(), digest_size=8).digest(), np.uint64)[0]
        self.hashes = _mix(value + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.doc = np.searchsorted(bounds, starts, side="right") - 1
        # Empty texts share bounds; a word belongs to the last text that starts at or before it.
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def rolling(self, k: int, seed: int = 0) -> np.ndarray:
        """Hash of the k words from each word on; meaningless where a text ends earlier."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        base = np.uint64(0xD1342543DE82EF95 + 2 * seed)
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = out * base + (self.hashes[i : i + n] ^ np.uint64(seed * 0x2545F4914F6CDD1D & (2**64 - 1)))
        return _mix(out)

    def windows(self, k: int) -> np.ndarray:
        """Starts of the windows of k words of one text."""
        n = len(self.hashes) - k + 1
        return np.flatnonzero(self.doc[:n] == self.doc[k - 1 : k - 1 + n]) if n > 0 else np.zeros(0, np.int64)

    def anchors(self, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
        """(window starts, place of each window's anchor, the leftmost prefix of smallest hash) and the prefixes' hashes."""
        hashes = self.rolling(prefix)
        n, span = len(self.hashes) - window + 1, window - prefix + 1
        if n <= 0:
            return np.zeros(0, np.int64), hashes
        best, at = hashes[:n].copy(), np.arange(n)
        for i in range(1, span):
            other = hashes[i : i + n]
            less = other < best
            best[less] = other[less]
            at[less] = np.flatnonzero(less) + i
        return at, hashes


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchor_counts(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """(anchor, n_docs): anchors that more than one document holds; each task counts an anchor of a document once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = Words(b.column(0))
            at, hashes = w.anchors(window, prefix)
            starts = w.windows(window)
            if len(starts):
                places = np.unique(at[starts])
                order = np.lexsort((w.doc[places], hashes[places]))
                anchor, doc = hashes[places][order], w.doc[places][order]
                new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
                other = new | np.concatenate([[True], doc[1:] != doc[:-1]])
                first = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([_signed(anchor[first]), pa.array(np.add.reduceat(other, first).astype(np.int32))], ["anchor", "n"])

    return docs.select("text").mapInArrow(run, "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n_docs")).where("n_docs > 1")


def _lists(keys: tuple[np.ndarray, ...], places: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Rows of equal keys as one: where its first is, and the places of all as 32-bit numbers."""
    order = np.lexsort((places, *keys))
    new = np.concatenate([[True], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)])
    first = np.flatnonzero(new)
    offsets = np.concatenate([first, [len(order)]]).astype(np.int32) * 4
    held = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(places[order].astype(np.int32).tobytes())])
    return order[first], held


def repeated_suffixes(docs: DataFrame, window: int, prefix: int, repeats: Bloom, heavy: Bloom) -> DataFrame:
    """(anchor, low, high, doc_id, text_id, places, words): a row for each different run of windows of a document under one repeated anchor.

    ``words`` holds the hashes of the run's words, which spell all its suffixes, ``places`` where it starts; under a
    heavy anchor each different window is a row of its own, whose prefix is the whole window, as two hashes ``low`` and
    ``high``. So what a document says again and again is sent once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            w = Words(b.column(2))
            at, hashes = w.anchors(window, prefix)
            starts = w.windows(window)
            if not len(starts):
                continue
            places, back = np.unique(at[starts], return_inverse=True)
            passed = repeats.has(hashes[places])
            large = passed & heavy.has(hashes[places])
            doc = w.doc[starts]
            own = starts - w.first[doc]
            low = w.rolling(window, 1) if passed.any() else None
            many = large[back]
            if many.any():
                s, d = starts[many], doc[many]
                high = w.rolling(window, 2)
                first, lists = _lists((high[s], low[s], d), own[many])
                n = len(first)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), _signed(low[s[first]]), _signed(high[s[first]]), pa.array(ids[d[first]]), pa.array(texts[d[first]]), lists, pa.nulls(n, pa.binary())], names)
            few = (passed & ~large)[back]
            if few.any():
                s, a, d = starts[few], back[few], doc[few]
                new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)]))
                last = np.concatenate([new[1:], [len(s)]]) - 1
                # A run is no longer than its first and last window together, whose hashes tell it.
                first, lists = _lists((last - new, low[s[last]], low[s[new]], d[new]), own[few][new])
                new, last = new[first], last[first]
                lo, n = s[new], s[last] + window - s[new]
                offsets = np.concatenate([[0], np.cumsum(n)]) * 8
                words = pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(w.hashes[_spread(lo, n)].tobytes())])
                none = pa.nulls(len(lo), pa.int64())
                yield pa.RecordBatch.from_arrays([_signed(hashes[places[a[new]]]), none, none, pa.array(ids[d[new]]), pa.array(texts[d[new]]), lists, words], names)

    names = ["anchor", "low", "high", "doc_id", "text_id", "places", "words"]
    return pick(docs, "doc_id", "text_id", "text").mapInArrow(run, "anchor long, low long, high long, doc_id long, text_id long, places binary, words binary")


def tree_nodes(suffixes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Of suffixes (rows of word hashes, cut at full depth), the smallest document below each one's deepest node.

    Sorted suffixes and the common prefixes of neighbours are the tree in order: its internal nodes are the intervals
    of neighbours with enough words in common, and those of full depth are the repeats.
    """
    depth = suffixes.shape[1]
    order = np.argsort(np.ascontiguousarray(suffixes.byteswap()).view(f"S{8 * depth}").ravel(), kind="stable")
    ordered = suffixes[order]
    differs = ordered[1:] != ordered[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), depth)
    opens = np.concatenate([[0], np.flatnonzero(common < depth) + 1])
    least = np.minimum.reduceat(docs[order], opens)
    out = np.empty(len(docs), np.int64)
    out[order] = np.repeat(least, np.diff(np.concatenate([opens, [len(docs)]])))
    return out


def _spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, .. of each row, n of them."""
    before = np.cumsum(n) - n
    return np.arange(int(n.sum())) - np.repeat(before, n) + np.repeat(starts, n)


def walk(rows: pa.Table, window: int) -> pa.RecordBatch:
    """(doc_id, text_id, places) of the late windows of whole groups. Equal runs of words are one branch, of the smallest document."""
    docs = rows["doc_id"].to_numpy()
    runs = rows["words"].combine_chunks().dictionary_encode()
    branch, distinct = runs.indices.to_numpy(), runs.dictionary
    ends, flat = _binary(distinct, np.uint64)
    n = np.diff(ends) - window + 1
    first = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(first, branch, docs)
    nodes = tree_nodes(flat[_spread(ends[:-1], n)[:, None] + np.arange(window)], np.repeat(first, n))
    own = n[branch]
    late = nodes[_spread((np.cumsum(n) - n)[branch], own)] < np.repeat(docs, own)
    row, k = np.repeat(np.arange(len(docs)), own)[late], _spread(np.zeros(len(docs), np.int64), own)[late]
    # Every late window of a run, at each place of the run.
    at, places = _binary(rows["places"].combine_chunks(), np.int32)
    times = np.diff(at)[row]
    out = (places[_spread(at[row], times)] + np.repeat(k, times)).astype(np.int32)
    by_row = np.bincount(row, times, len(docs)).astype(np.int64)
    held = np.flatnonzero(by_row)
    offsets = np.concatenate([[0], np.cumsum(by_row[held])]) * 4
    lists = pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(docs[held]), rows["text_id"].combine_chunks().take(pa.array(held)), lists], ["doc_id", "text_id", "places"])


def _binary(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Of numbers held as bytes: bounds of each row, in numbers, and all numbers."""
    size = np.dtype(kind).itemsize
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[int(ends[0]) : int(ends[-1])].view(kind) if ends[-1] > ends[0] else np.zeros(0, kind)
    return (ends - ends[0]) // size, data


def walk_groups(rows: DataFrame, window: int, at_once: int = 4_000) -> DataFrame:
    """(doc_id, text_id, places): windows whose words also start in a document of smaller id, of rows grouped by anchor.

    A partition's rows come sorted by anchor; whole groups are gathered until there are ``at_once`` rows, and their
    subtrees are built and walked together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            anchors = b.column(0).to_numpy()
            changes = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
            if size + b.num_rows >= at_once and held and anchors[0] != held[-1].column(0)[-1].as_py():
                yield walk(pa.Table.from_batches(held), window)
                held, size = [], 0
            if size + b.num_rows >= at_once and len(changes):
                held.append(b.slice(0, int(changes[-1])))
                yield walk(pa.Table.from_batches(held), window)
                held, size = [], 0
                b = b.slice(int(changes[-1]))
            held.append(b)
            size += b.num_rows
        if size:
            yield walk(pa.Table.from_batches(held), window)

    return rows.select("anchor", "doc_id", "text_id", "places", "words").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "doc_id long, text_id long, places binary")


def drop_repeats(docs: DataFrame, window: int = 13, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """Every row of ``docs`` as (doc_id, text, n_words, n_removed): kept words, joined by one space.

    Removed is each word covered by a window whose words also start in a document with a smaller doc_id, judged on the
    input. Null, empty and short texts lose nothing, long ones are read whole. Rows with a null doc_id are read as if
    theirs were the largest of all and no smaller than each other's; rows that repeat a doc_id, with whatever texts, are
    judged each by its own text and open windows together, so that none loses what only they hold. Words count as equal
    when their 64-bit hashes are, for all 13 words of a window. Other columns of ``docs`` do not matter, and an empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    work = Workspace(spark, "substring")
    # What a row loses depends on its doc_id and its text alone, so these two tell it.
    text_id = F.xxhash64(F.coalesce("text", F.lit("")))
    unnamed = F.lit(1 << 62) + text_id.bitwiseAND(F.lit((1 << 62) - 1))
    own = pick(docs, "doc_id", "text").select(F.col("doc_id").alias("named"), F.coalesce("doc_id", unnamed).alias("doc_id"), text_id.alias("text_id"), "text")
    counts = work.table(anchor_counts(own, window, prefix), "anchors")
    n, n_heavy = counts.agg(F.count("*"), F.coalesce(F.sum((F.col("n_docs") > group).cast("long")), F.lit(0))).first()
    repeats = build_bloom(counts.select("anchor"), n)
    heavy = build_bloom(counts.where(F.col("n_docs") > group).select("anchor"), n_heavy)
    suffixes = work.table(repeated_suffixes(own, window, prefix, repeats, heavy), "suffixes")
    # Each a table of its own, so that a join of very frequent windows may be split where they gather.
    light = work.table(walk_groups(suffixes.where("anchor is not null"), window), "light")
    many = suffixes.where("anchor is null").select("low", "high", "doc_id", "text_id", "places")
    opened = work.table(many.groupBy("low", "high").agg(F.min("doc_id").alias("opened")), "opened")
    found = light.union(work.table(many.join(opened, ["low", "high"]).where("doc_id > opened").select("doc_id", "text_id", "places"), "many"))
    lost = work.table(found.groupBy("doc_id", "text_id").agg(F.collect_list("places").alias("places")).select(F.col("doc_id").alias("of"), F.col("text_id").alias("of_text"), "places"), "lost")
    size = lost.agg(F.sum(F.aggregate("places", F.lit(24).cast("long"), lambda a, x: a + F.octet_length(x)))).first()[0] or 0
    lost = F.broadcast(lost) if size <= SENT_BYTES else lost.hint("shuffle_hash")
    work.drop("anchors", "suffixes", "light", "opened", "many")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_words, n_removed = [], [], []
            for text, places in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                words = (text or "").encode().split()
                n_words.append(len(words))
                if places.is_valid:
                    gone = np.zeros(len(words) + 1, np.int64)
                    at = np.unique(np.frombuffer(b"".join(places.as_py()), np.int32))
                    at = at[at + window <= len(words)]
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                    words = [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]
                n_removed.append(n_words[-1] - len(words))
                texts.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["doc_id", "text", "n_words", "n_removed"])

    joined = own.join(lost, (F.col("doc_id") == F.col("of")) & (F.col("text_id") == F.col("of_text")), "left").select(F.col("named").alias("doc_id"), "text", "places")
    return joined.mapInArrow(run, "doc_id long, text string, n_words long, n_removed long")
