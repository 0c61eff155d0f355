"""BPE encoding and decoding with a minimal acyclic transducer as lexicon."""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import mmap
import os
import struct
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import Workspace, driver_folder, pick, small_batches

#: Fixed value: how byte-level BPE splits a text into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The lexicon holds at most so many words, the most frequent of the corpus, none longer than this in bytes.
LEXICON_WORDS, LEXICON_LENGTH = 50_000, 64
#: Counts are told apart by so many steps to each doubling, when the least of the lexicon is looked for.
STEPS = 64
#: Words a worker remembers, twice: those met of late and those met before them; and the longest it remembers.
REMEMBERED, REMEMBERED_LENGTH = 300_000, 64


def byte_symbols() -> dict[str, int]:
    """Byte-level vocabularies spell bytes as characters: printable Latin-1 as itself, the rest from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Of a byte-level BPE file of the tokenizers library: token bytes, merge ranks and special tokens."""

    def __init__(self, file: str) -> None:
        with open(file, encoding="utf-8") as f:
            held = json.load(f)
        symbols = byte_symbols()
        ids = held["model"]["vocab"]
        self.pieces: dict[int, bytes] = {i: bytes(symbols[c] for c in t) for t, i in ids.items()}
        self.bytes_to_id = [ids[c] for c, _ in sorted(symbols.items(), key=lambda x: x[1])]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in held["model"]["merges"]]
        #: Both by the pair as one number: the merge's rank, and what it makes, by rank.
        self.ranks = {ids[a] << 20 | ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in held.get("added_tokens", [])}
        self.pieces |= {i: t.encode() for t, i in self.special.items()}

    def merge(self, word: bytes) -> list[int]:
        """Exact: the pair of lowest rank first, the leftmost of equals; a heap keeps long words near linear."""
        ids = list(map(self.bytes_to_id.__getitem__, word))
        if len(ids) > 64:
            return self._merge_long(ids)
        rank, none = self.ranks.get, len(self.made)
        at = [rank(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while at and (best := min(at)) < none:
            k = at.index(best)
            ids[k : k + 2] = [self.made[best]]
            del at[k]
            if k:
                at[k - 1] = rank(ids[k - 1] << 20 | ids[k], none)
            if k < len(at):
                at[k] = rank(ids[k] << 20 | ids[k + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        rank = self.ranks.get
        before, after = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(len(ids) - 1) if (r := rank(ids[k] << 20 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            best, k, a, b = heapq.heappop(heap)
            n = after[k]
            if ids[k] != a or n < 0 or ids[n] != b:
                continue
            ids[k], ids[n], after[k] = self.made[best], -1, after[n]
            if after[n] >= 0:
                before[after[n]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (r := rank(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic transducer of the words, as one flat block to map into memory.

    Words are added in order; whenever a branch is finished its states are replaced by equal ones met before, so
    suffixes are shared. Arcs carry numbers that add up, along a word, to its place among all, where its ids are.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # open states: final, frozen arcs; the arc to the next open one is implied
    labels: list[int] = []
    order = sorted(words)
    for word in order:
        same = 0
        while same < min(len(word), len(labels)) and word[same] == labels[same]:
            same += 1
        while len(labels) > same:
            done = freeze(path.pop())
            path[-1][1].append((labels.pop(), done))
        for b in word[same:]:
            labels.append(b)
            path.append([False, []])
        path[-1][0] = True
    while labels:
        done = freeze(path.pop())
        path[-1][1].append((labels.pop(), done))
    root = freeze(path.pop())

    below = [0] * len(states)
    first, label, target, skip = [0], bytearray(), [], []
    for k, (final, arcs) in enumerate(states):  # targets are frozen before their sources
        n = int(final)
        for b, to in arcs:
            label.append(b)
            target.append(to)
            skip.append(n)
            n += below[to]
        below[k] = n
        first.append(len(target))
    starts = np.cumsum([0, *(len(words[w]) for w in order)]).astype("<u4")
    ids = np.array([i for w in order for i in words[w]], "<u4")
    final = bytes(int(f) for f, _ in states)
    head = struct.pack("<5I", len(states), len(target), root, len(order), len(ids))
    return b"".join([head, np.array(first, "<u4").tobytes(), np.array(target, "<u4").tobytes(), np.array(skip, "<u4").tobytes(), starts.tobytes(), ids.tobytes(), final, bytes(label)])


BYTES = [bytes((b,)) for b in range(256)]


class Lexicon:
    """A compiled transducer in memory that processes share."""

    def __init__(self, block: bytes | mmap.mmap) -> None:
        n, arcs, self.root, words, ids = struct.unpack_from("<5I", block)
        at, parts = 20, []
        for size in (n + 1, arcs, arcs, words + 1, ids):
            parts.append(memoryview(block)[at : at + 4 * size].cast("I"))
            at += 4 * size
        self.first, self.target, self.skip, self.starts, self.ids = parts
        self.final_at, self.label_at, self.block = at, at + n, block

    def find(self, word: bytes) -> list[int] | None:
        state, place = self.root, 0
        find, labels, first, skip, target = self.block.find, self.label_at, self.first, self.skip, self.target
        for b in word:
            arc = find(BYTES[b], labels + first[state], labels + first[state + 1]) - labels
            if arc < 0:
                return None
            place += skip[arc]
            state = target[arc]
        return self.ids[self.starts[place] : self.starts[place + 1]].tolist() if self.block[self.final_at + state] else None


class Encoder(dict):
    """Word to the bytes of its ids: from memory, else the lexicon, else by merging."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None) -> None:
        import regex

        super().__init__()
        self.before: dict[str, bytes] = {}
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.words = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True)) + ")") if vocabulary.special else None

    def __missing__(self, word: str) -> bytes:
        if (out := self.before.get(word)) is None:
            raw = word.encode()
            ids = self.lexicon.find(raw) if self.lexicon and len(raw) <= LEXICON_LENGTH else None
            out = array("i", self.vocabulary.merge(raw) if ids is None else ids).tobytes()
        if len(word) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[word] = out
        return out

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        parts = self.specials.split(text) if self.specials and any(s in text for s in self.vocabulary.special) else [text]
        get, out = self.__getitem__, []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(struct.pack("<i", self.vocabulary.special[part]))
            else:
                out.append(b"".join(map(get, self.words.findall(part))))
        return b"".join(out)


def decoded(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    return b"".join(map(vocabulary.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS) -> list[str]:
    """Of all texts, the ``most`` words between ASCII blanks that occur most often, at most, in order.

    Tasks count in memory and send their counts on when it is full. The number of words by count, in steps, tells which
    steps are taken whole; of the next one words are taken by their hash, so that what reaches the driver is bounded
    however the counts lie.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flushed() -> Iterator[pa.RecordBatch]:
            rows = [(w, n) for w, n in seen.items() if len(w) < LEXICON_LENGTH]
            seen.clear()
            for k in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows[k : k + 50_000]], pa.binary()).cast(pa.string()), pa.array([n for _, n in rows[k : k + 50_000]], pa.int64())], ["word", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update((text or "").encode().split())
            if len(seen) > 400_000:
                yield from flushed()
        yield from flushed()

    work = Workspace(docs.sparkSession, "bpe")
    counted = pick(docs, "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counted = work.table(counted.select("word", F.floor(F.log2("n") * STEPS).cast("int").alias("step")), "counted")
    least, held, part = None, 0, 0.0
    for step, words in sorted(counted.groupBy("step").count().collect(), reverse=True):  # a row a step: 64 a doubling
        if held + words > most:
            least, part = step, (most - held) / words
            break
        held += words
    whole = F.col("step") > least if least is not None else F.lit(True)
    some = (F.col("step") == (least or 0)) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < math.floor(part * (1 << 20)))
    got = sorted(r[0] for r in counted.where(whole | some if least is not None else whole).select("word").limit(most).collect())
    work.drop("counted")
    return got


def ship_lexicon(spark: SparkSession, block: bytes) -> str:
    """Adds the block to the files Spark copies to every executor, where workers map it into memory; returns its name."""
    name = f"lexicon-{hashlib.sha256(block).hexdigest()[:16]}.bin"
    if not os.path.exists(SparkFiles.get(name)):
        path = os.path.join(driver_folder(), name)
        with open(path, "wb") as f:
            f.write(block)
        spark.sparkContext.addFile(path)
    return name


_encoders: dict[str, Encoder] = {}


def _encoder(name: str, vocabulary: Vocabulary) -> Encoder:
    if name not in _encoders:
        _encoders.clear()
        with open(SparkFiles.get(name), "rb") as f:
            _encoders[name] = Encoder(vocabulary, Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)))
    return _encoders[name]


def _encoded(docs: DataFrame, tokenizer_file: str, lexicon_words: int, back: bool) -> DataFrame:
    """(doc_id, ids) and, if asked for, what they decode to."""
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = Vocabulary(tokenizer_file)
    split = Encoder(vocabulary, None).words.findall
    words = {piece.encode() for w in frequent_words(docs, lexicon_words) for piece in split(f" {w}")}
    name = ship_lexicon(spark, compile_lexicon({w: vocabulary.merge(w) for w in words if len(w) <= LEXICON_LENGTH}))
    sent = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, sent.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            # A few texts at a time: ids and decoded texts go back beside each other.
            for lo in range(0, len(texts), 500):
                found = [np.frombuffer(encoder.encode(t), "<i4") for t in texts[lo : lo + 500]]
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                out = [b.column(0).slice(lo, 500), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).astype(np.int32)))]
                if back:
                    out.append(pa.array([decoded(encoder.vocabulary, x) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names)

    names = ["doc_id", "ids", "decoded"] if back else ["doc_id", "ids"]
    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * back)


def round_trip(docs: DataFrame, tokenizer_file: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """Every row of ``docs`` as (doc_id, ids array<int>, decoded string).

    Whole texts, however long, are encoded as the tokenizers library does without special tokens added; special tokens'
    strings in a text become their ids. Null and empty texts have no ids. The lexicon only saves merging: any choice of
    its words gives the same ids. Ids are decoded by their bytes, special tokens kept. Rows that repeat and null doc_ids
    stay as they are, other columns of ``docs`` do not matter, and an empty table gives an empty one.
    """
    return _encoded(docs, tokenizer_file, lexicon_words, True)


def encode(docs: DataFrame, tokenizer_file: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids array<int>) as of ``round_trip``, without decoding."""
    return _encoded(docs, tokenizer_file, lexicon_words, False)


def decode(rows: DataFrame, tokenizer_file: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids array<int>); null ids are an empty text, bytes that are no UTF-8 become U+FFFD."""
    small_batches(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decoded(sent.value, np.array(x or [], np.int32)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return pick(rows, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")
