"""Language identification by word-first backoff."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import Workspace, pick, small_batches

#: A word is a letter and the letters and marks that follow it; digits, fractions and number signs are none.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*+")

#: Orders of the character n-grams, longest first; a word is read with a mark at both ends.
ORDERS = (4, 3, 2, 1)

#: The classifier is fitted on at most so many labelled rows, those of smallest hash.
SAMPLE_ROWS = 20_000
#: Bounds of the model: numbers, a term in a language each, of the words and of each order of n-grams. Only where the
#: sample has more do the rarest terms go, so that a model of many languages fits in a worker's memory.
WORD_CELLS, GRAM_CELLS = 8_000_000, 2_000_000
#: Unseen words that a worker remembers, as numbers again.
REMEMBERED_CELLS = 1_000_000
#: A term that a language lacks counts as this share of its mean frequency in all.
LACKING = 0.01

AT_ONCE = 100_000


def features(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def grams(word: str, k: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + k] for i in range(len(marked) - k + 1)]


def _sent(rows: Counter, names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Counted tuples as rows, the count last."""
    held = list(rows.items())
    rows.clear()
    for k in range(0, len(held), 50_000):
        part = held[k : k + 50_000]
        columns = [*zip(*(x for x, _ in part), strict=True), [n for _, n in part]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*kinds, pa.int64()], strict=True)], [*names, "n"])


def _words(docs: DataFrame) -> DataFrame:
    """(lang, term, n): every word of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(features(text))
            if sum(map(len, seen.values())) > 200_000:
                for lang, words in seen.items():
                    yield from _sent(Counter({(lang, w): n for w, n in words.items()}), ["lang", "term"], [pa.string(), pa.string()])
                seen.clear()
        for lang, words in seen.items():
            yield from _sent(Counter({(lang, w): n for w, n in words.items()}), ["lang", "term"], [pa.string(), pa.string()])

    return docs.select("text", "lang").mapInArrow(run, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


def _grams(words: DataFrame) -> DataFrame:
    """(lang, size, term, n): in how many places of different words of a language each n-gram stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], Counter] = {}
        for b in batches:
            for lang, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k in ORDERS:
                    seen.setdefault((lang, k), Counter()).update(grams(word, k))
            if sum(map(len, seen.values())) > 400_000:
                for key, found in seen.items():
                    yield from _sent(Counter({(*key, g): n for g, n in found.items()}), ["lang", "size", "term"], [pa.string(), pa.int32(), pa.string()])
                seen.clear()
        for key, found in seen.items():
            yield from _sent(Counter({(*key, g): n for g, n in found.items()}), ["lang", "size", "term"], [pa.string(), pa.int32(), pa.string()])

    return words.select("lang", "term").mapInArrow(run, "lang string, size int, term string, n long").groupBy("lang", "size", "term").agg(F.sum("n").alias("n"))


class _Rows(dict):
    """Word to its row in the model's table; a word that is met for the first time is scored and, while there is room, gets one, in one array for all."""

    def __init__(self, model: Model) -> None:
        super().__init__(model.tables[0][0])
        self.model, self.late, self.n_late = model, np.empty((1024, len(model.langs))), 0

    def __missing__(self, word: str) -> int:
        if self.n_late == len(self.late):
            self.late = np.concatenate([self.late, np.empty_like(self.late)])
        self.late[self.n_late] = self.model.unseen(word)
        self[word] = at = self.model.known + self.n_late
        self.n_late += 1
        return at


class Model:
    """Log frequencies of words and of n-grams of each order in each language, as (term to row, rows by language)."""

    def __init__(self, langs: list[str], tables: list[tuple[dict[str, int], np.ndarray]]) -> None:
        self.langs, self.tables = langs, tables
        self.known = len(tables[0][0]) if tables else 0
        self.rows: _Rows | None = None

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "tables": self.tables, "known": self.known, "rows": None}

    def unseen(self, word: str) -> np.ndarray:
        """The mean over the known n-grams of the longest order that has any; zeros if none has."""
        for k, (index, logs) in zip(ORDERS, self.tables[1:], strict=True):
            if found := [at for g in grams(word, k) if (at := index.get(g)) is not None]:
                return logs[found].mean(axis=0, dtype=np.float64)
        return np.zeros(len(self.langs))

    def scores(self, words: list[str]) -> np.ndarray:
        """Mean score a word, by language."""
        if self.rows is None or self.rows.n_late * len(self.langs) > REMEMBERED_CELLS:
            self.rows = _Rows(self)
        total = np.zeros(len(self.langs))
        for lo in range(0, len(words), AT_ONCE):
            at = np.fromiter(map(self.rows.__getitem__, part := words[lo : lo + AT_ONCE]), np.int64, len(part))
            old = at < self.known
            total += self.tables[0][1][at[old]].sum(axis=0, dtype=np.float64)
            if not old.all():
                times = Counter((at[~old] - self.known).tolist())
                total += np.fromiter(times.values(), float, len(times)) @ self.rows.late[list(times)]
        return total / len(words)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = features(text)
        if not words or not self.langs:
            return "und", 0.0
        s = self.scores(words) * min(len(words), 50)
        p = np.exp(s - s.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def log_frequencies(counts: np.ndarray) -> np.ndarray:
    """Of counts by term and language: the log of each share of its language's total and a part of the term's mean share."""
    share = counts / np.maximum(counts.sum(axis=0), 1)
    return np.log(share + LACKING * share.mean(axis=1, keepdims=True)).astype(np.float32)


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of every language in the sample of those rows of ``docs`` whose lang is not null. No such rows: no languages.

    What reaches the driver are the sample's counted terms, at most WORD_CELLS and GRAM_CELLS of them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    labelled = pick(docs, "doc_id", "text", "lang").where("lang is not null").withColumn("h", F.xxhash64("doc_id", F.lit(11)))
    last = labelled.select("h").orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    if last is None:
        return Model([], [])
    work = Workspace(spark, "langid")
    words = work.table(_words(labelled.where(F.col("h") <= last)), "words")
    counted = work.table(words.select("lang", F.lit(0).alias("size"), "term", "n").union(_grams(words.repartition(spark.sparkContext.defaultParallelism))), "counted")
    langs = sorted(r[0] for r in words.select("lang").distinct().collect())
    tables = []
    for size in (0, *ORDERS):
        own = counted.where(F.col("size") == size)
        most = (GRAM_CELLS if size else WORD_CELLS) // max(1, len(langs))
        if own.select("term").distinct().count() > most:
            own = own.join(own.groupBy("term").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "term").limit(most), "term", "left_semi")
        got = own.select("term", "lang", "n").toArrow()
        at, terms = pd.factorize(got["term"].to_pandas(), sort=True)
        counts = np.zeros((len(terms), len(langs)))
        counts[at, np.searchsorted(langs, got["lang"].to_pylist())] = got["n"].to_numpy()
        tables.append((dict(zip(terms.tolist(), range(len(terms)), strict=True)), log_frequencies(counts)))
    work.drop("words", "counted")
    return Model(langs, tables)


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` as (doc_id, lang_pred, score), or with the columns of ``keep``: only the text is judged.

    Texts without a letter, null and empty ones included, are ``und`` with score 0; so are all without a model. Very
    long texts are scored in parts of AT_ONCE words. Ties go to the first language by name. The score is the posterior
    under equal priors of at most 50 words' mean evidence. Rows that repeat are judged alike, other columns of ``docs``
    do not matter, and an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            found = [own.predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*kept, "lang_pred", "score"])

    kept = keep or ["doc_id"]
    own = pick(docs, *dict.fromkeys([*kept, "text"]))
    told = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in kept)
    return own.mapInArrow(run, f"{told}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id", fold: int = 2, folds: int = 4) -> Column:
    """True for the fold that is never learned from; a null doc_id is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))
