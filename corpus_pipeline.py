"""A corpus in five stages: language, exact copies, near copies, source weights, tokens.

Every stage takes null and repeated doc_ids, null, empty and very long texts, repeated rows and columns beside those of
documents, which do not reach its result; an empty table gives an empty one. Rows are told apart by their place in the
files that hold them, not by their doc_id.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm import bpe, exact_dedup, langid, mixing, simhash
from keyloom.llm.common import Workspace, few_or_hashed
from keyloom.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Documents whose language is less sure than this, or that have no letter, go.
LEAST_SCORE = 0.5

#: Files of one input that are numbered in a table sent to all executors; an input of more is written anew.
MOST_FILES = 100_000
#: Bits of a row's number that are its place in its file.
PLACE_BITS = 40


def _numbered(work: Workspace, docs: DataFrame) -> DataFrame:
    """The stage's input with a number ``row`` of its own for each row, the same whenever it is read.

    It is the number of the row's file and its place there, so nothing is written but the names of the files. What is no
    table of Parquet files is written first, with numbers given once.
    """
    try:
        files = work.table(docs.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").isNull().alias("odd")).distinct(), "files")
        n, odd = files.agg(F.count("*"), F.coalesce(F.bool_or("odd"), F.lit(False))).first()
    except AnalysisException:
        n, odd = MOST_FILES + 1, True
    if odd or n > MOST_FILES:
        return work.table(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "numbered")
    files = work.table(files.select("path", F.row_number().over(Window.orderBy("path")).cast("long").alias("file")), "numbers")  # a row a file
    placed = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("place"))
    row = F.shiftleft(F.col("file"), PLACE_BITS).bitwiseOR(F.col("place"))
    return placed.join(F.broadcast(files), "path").select(*COLUMNS, row.alias("row"))


def _keep(work: Workspace, rows: DataFrame, groups: DataFrame, *first: Column) -> DataFrame:
    """One row of each group of ``groups``, (row, group): by ``first``, then the smallest doc_id, null last, then the first of equal rows."""
    place = F.struct(*first, F.col("doc_id").isNull().alias("none"), "doc_id", F.col("row").alias("at"))
    placed = work.table(rows.select("row", place.alias("place")).join(groups, "row"), "placed")
    best = work.table(placed.groupBy("group").agg(F.min("place").alias("best")).select(F.col("group").alias("of"), F.col("best.at").alias("kept")), "best")
    gone = work.table(placed.join(best, F.col("group") == F.col("of")).where("row <> kept").select(F.col("row").alias("gone")), "gone")
    work.drop("placed", "best")
    return rows.join(few_or_hashed(gone, gone.count()), F.col("row") == F.col("gone"), "left_anti").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6, fitted on the labelled rows: documents without a sure language go; lang is left as it is. Without a labelled row nothing can be told, and all documents with a letter stay."""
    model = langid.fit(docs.where(~langid.held_out()))
    if not model.langs:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")).select(*COLUMNS)
    found = langid.identify(docs, model, keep=COLUMNS)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of equal texts one row stays, the longest, with or without a doc_id. Null counts as empty."""
    work = Workspace(spark, "stage-exact")
    rows = _numbered(work, docs)
    found = exact_dedup.exact_duplicates(rows.select(F.col("row").alias("doc_id"), "text"))
    return _keep(work, rows, found.select(F.col("doc_id").alias("row"), F.col("keep_id").alias("group")), (-F.coalesce(F.char_length("text"), F.lit(0))).alias("n"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3 on shingles of five words: of documents that links of a similarity of 0.8 or more connect the one of smallest doc_id stays. Null and blank texts are one group."""
    work = Workspace(spark, "stage-near")
    rows = _numbered(work, docs)
    return _keep(work, rows, simhash.similar_documents(rows, words=5))


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: every row as often as the mix takes it; documents without a word stay once."""
    work = Workspace(spark, "stage-mix")
    rows = _numbered(work, docs)
    copies = work.table(mixing.mix(rows, keep=("row",)).where("copies > 0").select(F.col("row").alias("of"), "copies"), "copies")
    taken = rows.join(few_or_hashed(copies, copies.count()), F.col("row") == F.col("of"))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: (doc_id, ids) of every copy; no ids for null and empty texts."""
    return bpe.encode(docs, tokenizer_file())


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("source_weights", source_weights), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each one's rows are written to the shared folder and read again as the next one's."""
    work = Workspace(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir), name)
        if before:
            work.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)


#: Two stages fit models or round by hashes that SQL doesn't have; the tests hold run() against a brute-force version.
ORACLE_SQL = None
