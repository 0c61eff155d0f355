"""The operators as queries over the whole tables, and their SQL where it can say the same.

Each query gives one row for each row of its table, whatever that holds: nulls in any column, empty and very long texts,
repeated rows, columns beside those it reads, or no row at all. What it gives for them is what the operator's docstring
says; digests are of the operator's texts and spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import bpe, embed_dedup, exact_dedup, langid, line_dedup, mixing, pii, simhash, substring, url_filter


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.drop_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.identify(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file())
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    n = [pii.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    every = pii.in_order(F.concat("base", "terms"))
    return found.select("doc_id", *n, F.sha2(pii.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.span_text(every).alias("spans"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_near_dedup, op2_url_filter, op3_simhash_near_dedup, op4_source_mixing, op5_substring_dedup, op6_language_id, op7_bpe, op8_exact_dedup, op9_personal_data, op10_line_dedup)}


#: Blanks as DuckDB's regular expressions name them.
_BLANK = r"[\x20\x09-\x0D]"


def oracle_sql() -> dict[str, str]:
    return {
        # Every pair of vectors: for tables as small as those it is run on.
        "op1_embedding_near_dedup": """
            WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
            g AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
            l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.95),
            r AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
            n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
            SELECT v.vec_id, coalesce(n.n, 0) AS n_links, min(r.root) AS component_id, v.vec_id = min(r.root) AS kept
            FROM v JOIN r ON r.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id GROUP BY v.vec_id, n.n""",
        "op8_exact_dedup": rf"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '{_BLANK}', '', 'g') AS norm FROM documents)
            SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
                   doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
            FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)""",
        "op10_line_dedup": rf"""
            WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
            l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
            k AS (SELECT doc_id, line, pos, translate(regexp_replace(line, '^{_BLANK}+|{_BLANK}+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
            r AS (SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
            s AS (SELECT k.doc_id, line, pos, coalesce(r.last_id <> k.doc_id, false) AS lost FROM k LEFT JOIN r USING (key))
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
            FROM s GROUP BY doc_id""",
        "op5_substring_dedup": rf"""
            WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}+'), lambda x: x <> '') AS ws FROM documents),
            p AS (SELECT doc_id, ws, unnest(range(len(ws) - 12)) AS i FROM d WHERE len(ws) >= 13),
            w AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 13], ' ') AS gram FROM p),
            m AS (SELECT gram, min(doc_id) AS opened FROM w GROUP BY gram HAVING count(DISTINCT doc_id) > 1),
            c AS (SELECT DISTINCT w.doc_id, i + o AS pos FROM w JOIN m USING (gram), range(13) r(o) WHERE w.doc_id > opened),
            g AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id),
            k AS (SELECT d.doc_id, len(ws) AS n, coalesce(len(gone), 0) AS n_gone, list_filter(ws, lambda x, j: NOT list_contains(coalesce(gone, []), j - 1)) AS kept FROM d LEFT JOIN g USING (doc_id))
            SELECT doc_id, n AS n_words, n_gone AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k""",
    }
