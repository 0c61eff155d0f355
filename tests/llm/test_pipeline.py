"""The stages against plain versions, each on what it was given."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as p
from keyloom.llm import langid, mixing, simhash
from keyloom.llm.queries import tokenizer_file
from tests.llm import brute


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").cache()
    seen = {}
    given = docs
    for name, stage in p.STAGES:
        out = stage(spark, given, data)
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = (given, spark.read.parquet(f"{tmp_path}/{name}"))
        given = seen[name][1]
        if name != "tokens":
            assert given.columns == docs.columns
            assert given.join(docs, docs.columns, "left_semi").count() == given.count()

    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    pairs = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    was, now = seen["language"]
    told = langid.identify(was, langid.fit(was.where(~langid.held_out())))
    assert ids(now) == ids(told.where("lang_pred <> 'und' and score >= 0.5"))
    assert now.count() > 0.95 * was.count()
    was, now = seen["exact_copies"]
    assert ids(now) == sorted({r[1] for r in brute.exact(pairs(was))})
    was, now = seen["near_copies"]
    want = set(brute.similar(pairs(was))[0].values())
    assert want <= set(ids(now)) and len(set(ids(now)) - want) <= 1
    was, now = seen["source_weights"]
    copies = {r.doc_id: r.copies for r in mixing.mix(was).collect()}
    assert len(ids(now)) == sum(copies.values()) and sorted(now.groupBy("source").count().collect()) == sorted(mixing.mix(was).groupBy("source").agg(F.sum("copies").alias("n")).where("n > 0").collect())
    was, now = seen["tokens"]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in pairs(was)}
    assert ids(now) == ids(was) and all(list(r.ids) == want[r.doc_id] for r in now.collect())


def test_recall_of_near_copies(spark):
    """Of what brute force drops on a larger table, at least nine in ten; and nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = set(brute.similar(rows)[0].values())
    got = {r.doc_id for r in p.near_copies(spark, docs, "").collect()}
    gone = len(rows) - len(want)
    assert want <= got and len(got - want) <= 0.1 * gone and gone > 50


def test_near_copies_of_a_large_group(spark):
    """Of near copies that lie near each other's limit no link is lost, however many meet in one bucket."""
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=7))
    rows = []
    for n_copies in (200, 40, 5):
        base = [word() for _ in range(150)]
        for _ in range(n_copies):
            own = list(base)
            for k in rnd.sample(range(150), rnd.randint(1, 4)):
                own[k] = word()
            rows.append((len(rows), " ".join(own)))
    want, links = brute.similar(rows)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in p.near_copies(spark, docs, "").collect()) == sorted(set(want.values()))
    groups = {r.row: r.group for r in simhash.similar_documents(docs.select(F.col("doc_id").alias("row"), "text")).collect()}
    assert len({(groups[i], want[i]) for i, _ in rows}) == len(set(groups.values())) == len(set(want.values())) < len(rows) and len(links) > 100


def test_run(spark, data):
    got = p.run(spark, data)
    assert got.columns == ["doc_id", "ids"] and got.count() > 100
    assert [name for name, _ in p.STAGES] == ["language", "exact_copies", "near_copies", "source_weights", "tokens"]


EDGES = "doc_id long, text string, lang string, source string, n_chars long, row long, group long, k long"


def edges(spark):
    text = " ".join(f"word{chr(97 + k % 26)}x" for k in range(40))
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (None, text + " ", None, None), (None, None, "en", "a"), (3, "", None, "b"), (4, "½", "en", "b"), (5, "der die das und", "de", None), (5, "and the of to", "en", "b"), (6, "w " * 200_000, "en", "a"), (None, None, None, None)]
    return spark.createDataFrame([(i, t, x, s, len(t or ""), 7, 8, 9) for i, t, x, s in rows], EDGES)


def test_stages_on_edges(spark, tmp_path):
    given = edges(spark)
    seen = {}
    for name, stage in p.STAGES:
        out = stage(spark, given, "")
        out.write.parquet(f"{tmp_path}/{name}")
        again = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = again
        if name != "tokens":
            assert again.columns == p.COLUMNS
            given = again.select("*", F.lit(1).alias("row"), F.lit(2).alias("group"))
    assert all(r.text and any(c.isalpha() for c in r.text) for r in seen["language"].collect())
    assert sorted((r.doc_id or 0) for r in seen["exact_copies"].collect()) in ([0, 5, 5, 6], [0, 5, 6], [0, 5, 5])  # the longest of equal texts has no doc_id
    assert seen["tokens"].count() == seen["source_weights"].count()
    assert p.exact_copies(spark, edges(spark), "").where("text is null or text = ''").count() == 1
    assert p.near_copies(spark, edges(spark), "").where("trim(coalesce(text, '')) = ''").count() == 1


def test_stages_on_an_empty_table(spark, data):
    given = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for name, stage in p.STAGES:
        out = stage(spark, given, "")
        assert out.count() == 0 and (name == "tokens" or out.columns == p.COLUMNS)


def test_language_without_a_labelled_row(spark):
    df = edges(spark).withColumn("lang", F.lit(None).cast("string"))
    assert p.language(spark, df, "").count() == 6
