"""Personal data: base patterns and information-theoretic sanitisation, in DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import Workspace, pick

#: The base kinds in order. Possessive repeats and look-behinds find the same leftmost matches without
#: backtracking over long runs; \G lets a match begin where the last one ended. A run of fewer digits than a card has is
#: none from any start.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: A term is a word of letters that no digit touches, so that terms share no character with numbers.
TERM = r"(?<![\p{L}\p{M}\p{N}])\p{L}[\p{L}\p{M}]*+(?!\p{N})"
#: A text without this holds no entity.
MAYBE = r"@|\+[0-9]|[0-9]\.[0-9]++\.[0-9]++\.[0-9]|[0-9](?:[\x20-]?[0-9]){13}"
#: The class of all entities, whatever their kind.
ANY = "any"

#: A term is disclosed if it tells this share of an entity's information. For a value it must stand in so many different
#: texts that hold it; for a class it must meet it so often that chance would do so for this many terms of the corpus.
THRESHOLD, SUPPORT, CHANCE = 0.5, 3, 0.1

CHUNK = 256
#: Terms, words of some ten characters, that may be sent to all tasks.
MOST_TERMS = 200_000


def located(text: Column, pattern: str, offset: Column | int = 0) -> Column:
    """array<struct<start, end, text>>: the leftmost non-overlapping matches in code points.

    Lengths of matches and of what lies between add up, in chunks, so that a text of very many matches stays near
    linear.
    """
    offset = F.lit(offset) if isinstance(offset, int) else offset
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    items = F.zip_with(matches, gaps, lambda m, g: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("len"), m.alias("m")))

    def once(value: Column, f: Callable[[Column], Column]) -> Column:
        """``f`` of a value that is computed once, however often ``f`` names it."""
        return F.element_at(F.transform(F.array(value), f), 1)

    def cut(items: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), ((F.size(items) - 1) / CHUNK).cast("int")), lambda c: F.slice(items, c * CHUNK + 1, F.lit(CHUNK)))

    def starts(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["gap"] + x["len"]))
        return F.aggregate(sums, F.array(offset.cast("int")), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)))

    def place(chunk: Column, base: Column) -> Column:
        start = F.struct(base.alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)").alias("out"))
        step = lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["len"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["len"]).alias("end"), x["m"].alias("text")))).alias("out"),
        )
        return F.aggregate(chunk, start, step, lambda acc: acc["out"])

    def spread(chunks: Column) -> Column:
        return F.flatten(F.zip_with(chunks, F.slice(starts(chunks), 1, F.size(chunks)), place))

    # The last gap has no match beside it; without a match nothing is left.
    kept = once(F.filter(items, lambda x: x["m"].isNotNull()), lambda it: F.when(F.size(it) > 0, once(cut(it), spread)))
    return F.coalesce(kept, F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)"))


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.ltrim(p, F.lit("0"))).otherwise("999").try_cast("int"), F.lit(0)) <= 255)
    if kind == "card":
        n = F.length(digits)
        doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        luhn = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, k: a + F.when((n - k) % 2 == 1, doubled(F.substring(digits, k, F.lit(1)).cast("int"))).otherwise(F.substring(digits, k, F.lit(1)).cast("int")))
        return F.when((n >= 14) & (n <= 19), luhn % 10 == 0).otherwise(False)
    if kind == "phone":
        return (F.length(digits) >= 10) & (F.length(digits) <= 15)
    return F.lit(True)


def _kept(spans: Column, k: int, kind: str) -> Column:
    kept = F.filter(spans, lambda s: valid(kind, s["text"]))
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["text"].alias("text")))


def base_spans(text: Column) -> Column:
    """array<struct<start, k, end, kind, text>> by start, then kind as listed."""
    found = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        spans = located(F.when(F.contains(text, F.lit(NEEDS[kind])), text).otherwise("") if NEEDS[kind] else text, pattern)
        found.append(_kept(spans, k, kind))
    return F.array_sort(F.concat(*found))


def entity_of(span: Column) -> Column:
    """The span's kind and what it names: addresses in lower case, numbers as their digits."""
    return F.concat(span["kind"], F.lit(":"), F.lower(F.when(span["kind"].isin("email", "ip"), span["text"]).otherwise(F.regexp_replace(span["text"], "[^0-9]", ""))))


def term_places(text: Column) -> Column:
    """array<struct<start, end, text>>: the terms between emails, which alone of all base kinds hold letters, lower-cased."""
    emails = located(F.when(F.contains(text, F.lit("@")), text).otherwise(""), KINDS["email"])
    gaps = F.when(F.contains(text, F.lit("@")), F.split(text, KINDS["email"], -1)).otherwise(F.array(text))
    starts = F.concat(F.array(F.lit(0)), F.transform(emails, lambda e: e["end"]))
    return F.flatten(F.zip_with(gaps, starts, lambda gap, at: F.transform(located(gap, TERM, at), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lower(t["text"]).alias("term")))))


def told(both: Column, of_entity: Column, of_term: Column, n: float) -> Column:
    """The share of an entity's information that a term tells: their pointwise mutual information over it."""
    return F.log(both * n / (of_entity * of_term)) / F.greatest(F.log(n / of_entity), F.lit(1e-9))


def surprise(both: Column, expected: Column) -> Column:
    """By Chernoff's bound, how unlikely so many meetings are by chance, as a negative logarithm."""
    return F.when(both > expected, both * F.log(both / expected) - both + expected).otherwise(0.0)


def plain_counts(plain: DataFrame, asked: DataFrame, n_asked: int) -> DataFrame:
    """(term, n_plain): in how many different texts of ``plain``, (text, part), the ``n_asked`` terms of ``asked`` stand.

    Each of n copies is a part of 1 / n, which sums to whole numbers but for the rounding. Few terms are sent to all
    tasks, which then count no others; many meet the counts of all terms, after these are summed in each task.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))
    met = plain.select("part", F.explode(words).alias("term"))
    if n_asked <= MOST_TERMS:
        met = met.join(F.broadcast(asked), "term", "left_semi")
    counted = met.groupBy("term").agg(F.round(F.sum("part")).cast("long").alias("n_plain"))
    return counted if n_asked <= MOST_TERMS else counted.join(asked, "term", "left_semi")


def disclosing_terms(work: Workspace, held: DataFrame, words: DataFrame, plain: DataFrame, n_plain: int, threshold: float, support: int) -> DataFrame:
    """(entity, term) of the terms that disclose an entity: a class, by its kind or ANY, or a value, ``kind:value``.

    ``held`` has a row a text with entities, (h, kinds, entities, record), ``words`` one a text and term, (h, term), and
    ``plain`` the texts without, (text, part). For values all four numbers count different texts. For classes they count
    records, which are different texts without entities, and different sets of entities: texts that tell of the same are
    one, so that near copies of one text prove nothing. Both times the term must tell ``threshold`` of the entity.
    """
    n_texts, n_records = held.agg(F.count("*"), F.countDistinct("record")).first()
    kinds = [*KINDS, ANY]
    in_class = [F.max(F.array_contains("kinds", k).cast("int")).alias(k) for k in kinds]
    of_class = work.table(held.groupBy("record").agg(*in_class), "records").agg(*[F.sum(k).alias(k) for k in kinds]).first().asDict()
    rows = words.join(held.select("h", "record", "kinds"), "h").groupBy("term", "record").agg(F.count("*").alias("texts"), *in_class)
    terms = work.table(rows.groupBy("term").agg(F.sum("texts").alias("n_texts"), F.count("*").alias("n_records"), *[F.sum(k).alias(k) for k in kinds]), "terms")
    n_terms = terms.count()
    limit = math.log(max(1, n_terms) * len(kinds) / CHANCE)
    n, every = float(n_plain + n_records), float(n_plain + n_texts)

    # Values that enough texts hold, and the terms that stand in enough of them.
    often = held.select("h", F.explode("entities").alias("entity")).distinct()
    often = work.table(often.join(often.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= support), "entity"), "often")
    most = often.agg(F.max("n_entity")).first()[0]
    rare = (F.col("n_texts") >= support) & (F.col("n_texts") <= every * (most / every) ** threshold * (1 + 1e-6)) if most else F.lit(False)

    # Counted in all other texts are only terms that could pass if none had them.
    could = rare
    for k in kinds:
        if of_class[k]:
            best = (told(F.col(k), F.lit(of_class[k]), F.col("n_records"), n) >= threshold) & (surprise(F.col(k), F.col("n_records") * (of_class[k] / n)) >= limit)
            could = could | best
    asked = work.table(terms.where(could).withColumn("id", F.lit(1)), "asked")
    counted = asked.join(plain_counts(plain, asked.select("term"), asked.count()), "term", "left").withColumn("n_plain", F.coalesce("n_plain", F.lit(0)))
    counted = work.table(counted.withColumn("all_texts", F.col("n_texts") + F.col("n_plain")).withColumn("all_records", F.col("n_records") + F.col("n_plain")), "counted")

    tells = [F.when((F.col(k) > 0) & (told(F.col(k), F.lit(of_class[k]), F.col("all_records"), n) >= threshold) & (surprise(F.col(k), F.col("all_records") * (of_class[k] / n)) >= limit), F.lit(k)) for k in kinds if of_class[k]]
    classes = counted.select(F.explode(F.array_compact(F.array(*tells))).alias("entity"), "term") if tells else counted.select(F.lit("").alias("entity"), "term").limit(0)
    if most is None:
        return classes
    within = F.col("all_texts") <= every * F.pow(F.col("n_entity") / every, F.lit(float(threshold))) * (1 + 1e-6)
    few = counted.where(rare & (F.col("all_texts") <= every * (most / every) ** threshold * (1 + 1e-6))).select("term", "all_texts")
    pairs = often.join(words.join(few, "term"), "h").where(within).groupBy("entity", "term", "n_entity", "all_texts").agg(F.count("*").alias("both")).where(F.col("both") >= support)
    return classes.union(pairs.where(told(F.col("both"), F.col("n_entity"), F.col("all_texts"), every) >= threshold).select("entity", "term"))


def find_personal_data(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """Every row of ``docs`` as (doc_id, base, terms): arrays of struct<start, end, kind>, in code points, end exclusive.

    ``base`` are the four patterns' valid matches by start, then kind as listed; ``terms`` are all places of the words
    that disclose an entity the text holds, a value of it or its class, anywhere in it, by start, outside all base spans.
    Texts without base spans have no terms. Null and empty texts have neither, long ones are read whole; rows that
    repeat are documents of their own, though copies of a text are evidence but once; null doc_ids stay null; other
    columns of ``docs`` do not matter; an empty table gives an empty one.
    """
    work = Workspace(docs.sparkSession, "pii")
    texts = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("h", F.xxhash64("text"))
    found = texts.select("doc_id", "text", "h", base_spans(F.col("text")).alias("base"))
    holds = F.size("base") > 0
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    kept = found.select("doc_id", "h", plain.alias("base"), F.when(holds, F.array_sort(F.array_distinct(F.transform("base", entity_of)))).alias("entities"), F.when(holds, F.col("text")).alias("text"))
    found = work.table(kept, "found")
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:string>>)")

    sizes = work.table(found.groupBy("h").agg(F.count("*").alias("n"), F.bool_or(F.col("entities").isNotNull()).alias("holds")), "sizes")
    n_held, n_plain = sizes.agg(F.count_if("holds"), F.count_if(~F.col("holds"))).first()
    if not n_held:
        return found.select("doc_id", "base", none.alias("terms"))
    kinds = F.concat(F.array_distinct(F.transform("entities", lambda e: F.substring_index(e, ":", 1))), F.array(F.lit(ANY)))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a few texts make many rows of terms
    held = found.where("entities is not null").dropDuplicates(["h"]).repartition(parts)
    held = work.table(held.select("h", "entities", kinds.alias("kinds"), F.xxhash64("entities").alias("record"), term_places(F.col("text")).alias("places")), "held")
    words = work.table(held.select("h", F.explode(F.array_distinct(F.transform("places", lambda t: t["term"]))).alias("term")), "words")
    copied = work.table(sizes.where("n > 1 and not holds").select(F.col("h").alias("of"), (1.0 / F.col("n")).alias("share")), "copied")
    # Only texts that the pattern leaves open are held against those with entities.
    maybe = F.col("text").rlike(MAYBE)
    others = texts.where(~maybe).select("h", "text").union(texts.where(maybe).join(sizes.where("holds").select("h"), "h", "left_anti").select("h", "text"))
    others = others.join(copied, F.col("h") == F.col("of"), "left").select("text", F.coalesce("share", F.lit(1.0)).alias("part"))
    told_by = work.table(disclosing_terms(work, held.drop("places"), words, others, n_plain, threshold, support), "told")

    # Each text's own disclosing terms, then their places.
    names = F.concat("kinds", "entities")
    marked = held.select("h", F.explode(names).alias("entity")).join(told_by, "entity").groupBy("h").agg(F.collect_set("term").alias("marked"))
    spans = held.join(marked, "h").select(F.col("h").alias("of"), F.transform(F.filter("places", lambda t: F.array_contains("marked", t["term"])), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit("term").alias("kind"))).alias("terms"))
    spans = work.table(spans, "terms")
    work.drop("words", "held", "sizes")
    return found.join(spans, F.col("h") == F.col("of"), "left").select("doc_id", "base", F.coalesce("terms", none).alias("terms"))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def in_order(spans: Column) -> Column:
    """By start, then kind as listed, terms last."""
    place = F.create_map(*[x for k, kind in enumerate([*KINDS, "term"]) for x in (F.lit(kind), F.lit(k))])
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("k"), s["end"].alias("end"), s["kind"].alias("kind"))))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, base: Column, terms: Column) -> Column:
    """The text with base spans generalised to their kind, as ``[EMAIL]``, and terms removed as ``[TERM]``; of overlapping spans the first to begin stays."""
    every = F.array_sort(F.concat(base, terms))
    clear = F.filter(every, lambda s: ~F.exists(every, lambda o: (o < s) & (o["end"] > s["start"])))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    step = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out"))
    return F.aggregate(clear, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))))
