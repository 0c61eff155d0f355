"""URL filter: character language-model ratio, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import Workspace, pick

#: (verdict, rule): a rule is a host, and all its subdomains, with the start of a path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

#: The start of a URL is padded with as many of this character as the longest context has.
PAD = "\x02"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, A-Z lower-cased, and path up to ``?`` or ``#``; both empty without ``://`` or url."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"^(?s:.*?)://((?s:.*))$", 1)).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of, _, rest = text.partition("/")
        fits = ((host == of) | F.endswith(host, F.lit(f".{of}"))) & F.startswith(path, F.lit(f"/{rest}"))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def grams(urls: DataFrame, order: int) -> DataFrame:
    """(id, .., gram) of (id, url, ..): each character of the URL with the ``order`` before it; the URL itself stays behind.

    The characters are shifted against each other as whole arrays, which is linear in a URL of any length.
    """
    n = F.size("chars")
    padded = F.concat(F.array_repeat(F.lit(PAD), order), F.col("chars"))
    gram = F.slice(padded, 1, n)
    for k in range(1, order + 1):
        gram = F.zip_with(gram, F.slice(padded, k + 1, n), lambda a, b: F.concat(a, b))
    others = [c for c in urls.columns if c != "url"]
    split = urls.where(F.length("url") > 0).select(*others, F.split("url", "").alias("chars"))
    return split.select(*others, F.explode(gram).alias("gram"))


def model(counted: DataFrame, chars: int, order: int, strength: float) -> DataFrame:
    """(gram, ratio): log P(char | context) of accepted over rejected, from (gram, allow, block) counts of all grams.

    Markov models of every order from 0 to ``order`` are interpolated: a context's own counts weigh against
    ``strength`` draws from the next shorter context, at the bottom from ``chars`` equal characters and one unseen. So a
    context never seen leaves the word to shorter ones. The counts of shorter grams are sums of those of longer ones.
    """
    out = counted.withColumns({f"p_{c}": F.lit(1.0 / (chars + 1)) for c in ("allow", "block")})
    for k in range(order + 1):  # k characters of context
        gram = F.right("gram", F.lit(k + 1))
        sums = counted.groupBy(gram.alias("g")).agg(*[F.sum(c).alias(f"n_{c}") for c in ("allow", "block")])
        whole = counted.groupBy(F.substring("gram", order + 1 - k, k).alias("h")).agg(*[F.sum(c).alias(f"all_{c}") for c in ("allow", "block")])
        out = out.join(sums, gram == F.col("g")).join(whole, F.substring("gram", order + 1 - k, k) == F.col("h"))
        out = out.withColumns({f"p_{c}": (F.col(f"n_{c}") + strength * F.col(f"p_{c}")) / (F.col(f"all_{c}") + strength) for c in ("allow", "block")})
        out = out.drop("g", "h", "n_allow", "n_block", "all_allow", "all_block")
    return out.select("gram", F.log(F.col("p_allow") / F.col("p_block")).alias("ratio"))


def calibrated(scores: DataFrame, limit: float = 4.0, bins: int = 800) -> DataFrame:
    """One row (threshold): of ``bins`` cuts in [-limit, limit], the one with most accepted above plus rejected below.

    The rates of both verdicts count alike. Ties go to the cut nearest 0; without both verdicts it is 0.
    """
    width = 2 * limit / bins
    at = F.least(F.lit(bins), F.greatest(F.lit(0), F.ceil((F.col("score") + limit) / width))).cast("int")
    cuts = scores.sparkSession.range(bins + 1).select(F.col("id").cast("int").alias("bin"))
    held = scores.groupBy(at.alias("bin")).agg(*[F.sum((F.col("verdict") == c).cast("long")).alias(c) for c in ("allow", "block")])
    up = Window.orderBy("bin")  # over the bins only
    counted = cuts.join(held, "bin", "left").fillna(0)
    # A score is at or above the cuts that are below its bin.
    above = F.sum("allow").over(Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1))
    gain = F.coalesce(above, F.lit(0)) / F.greatest(F.sum("allow").over(Window.partitionBy()), F.lit(1)) + F.sum("block").over(up) / F.greatest(F.sum("block").over(Window.partitionBy()), F.lit(1))
    cut = F.col("bin") * width - limit
    both = (F.sum("allow") > 0) & (F.sum("block") > 0)
    return counted.withColumn("gain", gain).agg(F.when(both, F.min_by(cut, F.struct(-F.round("gain", 12), F.abs(cut), cut))).otherwise(0.0).alias("threshold"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, order: int = 4, strength: float = 2.0) -> DataFrame:
    """Every row of ``pages`` as (page_id, host, path, rule, verdict, score).

    URLs that a rule fits get its verdict and teach the two models; three quarters of them, by the hash of the page_id,
    are counted first, and the rest set the threshold that the length-normalised log-likelihood difference must reach.
    The final models count all of them. Null and empty urls score 0. Urls of any length are scored character by
    character in rows, in time linear in it; rows that repeat and null page_ids stay as they are; other columns of
    ``pages`` do not matter; an empty table gives an empty one. Ties in the calibration go to
    the cut nearest 0, and a score at the threshold is accepted.
    """
    spark = pages.sparkSession
    work = Workspace(spark, "urls")
    host, path = host_and_path(F.col("url"))
    rows = pick(pages, "page_id", "url").select("page_id", "url", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules or RULES)
    rows = work.table(rows.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("rule_verdict"), (F.pmod(F.xxhash64("page_id"), F.lit(4)) == 0).alias("held")), "rows")
    urls = rows.where("url is not null").groupBy("url").agg(F.first("rule_verdict").alias("verdict"), F.count("*").alias("n"), F.bool_and("held").alias("held"))
    # Dealt out anew, as few bytes of urls make many rows of characters; from here on a number stands for the url.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = work.table(urls.repartition(parts).withColumn("id", F.monotonically_increasing_id()), "urls")
    seen = grams(urls.select("id", "url", "verdict", "n", "held"), order)
    allow, block = [F.sum(F.when(F.col("verdict") == c, F.col("n")).otherwise(0)) for c in ("allow", "block")]
    first_allow, first_block = [F.sum(F.when((F.col("verdict") == c) & ~F.col("held"), F.col("n")).otherwise(0)) for c in ("allow", "block")]
    counted = work.table(seen.groupBy("gram").agg(allow.alias("allow"), block.alias("block"), first_allow.alias("first_allow"), first_block.alias("first_block")), "counted")
    chars = counted.select(F.countDistinct(F.right("gram", F.lit(1)))).first()[0]
    both = model(counted.select("gram", "allow", "block"), chars, order, strength).join(
        model(counted.select("gram", F.col("first_allow").alias("allow"), F.col("first_block").alias("block")), chars, order, strength).withColumnRenamed("ratio", "first_ratio"), "gram")
    both = work.table(both, "model")
    scores = grams(urls.select("id", "url"), order).join(both, "gram").groupBy("id").agg(F.round(F.avg("ratio"), 9).alias("score"), F.round(F.avg("first_ratio"), 9).alias("first_score"))
    scores = work.table(urls.join(scores, "id", "left").select(F.col("url").alias("of"), "verdict", "held", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("first_score", F.lit(0.0)).alias("first_score")), "scores")
    cut = calibrated(scores.where(F.col("held") & F.col("verdict").isNotNull()).select("verdict", F.col("first_score").alias("score"))).first()[0]
    work.drop("urls", "counted", "model")
    judged = rows.join(scores.select("of", "score"), F.col("url") == F.col("of"), "left")
    score = F.coalesce("score", F.lit(0.0))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(score >= F.lit(cut), "allow").otherwise("block")).alias("verdict"), score.alias("score"))
