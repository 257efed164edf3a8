"""URL filter by association rules, in DataFrame operations only.

A url that a fixed rule fits takes that rule's verdict; these urls are the labels that FP-growth learns from (or labels given
as a table of url and verdict). Each labelled url is a set of tokens: scheme, host labels, host suffix, path words, query
keys. Frequent token sets that come with one verdict become rules: they need a support, a confidence, and more confidence than
any rule of fewer of their tokens for the same verdict. Rules match by an inverted index: each rule is filed under its least
frequent token, urls look up their tokens, and a rule filed there fits if the url has all its tokens. The most confident rule
decides, then the better supported, then the longer, then block; a url that none fits is allowed.

How many rules there are depends on the support asked for and not on the number of urls; they're broadcast only while at most
RULE_ROWS, else shuffled. Defined cases: a null url, or one without ``://``, has an empty host and path and no tokens, so it is
allowed; repeated rows are judged one by one; null ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch, ascii_lower, table

#: The rules of the contract, as host, path and verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.9
RULE_ROWS = 100_000
_LABEL = "verdict="


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"^(?s)(?:(?!://).)*://([^/?#]*)([^?#]*)", i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The set of a url's tokens: parts of the host, of the path without its numbers, and the keys of the query."""
    tagged = lambda tag, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))
    labels = F.split(host, r"\.")
    suffix = F.when(host != "", F.array(F.concat(F.lit("suffix="), F.substring_index(host, ".", -2)))).otherwise(F.array().cast("array<string>"))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    words = F.split(F.regexp_replace(ascii_lower(path), "[0-9]+", ""), "[/._-]+")
    scheme = F.array(ascii_lower(F.substring_index(url, "://", 1)))
    listed = F.concat(tagged("scheme=", scheme), tagged("host=", labels), suffix, tagged("path=", words), tagged("query=", keys))
    return F.when(host != "", F.array_distinct(F.coalesce(listed, F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>"))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """From tokens and verdict: key (the token under which the rule is filed), antecedent, verdict, confidence, support."""
    spark, scratch = labelled.sparkSession, Scratch(labelled.sparkSession)
    labelled = labelled.where("verdict is not null")
    items = scratch.save(labelled.select(F.array_append("tokens", F.concat(F.lit(_LABEL), "verdict")).alias("items")))
    schema = "rule long, antecedent array<string>, verdict string, confidence double, support double, key string"
    if items.isEmpty():
        return spark.createDataFrame([], schema).drop("rule")
    n = items.count()
    model = FPGrowth(itemsCol="items", minSupport=min_support).fit(items)
    sets = scratch.save(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"))
    label = lambda x: x.startswith(_LABEL)
    of = sets.withColumn("labels", F.filter("items", label)).withColumn("antecedent", F.filter("items", lambda x: ~label(x)))
    whole = of.where("size(labels) = 0").select("antecedent", F.col("freq").alias("n_antecedent"))
    # every subset of a frequent set is frequent, so each antecedent has a row, and so have all its parts with the same verdict
    both = of.where("size(labels) = 1 and size(antecedent) > 0").select("antecedent", F.substring(F.col("labels")[0], len(_LABEL) + 1, 1 << 20).alias("verdict"), "freq")
    judged = both.join(whole, "antecedent").select("antecedent", "verdict", (F.col("freq") / F.col("n_antecedent")).alias("confidence"), (F.col("freq") / F.lit(n)).alias("support"), F.size("antecedent").alias("n"))
    rules = scratch.save(_best_of_parts(scratch.save(judged), scratch).where((F.col("confidence") >= min_confidence) & (F.col("confidence") > F.greatest("best", F.lit(0.0)))))
    rules = rules.withColumn("rule", F.xxhash64("antecedent", "verdict"))
    often = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    least = rules.select("rule", F.explode("antecedent").alias("token")).join(often, "token").groupBy("rule").agg(F.min(F.struct("freq", "token")).alias("least"))
    return scratch.finish(rules.join(least, "rule").select("antecedent", "verdict", "confidence", "support", F.col("least.token").alias("key")))


def _best_of_parts(judged: DataFrame, scratch: Scratch) -> DataFrame:
    """Antecedents with ``best``, the greatest confidence of fewer of their tokens for the same verdict (0 of a single token). Level
    by level: an antecedent looks at its parts of one token less, and takes on their best too, so the rows are as many as
    tokens, and no two rules are compared."""
    done, level = None, judged.where("n = 1").withColumn("best", F.lit(0.0))
    for size in range(1, (judged.agg(F.max("n")).first()[0] or 0) + 1):
        level = scratch.save(level)
        done = level if done is None else done.unionByName(level)
        below = level.select(F.col("antecedent").alias("part"), "verdict", F.greatest("confidence", "best").alias("of_part"))
        above = judged.where(F.col("n") == size + 1)
        parts = above.select("antecedent", "verdict", F.explode(F.transform(F.sequence(F.lit(0), F.lit(size)), lambda i: F.filter("antecedent", lambda x, j: j != i))).alias("part"))
        best = parts.join(below, ["part", "verdict"], "left").groupBy("antecedent", "verdict").agg(F.coalesce(F.max("of_part"), F.lit(0.0)).alias("best"))
        level = above.join(best, ["antecedent", "verdict"])
    return level if done is None else done


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, labels: DataFrame | None = None, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, confidence (of the mined rule that decided, else null)."""
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession)

    def cut(df: DataFrame, *keep: Column) -> DataFrame:
        url = F.col(url_col).cast("string")
        host, path = split_url(url)
        df = df.select(*keep, url.alias("url"), host.alias("host"), path.alias("path"))
        return df.select("*", tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), fixed_rule(F.col("host"), F.col("path"), rules).alias("fixed"))

    seen = scratch.save(cut(pages, F.col(id_col).cast("long").alias("page_id"), F.monotonically_increasing_id().alias("row")))
    if labels is None:
        labelled = seen.where("fixed is not null").select("tokens", F.col("fixed.verdict").alias("verdict"))
    else:
        labelled = cut(labels, F.col("verdict")).select("tokens", "verdict")
    mined = mine_rules(labelled, min_support, min_confidence)
    n_rules = mined.count()
    filed = F.broadcast(mined) if n_rules <= RULE_ROWS else mined
    looked_up = seen.where("fixed is null").select("row", "tokens", F.explode("tokens").alias("key")).join(filed, "key")
    fitting = looked_up.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", F.size("antecedent").alias("n"), "verdict"))
    decided = fitting.groupBy("row").agg(best.alias("best")).select("row", "best.verdict", "best.confidence")
    out = seen.select("row", "page_id", "host", "path", "fixed").join(decided, "row", "left")
    verdict = F.coalesce("fixed.verdict", "verdict", F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), "confidence")


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))
