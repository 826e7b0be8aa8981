"""URL filter: longest fitting rule, and for the rest gradient-boosted trees on lexical features.

The trees learn from URLs that a rule decides. Features are length, depth, digit ratio, entropy, parameters, and statistics of the host's last label
(its suffix) over all labelled URLs, kept in a fixed number of hash buckets.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellerlake.llm.common import written

#: Rows the trees are fitted on, at most: those with the smallest hash of their url.
TRAINING_ROWS = 20_000
SUFFIX_BUCKETS = 1024
FEATURES = ["length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "labels", "suffix_block_rate", "suffix_log_count"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), UPPER, LOWER)).otherwise("")


def path(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1)).otherwise("")


def fits(rule: str) -> Column:
    name, slash, rest = rule.partition("/")
    return ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(slash + rest)


def longest(rules: dict[str, str]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, equally long ones in the order of their text; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r), r), reverse=True):
        rule, verdict = F.when(fits(r), r).otherwise(rule), F.when(fits(r), rules[r]).otherwise(verdict)
    return rule, verdict


def count_of(text: Column, *chars: str) -> Column:
    return sum((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in chars), F.lit(0)).cast("double")


def entropy(text: Column) -> Column:
    """Bits a character; 0 for an empty text."""

    def term(total: Column, c: Column) -> Column:
        p = F.coalesce(F.try_divide(F.length(text) - F.length(F.replace(text, c, F.lit(""))), F.length(text)), F.lit(0.0))
        return total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)

    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), term)


def lexical(pages: DataFrame) -> DataFrame:
    """Features of `url` beside `host` and `path`; a null url counts as an empty one."""
    url = F.coalesce("url", F.lit(""))
    return pages.withColumns({
        "length": F.length(url).cast("double"), "host_length": F.length("host").cast("double"), "depth": count_of(F.col("path"), "/"), "digit_ratio": F.coalesce(F.try_divide(F.length(F.regexp_replace(url, "[^0-9]", "")), F.length(url)), F.lit(0.0)),
        "entropy": entropy(url), "parameters": count_of(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "="), "hyphens": count_of(url, "-"), "labels": count_of(F.col("host"), "."),
        "suffix": F.pmod(F.xxhash64(F.element_at(F.split("host", r"\."), -1)), F.lit(SUFFIX_BUCKETS)).cast("int"),
    })


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """Block rate (smoothed) and count of each suffix bucket over all labelled URLs: at most `SUFFIX_BUCKETS` rows."""
    blocked = F.sum(F.when(F.col("verdict") == "block", 1.0).otherwise(0.0))
    return labelled.groupBy("suffix").agg(((blocked + 1) / (F.count("*") + 2)).alias("suffix_block_rate"), F.log1p(F.count("*").cast("double")).alias("suffix_log_count"))


def url_verdicts(pages: DataFrame, rules: dict[str, str], url: str = "url", keep: tuple[str, ...] = ("page_id",), training_rows: int = TRAINING_ROWS, rounds: int = 8, seed: int = 7) -> DataFrame:
    """Kept columns, `host`, `path`, `rule` and `verdict`, a row for each row. Where rules decide no URL all others are allowed; where all their
    verdicts are alike, so are the others."""
    judged = pages.select(*keep, pages[url].alias("url")).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rule, verdict = longest(rules)
    judged = lexical(judged.withColumns({"rule": rule, "verdict": verdict}))
    statistics = written(suffix_statistics(judged.where("verdict is not null")), "suffixes")
    known = judged.join(F.broadcast(statistics), "suffix", "left").fillna({"suffix_block_rate": 0.5, "suffix_log_count": 0.0})
    sample = written(known.where("verdict is not null").select(*FEATURES, (F.col("verdict") == "block").cast("double").alias("label"), F.xxhash64("url").alias("order")).orderBy("order", *FEATURES).limit(training_rows), "urls")
    classes = [r.label for r in sample.select("label").distinct().collect()]
    out = [*keep, "host", "path", "rule"]
    if len(classes) < 2:
        return known.select(*out, F.coalesce("verdict", F.lit("block" if classes == [1.0] else "allow")).alias("verdict"))
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trees = GBTClassifier(maxIter=rounds, maxDepth=3, stepSize=0.3, seed=seed, maxBins=32).fit(assemble.transform(sample.coalesce(2)))
    scored = trees.transform(assemble.transform(known))
    return scored.select(*out, F.coalesce("verdict", F.when(F.col("prediction") == 1, "block").otherwise("allow")).alias("verdict"))
