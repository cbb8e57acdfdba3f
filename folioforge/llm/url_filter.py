"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees are trained on labelled URLs (a bounded sample, TRAIN_ROWS, in order of a hash) with features that need the
URL alone: lengths, depth, digit ratio, character entropy, counts of parameters, hyphens and dots, and how common
the host's last label and its last two labels are over the whole table.  Everything is DataFrame operations and
the JVM's own tree learner.

Null URLs and those without ``://``: empty host and path, judged by the trees.  With labels of one kind only that kind
is the verdict of all; without labels everything is allowed.  Repeated pages give a row each; an empty table none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, lower_ascii, stored, table

#: Verdict and rule; a rule is a host, and all hosts under it, and the beginning of a path.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
TRAIN_ROWS = 10_000
FEATURES = ["url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "dots", "secure", "fragment", "last_label", "last_two_labels", "hosts_of_two"]
TREES = 12
TREE_DEPTH = 4


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    rest = F.expr(f"CASE WHEN locate('://', {url}) > 0 THEN substring({url}, locate('://', {url}) + 3) ELSE '' END")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def matching_rule(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def lexical_features(pages: DataFrame) -> DataFrame:
    """``pages`` (url, host, path) with FEATURES."""
    url = F.coalesce(F.col("url"), F.lit(""))
    without = lambda x: F.length(url) - F.length(F.replace(url, F.lit(x)))
    labels = F.split("host", r"\.")
    named = pages.withColumn("_last", F.element_at(labels, -1)).withColumn("_two", F.array_join(F.slice(F.concat(F.array(F.lit(""), F.lit("")), labels), -2, 2), "."))
    last = stored(named.groupBy("_last").agg(F.log1p(F.count("*")).alias("last_label")), "last-labels")
    two = stored(named.groupBy("_two", "host").agg(F.count("*").alias("_n")).groupBy("_two").agg(F.log1p(F.sum("_n")).alias("last_two_labels"), F.log1p(F.count("*")).alias("hosts_of_two")), "two-labels")
    named = named.join(broadcast_if_small(last), "_last").join(broadcast_if_small(two), "_two")
    counts = F.expr("transform(array_distinct(split(coalesce(url, ''), '')), c -> length(url) - length(replace(url, c, '')))")
    share = lambda n: n / F.length(url)
    entropy = F.aggregate(F.filter(counts, lambda n: n > 0), F.lit(0.0), lambda a, n: a - share(n) * F.log2(share(n)))
    size = F.length(url)
    values = {
        "url_length": size,
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": F.length("path") - F.length(F.replace("path", F.lit("/"))),
        "digit_ratio": F.when(size > 0, (size - F.length(F.translate(url, "0123456789", ""))) / size),
        "entropy": F.when(size > 0, entropy),
        "parameters": without("&") + F.contains(url, F.lit("?")).cast("int"),
        "hyphens": without("-"),
        "dots": without("."),
        "secure": F.startswith(url, F.lit("https://")).cast("int"),
        "fragment": F.contains(url, F.lit("#")).cast("int"),
        "last_label": F.col("last_label"),
        "last_two_labels": F.col("last_two_labels"),
        "hosts_of_two": F.col("hosts_of_two"),
    }
    return named.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in values.items()}).drop("_last", "_two")


def predict_verdicts(featured: DataFrame, labelled: DataFrame) -> DataFrame:
    """``featured`` with _predicted; ``labelled`` has FEATURES and label (1: block)."""
    sample = stored(labelled.select("label", *FEATURES).orderBy(F.xxhash64("url", "page_id"), "label", *FEATURES).limit(TRAIN_ROWS), "labelled")
    kinds = [r[0] for r in sample.select("label").distinct().collect()]  # two at most
    if len(kinds) < 2:
        return featured.withColumn("_predicted", F.lit("block" if kinds == [1.0] else "allow"))
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    gather = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    learner = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=TREES, maxDepth=TREE_DEPTH, seed=11, checkpointInterval=-1, maxBins=64)
    judged = learner.fit(gather.transform(sample)).transform(gather.transform(featured))
    return judged.withColumn("_predicted", F.when(F.col("prediction") == 1.0, "block").otherwise("allow")).drop("_features", "prediction", "probability", "rawPrediction")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule and verdict of every page.

    ``labelled(page_id, url, label)`` are the URLs to learn from; without it those that a rule decides.
    """
    host, path = host_and_path()
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(rules)
    judged = lexical_features(split).withColumn("rule", rule).withColumn("_fixed", verdict)
    if labelled is None:
        known = judged.filter("_fixed is not null").withColumn("label", (F.col("_fixed") == "block").cast("double"))
    else:
        known = lexical_features(labelled.select("page_id", "url", "label", host.alias("host"), path.alias("path"))).withColumn("label", F.col("label").cast("double"))
    out = predict_verdicts(judged, known)
    return out.select("page_id", "url", "host", "path", "rule", F.coalesce("_fixed", "_predicted").alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
