"""URL verdicts: explicit rules, and gradient-boosted trees on lexical features for all others (DataFrame operations only).

The trees are trained here, on labelled URLs: those that a rule decides, each once, at most TRAIN_ROWS of them by the hash
of the URL, of which either verdict has half if it needs them. Features are lengths, depth, digit ratio, character entropy,
counts of parameters, labels and hyphens, and suffix statistics: the smoothed share of blocked URLs among training URLs
with the same last label of the host, and with the same last two. A training URL has the shares of the other folds only, as
its own label must not reach its features.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.tables import ascii_lower, held, let_go, passed_through, stored

#: The bound of the training sample.
TRAIN_ROWS = 5_000
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
FEATURES = ("url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "host_labels", "hyphens", "suffix_share", "domain_share")
FOLDS = 5


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 2)


def rule_column(rules: list[tuple[str, str]], at: Column, way: Column, what: int) -> Column:
    """For the longest rule that fits host and path: its verdict (what 0) or its text (what 1); null if none fits."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, start = rule[1].partition("/")
        fits = ((at == name) | at.endswith(f".{name}")) & way.startswith(f"/{start}")
        out = F.when(fits, F.lit(rule[what])).otherwise(out)
    return out


def _count(c: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(c, f"[^{pattern}]", "")).cast("double")


def _entropy(c: Column) -> Column:
    """Bits per character."""
    n = F.char_length(c)
    share = lambda x: (n - F.char_length(F.replace(c, x, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(c, "")), F.lit(0.0), lambda acc, x: acc - F.when((x == "") | (share(x) <= 0), 0.0).otherwise(share(x) * F.log2(share(x))))


def _suffix(at: Column, labels: int) -> Column:
    """The last labels of the host."""
    return F.substring_index(at, ".", -labels)


def with_features(df: DataFrame, url: str, host_col: str, path_col: str) -> DataFrame:
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    return df.withColumns({
        "url_length": F.char_length(u).cast("double"), "host_length": F.char_length(host_col).cast("double"), "path_length": F.char_length(path_col).cast("double"),
        "depth": _count(F.col(path_col), "/"), "digit_ratio": _count(u, "0-9") / F.greatest(F.char_length(u), F.lit(1)), "entropy": F.when(F.char_length(u) > 0, _entropy(u)).otherwise(0.0),
        "parameters": _count(u, "&?"), "host_labels": _count(F.col(host_col), "."), "hyphens": _count(F.col(host_col), r"\-"), "suffix": _suffix(F.col(host_col), 1), "domain": _suffix(F.col(host_col), 2),
    })


def _share(blocked: Column, n: Column, mean: Column | float) -> Column:
    """Smoothed by two URLs of the mean."""
    return (F.coalesce(blocked, F.lit(0.0)) + 2 * mean) / (F.coalesce(n, F.lit(0)) + 2)


def with_shares(df: DataFrame, sample: DataFrame, mean: float, other_folds: bool = False) -> DataFrame:
    """Adds suffix_share and domain_share by the labelled URLs of sample; with other_folds (df has a fold) without those of the
    row's own fold. A table of shares has a row for each suffix of the sample, so no more than the sample, and is broadcast."""
    for key, name in (("suffix", "suffix_share"), ("domain", "domain_share")):
        whole = stored(sample.groupBy(key).agg(F.sum("label").alias("_b"), F.count("*").alias("_n")), "shares")
        df = df.join(F.broadcast(whole), key, "left")
        blocked, n = F.col("_b"), F.col("_n")
        if other_folds:
            own = stored(sample.groupBy(key, "fold").agg(F.sum("label").alias("_fb"), F.count("*").alias("_fn")), "shares")
            df = df.join(F.broadcast(own), [key, "fold"], "left")
            blocked, n = blocked - F.coalesce("_fb", F.lit(0.0)), n - F.coalesce("_fn", F.lit(0))
        df = df.withColumn(name, _share(blocked, n, F.lit(mean))).drop("_b", "_n", "_fb", "_fn")
    return df


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", columns: tuple[str, ...] = ("page_id",), train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The named columns of every row, with host, path, rule (text of the longest rule that fits, else null) and verdict.

    rules are (verdict, text) pairs: host, slash and start of the path; a rule fits its host and all subdomains. A null
    URL, or one without ://, has an empty host and path. Without training URLs of both verdicts, all others get the only
    verdict there is, or allow. Long URLs are judged whole and repeated rows alike; an empty table gives an empty result. An
    input column with the name of a result gives way to it; others that are not asked for are ignored.
    """
    columns = passed_through(pages, columns, ("host", "path", "rule", "verdict"))
    url = F.col(url_col).cast("string")
    rows = pages.select(held(columns), url.alias("_url"), host(url).alias("_host"), path(url).alias("_path"))
    rows = rows.withColumns({"_rule": rule_column(rules, F.col("_host"), F.col("_path"), 1), "_by_rule": rule_column(rules, F.col("_host"), F.col("_path"), 0)})
    sample, counts = training_urls(rows, train_rows)
    result = [*let_go(columns), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule")]
    if len(counts) < 2:
        rest = "block" if set(counts) == {1.0} else "allow"
        return rows.select(*result, F.coalesce("_by_rule", F.lit(rest)).alias("verdict"))
    mean = counts[1.0] / (counts[0.0] + counts[1.0])
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    model = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.3, seed=1, featuresCol="features", labelCol="label").fit(vector.transform(with_shares(sample, sample, mean, other_folds=True)))
    scored = model.transform(vector.transform(with_shares(with_features(rows, "_url", "_host", "_path"), sample, mean)))
    return scored.select(*result, F.coalesce("_by_rule", F.when(F.col("prediction") == 1, "block").otherwise("allow")).alias("verdict"))


def training_urls(rows: DataFrame, train_rows: int) -> tuple[DataFrame, dict[float, int]]:
    """Distinct URLs that a rule decides, with label (1: block), fold and features, train_rows at most; and how many have each label."""
    distinct = rows.where(F.col("_by_rule").isNotNull()).select("_url", "_host", "_path", (F.col("_by_rule") == "block").cast("double").alias("label")).distinct()
    first = lambda df, verdict, n: df.where(F.col("label") == verdict).orderBy(F.xxhash64("_url"), "_url").limit(n)
    near = stored(first(distinct, 0, train_rows).unionByName(first(distinct, 1, train_rows)), "urls")
    there = {r.label: r.n for r in near.groupBy("label").agg(F.count("*").alias("n")).collect()}
    most = {own: min(there.get(own, 0), max(train_rows // 2, train_rows - there.get(1.0 - own, 0))) for own in (0.0, 1.0)}
    parts = first(near, 0.0, most[0.0]).unionByName(first(near, 1.0, most[1.0]))
    sample = with_features(parts.withColumn("fold", F.pmod(F.xxhash64("_url", F.lit("fold")), F.lit(FOLDS))), "_url", "_host", "_path")
    return stored(sample, "urls"), {label: n for label, n in most.items() if n}
