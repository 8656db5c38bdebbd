"""URL filtering: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from the URLs that the rules (or a label column) decide. Everything is DataFrame expressions and
Spark's own tree ensemble; nothing runs in Python on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.common import hash60, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["url_len", "host_len", "path_len", "depth", "labels", "digit_ratio", "entropy", "params", "query_len", "hyphens", "secure", "segment_rate", "suffix_rate"]
#: The trees learn from at most so many labelled URLs of each verdict, those with the least hashes.
MOST_PER_LABEL = 20_000
FOLDS = 5


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; then path up to '?' or '#'."""
    rest = F.when(F.contains(url, F.lit("://")), F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matched(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(verdict, rule), or null. rules: (verdict, 'host/path')."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        at = rule.index("/")
        name, start = rule[:at], rule[at:]
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        hit = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def lexical(df: DataFrame) -> DataFrame:
    """Adds the lexical features of _url, host and path, all doubles, and the keys of the rate features."""
    url, n = F.col("_url"), F.greatest(F.length("_url"), F.lit(1)).cast("double")
    count = lambda c, what: F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    share = lambda c: count(url, c).cast("double") / n
    chars = F.array_distinct(F.split(url, ""))
    kinds = F.transform(F.filter(chars, lambda c: c != ""), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))).cast("double") / n)
    return df.withColumns({
        "url_len": F.length(url).cast("double"),
        "host_len": F.length("host").cast("double"),
        "path_len": F.length("path").cast("double"),
        "depth": count(F.col("path"), "/").cast("double"),
        "labels": (count(F.col("host"), ".") + 1).cast("double"),
        "digit_ratio": (F.length(url) - F.length(F.translate(url, "0123456789", ""))).cast("double") / n,
        "entropy": F.aggregate(kinds, F.lit(0.0), lambda a, p: a - p * F.log2(p)),
        "params": F.when(query == "", F.lit(0.0)).otherwise((count(query, "&") + 1).cast("double")),
        "query_len": F.length(query).cast("double"),
        "hyphens": share("-"),
        "secure": F.startswith(url, F.lit("https")).cast("double"),
        "_suffix": F.substring_index("host", ".", -1),
        "_segment": F.concat_ws("/", F.substring_index("host", ".", -1), F.regexp_extract("path", r"^/([^/]*)", 1)),
    })


def rates(train: DataFrame, keys: list[str], out: str, overall: float, weight: float = 5.0) -> DataFrame:
    """Smoothed share of blocked URLs for each value of keys in the (bounded) training rows."""
    return train.groupBy(*keys).agg(((F.sum("label") + F.lit(weight * overall)) / (F.count("*") + F.lit(weight))).alias(out))


def fit(labelled: DataFrame, most_per_label: int = MOST_PER_LABEL, trees: int = 12, depth: int = 4):
    """Fits the trees on labelled (of lexical(), with label 0.0 or 1.0). Returns (score, threshold) for judge().

    At most most_per_label distinct URLs of each label are used, those with the least hashes. With one label only, or
    none, there is nothing to learn: the verdict is then that label's, or 'allow'. A training URL's suffix and segment
    rates are counted over the other folds of the training URLs, so that its own label is no part of its features.
    """
    keyed = labelled.withColumn("_h", hash60(F.col("_url")))
    sizes = {r["label"]: r["count"] for r in keyed.groupBy("label").count().collect()}  # two labels

    def least(label: float) -> DataFrame:
        # Rows beyond about twice the bound go before anything is shuffled; copies may leave fewer than the bound.
        share = min(1.0, 2.0 * most_per_label / max(1, sizes.get(label, 0)))
        return keyed.where((F.col("label") == label) & (F.col("_h") < 2.0**60 * share)).dropDuplicates(["_url"]).orderBy("_h", "_url").limit(most_per_label)

    both = [least(v) for v in (0.0, 1.0)]
    train = written(both[0].unionByName(both[1]).coalesce(1), "urls")
    n, blocked = train.agg(F.count("*"), F.sum("label")).first()
    if not n or blocked in (0.0, float(n)):
        always = 1.0 if n and blocked else 0.0
        return lambda df: df.withColumn("block_score", F.lit(always))
    overall = blocked / n
    of = {"suffix_rate": "_suffix", "segment_rate": "_segment"}
    whole = {name: ([key], written(rates(train, [key], name, overall).coalesce(1), name)) for name, key in of.items()}
    # A row for each training row and other fold: what is counted for a fold leaves its own rows out.
    others = train.withColumn("_f", F.explode(F.array(*[F.lit(f) for f in range(FOLDS)]))).where(F.col("_f") != F.pmod(F.col("_h"), F.lit(FOLDS))).withColumn("_fold", F.col("_f").cast("bigint"))
    apart = {name: (["_fold", key], rates(others, ["_fold", key], name, overall)) for name, key in of.items()}

    def prepared(df: DataFrame, of: dict) -> DataFrame:
        for name, (keys, rate) in of.items():  # FOLDS times the training rows at most
            df = df.join(F.broadcast(rate), keys, "left").withColumn(name, F.coalesce(name, F.lit(overall)))
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)

    folded = prepared(train.withColumn("_fold", F.pmod(F.col("_h"), F.lit(FOLDS)).cast("bigint")), apart)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, featuresCol="features", labelCol="label").fit(folded.coalesce(1).sortWithinPartitions("_h", "_url"))

    def score(df: DataFrame) -> DataFrame:
        out = model.transform(prepared(df, whole))
        return out.withColumn("block_score", F.col("prediction").cast("double"))

    return score


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A verdict for every row: the longest fitting rule's, else that of the trees learnt from the rules' URLs.

    Returns id, host, path, rule (null where none fits) and verdict. A null url, or one without '://', has empty host and
    path and is judged by the trees on its features. Repeated rows stay; no rows give no rows; further columns of
    pages play no part.
    """
    base = pages.select(F.col(id_col).alias("_id"), F.coalesce(url_col, F.lit("")).alias("_url"))
    host, path = parts(F.col("_url"))
    split = base.withColumns({"host": host, "path": path}).withColumn("_hit", matched(F.col("host"), F.col("path"), rules))
    seen = split.where("_hit is not null").withColumn("label", (F.col("_hit.verdict") == "block").cast("double"))
    score = fit(lexical(seen.drop("_hit", "_id")))
    judged = score(lexical(split))
    verdict = F.coalesce(F.col("_hit.verdict"), F.when(F.col("block_score") > 0.5, "block").otherwise("allow"))
    return judged.select(F.col("_id").alias(id_col), "host", "path", F.col("_hit.rule").alias("rule"), verdict.alias("verdict"))
