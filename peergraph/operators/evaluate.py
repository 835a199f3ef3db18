"""Label reproduction, agreement, and bootstrap of firm-level means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peergraph.operators import quadratic
from peergraph.operators.ranking import average_ranks, counted_ranks, positions
from peergraph.sources.scratch import table


def valid_label(label: Column) -> Column:
    return label.isNotNull() & (label.cast("string") != "")


def label_frame(universe: DataFrame, filings: DataFrame) -> DataFrame:
    """universe with sic4, sic3, sic2: the first non-null code of a company, zero-padded."""
    sic = filings.where("sic is not null and sic <> ''").groupBy("cik").agg(F.min_by("sic", "ord").alias("sic"))
    four = F.lpad("sic", 4, "0")
    return universe.join(sic, "cik", "left").withColumn("sic4", four).withColumn("sic3", F.substring(four, 1, 3)).withColumn("sic2", F.substring(four, 1, 2)).drop("sic")


def precision_per_firm(neighbours: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(i, precision) from a neighbour table among labelled firms: the share with i's label."""
    a = labels.select(F.col(key).alias("i"), F.col(label).alias("li"))
    b = labels.select(F.col(key).alias("j"), F.col(label).alias("lj"))
    return neighbours.join(a, "i").join(b, "j").groupBy("i").agg(F.avg((F.col("li") == F.col("lj")).cast("double")).alias("precision"))


def random_precision(labels: DataFrame, label: str) -> DataFrame:
    """One row: what precision random neighbours reach, mean((same - 1) / (n - 1))."""
    sizes = labels.where(valid_label(F.col(label))).groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c").cast("double")
    return sizes.agg((F.sum(F.col("c") * (F.col("c") - 1)).cast("double") / (n * (n - 1))).alias("random"))


def auc(scores: DataFrame, score: str, positive: Column) -> DataFrame:
    """One row ``auc``: P(score of a positive > of a negative), ties one half; null without both classes."""
    counts = scores.withColumn("_pos", positive).groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("ties"), F.count_if("_pos").alias("pos"), F.count_if(~F.col("_pos")).alias("neg"))
    return auc_of_counts(counts)  # rows meet no table of ranks: a value is one row, however common


def auc_of_counts(counts: DataFrame) -> DataFrame:
    """:func:`auc` from (s, ties, pos, neg) of every distinct score."""
    counts = table(counts, "scores")
    ranked = counted_ranks(counts.where("s is not null"), "s").unionByName(counts.where("s is null").withColumn("below", F.lit(None).cast("long")))
    p, n = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    total = F.sum(F.col("pos") * (F.col("below") + (F.col("ties") + 1) / F.lit(2).cast("double")))
    return ranked.agg(F.when((p > 0) & (n > 0), (total - p * (p + 1) / 2) / (p * n)).alias("auc"))


def spearman(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``spearman``: the correlation of average ranks."""
    ranked = average_ranks(average_ranks(pairs, a, "_ra"), b, "_rb")
    return ranked.agg(F.corr("_ra", "_rb").alias("spearman"))


def jaccard_at_k(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``jaccard``: the mean over firms of |A and B| / |A or B| of their neighbours."""
    sets = lambda df, n: df.groupBy("i").agg(F.collect_set("j").alias(n))
    both = sets(a, "x").join(sets(b, "y"), "i")
    return both.agg(F.avg(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")).cast("double")).alias("jaccard"))


def boot_weights(spark: SparkSession, n: int, draws: int, seed: int) -> DataFrame:
    """(b, firm_idx, w): how often each draw takes each of ``n`` firms.

    Pick ``s`` of draw ``b`` is a hash of (seed, b, s), so the weights are made in tasks
    and come out alike wherever they are made.
    """
    picks = spark.range(draws).select(F.col("id").cast("int").alias("b")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))))
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("s").cast("string")).cast("binary"))
    pick = (F.conv(F.substring(mark, 1, 13), 16, 10).cast("long") % F.lit(max(n, 1))).cast("int")
    return picks.select("b", pick.alias("firm_idx")).groupBy("b", "firm_idx").agg(F.count(F.lit(1)).cast("int").alias("w")).where(F.lit(n > 0))


def firm_numbers(firms: DataFrame, key: str) -> DataFrame:
    """(key, firm_idx): firms numbered in order, for :func:`boot_weights`."""
    return positions(firms.select(key).distinct(), [F.col(key)], "firm_idx").withColumn("firm_idx", F.col("firm_idx").cast("int"))


def label_metrics(top: DataFrame, pairs: DataFrame, labels: DataFrame, key: str, names: list[str], ks: list[int]) -> DataFrame:
    """(label, metric, value): AUC of same-label pairs, precision and random precision at every k, and how many firms have the label.

    ``top`` has i, j and a full ranking by score ``s``: neighbours are taken among the firms
    that have the label.
    """
    out = None
    for name in names:
        own = labels.where(valid_label(F.col(name))).select(key, F.col(name).cast("string").alias("l"))
        a, b = own.select(F.col(key).alias("i"), F.col("l").alias("li")), own.select(F.col(key).alias("j"), F.col("l").alias("lj"))
        same = (F.col("li") == F.col("lj")).cast("double")
        ranked = top.join(a, "i").join(b, "j").withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("s"), "j"))).where(F.col("r") <= max(ks))
        one = metrics_of(ranked.withColumn("same", same), auc(pairs.join(a, "i").join(b, "j"), "s", F.col("li") == F.col("lj")), own, name, ks)
        out = one if out is None else out.unionByName(one)
    return out


def metrics_of(ranked: DataFrame, area: DataFrame, own: DataFrame, name: str, ks: list[int]) -> DataFrame:
    """A label's rows of :func:`label_metrics`, from ranked neighbours (i, r, same), an ``auc`` and the labelled firms (l)."""
    at = ranked.withColumn("k", F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: F.col("r") <= k)))
    precision = at.groupBy("k", "i").agg(F.avg("same").alias("p")).groupBy("k").agg(F.avg("p").alias("value")).select(F.concat(F.lit("p@"), F.col("k").cast("string")).alias("metric"), "value")
    chance = random_precision(own, "l").select(F.lit("random").alias("metric"), F.col("random").alias("value"))
    area = area.select(F.lit("auc").alias("metric"), F.col("auc").alias("value"))
    size = own.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("n").alias("metric"), "value")
    return precision.unionByName(chance).unionByName(area).unionByName(size).select(F.lit(name).alias("label"), "metric", "value")


def paired_means(values: DataFrame, weights: DataFrame, method: str, reference: str, level: float = 0.95) -> DataFrame:
    """(method, mean, lo, hi, diff, diff_lo, diff_hi): bootstrapped means and their differences from a reference over the same draws.

    ``values`` has the method's name, firm_idx and value.
    """
    tail = (1 - level) / 2
    draws = values.where("value is not null").join(weights, "firm_idx").groupBy(method, "b").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("m"))
    base = draws.where(F.col(method) == reference).select("b", F.col("m").alias("m0"))
    bounds = draws.join(base, "b", "left").groupBy(method).agg(
        F.percentile("m", F.lit(tail)).alias("lo"), F.percentile("m", F.lit(1 - tail)).alias("hi"),
        F.percentile(F.col("m") - F.col("m0"), F.lit(tail)).alias("diff_lo"), F.percentile(F.col("m") - F.col("m0"), F.lit(1 - tail)).alias("diff_hi"),
    )
    means = values.groupBy(method).agg(F.avg("value").alias("mean"))
    at = means.where(F.col(method) == reference).select(F.col("mean").alias("mean0"))
    return means.join(bounds, method, "left").join(F.broadcast(at), how="left").withColumn("diff", F.col("mean") - F.col("mean0")).drop("mean0")


def bootstrap_mean(values: DataFrame, weights: DataFrame, by: list[str], value: str = "value", level: float = 0.95) -> DataFrame:
    """(by, mean, lo, hi): company bootstrap of a mean that skips nulls.

    ``values`` has firm_idx; partial sums by draw come first, the draws' percentiles after.
    """
    tail = (1 - level) / 2
    draws = values.where(F.col(value).isNotNull()).join(weights, "firm_idx").groupBy(*by, "b").agg(
        (F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("m")
    )
    bounds = draws.groupBy(*by).agg(F.percentile("m", F.lit(tail)).alias("lo"), F.percentile("m", F.lit(1 - tail)).alias("hi"))
    return values.groupBy(*by).agg(F.avg(value).alias("mean")).join(bounds, by, "left")


def pair_bootstrap_mean(pairs: DataFrame, weights: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    """(by, mean, lo, hi): a pair counts w_i * w_j times in a draw; ``weights`` has b, firm_idx, w."""
    tail = (1 - level) / 2
    own = pairs.where(F.col(value).isNotNull()).withColumn("_one", F.lit(1.0))
    sums = quadratic.pair_sums(own, quadratic.draws(weights.select("b", F.col("firm_idx").alias("firm"), "w")), by, [value, "_one"])
    draws = sums.where("_one > 0").withColumn("m", F.col(value) / F.col("_one"))
    bounds = draws.groupBy(*by).agg(F.percentile("m", F.lit(tail)).alias("lo"), F.percentile("m", F.lit(1 - tail)).alias("hi"))
    return own.groupBy(*by).agg(F.avg(value).alias("mean")).join(bounds, by, "left")


def interval_contrast(draws: DataFrame, group: str, a: str, b: str, level: float = 0.95) -> DataFrame:
    """One row (lo, hi) of the paired difference of two groups over the same draws (b, group, m)."""
    tail = (1 - level) / 2
    wide = draws.groupBy("b").pivot(group, [a, b]).agg(F.first("m"))
    return wide.agg(F.percentile(F.col(a) - F.col(b), F.lit(tail)).alias("lo"), F.percentile(F.col(a) - F.col(b), F.lit(1 - tail)).alias("hi"))
