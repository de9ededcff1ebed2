"""Scaling, scores and order statistics of series, as window expressions over a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmend.spec import SeriesSpec


def column_bounds(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """(sample, col, lo, hi, mean) of every feature: one aggregate, no window."""
    aggs = [f(x).alias(f"{n}_{x}") for x in spec.features for n, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg))]
    g = df.groupBy(spec.sample).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(x).alias("col"), F.col(f"lo_{x}").cast("double").alias("lo"), F.col(f"hi_{x}").cast("double").alias("hi"), F.col(f"mean_{x}").cast("double").alias("mean")) for x in spec.features])
    return g.select(spec.sample, F.inline(rows))


def adjust_scale(df: DataFrame, spec: SeriesSpec, mean: float = 10.0) -> DataFrame:
    """(x - min) mean / avg(x - min); a factor of 1 where that mean is 0."""
    w = spec.whole
    factor = lambda c: F.coalesce(mean / F.nullif(F.avg(c).over(w) - F.min(c).over(w), F.lit(0.0)), F.lit(1.0))
    return df.withColumns({c: (F.col(c) - F.min(c).over(w)) * factor(c) for c in spec.features})


def restore_scale(df: DataFrame, original: DataFrame, spec: SeriesSpec, mean: float = 10.0) -> DataFrame:
    """The inverse of adjust_scale, whose factors come from the original table."""
    b = original.groupBy(spec.sample).agg(*[F.min(c).alias(f"__lo_{c}") for c in spec.features], *[F.coalesce(mean / F.nullif(F.avg(c) - F.min(c), F.lit(0.0)), F.lit(1.0)).alias(f"__f_{c}") for c in spec.features])
    back = df.join(b, spec.sample)
    return back.withColumns({c: F.col(c) / F.col(f"__f_{c}") + F.col(f"__lo_{c}") for c in spec.features}).select(*df.columns)


def minmax(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Each feature to [0, 1] in its sample; a range of 0 counts as 1."""
    w = spec.whole
    span = lambda c: F.coalesce(F.nullif(F.max(c).over(w) - F.min(c).over(w), F.lit(0.0)), F.lit(1.0))
    return df.withColumns({c: (F.col(c) - F.min(c).over(w)) / span(c) for c in spec.features})


def standardise(df: DataFrame, spec: SeriesSpec, ddof: int = 0) -> DataFrame:
    """(x - mean) / deviation in the sample; a deviation of 0 counts as 1."""
    w, dev = spec.whole, (F.stddev_samp if ddof else F.stddev_pop)
    return df.withColumns({c: (F.col(c) - F.avg(c).over(w)) / F.coalesce(F.nullif(dev(c).over(w), F.lit(0.0)), F.lit(1.0)) for c in spec.features})


def zscore_rows(df: DataFrame, spec: SeriesSpec, ddof: int = 1) -> DataFrame:
    """The z-score of each value among the features of its row; null where they are all equal."""
    x = [F.col(c) for c in spec.features]
    n = len(x)
    mean = sum(x[1:], x[0]) / n
    dev = F.sqrt(sum([(c - mean) ** 2 for c in x[1:]], (x[0] - mean) ** 2) / (n - ddof))
    return df.withColumns({c: F.when(dev > 0, (F.col(c) - mean) / dev) for c in spec.features})


def sanitise(c: Column, clip: float = 1e6) -> Column:
    """Null, NaN and infinite to 0, the rest into [-clip, clip]."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.greatest(F.lit(-clip), F.least(F.lit(clip), c)))


def sanitise_scores(df: DataFrame, spec: SeriesSpec, score: str) -> DataFrame:
    """Non-finite scores become the sample's median of finite ones, then all go to [0, 1]; zeros where none is finite or all are equal."""
    w = spec.whole
    x = F.col(score).cast("double")
    finite = F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)
    filled = F.coalesce(finite, F.percentile(finite, F.lit(0.5)).over(w))
    df = df.withColumn(score, filled)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(score, F.coalesce((F.col(score) - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0)))


def label_known(df: DataFrame, spec: SeriesSpec, rate: float, seed: int = 42, first: int = 3) -> DataFrame:
    """known_<feature>: the first rows of a sample, and cells drawn by a hash with the given rate."""
    draw = lambda c: F.pmod(F.xxhash64(spec.sample, spec.t, F.lit(c), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return df.withColumns({f"known_{c}": (F.col(spec.t) < first) | (draw(c) < rate) for c in spec.features})


def invert_order(score: Column, method: str = "multiplication") -> Column:
    """Scores in the opposite order: -x, or 1 - x for shares ("subtraction")."""
    return -score if method == "multiplication" else 1 - score


def score_to_label(df: DataFrame, spec: SeriesSpec, score: str, fraction: float = 0.1, name: str = "label") -> DataFrame:
    """1 where the score is above the sample's 100 (1 - fraction) percentile."""
    return df.withColumn(name, (F.col(score) > F.percentile(score, F.lit(1 - fraction)).over(spec.whole)).cast("int"))


def precision_at_n(df: DataFrame, spec: SeriesSpec, score: str, label: str, n: int | None = None) -> DataFrame:
    """(sample, precision_at_n): precision of the labels above the percentile that leaves the n (default: number of outliers) greatest."""
    w = spec.whole
    k = F.lit(n) if n else F.sum(F.col(label).cast("long")).over(w)
    rows = df.withColumn("__r", F.row_number().over(Window.partitionBy(spec.sample).orderBy(F.desc(score), spec.t))).withColumn("__k", k)
    cut = F.min(F.when(F.col("__r") <= F.col("__k"), F.col(score))).over(w)
    return rows.withColumn("__c", cut).groupBy(spec.sample).agg((F.count_if((F.col(score) >= F.col("__c")) & (F.col(label) == 1)) / F.nullif(F.count_if(F.col(score) >= F.col("__c")), F.lit(0))).alias("precision_at_n"))


def top_n(df: DataFrame, spec: SeriesSpec, value: str, n: int, order: str = "desc") -> DataFrame:
    """(sample, t, value, rank) of the n greatest (or least) values; the earlier of equals first."""
    key = F.desc(value) if order == "desc" else F.asc(value)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(spec.sample).orderBy(key, spec.t))).where(F.col("rank") <= n).select(*spec.keys, value, "rank")


def ecdf(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """ecdf_<feature>: share of the sample's rows that do not come after in order of the feature; missing values come last."""
    return df.withColumns({f"ecdf_{c}": F.cume_dist().over(Window.partitionBy(spec.sample).orderBy(F.asc_nulls_last(c))) for c in spec.features})


def weighted_pearson(df: DataFrame, spec: SeriesSpec, x: str, y: str, w: str) -> DataFrame:
    """(sample, wpearson): correlation under weights."""
    g = df.groupBy(spec.sample).agg(*[F.sum(e).alias(n) for n, e in (("s", F.col(w)), ("sx", F.col(w) * F.col(x)), ("sy", F.col(w) * F.col(y)), ("sxx", F.col(w) * F.col(x) ** 2), ("syy", F.col(w) * F.col(y) ** 2), ("sxy", F.col(w) * F.col(x) * F.col(y)))])
    cov = F.expr("sxy / s - sx / s * sy / s")
    return g.select(spec.sample, (cov / F.sqrt(F.expr("(sxx / s - sx / s * sx / s) * (syy / s - sy / s * sy / s)"))).alias("wpearson"))


def row_distance(df: DataFrame, left: list[str], right: list[str], name: str = "distance") -> DataFrame:
    """Euclidean distance between two lists of columns of a row."""
    terms = [(F.col(a) - F.col(b)) ** 2 for a, b in zip(left, right, strict=True)]
    return df.withColumn(name, F.sqrt(sum(terms[1:], terms[0])))


def optimal_bins(df: DataFrame, spec: SeriesSpec, feature: str, most: int | None = None) -> DataFrame:
    """(sample, n_bins): the number of equal bins of the greatest penalised likelihood (Birge and Rozenholc)."""
    import numpy as np
    from pyspark.sql import types as T

    def run(pdf):
        x = pdf[feature].dropna().to_numpy(float)
        n = len(x)
        best, at = -np.inf, 1
        for b in range(1, (most or max(1, int(n**0.5))) + 1):
            c = np.histogram(x, b)[0] if n else np.zeros(b)
            got = (c[c > 0] * np.log(b * c[c > 0] / n)).sum() - (b - 1 + np.log(b) ** 2.5) if n else -np.inf
            best, at = (got, b) if got > best else (best, at)
        return pdf[[spec.sample]].head(1).assign(n_bins=at)

    return df.select(spec.sample, feature).groupBy(spec.sample).applyInPandas(run, T.StructType([df.schema[spec.sample], T.StructField("n_bins", T.LongType())]))
