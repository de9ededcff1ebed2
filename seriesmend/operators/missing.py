"""Missing and duplicate detection, time rebuilding, and the six imputers that run before detection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmend.spec import SeriesSpec, per_series


def is_missing(c: Column, kind: str = "double") -> Column:
    """Null, NaN, and of text '' and 'nan' in any case."""
    return c.isNull() | (F.lower(c).isin("", "nan") if kind == "string" else F.isnan(c.cast("double")))


def missing_mask(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """missing_<column> of every feature and of the time."""
    kinds = dict(df.dtypes)
    return df.withColumns({f"missing_{c}": is_missing(F.col(c), kinds[c]) for c in (spec.timestamp, *spec.features)})


def missing_rates(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """(sample, any_missing, missing_rate): the rate is the mean over cells, of which time is one."""
    cols = [spec.timestamp, *spec.features]
    m = [F.col(f"missing_{c}").cast("int") for c in cols]
    g = missing_mask(df, spec).groupBy(spec.sample).agg(F.sum(sum(m[1:], m[0])).alias("n"), F.count("*").alias("rows"))
    return g.select(spec.sample, (F.col("n") > 0).alias("any_missing"), (F.col("n") / (F.col("rows") * len(cols))).alias("missing_rate"))


def duplicate_runs(df: DataFrame, spec: SeriesSpec, least: int = 8) -> DataFrame:
    """is_duplicate: rows of a run of at least `least` equal rows (time included), from the second on. Only where there are three columns or more. Missing equals nothing."""
    if len(spec.features) + 1 < 3:
        return df.withColumn("is_duplicate", F.lit(False))
    same = [F.col(c) == F.lag(c).over(spec.ordered) for c in (spec.timestamp, *spec.features)]
    equal = F.coalesce(sum_and(same), F.lit(False))
    rows = df.withColumn("__eq", equal)
    island = F.col(spec.t) - F.row_number().over(Window.partitionBy(spec.sample, "__eq").orderBy(spec.t))
    rows = rows.withColumn("__is", island)
    n = F.count("*").over(Window.partitionBy(spec.sample, "__eq", "__is"))
    return rows.withColumn("is_duplicate", F.col("__eq") & (n + 1 >= least)).drop("__eq", "__is")


def sum_and(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def blank_duplicates(df: DataFrame, spec: SeriesSpec, least: int = 8) -> DataFrame:
    """Duplicate rows become missing in all features and in time."""
    rows = duplicate_runs(df, spec, least)
    return rows.withColumns({c: F.when(~F.col("is_duplicate"), F.col(c)) for c in (spec.timestamp, *spec.features)})


def rebuild_time(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Time on a grid through the first valid one: the step is the first difference of two valid neighbours, else that of the first and last valid by their distance; one
    valid value stays constant, none stays missing. Rounded half to even."""
    w, ts, t = spec.whole, F.col(spec.timestamp), F.col(spec.t)
    valid = ts.isNotNull()
    step1 = F.when(valid & F.lag(spec.timestamp).over(spec.ordered).isNotNull(), ts - F.lag(spec.timestamp).over(spec.ordered))
    rows = df.withColumn("__d", step1)
    first_t, last_t = F.min(F.when(valid, t)).over(w), F.max(F.when(valid, t)).over(w)
    first_v = F.min_by(spec.timestamp, F.when(valid, t)).over(w)
    last_v = F.max_by(spec.timestamp, F.when(valid, t)).over(w)
    step = F.coalesce(F.min_by("__d", F.when(F.col("__d").isNotNull(), t)).over(w).cast("double"), (last_v - first_v) / F.nullif(last_t - first_t, F.lit(0)), F.lit(0.0))
    rows = rows.withColumns({"__t0": first_t, "__v0": first_v, "__step": step})
    return rows.withColumn(spec.timestamp, F.bround(F.col("__v0") + (t - F.col("__t0")) * F.col("__step")).cast("long")).drop("__d", "__t0", "__v0", "__step")


def _around(c: str, spec: SeriesSpec) -> tuple[Column, Column, Column, Column]:
    """(value before, its t, value after, its t) of the nearest valid cells, the own one included."""
    before = spec.ordered.rowsBetween(Window.unboundedPreceding, 0)
    after = spec.whole.orderBy(F.desc(spec.t)).rowsBetween(Window.unboundedPreceding, 0)  # a frame to the end is read anew for each row
    own_t = F.when(F.col(c).isNotNull(), F.col(spec.t))
    return F.last(c, True).over(before), F.last(own_t, True).over(before), F.last(c, True).over(after), F.last(own_t, True).over(after)


def impute_linear(df: DataFrame, spec: SeriesSpec, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Linear in the row number between valid cells, constant beyond them, 0 where a sample has none."""
    out = {}
    for c in columns or spec.features:
        a, ta, b, tb = _around(c, spec)
        out[c] = F.coalesce(F.col(c), a + (b - a) * (F.col(spec.t) - ta) / (tb - ta), a, b, F.lit(0.0))
    return df.withColumns(out)


def impute_rolling_mean(df: DataFrame, spec: SeriesSpec, window: int = 5) -> DataFrame:
    """The mean of valid cells among the last `window` rows; missing where there is none."""
    return df.withColumns({c: F.coalesce(F.col(c), F.avg(c).over(spec.rows(window - 1, 0))) for c in spec.features})


def impute_ewma(df: DataFrame, spec: SeriesSpec, span: int = 5) -> DataFrame:
    """The running average s = a x + (1 - a) s, a = 2 / (span + 1), in place of all values; a missing cell repeats s, leading ones take the first s."""
    a = 2 / (span + 1)

    def kernel(x, _):
        out = np.full_like(x, np.nan)
        for j in range(x.shape[1]):
            s = np.nan
            for i, v in enumerate(x[:, j]):
                s = s if np.isnan(v) else v if np.isnan(s) else a * v + (1 - a) * s
                out[i, j] = s
            good = np.flatnonzero(~np.isnan(out[:, j]))
            if len(good):
                out[: good[0], j] = out[good[0], j]
        return out

    return per_series(df, spec, kernel)


def impute_time(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Missing timestamps on the line between known ones by row; the nearest known one beyond them. Timestamps come as doubles."""
    rows = df.withColumn(spec.timestamp, F.col(spec.timestamp).cast("double"))
    return impute_linear(rows, SeriesSpec((spec.timestamp,), spec.sample, spec.t, spec.timestamp))


def impute_mean(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """The sample's mean. (Neighbours among rows that were filled with the mean give the mean again.)"""
    return df.withColumns({c: F.coalesce(F.col(c), F.avg(c).over(spec.whole)) for c in spec.features})


def impute_boosted(df: DataFrame, spec: SeriesSpec, rounds: int = 40, rate: float = 0.1, bins: int = 32, depth: int = 3) -> DataFrame:
    """Regression of each column on the others (filled with their means) by histogram gradient boosting; missing cells take its prediction."""
    from seriesmend.operators.kernels import boosted_fit

    def kernel(x, _):
        out = x.copy()
        filled = np.where(np.isnan(x), np.nan_to_num(np.nanmean(np.where(np.isfinite(x), x, np.nan), axis=0) if len(x) else 0), x)
        for j in range(x.shape[1]):
            gap = np.isnan(x[:, j])
            if gap.any() and not gap.all() and x.shape[1] > 1:
                others = np.delete(filled, j, axis=1)
                out[gap, j] = boosted_fit(others[~gap], x[~gap, j], others[gap], rounds, rate, bins, depth)
            else:
                out[gap, j] = filled[gap, j]
        return out

    return per_series(df, spec, kernel)


def impute_kalman(df: DataFrame, spec: SeriesSpec, steps: int = 5) -> DataFrame:
    """A local-level model by `steps` EM rounds; its smoothed level replaces the whole column."""
    from seriesmend.operators.kernels import local_level

    return per_series(df, spec, lambda x, _: np.stack([local_level(x[:, j], steps) for j in range(x.shape[1])], axis=1))


IMPUTERS = {"linear": impute_linear, "rolling_mean": impute_rolling_mean, "ewma": impute_ewma, "knn": impute_mean, "ridge": impute_boosted, "kalman": impute_kalman}


def preprocess(df: DataFrame, spec: SeriesSpec, least: int = 8, method: str = "linear") -> tuple[DataFrame, DataFrame]:
    """(rows without missing values, rates by sample): rates are taken before imputation; duplicates count as missing afterwards; time is rebuilt."""
    rates = missing_rates(df, spec).join(duplicate_runs(df, spec, least).groupBy(spec.sample).agg(F.avg(F.col("is_duplicate").cast("double")).alias("duplicate_rate")), spec.sample)
    blank = rebuild_time(blank_duplicates(df, spec, least).drop("is_duplicate"), spec)
    return IMPUTERS[method](blank, spec), rates
