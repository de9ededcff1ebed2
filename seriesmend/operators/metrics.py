"""Scores of repairs against clean data and of detections against labels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmend.spec import long_form, per_series, SeriesSpec

# ---- repairs -------------------------------------------------------------------------------------------------------


def aligned(repair: DataFrame, clean: DataFrame, dirty: DataFrame, spec: SeriesSpec, columns: tuple[str, ...] | None = None) -> DataFrame:
    """(sample, t, col, r, c, d): the three values of each cell; missing counts as 0."""
    cols = columns or spec.features
    pick = lambda df, p: df.select(*spec.keys, *[F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(f"{p}_{x}") for x in cols])
    j = pick(repair, "r").join(pick(clean, "c"), spec.keys).join(pick(dirty, "d"), spec.keys)
    return j.select(*spec.keys, F.inline(F.array(*[F.struct(F.lit(x).alias("col"), F.col(f"r_{x}").alias("r"), F.col(f"c_{x}").alias("c"), F.col(f"d_{x}").alias("d")) for x in cols])))


def repair_metrics(repair: DataFrame, clean: DataFrame, dirty: DataFrame, spec: SeriesSpec, columns: tuple[str, ...] | None = None) -> DataFrame:
    """One row: mse and mnad (columns scaled to the clean range, averaged over them), rra, precision, recall, f1, mae_error.

    precision and recall: a cell is an error if dirty and clean differ by more than 1/10000 of the dirty range, is repaired if repair and dirty do, and is right if repaired, an error and nearer to clean than before.
    """
    cells = aligned(repair, clean, dirty, spec, columns)
    far = F.col("bound")
    b = cells.groupBy("col").agg(((F.max("d") - F.min("d")) / 1e4).alias("bound"), (F.max("c") - F.min("c")).alias("span"))
    x = cells.join(F.broadcast(b), "col")
    scale = F.when(F.col("span") > 0, F.col("span")).otherwise(1.0)
    error, moved = F.abs(F.col("d") - F.col("c")) > far, F.abs(F.col("r") - F.col("d")) > far
    nearer = F.abs(F.col("r") - F.col("c")) < F.abs(F.col("d") - F.col("c"))
    by = x.groupBy("col").agg(F.avg(((F.col("r") - F.col("c")) / scale) ** 2).alias("mse"), F.avg(F.abs((F.col("r") - F.col("c")) / scale)).alias("mnad"), F.sum(F.abs(F.col("r") - F.col("c"))).alias("rc"), F.sum(F.abs(F.col("d") - F.col("c"))).alias("dc"), F.sum(F.abs(F.col("r") - F.col("d"))).alias("rd"),
                              F.count_if(error).alias("errors"), F.count_if(moved).alias("repairs"), F.count_if(error & moved & nearer).alias("right"), F.sum(F.when(F.col("d") != F.col("c"), F.abs(F.col("r") - F.col("c")))).alias("ae"), F.count_if(F.col("d") != F.col("c")).alias("wrong"))
    g = by.agg(F.avg("mse").alias("mse"), F.avg("mnad").alias("mnad"), *[F.sum(c).alias(c) for c in ("rc", "dc", "rd", "errors", "repairs", "right", "ae", "wrong")])
    p, r = F.coalesce(F.col("right") / F.nullif(F.col("repairs"), F.lit(0)), F.lit(0.0)), F.coalesce(F.col("right") / F.nullif(F.col("errors"), F.lit(0)), F.lit(0.0))
    return g.select("mse", "mnad", F.coalesce(1 - F.col("rc") / F.nullif(F.col("dc") + F.col("rd"), F.lit(0.0)), F.lit(1.0)).alias("rra"), p.alias("precision"), r.alias("recall"), F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1"), F.coalesce(F.col("ae") / F.nullif(F.col("wrong"), F.lit(0)), F.lit(0.0)).alias("mae_error"))


def structure(df: DataFrame, spec: SeriesSpec, column: str) -> DataFrame:
    """(sample, structure): minus the mean distance to the mean of three, rows beyond the ends counting as 0."""
    w = spec.ordered
    three = (F.coalesce(F.lag(column).over(w), F.lit(0.0)) + F.col(column) + F.coalesce(F.lead(column).over(w), F.lit(0.0))) / 3
    return df.select(spec.sample, F.abs(F.col(column) - three).alias("d")).groupBy(spec.sample).agg((-F.avg("d")).alias("structure"))


# ---- thresholds ----------------------------------------------------------------------------------------------------


def threshold(df: DataFrame, spec: SeriesSpec, method: str = "sigma", score: str = "score", label: str | None = None, value: float | None = None) -> DataFrame:
    """`pred` 0/1 by sample. method: none (score as it is), fixed (>= value, 0.8), percentile (>= the value-th, 90), topk (the value-th greatest, default number of labels), sigma (> mean + value, 3, x deviation)."""
    w, x = spec.whole, F.col(score)
    if method == "none":
        return df.withColumn("pred", x)
    if method == "fixed":
        cut = F.lit(0.8 if value is None else value)
    elif method == "percentile":
        cut = F.percentile(score, F.lit((90 if value is None else value) / 100)).over(w)
    elif method == "topk":
        rows = df.withColumn("__k", F.lit(int(value)) if value else F.sum(F.col(label).cast("long")).over(w)).withColumn("__r", F.row_number().over(Window.partitionBy(spec.sample).orderBy(F.desc(score), spec.t)))
        cut = F.min(F.when(F.col("__r") <= F.col("__k"), x)).over(w)
        return rows.withColumn("__c", cut).withColumn("pred", F.coalesce(x >= F.col("__c"), F.lit(False)).cast("int")).drop("__k", "__r", "__c")
    elif method == "sigma":
        return df.withColumn("pred", F.coalesce(x > F.avg(score).over(w) + (3.0 if value is None else value) * F.stddev_pop(score).over(w), F.lit(False)).cast("int"))
    else:
        raise ValueError(f"no threshold method {method}")
    return df.withColumn("pred", F.coalesce(x >= cut, F.lit(False)).cast("int"))


# ---- detections, in SQL --------------------------------------------------------------------------------------------


def events(df: DataFrame, spec: SeriesSpec, flag: str) -> DataFrame:
    """(sample, start, end): half-open runs of 1."""
    rows = df.where(F.col(flag) == 1).select(*spec.keys)
    rows = rows.withColumn("__i", F.col(spec.t) - F.row_number().over(spec.ordered))
    return rows.groupBy(spec.sample, "__i").agg(F.min(spec.t).alias("start"), (F.max(spec.t) + 1).alias("end")).drop("__i")


def point_adjust(df: DataFrame, spec: SeriesSpec, label: str = "label", pred: str = "pred") -> DataFrame:
    """`pred` marks the whole of an event that it hits. (The first row of a sample isn't marked backwards.)"""
    runs = Window.partitionBy(spec.sample, label).orderBy(spec.t)
    rows = df.withColumn("__i", F.col(spec.t) - F.row_number().over(runs))
    hit = F.max(pred).over(Window.partitionBy(spec.sample, label, "__i"))
    return rows.withColumn(pred, F.when((F.col(label) == 1) & ((F.col(spec.t) > 0) | (F.col(pred) == 1)), hit).otherwise(F.col(pred))).drop("__i")


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))


def point_scores(df: DataFrame, spec: SeriesSpec, label: str = "label", pred: str = "pred") -> DataFrame:
    """(sample, precision, recall, f1) of points."""
    g = df.groupBy(spec.sample).agg(F.count_if((F.col(label) == 1) & (F.col(pred) == 1)).alias("tp"), F.count_if(F.col(pred) == 1).alias("pp"), F.count_if(F.col(label) == 1).alias("p"))
    p, r = F.coalesce(F.col("tp") / F.nullif(F.col("pp"), F.lit(0)), F.lit(0.0)), F.coalesce(F.col("tp") / F.nullif(F.col("p"), F.lit(0)), F.lit(0.0))
    return g.select(spec.sample, p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"))


def event_f1(df: DataFrame, spec: SeriesSpec, label: str = "label", pred: str = "pred") -> DataFrame:
    """(sample, precision, recall, f1): precision of points after adjustment, recall of events (an interval-overlap join)."""
    truth = events(df, spec, label)
    found = df.where(F.col(pred) == 1).select(F.col(spec.sample).alias("__s"), F.col(spec.t).alias("__t"))
    hit = truth.join(found, (truth[spec.sample] == found["__s"]) & (F.col("__t") >= F.col("start")) & (F.col("__t") < F.col("end")), "left").groupBy(spec.sample, "start").agg(F.max(F.col("__t").isNotNull().cast("int")).alias("hit"))
    recall = hit.groupBy(spec.sample).agg(F.avg("hit").alias("recall"))
    points = point_scores(point_adjust(df, spec, label, pred), spec, label, pred).select(spec.sample, "precision")
    return points.join(recall, spec.sample, "left").select(spec.sample, "precision", F.coalesce("recall", F.lit(0.0)).alias("recall"), _f1(F.col("precision"), F.coalesce("recall", F.lit(0.0))).alias("f1"))


def range_part(df: DataFrame, spec: SeriesSpec, of: str, against: str, alpha: float) -> DataFrame:
    """(sample, value): mean over the events of `of` of alpha x existence + (1 - alpha) x overlap share / number of events of `against` that overlap."""
    a = events(df, spec, of)
    b = events(df, spec, against).select(F.col(spec.sample).alias("__s"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    o = a.join(b, (a[spec.sample] == b["__s"]) & (F.col("s2") < F.col("end")) & (F.col("e2") > F.col("start")), "left")
    size = F.least("end", "e2") - F.greatest("start", "s2")
    g = o.groupBy(spec.sample, "start", "end").agg(F.count("s2").alias("k"), F.sum(F.when(F.col("s2").isNotNull(), size)).alias("o"))
    score = F.when(F.col("k") > 0, alpha + (1 - alpha) * F.col("o") / (F.col("end") - F.col("start")) / F.col("k")).otherwise(0.0)
    return g.groupBy(spec.sample).agg(F.avg(score).alias("value"))


def range_f1(df: DataFrame, spec: SeriesSpec, label: str = "label", pred: str = "pred", recall_alpha: float = 0.2, precision_alpha: float = 0.0) -> DataFrame:
    """(sample, precision, recall, f1) of ranges."""
    r = range_part(df, spec, label, pred, recall_alpha).withColumnRenamed("value", "recall")
    p = range_part(df, spec, pred, label, precision_alpha).withColumnRenamed("value", "precision")
    j = df.select(spec.sample).distinct().join(p, spec.sample, "left").join(r, spec.sample, "left").na.fill(0.0, ["precision", "recall"])
    return j.select(spec.sample, "precision", "recall", _f1(F.col("precision"), F.col("recall")).alias("f1"))


def roc_auc(df: DataFrame, spec: SeriesSpec, label: str = "label", score: str = "score") -> DataFrame:
    """(sample, auc) by rank sums with average ranks; null without both classes."""
    g = df.groupBy(spec.sample, F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(spec.sample).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    h = g.withColumn("w", F.col("p") * (below + F.col("n") / 2)).groupBy(spec.sample).agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return h.select(spec.sample, (F.col("w") / F.nullif(F.col("p") * F.col("n"), F.lit(0))).alias("auc"))


def average_precision(df: DataFrame, spec: SeriesSpec, label: str = "label", score: str = "score") -> DataFrame:
    """(sample, ap): sum of precision x rise of recall over distinct scores, from the top."""
    g = df.groupBy(spec.sample, F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count("*").alias("m"))
    w = Window.partitionBy(spec.sample).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    h = g.withColumns({"tp": F.sum("p").over(w), "all": F.sum("m").over(w)})
    return h.groupBy(spec.sample).agg((F.sum(F.col("tp") / F.col("all") * F.col("p")) / F.nullif(F.sum("p"), F.lit(0))).alias("ap"))


def best_f1(df: DataFrame, spec: SeriesSpec, label: str = "label", score: str = "score") -> DataFrame:
    """(sample, best_f1): greatest 2pr / (p + r + 1e-5) over all thresholds."""
    g = df.groupBy(spec.sample, F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count("*").alias("m"))
    w = Window.partitionBy(spec.sample).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    h = g.withColumns({"tp": F.sum("p").over(w), "all": F.sum("m").over(w), "pos": F.sum("p").over(spec.whole)})
    p, r = F.col("tp") / F.col("all"), F.col("tp") / F.nullif(F.col("pos"), F.lit(0))
    return h.groupBy(spec.sample).agg(F.max(2 * p * r / (p + r + 1e-5)).alias("best_f1"))


def combined_metrics(df: DataFrame, spec: SeriesSpec, label: str = "label", score: str = "score", pred: str | None = None, alpha: float = 0.2) -> DataFrame:
    """A row for each sample with a labelled row: auc, precision, recall and f1 of points, point_f1 after adjustment, range_recall (alpha x existence + (1 - alpha) x overlap), existence, overlap, range_precision, range_f1, and precision_at_k: the share of the k labelled rows among those whose score
    is above the 1 - k / n quantile (between order statistics). pred: a column of 0 and 1; by default scores above mean + 3 deviations."""
    if pred is None:
        df, pred = threshold(df, spec, "sigma", score), "pred"
    w, x = spec.whole, F.col(score)
    rows = df.withColumns({"__n": F.count("*").over(w), "__k": F.sum((F.col(label) == 1).cast("long")).over(w), "__r": F.row_number().over(Window.partitionBy(spec.sample).orderBy(score, spec.t))})
    rows = rows.where(F.col("__k") > 0).withColumn("__h", (1 - F.col("__k") / F.col("__n")) * (F.col("__n") - 1))
    at = lambda place: F.max(F.when(F.col("__r") == place, x)).over(w)
    low = at(F.floor("__h") + 1)
    rows = rows.withColumn("__cut", low + (F.col("__h") - F.floor("__h")) * (F.coalesce(at(F.floor("__h") + 2), low) - low))
    out = rows.groupBy(spec.sample).agg((F.count_if((x > F.col("__cut")) & (F.col(label) == 1)) / F.max("__k")).alias("precision_at_k"))
    kept = rows.select(*spec.keys, label, score, pred)
    named = lambda part, name: part.withColumnRenamed("value", name)
    parts = [
        roc_auc(kept, spec, label, score), point_scores(kept, spec, label, pred), point_scores(point_adjust(kept, spec, label, pred), spec, label, pred).select(spec.sample, F.col("f1").alias("point_f1")),
        named(range_part(kept, spec, label, pred, 1.0), "existence"), named(range_part(kept, spec, label, pred, 0.0), "overlap"), named(range_part(kept, spec, pred, label, 0.0), "range_precision"),
    ]
    for p in parts:
        out = out.join(p, spec.sample, "left")
    out = out.na.fill(0.0, ["existence", "overlap", "range_precision"]).withColumn("range_recall", alpha * F.col("existence") + (1 - alpha) * F.col("overlap"))
    return out.withColumn("range_f1", _f1(F.col("range_precision"), F.col("range_recall")))


# ---- detections, by volume under surfaces --------------------------------------------------------------------------


def _runs(y: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[0, y.astype(int), 0]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _apart(y: np.ndarray) -> np.ndarray:
    """Rows from each row to the nearest one of an event; more than any window where there is none."""
    n, at = len(y), np.arange(len(y))
    events = np.flatnonzero(y.astype(int))
    if not len(events):
        return np.full(n, 1 << 40)
    k = np.searchsorted(events, at)
    return np.minimum(np.where(k > 0, at - events[np.maximum(k - 1, 0)], n), np.where(k < len(events), events[np.minimum(k, len(events) - 1)] - at, n))


def _softened(y: np.ndarray, apart: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """(windows x rows) of soft_labels."""
    wide = windows[:, None]
    near = (apart > 0) & (apart <= wide // 2)
    return np.where(near, np.sqrt(np.maximum(0.0, 1 - apart / np.maximum(wide, 1))), y.astype(float))


def soft_labels(y: np.ndarray, window: int) -> np.ndarray:
    """Labels with margins of window // 2 rows on either side of an event that fade with the root of the distance."""
    return _softened(y, _apart(y), np.array([window]))[0]


def _areas(y: np.ndarray, s: np.ndarray, windows: list[int], thresholds: int) -> list[tuple[float, float]]:
    """(area under ROC, area under precision-recall) with soft labels for each window. Scores are sorted once: rows at or above a threshold are a prefix, so that what is hit is a running sum and an event is hit from the place of its best row on."""
    runs, total, n = _runs(y), int(y.sum()), len(y)
    if not runs or total == n:
        return [(0.0, 0.0)] * len(windows)
    order = np.argsort(-s, kind="stable")
    cuts = s[order][np.linspace(0, n - 1, thresholds).astype(int)]
    above = np.searchsorted(-s[order], -cuts, side="right")  # rows at or above each threshold
    place = np.empty(n, int)
    place[order] = np.arange(n)
    starts, ends = np.array(runs).T
    apart, areas, block = _apart(y), [], max(1, (1 << 20) // max(n, thresholds))
    # places of the events' best rows within each margin: a margin has two rows more than the one before it
    margins = sorted({w // 2 for w in windows})
    first, found = np.minimum.reduceat(np.r_[place, n], np.stack([starts, ends], axis=1).ravel())[::2], {}
    for h in range(margins[-1] + 1):
        if h:
            first = np.minimum(first, np.minimum(np.where(starts >= h, place[np.maximum(starts - h, 0)], n), np.where(ends + h <= n, place[np.minimum(ends + h - 1, n - 1)], n)))
        if h in margins:
            found[h] = np.searchsorted(np.sort(first), above, side="left") / len(runs)
    for lo in range(0, len(windows), block):
        some = windows[lo : lo + block]
        soft = _softened(y, apart, np.array(some))
        mass, running = ((total + soft.sum(axis=1)) / 2)[:, None], np.cumsum(soft[:, order], axis=1)
        hit, exist, edge = np.where(above > 0, running[:, above - 1], 0.0), np.stack([found[w // 2] for w in some]), np.zeros((len(some), 1))
        t = np.hstack([edge, np.minimum(hit / mass, 1.0) * exist, edge + 1])
        f = np.hstack([edge, (above - hit) / np.maximum(n - mass, 1e-10), edge + 1])
        p = hit / np.maximum(above, 1)
        roc, pr = ((f[:, 1:] - f[:, :-1]) * (t[:, 1:] + t[:, :-1]) / 2).sum(axis=1), ((t[:, 1:-1] - t[:, :-2]) * p).sum(axis=1)
        areas += list(zip(roc.tolist(), pr.tolist(), strict=True))
    return areas


def range_auc(y: np.ndarray, s: np.ndarray, window: int, thresholds: int = 250) -> tuple[float, float]:
    """(area under ROC, area under precision-recall) with soft labels; recall counts by the share of events that are hit, positives are the mean of hard and soft labels."""
    return _areas(y, s, [window], thresholds)[0]


def vus(y: np.ndarray, s: np.ndarray, window: int = 100, thresholds: int = 250) -> tuple[float, float]:
    """Mean areas over all windows from 0 to window."""
    got = np.array(_areas(y, s, list(range(window + 1)), thresholds))
    return float(got[:, 0].mean()), float(got[:, 1].mean())


def vus_pred(y: np.ndarray, pred: np.ndarray, window: int = 100) -> tuple[float, float, float]:
    """(precision, recall, F) of a prediction by volume: means over all windows from 0 to window, whose margins build on those of the windows before."""
    total, runs, soft = int(y.sum()), _runs(y), y.astype(float)
    if not runs or not len(y):
        return 0.0, 0.0, 0.0
    got = []
    for w in range(window + 1):
        soft = np.maximum(soft, soft_labels((soft > 0).astype(int), w)) if w else soft
        hit = float((soft * pred).sum())
        mass = (total + soft.sum()) / 2
        exist = np.mean([pred[max(0, a - w // 2) : min(len(y), b + w // 2)].any() for a, b in runs])
        recall, precision = min(hit / mass, 1.0) * exist, hit / max(pred.sum(), 1)
        got.append((precision, recall, 2 * precision * recall / (precision + recall) if precision + recall > 0 else 0.0))
    return tuple(float(v) for v in np.mean(got, axis=0))


def affiliation(truth: list[tuple[int, int]], found: list[tuple[int, int]], n: int) -> tuple[float, float]:
    """(precision, recall) by affiliation: each true event owns the rows nearer to it than to others; distances become chances of a random point being further. ValueError without true events."""
    if not truth:
        raise ValueError("no true events")
    mids = [0.0, *[(a[1] + b[0]) / 2 for a, b in zip(truth, truth[1:], strict=False)], float(n)]
    precision, recall = [], []
    grid = np.arange(n) + 0.5
    for (a, b), lo, hi in zip(truth, mids, mids[1:], strict=False):
        zone = grid[(grid >= lo) & (grid < hi)]
        mine = [(max(c, lo), min(d, hi)) for c, d in found if d > lo and c < hi]
        away = np.maximum(np.maximum(a - zone, zone - b), 0)
        if mine:
            inside = np.concatenate([grid[(grid >= c) & (grid < d)] for c, d in mine])
            d = np.maximum(np.maximum(a - inside, inside - b), 0)
            precision.append(float(np.mean([(away > v).mean() + 0.5 * (away == v).mean() if v > 0 else 1.0 for v in d])) if len(d) else np.nan)
            points = grid[(grid >= a) & (grid < b)]
            gap = np.min([np.maximum(np.maximum(c - points, points - e), 0) for c, e in mine], axis=0)
            chance = [((np.abs(zone - p) > g).mean()) if g > 0 else 1.0 for p, g in zip(points, gap, strict=True)]
            recall.append(float(np.mean(chance)) if len(points) else 0.0)
        else:
            recall.append(0.0)
    return (float(np.nanmean(precision)) if precision and not np.isnan(precision).all() else float("nan")), float(np.mean(recall))


def detection_metrics(df: DataFrame, spec: SeriesSpec, label: str = "label", score: str = "score", window: int = 100, quantile: float = 0.925) -> DataFrame:
    """By sample: auc_roc, auc_pr, vus_roc, vus_pr (all windows), range_auc_roc and range_auc_pr (window), affiliation_precision, affiliation_recall and affiliation_f at the quantile's threshold."""
    names = ["range_auc_roc", "range_auc_pr", "vus_roc", "vus_pr", "affiliation_precision", "affiliation_recall", "affiliation_f"]

    def run(pdf):
        pdf = pdf.sort_values(spec.t)
        y, s = pdf[label].fillna(0).to_numpy(int), pdf[score].fillna(0).to_numpy(float)
        a, v = range_auc(y, s, window), vus(y, s, window)
        pred = s > np.quantile(s, quantile)
        p, r = affiliation(_runs(y), _runs(pred), len(y)) if y.any() else (np.nan, np.nan)
        f = 2 * p * r / (p + r) if p + r > 0 else 0.0
        return pdf[[spec.sample]].head(1).assign(**dict(zip(names, (*a, *v, p, r, f), strict=True)))

    volume = df.select(*spec.keys, label, score).groupBy(spec.sample).applyInPandas(run, T.StructType([df.schema[spec.sample], *[T.StructField(n, T.DoubleType()) for n in names]]))
    return roc_auc(df, spec, label, score).withColumnRenamed("auc", "auc_roc").join(average_precision(df, spec, label, score).withColumnRenamed("ap", "auc_pr"), spec.sample).join(best_f1(df, spec, label, score), spec.sample).join(volume, spec.sample)


def top_ranges_threshold(y: np.ndarray, s: np.ndarray, k: int | None = None) -> float:
    """The greatest score (the least excluded) at which there are k or more ranges; k: number of labelled ranges."""
    k = len(_runs(y)) if k is None else k
    for c in np.unique(s)[:0:-1]:
        if len(_runs(s >= c)) >= k:
            return float(c)
    return float(s.max())


def range_pr_auc(y: np.ndarray, s: np.ndarray, most: int = 50, alpha: float = 0.5) -> float:
    """Area under range precision over range recall at about `most` thresholds, from recall 0 at precision 1 to recall 1 at the share of positives."""
    cuts = np.unique(s)
    cuts = cuts[np.linspace(0, len(cuts) - 1, min(most, len(cuts))).astype(int)]
    part = lambda of, ag, al: np.mean([(al + (1 - al) * sum(min(b, d) - max(a, c) for c, d in hit) / (b - a) / len(hit)) if (hit := [(c, d) for c, d in ag if c < b and d > a]) else 0.0 for a, b in of]) if of else 0.0
    truth = _runs(y)
    pts = [(0.0, 1.0), (1.0, float(y.mean()))]
    for c in cuts:
        found = _runs(s >= c)
        pts.append((float(part(truth, found, alpha)), float(part(found, truth, 0.0))))
    pts = sorted(pts, key=lambda p: (p[0], -p[1]))
    return float(sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:], strict=False)))


def by_values(df: DataFrame, spec: SeriesSpec, fn: Callable[[np.ndarray], float], name: str, columns: list[str]) -> DataFrame:
    """(sample, name): fn(rows x columns, in order) of each sample."""
    rows = per_series(df.select(*spec.keys, *[F.col(c).cast("double").alias(c) for c in columns]), SeriesSpec(tuple(columns), spec.sample, spec.t, spec.t), lambda x, _: np.full(len(x), fn(x)), [name])
    return rows.groupBy(spec.sample).agg(F.min(name).alias(name))


def prediction_metrics(df: DataFrame, spec: SeriesSpec, label: str = "label", pred: str = "pred", window: int = 100) -> DataFrame:
    """By sample, for a given prediction: f1 of points, of points after adjustment, of events and of ranges, affiliation_f, and precision, recall and F by volume (vus_precision, vus_recall, vus_f)."""
    names = ["affiliation_f", "vus_precision", "vus_recall", "vus_f"]

    def values(x: np.ndarray, _) -> np.ndarray:
        y, p = np.nan_to_num(x[:, 0]).astype(int), np.nan_to_num(x[:, 1]).astype(int)
        a, b = affiliation(_runs(y), _runs(p), len(y)) if y.any() else (np.nan, np.nan)
        return np.tile([2 * a * b / (a + b) if a + b > 0 else 0.0, *vus_pred(y, p, window)], (len(x), 1))

    two = df.select(*spec.keys, F.col(label).cast("double").alias("label"), F.col(pred).cast("double").alias("pred"))
    volume = per_series(two, SeriesSpec(("label", "pred"), spec.sample, spec.t, spec.t), values, names).groupBy(spec.sample).agg(*[F.min(n).alias(n) for n in names])
    f1 = lambda d, name: d.select(spec.sample, F.col("f1").alias(name))
    out = f1(point_scores(df, spec, label, pred), "point_f1").join(f1(point_scores(point_adjust(df, spec, label, pred), spec, label, pred), "adjusted_f1"), spec.sample)
    return out.join(f1(event_f1(df, spec, label, pred), "event_f1"), spec.sample).join(f1(range_f1(df, spec, label, pred), "range_f1"), spec.sample).join(volume, spec.sample)


def label_metrics(repaired: DataFrame, clean: DataFrame, dirty: DataFrame, labels: DataFrame, spec: SeriesSpec) -> DataFrame:
    """One row: rmse, mnad (columns scaled to [0, 1] over each sample), rra (labelled cells that were changed), precision, recall and f1 of changes against labels (columns of the features' names, 1: an error)."""
    cells = [long_form(d, spec).withColumnRenamed("value", name) for d, name in ((repaired, "r"), (clean, "c"), (dirty, "d"), (labels, "e"))]
    j = cells[0]
    for other in cells[1:]:
        j = j.join(other, [*spec.keys, "col"])
    w = Window.partitionBy(spec.sample, "col")
    scaled = lambda v: (F.col(v) - F.min(v).over(w)) / F.coalesce(F.nullif(F.max(v).over(w) - F.min(v).over(w), F.lit(0.0)), F.lit(1.0))
    j = j.select("r", "c", (F.coalesce(F.abs(F.col("d") - F.col("r")) > 1e-6, F.lit(False))).alias("moved"), (F.col("e") == 1).alias("wrong"), F.abs(scaled("r") - scaled("c")).alias("gap"))
    g = j.agg(F.sqrt(F.avg((F.col("r") - F.col("c")) ** 2)).alias("rmse"), F.avg("gap").alias("mnad"), F.count_if(F.col("moved") & F.col("wrong")).alias("tp"), F.count_if("moved").alias("pp"), F.count_if("wrong").alias("p"), F.count("*").alias("n"))
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    both = (F.col("p") > 0) & (F.col("p") < F.col("n"))
    precision, recall = F.when(both, share("tp", "pp")).otherwise(0.0), F.when(both, share("tp", "p")).otherwise(0.0)
    return g.select("rmse", "mnad", share("tp", "p").alias("rra"), precision.alias("precision"), recall.alias("recall"), _f1(precision, recall).alias("f1"))


def by_sample(df: DataFrame, spec: SeriesSpec, fn: Callable[[np.ndarray, np.ndarray], float], name: str, label: str = "label", score: str = "score") -> DataFrame:
    """(sample, name): fn(labels, scores) of each sample in order."""

    def run(pdf):
        pdf = pdf.sort_values(spec.t)
        return pdf[[spec.sample]].head(1).assign(**{name: float(fn(pdf[label].to_numpy(int), pdf[score].to_numpy(float)))})

    return df.select(*spec.keys, label, score).groupBy(spec.sample).applyInPandas(run, T.StructType([df.schema[spec.sample], T.StructField(name, T.DoubleType())]))
