"""The detector benchmark: folders of labelled series, every detector on each, one row of scores for each series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmend.functions.scaling import minmax
from seriesmend.operators import detect, kernels, learned, metrics
from seriesmend.spec import SeriesSpec, number_rows

#: All detectors by name.
POOL = detect.DETECTORS | learned.DETECTORS


def read_labelled(spark: SparkSession, folder: str, names: str = "*_val.csv") -> tuple[DataFrame, SeriesSpec]:
    """All CSV files of a folder as series: the first column is left out (time), the last is the label, rows with a gap go. sample_id is the file's name up to the first wildcard's end."""
    raw = spark.read.csv(folder, header=True, inferSchema=True, pathGlobFilter=names)
    _, *features, label = raw.columns
    tail = names.rpartition("*")[2]
    rows = raw.na.drop().withColumns({"__file": F.col("_metadata.file_name"), "__block": F.col("_metadata.file_block_start"), "__row": F.monotonically_increasing_id()})
    spec = SeriesSpec(tuple(f"col_{i + 1}" for i in range(len(features))))
    columns = [F.col(f"`{c}`").cast("double").alias(f) for c, f in zip(features, spec.features, strict=True)]
    rows = rows.select(F.expr(f"substring(__file, 1, length(__file) - {len(tail)})").alias("sample_id"), "__block", "__row", F.col(f"`{label}`").cast("int").alias("label"), *columns)
    return number_rows(rows, spec, "__block", "__row").drop("__block", "__row").withColumn("timestamp", F.col("t")), spec


def bounded(df: DataFrame, spec: SeriesSpec, label: str = "label", most: int = 20_000, step: int = 5000) -> DataFrame:
    """Of each sample the first `most` rows, and as many more by `step` as it takes to have both classes; samples of one class go."""
    w = spec.whole
    first = F.min_by(F.col(label), F.col(spec.t)).over(w)
    rows = df.withColumn("__first", first)
    other = F.min(F.when(F.col(label) != F.col("__first"), F.col(spec.t))).over(w)
    more = F.ceil(F.greatest(F.col("__other") + 1 - most, F.lit(0)) / step) * step
    return rows.withColumn("__other", other).where(F.col("__other").isNotNull() & (F.col(spec.t) < most + more)).drop("__first", "__other")


def of_both_classes(df: DataFrame, spec: SeriesSpec, label: str = "label") -> DataFrame:
    """All rows of the samples that have both classes."""
    w = spec.whole
    rows = df.withColumn("__both", F.min(label).over(w) != F.max(label).over(w))
    return rows.where("__both").drop("__both")


def score_table(df: DataFrame, spec: SeriesSpec, detectors: list[str], label: str = "label", most: int | None = None, step: int = 5000) -> DataFrame:
    """(sample, one column for each detector): VUS-PR of its scores between 0 and 1, with windows up to the series' period, over whole series (most: over their beginnings, see `bounded`); samples of one class go. A sample on which a detector fails has null there: that detector's column alone."""
    rows = of_both_classes(df, spec, label) if most is None else bounded(df, spec, label, most, step)
    features = list(spec.features)
    period = metrics.by_values(rows, spec, lambda x: float(kernels.period(x)), "__period", features)
    out = rows.select(spec.sample).distinct()
    for name in detectors:
        if name not in POOL:
            raise ValueError(f"no detector {name}")
        scored = POOL[name](rows.select(*spec.keys, *([spec.timestamp] if spec.timestamp in rows.columns else []), *features), spec).select(*spec.keys, "score")
        scored = minmax(scored, SeriesSpec(("score",), spec.sample, spec.t, spec.timestamp)).join(rows.select(*spec.keys, F.col(label).alias("label")), spec.keys).join(period, spec.sample)
        got = metrics.by_values(scored, spec, lambda x: metrics.vus(x[:, 0].astype(int), np.nan_to_num(x[:, 1]), int(x[0, 2]))[1], name, ["label", "score", "__period"])
        out = out.join(got, spec.sample, "left")
    return out
