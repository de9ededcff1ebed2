"""Sources and sinks of series: tables, CSV files, views over the star schema, bounded subsets, agents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesmend.spec import SeriesSpec, clean_numbers, number_rows

#: Names that make a text column a time column.
TIME_NAMES = ("timestamp", "time", "date", "datetime")


def user_events(spark: SparkSession, sf_dir: str, missing_every: int = 0) -> tuple[DataFrame, SeriesSpec]:
    """events as one series for each user. missing_every=n: the value of every n-th event id is missing."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
    value = F.when(F.col("event_id") % missing_every != 0, F.col("value")) if missing_every else F.col("value")
    rows = e.select(F.col("user_id").alias("sample_id"), "ts", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("timestamp"), value.alias("col_1"), F.col("value").alias("clean_1"))
    return number_rows(rows, SeriesSpec(), "ts", "event_id").select("sample_id", "t", "timestamp", "col_1", "clean_1"), SeriesSpec(("col_1",))


def exact_units(c: str) -> Column:
    """A column of amounts in ten-thousandths, as longs: their sum is exact in any order. Null for what is no number below 1e14 (NaN, infinite)."""
    x = F.col(c).cast("double")
    return F.when(F.abs(x) < 1e14, F.when(x < 0, F.ceil(x * 10_000 - 0.5)).otherwise(F.floor(x * 10_000 + 0.5)))


def supplier_months(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, SeriesSpec]:
    """lineitem by supplier and month of shipping: quantity, price, mean discount, which correlate.

    Sums of doubles depend on their order in the last place, and that decides which months tie. So amounts are added up in ten-thousandths, which is exact in any order: each task adds up its own rows first. What is no number is missing."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long")
    rows = li.select(F.col("l_suppkey").alias("sample_id"), month.alias("timestamp"), *[exact_units(c).alias(f"s{k}") for k, c in enumerate(("l_quantity", "l_extendedprice", "l_discount"))])
    total = lambda k: F.sum(f"s{k}") / 10_000.0
    g = rows.groupBy("sample_id", "timestamp").agg(total(0).alias("col_1"), total(1).alias("col_2"), (total(2) / F.nullif(F.count("s2"), F.lit(0))).alias("col_3"))
    return number_rows(g, SeriesSpec(), "timestamp").select("sample_id", "t", "timestamp", "col_1", "col_2", "col_3"), SeriesSpec(("col_1", "col_2", "col_3"))


def order_days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, SeriesSpec]:
    """orders by day, one long series: total price (an exact sum, see supplier_months) and count."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderdate", "o_totalprice")
    g = o.groupBy(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("timestamp")).agg((F.sum(exact_units("o_totalprice")) / 10_000.0).alias("col_1"), F.count("*").cast("double").alias("col_2"))
    return number_rows(g.withColumn("sample_id", F.lit(1).cast("long")), SeriesSpec(), "timestamp").select("sample_id", "t", "timestamp", "col_1", "col_2"), SeriesSpec(("col_1", "col_2"))


def read_series_csv(spark: SparkSession, path: str, rate: float = 1.0, by_time: bool = False) -> tuple[DataFrame, SeriesSpec]:
    """A CSV file with a header (by_time: files, whose rows are in the order of their times and, where these are equal, of the rest), its first column time, the rest numbers; time text becomes epoch seconds, and the first max(1, int(n rate)) rows stay."""
    raw = spark.read.csv(path, header=True, inferSchema=True)
    raw = raw.withColumn("__row", F.monotonically_increasing_id())
    first, *rest = raw.columns[:-1]
    kind = raw.schema[first].dataType.typeName()
    epoch = F.unix_timestamp(F.col(first).cast("timestamp")) if kind in ("string", "date", "timestamp") or first.lower() in TIME_NAMES and kind == "string" else F.col(first).cast("long")
    spec = SeriesSpec(tuple(f"col_{i + 1}" for i in range(len(rest))))
    rows = raw.select(F.lit(0).cast("long").alias("sample_id"), "__row", epoch.alias("timestamp"), *[F.col(c).cast("double").alias(f) for c, f in zip(rest, spec.features, strict=True)])
    rows = number_rows(rows, spec, *(["timestamp", *spec.features] if by_time else []), "__row").drop("__row")
    return clean_numbers(head_rate(rows, spec, rate), spec), spec


def head_rate(df: DataFrame, spec: SeriesSpec, rate: float) -> DataFrame:
    """The first max(1, int(n rate)) rows of each sample of n rows."""
    return df.withColumn("__n", F.count("*").over(spec.whole)).where(F.col(spec.t) < F.greatest(F.lit(1), F.floor(F.col("__n") * rate))).drop("__n")


def densest_subset(df: DataFrame, spec: SeriesSpec, label: str, size: int = 10_000) -> DataFrame:
    """In each sample the `size` rows in a row with the most labelled ones; the first such run of equals. Shorter samples stay whole."""
    ahead = F.sum(F.col(label).cast("long")).over(spec.rows(0, size - 1))
    n = F.count("*").over(spec.whole)
    rows = df.withColumn("__k", F.when(F.col(spec.t) <= F.greatest(n - size, F.lit(0)), ahead))
    start = F.min_by(F.col(spec.t), F.struct(-F.coalesce("__k", F.lit(-1)), F.col(spec.t))).over(spec.whole)
    return rows.withColumn("__s", start).where((F.col(spec.t) >= F.col("__s")) & (F.col(spec.t) < F.col("__s") + size)).drop("__k", "__s")


def rank_models(scores: DataFrame, dataset: str = "Dataset") -> DataFrame:
    """(model, mean_score, rank) from a table with a column of scores for each model."""
    models = [c for c in scores.columns if c != dataset]
    mean = scores.select(dataset, *[F.col(m).cast("double") for m in models]).unpivot(dataset, models, "model", "score").groupBy("model").agg(F.avg("score").alias("mean_score"))
    return mean.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_score"), "model")))


def write_series(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    df.write.format(fmt).options(**options).mode("overwrite").save(path)


def save_agents(spark: SparkSession, agents: dict, path: str) -> None:
    """Agents (Q tables and parameters) as one line of JSON; any store that Spark reaches."""
    spark.createDataFrame([(json.dumps(agents, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_agents(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
