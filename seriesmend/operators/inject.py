"""Error injection: a schedule of blocks for each sample, and eight kinds of errors that a range join puts into the data.

Everything random is drawn from hashes of (sample, block, what is drawn, seed), so that a schedule is the same on every run and machine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmend.functions.scaling import adjust_scale, restore_scale
from seriesmend.spec import SeriesSpec

KINDS = ("single", "drift", "gaussian", "volatility", "gradual", "sudden", "missing", "duplicate")
#: Least and greatest length of a block, first row that may be hit, values after injection in the scale of mean 10.
SHORTEST, LONGEST, FIRST, RANGE = 8, 16, 20, (0.0, 30.0)


def draw(*parts: Column | str, seed: int) -> Column:
    """Uniform in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def schedule(df: DataFrame, spec: SeriesSpec, ratio: float, kinds: tuple[str, ...] = KINDS, features: tuple[str, ...] | None = None, seed: int = 42) -> DataFrame:
    """(sample, start, length, kind, cols): blocks that don't overlap, in all about ratio of a sample's rows. ValueError for a ratio out of [0, 1].

    A sample's rows from FIRST on are cut into slots of LONGEST rows; slots in hashed order get a block each until their lengths reach the ratio.
    """
    if not 0 <= ratio <= 1:
        raise ValueError("ratio must be in [0, 1]")
    features = features or spec.features
    slots = df.groupBy(spec.sample).agg(F.count("*").alias("n")).where(F.col("n") >= FIRST + LONGEST)
    slots = slots.withColumn("slot", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - FIRST) / LONGEST).cast("int") - 1)))
    u = lambda what: draw(spec.sample, "slot", F.lit(what), seed=seed)
    b = slots.withColumn("length", (SHORTEST + F.floor(u("length") * (LONGEST - SHORTEST + 1))).cast("int"))
    b = b.withColumn("start", (FIRST + F.col("slot") * LONGEST + F.floor(u("start") * (LONGEST - F.col("length") + 1))).cast("long"))
    done = F.sum("length").over(Window.partitionBy(spec.sample).orderBy(u("order"), "slot").rowsBetween(Window.unboundedPreceding, -1))
    b = b.withColumn("__done", F.coalesce(done, F.lit(0))).where(F.col("__done") < F.floor(F.col("n") * ratio))
    b = b.withColumn("kind", F.element_at(F.array(*map(F.lit, kinds)), (F.floor(u("kind") * len(kinds)) + 1).cast("int")))
    most = min(3, len(features))
    ranked = F.array_sort(F.array(*[F.struct(draw(spec.sample, "slot", F.lit(f"col {c}"), seed=seed).alias("u"), F.lit(c).alias("c")) for c in features]))
    cols = F.transform(F.slice(ranked, 1, (F.floor(u("cols") * most) + 1).cast("int")), lambda x: x["c"])
    return b.select(spec.sample, "start", "length", "kind", cols.alias("cols"))


def inject(df: DataFrame, spec: SeriesSpec, ratio: float, kinds: tuple[str, ...] = KINDS, features: tuple[str, ...] | None = None, seed: int = 42) -> DataFrame:
    """df with errors, in its own scale, and mask_<feature>: cells that an error was put into."""
    return apply_schedule(df, spec, schedule(df, spec, ratio, kinds, features, seed), seed)


def apply_schedule(df: DataFrame, spec: SeriesSpec, blocks: DataFrame, seed: int = 42) -> DataFrame:
    """Errors of a given schedule (sample, start, length, kind, cols). The values of errors arise in the scale of minimum 0 and mean 10 and go back to the data's."""
    scaled = adjust_scale(df, spec)
    hit = blocks.withColumn(spec.t, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)))
    rows = scaled.join(hit.withColumnRenamed("start", "__start").withColumnRenamed("length", "__len").withColumnRenamed("kind", "__kind").withColumnRenamed("cols", "__cols"), spec.keys, "left")
    block = Window.partitionBy(spec.sample, "__start").orderBy(spec.t)
    i = F.col(spec.t) - F.col("__start")
    n = F.col("__len")
    kind = F.col("__kind")
    sign = F.when(draw(spec.sample, "__start", F.lit("sign"), seed=seed) < 0.5, 1.0).otherwise(-1.0)
    u = lambda c, what: draw(spec.sample, spec.t, F.lit(f"{what} {c}"), seed=seed)
    normal = lambda c: F.sqrt(-2 * F.log(1 - u(c, "n1"))) * F.cos(6.283185307179586 * u(c, "n2"))
    out, masks = {}, {}
    for c in spec.features:
        x = F.col(c)
        own = F.array_contains("__cols", c)
        lo, hi = F.min(c).over(spec.whole), F.max(c).over(spec.whole)
        span = hi - lo
        # a value at least 30 % of the range away: the rest of the range, drawn uniformly
        room_low, room_high = F.greatest(x - 0.3 * span - lo, F.lit(0.0)), F.greatest(hi - x - 0.3 * span, F.lit(0.0))
        at = u(c, "one") * (room_low + room_high)
        single = F.when(at < room_low, lo + at).otherwise(hi - (at - room_low))
        half = n - F.floor(n / 2)
        ramp = F.when(n > 1, sign * 6 * i / (n - 1)).otherwise(F.lit(0.0))
        recover = F.when(i < n - half, sign * 6).otherwise((sign * F.floor(6 - 6 * (i - (n - half)) / F.greatest(half - 1, F.lit(1)))))
        sd = F.sqrt(F.avg(x * x).over(spec.whole) / 100)
        value = (
            F.when((kind == "single") & (i == 0), single).when(kind == "drift", x + 6).when(kind == "gaussian", x + sd * normal(c)).when(kind == "volatility", x * (0.7 + 0.6 * u(c, "v")))
            .when((kind == "gradual") & (i < n - 1), x + ramp).when(kind == "sudden", x + recover)
        )
        clipped = F.greatest(F.lit(RANGE[0]), F.least(F.lit(RANGE[1]), value))
        dup = (kind == "duplicate") & (i > 0)
        touched = own & ((kind != "single") | (i == 0)) & ~kind.isin("missing", "duplicate") & x.isNotNull()
        out[c] = F.when(dup, F.first(c).over(block)).when(own & (kind == "missing"), F.lit(None).cast("double")).when(touched & clipped.isNotNull(), clipped).otherwise(x)
        masks[f"mask_{c}"] = F.coalesce(dup | (own & (kind == "missing")) | touched, F.lit(False))
    stamp = F.when((kind == "duplicate") & (i > 0), F.first(spec.timestamp).over(block)).otherwise(F.col(spec.timestamp))
    dirty = rows.withColumns({**out, **masks, spec.timestamp: stamp}).drop("__start", "__len", "__kind", "__cols")
    return restore_scale(dirty, df, spec)


def blank_rows(df: DataFrame, spec: SeriesSpec, blocks: DataFrame) -> DataFrame:
    """All features missing in the rows of the blocks (sample, start, length)."""
    hit = blocks.select(spec.sample, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias(spec.t)).distinct().withColumn("__hit", F.lit(True))
    rows = df.join(hit, spec.keys, "left")
    return reduce(lambda d, c: d.withColumn(c, F.when(F.col("__hit").isNull(), F.col(c))), spec.features, rows).drop("__hit")
