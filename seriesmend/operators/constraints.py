"""Mining of constraints (speed, acceleration, variance, order, denial, row) and detection of their violations.

Constraints are small driver-side records; each miner needs a handful of aggregates over the series, whatever their size.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations, combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmend.functions.quantiles import quantiles as whole_quantiles
from seriesmend.runtime import discard, written
from seriesmend.spec import SeriesSpec, long_form


@dataclass(frozen=True)
class RowConstraint:
    """target = intercept + sum of coefficients x products of features, within [lower, upper]."""

    target: str
    terms: tuple[tuple[tuple[str, ...], float], ...]
    intercept: float
    lower: float
    upper: float
    r2: float = 1.0

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(sorted({c for t, _ in self.terms for c in t}))

    @property
    def formula(self) -> str:
        parts = [f"{self.intercept:.4g}"] + [f"{w:+.4g}*{'*'.join(t)}" for t, w in self.terms]
        return f"{self.target} = " + " ".join(parts)

    def residual(self) -> Column:
        out = F.col(self.target) - self.intercept
        for term, w in self.terms:
            product = F.lit(w)
            for c in term:
                product = product * F.col(c)
            out = out - product
        return out


@dataclass(frozen=True)
class OrderConstraint:
    source: str
    target: str
    direction: str  # increasing or decreasing
    ratio: float


@dataclass(frozen=True)
class DenialConstraint:
    """No row may have both: left in [lo, hi] and right in [lo, hi]."""

    left: tuple[str, float, float]
    right: tuple[str, float, float]
    support: float
    confidence: float


@dataclass
class Constraints:
    speed: dict[str, tuple[float, float]] = field(default_factory=dict)
    accel: dict[str, tuple[float, float]] = field(default_factory=dict)
    variance: dict[str, tuple[float, float]] = field(default_factory=dict)
    amplitude: dict[str, tuple[float, float]] = field(default_factory=dict)
    order: list[OrderConstraint] = field(default_factory=list)
    denial: list[DenialConstraint] = field(default_factory=list)
    row: list[RowConstraint] = field(default_factory=list)


def differences(df: DataFrame, spec: SeriesSpec, window: int = 5) -> DataFrame:
    """Long form with speed (first difference), accel (second) and variance (sample variance of `window` rows)."""
    w = Window.partitionBy(spec.sample, "col").orderBy(spec.t)
    rows = long_form(df, spec).withColumn("speed", F.col("value") - F.lag("value").over(w))
    full = F.count("value").over(w.rowsBetween(1 - window, 0)) == window
    return rows.withColumns({"accel": F.col("speed") - F.lag("speed").over(w), "variance": F.when(full, F.var_samp("value").over(w.rowsBetween(1 - window, 0)))})


def robust_bounds(df: DataFrame, by: list[str], value: str, k: float = 3.0) -> DataFrame:
    """(by, lower, upper): median -+ k 1.4826 MAD; (0, 0) for groups without values."""
    med = df.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("med"))
    dev = df.join(med, by).groupBy(*by).agg(F.first("med").alias("med"), F.percentile(F.abs(F.col(value) - F.col("med")), F.lit(0.5)).alias("mad"))
    return dev.select(*by, F.coalesce(F.col("med") - k * 1.4826 * F.col("mad"), F.lit(0.0)).alias("lower"), F.coalesce(F.col("med") + k * 1.4826 * F.col("mad"), F.lit(0.0)).alias("upper"))


def column_bounds_table(df: DataFrame, spec: SeriesSpec, per_sample: bool = False, window: int = 5, quantiles: tuple[float, float] | None = None) -> DataFrame:
    """([sample,] col, kind, lower, upper) for speed, accel and variance; with quantiles the bounds are those instead of median and MAD."""
    if not per_sample:
        return _whole_bounds(df, spec, window, quantiles)
    rows = differences(df, spec, window).unpivot([*spec.keys, "col"], ["speed", "accel", "variance"], "kind", "x").where("x is not null")
    by = [spec.sample, "col", "kind"]
    if quantiles:
        q = F.percentile("x", F.array(*map(F.lit, quantiles)))
        return rows.groupBy(*by).agg(q.alias("q")).select(*by, F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))
    return robust_bounds(rows, by, "x")


def _whole_bounds(df: DataFrame, spec: SeriesSpec, window: int, quantiles: tuple[float, float] | None) -> DataFrame:
    """(col, kind, lower, upper) over all samples: a group is a column of the whole table, which no task is to hold. The differences of all features come from one sort and are written once."""
    w = spec.ordered
    frame = w.rowsBetween(1 - window, 0)
    x = {c: F.col(c).cast("double") for c in spec.features}
    rows = df.select(*spec.keys, *[e for k, (c, v) in enumerate(x.items()) for e in ((v - F.lag(v).over(w)).alias(f"speed{k}"), F.when(F.count(v).over(frame) == window, F.var_samp(v).over(frame)).alias(f"variance{k}"))])
    rows = rows.select("*", *[(F.col(f"speed{k}") - F.lag(f"speed{k}").over(w)).alias(f"accel{k}") for k in range(len(x))]).drop(*spec.keys)
    rows = written(rows, "differences")
    names = {f"{kind}{k}": (c, kind) for k, c in enumerate(x) for kind in ("speed", "accel", "variance")}
    if quantiles:
        found = {n: q for n, q in whole_quantiles(rows, {n: F.col(n) for n in names}, quantiles).items() if q[0] is not None}
    else:
        middle = {n: q[0] for n, q in whole_quantiles(rows, {n: F.col(n) for n in names}, [0.5]).items() if q[0] is not None}
        away = whole_quantiles(rows, {n: F.abs(F.col(n) - m) for n, m in middle.items()}, [0.5]) if middle else {}
        found = {n: (m - 3.0 * 1.4826 * away[n][0], m + 3.0 * 1.4826 * away[n][0]) for n, m in middle.items()}
    discard(rows)
    return df.sparkSession.createDataFrame([(*names[n], *map(float, q)) for n, q in found.items()], "col string, kind string, lower double, upper double")


def mine_columns(df: DataFrame, spec: SeriesSpec, **options) -> Constraints:
    out = Constraints()
    for r in column_bounds_table(df, spec, **options).collect():  # three rows a feature
        getattr(out, r["kind"])[r["col"]] = (r["lower"], r["upper"])
    return out


def order_ratios(df: DataFrame, spec: SeriesSpec, columns: tuple[str, ...] | None = None) -> DataFrame:
    """(sample, source, target, increasing, decreasing): shares of steps in order of source, missing ones last, on which target doesn't fall, and doesn't rise."""
    names = list(columns or spec.features)
    if len(names) < 2:
        return None
    # one row for each source, so that one sort by sample, source and value serves all pairs
    rows = df.select(*spec.keys, *names, F.explode(F.array(*[F.struct(F.lit(a).alias("source"), F.col(a).cast("double").alias("by")) for a in names])).alias("s"))
    rows = rows.select(*spec.keys, *names, "s.source", "s.by")
    w = Window.partitionBy(spec.sample, "source").orderBy(F.asc_nulls_last("by"), spec.t)
    steps = rows.select(spec.sample, "source", *[(F.col(b) - F.lag(b).over(w)).alias(b) for b in names])
    shares = [F.struct(F.lit(b).alias("target"), F.avg((F.col(b) >= 0).cast("double")).alias("increasing"), F.avg((F.col(b) <= 0).cast("double")).alias("decreasing")) for b in names]
    found = steps.groupBy(spec.sample, "source").agg(F.array(*shares).alias("pairs")).select(spec.sample, "source", F.explode("pairs").alias("p"))
    return found.select(spec.sample, "source", "p.target", "p.increasing", "p.decreasing").where("source <> target")


def mine_order(df: DataFrame, spec: SeriesSpec, threshold: float = 0.95) -> list[OrderConstraint]:
    """Pairs whose ratio is threshold or more in every sample; increasing before decreasing."""
    rows = order_ratios(df, spec)
    if rows is None:
        return []
    g = rows.groupBy("source", "target").agg(F.min("increasing").alias("i"), F.min("decreasing").alias("d")).orderBy("source", "target").collect()
    return [OrderConstraint(r["source"], r["target"], "increasing" if (r["i"] or 0) >= threshold else "decreasing", max(r["i"] or 0, 0) if (r["i"] or 0) >= threshold else r["d"]) for r in g if max(r["i"] or 0, r["d"] or 0) >= threshold]


def mine_denial(df: DataFrame, spec: SeriesSpec, bins: int = 3, min_support: float = 0.05, min_conf: float = 0.9, top: int = 5) -> list[DenialConstraint]:
    """Pairs of quantile intervals of two features: support = share of rows in both, confidence = 1 - both / either, in each sample; pairs that pass both bounds in every
    sample, with their means over samples, the `top` by confidence, then support."""
    at = [i / bins for i in range(bins + 1)]
    q = whole_quantiles(df, {c: F.col(c) for c in spec.features}, at)
    preds = {}
    for c in spec.features:
        edges = q[c]
        if edges[0] is not None:
            edges[0], edges[-1] = edges[0] - 1e-6, edges[-1] + 1e-6
            preds[c] = [(c, round(a, 2), round(b, 2)) for a, b in zip(edges, edges[1:], strict=False)]
    pairs = [(p, r) for a, b in combinations(preds, 2) for p in preds[a] for r in preds[b]]
    if not pairs:
        return []
    inside = lambda p: (F.col(p[0]) >= p[1]) & (F.col(p[0]) < p[2])
    # a map from pair to its two counts: as many rows as there are samples and pairs, whose least and mean reach the driver
    cells = [F.struct(F.lit(i).alias("pair"), F.count_if(inside(p) & inside(r)).alias("both"), F.count_if(inside(p) | inside(r)).alias("either")) for i, (p, r) in enumerate(pairs)]
    counted = df.groupBy(spec.sample).agg(F.count("*").alias("n"), F.array(*cells).alias("c")).select("n", F.explode("c").alias("c"))
    support, confidence = F.col("c.both") / F.col("n"), F.when(F.col("c.either") > 0, 1 - F.col("c.both") / F.col("c.either")).otherwise(0.0)
    rows = counted.select("c.pair", support.alias("s"), confidence.alias("f")).groupBy("pair").agg(F.min("s").alias("s0"), F.min("f").alias("f0"), F.avg("s").alias("s"), F.avg("f").alias("f"))
    rows = rows.where((F.col("s0") >= min_support) & (F.col("f0") >= min_conf)).collect()
    found = [DenialConstraint(*pairs[r["pair"]], r["s"], r["f"]) for r in rows]
    return sorted(found, key=lambda d: (-d.confidence, -d.support, d.left, d.right))[:top]


def mine_rows(df: DataFrame, spec: SeriesSpec, degree: int = 2, most_features: int = 2, least_corr: float = 0.3, collinear: float = 0.98, min_r2: float = 0.8, max_std: float | None = 0.3, coverage: float = 0.95, candidates: int = 10) -> list[RowConstraint]:
    """Polynomial regressions of each feature on up to most_features others, from one Gram matrix over all products: an aggregate, whatever the number of models.

    Candidates correlate with the target by least_corr; two that correlate by `collinear` don't go together. A model stays with R2 >= min_r2 and a residual deviation <= max_std (None: any);
    of a target's models within 0.005 of the best R2 the one of fewest features wins. Bounds are residual quantiles.
    """
    cols = list(spec.features)
    if len(cols) < 2:
        return []
    full = df.where(" and ".join(f"{c} is not null" for c in cols))
    corr = full.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in combinations(cols, 2)]).first().asDict()
    r = lambda a, b: abs(corr.get(f"{a}|{b}", corr.get(f"{b}|{a}")) or 0.0)
    terms = [t for k in range(1, degree + 1) for t in combinations_with_replacement(cols, k)]
    basis: list[tuple[str, ...]] = [(), *terms]
    value = {}
    scale = {c: v or 1.0 for c, v in full.agg(*[F.stddev_pop(c).alias(c) for c in cols]).first().asDict().items()}
    for t in basis:
        e = F.lit(1.0)
        for c in t:
            e = e * (F.col(c) / scale[c])
        value[t] = e
    pairs = [(i, j) for i in range(len(basis)) for j in range(i, len(basis))]
    got = full.agg(*[F.sum(value[basis[i]] * value[basis[j]]).alias(f"g{i}_{j}") for i, j in pairs]).first()
    gram = np.zeros((len(basis), len(basis)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = got[f"g{i}_{j}"] or 0.0
    n = gram[0, 0]
    if n < 3:
        return []
    found: list[tuple] = []
    for y in cols:
        near = sorted((c for c in cols if c != y and r(c, y) > least_corr), key=lambda c: -r(c, y))[:candidates]
        k = basis.index((y,))
        for size in range(1, most_features + 1):
            for group in combinations(near, size):
                if any(r(a, b) > collinear for a, b in combinations(group, 2)):
                    continue
                use = [i for i, t in enumerate(basis) if all(c in group for c in t)]
                beta = np.linalg.lstsq(gram[np.ix_(use, use)], gram[use, k], rcond=None)[0]
                rss = gram[k, k] - 2 * beta @ gram[use, k] + beta @ gram[np.ix_(use, use)] @ beta
                tss = gram[k, k] - gram[0, k] ** 2 / n
                r2 = 1 - rss / tss if tss > 0 else 0.0
                std = (max(rss, 0) / n) ** 0.5 * scale[y]
                if r2 >= min_r2 and (max_std is None or std <= max_std):
                    found.append((y, r2, group, {basis[i]: b * scale[y] / np.prod([scale[c] for c in basis[i]]) for i, b in zip(use, beta, strict=True)}))
    out = []
    for y in cols:
        own = [f for f in found if f[0] == y]
        if own:
            best = max(f[1] for f in own)
            _, r2, _, coef = min((f for f in own if f[1] >= best - 0.005), key=lambda f: (len(f[2]), -f[1]))
            top = max((abs(v) for t, v in coef.items() if t), default=0.0)
            kept = tuple((t, float(v)) for t, v in coef.items() if t and abs(v) >= 1e-4 * top)
            out.append(RowConstraint(y, kept, float(coef.get((), 0.0)), 0.0, 0.0, float(r2)))
    if not out:
        return []
    lo = (1 - coverage) / 2
    q = whole_quantiles(full, {f"q{i}": c.residual() for i, c in enumerate(out)}, (lo, 1 - lo))
    return [RowConstraint(c.target, c.terms, c.intercept, *map(float, q[f"q{i}"]), c.r2) for i, c in enumerate(out)]


def mine_all(df: DataFrame, spec: SeriesSpec, degree: int = 2, most_features: int = 2, confidence: float = 0.95, bins: int = 3, min_support: float = 0.05, min_conf: float = 0.9, max_std: float | None = 0.3) -> Constraints:
    """All kinds together."""
    out = mine_columns(df, spec)
    out.order, out.denial, out.row = mine_order(df, spec, confidence), mine_denial(df, spec, bins, min_support, min_conf), mine_rows(df, spec, degree, most_features, max_std=max_std)
    return out


def mine_all_per_sample(df: DataFrame, spec: SeriesSpec, **options) -> dict:
    """Constraints of each sample of a set of a few (each is a handful of jobs)."""
    ids = [r[0] for r in df.select(spec.sample).distinct().orderBy(spec.sample).collect()]
    return {i: mine_all(df.where(F.col(spec.sample) == F.lit(i)), spec, **options) for i in ids}


def report(c: Constraints) -> str:
    """Constraints as text."""
    lines = [f"{kind} {col}: [{lo:.4g}, {hi:.4g}]" for kind in ("speed", "accel", "variance", "amplitude") for col, (lo, hi) in sorted(getattr(c, kind).items())]
    lines += [f"order {o.source} -> {o.target}: {o.direction} ({o.ratio:.3f})" for o in c.order]
    lines += [f"denial not ({d.left[0]} in [{d.left[1]}, {d.left[2]}] and {d.right[0]} in [{d.right[1]}, {d.right[2]}]): {d.confidence:.3f}" for d in c.denial]
    return "\n".join(lines + [f"row {r.formula} + [{r.lower:.4g}, {r.upper:.4g}]" for r in c.row])


_FACT = ("kind", "cols", "value", "lower", "upper", "degree")


def _facts(df: DataFrame, spec: SeriesSpec, rules: list[tuple]) -> DataFrame | None:
    """What is wrong by rules of (kind, cols, values, verdict), where verdict(*values) is (value, lower, upper, degree, whether that is wrong). All rules are held against a row in one pass over the table: a union of theirs would sort it anew for each, and in one task."""
    if not rules:
        return None
    names = [[f"__v{k}_{i}" for i in range(len(values))] for k, (_, _, values, _) in enumerate(rules)]
    rows = df.select(*spec.keys, *[v.alias(n) for at, (_, _, values, _) in zip(names, rules, strict=True) for n, v in zip(at, values, strict=True)])
    facts, wrongs = [], []
    for at, (kind, cols, _, verdict) in zip(names, rules, strict=True):
        *numbers, wrong = verdict(*map(F.col, at))
        numbers = [(x if isinstance(x, Column) else F.lit(x)).cast("double").alias(n) for n, x in zip(_FACT[2:], numbers, strict=True)]
        facts.append(F.when(wrong, F.struct(F.lit(kind).alias("kind"), F.array(*map(F.lit, cols)).alias("cols"), *numbers)))
        wrongs.append(wrong)
    return rows.where(reduce(lambda a, b: a | b, wrongs)).select(*spec.keys, F.inline(F.array_compact(F.array(*facts))))


def _bounded(kind: str, cols: list[str], value: Column, lo: float, hi: float) -> tuple:
    return kind, cols, [value], lambda v: (v, lo, hi, _beyond(v, lo, hi), (v < lo) | (v > hi))


def _beyond(v: Column, lo: float, hi: float) -> Column:
    return F.when(v < lo, lo - v).when(v > hi, v - hi)


def column_violations(df: DataFrame, spec: SeriesSpec, c: Constraints, window: int = 10) -> DataFrame | None:
    """Speed, acceleration, variance (population, over `window` rows, at the row after the middle) and amplitude out of bounds. degree: distance to the bound."""
    return _facts(df, spec, _column_verdicts(spec, c, window))


def _column_verdicts(spec: SeriesSpec, c: Constraints, window: int = 10) -> list[tuple]:
    return [_bounded(kind, [f], value, lo, hi) for kind, f, value, lo, hi in _column_rules(spec, c, window)]


def _column_rules(spec: SeriesSpec, c: Constraints, window: int = 10) -> list[tuple[str, str, Column, float, float]]:
    """(kind, feature, what is bounded, lower, upper) of each column constraint."""
    w = spec.ordered
    frame = w.rowsBetween(-(window // 2), window - window // 2 - 1)
    value = {
        "speed": lambda f: F.col(f) - F.lag(f).over(w),
        "accel": lambda f: F.col(f) - 2 * F.lag(f).over(w) + F.lag(f, 2).over(w),
        "variance": lambda f: F.when(F.count(f).over(frame) == window, F.var_pop(f).over(frame)),
        "amplitude": F.col,
    }
    return [(kind, f, of(f), lo, hi) for kind, of in value.items() for f, (lo, hi) in sorted(getattr(c, kind).items())]


def row_violations(df: DataFrame, spec: SeriesSpec, c: Constraints) -> DataFrame | None:
    """Residuals of row constraints out of bounds."""
    return _facts(df, spec, _row_verdicts(c))


def _row_verdicts(c: Constraints) -> list[tuple]:
    return [_bounded("row", [r.target, *r.features], r.residual(), r.lower, r.upper) for r in c.row]


def _order_target(spec: SeriesSpec, o: OrderConstraint) -> tuple[Column, Column]:
    """(target, greatest one before it in order of the source), with the sign of the direction."""
    y = F.col(o.target) if o.direction == "increasing" else -F.col(o.target)
    return y, F.max(y).over(Window.partitionBy(spec.sample).orderBy(o.source, spec.t).rowsBetween(Window.unboundedPreceding, -1))


def order_violations(df: DataFrame, spec: SeriesSpec, c: Constraints) -> DataFrame | None:
    """Rows which in order of the source stand after one of a greater target (a lesser one if decreasing): a running maximum, one sort. degree: distance to it."""
    return _facts(df, spec, _order_verdicts(spec, c))


def _order_verdicts(spec: SeriesSpec, c: Constraints) -> list[tuple]:
    def of(o: OrderConstraint) -> tuple:
        return "order", [o.source, o.target], [F.col(o.target), *_order_target(spec, o)], lambda v, y, m: (v, None, None, m - y, m > y)

    return [of(o) for o in c.order]


def _denied(d: DenialConstraint) -> Column:
    both = F.lit(True)
    for f, lo, hi in (d.left, d.right):
        both = both & (F.col(f) >= lo) & (F.col(f) < hi)
    return both


def denial_violations(df: DataFrame, spec: SeriesSpec, c: Constraints) -> DataFrame | None:
    """Rows inside both intervals of a denial. degree: both / either over all rows."""
    return _facts(df, spec, _denial_verdicts(c))


def _denial_verdicts(c: Constraints) -> list[tuple]:
    def of(d: DenialConstraint) -> tuple:
        return "denial", [d.left[0], d.right[0]], [_denied(d)], lambda wrong: (None, None, None, 1 - d.confidence, wrong)

    return [of(d) for d in c.denial]


def violations(df: DataFrame, spec: SeriesSpec, c: Constraints) -> DataFrame:
    """(sample, t, kind, cols, value, lower, upper, degree) of all kinds, from one pass over the table."""
    found = _facts(df, spec, [*_column_verdicts(spec, c), *_row_verdicts(c), *_order_verdicts(spec, c), *_denial_verdicts(c)])
    return _facts(df, spec, [("none", [], [F.lit(None)], lambda v: (v, v, v, v, F.lit(False)))]) if found is None else found


def violation_rates(df: DataFrame, spec: SeriesSpec, found: DataFrame) -> DataFrame:
    """(sample, kind, cols, rate): violating rows by rows of the sample, for a sample as a whole (kind and cols null), by kind, and by kind and columns; samples without any have 0."""
    n = df.groupBy(spec.sample).agg(F.count("*").alias("n"))
    rows = found.select(spec.sample, spec.t, "kind", F.array_join("cols", ",").alias("cols")).distinct()
    sets = rows.select(spec.sample, spec.t, F.explode(F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("cols")), F.struct("kind", F.lit(None).cast("string").alias("cols")), F.struct("kind", "cols"))).alias("g")).distinct()
    g = sets.groupBy(spec.sample, "g").agg(F.count("*").alias("bad")).select(spec.sample, "g.kind", "g.cols", "bad")
    none = n.select(spec.sample, F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("cols"), F.lit(0).cast("long").alias("bad"))
    return g.unionByName(none).groupBy(spec.sample, "kind", "cols").agg(F.max("bad").alias("bad")).join(n, spec.sample).select(spec.sample, "kind", "cols", (F.col("bad") / F.col("n")).alias("rate"))


def mean_rates(df: DataFrame, spec: SeriesSpec, c: Constraints) -> dict[str, float]:
    """Means of `violation_rates` over samples: of samples as a whole ("all"), and by kind over the samples that have some. Violations are flags of rows here, added up in place: no table of them is made."""
    flags: dict[str, list[Column]] = {}
    for kind, _, value, lo, hi in _column_rules(spec, c):
        flags.setdefault(kind, []).append((value < lo) | (value > hi))
    for r in c.row:
        flags.setdefault("row", []).append((r.residual() < r.lower) | (r.residual() > r.upper))
    for o in c.order:
        y, m = _order_target(spec, o)
        flags.setdefault("order", []).append(m > y)
    for d in c.denial:
        flags.setdefault("denial", []).append(_denied(d))
    if not flags:
        return {"all": 0.0}
    marked = df.where(F.col(spec.sample).isNotNull()).select(spec.sample, *[F.coalesce(f, F.lit(False)).alias(f"__{kind}{k}") for kind, every in flags.items() for k, f in enumerate(every)])
    kinds = {kind: reduce(lambda a, b: a | b, [F.col(f"__{kind}{k}") for k in range(len(every))]) for kind, every in flags.items()}
    kinds["all"] = reduce(lambda a, b: a | b, kinds.values())
    per = marked.groupBy(spec.sample).agg(F.count("*").alias("n"), *[F.count_if(flag).alias(kind) for kind, flag in kinds.items()])
    got = per.agg(*[F.avg(F.when((F.col(kind) > 0) | F.lit(kind == "all"), F.col(kind) / F.col("n"))).alias(kind) for kind in kinds]).first()
    return {kind: got[kind] for kind in kinds if got[kind] is not None}


def degree_cells(found: DataFrame, spec: SeriesSpec) -> DataFrame:
    """(sample, t, col, degree): degrees of violations summed over the cells they involve."""
    return found.select(*spec.keys, F.explode("cols").alias("col"), "degree").groupBy(*spec.keys, "col").agg(F.sum("degree").alias("degree"))


def monotone_segments(df: DataFrame, spec: SeriesSpec, source: str, target: str, least: int = 5) -> DataFrame:
    """(sample, same_direction, steps): over runs of `least` or more steps on which source keeps its direction, the share on which target goes the same way."""
    w = spec.ordered
    rows = df.withColumns({"__s": F.signum(F.col(source) - F.lag(source).over(w)), "__d": F.signum(F.col(target) - F.lag(target).over(w))}).where("__s is not null and __s <> 0")
    rows = rows.withColumn("__i", F.col(spec.t) - F.row_number().over(Window.partitionBy(spec.sample, "__s").orderBy(spec.t)))
    runs = rows.groupBy(spec.sample, "__s", "__i").agg(F.count("*").alias("n"), F.count_if(F.col("__s") == F.col("__d")).alias("k")).where(F.col("n") >= least)
    return runs.groupBy(spec.sample).agg((F.sum("k") / F.sum("n")).alias("same_direction"), F.sum("n").alias("steps"))


def trend_agreement(df: DataFrame, spec: SeriesSpec, a: str, b: str) -> DataFrame:
    """(sample, same, opposite): shares of steps on which two features move the same or the opposite way."""
    w = spec.ordered
    x, y = F.signum(F.col(a) - F.lag(a).over(w)), F.signum(F.col(b) - F.lag(b).over(w))
    rows = df.select(spec.sample, x.alias("x"), y.alias("y")).where("x is not null and y is not null")
    return rows.groupBy(spec.sample).agg(F.avg((F.col("x") == F.col("y")).cast("double")).alias("same"), F.avg((F.col("x") == -F.col("y")).cast("double")).alias("opposite"))


def step_violations(df: DataFrame, spec: SeriesSpec, source: str, target: str, ranges: list[tuple[float, float]], bounds: tuple[float, float]) -> DataFrame:
    """(sample, t, step, degree): rows, in order of source, at which source is in one of the ranges and target's step from the row before is out of bounds (a sequential dependency)."""
    step = F.col(target) - F.lag(target).over(Window.partitionBy(spec.sample).orderBy(source, spec.t))
    inside = reduce(lambda a, b: a | b, [F.col(source).between(lo, hi) for lo, hi in ranges], F.lit(False))
    rows = df.select(*spec.keys, source, step.alias("step")).where(inside & F.col("step").isNotNull())
    degree = F.when(F.col("step") < bounds[0], bounds[0] - F.col("step")).when(F.col("step") > bounds[1], F.col("step") - bounds[1])
    return rows.select(*spec.keys, "step", degree.alias("degree")).where("degree is not null")


def order_correlation(df: DataFrame, spec: SeriesSpec, a: str, b: str) -> DataFrame:
    """(sample, spearman, kendall): correlation of average ranks, and tau-b by signs over all pairs of a sample's rows (quadratic in its rows)."""
    rank = lambda c: F.rank().over(Window.partitionBy(spec.sample).orderBy(c)) + (F.count("*").over(Window.partitionBy(spec.sample, c)) - 1) / 2
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*spec.keys, F.col(a).alias("x"), F.col(b).alias("y"))
    spearman = rows.select(spec.sample, rank("x").alias("rx"), rank("y").alias("ry")).groupBy(spec.sample).agg(F.corr("rx", "ry").alias("spearman"))
    later = rows.select(F.col(spec.sample).alias("__s"), F.col(spec.t).alias("__t"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = rows.join(later, (F.col(spec.sample) == F.col("__s")) & (F.col("__t") > F.col(spec.t)))
    sx, sy = F.signum(F.col("x2") - F.col("x")), F.signum(F.col("y2") - F.col("y"))
    kendall = pairs.groupBy(spec.sample).agg((F.sum(sx * sy) / F.nullif(F.sqrt(F.sum(F.abs(sx)) * F.sum(F.abs(sy))), F.lit(0.0))).alias("kendall"))
    return spearman.join(kendall, spec.sample, "left")


#: What kinds of violations are called in reports by sample.
REPORT_NAMES = {"speed": "speed_constraints", "accel": "acceleration_constraints", "variance": "variance_constraints", "amplitude": "amplitude_constraints", "row": "row_constraints", "order": "od_constraints", "denial": "dd_constraints"}


def named_rates(rates: DataFrame, spec: SeriesSpec) -> DataFrame:
    """(sample, constraint, rate) of each sample's rates by kind."""
    name = F.create_map(*[F.lit(x) for pair in REPORT_NAMES.items() for x in pair])
    return rates.where("kind is not null and cols is null").select(spec.sample, F.coalesce(name[F.col("kind")], F.col("kind")).alias("constraint"), "rate")
