"""Series operators: small fixtures by hand, properties, and the SQL of every query that has one."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesmend import registry, registry_plans
from seriesmend.functions import scaling
from seriesmend.operators import constrained, constraints, detect, distances, inject, kernels, metrics, missing, repair
from seriesmend.plans import harness, policy, selection
from seriesmend.sources import series
from seriesmend.spec import SeriesSpec, clean_numbers

ONE = SeriesSpec(("col_1",))
THREE = SeriesSpec(("col_1", "col_2", "col_3"))


def make(spark, *columns, times=None, sample=1):
    n = len(columns[0])
    times = times or list(range(n))
    rows = [(sample, i, None if times[i] is None else int(times[i]), *[None if c[i] is None else float(c[i]) for c in columns]) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id long, t long, timestamp long, " + ", ".join(f"col_{k + 1} double" for k in range(len(columns))))


def col(df, name="col_1"):
    return [r[name] for r in df.orderBy("t").collect()]


# ---- the SQL of queries --------------------------------------------------------------------------------------------


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "M":
            df[c] = pd.to_datetime(df[c]).dt.tz_localize(None).astype("datetime64[us]").astype(str)
    cell = lambda v: None if v is None or v != v else bool(v) if isinstance(v, (bool, np.bool_)) else str(v) if isinstance(v, str) else round(float(v), 5)
    return sorted((tuple(cell(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


EVERY_SQL = registry.ORACLE_SQL | registry_plans.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(EVERY_SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    got, want = (registry.QUERIES | registry_plans.QUERIES)[name](spark, sf).toPandas(), duck.execute(EVERY_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    for x, y in zip(normal(got), normal(want), strict=True):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 1.1e-5 * max(1, abs(p))) for p, q in zip(x, y, strict=True)), (x, y)


@pytest.fixture(scope="module")
def split_lines(tmp_path_factory):
    """lineitem with discounts about a bound, in 40 row groups, so that a month's rows are in several tasks."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(5)
    n = 40_000
    month = rng.integers(0, 80, n)
    rows = {
        "l_suppkey": rng.integers(0, 50, n), "l_shipdate": pa.array([f"{1992 + m // 12}-{m % 12 + 1:02d}-15" for m in month]).cast(pa.timestamp("us")),
        "l_quantity": rng.integers(1, 51, n).astype(float), "l_extendedprice": rng.integers(90_000, 10_000_000, n) / 100, "l_discount": rng.choice([0.08, 0.09, 0.1], n),
    }
    folder = tmp_path_factory.mktemp("lines")
    pq.write_table(pa.table(rows), folder / "lineitem.parquet", row_group_size=1000)
    return str(folder)


@pytest.mark.parametrize("name", ["column_violations", "rates_by_constraint", "column_ecdf", "detect_iqr", "order_dependency_ratios", "violation_rates"])
def test_months_of_several_tasks_equal_the_sql_of_several_threads(spark, split_lines, name):
    """Sums of doubles in another order would differ in the last place, and ties with them; these are exact."""
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "65536")
    try:
        assert spark.read.parquet(f"{split_lines}/lineitem.parquet").rdd.getNumPartitions() > 4
        got = (registry.QUERIES | registry_plans.QUERIES)[name](spark, split_lines).toPandas()
    finally:
        spark.conf.set(size, before)
    c = duckdb.connect(config={"threads": 8})
    c.execute(f"create view lineitem as select * from read_parquet('{split_lines}/lineitem.parquet')")
    assert normal(got) == normal(c.execute(EVERY_SQL[name]).df())


@pytest.fixture(scope="module")
def holed(sf, tmp_path_factory):
    """lineitem and events with missing values, keys and times."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    rng = np.random.default_rng(7)
    folder = tmp_path_factory.mktemp("holed")
    for name, shares in (("lineitem", {"l_shipdate": 0.1, "l_suppkey": 0.01, "l_quantity": 0.4, "l_extendedprice": 0.4, "l_discount": 0.4}), ("events", {"ts": 0.02, "user_id": 0.01, "value": 0.1})):
        rows = pq.read_table(f"{sf}/{name}.parquet")
        for c, share in shares.items():
            rows = rows.set_column(rows.schema.get_field_index(c), c, pc.if_else(pa.array(rng.random(len(rows)) < share), pa.scalar(None, rows[c].type), rows[c]))
        pq.write_table(rows, folder / f"{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["bounds_speed_accel_global", "violation_rates", "rates_by_constraint", "column_ecdf", "order_dependency_ratios"])
def test_query_equals_its_sql_where_keys_times_and_values_are_missing(spark, holed, name):
    c = duckdb.connect(config={"threads": 8})
    for t in ("lineitem", "events"):
        c.execute(f"create view {t} as select * from read_parquet('{holed}/{t}.parquet')")
    got, want = (registry.QUERIES | registry_plans.QUERIES)[name](spark, holed).toPandas(), c.execute(EVERY_SQL[name]).df()
    got, want = (x.astype(object).where(x.notna(), None) for x in (got, want))
    assert len(got) > 0 and normal(got) == normal(want)


# ---- missing values ------------------------------------------------------------------------------------------------


def test_hold_and_extrapolation(spark):
    df = make(spark, [None, 5, 3, 9, None])
    assert col(missing.impute_linear(df, ONE)) == [5, 5, 3, 9, 9]
    assert col(repair.impute_interpolation(df, ONE)) == [7, 5, 3, 9, 9]
    assert col(missing.impute_linear(make(spark, [1, None, 3, None, None, 6]), ONE)) == [1, 2, 3, 4, 5, 6]
    assert col(missing.impute_linear(make(spark, [None, None]), ONE)) == [0, 0]


def test_nan_and_infinity_are_missing(spark):
    df = clean_numbers(make(spark, [float("nan"), float("inf"), 1.0]), ONE)
    assert col(df) == [None, None, 1.0]


@pytest.mark.parametrize(("n", "flags"), [(8, 7), (7, 0)])
def test_duplicate_runs(spark, n, flags):
    spec = SeriesSpec(("col_1", "col_2"))
    df = make(spark, [1.0] * n, [2.0] * n, times=[5] * n)
    assert sum(col(missing.duplicate_runs(df, spec), "is_duplicate")) == flags
    assert sum(col(missing.duplicate_runs(make(spark, [1.0] * n, times=[5] * n), ONE), "is_duplicate")) == 0


@pytest.mark.parametrize(("given", "want"), [([None, 110, None, 130, 140], [100, 110, 120, 130, 140]), ([100, None, None, 160], [100, 120, 140, 160]), ([None, 7, None], [7, 7, 7]), ([None, None], [None, None])])
def test_time_is_rebuilt(spark, given, want):
    assert col(missing.rebuild_time(make(spark, [1.0] * len(given), times=given), ONE), "timestamp") == want


def test_ewma_imputer_overwrites(spark):
    assert np.allclose(col(missing.impute_ewma(make(spark, [None, 3, 6, None]), ONE, span=3)), [3, 3, 4.5, 4.5])


def test_preprocess_rates_before_imputation(spark):
    spec = SeriesSpec(("col_1", "col_2"))
    clean, rates = missing.preprocess(make(spark, [1.0, None, 3.0], [1.0, 2.0, 3.0]), spec)
    assert rates.first().missing_rate == pytest.approx(1 / 9) and col(clean) == [1, 2, 3]


# ---- detectors -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("name", "x", "want"), [
    ("ZScore", [1, 2, 3], [1.224745, 0, 1.224745]), ("MAD", [1, 2, 3, 4, 100], [2, 1, 0, 1, 97]), ("IQR", [1, 2, 3, 4, 100], [0, 0, 0, 0, 1]),
    ("EWMA", [0, 10, 10], [0, 7, 4.9]), ("HoltWinters", [0, 10, 10], [0, 6.7, 4.189]),
])
def test_small_scores(spark, name, x, want):
    assert np.allclose(col(detect.DETECTORS[name](make(spark, x), ONE), "score"), want, atol=1e-5)


@pytest.mark.parametrize("x", [[0.26, 14.07, 17.02, 20.4, 23.13, 24.63, 27.84, 38.42, 39.52, 62.64], [2.16, 7.01, 8.6, 17.38, 20.34, 37.88875], [62.84625, 6.89, None, 8.89, 13.19, 22.44, 28.27, 31.59, 33.75, 34.67, 38.55]])
def test_a_value_on_the_fence_is_not_outside(spark, x):
    """Its quartiles lie a quarter of the way between two values."""
    want = duckdb.execute("select max(cast(v > b + 1.5 * (b - a) as double)) from (select v, quantile_cont(v, 0.25) over () a, quantile_cont(v, 0.75) over () b from (select unnest(?::double[]) v))", [x]).fetchone()[0]
    assert max(v for v in col(detect.iqr(make(spark, x), ONE), "score") if v is not None) == want == 0


@pytest.mark.parametrize("name", sorted(detect.DETECTORS))
def test_every_detector_scores_every_row(spark, name):
    rng = np.random.default_rng(0)
    x = np.sin(np.arange(120) / 5)[:, None] + rng.normal(0, 0.05, (120, 3))
    x[60] += 8
    got = col(detect.DETECTORS[name](make(spark, *x.T.tolist()), THREE), "score")
    assert len(got) == 120 and np.isfinite(np.array(got, float)).all()
    if name in ("ZScore", "MAD", "MovingAverage", "RollingMedian", "SavGol", "LOESS", "FFT", "GMM", "KDE", "RobustPCA", "EIF", "CBLOF", "KMeansAD", "Kalman", "EWMA"):
        assert abs(int(np.argmax(got)) - 60) <= 20


def test_scores_are_sanitised(spark):
    df = make(spark, [1.0, 2.0, 3.0]).withColumn("score", F.when(F.col("t") == 1, float("nan")).otherwise(F.col("col_1")))
    assert col(scaling.sanitise_scores(df, ONE, "score"), "score") == [0, 0.5, 1]
    df = df.withColumn("score", F.lit(float("nan")))
    assert col(scaling.sanitise_scores(df, ONE, "score"), "score") == [0, 0, 0]


# ---- constraints ---------------------------------------------------------------------------------------------------


def test_robust_bounds(spark):
    df = spark.createDataFrame([(1, float(v)) for v in range(5)], "g int, x double")
    r = constraints.robust_bounds(df, ["g"], "x").first()
    assert (r.lower, r.upper) == pytest.approx((-2.4478, 6.4478))


def test_order_dependency(spark):
    df = make(spark, [1, 2, 3, 4, 5], [1, 2, 4, 3, 5])
    spec = SeriesSpec(("col_1", "col_2"))
    r = constraints.order_ratios(df, spec).where("source = 'col_1'").first()
    assert r.increasing == 0.75
    rule = constraints.Constraints(order=[constraints.OrderConstraint("col_1", "col_2", "increasing", 0.75)])
    v = constraints.violations(df, spec, rule).collect()
    assert [(x.t, x.degree) for x in v] == [(3, 1.0)]


def test_row_constraint_is_recovered(spark):
    rng = np.random.default_rng(1)
    a, b = rng.uniform(1, 5, 200), rng.uniform(-3, 3, 200)
    y = 2 + 0.5 * a + 0.25 * a * b
    df = make(spark, a.tolist(), b.tolist(), y.tolist())
    found = [r for r in constraints.mine_rows(df, THREE, least_corr=0.05, min_r2=0.99) if r.target == "col_3"]
    terms = dict(found[0].terms)
    assert terms[("col_1", "col_2")] == pytest.approx(0.25, abs=1e-4) and terms[("col_1",)] == pytest.approx(0.5, abs=1e-3)
    bad = df.withColumn("col_3", F.when(F.col("t") == 7, F.col("col_3") + 9).otherwise(F.col("col_3")))
    rule = constraints.Constraints(row=[constraints.RowConstraint("col_3", found[0].terms, found[0].intercept, -0.01, 0.01)])
    assert [r.t for r in constraints.violations(bad, THREE, rule).collect()] == [7]
    assert "col_3 =" in constraints.report(rule)


def test_variance_violation_uses_ten_rows(spark):
    x = [0.0] * 20
    x[12] = 100.0
    v = constraints.violations(make(spark, x), ONE, constraints.Constraints(variance={"col_1": (0, 100)})).collect()
    assert sorted(r.t for r in v) == list(range(8, 16)) and v[0].value == pytest.approx(900.0)


def test_rates_count_samples_without_violations(spark):
    df = make(spark, [0, 9, 0], sample=1).unionByName(make(spark, [0, 1, 2], sample=2))
    found = constraints.violations(df, ONE, constraints.Constraints(speed={"col_1": (-5, 5)}))
    rates = {(r.sample_id, r.kind, r.cols): r.rate for r in constraints.violation_rates(df, ONE, found).collect()}
    assert rates[(1, None, None)] == pytest.approx(2 / 3) and rates[(2, None, None)] == 0 and rates[(1, "speed", "col_1")] == pytest.approx(2 / 3)
    assert {(r.t, r.degree) for r in constraints.degree_cells(found, ONE).collect()} == {(1, 4.0), (2, 4.0)}


# ---- repairs -------------------------------------------------------------------------------------------------------


def test_small_repairs(spark):
    assert col(repair.moving_average(make(spark, [1, 2, 3, 4, 5, 6]), ONE)) == [3, 3, 3, 4, 4, 4]
    assert col(constrained.screen(make(spark, [0, 1, 10, 3, 4]), ONE, {"col_1": (-2, 2)})) == [0, 2, 4, 3, 4]
    assert col(constrained.speed_local(make(spark, [0, 1, 10, 3, 4]), ONE, {"col_1": (-2, 2)})) == [0, 2, 4, 3, 4]
    assert col(repair.interpolation(make(spark, [0, 9, 9, 3, 9, 5]), ONE)) == [0, 1, 2, 3, 4, 5]


@pytest.mark.parametrize("name", ["speed_local", "speed_global", "screen", "oneMilp", "speedacc", "speed_accel_global", "mtclean"])
def test_speed_repairs_keep_to_the_speed(spark, name):
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.uniform(-1, 1, 60))
    x[[10, 30, 31]] += 20
    rules = constraints.Constraints(speed={"col_1": (-2.0, 2.0)}, accel={"col_1": (-4.0, 4.0)})
    got = col(constrained.CONSTRAINT_REPAIRS[name](make(spark, x.tolist()), ONE, rules))
    assert np.abs(np.diff(got)).max() <= 2.0 + 1e-3
    assert np.abs(np.array(got)[[10, 30, 31]] - (x[[10, 30, 31]] - 20)).max() < 15


@pytest.mark.parametrize("name", ["screen", "speed_local", "speed_global", "speedacc", "speed_accel_local", "speed_accel_global", "mtclean", "mtcsc_n", "oneMilp"])
def test_no_step_is_too_fast_in_epoch_seconds(spark, name):
    """On events with their own clock, where steps take from seconds to days."""
    d, s = series.user_events(spark, "/root/testdata/sf0.001")
    before = d.select("sample_id", "t", "timestamp", "col_1").toPandas().sort_values(["sample_id", "t"])
    after = constrained.CONSTRAINT_REPAIRS[name](d, s, registry.EV_RULES).toPandas().sort_values(["sample_id", "t"])

    def fast(p):
        g = p.groupby("sample_id")
        return (g.col_1.diff() / g.timestamp.diff().clip(lower=1e-8)).abs()

    assert (fast(before) > 0.01).any() and not (fast(after) > 0.01 + 1e-6).any()


def test_constrained_projections_are_the_least():
    """The heap method and the interior-point method agree, and no feasible point found by a random walk from theirs is nearer."""
    rng = np.random.default_rng(0)
    for n in (2, 3, 8, 60, 230):
        t = np.cumsum(rng.integers(1, 50, n)).astype(float)
        y = rng.gamma(1, 5, n)
        a, b = constrained.within_speed(y, t, -0.1, 0.2), constrained.within_steps(y, t, (-0.1, 0.2), None, True, 1000, 0.0)
        assert np.abs(a - y).sum() == pytest.approx(np.abs(b - y).sum(), rel=1e-6, abs=1e-6)
        for x, accel, cost in ((constrained.within_steps(y, t, (-0.1, 0.2), (-0.01, 0.02), True, 1000, 0.0), (-0.01, 0.02), lambda v: np.abs(v - y).sum()), (constrained.within_steps(y, t, (-0.1, 0.2), (-0.01, 0.02), False, 1000, 0.0), (-0.01, 0.02), lambda v: ((v - y) ** 2).sum())):
            v = np.diff(x) / np.diff(t)
            assert (v >= -0.1 - 1e-9).all() and (v <= 0.2 + 1e-9).all()
            w = np.diff(v) / np.diff(t)[1:]
            assert (w >= accel[0] - 1e-9).all() and (w <= accel[1] + 1e-9).all()
            for _ in range(200):  # the feasible set is convex: a step towards any feasible point doesn't help
                other = constrained.kept_to(y + rng.normal(0, 3, n), t, (-0.1, 0.2), accel)
                assert cost(x) <= cost(x + 0.01 * (other - x)) + 1e-6
    with pytest.raises(ValueError):
        constrained.within_steps(y, t, None, (0.1, 0.2), True, 100, 0.1)


@pytest.mark.parametrize("name", ["speed_accel_global", "mtclean"])
@pytest.mark.parametrize("copies", [1, 6])
def test_rows_of_one_second_keep_to_the_acceleration(spark, name, copies):
    """Between rows of one second a value can move by a few units in its last place; the speed before must be one that it can go on with."""
    rng = np.random.default_rng(3)
    times = np.repeat(np.cumsum(rng.choice([0, 0, 1, 60, 17063], 150)) + 1_704_067_200, copies).tolist()
    df = make(spark, np.repeat(rng.gamma(1, 30, 150), copies).tolist(), times=times)
    got = constrained.CONSTRAINT_REPAIRS[name](df, ONE, registry.EV_RULES).toPandas().sort_values("t")
    d = np.maximum(np.diff(got.timestamp), 1e-8)
    v = np.diff(got.col_1) / d
    assert (np.diff(times) == 0).any() and np.abs(v).max() <= 0.01 + 1e-6 and np.abs(np.diff(v) / d[1:]).max() <= 0.001 + 1e-6


@pytest.mark.parametrize("name", ["speed_accel_global", "mtclean"])
@pytest.mark.parametrize("scale", [1e4, 1e6])
def test_large_values_of_one_second_keep_to_the_acceleration(spark, name, scale):
    """Where a value's last place is so wide that only the speed 0 goes on in no time, the steps before must come to it in time."""
    rng = np.random.default_rng(4)
    times = (np.cumsum(rng.choice([0, 1, 1, 1, 2, 17063], 200)) + 1_704_067_200).tolist()
    df = make(spark, (scale * rng.gamma(1, 30, 200)).tolist(), times=times)
    got = constrained.CONSTRAINT_REPAIRS[name](df, ONE, registry.EV_RULES).toPandas().sort_values("t")
    d = np.maximum(np.diff(got.timestamp), 1e-8)
    v = np.diff(got.col_1) / d
    assert np.abs(v).max() <= 0.01 + 1e-6 and np.abs(np.diff(v) / d[1:]).max() <= 0.001 + 1e-6


def test_a_row_without_time_is_of_the_moment_before(spark):
    times = [None, 10, 11, None, 20, None]
    got = constrained.speed_global(make(spark, [0, 4, 9, 9, 30, 30], times=times), ONE, {"col_1": (-2, 2)}).toPandas().sort_values("t")
    filled = constrained.speed_global(make(spark, [0, 4, 9, 9, 30, 30], times=[10, 10, 11, 11, 20, 20]), ONE, {"col_1": (-2, 2)})
    assert got.col_1.tolist() == col(filled) and got.timestamp.isna().tolist() == [t is None for t in times]


def test_one_milp_changes_the_fewest_rows(spark):
    x = [0, 1, 50, 3, 4, -40, 6, 7]
    got = col(constrained.one_milp(make(spark, x), ONE, {"col_1": (-1.5, 1.5)}))
    assert [i for i, (a, b) in enumerate(zip(x, got, strict=True)) if a != b] == [2, 5] and got == [0, 1, 2, 3, 4, 5, 6, 7]


def test_constraint_repairs_shrink_spikes(spark):
    rng = np.random.default_rng(42)
    x = np.cumsum(rng.normal(0, 0.3, (80, 2)), axis=0)
    bad = x.copy()
    bad[20, 0] += 15
    bad[45, 1] -= 8
    spec = SeriesSpec(("col_1", "col_2"))
    limit = {f: (-1.2, 1.2) for f in spec.features}
    rules = constraints.Constraints(speed=limit, accel={f: (-2.0, 2.0) for f in spec.features}, variance={f: (0.0, 1.0) for f in spec.features})
    for name, fn in constrained.CONSTRAINT_REPAIRS.items():
        got = fn(make(spark, *bad.T.tolist()), spec, rules).orderBy("t").collect()
        assert [r.timestamp for r in got] == list(range(80))
        assert abs(got[20].col_1 - x[20, 0]) < 15 and all(np.isfinite([r.col_1, r.col_2]).all() for r in got), name


@pytest.mark.parametrize("name", sorted(repair.OUTLIER_REPAIRS))
def test_outlier_repairs_return_every_row(spark, name):
    rng = np.random.default_rng(3)
    x = np.sin(np.arange(90) / 6)[:, None] * [1, 2, 0.5] + rng.normal(0, 0.05, (90, 3))
    x[40] += 6
    got = repair.OUTLIER_REPAIRS[name](make(spark, *x.T.tolist()), THREE).orderBy("t").collect()
    y = np.array([[r.col_1, r.col_2, r.col_3] for r in got], float)
    assert [r.timestamp for r in got] == list(range(90)) and np.isfinite(y).all()
    labelled = repair.repair_labelled(make(spark, *x.T.tolist()).withColumn("label", (F.col("t") == 40).cast("int")), THREE, "label", name).orderBy("t").collect()
    z = np.array([[r.col_1, r.col_2, r.col_3] for r in labelled], float)
    assert np.allclose(np.delete(z, 40, 0), np.delete(x, 40, 0)) and np.isfinite(z[40]).all()


@pytest.mark.parametrize("name", sorted(repair.MISSING_REPAIRS))
def test_missing_repairs_fill_gaps_only(spark, name):
    x = [float(np.sin(i / 4)) if i % 6 else None for i in range(60)]
    got = col(repair.MISSING_REPAIRS[name](make(spark, x, [None] * 60, [1.0] * 60), THREE))
    assert all(v is not None for v in got) and all(a == b for a, b in zip(x, got, strict=True) if a is not None)


def test_interval_roots():
    assert constrained.interval_roots(1, 0, -4) == (-2, 2) and constrained.interval_roots(1, 0, 4) is None


# ---- injection -----------------------------------------------------------------------------------------------------


def test_injection_mask_is_what_changed(spark):
    n = 300
    df = make(spark, *[[10 + float(np.sin(i / 9 + k)) for i in range(n)] for k in range(3)])
    got = inject.inject(df, THREE, 0.3).join(df.select("t", *[F.col(c).alias(f"o_{c}") for c in THREE.features]), "t").collect()
    assert len(got) == n
    for r in got:
        for c in THREE.features:
            if not r[f"mask_{c}"]:
                assert r[c] == pytest.approx(r[f"o_{c}"])
    hit = sum(any(r[f"mask_{c}"] for c in THREE.features) for r in got)
    assert 0.1 * n < hit <= 0.35 * n and all(r.t >= 20 for r in got if r.mask_col_1)
    again = inject.inject(df, THREE, 0.3).orderBy("t").collect()
    assert [r.col_1 for r in again] == [r.col_1 for r in sorted(got, key=lambda r: r.t)]
    with pytest.raises(ValueError):
        inject.inject(df, THREE, 1.5)


@pytest.mark.parametrize("kind", inject.KINDS)
def test_each_kind_of_error(spark, kind):
    df = make(spark, [10 + float(np.sin(i)) for i in range(60)])
    b = spark.createDataFrame([(1, 30, 8, kind, ["col_1"])], "sample_id long, start long, length int, kind string, cols array<string>")
    got = inject.apply_schedule(df, ONE, b).orderBy("t").collect()
    marked = [r.t for r in got if r.mask_col_1]
    assert marked == ([30] if kind == "single" else list(range(31 if kind == "duplicate" else 30, 37 if kind == "gradual" else 38)) if kind != "gradual" else marked)
    if kind == "missing":
        assert all(r.col_1 is None for r in got if r.mask_col_1)
    if kind == "duplicate":
        assert len({(r.timestamp, r.col_1) for r in got if 30 <= r.t < 38}) == 1


# ---- metrics -------------------------------------------------------------------------------------------------------


def test_rra_and_precision(spark):
    m = metrics.repair_metrics(make(spark, [0, 5]), make(spark, [0, 10]), make(spark, [0, 0]), ONE).first()
    assert m.rra == pytest.approx(2 / 3) and (m.precision, m.recall, m.mae_error) == (1.0, 1.0, 5.0)


def labels(spark, label, pred):
    return make(spark, [0.0] * len(label)).withColumn("label", F.array(*map(F.lit, label))[F.col("t")]).withColumn("pred", F.array(*map(F.lit, pred))[F.col("t")])


def test_point_adjust_and_ranges(spark):
    assert col(metrics.point_adjust(labels(spark, [0, 1, 1, 0], [0, 0, 1, 0]), ONE), "pred") == [0, 1, 1, 0]
    assert col(metrics.point_adjust(labels(spark, [1, 1, 0, 0], [0, 1, 0, 0]), ONE), "pred") == [0, 1, 0, 0]
    r = metrics.range_f1(labels(spark, [0, 1, 1, 0, 1, 0], [0, 0, 1, 1, 0, 0]), ONE).first()
    assert r.precision == pytest.approx(0.5) and r.recall == pytest.approx((0.2 + 0.8 * 0.5) / 2)


def plain_range_auc(y, s, window, thresholds=250):
    soft, runs, total = metrics.soft_labels(y, window), metrics._runs(y), int(y.sum())
    wide, mass = [(max(0, a - window // 2), min(len(y), b + window // 2)) for a, b in runs], (total + soft.sum()) / 2
    points, precision = [(0.0, 0.0)], [1.0]
    for c in np.sort(s)[::-1][np.linspace(0, len(s) - 1, thresholds).astype(int)]:
        hit = soft[s >= c].sum()
        exist = np.mean([(s[a:b] >= c).any() for a, b in wide])
        points.append(((sum(s >= c) - hit) / max(len(y) - mass, 1e-10), min(hit / mass, 1.0) * exist))
        precision.append(hit / sum(s >= c))
    f, t = np.array([*points, (1.0, 1.0)]).T
    return ((f[1:] - f[:-1]) * (t[1:] + t[:-1]) / 2).sum(), ((t[1:-1] - t[:-2]) * np.array(precision)[1:]).sum()


def test_volume_takes_all_windows():
    rng = np.random.default_rng(4)
    for n, window in ((60, 4), (250, 20)):
        y = (rng.random(n) < 0.05).astype(int)
        y[n // 3 : n // 2] = 1
        s = np.round(rng.random(n) + 0.3 * y, 2)
        want = np.mean([plain_range_auc(y, s, w) for w in range(window + 1)], axis=0)
        assert metrics.vus(y, s, window) == pytest.approx(tuple(want))
    assert metrics.vus_pred(y, y, 0) == pytest.approx((1.0, 1.0, 1.0))
    p, r, f = metrics.vus_pred(y, np.ones(n, int), 10)
    assert r > 0.9 and p < 0.7 and 0 < f < 1


def test_areas_of_a_perfect_score():
    y = np.zeros(200, int)
    y[50:60] = 1
    s = y + np.linspace(0, 0.01, 200)
    roc, pr = metrics.vus(y, s, 10, 100)
    assert roc > 0.85 and pr > 0.7
    assert metrics.vus(y, -s, 10, 100)[1] < 0.4
    p, r = metrics.affiliation([(50, 60)], [(50, 60)], 200)
    assert (p, r) == (1.0, 1.0) and metrics.affiliation([(50, 60)], [(150, 151)], 200)[0] < 0.6
    with pytest.raises(ValueError):
        metrics.affiliation([], [], 10)
    assert metrics.range_pr_auc(y, s.astype(float)) > 0.9 and metrics.top_ranges_threshold(y, s, 1) > 0.5


# ---- policy, selection, sources ------------------------------------------------------------------------------------


def test_policy_improves_a_broken_series(spark):
    rng = np.random.default_rng(0)
    x = np.sin(np.arange(120) / 6) + rng.normal(0, 0.02, 120)
    bad = [None if i in (15, 16, 70) else v + (6 if i in (40, 90) else 0) for i, v in enumerate(x.tolist())]
    rules = constraints.Constraints(speed={"col_1": (-0.5, 0.5)})
    env = policy.Environment(make(spark, bad), ONE, rules, performance=lambda d: -float(np.mean((np.array(col(d), float) - x) ** 2)), most_steps=2)
    actions = {"MISSING": ["interpolation"], "OUTLIER": ["abnormal_sequence_interpolation"], "CONSTRAINT": ["speed_local"]}
    res = policy.train(env, episodes=2, actions=actions)
    assert res.best_score > env.first and res.best_actions[0] == ("MISSING", "interpolation")
    again = policy.apply_agents(env, res.agents(), actions)
    assert again.count() == 120


def test_agents_survive_a_file(spark, tmp_path):
    q = policy.QTable(1)
    q.learn([(("a", 1), "x", 1.0), (("b", 2), "y", 0.5)])
    series.save_agents(spark, {"high": q.to_json()}, f"file://{tmp_path}/agents")
    back = policy.QTable(0).from_json(series.load_agents(spark, f"file://{tmp_path}/agents")["high"])
    assert back.q == q.q
    assert all(abs(sum(w) - 1) < 1e-9 for w in policy.simplex(3)) and len(policy.simplex(3)) == 36


def test_selection(spark):
    df = make(spark, *np.random.default_rng(0).normal(size=(3, 50)).tolist())
    v = selection.meta_features(df, THREE)
    assert len(v) == selection.SIZE and np.isfinite(v).all()
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, selection.SIZE))
    y = np.stack([x[:, 0], -x[:, 0]], axis=1)
    m = selection.FactorizationMachine(["ZScore", "MAD"]).fit(x, y, 300, 0.02)
    assert selection.top_k_hits(m.scores(x), y, 1, 1) >= 24 and selection.mean_rank(y, y) == 0
    assert selection.select_detectors(df, THREE) == selection.DEFAULT


def test_csv_source(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("date,a,b\n2024-01-01 00:00:00,1,NaN\n2024-01-01 00:01:00,2,5\n2024-01-01 00:02:00,3,6\n2024-01-01 00:03:00,4,7\n")
    df, spec = series.read_series_csv(spark, f"file://{p}", 0.5)
    assert [(r.timestamp, r.col_1, r.col_2) for r in df.orderBy("t").collect()] == [(1704067200, 1.0, None), (1704067260, 2.0, 5.0)] and spec.features == ("col_1", "col_2")


def test_kernels():
    y = np.arange(20.0) ** 2
    assert np.allclose(kernels.savgol(y), y) and np.allclose(kernels.lowess(np.arange(30.0)), np.arange(30.0))
    assert kernels.period(np.sin(2 * np.pi * np.arange(600) / 25)[:, None]) == 25
    s = kernels.local_level(np.r_[np.ones(20), np.nan, np.ones(20)])
    assert abs(s[20] - 1) < 1e-3
    assert np.allclose(kernels.nearest(np.array([[0.0], [1.0], [5.0]]), 1)[0][:, 0], [1, 1, 4])
    z = repair.pchip(np.array([0.0, 1, 2, 4]), np.array([0.0, 1, 1, 3]), np.linspace(0, 4, 41))
    assert (np.diff(z) >= -1e-9).all()


def test_samples_over_many_batches(spark, monkeypatch):
    """A sample of several Arrow batches, many in one, and a null one."""
    from seriesmend import runtime

    monkeypatch.setattr(runtime, "BATCH_ROWS", 7)
    sizes = {1: 30, 2: 1, 3: 7, 4: 8, None: 20, 6: 3}
    rows = [(s, i, float(i * (s or 9))) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "sample_id long, t long, col_1 double").repartition(2)
    from seriesmend.spec import per_series

    got = per_series(df, ONE, lambda x, t: np.stack([np.full(len(x), len(x)), x[:, 0].cumsum()], axis=1), ["n", "total"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n == sizes[r.sample_id] and r.total == (r.sample_id or 9) * r.t * (r.t + 1) / 2
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_norma_counts_all_rows_before(spark):
    x = np.random.default_rng(1).normal(size=400)
    got = col(detect.norma(make(spark, x.tolist()), ONE, block=64), "score")
    a = np.zeros(0)
    for i, v in enumerate(x):
        assert got[i] == pytest.approx(abs(a @ np.exp(-0.1 * (x[:i] - v) ** 2)), abs=1e-12)
        a = np.append(a * (1 - 0.01 * 1e-4), 0.01)


def test_norma_tells_near_rows_of_great_values(spark):
    x = 1e8 + np.random.default_rng(2).normal(size=60)
    got = col(detect.norma(make(spark, x.tolist()), ONE, block=16), "score")
    age = lambda i: (1 - 0.01 * 1e-4) ** (i - 1 - np.arange(i))
    assert np.allclose(got, [(0.01 * age(i) * np.exp(-0.1 * (x[i] - x[:i]) ** 2)).sum() for i in range(60)], rtol=0, atol=1e-12)


def test_kernel_regression_is_that_of_all_rows():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(300, 4)), rng.normal(size=300)
    z = (x - x.mean(0)) / (x.std(0) + 1e-8)
    gram = np.exp(-0.25 * ((z[:, None] - z[None]) ** 2).sum(-1))
    want = y.mean() + gram @ np.linalg.solve(gram + 1e-2 * np.eye(300), y - y.mean())
    assert np.allclose(repair.KernelRidge(x, y, block=64)(x), want, atol=1e-5)


def test_isolation_finds_the_odd_row():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 5))
    x[13] = 8
    for extended in (False, True):
        s = kernels.isolation_scores(x, extended=extended)
        assert s.argmax() == 13 and ((s > 0) & (s < 1)).all()
        assert np.allclose(kernels.isolation_scores(np.ones((20, 2)), extended=extended), kernels.isolation_scores(np.ones((20, 2)), extended=extended))


def test_forecast_score_over_all_windows(spark):
    rng = np.random.default_rng(5)
    x = np.sin(np.arange(400) / 7) + rng.normal(0, 0.1, 400)
    d = make(spark, x.tolist(), (x * 2 + 1).tolist())
    spec = SeriesSpec(("col_1", "col_2"))
    train, test = d.where("t <= 280"), d.where("t > 280").withColumn("t", F.col("t") - 281)
    got = policy.linear_forecast_score(train, test, spec)
    a, b = ([(np.array(r.x), np.array(r.y)) for r in policy.supervised(p, spec).collect()] for p in (train, test))
    (u, v), (p, q) = (tuple(np.stack(z) for z in zip(*rows, strict=True)) for rows in (a, b))
    m, s = u.mean(0), u.std(0) + 1e-8
    coef = np.linalg.solve(((u - m) / s).T @ ((u - m) / s) + np.eye(u.shape[1]), ((u - m) / s).T @ (v - v.mean(0)))
    pred = (p - m) / s @ coef + v.mean(0)
    want = 0.6 * np.exp(-np.sqrt(((pred - q) ** 2).mean()) / (q.std() + 1e-8)) + 0.4 * (np.corrcoef(pred.ravel(), q.ravel())[0, 1] + 1) / 2
    assert got == pytest.approx(want, rel=1e-6)


def plain_grid(n, m, cost):
    """A dynamic program cell by cell."""
    table = np.full((n, m), np.inf)
    for i in range(n):
        for j in range(m):
            table[i, j] = cost(i, j, *(table[a, b] if a >= 0 and b >= 0 else np.inf for a, b in ((i - 1, j - 1), (i, j - 1), (i - 1, j))))
    return table[-1, -1]


def test_distances_against_plain_programs(spark):
    rng = np.random.default_rng(6)
    for n in (1, 2, 9, 30):
        x, y = rng.normal(size=n), rng.normal(size=n)
        assert distances.dtw(x, y) == pytest.approx(plain_grid(n, n, lambda i, j, c, a, b: (x[i] - y[j]) ** 2 + (min(c, a, b) if i and j else 0)) / n)
        assert distances.edr(x, y, 0.5) == pytest.approx(plain_grid(n, n, lambda i, j, c, a, b: i + j if not i or not j else c if abs(x[i] - y[j]) < 0.5 else 1 + min(c, a, b)) / n)
        p, q = np.r_[0, x], np.r_[0, y]
        want = plain_grid(n + 1, n + 1, lambda i, j, c, a, b: 0 if i == j == 0 else np.inf if not i or not j else min(b + abs(p[i] - p[i - 1]) + 0.2, a + abs(q[j] - q[j - 1]) + 0.2, c + abs(p[i] - q[j]) + abs(p[i - 1] - q[j - 1]) + 0.2 * abs(i - j)))
        assert distances.twed(x, y) == pytest.approx(want)
        assert distances.fourier(x, y) == pytest.approx(np.linalg.norm(x - y) / np.sqrt(n)) and distances.ssa(x, x) == 0
    assert [f(np.zeros(0), np.zeros(0)) for f in (distances.dtw, distances.twed, distances.ssa, distances.euclidean)] == [0.0] * 4
    assert distances.euclidean(np.array([1.0, 3.0]), np.zeros(2), 2, spread=2.0) == pytest.approx(np.sqrt(10) / 8)
    line = np.array([0.0, 1.0, 2.0, 9.0, 10.0])
    assert distances.line_knots(line)[0].tolist() == [0, 3]
    got = distances.between(spark.createDataFrame([([1.0], [3.0], 1), (None, [1.0], 2)], "x array<double>, y array<double>, k int"), "x", "y", {"d": distances.euclidean}).orderBy("k").collect()
    assert [r.d for r in got] == [2.0, None]


def test_harness_reads_a_folder_and_scores(spark, tmp_path):
    rng = np.random.default_rng(7)
    for name in ("a", "b", "dull"):
        x = rng.normal(size=(120, 2))
        y = np.zeros(120, int)
        if name != "dull":
            x[60:64] += 9
            y[60:64] = 1
        pd.DataFrame({"time": range(120), "p": x[:, 0], "q": x[:, 1], "label": y}).to_csv(tmp_path / f"{name}_val.csv", index=False)
    d, spec = harness.read_labelled(spark, f"file://{tmp_path}")
    assert sorted(r.sample_id for r in d.select("sample_id").distinct().collect()) == ["a", "b", "dull"] and spec.features == ("col_1", "col_2")
    cut = harness.bounded(d, spec, most=50, step=5).groupBy("sample_id").count().collect()
    assert {r.sample_id: r["count"] for r in cut} == {"a": 65, "b": 65}
    got = {r.sample_id: r for r in harness.score_table(d, spec, ["ZScore", "IForest"]).collect()}
    assert set(got) == {"a", "b"} and all(r.ZScore > 2 * 4 / 65 for r in got.values()), got  # twice what chance gives
    ranks = series.rank_models(harness.score_table(d, spec, ["ZScore", "IForest"]), "sample_id").collect()
    assert {r.model for r in ranks} == {"ZScore", "IForest"}


def test_flat_and_continued_agents(spark):
    x = np.sin(np.arange(80) / 6) * 3
    x[[20, 50]] += 9
    d = make(spark, [None if i % 17 == 3 else v for i, v in enumerate(x)])
    actions = {"MISSING": ["interpolation"], "OUTLIER": ["smurf"], "CONSTRAINT": ["screen"]}
    rules = constraints.Constraints(speed={"col_1": (-1.0, 1.0)})
    env = policy.Environment(d, ONE, rules, most_steps=2, performance=lambda t: 0.5)
    first = policy.train(env, 1, actions=actions)
    again = policy.train(env, 1, actions=actions, agents=first.agents())
    assert set(map(str, first.high.q)) <= set(map(str, again.high.q)) and again.best.count() == 80
    table = policy.train_flat(env, 1, actions=actions)
    out = policy.apply_flat(env, table.to_json(), actions)
    assert out.count() == 80 and out.where("col_1 is null").count() == 0


def test_clusters_of_two_kinds(spark):
    rng = np.random.default_rng(8)
    rows = [(s, i, float(rng.normal() + (0 if s < 6 else 50 * np.sin(i)))) for s in range(12) for i in range(30)]
    d = spark.createDataFrame(rows, "sample_id long, t long, col_1 double")
    assert 2 <= policy.choose_clusters(d, ONE, 4) <= 4 and policy.cluster_performance(d, ONE, 2) > 0.5
    classes = d.select("sample_id").distinct().withColumn("label", (F.col("sample_id") >= 6).cast("int"))
    assert policy.class_performance(d, classes, ONE) > 0.9


@pytest.mark.parametrize("values,want", [
    ([0, 5, 1, 2, 3, 4], [0, 1, 1, 2, 3, 4]),  # towards the first row of the chain 1, 2, 3, 4, as fast as allowed
    ([0, 9, 4, 4.5, 5], [0, 1, 2, 3, 3]),  # no chain: towards the row's own value; the last one becomes the row before it
    ([0, 0.5, 3, 1, 1.5], [0, 0.5, 1, 1, 1.5]),  # the chain begins after the peak
])
def test_mtcsc_by_hand(spark, values, want):
    df = make(spark, values)
    got = constrained.mtcsc(df, ONE, {"col_1": (-1.0, 1.0)}, 5).orderBy("t").toPandas()
    assert np.allclose(got["col_1"], want)


def test_low_reward_is_the_gain_in_smoothness(spark):
    """A repair that changes nothing gains nothing, however smooth the series is."""
    d = make(spark, [float(np.sin(t / 5)) for t in range(60)])
    env = policy.Environment(d, ONE, registry.EV_RULES, most_steps=2)
    env.reset()
    env.apply = lambda macro, low: env.now
    env.performance = lambda df: env.last
    low, _ = env.act("OUTLIER", "smurf")
    assert abs(low) < 1e-9
    rough = [float(np.sin(t / 5)) + (0.8 if t % 9 == 4 else 0) for t in range(60)]
    env = policy.Environment(make(spark, rough), ONE, registry.EV_RULES, most_steps=2)
    env.reset()
    env.apply = lambda macro, low: d
    env.performance = lambda df: env.last
    change = np.sqrt(np.mean([0.64 * (t % 9 == 4) for t in range(60)])) / np.std(rough, ddof=0)
    assert env.act("OUTLIER", "smurf")[0] > -0.2 * change + 0.02


def test_least_change_takes_the_worst_value_first(spark):
    rng = np.random.default_rng(12)
    clean = np.sin(np.arange(120) / 5) + 0.02 * rng.standard_normal(120)
    y = clean.copy()
    y[[40, 41, 90]] += [3, 3, -4]
    got = np.array(col(repair.least_change(make(spark, y.tolist()), ONE)))
    assert np.abs(got - clean)[[40, 90]].max() < 1.0 and np.abs(got - clean).max() < np.abs(y - clean).max() / 2
    assert (np.abs(got - y) < 1e-12).mean() > 0.1 and np.allclose(got[:3], y[:3])
    assert col(repair.least_change(make(spark, [1.0, 5.0, 1.0]), ONE)) == [1.0, 5.0, 1.0]
    assert np.allclose(col(repair.least_change(make(spark, [2.0] * 30), ONE)), 2.0)


def test_policy_measures_each_table_once(spark):
    """a run begins with what the run before measured of the dirty table, and a filled table is written once."""
    d = make(spark, [1.0, None, 3.0, 4.0, 50.0, 6.0, 7.0, 8.0] * 3)
    seen = []
    env = policy.Environment(d, ONE, registry.EV_RULES, most_steps=2, performance=lambda t: seen.append(t) or 0.5)
    first = dict(env.rates)
    full = constraints.violation_rates(env.full, ONE, constraints.violations(env.full, ONE, registry.EV_RULES))
    want = {r["kind"] or "all": r["rate"] for r in full.where("cols is null").groupBy("kind").agg(F.avg("rate").alias("rate")).collect()}
    assert first["CONSTRAINT"] == want.pop("all") and {k[5:]: v for k, v in first.items() if k.startswith("rate_")} == want
    env.reset()
    assert len(seen) == 1 and env.rates == first and seen[0] is env.full


def test_forecast_of_both_sides_from_one_pass(spark):
    """the score of an environment's own task is that of two tables cut at the sample's 0.7 percentile."""
    rng = np.random.default_rng(8)
    d = make(spark, (np.sin(np.arange(230) / 7) + rng.normal(0, 0.1, 230)).tolist())
    env = policy.Environment(d, ONE, registry.EV_RULES, most_steps=1)
    rows = d.withColumn("c", F.percentile_approx("t", 0.7).over(ONE.whole))
    assert env.first == pytest.approx(policy.linear_forecast_score(rows.where("t <= c"), rows.where("t > c"), ONE), rel=1e-9) and env.first > 0.3


def test_mean_shape_is_skewness_and_kurtosis(spark):
    d = make(spark, [1.0, None, 3.0, 4.0, 50.0, 6.0, 7.0, 8.0])
    got = d.select(F.coalesce("col_1", F.lit(0.0)).alias("x")).agg(F.skewness("x"), F.kurtosis("x")).first()
    assert policy.mean_shape(d, ONE) == pytest.approx(tuple(got), rel=1e-9)
    assert policy.mean_shape(make(spark, [2.0, 2.0]), ONE) == (0.0, 0.0)


def test_column_violations_are_one_pass(spark):
    """all kinds come from one sorted table, however many there are; a row may break several."""
    d = make(spark, [float(x) for x in (1, 2, 400, 3, 900, 5, 6, 7, 8, 9, 10, 11)], [1.0] * 12)
    spec = SeriesSpec(("col_1", "col_2"))
    rules = constraints.Constraints(speed={"col_1": (-300.0, 300.0)}, accel={"col_1": (-400.0, 400.0)}, variance={"col_1": (0.0, 30000.0)}, amplitude={"col_2": (2.0, 3.0)})
    found = constraints.column_violations(d, spec, rules)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
    got = sorted((r["t"], r["kind"], r["cols"][0]) for r in found.collect())
    assert [t for t, k, _ in got if k == "speed"] == [2, 3, 4, 5] and [t for t, k, _ in got if k == "amplitude"] == list(range(12))
    assert [t for t, k, _ in got if k == "accel"] == [3, 4, 5, 6] and {c for _, k, c in got if k == "amplitude"} == {"col_2"}


def test_violations_of_all_kinds_are_one_pass(spark):
    """rules of rows, orders and denials are held against the same pass; a union would make the table anew for each, in one task."""
    d = make(spark, [1.0, 2.0, 30.0, 4.0, 5.0], [1.0, 2.0, 3.0, 1.0, 5.0])
    rules = constraints.Constraints(speed={"col_1": (-20.0, 20.0)}, amplitude={"col_2": (0.0, 4.0)})
    rules.row = [constraints.RowConstraint("col_1", ((("col_2",), 1.0),), 0.0, -5.0, 5.0), constraints.RowConstraint("col_2", ((("col_1",), 1.0),), 0.0, -4.0, 30.0)]
    rules.order = [constraints.OrderConstraint("col_1", "col_2", "increasing", 1.0), constraints.OrderConstraint("col_2", "col_1", "decreasing", 1.0)]
    rules.denial = [constraints.DenialConstraint(("col_1", 3.0, 5.0), ("col_2", 0.0, 2.0), 0.1, 0.75)]
    found = constraints.violations(d, SeriesSpec(("col_1", "col_2")), rules)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    got = {(r.kind, ",".join(r.cols), r.t): (r.value, r.lower, r.upper, r.degree) for r in found.collect()}
    assert got == {
        ("speed", "col_1", 2): (28, -20, 20, 8), ("speed", "col_1", 3): (-26, -20, 20, 6), ("amplitude", "col_2", 4): (5, 0, 4, 1),
        ("row", "col_1,col_2", 2): (27, -5, 5, 22), ("row", "col_2,col_1", 2): (-27, -4, 30, 23), ("denial", "col_1,col_2", 3): (None, None, None, 0.25),
        ("order", "col_1,col_2", 3): (1, None, None, 1), ("order", "col_1,col_2", 2): (3, None, None, 2),
        ("order", "col_2,col_1", 3): (4, None, None, 3), ("order", "col_2,col_1", 1): (2, None, None, 1), ("order", "col_2,col_1", 2): (30, None, None, 29), ("order", "col_2,col_1", 4): (5, None, None, 4),
    }


def test_select_detectors_makes_its_series_once(spark, monkeypatch):
    """statistics and detectors read a written table, and not the line items anew."""
    seen = []
    monkeypatch.setattr(registry_plans.selection, "meta_features", lambda d, s: seen.append(d) or np.zeros(selection.SIZE))
    got = registry_plans.QUERIES["select_detectors"](spark, "/root/testdata/sf0.001")
    assert got.count() == 3 and len(seen) == 5
    assert not any("lineitem" in f for d in seen for f in d.inputFiles())
