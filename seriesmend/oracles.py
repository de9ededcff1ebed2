"""SQL of further queries: recursions as folds over the list of a sample's rows so far, and sums over pairs of a sample's rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def _greatest(parts: Sequence[str]) -> str:
    return f"round(greatest({', '.join(parts)}), 6) + 0.0 AS score"


def detectors(sm: str, cols: Sequence[str]) -> dict[str, str]:
    """sm: the CTE of the series of several columns (sample_id, t, ...)."""
    whole = "WINDOW w AS (PARTITION BY sample_id)"
    upto = "WINDOW w AS (PARTITION BY sample_id ORDER BY t ROWS UNBOUNDED PRECEDING)"
    every = "WINDOW w AS (PARTITION BY sample_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    found = {}

    level = "0.3 * x.v + 0.7 * (a.l + a.b)"
    state = f"lambda a, x: struct_pack(v := x.v, l := {level}, b := 0.1 * (({level}) - a.l) + 0.9 * a.b)"
    folds = ", ".join(f"list_reduce(list(struct_pack(v := {c}, l := {c}, b := CAST(0 AS DOUBLE))) OVER w, {state}) AS s_{c}" for c in cols)
    found["detect_holtwinters"] = f"""
        WITH {sm}, s AS (SELECT *, {folds} FROM sm {upto})
        SELECT sample_id, t, {_greatest([f'abs({c} - (s_{c}.l + s_{c}.b))' for c in cols])} FROM s"""

    design = np.vander(np.arange(-3, 4), 3, increasing=True)
    hat = "[" + ", ".join("[" + ", ".join(repr(float(v)) for v in row) + "]" for row in design @ np.linalg.pinv(design)) + "]"
    smooth = """CASE WHEN n < 7 THEN {c} WHEN t < 3 THEN list_inner_product(h[t + 1], l_{c}[1:7])
        WHEN t >= n - 3 THEN list_inner_product(h[t - n + 8], l_{c}[n - 6:n]) ELSE list_inner_product(h[4], l_{c}[t - 2:t + 4]) END"""
    found["detect_savgol"] = f"""
        WITH {sm}, l AS (SELECT *, count(*) OVER w AS n, {hat} AS h, {', '.join(f'list({c}) OVER w AS l_{c}' for c in cols)} FROM sm {every})
        SELECT sample_id, t, {_greatest([f'abs({c} - {smooth.format(c=c)})' for c in cols])} FROM l"""

    a, b, c = cols
    distance = """(da * da * (1 - bc * bc) + db * db * (1 - ac * ac) + dc * dc * (1 - ab * ab)
        + 2 * da * db * (ac * bc - ab) + 2 * da * dc * (ab * bc - ac) + 2 * db * dc * (ab * ac - bc)) / (1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc)"""
    standard = ", ".join(f"({x} - avg({x}) OVER w) / stddev_samp({x}) OVER w AS d{k}" for k, x in zip("abc", cols, strict=True))
    pairs = ", ".join(f"corr({x}, {y}) OVER w AS {k}" for k, x, y in (("ab", a, b), ("ac", a, c), ("bc", b, c)))
    for name, form in (("mahalanobis", f"sqrt(greatest({distance}, 0))"), ("hotellingt2", f"greatest({distance}, 0)")):
        found[f"detect_{name}"] = f"""
            WITH {sm}, d AS (SELECT sample_id, t, {standard}, {pairs} FROM sm {whole})
            SELECT sample_id, t, round({form}, 6) + 0.0 AS score FROM d"""

    squares = " + ".join(f"(p.{x} - q.{x}) ^ 2" for x in cols)
    found["detect_kde"] = f"""
        WITH {sm}, k AS (SELECT p.sample_id, p.t, sum(exp(-0.5 * ({squares}))) AS s, count(*) AS n FROM sm p JOIN sm q USING (sample_id) GROUP BY 1, 2)
        SELECT sample_id, t, round(-(ln(s) - ln(n) - 0.5 * {len(cols)} * ln(2 * pi())), 6) + 0.0 AS score FROM k"""
    found["detect_norma"] = f"""
        WITH {sm}, k AS (SELECT p.sample_id, p.t, sum(0.01 * (1 - 0.01 * 1e-4) ^ (p.t - 1 - q.t) * exp(-0.1 * ({squares}))) AS s
            FROM sm p LEFT JOIN sm q ON p.sample_id = q.sample_id AND q.t < p.t GROUP BY 1, 2)
        SELECT sample_id, t, round(abs(coalesce(s, 0)), 6) + 0.0 AS score FROM k"""

    # what the kept frequencies make of the series: a sum over all rows, weighted by the sum of cosines of the kept bins
    found["detect_fft"] = f"""
        WITH {sm}, n AS (SELECT *, count(*) OVER w AS n, CAST(floor(count(*) OVER w * 0.1) AS BIGINT) AS k FROM sm {whole}),
        sizes AS (SELECT DISTINCT n, k FROM n), bins AS (SELECT n, unnest(range(0, k)) AS bin FROM sizes UNION SELECT n, unnest(range(n - k, n)) FROM sizes),
        lags AS (SELECT n, unnest(range(1 - n, n)) AS lag FROM sizes), waves AS (SELECT n, lag, sum(cos(2 * pi() * bin * lag / n)) / n AS v FROM lags JOIN bins USING (n) GROUP BY 1, 2),
        s AS (SELECT p.sample_id, p.t, {', '.join(f'any_value(p.{x}) AS {x}, sum(q.{x} * v) AS s_{x}' for x in cols)}
            FROM n p JOIN n q USING (sample_id) JOIN waves z ON z.n = p.n AND z.lag = p.t - q.t GROUP BY 1, 2)
        SELECT sample_id, t, round({_plain([f'abs({x} - s_{x})' for x in cols])}, 3) + 0.0 AS score FROM s"""

    rows = ", ".join(f"({x} - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS {x}" for x in cols)
    spread = f"sqrt((({') ^ 2 + ('.join(f'{x} - m' for x in cols)}) ^ 2) / {len(cols) - 1})"
    standard_rows = f"m AS (SELECT *, ({' + '.join(cols)}) / {len(cols)} AS m FROM sm), e AS (SELECT *, {spread} AS sd FROM m), z AS (SELECT sample_id, t, {rows} FROM e)"
    tails = ", ".join(f"-ln(cume_dist() OVER (PARTITION BY sample_id ORDER BY {x})) AS l_{x}, -ln(cume_dist() OVER (PARTITION BY sample_id ORDER BY -{x})) AS r_{x}, {x} - avg({x}) OVER (PARTITION BY sample_id) AS d_{x}" for x in cols)
    skews = ", ".join(f"sign(avg(d_{x} ^ 3) OVER w) AS k_{x}" for x in cols)
    terms = " + ".join(f"greatest(l_{x} * -sign(k_{x} - 1) + r_{x} * sign(k_{x} + 1), (l_{x} + r_{x}) / 2)" for x in cols)
    found["detect_copod"] = f"""
        WITH {sm}, {standard_rows}, u AS (SELECT sample_id, t, {tails} FROM z), k AS (SELECT *, {skews} FROM u {whole})
        SELECT sample_id, t, round({terms}, 6) + 0.0 AS score FROM k"""

    # 20 rows a block; the line is that through the blocks before and after, and a spectrum's norm that of the residual times the root of its length
    first = cols[0]
    found["detect_poly"] = f"""
        WITH {sm}, k AS (SELECT *, t // 20 AS k FROM sm), f AS (SELECT a.sample_id, a.k, regr_slope(b.{first}, b.t) AS s, regr_intercept(b.{first}, b.t) AS i, count(*) AS n
            FROM (SELECT DISTINCT sample_id, k FROM k) a JOIN k b ON a.sample_id = b.sample_id AND abs(a.k - b.k) = 1 GROUP BY 1, 2),
        e AS (SELECT sample_id, k, sqrt(count(*) * sum((k.{first} - (i + s * t)) ^ 2)) / count(*) AS e FROM k JOIN f USING (sample_id, k) WHERE n > 2 GROUP BY 1, 2)
        SELECT sample_id, t, round(coalesce(e, 0), 6) + 0.0 AS score FROM k LEFT JOIN e USING (sample_id, k)"""

    edges = ", ".join(f"min({x}) OVER w AS lo_{x}, (max({x}) OVER w - min({x}) OVER w) / 10 AS wd_{x}" for x in cols)
    places = ", ".join(f"least(9, greatest(0, CAST(ceil(({x} - lo_{x}) / wd_{x}) AS INTEGER) - 1)) AS b_{x}" for x in cols)
    heights = ", ".join(f"log2(count(*) OVER (PARTITION BY sample_id, b_{x}) / (n * wd_{x}) + 0.1) AS h_{x}" for x in cols)
    found["detect_hbos"] = f"""
        WITH {sm}, {standard_rows}, r AS (SELECT *, count(*) OVER w AS n, {edges} FROM z {whole}), b AS (SELECT *, {places} FROM r), h AS (SELECT *, {heights} FROM b)
        SELECT sample_id, t, round(-({' + '.join(f'h_{x}' for x in cols)}), 3) + 0.0 AS score FROM h"""

    scores = {
        "z": _plain([f"abs(({x} - avg({x}) OVER w) / (stddev_pop({x}) OVER w + 1e-8))" for x in cols]),
        "r": _plain([f"abs({x} - quantile_cont({x}, 0.5) OVER f)" for x in cols]),
    }
    away = ", ".join(f"abs({x} - quantile_cont({x}, 0.5) OVER w) AS {x}" for x in cols)
    found["detect_ensemble"] = f"""
        WITH {sm}, d AS (SELECT sample_id, t, {away} FROM sm {whole}),
        m AS (SELECT sample_id, t, {_plain([f'{x} / (quantile_cont({x}, 0.5) OVER w + 1e-8)' for x in cols])} AS m FROM d {whole}),
        b AS (SELECT sample_id, t, {scores['z']} AS z, {scores['r']} AS r FROM sm WINDOW w AS (PARTITION BY sample_id), f AS (PARTITION BY sample_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
        j AS (SELECT sample_id, t, z, m, r FROM b JOIN m USING (sample_id, t)),
        s AS (SELECT sample_id, t, ({' + '.join(f"coalesce(({x} - min({x}) OVER w) / nullif(max({x}) OVER w - min({x}) OVER w, 0), 0)" for x in "zmr")}) / 3 AS score FROM j {whole})
        SELECT sample_id, t, round(score, 6) + 0.0 AS score, score > avg(score) OVER w + 3 * stddev_pop(score) OVER w AS is_outlier FROM s {whole}"""
    return found


def _plain(parts: Sequence[str]) -> str:
    return f"greatest({', '.join(parts)})"


def repairs(ev: str, linear: str) -> dict[str, str]:
    """ev: the CTE of the users' series; linear: that of its line fill (x)."""
    found = {}
    near = " + ".join(["coalesce(lag(x, 2) OVER o, first_value(x) OVER o)", "coalesce(lag(x, 1) OVER o, first_value(x) OVER o)", "x", "coalesce(lead(x, 1) OVER o, last_value(x) OVER e)", "coalesce(lead(x, 2) OVER o, last_value(x) OVER e)"])
    found["repair_missing_moving_average"] = f"""
        WITH {ev}, {linear}, j AS (SELECT sample_id, t, x, col_1 FROM lin JOIN ev USING (sample_id, t)),
        m AS (SELECT *, ({near}) / 5 AS m, min(col_1) OVER e AS lo, max(col_1) OVER e AS hi
            FROM j WINDOW o AS (PARTITION BY sample_id ORDER BY t), e AS (PARTITION BY sample_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
        SELECT sample_id, t, round(coalesce(col_1, CASE WHEN lo IS NULL THEN x ELSE greatest(lo, least(hi, m)) END), 6) + 0.0 AS col_1 FROM m"""
    found["repair_missing_ar"] = f"""
        WITH {ev}, {linear}, j AS (SELECT sample_id, t, x, col_1, lag(x) OVER (PARTITION BY sample_id ORDER BY t) AS p FROM lin JOIN ev USING (sample_id, t)),
        m AS (SELECT *, regr_slope(x, p) OVER w AS s, regr_intercept(x, p) OVER w AS i, min(col_1) OVER w AS lo, max(col_1) OVER w AS hi FROM j WINDOW w AS (PARTITION BY sample_id))
        SELECT sample_id, t, round(coalesce(col_1, CASE WHEN lo IS NULL OR p IS NULL THEN x ELSE greatest(lo, least(hi, i + s * p)) END), 6) + 0.0 AS col_1 FROM m"""
    found["repair_akane"] = f"WITH {ev}, {linear} SELECT sample_id, t, round(x, 6) + 0.0 AS col_1 FROM lin"
    found["repair_exponential_smoothing"] = f"""
        WITH {ev}, n AS (SELECT sample_id, t, clean_1 AS y, coalesce(lag(clean_1) OVER o, clean_1) AS a, coalesce(lead(clean_1) OVER o, clean_1) AS b FROM ev WINDOW o AS (PARTITION BY sample_id ORDER BY t)),
        m AS (SELECT sample_id, t, list_median([a, y, b]) AS m FROM n),
        s AS (SELECT *, list(m) OVER (PARTITION BY sample_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM m)
        SELECT sample_id, t, round(CASE WHEN t = 0 THEN m ELSE list_reduce(l, lambda s, x: 0.5 * x + 0.5 * s) END + 1e-9, 6) + 0.0 AS col_1 FROM s"""
    found["impute_ewma"] = f"""
        WITH {ev}, l AS (SELECT sample_id, t, list(col_1) FILTER (col_1 IS NOT NULL) OVER (PARTITION BY sample_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS l,
            first_value(col_1 IGNORE NULLS) OVER (PARTITION BY sample_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f FROM ev)
        SELECT sample_id, t, round(CASE WHEN coalesce(len(l), 0) = 0 THEN f ELSE list_reduce(l, lambda s, x: x / 3 + s * 2 / 3) END, 6) + 0.0 AS col_1 FROM l"""
    for name, window in (("screen", 5), ("speed_local", 50)):
        found[f"repair_constraint_{name}"] = f"""
            WITH {ev}, {_middles(window)},
            l AS (SELECT sample_id, t, list(struct_pack(m := m, d := d, o := y)) OVER (PARTITION BY sample_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS l FROM c)
            SELECT sample_id, t, round(list_reduce(l, lambda a, x: struct_pack(m := x.m, d := x.d, o := least(greatest(x.m, a.o - 0.01 * x.d), a.o + 0.01 * x.d))).o, 6) + 0.0 AS col_1 FROM l"""
    # with acceleration: v is the speed of the step before, none at first
    low, high = "a.o - 0.01 * x.d", "a.o + 0.01 * x.d"
    slow, fast = f"greatest({low}, a.o + (a.v - 0.001 * x.d) * x.d)", f"least({high}, a.o + (a.v + 0.001 * x.d) * x.d)"
    both = f"a.v IS NOT NULL AND {slow} <= {fast}"
    to = f"least(greatest(x.m, CASE WHEN {both} THEN {slow} ELSE {low} END), CASE WHEN {both} THEN {fast} ELSE {high} END)"
    for name, window in (("speedacc", 5), ("speed_accel_local", 50)):
        found[f"repair_constraint_{name}"] = f"""
            WITH {ev}, {_middles(window)},
            l AS (SELECT sample_id, t, list(struct_pack(m := m, d := d, o := y, v := CAST(NULL AS DOUBLE))) OVER (PARTITION BY sample_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS l FROM c)
            SELECT sample_id, t, round(list_reduce(l, lambda a, x: struct_pack(m := x.m, d := x.d, o := {to}, v := ({to} - a.o) / x.d)).o, 6) + 0.0 AS col_1 FROM l"""
    return found


def _middles(window: int) -> str:
    """CTEs up to c: of each row y, d (time since the row before) and m, the median of itself and of what later rows within the window allow at a speed of 0.01."""
    return f"""b AS (SELECT sample_id, t, timestamp, clean_1 AS y, greatest(CAST(timestamp - lag(timestamp) OVER (PARTITION BY sample_id ORDER BY t) AS DOUBLE), 1e-8) AS d FROM ev),
        k AS (SELECT sample_id, t, y AS v FROM b UNION ALL SELECT p.sample_id, p.t, q.y + unnest([-0.01, 0.01]) * (q.timestamp - p.timestamp) FROM b p JOIN b q ON p.sample_id = q.sample_id AND q.t > p.t AND q.timestamp <= p.timestamp + {window}),
        g AS (SELECT sample_id, t, median(v) AS m FROM k GROUP BY 1, 2), c AS (SELECT sample_id, t, y, d, m FROM b JOIN g USING (sample_id, t))"""
