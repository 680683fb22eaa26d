"""Model queries: what SQL can solve in closed form, and those checked by tests."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import linear as M
from ..operators import logistic, ordered, smooth, subspace
from ..operators.gram import gram
from .registry import query, table
from .statistics import _SCORED, scored_rows

_SUMS = "SELECT count(*) AS n, sum(y) AS sy, sum(a) AS sa, sum(b) AS sb, sum(y * y) AS yy, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS by_ FROM (SELECT l_extendedprice / 1000 AS y, l_quantity AS a, l_discount AS b FROM lineitem)"
_CENTRED = f"SELECT n, sy / n AS my, sa / n AS ma, sb / n AS mb, yy - sy * sy / n AS yy, aa - sa * sa / n AS aa, bb - sb * sb / n AS bb, ab - sa * sb / n AS ab, ay - sa * sy / n AS ay, by_ - sb * sy / n AS by_ FROM ({_SUMS})"
_OLS = f"SELECT *, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS b1, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS b2 FROM ({_CENTRED})"


def _line(spark, sf):
    cols = {"y": F.col("l_extendedprice") / 1000, "a": F.col("l_quantity"), "b": F.col("l_discount")}
    return table(spark, sf, "lineitem"), cols


@query(f"SELECT n, round(my - b1 * ma - b2 * mb, 5) AS b0, round(b1, 6) AS b1, round(b2, 4) AS b2, round((b1 * ay + b2 * by_) / yy, 8) AS r2 FROM ({_OLS})")
def ols_two_feature(spark, sf):
    df, cols = _line(spark, sf)
    f = M.fit(gram(df, cols), "y", ["a", "b"])
    return spark.createDataFrame([(int(f.n), round(float(f.beta[0]), 5), round(float(f.beta[1]), 6), round(float(f.beta[2]), 4), round(f.r2, 8))], "n long, b0 double, b1 double, b2 double, r2 double")


@query(f"SELECT round(rss / n, 5) AS mse, round(1 - (rss / (n - 3)) / (yy / (n - 1)), 8) AS adjusted, round(n * ln(rss / n) + 2 * 4 * n / (n - 5.0), 2) AS aicc, round(((yy - ay * ay / aa - rss) / 1) / (rss / (n - 3)), 4) AS f_b FROM (SELECT *, yy - b1 * ay - b2 * by_ AS rss FROM ({_OLS}))")
def ols_tests(spark, sf):
    df, cols = _line(spark, sf)
    g = gram(df, cols)
    f = M.fit(g, "y", ["a", "b"])
    return spark.createDataFrame([(round(f.rss / f.n, 5), round(f.adjusted_r2, 8), round(f.aicc, 2), round(M.partial_f(g, "y", ["a"], ["b"]).f, 4))], "mse double, adjusted double, aicc double, f_b double")


_EST = "SELECT o_totalprice / 1000 AS y, o_custkey / 100.0 AS x, o_orderkey % 5 <> 0 AS est, o_orderkey % 4 AS fold FROM orders"


@query(f"""WITH d AS ({_EST}), s AS (SELECT avg(x) AS mx, avg(y) AS my, sum(x * y) - count(*) * avg(x) * avg(y) AS sxy, sum(x * x) - count(*) * avg(x) * avg(x) AS sxx, sum(y * y) - count(*) * avg(y) * avg(y) AS syy FROM d WHERE est)
SELECT round((SELECT syy - sxy * sxy / sxx FROM s) / 1e6, 5) AS rss, round(sum(pow(y - my - sxy / sxx * (x - mx), 2)) / 1e6, 5) AS cvss FROM d, s WHERE NOT est""")
def validated_cvss(spark, sf):
    cols = {"y": F.col("o_totalprice") / 1000, "x": F.col("o_custkey") / 100.0}
    f, cvss = M.validated(table(spark, sf, "orders"), "y", ["x"], cols, F.col("o_orderkey") % 5 != 0)
    return spark.createDataFrame([(round(f.rss / 1e6, 5), round(cvss / 1e6, 5))], "rss double, cvss double")


@query(f"""WITH d AS ({_EST}), s AS (SELECT f, avg(x) AS mx, avg(y) AS my, sum(x * y) - count(*) * avg(x) * avg(y) AS sxy, sum(x * x) - count(*) * avg(x) * avg(x) AS sxx FROM d, range(4) r(f) WHERE fold <> f GROUP BY f)
SELECT CAST(1 AS BIGINT) AS terms, round(sum(pow(y - my - sxy / sxx * (x - mx), 2)) / 1e6, 5) AS cvss FROM d JOIN s ON fold = f UNION ALL SELECT 0, round(sum(pow(y - my, 2)) / 1e6, 5) FROM d JOIN s ON fold = f""")
def kfold_cvss(spark, sf):
    cols = {"y": F.col("o_totalprice") / 1000, "x": F.col("o_custkey") / 100.0}
    rows = M.cross_validated(table(spark, sf, "orders"), "y", ["x"], cols, F.col("o_orderkey") % 4)
    return spark.createDataFrame([(r["terms"], round(r["cvss"] / 1e6, 5)) for r in rows], "terms long, cvss double")


@query(f"""WITH f AS ({_OLS}), e AS (SELECT l_extendedprice / 1000 - (my - ay / aa * ma) - ay / aa * l_quantity AS e, l_discount - mb - ab / aa * (l_quantity - ma) AS z FROM lineitem, f)
SELECT round(pow(sum(e * z), 2) / sum(e * e * z * z), 5) AS f FROM e""")
def white_f(spark, sf):
    df, cols = _line(spark, sf)
    t = M.white_f(df, gram(df, cols), "y", ["a"], ["b"], cols)
    return spark.createDataFrame([(round(t.f, 5),)], "f double")


@query("SELECT s, round(sum(v), 2) AS total FROM (SELECT 'interaction' AS s, (l_quantity - (SELECT avg(l_quantity) FROM lineitem)) * (l_tax - (SELECT avg(l_tax) FROM lineitem)) * l_discount AS v FROM lineitem UNION ALL SELECT 'cube', pow(l_quantity - (SELECT avg(l_quantity) FROM lineitem), 3) / 1000 FROM lineitem) GROUP BY s")
def interaction_centered(spark, sf):
    from ..plans.features import base_features, interaction, power_of

    df = table(spark, sf, "lineitem")
    q, t = base_features(df, ["l_quantity", "l_tax"])
    out = df.agg(F.round(F.sum(interaction(q, t).column * F.col("l_discount")), 2).alias("a"), F.round(F.sum(power_of(q, 3).column / 1000), 2).alias("b"))
    return out.select(F.inline(F.array(F.struct(F.lit("interaction").alias("s"), F.col("a").alias("total")), F.struct(F.lit("cube").alias("s"), F.col("b").alias("total")))))


@query("SELECT c_custkey, round(1.5 + 2.0 * c_acctbal / 1000 - 0.5 * c_nationkey, 6) AS v FROM customer")
def linear_combination(spark, sf):
    from ..plans.features import base_features, linear_combination as combined

    df = table(spark, sf, "customer")
    f = combined("mix", 1.5, [0.002, -0.5], base_features(df, ["c_acctbal", "c_nationkey"]))
    return df.select("c_custkey", F.round(f.column, 6).alias("v"))


def _labelled(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d, (F.col("quality") == 1).cast("double"), {"chars": F.col("n_chars") / 10000, "toxic": F.col("toxic").cast("double")}


def _newton(steps: int) -> str:
    """Newton steps of a logistic regression on a and b, written out."""
    out = """WITH d AS MATERIALIZED (SELECT CAST(quality = 1 AS DOUBLE) AS y, n_chars / 10000 AS a, CAST(toxic AS DOUBLE) AS b FROM documents JOIN labels USING (doc_id)), t0 AS (SELECT 0e0 AS b0, 0e0 AS b1, 0e0 AS b2)"""
    for k in range(steps):
        out += f""", s{k} AS MATERIALIZED (SELECT any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, sum(w) AS c, sum(w * a) AS e, sum(w * b) AS f, sum(w * a * a) AS g, sum(w * a * b) AS h, sum(w * b * b) AS i, sum(r) AS u, sum(r * a) AS v, sum(r * b) AS z FROM (SELECT *, p * (1 - p) AS w, y - p AS r FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * a + b2 * b))) AS p FROM d, t{k}))),
q{k} AS (SELECT *, g * i - h * h AS ca, f * h - e * i AS cb, e * h - f * g AS cc, c * i - f * f AS cd, e * f - c * h AS ce, c * g - e * e AS cf, c * (g * i - h * h) - e * (e * i - f * h) + f * (e * h - f * g) AS det FROM s{k}),
t{k + 1} AS MATERIALIZED (SELECT b0 + (ca * u + cb * v + cc * z) / det AS b0, b1 + (cb * u + cd * v + ce * z) / det AS b1, b2 + (cc * u + ce * v + cf * z) / det AS b2 FROM q{k})"""
    k = steps - 1
    return out + f" SELECT '1' AS term, round(b0, 5) AS beta, round(sqrt(ca / det), 5) AS se FROM q{k} UNION ALL SELECT 'chars', round(b1, 4), round(sqrt(cd / det), 4) FROM q{k} UNION ALL SELECT 'toxic', round(b2, 5), round(sqrt(cf / det), 5) FROM q{k}"


@query(_newton(14))
def logistic_irls(spark, sf):
    d, y, cols = _labelled(spark, sf)
    m = logistic.irls(d, y, cols)
    return spark.createDataFrame([(t, round(float(b), 4 if t == "chars" else 5), round(float(s), 4 if t == "chars" else 5)) for t, b, s in zip(["1", *cols], m["beta"], m["errors"])], "term string, beta double, se double")


@query()
def logistic_screens(spark, sf):
    """What screens, bounds and the likelihood say of four candidates."""
    d, y, cols = _labelled(spark, sf)
    more = cols | {"long": (F.col("n_chars") > 3000).cast("double"), "tenth": (F.col("doc_id") % 10).cast("double")}
    model = logistic.Screened(d, y)
    model.consider(more, 0.05)
    return spark.createDataFrame(model.log, "term string, stage string, statistic double, p double, kept boolean")


@query()
def logistic_tests(spark, sf):
    d, y, cols = _labelled(spark, sf)
    small = logistic.irls(d, y, {"chars": cols["chars"]})
    g2, p = logistic.likelihood_ratio(logistic.irls(d, y, cols), small)
    s, q = logistic.score_test(d, y, {"chars": cols["chars"]}, small["beta"], cols["toxic"])
    return spark.createDataFrame([(float(g2), float(p), float(s), float(q))], "g2 double, p double, score double, score_p double")


@query("""WITH d AS (SELECT CAST(l_returnflag = 'R' AS DOUBLE) AS y, l_quantity AS a, l_discount AS z FROM lineitem), s AS (SELECT avg(y) AS my, avg(a) AS ma, avg(z) AS mz, covar_pop(y, a) / var_pop(a) AS by_, covar_pop(z, a) / var_pop(a) AS bz FROM d),
r AS (SELECT y, greatest(1e-11, least(1 - 1e-11, my + by_ * (a - ma))) AS mu, z - mz - bz * (a - ma) AS r FROM d, s), q AS (SELECT abs(sum(r * (y - mu))) / sqrt(sum(r * r * mu * (1 - mu))) AS t, max(abs(r) * greatest(mu, 1 - mu)) / sqrt(sum(r * r * mu * (1 - mu))) AS m FROM r)
SELECT round(t, 6) AS t, round(least(1, 2 * exp(t / m - (t / m + 1 / (m * m)) * ln(1 + m * t))), 6) AS p FROM q""")
def bennett_test(spark, sf):
    d = table(spark, sf, "lineitem")
    cols = {"y": (F.col("l_returnflag") == "R").cast("double"), "a": F.col("l_quantity"), "z": F.col("l_discount")}
    t, p = M.bennett(d, gram(d, cols), "y", ["a"], "z", cols)
    return spark.createDataFrame([(round(t, 6), round(p, 6))], "t double, p double")


def _signal():
    """A response that quantity and discount tell something of, and the columns."""
    return {"y": F.col("l_extendedprice") / 1000 + F.col("l_quantity") + 100 * F.col("l_discount"), "q": F.col("l_quantity"), "d": F.col("l_discount"), "t": F.col("l_tax")}


_CROSS = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, sum((v[{i + 1}] - m[{i + 1}]) * (v[{j + 1}] - m[{j + 1}])) AS v FROM d, a" for i in range(5) for j in range(5))


def _sweeps(steps: int) -> str:
    """Greedy choice by F and sweeping, written out step by step."""
    out = f"""WITH d AS (SELECT [l_extendedprice / 1000 + l_quantity + 100 * l_discount, l_quantity, l_discount, l_tax, l_quantity * l_discount] AS v FROM lineitem),
a AS (SELECT count(*) AS n, [avg(v[1]), avg(v[2]), avg(v[3]), avg(v[4]), avg(v[5])] AS m FROM d), x0 AS MATERIALIZED ({_CROSS})"""
    for k in range(steps):
        taken = "".join(f" AND i NOT IN (SELECT i FROM b{t})" for t in range(k))
        out += f""", b{k} AS MATERIALIZED (SELECT i, f FROM (SELECT p.i, p.v * p.v / d.v / ((y.v - p.v * p.v / d.v) / (n - {k + 2})) AS f FROM x{k} p JOIN x{k} d ON d.i = p.i AND d.j = p.i JOIN x{k} y ON y.i = 0 AND y.j = 0, a WHERE p.j = 0 AND p.i > 0{taken.replace(" i NOT", " p.i NOT")}) ORDER BY f DESC LIMIT 1),
x{k + 1} AS MATERIALIZED (SELECT m.i, m.j, CASE WHEN m.i = b.i AND m.j = b.i THEN -1 / d.v WHEN m.i = b.i OR m.j = b.i THEN m.v / d.v ELSE m.v - r.v * c.v / d.v END AS v
  FROM x{k} m, b{k} b JOIN x{k} d ON d.i = b.i AND d.j = b.i JOIN x{k} r ON r.i = b.i JOIN x{k} c ON c.j = b.i WHERE r.j = m.j AND c.i = m.i)"""
    return out + " " + " UNION ALL ".join(f"SELECT {k} AS place, (['q', 'd', 't', 'qd'])[i] AS term, round(f, 2) AS f, f > 2 * ln(4) AS passed FROM b{k}" for k in range(steps))


@query(_sweeps(3))
def stepwise_terms(spark, sf):
    d = table(spark, sf, "lineitem")
    cols = _signal() | {"qd": F.col("l_quantity") * F.col("l_discount")}
    steps = M.stepwise(gram(d, cols), "y", ["q", "d", "t", "qd"], add=3)
    return spark.createDataFrame([(i, s.term, round(float(s.f), 2), s.passed) for i, s in enumerate(steps)], "place int, term string, f double, passed boolean")


_FITS = " UNION ALL ".join(f"SELECT '{c}' AS term, count(*) AS n, pow(corr({x}, l_extendedprice / 1000 + l_quantity + 100 * l_discount), 2) AS c2 FROM lineitem" for c, x in (("q", "l_quantity"), ("d", "l_discount"), ("t", "l_tax")))


@query(f"""SELECT term, round((n - 1) * r - log2(3) - CASE WHEN k > 0 THEN 1 ELSE 0 END - log2((1 + k * k) * 1.07667), 3) AS gain FROM (SELECT term, n, -ln(1 - c2) / (2 * ln(2)) AS r, round_even(sqrt((n - 2) * c2 / (1 - c2)), 0) AS k FROM ({_FITS}))
WHERE (n - 1) * r - log2(3) - CASE WHEN k > 0 THEN 1 ELSE 0 END - log2((1 + k * k) * 1.07667) > 0""")
def rated_candidates(spark, sf):
    d = table(spark, sf, "lineitem")
    cols = _signal()
    return spark.createDataFrame([(c, round(float(s), 3)) for c, s in M.rate(gram(d, cols), "y", [], ["q", "d", "t"])], "term string, gain double")


_FAR = "SELECT l_linenumber + l_discount + 1e9 AS x, 2 * l_linenumber + l_quantity / 50 + 1e9 AS y, l_tax * 1e-6 + 1e3 AS z FROM lineitem"


@query(f"""WITH d AS (SELECT x - 1e9 AS x, y - 1e9 AS y, (z - 1e3) * 1e6 AS z FROM ({_FAR})), s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, covar_pop(x, z) AS xz, var_pop(x) AS xx, var_pop(z) AS zz, var_pop(y) AS yy FROM d),
b AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS b1, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS b2 FROM s)
SELECT CAST(n AS DOUBLE) AS n, round(b1, 5) AS slope_x, round(b2, 3) AS slope_z, round((b1 * xy + b2 * zy) / yy, 6) AS r2 FROM b""")
def far_columns_fit(spark, sf):
    """A fit of columns that lie far from zero, by a tree of triangular factors."""
    df = table(spark, sf, "lineitem")
    cols = {"x": F.col("l_linenumber") + F.col("l_discount") + 1e9, "y": 2 * F.col("l_linenumber") + F.col("l_quantity") / 50 + 1e9, "z": F.col("l_tax") * 1e-6 + 1e3}
    f = M.fit_rows(df, "y", ["x", "z"], cols)
    return spark.createDataFrame([(float(f.n), round(float(f.beta[1]), 5), round(float(f.beta[2]) / 1e6, 3), round(f.r2, 6))], "n double, slope_x double, slope_z double, r2 double")


_RATERS = " UNION ALL ".join(f"""SELECT '{c}' AS term, rcp / ss AS b, ss, sqrt(rss / n / ss) AS plain, sqrt(ws) / ss AS white
FROM (SELECT count(*) AS n, sum(e * z) AS rcp, sum(z * z) AS ss, sum(e * e) AS rss, sum(e * e * z * z) AS ws FROM (SELECT l_extendedprice / 1000 - avg(l_extendedprice / 1000) OVER () AS e, {x} - avg({x}) OVER () AS z FROM lineitem))""" for c, x in (("a", "l_quantity"), ("b", "l_discount"), ("t", "l_tax")))
_BOUND = "greatest(0, abs(b) - 1.959963984540054 * {0})"


@query(f"SELECT term, round(pow({_BOUND.format('plain')}, 2) * ss, 3) AS plain, round(pow({_BOUND.format('white')}, 2) * ss, 3) AS white FROM ({_RATERS})")
def rater_bounds(spark, sf):
    df, cols = _line(spark, sf)
    cols["t"] = F.col("l_tax")
    g, terms = gram(df, cols), ["a", "b", "t"]
    plain = dict(M.rate(g, "y", [], terms, "stepwise"))
    white = dict(M.rate(g, "y", [], terms, "stepwise", weighted=M.weighted_squares(df, g, "y", [], terms, cols)))
    return spark.createDataFrame([(t, round(plain.get(t, 0.0), 3), round(white.get(t, 0.0), 3)) for t in terms], "term string, plain double, white double")


_SE = f"SELECT *, (yy - b1 * ay - b2 * by_) / (n - 3) AS s2, aa * bb - ab * ab AS det FROM ({_OLS})"


@query(f"""SELECT term, round(b, 5) AS estimate, round(se, 7) AS error, round(b / se, 4) AS t FROM (SELECT 'Intercept' AS term, my - b1 * ma - b2 * mb AS b, sqrt(s2 * (1.0 / n + (ma * ma * bb - 2 * ma * mb * ab + mb * mb * aa) / det)) AS se FROM ({_SE})
UNION ALL SELECT 'a', b1, sqrt(s2 * bb / det) FROM ({_SE}) UNION ALL SELECT 'b', b2, sqrt(s2 * aa / det) FROM ({_SE}))""")
def model_report(spark, sf):
    df, cols = _line(spark, sf)
    rows = M.coefficients(M.fit(gram(df, cols), "y", ["a", "b"]))
    return spark.createDataFrame([(n, round(b, 5), round(e, 7), round(t, 4)) for n, b, e, t, _ in rows], "term string, estimate double, error double, t double")


_INV = f"""f AS ({_SE}), e AS (SELECT l_orderkey, l_quantity - ma AS a, l_discount - mb AS b, (l_extendedprice / 1000 - my) - b1 * (l_quantity - ma) - b2 * (l_discount - mb) AS e FROM lineitem, f),
u AS (SELECT e * (bb * a - ab * b) / det AS u1, e * (aa * b - ab * a) / det AS u2, floor(l_orderkey / 10) AS block, l_orderkey FROM e, f)"""


@query(f"""WITH {_INV}, w AS (SELECT sum(u1 * u1) AS w1, sum(u2 * u2) AS w2 FROM u), k AS (SELECT sum(s1 * s1) AS k1, sum(s2 * s2) AS k2 FROM (SELECT sum(u1) AS s1, sum(u2) AS s2 FROM u GROUP BY block))
SELECT 'a' AS term, round(sqrt(s2 * bb / det), 8) AS ols, round(sqrt(w1), 8) AS white, round(sqrt(k1), 8) AS block FROM f, w, k UNION ALL SELECT 'b', round(sqrt(s2 * aa / det), 5), round(sqrt(w2), 5), round(sqrt(k2), 5) FROM f, w, k""")
def sandwich_errors(spark, sf):
    df, cols = _line(spark, sf)
    f = M.fit(gram(df, cols), "y", ["a", "b"])
    e, w, b = f.errors(), M.sandwich_errors(df, f, cols), M.sandwich_errors(df, f, cols, F.floor(F.col("l_orderkey") / 10))
    return spark.createDataFrame([(t, *(round(float(x[i]), d) for x in (e, w, b))) for i, t, d in ((1, "a", 8), (2, "b", 5))], "term string, ols double, white double, block double")


_PAV = f"""WITH g AS (SELECT p AS x, count(*) AS n, sum(y) AS total FROM {_SCORED} GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY x) AS i FROM g), c AS (SELECT *, sum(n) OVER (ORDER BY i) AS cn, sum(total) OVER (ORDER BY i) AS ct FROM o),
m AS (SELECT a.i AS a, b.i AS b, min((b.ct - a.ct + a.total) / CAST(b.cn - a.cn + a.n AS DOUBLE)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS low FROM c a JOIN c b ON a.i <= b.i), f AS (SELECT b AS i, round(max(low), 9) AS mean FROM m GROUP BY 1)"""


def _pooled(spark, sf):
    return ordered.pooled(scored_rows(spark, sf).groupBy(F.col("p").alias("x")).agg(F.count("*").alias("n"), F.sum("y").alias("total")))


@query(f"{_PAV} SELECT round(max(x), 9) AS boundary, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(total) AS DOUBLE) AS total, mean FROM f JOIN o USING (i) GROUP BY mean")
def pav_cells(spark, sf):
    return _pooled(spark, sf).select(F.round("boundary", 9).alias("boundary"), "n", "total", F.round("mean", 9).alias("mean"))


@query(f"{_PAV} SELECT doc_id, mean AS calibrated FROM {_SCORED} s JOIN o ON s.p = o.x JOIN f USING (i)")
def calibrated_scores(spark, sf):
    return ordered.calibrated(scored_rows(spark, sf), "p", _pooled(spark, sf)).select("doc_id", F.round("calibrated", 9).alias("calibrated"))


@query()
def spline_fit(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", smooth.smoothing_spline(e, "event_id", "value", 5).column(F.col("event_id").cast("double")).alias("fit"))


_BASIS = "b AS (SELECT doc_id, y, CASE WHEN abs(z) < 1 THEN pow(1 - z * z, 2) ELSE 0 END AS k0, z FROM (SELECT doc_id, CAST(y AS DOUBLE) AS y, (p - 0.5) * 2 AS z FROM " + _SCORED + "))"


@query(f"""WITH {_BASIS}, r AS (SELECT doc_id, y, k0 AS p, k0 * z AS q, k0 * z * z AS r FROM b), m AS (SELECT avg(y) AS my, avg(p) AS mp, avg(q) AS mq, avg(r) AS mr FROM r),
s AS (SELECT sum((p - mp) * (p - mp)) AS a, sum((p - mp) * (q - mq)) AS b, sum((p - mp) * (r - mr)) AS c, sum((q - mq) * (q - mq)) AS d, sum((q - mq) * (r - mr)) AS e, sum((r - mr) * (r - mr)) AS f, sum((p - mp) * (y - my)) AS u, sum((q - mq) * (y - my)) AS v, sum((r - mr) * (y - my)) AS w FROM r, m),
x AS (SELECT (u * (d * f - e * e) - v * (b * f - c * e) + w * (b * e - c * d)) / det AS b1, (-u * (b * f - c * e) + v * (a * f - c * c) - w * (a * e - b * c)) / det AS b2, (u * (b * e - c * d) - v * (a * e - b * c) + w * (a * d - b * b)) / det AS b3 FROM (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM s))
SELECT doc_id, round(my + b1 * (p - mp) + b2 * (q - mq) + b3 * (r - mr), 6) AS fit FROM r, m, x""")
def biweight_fit(spark, sf):
    s = scored_rows(spark, sf)
    basis = {f"b{i}": c for i, c in enumerate(smooth.biweight_basis((F.col("p") - 0.5) * 2, 3)[1:])}
    f = M.fit(gram(s, {"y": F.col("y").cast("double"), **basis}), "y", list(basis))
    return s.select("doc_id", F.round(f.predict(basis), 6).alias("fit"))


def _vectors(spark, sf, k=64):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", *(F.get("embedding", i).cast("double").alias(f"v{i}") for i in range(k))), {f"v{i}": F.col(f"v{i}") for i in range(k)}


@query()
def pca_loadings(spark, sf):
    df, cols = _vectors(spark, sf)
    p = subspace.pca(df, cols, 3)
    return spark.createDataFrame([(n, j, float(p["loadings"][i, j]), float(p["values"][j])) for i, n in enumerate(p["names"]) for j in range(3)], "name string, component int, loading double, variance double")


@query()
def pca_scores(spark, sf):
    df, cols = _vectors(spark, sf)
    return subspace.projected(df, cols, subspace.pca(df, cols, 3)).select("vec_id", "pc0", "pc1", "pc2")


@query()
def kernel_components(spark, sf):
    df, cols = _vectors(spark, sf)
    return subspace.kernel_components(df, "vec_id", list(cols), 3)


@query()
def kernel_gaps(spark, sf):
    """Eigenvalues of the kernel of all vectors' first components, and which of them stand apart."""
    df, cols = _vectors(spark, sf, 8)
    values = subspace.kernel_values(df, "vec_id", list(cols), 12, "quadratic")
    gaps = set(subspace.eigen_gaps(values, 0.95, 1e-3))
    return spark.createDataFrame([(i, float(v), i in gaps) for i, v in enumerate(values)], "place int, value double, apart boolean")


@query()
def randomized_svd(spark, sf):
    df, cols = _vectors(spark, sf)
    s, _ = subspace.randomized_svd(df, cols, 5)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(s)], "place int, singular double")


@query()
def rotated_loadings(spark, sf):
    df, cols = _vectors(spark, sf)
    turned = subspace.varimax(subspace.pca(df, cols, 3)["loadings"])
    return spark.createDataFrame([(n, *map(float, r)) for n, r in zip(cols, turned)], "name string, f0 double, f1 double, f2 double")


@query()
def gram_80(spark, sf):
    """Cross-products of 80 columns in one pass, as a fit."""
    df = table(spark, sf, "lineitem")
    base = [F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_linenumber") / 7]
    cols = {f"x{i}": base[i % 4] * (base[(i // 4) % 4] if i > 3 else 1.0) + F.sin(F.col("l_partkey") * (i + 1)) for i in range(80)}
    f = M.fit(gram(df, {"y": F.col("l_extendedprice") / 1000, **cols}), "y", list(cols))
    return spark.createDataFrame([(x, float(b), float(math.sqrt(max(s, 0)))) for x, b, s in zip(["1", *f.xs], f.beta, f.errors() ** 2)], "term string, beta double, se double")
