"""Ordered, sampling and reshaping-by-order queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered as W
from ..operators import sample as O
from ..operators import series as L
from .registry import query, table

_H = "(o_orderkey * 2654435761) % 4294967296"


@query("SELECT event_id, CASE WHEN row_number() OVER w > 2 THEN lag(value, 2) OVER w ELSE first_value(value) OVER w END AS lag2, value - lag(value) OVER w AS diff FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag_first_fill(spark, sf):
    order = ["ts", "event_id"]
    return table(spark, sf, "events").select("event_id", W.lag_first("value", order, ["user_id"], 2).alias("lag2"), W.difference("value", order, ["user_id"]).alias("diff"))


@query("SELECT o_orderkey, [10, 20, 30][(o_orderkey % 3) + 1] AS cyc, o_orderkey % 5 AS per, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place FROM orders")
def cyclic_and_order(spark, sf):
    values = F.array(*map(F.lit, [10, 20, 30]))
    return table(spark, sf, "orders").select("o_orderkey", W.cyclic(values, F.col("o_orderkey")).alias("cyc"), W.periodic(F.col("o_orderkey"), 5).alias("per"), W.ordering("o_totalprice", ["o_custkey"], True, "o_orderkey").cast("long").alias("place"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row FROM orders")
def global_row_numbers(spark, sf):
    return W.row_numbers(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.col("row").cast("long").alias("row"))


@query("SELECT round(sum(u * u), 2) AS u, round(sum(v * v), 2) AS v FROM (SELECT sum(value - 50) AS u, sum((value - 50) * (user_id % 5)) AS v FROM events GROUP BY event_id // 10)")
def block_white_sums(spark, sf):
    x = F.col("value") - 50
    return W.block_sums(table(spark, sf, "events"), "event_id", 10, {"u": x, "v": x * (F.col("user_id") % 5)}).select(F.round("u", 2).alias("u"), F.round("v", 2).alias("v"))


@query("SELECT user_id, count(*) AS n, min(ts) AS first, arg_min(value, ts) AS opening, len(list(value)) AS size, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stack_series(spark, sf):
    s = W.stacked(table(spark, sf, "events"), "user_id", "ts", "value")
    return s.select("user_id", "n", "first", "opening", F.size("values").cast("long").alias("size"), F.round(F.aggregate("values", F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


@query(f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_H}, o_orderkey LIMIT 500")
def exact_sample(spark, sf):
    return O.exact_sample(table(spark, sf, "orders"), "o_orderkey", 500).select("o_orderkey", "o_totalprice")


@query(f"SELECT o_orderkey, CAST(row_number() OVER (ORDER BY {_H}, o_orderkey) <= 300 AS INT) AS selected FROM orders")
def exact_indicator(spark, sf):
    return O.indicator(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 300)


@query(f"SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_H}, o_orderkey) <= 40 AS INT) AS selected FROM orders")
def balanced_indicator(spark, sf):
    return O.balanced_indicator(table(spark, sf, "orders"), "o_orderkey", "o_orderpriority", 40).select("o_orderkey", "selected")


@query(f"SELECT o_orderkey, CAST(o_orderkey % 5 AS INT) AS fold, CAST(((o_orderkey * 2654435761 + 26612 * 2654435761) % 4294967296 // 65536) % 5 AS INT) AS shuffled, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS run FROM orders")
def fold_assign(spark, sf):
    o = table(spark, sf, "orders")
    o = O.folds(O.folds(o, "o_orderkey", 5), "o_orderkey", 5, 26612, "shuffled")
    return O.even_folds(o, "o_orderkey", 4, ["o_orderpriority"], "run").select("o_orderkey", "fold", "shuffled", F.col("run").cast("long").alias("run"))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def topk_by_score(spark, sf):
    return O.top(table(spark, sf, "part"), "p_retailprice", "p_partkey", 25).select("p_partkey", "p_retailprice")


@query("WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS number FROM orders) SELECT o_orderkey, number FROM n WHERE number % 97 = 3")
def pick_lines(spark, sf):
    rows = W.row_numbers(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], "number")
    return O.pick_lines(rows, rows.where("number % 97 = 3").select("number")).select("o_orderkey", F.col("number").cast("long").alias("number"))


@query("WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, value FROM events) SELECT user_id, place // 2 AS place, round(sum(value) / sqrt(2), 6) AS smooth, round(sum(value * (1 - 2 * (place % 2))) / sqrt(2), 6) AS detail FROM p GROUP BY user_id, place // 2")
def haar_level(spark, sf):
    e = table(spark, sf, "events").withColumn("place", W.ordering("ts", ["user_id"], tie="event_id").cast("long"))
    return L.haar_level(e, ["user_id"], "place", "value").select("user_id", F.col("place").cast("long").alias("place"), F.round("smooth", 6).alias("smooth"), F.round("detail", 6).alias("detail"))


@query("""WITH c AS (SELECT user_id, value - avg(value) OVER (PARTITION BY user_id) AS x, ts, event_id FROM events), l AS (SELECT user_id, x, lag(x) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM c), s AS (SELECT user_id, sum(x * l) AS xl, sum(l * l) AS ll, sum(CASE WHEN l IS NOT NULL THEN x * x END) AS xx FROM l GROUP BY user_id)
SELECT user_id, round(xl / ll, 6) AS phi, round(xx - xl / ll * xl, 3) AS rss FROM s""")
def ar1_fit(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    return L.ar_fit(e, ["user_id"], "at", "value").select("user_id", F.round("phi", 6).alias("phi"), F.round("rss", 3).alias("rss"))


@query("SELECT event_id, round(CASE WHEN abs(value - 50) > 20 THEN value - 50 ELSE 0 END, 8) AS hard, round(sign(value - 50) * greatest(abs(value - 50) - 20, 0), 8) + 0.0 AS soft FROM events")
def thresholds(spark, sf):
    x = F.col("value") - 50
    return table(spark, sf, "events").select("event_id", F.round(L.hard(x, 20), 8).alias("hard"), F.round(L.soft(x, 20), 8).alias("soft"))


@query("""WITH r AS (SELECT user_id, event_type AS s, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), n0 AS (SELECT user_id, s, count(*) AS n FROM r GROUP BY 1, 2), n1 AS (SELECT user_id, p, s, count(*) AS n FROM r WHERE p IS NOT NULL GROUP BY 1, 2, 3)
SELECT user_id, 0 AS "order", round(sum(-n * log2(n / CAST(t AS DOUBLE))), 6) AS bits FROM (SELECT *, sum(n) OVER (PARTITION BY user_id) AS t FROM n0) GROUP BY user_id
UNION ALL SELECT user_id, 1, round(sum(-n * log2(n / CAST(t AS DOUBLE))), 6) FROM (SELECT *, sum(n) OVER (PARTITION BY user_id, p) AS t FROM n1) GROUP BY user_id""")
def markov_bits(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    return L.markov_bits(e, "user_id", "at", "event_type", 1).select("user_id", "order", (F.round("bits", 6) + 0.0).alias("bits"))


@query("SELECT event_id, round(value + 0.5 * coalesce(lag(value, 1) OVER w, 0) + 0.25 * coalesce(lag(value, 2) OVER w, 0), 6) AS convolved FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def convolution(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    return L.convolved(e, "user_id", "at", "value", [1.0, 0.5, 0.25]).select("event_id", F.round("convolved", 6).alias("convolved"))


@query("""WITH RECURSIVE p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value AS y FROM events),
k AS (SELECT user_id, i, y AS z, (1e6 + 1) / (1e6 + 101) * y AS s, 100 * (1e6 + 1) / (1e6 + 101) AS v FROM p WHERE i = 0
UNION ALL SELECT p.user_id, p.i, y - s, s + (v + 1) / (v + 101) * (y - s), 100 * (v + 1) / (v + 101) FROM k JOIN p ON p.user_id = k.user_id AND p.i = k.i + 1)
SELECT user_id, i AS place, round(s, 5) AS state, round(v, 5) AS variance, round(z, 5) AS innovation FROM k""")
def kalman_level(spark, sf):
    k = L.kalman_level(table(spark, sf, "events"), "user_id", "event_id", "value", 1.0, 100.0)
    return k.select("user_id", "place", *(F.round(c, 5).alias(c) for c in ("state", "variance", "innovation")))


def _daub2(levels: int) -> str:
    """Levels of the wavelet of four taps, written out; each value adds to two coefficients of each kind."""
    out = """WITH s AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS k FROM events),
z AS (SELECT user_id, CAST(pow(2, ceil(log2(any_value(k)))) AS BIGINT) AS n FROM s GROUP BY user_id),
f(t, lo, hi) AS (VALUES (0, 0.48296291314453416e0, -0.12940952255126037e0), (1, 0.8365163037378079e0, -0.2241438680420134e0), (2, 0.2241438680420134e0, 0.8365163037378079e0), (3, -0.12940952255126037e0, -0.48296291314453416e0)),
v0 AS MATERIALIZED (SELECT z.user_id, n, r.i, coalesce(x, 0) AS x FROM z JOIN range(1000000) r(i) ON r.i < n LEFT JOIN s ON s.user_id = z.user_id AND s.i = r.i)"""
    for k in range(levels):
        out += f""", v{k + 1} AS MATERIALIZED (SELECT user_id, n // 2 AS n, (((i - t) // 2) % (n // 2) + n // 2) % (n // 2) AS i, sum(x * lo) AS x, sum(x * hi) AS d FROM (SELECT * FROM v{k}, f WHERE n > 1 AND (i + t) % 2 = 0) GROUP BY ALL)"""
    parts = ["SELECT user_id, 0 AS level, i, x AS c FROM v0 WHERE n = 1"]
    for k in range(levels):
        parts += [f"SELECT user_id, {k}, i, d FROM v{k + 1}", f"SELECT user_id, {k + 1}, i, x FROM v{k + 1} WHERE n = 1"]
    return out + f" SELECT user_id, CAST(level AS INTEGER) AS level, CAST(i AS INTEGER) AS place, round(c, 6) + 0.0 AS coefficient FROM ({' UNION ALL '.join(parts)})"


@query(_daub2(14))
def wavelet_coefficients(spark, sf):
    return L.wavelet(table(spark, sf, "events"), "user_id", "event_id", "value", "daub2").withColumn("coefficient", F.round("coefficient", 6) + 0.0)


def _codes() -> str:
    bits = lambda c: f"(CASE WHEN {c} = 0 THEN 1e0 ELSE 3 + 2 * floor(log2(abs({c})) + 1e-9) END)"
    data = lambda d: f"0.721347521e0 * ({d}) * ({d})"
    return f"""WITH b AS (SELECT event_id, user_id, (value - 50) / 5 AS z FROM events),
c AS (SELECT *, floor(z) + CASE WHEN z - floor(z) > 0.5 THEN 1 ELSE 0 END AS r, abs(z) AS a, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY abs(z) DESC, event_id) AS place FROM b),
o AS (SELECT *, abs(r) - i AS ka, abs(r) - i + CASE WHEN r = 0 THEN 1 ELSE 0 END AS ke, CASE WHEN place = n THEN 0 ELSE -ln(place / CAST(n AS DOUBLE)) / 0.693147e0 END AS one, CASE WHEN place = n THEN 10 ELSE -ln(1 - place / CAST(n AS DOUBLE)) / 0.693147e0 END AS zero FROM c, range(3) t(i)),
q AS (SELECT *, {bits('ka')} + {data('ka - a')} AS qa, {bits('ke')} - 1 + {data('ke - a')} + CASE WHEN ke = 0 THEN zero ELSE one END AS qe FROM o),
m AS (SELECT event_id, user_id, any_value(z) AS z, any_value(r) AS r, any_value(n) AS n, arg_min(ka, (qa, i)) * sign(any_value(z)) AS ka, min(qa) AS qa, arg_min(ke, (qe, i)) * CASE WHEN any_value(z) > 0 THEN 1 ELSE -1 END AS ke FROM q GROUP BY event_id, user_id),
p AS (SELECT *, {data('z')} AS nil, floor(1 + 0.5 * ln(greatest(n - 1, 1)) / 0.693147e0) + {data('r - z')} AS qb, qa + 2 + floor(ln(greatest(n - 1, 1)) / 0.693147e0) AS qr FROM m)
SELECT event_id, CAST(CASE WHEN r = 0 THEN 0 ELSE ka END AS BIGINT) AS aic, round(CASE WHEN r = 0 THEN 1 + nil ELSE qa END, 6) AS aic_bits, CAST(CASE WHEN r <> 0 AND qb < nil THEN r ELSE 0 END AS BIGINT) AS bic, round(1 + CASE WHEN r <> 0 AND qb < nil THEN qb ELSE nil END, 6) AS bic_bits,
  CAST(CASE WHEN r <> 0 AND qr < nil THEN ka ELSE 0 END AS BIGINT) AS ric, round(CASE WHEN r <> 0 AND qr < nil THEN qr ELSE nil END, 6) AS ric_bits, CAST(ke AS BIGINT) AS ebic FROM p"""


@query(_codes())
def coefficient_codes(spark, sf):
    """Values in units of 5 as integers at the penalties of four criteria."""
    e = table(spark, sf, "events").withColumn("z", (F.col("value") - 50) / 5)
    out = None
    for m in ("aic", "bic", "ric", "ebic"):
        c = L.coded(e, "user_id", "event_id", "z", m).select("event_id", F.col("code").alias(m), *([F.round("bits", 6).alias(f"{m}_bits")] if m != "ebic" else []))
        out = c if out is None else out.join(c, "event_id")
    return out


@query("""WITH b AS (SELECT event_id, user_id, (value - 50) / 10 AS z FROM events),
c AS (SELECT *, floor(z) + CASE WHEN z - floor(z) > 0.5 THEN 1 ELSE 0 END AS r, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n FROM b WINDOW w AS (PARTITION BY user_id ORDER BY abs(z) DESC, event_id)),
d AS (SELECT *, sum(CASE WHEN r = 0 THEN 1e0 ELSE 3 + 2 * floor(log2(abs(r)) + 1e-9) END + 0.721347521e0 * ((z - r) * (z - r) - z * z)) OVER (PARTITION BY user_id ORDER BY k) + CASE WHEN k = n THEN 0 ELSE -k * log2(k / CAST(n AS DOUBLE)) - (n - k) * log2(1 - k / CAST(n AS DOUBLE)) END AS bits FROM c),
e AS (SELECT user_id, CASE WHEN min(bits) < 0 THEN arg_min(k, bits) ELSE 0 END AS keep FROM d GROUP BY user_id)
SELECT d.user_id, event_id, CASE WHEN k <= keep THEN r * 10 ELSE 0 END + 0e0 AS kept FROM d JOIN e USING (user_id)""")
def kept_blocks(spark, sf):
    e = table(spark, sf, "events").withColumn("z", F.col("value") - 50)
    return L.block_kept(e, "user_id", "event_id", "z", 10.0).withColumn("kept", F.col("kept") + 0.0)


def _halves(spark, sf):
    half = F.floor(F.size("values") / 2).cast("int")
    v = W.stacked(table(spark, sf, "events"), "user_id", "event_id", "value").where("size(values) > 1")
    return v.select("user_id", F.slice("values", 1, half).alias("a"), F.slice("values", half + 1, F.size("values") - half).alias("b"))


@query()
def dtw_map(spark, sf):
    """Where each place of a user's first values lies in the later ones, with limited slopes."""
    return L.warp_map(_halves(spark, sf), "a", "b", limited=True)


@query("""WITH RECURSIVE h AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY user_id HAVING count(*) > 1),
s AS MATERIALIZED (SELECT user_id, v[1:len(v) // 2] AS a, v[len(v) // 2 + 1:] AS b FROM h),
w AS (SELECT user_id, 1 AS x, list_transform(range(1, len(b) + 1), lambda j: pow(a[1] - b[1], 2) + coalesce(list_sum(list_transform(range(2, j + 1), lambda k: pow(a[1] - b[k], 2) / 2)), 0)) AS c FROM s
UNION ALL SELECT user_id, x, list_transform(range(1, len(t) + 1), lambda j: u[j] + list_min(t[1:j])) FROM (
  SELECT user_id, x, u, list_transform(range(1, len(d) + 1), lambda j: least(CASE WHEN j > 1 THEN c[j - 1] + d[j] ELSE c[j] + d[j] / 2 END, c[j] + d[j] / 2) - u[j]) AS t FROM (
    SELECT user_id, x, c, d, list_transform(range(1, len(d) + 1), lambda j: list_sum(d[1:j]) / 2) AS u FROM (
      SELECT w.user_id, x + 1 AS x, c, list_transform(b, lambda y: pow(a[x + 1] - y, 2)) AS d FROM w JOIN s ON s.user_id = w.user_id WHERE x < len(a)))))
SELECT w.user_id, round(c[len(b)], 6) AS distance FROM w JOIN s ON s.user_id = w.user_id AND x = len(a)""")
def dtw_distance(spark, sf):
    """Warped distances between the two halves of each user's values."""
    return L.dtw_distances(_halves(spark, sf), "a", "b").select("user_id", F.round("distance", 6).alias("distance"))


@query("""WITH l AS (SELECT user_id, event_id, value - avg(value) OVER (PARTITION BY user_id) AS y FROM events),
g AS (SELECT user_id, y, lag(y, 1) OVER w AS p, lag(y, 2) OVER w AS q, lag(y, 3) OVER w AS r FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT user_id, sum(p * p) AS a, sum(p * q) AS b, sum(p * r) AS c, sum(q * q) AS d, sum(q * r) AS e, sum(r * r) AS f, sum(p * y) AS u, sum(q * y) AS v, sum(r * y) AS w FROM g WHERE r IS NOT NULL GROUP BY user_id),
m AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM s),
k AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
o AS (SELECT k.user_id, n, [(u * (d * f - e * e) - v * (b * f - c * e) + w * (b * e - c * d)) / det, (-u * (b * f - c * e) + v * (a * f - c * c) - w * (a * e - b * c)) / det, (u * (b * e - c * d) - v * (a * e - b * c) + w * (a * d - b * b)) / det] AS phi FROM k LEFT JOIN m USING (user_id))
SELECT user_id, CAST(i AS INTEGER) AS lag, round(CASE WHEN n > 6 THEN phi[i] ELSE -7.7 END, 6) AS phi FROM o, unnest([1, 2, 3]) t(i)""")
def ar_least_squares(spark, sf):
    return L.ar_least_squares(table(spark, sf, "events"), "user_id", "event_id", "value", 3).select("user_id", "lag", F.round("phi", 6).alias("phi"))


@query("""WITH p AS (SELECT user_id, value AS x, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, value - lag(value) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
t AS (SELECT a.user_id, a.i, sum(b.x) AS t FROM p a CROSS JOIN range(4) r(k) JOIN p b ON b.user_id = a.user_id AND b.i = (a.i + k) % a.n GROUP BY 1, 2)
SELECT user_id, round(2 * t2 / (n * d2), 6) AS ratio FROM (SELECT user_id, sum(t * t) AS t2 FROM t GROUP BY 1) JOIN (SELECT user_id, max(n) AS n, sum(d * d) AS d2 FROM p GROUP BY 1) USING (user_id)""")
def moving_total_ratio(spark, sf):
    return L.moving_total_ratio(table(spark, sf, "events"), "user_id", "event_id", "value", 4).select("user_id", F.round("ratio", 6).alias("ratio"))


_HIDDEN = """p AS MATERIALIZED (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, floor(value / 10) AS x FROM events)"""


@query(f"""WITH RECURSIVE {_HIDDEN},
f AS (SELECT user_id, i, n, x * ln(2) - 2 AS b0, x * ln(8) - 8 AS b1, 0 AS k0, 0 AS k1 FROM p WHERE i = 0
UNION ALL SELECT p.user_id, p.i, p.n, greatest(b0 + ln(0.9), b1 + ln(0.1)) + x * ln(2) - 2, greatest(b0 + ln(0.1), b1 + ln(0.9)) + x * ln(8) - 8, CASE WHEN b0 + ln(0.9) >= b1 + ln(0.1) THEN 0 ELSE 1 END, CASE WHEN b0 + ln(0.1) >= b1 + ln(0.9) THEN 0 ELSE 1 END FROM f JOIN p ON p.user_id = f.user_id AND p.i = f.i + 1),
g AS (SELECT user_id, i, CASE WHEN b0 >= b1 THEN 0 ELSE 1 END AS s, k0, k1 FROM f WHERE i = n - 1
UNION ALL SELECT f.user_id, f.i, CASE WHEN g.s = 0 THEN g.k0 ELSE g.k1 END, f.k0, f.k1 FROM g JOIN f ON f.user_id = g.user_id AND f.i = g.i - 1)
SELECT user_id, CAST(i AS INTEGER) AS place, CAST(s AS INTEGER) AS state FROM g""")
def poisson_states(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.floor(F.col("value") / 10))
    return L.poisson_states(e, "user_id", "event_id", "k", [2.0, 8.0])


@query(f"""WITH RECURSIVE {_HIDDEN}, q AS MATERIALIZED (SELECT user_id, i, n, x, exp(x * ln(2) - 2) AS e0, exp(x * ln(8) - 8) AS e1 FROM p),
f AS (SELECT user_id, i, n, e0 / (e0 + e1) AS a0 FROM q WHERE i = 0
UNION ALL SELECT q.user_id, q.i, q.n, e0 * (0.1 + 0.8 * a0) / (e0 * (0.1 + 0.8 * a0) + e1 * (0.9 - 0.8 * a0)) FROM f JOIN q ON q.user_id = f.user_id AND q.i = f.i + 1),
g AS (SELECT user_id, i, a0 AS g0, 0e0 AS moved FROM f WHERE i = n - 1
UNION ALL SELECT f.user_id, f.i, a0 * (0.9 * g0 / (0.1 + 0.8 * a0) + 0.1 * (1 - g0) / (0.9 - 0.8 * a0)), a0 * 0.1 * (1 - g0) / (0.9 - 0.8 * a0) + (1 - a0) * 0.1 * g0 / (0.1 + 0.8 * a0) FROM g JOIN f ON f.user_id = g.user_id AND f.i = g.i - 1)
SELECT user_id, i AS place, round(g0, 6) AS low, round(moved, 6) AS moved FROM g""")
def state_posteriors(spark, sf):
    """The probability of the low state given a user's whole series, and that the next value is in the other one."""
    e = table(spark, sf, "events").withColumn("k", F.floor(F.col("value") / 10))
    p = L.poisson_posteriors(e, "user_id", "event_id", "k", [2.0, 8.0])
    return p.select("user_id", "place", F.round(F.get("posterior", 0), 6).alias("low"), F.round("moved", 6).alias("moved"))


@query("""WITH p AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, f AS frequency, round(sum(x * cos(2 * pi() * f * i / n)), 4) + 0.0 AS real, round(-sum(x * sin(2 * pi() * f * i / n)), 4) + 0.0 AS imaginary FROM p JOIN range(0, 100000) r(f) ON f <= n // 2 GROUP BY 1, 2""")
def spectrum(spark, sf):
    s = L.spectrum(table(spark, sf, "events"), "user_id", "event_id", "value")
    return s.select("user_id", F.col("frequency").cast("long").alias("frequency"), *((F.round(c, 4) + 0.0).alias(c) for c in ("real", "imaginary")))


@query("""WITH s AS (SELECT min(value) AS lo, max(value) AS hi, 1.06 * stddev_samp(value) * pow(count(*), -0.2) AS h, count(*) AS n FROM events),
e AS (SELECT lo - 3 * h AS low, (hi + 3 * h - (lo - 3 * h)) / 512 AS step, h, n FROM s),
c AS (SELECT least(CAST(floor((value - low) / step) AS BIGINT), 511) AS b, count(*) AS k FROM events, e GROUP BY 1)
SELECT round(low + (r.i + 0.5) * step, 6) AS x, round(sum(k * exp(-0.5 * pow((r.i - b) * step / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 8) AS density FROM range(512) r(i), c, e GROUP BY r.i, low, step""")
def kernel_density(spark, sf):
    return L.density(table(spark, sf, "events"), "value").select(F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))
