"""Queries over events in windows, seasonality and lagged correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as k
from ..operators import corr as c
from ..operators import events as e
from ..operators.features import strength_label
from ..operators.windows import window_arrays
from .q_windows import STATS
from .views import SUPP, WIN, supp_windows, v_supp, window_cte

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


STEP = STATS + """, d0 AS (SELECT *, lead(z) OVER w - z AS d FROM zz WINDOW w AS (PARTITION BY series_key, w_start ORDER BY i)),
 d1 AS (SELECT *, first_value(d) OVER (PARTITION BY series_key, w_start ORDER BY i) AS dh, max(CASE WHEN i = n - 2 THEN d END) OVER (PARTITION BY series_key, w_start) AS dt,
  coalesce(sum(d) OVER (PARTITION BY series_key, w_start ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) AS five FROM d0),
 sl AS (SELECT *, CASE WHEN i < n - 1 THEN (five + CASE WHEN i <= 1 THEN dh ELSE 0 END + CASE WHEN i >= n - 3 THEN dt ELSE 0 END) / 5 END AS slope FROM d1),
 sg0 AS (SELECT *, CASE WHEN slope > 0.02 THEN 1 WHEN slope < -0.02 THEN -1 ELSE 0 END AS sign FROM sl WHERE slope IS NOT NULL),
 sg1 AS (SELECT *, CASE WHEN sign <> lag(sign) OVER (PARTITION BY series_key, w_start ORDER BY i) THEN 1 ELSE 0 END AS turn FROM sg0),
 sg2 AS (SELECT *, sum(turn) OVER (PARTITION BY series_key, w_start ORDER BY i) AS run FROM sg1),
 runs AS (SELECT series_key, w_start, run, min(i) AS s, max(i) AS e, any_value(sign) AS sign FROM sg2 GROUP BY ALL)"""


def merged(least: int) -> str:
    return f""", h AS (SELECT *, sum(CASE WHEN run = 0 OR e - s + 2 >= {least} THEN 1 ELSE 0 END) OVER (PARTITION BY series_key, w_start ORDER BY s) - 1 AS seg FROM runs),
 segs AS (SELECT series_key, w_start, seg, min(s) AS s, max(e) + 1 AS e, arg_min(sign, s) AS label FROM h GROUP BY ALL)"""


JOINED = "segs JOIN zz USING (series_key, w_start) WHERE zz.i BETWEEN segs.s AND segs.e"


@query("e1_smoothed_slope", f"WITH {STEP} SELECT series_key, w_start, i, round(slope, 6) AS slope FROM sl WHERE slope IS NOT NULL")
def e1(spark, d):
    return e.smoothed_slope(supp_windows(spark, d, by_window=True)).where("slope is not null").select("series_key", "w_start", "i", F.round("slope", 6).alias("slope"))


@query("e2_slope_runs", f"WITH {STEP} SELECT series_key, w_start, CAST(run AS BIGINT) AS run, sign, s, e FROM runs")
def e2(spark, d):
    runs = e.slope_runs(supp_windows(spark, d, by_window=True)).where("slope is not null")
    return runs.groupBy("series_key", "w_start", "run").agg(F.first("sign").alias("sign"), F.min("i").alias("s"), F.max("i").alias("e"))


@query("e3_slope_segments", f"WITH {STEP} {merged(10)} SELECT series_key, w_start, CAST(seg AS BIGINT) AS seg, s AS \"start\", e AS \"end\", label, round(regr_slope(z, i), 6) AS slope FROM {JOINED} GROUP BY ALL")
def e3(spark, d):
    return e.slope_segments(supp_windows(spark, d, by_window=True)).withColumn("slope", F.round("slope", 6))


EXT = STATS + """, x0 AS (SELECT *, lag(z) OVER w AS zl, lead(z) OVER w AS zr FROM zz WINDOW w AS (PARTITION BY series_key, w_start ORDER BY i)),
 ex AS (SELECT series_key, w_start, CASE WHEN z > zl AND z > zr AND z >= 1 THEN 'peak' WHEN z < zl AND z < zr AND z <= -1 THEN 'valley' END AS kind, i, z, value, (value - mean) / scale * 100 AS delta_pct FROM x0)"""
THIN = "RECURSIVE " + EXT + """, ev AS (SELECT * FROM ex WHERE kind IS NOT NULL),
 kept(series_key, w_start, kind, i) AS (SELECT series_key, w_start, kind, min(i) FROM ev GROUP BY ALL
  UNION ALL SELECT kept.series_key, kept.w_start, kept.kind, min(ev.i) FROM kept JOIN ev ON ev.series_key = kept.series_key AND ev.w_start = kept.w_start AND ev.kind = kept.kind AND ev.i >= kept.i + 5 GROUP BY kept.series_key, kept.w_start, kept.kind, kept.i),
 th AS (SELECT ev.* FROM ev JOIN kept USING (series_key, w_start, kind, i))"""


@query("e4_extrema", f"WITH {EXT} SELECT series_key, w_start, kind, i, round(z, 6) AS z, round(delta_pct, 6) AS delta_pct FROM ex WHERE kind IS NOT NULL")
def e4(spark, d):
    return e.extrema(supp_windows(spark, d, by_window=True)).select("series_key", "w_start", "kind", "i", F.round("z", 6).alias("z"), F.round("delta_pct", 6).alias("delta_pct"))


@query("e5_thinned_extrema", f"WITH {THIN} SELECT series_key, w_start, kind, i FROM th")
def e5(spark, d):
    return e.thin(e.extrema(supp_windows(spark, d, by_window=True))).select("series_key", "w_start", "kind", "i")


@query("e6_top_extrema", f"WITH {THIN} SELECT series_key, w_start, kind, i, row_number() OVER (PARTITION BY series_key, w_start, kind ORDER BY abs(z) DESC, i) - 1 AS rank, round(z, 6) AS z FROM th QUALIFY rank < 3")
def e6(spark, d):
    top = e.top_events(e.thin(e.extrema(supp_windows(spark, d, by_window=True))))
    return top.select("series_key", "w_start", "kind", "i", "rank", F.round("z", 6).alias("z"))


RAMP = STEP + merged(10) + f""", rr AS (SELECT series_key, w_start, seg, any_value(segs.s) AS s, any_value(segs.e) AS e, any_value(label) AS label, arg_max(z, i) - arg_min(z, i) AS dz, (arg_max(value, i) - arg_min(value, i)) / any_value(scale) * 100 AS dp FROM {JOINED} GROUP BY ALL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY series_key, w_start ORDER BY abs(dz) DESC, s) - 1 AS rank FROM rr WHERE label <> 0 AND e - s + 1 >= {{least}} AND abs(dz) >= {{dz}})"""


@query("e7_ramps", f"WITH {RAMP.format(least=24, dz=0.8)} SELECT series_key, w_start, rank, CASE WHEN label > 0 THEN 'ramp_up' ELSE 'ramp_down' END AS kind, s AS \"start\", e AS \"end\", round(dz, 6) AS delta_z, round(dp, 6) AS delta_pct FROM rk WHERE rank < 3")
def e7(spark, d):
    return e.ramps(supp_windows(spark, d, by_window=True)).withColumns({"delta_z": F.round("delta_z", 6), "delta_pct": F.round("delta_pct", 6)})


@query("e7_short_ramps", f"WITH {RAMP.format(least=12, dz=0.1)} SELECT series_key, w_start, rank, CASE WHEN label > 0 THEN 'ramp_up' ELSE 'ramp_down' END AS kind, s AS \"start\", e AS \"end\", round(dz, 6) AS delta_z, round(dp, 6) AS delta_pct FROM rk WHERE rank < 3")
def e7s(spark, d):
    return e.ramps(supp_windows(spark, d, by_window=True), least=12, z_change=0.1).withColumns({"delta_z": F.round("delta_z", 6), "delta_pct": F.round("delta_pct", 6)})


PHASE = STEP + merged(20) + f""", ns AS (SELECT series_key, w_start, count(*) AS c FROM segs GROUP BY ALL),
 ph AS (SELECT series_key, w_start, CAST(seg AS INT) AS phase, zz.* EXCLUDE (series_key, w_start) FROM {JOINED} AND (SELECT c FROM ns WHERE ns.series_key = segs.series_key AND ns.w_start = segs.w_start) >= 2
  UNION ALL SELECT series_key, w_start, CAST((i >= round_even(n / 3.0, 0))::INT + (i >= round_even(2 * n / 3.0, 0))::INT AS INT), zz.* EXCLUDE (series_key, w_start) FROM zz JOIN ns USING (series_key, w_start) WHERE c < 2),
 pp AS (SELECT series_key, w_start, phase, min(i) AS s, max(i) AS e, arg_min(value, i) AS start_v, arg_max(value, i) AS end_v, any_value(scale) AS scale, stddev_pop(value) / any_value(scale) AS std, min(value) AS min_v, max(value) AS max_v, arg_min(i, (value, i)) AS min_i, arg_max(i, (value, -i)) AS max_i FROM ph GROUP BY ALL),
 pq AS (SELECT *, (end_v - start_v) / scale * 100 AS delta_pct, CASE WHEN abs(end_v - start_v) <= 0.01 * scale THEN 'flat' WHEN end_v > start_v THEN 'up' ELSE 'down' END AS label FROM pp WHERE e > s)"""


@query("e8_phases", f"WITH {PHASE} SELECT series_key, w_start, phase, s AS \"start\", e AS \"end\", label, start_v, end_v, round(delta_pct, 6) AS delta_pct, min_v, min_i, max_v, max_i, round(std, 6) AS std FROM pq")
def e8(spark, d):
    return e.phases(supp_windows(spark, d, by_window=True)).drop("n").withColumns({"delta_pct": F.round("delta_pct", 6), "std": F.round("std", 6)})


@query("e9_phase_scores", f"""WITH {PHASE}, b AS (SELECT *, greatest(1.5 * abs(end_v - start_v), 0.05 * abs(start_v), 1e-8) AS bound FROM pq)
 SELECT series_key, w_start, phase, round(abs(delta_pct) + 3 * ln(1 + e - s + 1) + 50 * std + CASE WHEN max_v > greatest(start_v, end_v) + bound OR min_v < least(start_v, end_v) - bound THEN 10 ELSE 0 END, 6) AS score FROM b""")
def e9(spark, d):
    return e.phase_score(e.phases(supp_windows(spark, d, by_window=True))).select("series_key", "w_start", "phase", F.round("score", 6).alias("score"))


ZEV = STATS + ", zi AS (SELECT *, i - row_number() OVER (PARTITION BY series_key, w_start ORDER BY i) AS g FROM zz WHERE abs(z) >= 1.8), ze AS (SELECT series_key, w_start, g, min(i) AS s, max(i) AS e, arg_max(i, (abs(z), -i)) AS peak_i, arg_max(z, (abs(z), -i)) AS z FROM zi GROUP BY ALL)"


@query("e12_z_events", f"WITH {ZEV} SELECT series_key, w_start, s AS \"start\", e AS \"end\", peak_i, round(z, 6) AS z, row_number() OVER (PARTITION BY series_key, w_start ORDER BY abs(z) DESC, s) - 1 AS rank FROM ze")
def e12(spark, d):
    return e.z_events(supp_windows(spark, d, by_window=True), 1.8).withColumn("z", F.round("z", 6))


@query("e13_lift", f"WITH {WIN} SELECT series_key, w_start, i, round(value - coalesce(avg(value) OVER (PARTITION BY series_key, w_start ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), avg(value) OVER (PARTITION BY series_key, w_start)), 9) AS lift FROM win")
def e13(spark, d):
    return e.lift(supp_windows(spark, d, by_window=True)).select("series_key", "w_start", "i", F.round("lift", 9).alias("lift"))


@query("e14_spike_segments", f"WITH {THIN} SELECT series_key, w_start, CASE WHEN z > 0 THEN 'spike' ELSE 'drop' END AS kind, greatest(0, i - 3) AS \"start\", i + 3 AS \"end\", round(z, 6) AS z FROM th WHERE abs(z) >= 1.5")
def e14(spark, d):
    return e.spike_segments(e.thin(e.extrema(supp_windows(spark, d, by_window=True))), 1.5).withColumn("z", F.round("z", 6))


@query("e15_longest_rise", f"WITH {WIN}, u AS (SELECT series_key, w_start, i, CASE WHEN value > lag(value) OVER (PARTITION BY series_key, w_start ORDER BY i) THEN 1 ELSE 0 END AS up FROM win), g AS (SELECT *, sum(1 - up) OVER (PARTITION BY series_key, w_start ORDER BY i) AS g FROM u), r AS (SELECT series_key, w_start, g, CAST(sum(up) AS BIGINT) AS c FROM g GROUP BY ALL) SELECT series_key, w_start, max(c) AS longest, max(c) >= 5 AS long FROM r GROUP BY ALL")
def e15(spark, d):
    return e.longest_rise(supp_windows(spark, d, by_window=True))


@query("e16_first_crossing", f"WITH {WIN}, x AS (SELECT series_key, w_start, min(CASE WHEN value > 95000 THEN i END) AS up, min(CASE WHEN value < 5000 THEN i END) AS down FROM win GROUP BY ALL) SELECT series_key, w_start, up, down, CASE WHEN coalesce(up, 1e9) < coalesce(down, 1e9) THEN 'A' WHEN coalesce(down, 1e9) < coalesce(up, 1e9) THEN 'B' ELSE 'none' END AS first FROM x")
def e16(spark, d):
    return e.first_crossing(supp_windows(spark, d), F.lit(5000.0), F.lit(95000.0))


@query("e17_quantile_position", f"WITH {WIN}, x AS (SELECT series_key, w_start, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, max(CASE WHEN i = series_key % 128 THEN value END) AS marked FROM win GROUP BY ALL) SELECT series_key, w_start, marked, CASE WHEN marked >= q3 THEN 'A' WHEN marked <= q1 THEN 'C' ELSE 'B' END AS position FROM x")
def e17(spark, d):
    return e.quantile_position(supp_windows(spark, d), F.col("series_key") % 128)


ARGMAX = WIN + ", mx AS (SELECT series_key, w_start, arg_max(i, (value, -i)) AS i, max(value) AS v FROM win GROUP BY ALL)"


@query("e18_argmax", f"WITH {ARGMAX} SELECT series_key, w_start, i + 1 AS place FROM mx")
def e18(spark, d):
    return e.argmax_position(supp_windows(spark, d)).select("series_key", "w_start", "place")


@query("e19_value_text", f"WITH {ARGMAX} SELECT series_key, w_start, printf('%.2f', v) AS text FROM mx")
def e19(spark, d):
    return e.argmax_position(supp_windows(spark, d)).select("series_key", "w_start", "text")


TREND_Q = "SELECT series_key, w_start, CASE WHEN regr_slope(value, i) > 0.001 * (max(value) - min(value) + 1e-6) THEN 'A' WHEN regr_slope(value, i) < -0.001 * (max(value) - min(value) + 1e-6) THEN 'B' ELSE 'C' END AS answer FROM win GROUP BY ALL"
HALF_Q = "SELECT series_key, w_start, CASE WHEN s1 > s2 THEN 'A' ELSE 'B' END AS answer FROM (SELECT series_key, w_start, stddev_pop(CASE WHEN i < 64 THEN value END) AS s1, stddev_pop(CASE WHEN i >= 64 THEN value END) AS s2 FROM win GROUP BY ALL) WHERE abs(s1 - s2) >= 0.05 * greatest(s1, s2)"
NEXT = SUPP + ", base AS (SELECT series_key, t, ts, price AS value, lead(price) OVER (PARTITION BY series_key ORDER BY t) AS nxt, qty, disc, tax FROM supp), " + window_cte("base", 128, 64)
NEXT_Q = "SELECT series_key, w_start, CASE WHEN st > 0 THEN 'A' ELSE 'B' END AS answer FROM (SELECT series_key, w_start, max(CASE WHEN i = n - 1 THEN nxt - value END) AS st, stddev_pop(value) AS sd FROM win GROUP BY ALL) WHERE st IS NOT NULL AND abs(st) >= 0.1 * (sd + 1e-6)"


@query("e20_trend_question", f"WITH {WIN} {TREND_Q}")
def e20(spark, d):
    return e.trend_question(supp_windows(spark, d))


@query("e21_max_quarter", f"WITH {ARGMAX} SELECT series_key, w_start, CAST(least(i // 32, 3) + 1 AS INT) AS quarter FROM mx")
def e21(spark, d):
    return e.argmax_position(supp_windows(spark, d)).select("series_key", "w_start", "quarter")


@query("e22_volatile_half", f"WITH {WIN} {HALF_Q}")
def e22(spark, d):
    return e.volatile_half(supp_windows(spark, d))


def _price_points(spark, d):
    return v_supp(spark, d).select("series_key", "t", F.col("price").alias("value"))


@query("e23_next_step", f"WITH {NEXT} {NEXT_Q}")
def e23(spark, d):
    return e.next_step(_price_points(spark, d), 128, 64)


@query("e24_question_items", f"WITH {NEXT}, a AS (SELECT 'trend' AS task, * FROM ({TREND_Q}) UNION ALL SELECT 'half', * FROM ({HALF_Q}) UNION ALL SELECT 'next', * FROM ({NEXT_Q})) SELECT task, 128 AS length, series_key, w_start, answer FROM a QUALIFY row_number() OVER (PARTITION BY task ORDER BY w_start, series_key) <= 40")
def e24(spark, d):
    win = supp_windows(spark, d)
    return e.question_items({"trend": e.trend_question(win), "half": e.volatile_half(win), "next": e.next_step(_price_points(spark, d), 128, 64)}, 128, 40)


LAGS = ", lg AS (SELECT unnest(range(1, {0} + 1)) AS lag)"
ACF = WIN + """, dt AS (SELECT series_key, w_start, n, i, value - (regr_slope(value, i) OVER w * i + regr_intercept(value, i) OVER w) AS y FROM win WINDOW w AS (PARTITION BY series_key, w_start)),
 vr AS (SELECT series_key, w_start, sum(y * y) / count(*) AS v, count(*) AS n FROM dt GROUP BY ALL), lg AS (SELECT unnest(range(1, 65)) AS lag),
 ac AS (SELECT a.series_key, a.w_start, lag, sum(a.y * b.y) / ((any_value(vr.n) - any_value(lag)) * any_value(vr.v)) AS r FROM dt a CROSS JOIN lg JOIN dt b ON b.series_key = a.series_key AND b.w_start = a.w_start AND b.i = a.i + lag JOIN vr ON vr.series_key = a.series_key AND vr.w_start = a.w_start GROUP BY ALL),
 nb AS (SELECT *, lag(r) OVER w AS rl, lead(r) OVER w AS rr FROM ac WINDOW w AS (PARTITION BY series_key, w_start ORDER BY lag)),
 bp AS (SELECT series_key, w_start, arg_max(lag, (r, -lag)) FILTER (WHERE r > rl AND r > rr AND r >= 0.3) AS period, max(r) FILTER (WHERE r > rl AND r > rr AND r >= 0.3) AS s, max(r) AS m FROM nb GROUP BY ALL)"""


@query("a9_acf_period", f"WITH {ACF} SELECT series_key, w_start, period IS NOT NULL AS has, CAST(period AS INT) AS period, round(coalesce(s, m), 6) AS strength FROM bp")
def a9(spark, d):
    a = window_arrays(supp_windows(spark, d), ["value"]).withColumn("p", k.acf_period("value"))
    return a.select("series_key", "w_start", "p.has", "p.period", F.round("p.strength", 6).alias("strength"))


SPECTRUM = """, hy AS (SELECT series_key, w_start, n, i, (0.5 - 0.5 * cos(2 * pi() * i / n)) * (value - avg(value) OVER (PARTITION BY series_key, w_start)) AS y FROM win),
 hk AS (SELECT *, unnest(range(3, CAST(ceil(0.4 * n) AS BIGINT) + 1)) AS k FROM hy WHERE n >= 10),
 pw AS (SELECT series_key, w_start, n, k, 2 * (power(sum(y * cos(2 * pi() * k * i / n)), 2) + power(sum(y * sin(2 * pi() * k * i / n)), 2)) / power(n / 2.0, 2) AS p FROM hk WHERE k / n < 0.4 GROUP BY series_key, w_start, n, k),
 sp AS (SELECT series_key, w_start, CAST(round_even(any_value(n) / arg_max(k, (p, -k)), 0) AS INT) AS other, max(p) / (sum(p) + 1e-9) AS share FROM pw GROUP BY ALL)"""
FUSED = """, fu AS (SELECT series_key, w_start, period, coalesce(s, m) AS strength, other, share,
  CASE WHEN other IS NULL OR share <= 0.15 THEN 'acf' WHEN period IS NULL THEN 'fft' WHEN abs(period - other) / period < 0.15 THEN 'both' WHEN share > 0.4 AND s < 0.4 THEN 'fft' ELSE 'acf' END AS way FROM bp LEFT JOIN sp USING (series_key, w_start)),
 se AS (SELECT series_key, w_start, (way <> 'acf' OR period IS NOT NULL) AS has, CAST(CASE WHEN way = 'fft' THEN other ELSE period END AS INT) AS period, CASE way WHEN 'acf' THEN strength WHEN 'fft' THEN share ELSE greatest(strength, share) END AS strength, period AS acf_period FROM fu)"""


@query("a10_fft_period", f"WITH {WIN}{SPECTRUM} SELECT series_key, w_start, other AS period, round(coalesce(share, 0), 6) AS strength FROM (SELECT DISTINCT series_key, w_start FROM win) LEFT JOIN sp USING (series_key, w_start)")
def a10(spark, d):
    a = window_arrays(supp_windows(spark, d), ["value"]).withColumn("p", k.fft_period("value"))
    return a.select("series_key", "w_start", "p.period", F.round("p.strength", 6).alias("strength"))


@query("a11_season", f"WITH {ACF}{SPECTRUM}{FUSED} SELECT series_key, w_start, has, period, round(strength, 6) AS strength FROM se")
def a11(spark, d):
    a = window_arrays(supp_windows(spark, d), ["value"]).withColumn("p", k.season("value"))
    return a.select("series_key", "w_start", "p.has", "p.period", F.round("p.strength", 6).alias("strength"))


@query("a12_strength_label", f"WITH {ACF} SELECT series_key, w_start, CASE WHEN period IS NULL THEN 'none' WHEN s >= 0.6 THEN 'strong' WHEN s >= 0.4 THEN 'medium' WHEN s >= 0.25 THEN 'weak' ELSE 'none' END AS label FROM bp")
def a12(spark, d):
    a = window_arrays(supp_windows(spark, d), ["value"]).withColumn("p", k.acf_period("value"))
    return a.select("series_key", "w_start", strength_label(F.col("p.has"), F.col("p.strength")).alias("label"))


@query("a24_dominant_lag", f"""WITH {WIN}, y AS (SELECT series_key, w_start, i, value - avg(value) OVER (PARTITION BY series_key, w_start) AS y FROM win), v AS (SELECT series_key, w_start, sum(y * y) AS v FROM y GROUP BY ALL), lg AS (SELECT unnest(range(1, 65)) AS lag),
 r AS (SELECT a.series_key, a.w_start, lag, sum(a.y * b.y) / any_value(v.v) AS r FROM y a CROSS JOIN lg JOIN y b ON b.series_key = a.series_key AND b.w_start = a.w_start AND b.i = a.i + lag JOIN v ON v.series_key = a.series_key AND v.w_start = a.w_start GROUP BY ALL)
 SELECT series_key, w_start, CAST(arg_max(lag, (r, -lag)) AS INT) AS lag, round(max(r), 6) AS strength FROM r GROUP BY ALL""")
def a24(spark, d):
    a = window_arrays(supp_windows(spark, d), ["value"]).withColumn("p", k.dominant_lag("value"))
    return a.select("series_key", "w_start", "p.lag", F.round("p.strength", 6).alias("strength"))


@query("u2_sql_kernels", SQL["a24_dominant_lag"])
def u2(spark, d):
    """A registered kernel called from SQL text."""
    k.register(spark)
    a = window_arrays(supp_windows(spark, d), ["value"]).selectExpr("series_key", "w_start", "dominant_lag(value) AS p")
    return a.selectExpr("series_key", "w_start", "p.lag", "round(p.strength, 6) AS strength")


VARS = ["qty", "disc", "tax"]
LONGV = WIN + ", lv AS (SELECT series_key, w_start, i, value AS y, unnest(['qty', 'disc', 'tax']) AS var, unnest([qty, disc, tax]) AS x FROM win)"


@query("c1_guarded_corr", f"WITH {LONGV} SELECT series_key, w_start, var, CASE WHEN count(*) >= 8 AND stddev_pop(x) >= 1e-8 AND stddev_pop(y) >= 1e-8 THEN round(corr(x, y), 6) END AS corr FROM lv GROUP BY ALL")
def c1(spark, d):
    return c.guarded_corr(c.against_target(supp_windows(spark, d, extra=VARS), VARS)).withColumn("corr", F.round("corr", 6))


COS = LONGV + """, zv AS (SELECT series_key, w_start, i, var, (y - avg(y) OVER w) / (stddev_pop(y) OVER w + 1e-9) AS y, (x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-9) AS x FROM lv WINDOW w AS (PARTITION BY series_key, w_start, var)), ll AS (SELECT unnest(range(-24, 25)) AS lag),
 cc AS (SELECT a.series_key, a.w_start, a.var, lag, sum(a.y * b.x) / (sqrt(sum(a.y * a.y)) * sqrt(sum(b.x * b.x)) + 1e-9) AS c FROM zv a CROSS JOIN ll JOIN zv b ON b.series_key = a.series_key AND b.w_start = a.w_start AND b.var = a.var AND b.i = a.i - lag GROUP BY ALL),
 bc AS (SELECT series_key, w_start, var, arg_max(c, (abs(c), -lag)) AS corr, arg_max(lag, (abs(c), -lag)) AS lag FROM cc GROUP BY ALL)"""


@query("c2_best_lag", f"WITH {COS} SELECT series_key, w_start, var, round(corr, 6) AS corr, CAST(lag AS INT) AS lag FROM bc")
def c2(spark, d):
    return c.best_lags(supp_windows(spark, d, extra=VARS), "value", VARS).select("series_key", "w_start", "var", F.round("corr", 6).alias("corr"), "lag")


HALVES = LONGV + """, hv AS (SELECT *, CASE WHEN i < 64 THEN 1 ELSE 2 END AS half FROM lv), ll AS (SELECT unnest(range(-24, 25)) AS lag),
 hc AS (SELECT a.series_key, a.w_start, a.var, a.half, lag, corr(a.y, b.x) AS c FROM hv a CROSS JOIN ll JOIN hv b ON b.series_key = a.series_key AND b.w_start = a.w_start AND b.var = a.var AND b.half = a.half AND b.i = a.i - lag GROUP BY ALL),
 hb AS (SELECT series_key, w_start, var, half, arg_max(c, (abs(c), -lag)) AS corr, arg_max(lag, (abs(c), -lag)) AS lag FROM hc WHERE NOT isnan(c) GROUP BY ALL),
 hp AS (SELECT series_key, w_start, var, max(CASE WHEN half = 1 THEN corr END) AS corr_1, max(CASE WHEN half = 1 THEN lag END) AS lag_1, max(CASE WHEN half = 2 THEN corr END) AS corr_2, max(CASE WHEN half = 2 THEN lag END) AS lag_2 FROM hb GROUP BY ALL)"""


@query("c3_half_lags", f"WITH {HALVES} SELECT series_key, w_start, var, round(corr_1, 6) AS corr_1, CAST(lag_1 AS INT) AS lag_1, round(corr_2, 6) AS corr_2, CAST(lag_2 AS INT) AS lag_2 FROM hp")
def c3(spark, d):
    b = c.best_lags(supp_windows(spark, d, extra=VARS), "value", VARS)
    return b.select("series_key", "w_start", "var", F.round("corr_1", 6).alias("corr_1"), "lag_1", F.round("corr_2", 6).alias("corr_2"), "lag_2")


STABLE = COS.replace("WITH ", "") + HALVES[len(LONGV) :].replace(", ll AS (SELECT unnest(range(-24, 25)) AS lag)", "") + """, sb AS (SELECT *, sign(corr_1) = sign(corr) AND sign(corr_2) = sign(corr) AND abs(lag_1 - lag) <= 2 AND abs(lag_2 - lag) <= 2 AND abs(corr_1) >= 0.21 AND abs(corr_2) >= 0.21 AS stable FROM bc JOIN hp USING (series_key, w_start, var))"""


@query("c4_stability", f"WITH {STABLE} SELECT series_key, w_start, var, stable FROM sb")
def c4(spark, d):
    return c.with_stability(c.best_lags(supp_windows(spark, d, extra=VARS), "value", VARS)).select("series_key", "w_start", "var", "stable")


@query("c5_kept_correlations", f"WITH {STABLE} SELECT series_key, w_start, row_number() OVER (PARTITION BY series_key, w_start ORDER BY abs(corr) DESC, var) - 1 AS rank, var, round(corr, 6) AS corr, CAST(lag AS INT) AS lag, CASE WHEN corr > 0 THEN 'positive' ELSE 'negative' END AS relation, stable FROM sb WHERE abs(corr) >= 0.2 QUALIFY rank < 3")
def c5(spark, d):
    kept = c.kept_correlations(c.with_stability(c.best_lags(supp_windows(spark, d, extra=VARS), "value", VARS)), least=0.2)
    return kept.withColumn("corr", F.round("corr", 6))


@query("c6_zero_lag_ranks", f"WITH {LONGV}, r AS (SELECT series_key, w_start, var, corr(x, y) AS corr FROM lv GROUP BY ALL) SELECT series_key, w_start, var, round(corr, 6) AS corr, row_number() OVER (PARTITION BY series_key, w_start ORDER BY abs(corr) DESC, var) AS rank FROM r")
def c6(spark, d):
    return c.ranked_corr(c.against_target(supp_windows(spark, d, extra=VARS), VARS)).withColumn("corr", F.round("corr", 6))


@query("c7_best_driver", f"WITH {LONGV}, r AS (SELECT series_key, w_start, var, corr(x, y) AS corr FROM lv GROUP BY ALL) SELECT series_key, w_start, arg_max(var, abs(corr)) AS var FROM r GROUP BY ALL")
def c7(spark, d):
    return c.best_driver(c.against_target(supp_windows(spark, d, extra=VARS), VARS)).select("series_key", "w_start", "var")


