"""Queries over windows and per-window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as f
from ..operators import windows as w
from .views import SUPP, USER, WIN, supp_windows, table, v_supp, v_user, window_cte

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


KEYS = "series_key, w_start"
R = "round({}, 6)"
STATS = WIN + ", st AS (SELECT *, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS std FROM win WINDOW w AS (PARTITION BY series_key, w_start)), zz AS (SELECT *, CASE WHEN std < 1e-8 THEN 0 ELSE (value - mean) / std END AS z, greatest(abs(mean), std, 1e-8) AS scale FROM st)"
SEG = STATS + ", sg AS (SELECT *, least(i // greatest(n // 3, 1), 2) AS seg FROM zz), ts3 AS (SELECT series_key, w_start, CAST(seg AS INT) AS seg, min(i) AS s, max(i) AS e, CASE WHEN any_value(std) < 1e-8 THEN 0 ELSE coalesce(regr_slope(value, i) / any_value(std), 0) END AS slope_z FROM sg GROUP BY ALL), lab AS (SELECT *, CASE WHEN slope_z > 0.03 THEN 'up' WHEN slope_z < -0.03 THEN 'down' ELSE 'flat' END AS label FROM ts3)"
GT = SEG + ", gt0 AS (SELECT series_key, w_start, max(CASE WHEN seg = 0 THEN label END) AS fl, arg_max(label, seg) AS ll, sum(slope_z) / 3 AS avg_slope FROM lab GROUP BY ALL), gt AS (SELECT series_key, w_start, avg_slope, CASE WHEN fl = 'up' AND ll = 'down' THEN 'up_then_down' WHEN fl = 'down' AND ll = 'up' THEN 'down_then_up' WHEN avg_slope > 0.03 THEN 'up' WHEN avg_slope < -0.03 THEN 'down' ELSE 'flat' END AS trend FROM gt0), nc AS (SELECT series_key, w_start, arg_min(value, i) AS start_v, arg_max(value, i) AS end_v, greatest(abs(avg(value)), stddev_pop(value), 1e-8) AS scale FROM win GROUP BY ALL), ncd AS (SELECT *, (end_v - start_v) / scale * 100 AS delta_pct FROM nc)"


@query("slice_trend_by_label", f"WITH {GT} SELECT trend, count(*) AS windows, round(avg(delta_pct), 6) AS mean_delta_pct FROM gt JOIN ncd USING (series_key, w_start) GROUP BY trend")
def slice_trend(spark, d):
    win = supp_windows(spark, d)
    joined = f.global_trend(f.trend_segments(win)).join(f.net_change(win), ["series_key", "w_start"])
    return joined.groupBy("trend").agg(F.count("*").alias("windows"), F.round(F.avg("delta_pct"), 6).alias("mean_delta_pct"))


@query("w1_sliding_windows", f"WITH {WIN} SELECT series_key, w_start, w_end, n, count(*) AS points, min(i) AS lo, max(i) AS hi, round(sum(value), 2) AS total FROM win GROUP BY ALL")
def w1(spark, d):
    return supp_windows(spark, d).groupBy("series_key", "w_start", "w_end", "n").agg(F.count("*").alias("points"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.round(F.sum("value"), 2).alias("total"))


@query("w2_full_windows", f"WITH {USER}, {window_cte('usr', 64, 32)} SELECT series_key, w_start, w_end, n, count(*) AS points, round(sum(value), 4) AS total FROM win GROUP BY ALL")
def w2(spark, d):
    return w.sliding_windows(v_user(spark, d), 64, 32).groupBy("series_key", "w_start", "w_end", "n").agg(F.count("*").alias("points"), F.round(F.sum("value"), 4).alias("total"))


@query("w3_limit_per_series", f"WITH {WIN}, t AS (SELECT DISTINCT series_key, w_start, w_end, n FROM win) SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY w_start) <= 3")
def w3(spark, d):
    return w.limit_windows(w.window_table(supp_windows(spark, d)), 3)


@query("w3_limit_global", f"WITH {WIN}, t AS (SELECT DISTINCT series_key, w_start, w_end, n FROM win) SELECT * FROM t ORDER BY series_key, w_start LIMIT 50")
def w3g(spark, d):
    return w.limit_windows(w.window_table(supp_windows(spark, d)), 50, "global")


@query("w4_multi_length", f"WITH {SUPP}, base AS (SELECT series_key, t, price AS value FROM supp), {window_cte('base', 64, 32, 'wa')}, {window_cte('base', 256, 128, 'wb')} SELECT length, count(*) AS points, count(DISTINCT (series_key, w_start)) AS windows, round(sum(value), 1) AS total FROM (SELECT 64::BIGINT AS length, * FROM wa WHERE n = 64 UNION ALL SELECT 256::BIGINT, * FROM wb WHERE n = 256) GROUP BY length")
def w4(spark, d):
    points = v_supp(spark, d).select("series_key", "t", F.col("price").alias("value"))
    return w.multi_length_windows(points, [64, 256]).groupBy("length").agg(F.count("*").alias("points"), F.countDistinct("series_key", "w_start").alias("windows"), F.round(F.sum("value"), 1).alias("total"))


@query("w5_equal_segments", f"WITH {WIN} SELECT series_key, w_start, CAST(least(i // (n // 3), 2) AS INT) AS seg, min(i) AS s, max(i) AS e FROM win GROUP BY ALL")
def w5(spark, d):
    return supp_windows(spark, d).withColumn("seg", w.equal_segment(F.col("i"), F.col("n"), 3)).groupBy("series_key", "w_start", "seg").agg(F.min("i").alias("s"), F.max("i").alias("e"))


@query("w6_even_cuts", "SELECT user_id AS series_key, count(*) AS n, CAST(round_even(count(*) / 3.0, 0) AS BIGINT) AS cut_1, CAST(round_even(2 * count(*) / 3.0, 0) AS BIGINT) AS cut_2 FROM events GROUP BY ALL")
def w6(spark, d):
    sizes = table(spark, d, "events").groupBy(F.col("user_id").alias("series_key")).agg(F.count("*").alias("n"))
    return sizes.withColumns({"cut_1": w.even_cut(F.lit(1), F.col("n")), "cut_2": w.even_cut(F.lit(2), F.col("n"))})


@query("w7_crop_events", """WITH e AS (SELECT l_orderkey AS sample_id, 60 AS n, l_partkey % 50 AS s, l_partkey % 50 + CAST(l_quantity AS BIGINT) % 9 AS e, l_orderkey % 29 AS crop FROM lineitem)
 SELECT sample_id, crop, greatest(s, crop) - crop AS "start", least(e, crop + 31) - crop AS "end", count(*) AS c FROM e WHERE greatest(s, crop) <= least(e, crop + 31) GROUP BY ALL""")
def w7(spark, d):
    part = F.col("l_partkey") % 50
    events = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.lit(60).alias("n"), part.alias("start"), (part + F.col("l_quantity").cast("long") % 9).alias("end"), (F.col("l_orderkey") % 29).alias("crop"))
    return w.crop_at(events, 32).groupBy("sample_id", "crop", "start", "end").agg(F.count("*").alias("c"))


@query("w8_patchify", f"WITH {USER}, p AS (SELECT series_key, t // 16 AS patch, count(*) AS c, sum(value) AS s, arg_min(value, t) AS fv, arg_max(value, t) AS lv FROM usr GROUP BY ALL) SELECT series_key, patch, 16 AS width, round(s, 4) AS total, fv AS first_v, CASE WHEN c < 16 THEN 0.0 ELSE lv END AS last_v FROM p")
def w8(spark, d):
    p = w.patchify(v_user(spark, d), 16)
    total = F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4)
    return p.select("series_key", "patch", F.size("values").alias("width"), total.alias("total"), F.element_at("values", 1).alias("first_v"), F.element_at("values", -1).alias("last_v"))


@query("w9_patch_span", "SELECT l_orderkey, l_linenumber, s, e, least(greatest(s // 16, 0), 7) AS ps, least(greatest(CAST(ceil((e + 1) / 16.0) AS BIGINT), least(greatest(s // 16, 0), 7) + 1), 8) AS pe FROM (SELECT l_orderkey, l_linenumber, l_partkey % 128 AS s, least(l_partkey % 128 + CAST(l_quantity AS BIGINT), 140) AS e FROM lineitem)")
def w9(spark, d):
    s = F.col("l_partkey") % 128
    spans = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", s.alias("s"), F.least(s + F.col("l_quantity").cast("long"), F.lit(140)).alias("e"))
    ps, pe = w.patch_span(F.col("s"), F.col("e"), F.lit(128), 16)
    return spans.withColumns({"ps": ps, "pe": pe})


@query("w10_stride_pool", "WITH x AS (SELECT vec_id // 10 AS id, vec_id % 10 AS pos, CASE WHEN vec_id % 7 = 0 THEN 0 ELSE 1 END AS mask, unnest(embedding) AS x, unnest(range(64)) AS dim FROM embeddings) SELECT id, pos // 4 AS block, CAST(dim AS INT) AS dim, round(coalesce(sum(CASE WHEN mask = 1 THEN CAST(x AS DOUBLE) END) / nullif(sum(mask), 0), 0), 6) AS value FROM x GROUP BY ALL")
def w10(spark, d):
    tokens = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("id"), (F.col("vec_id") % 10).alias("pos"), F.when(F.col("vec_id") % 7 == 0, 0).otherwise(1).alias("mask"), F.col("embedding").cast("array<double>").alias("vec"))
    return w.stride_pool(tokens, 4).withColumn("value", F.round("value", 6))


@query("w11_patch_heat", "WITH x AS (SELECT vec_id AS id, CAST(unnest(range(64)) AS INT) AS patch, CAST(unnest(embedding) AS DOUBLE) AS score FROM embeddings), h AS (SELECT id, patch, (score - min(score) OVER (PARTITION BY id)) / (max(score) OVER (PARTITION BY id) - min(score) OVER (PARTITION BY id)) AS heat FROM x) SELECT id, CAST(unnest(range(patch * 4, patch * 4 + 4)) AS INT) AS step, patch, round(heat, 6) AS heat FROM h")
def w11(spark, d):
    scores = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("patch", "score"))
    return w.patch_heat(scores, 4).withColumn("heat", F.round("heat", 6))


@query("a1_z_score", f"WITH {STATS} SELECT series_key, w_start, i, round(z, 6) AS z FROM zz")
def a1(spark, d):
    return f.with_z(supp_windows(spark, d, by_window=True)).select("series_key", "w_start", "i", F.round("z", 6).alias("z"))


@query("a2_robust_change", f"WITH {STATS} SELECT series_key, w_start, i, round((value - mean) / scale * 100, 6) AS pct FROM zz")
def a2(spark, d):
    return f.with_z(supp_windows(spark, d, by_window=True)).select("series_key", "w_start", "i", F.round(f.change_pct(F.col("mean"), F.col("value"), F.col("scale")), 6).alias("pct"))


@query("a3_detrend", f"WITH {WIN} SELECT series_key, w_start, i, round(value - (regr_slope(value, i) OVER w * i + regr_intercept(value, i) OVER w), 4) AS residual FROM win WINDOW w AS (PARTITION BY series_key, w_start)")
def a3(spark, d):
    return f.detrend(supp_windows(spark, d, by_window=True)).select("series_key", "w_start", "i", F.round("residual", 4).alias("residual"))


@query("a4_trend_segments", f"WITH {SEG} SELECT series_key, w_start, seg, s AS \"start\", e AS \"end\", round(slope_z, 6) AS slope_z, label FROM lab")
def a4(spark, d):
    return f.trend_segments(supp_windows(spark, d, by_window=True)).withColumn("slope_z", F.round("slope_z", 6))


@query("a5_global_trend", f"WITH {GT} SELECT series_key, w_start, round(avg_slope, 6) AS avg_slope, trend FROM gt")
def a5(spark, d):
    return f.global_trend(f.trend_segments(supp_windows(spark, d, by_window=True))).withColumn("avg_slope", F.round("avg_slope", 6))


@query("a6_net_change", f"WITH {GT} SELECT series_key, w_start, start_v, end_v, round(delta_pct, 6) AS delta_pct FROM ncd")
def a6(spark, d):
    return f.net_change(supp_windows(spark, d)).withColumn("delta_pct", F.round("delta_pct", 6))


VOL = SEG + ", sv AS (SELECT series_key, w_start, seg, stddev_pop(z) AS ss, any_value(std) AS std FROM sg GROUP BY ALL), rg AS (SELECT series_key, w_start, max(value) - min(value) AS span FROM win GROUP BY ALL)"


@query("a7_volatility", f"WITH {VOL} SELECT series_key, w_start, round(any_value(std / CASE WHEN span > 0 THEN span ELSE 1 END), 6) AS overall_std, round(max(CASE WHEN seg = 0 THEN ss END), 6) AS std_0, round(max(CASE WHEN seg = 1 THEN ss END), 6) AS std_1, round(max(CASE WHEN seg = 2 THEN ss END), 6) AS std_2, CAST(arg_max(seg, (ss, -seg)) AS INT) AS most FROM sv JOIN rg USING (series_key, w_start) GROUP BY ALL")
def a7(spark, d):
    v = f.volatility(supp_windows(spark, d, by_window=True))
    return v.select("series_key", "w_start", *[F.round(c, 6).alias(c) for c in ("overall_std", "std_0", "std_1", "std_2")], "most")


VL = STATS + ", dz AS (SELECT series_key, w_start, z - lag(z) OVER (PARTITION BY series_key, w_start ORDER BY i) AS d FROM zz), vl AS (SELECT series_key, w_start, stddev_pop(d) AS step_std FROM dz GROUP BY ALL)"


@query("a8_volatility_label", f"WITH {VL} SELECT series_key, w_start, round(step_std, 6) AS step_std, CASE WHEN step_std < 0.5 THEN 'low' WHEN step_std < 1 THEN 'medium' ELSE 'high' END AS volatility FROM vl")
def a8(spark, d):
    return f.volatility_label(supp_windows(spark, d, by_window=True)).withColumn("step_std", F.round("step_std", 6))


@query("a13_series_stats", f"WITH {SUPP}, l AS (SELECT series_key, t, unnest(['disc', 'price', 'qty', 'tax']) AS var, unnest([disc, price, qty, tax]) AS value FROM supp), s AS (SELECT series_key, var, avg(value) AS mean, sqrt(var_pop(value) + 1e-6) AS std, min(value) AS min, max(value) AS max, arg_min(value, t) AS a, arg_max(value, t) AS b, count(*) AS length FROM l GROUP BY ALL) SELECT series_key, var, round(mean, 5) AS mean, round(std, 5) AS std, min, max, round((b - a) / (abs(a) + 1e-6), 4) AS change, length FROM s")
def a13(spark, d):
    long = v_supp(spark, d).unpivot(["series_key", "t"], ["disc", "price", "qty", "tax"], "var", "value")
    s = f.series_stats(long, ["series_key", "var"])
    return s.select("series_key", "var", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "min", "max", F.round("change", 4).alias("change"), "length")


@query("a14_instance_norm", f"WITH {WIN} SELECT series_key, w_start, i, round((value - avg(value) OVER w) / sqrt(var_pop(value) OVER w + 1e-5), 6) AS normed, round(value, 4) AS restored FROM win WINDOW w AS (PARTITION BY series_key, w_start)")
def a14(spark, d):
    return f.instance_norm(supp_windows(spark, d, by_window=True)).select("series_key", "w_start", "i", F.round("normed", 6).alias("normed"), F.round("restored", 4).alias("restored"))


CLS = "CASE WHEN {0} > 0.3 THEN 'strong_up' WHEN {0} > 0.1 THEN 'mild_up' WHEN {0} < -0.3 THEN 'strong_down' WHEN {0} < -0.1 THEN 'mild_down' ELSE 'flat' END"


@query("a15_trend_class", f"WITH {WIN}, r AS (SELECT series_key, w_start, regr_slope(value, i) * count(*) / (max(value) - min(value)) AS r FROM win GROUP BY ALL) SELECT series_key, w_start, round(r, 6) AS ratio, {CLS.format('r')} AS trend_class FROM r")
def a15(spark, d):
    return f.trend_class(supp_windows(spark, d)).withColumn("ratio", F.round("ratio", 6))


@query("a16_relative_volatility", f"WITH {WIN}, r AS (SELECT series_key, w_start, stddev_pop(value) / (abs(avg(value)) + 1e-6) AS r FROM win GROUP BY ALL) SELECT series_key, w_start, round(r, 6) AS ratio, CASE WHEN r < 0.05 THEN 'low' WHEN r < 0.15 THEN 'medium' ELSE 'high' END AS volatility FROM r")
def a16(spark, d):
    return f.relative_volatility(supp_windows(spark, d)).withColumn("ratio", F.round("ratio", 6))


@query("a17_segment_table", f"WITH {STATS}, r AS (SELECT series_key, w_start, CAST(least(i // (n // 4), 3) AS INT) AS seg, avg(value) AS mean, stddev_pop(value) AS s, any_value(std) AS a, regr_slope(value, i) * count(*) / (max(value) - min(value)) AS r FROM zz GROUP BY ALL) SELECT series_key, w_start, seg, round(mean, 7) AS mean, round(s, 4) AS std, CASE WHEN s / (a + 1e-6) < 0.7 THEN 'low' WHEN s / (a + 1e-6) > 1.3 THEN 'high' ELSE 'medium' END AS volatility, {CLS.format('r')} AS trend_class FROM r")
def a17(spark, d):
    return f.segment_table(supp_windows(spark, d, by_window=True)).withColumns({"mean": F.round("mean", 7), "std": F.round("std", 4)})


@query("a18_trend_strength", f"WITH {SEG}, a AS (SELECT series_key, w_start, avg(slope_z) AS s FROM lab GROUP BY ALL) SELECT series_key, w_start, CASE WHEN s > 0.01 THEN 'up' WHEN s < -0.01 THEN 'down' ELSE 'flat' END AS direction, CASE WHEN abs(s) < 0.015 THEN 'weak' WHEN abs(s) < 0.06 THEN 'moderate' ELSE 'strong' END AS strength FROM a")
def a18(spark, d):
    return f.trend_strength(f.trend_segments(supp_windows(spark, d, by_window=True)))


AMP = WIN + ", m AS (SELECT series_key, w_start, arg_min(value, i) AS start_v, arg_max(value, i) AS end_v, avg(value) AS mean, min(value) AS min_v, max(value) AS max_v FROM win GROUP BY ALL), p AS (SELECT series_key, w_start, min(CASE WHEN value = min_v THEN i END) AS min_i, min(CASE WHEN value = max_v THEN i END) AS max_i FROM win JOIN m USING (series_key, w_start) GROUP BY ALL)"


@query("a25_amplitude", f"WITH {AMP} SELECT series_key, w_start, start_v, end_v, round(mean, 9) AS mean, min_v, min_i, max_v, max_i, round((end_v - start_v) / abs(mean) * 100, 6) AS net_pct, round((max_v - min_v) / abs(mean) * 100, 6) AS range_pct FROM m JOIN p USING (series_key, w_start)")
def a25(spark, d):
    return f.amplitude(supp_windows(spark, d, by_window=True)).withColumns({"mean": F.round("mean", 9), "net_pct": F.round("net_pct", 6), "range_pct": F.round("range_pct", 6)})


for _mode, _rule in {"any": "max(label)", "majority": "CAST(avg(label) >= 0.5 AS INT)", "first": "arg_min(label, i)", "mode": "CASE WHEN sum(label) > count(*) - sum(label) THEN 1 ELSE 0 END", "constant": "7"}.items():

    def _label(spark, d, mode=_mode):
        points = v_supp(spark, d).select("series_key", "t", (F.col("part") % 3 == 0).cast("int").alias("label"))
        return f.window_label(w.sliding_windows(points, 128, 64), mode, 7)

    Q[f"a19_window_label_{_mode}"] = _label
    SQL[f"a19_window_label_{_mode}"] = f"WITH {SUPP}, base AS (SELECT series_key, t, CAST(part % 3 = 0 AS INT) AS label FROM supp), {window_cte('base', 128, 64)} SELECT series_key, w_start, CAST({_rule} AS INT) AS window_label FROM win GROUP BY series_key, w_start"
