"""Queries over claims, segments, records and training tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims as c
from ..operators import tables as t
from ..operators.events import phases
from ..operators.render import phase_forms, thinned_phases, told_extremes
from ..operators.windows import KEY
from .q_events import PHASE, RAMP, STABLE, THIN
from .q_windows import GT, STATS, VL
from .views import WIN, supp_windows, table

Q, SQL = {}, {}
VARS = ["qty", "disc"]


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def claims_of(spark, d, variables=()):
    return c.build_claims(supp_windows(spark, d, extra=VARS, by_window=True), list(variables))


TOPK = THIN + ", tk AS (SELECT *, row_number() OVER (PARTITION BY series_key, w_start, kind ORDER BY abs(z) DESC, i) - 1 AS rank FROM th QUALIFY rank < 3)"
RAMPS = f"WITH {RAMP.format(least=24, dz=0.8)} SELECT series_key, w_start, rank, s, e, CASE WHEN label > 0 THEN 'ramp_up' ELSE 'ramp_down' END AS kind, dp FROM rk WHERE rank < 3"


def _claim_part(source: str, id_: str, kind: str, start="NULL", end="NULL", idx="NULL", delta="NULL", z="NULL", label="NULL") -> str:
    return f"""SELECT series_key, w_start, {id_} AS id, {kind} AS type, CAST({start} AS INT) AS "start", CAST({end} AS INT) AS "end", CAST({idx} AS INT) AS idx,
 round(CAST({delta} AS DOUBLE), 4) AS delta_pct, round(CAST({z} AS DOUBLE), 4) AS z, CAST({label} AS VARCHAR) AS label FROM ({source})"""


def _sized(cte: str, table_: str) -> str:
    return f"WITH {cte} SELECT x.*, last FROM {table_} x JOIN (SELECT series_key, w_start, max(n) - 1 AS last FROM win GROUP BY ALL) USING (series_key, w_start)"


VOLATILITY = "CASE WHEN step_std < 0.5 THEN 'low' WHEN step_std < 1 THEN 'medium' ELSE 'high' END"
CORRS = f"WITH {STABLE} SELECT series_key, w_start, row_number() OVER (PARTITION BY series_key, w_start ORDER BY abs(corr) DESC, var) - 1 AS rank FROM sb WHERE var <> 'tax' AND abs(corr) >= 0.3 QUALIFY rank < 3"
CLAIMS = "\nUNION ALL ".join([
    _claim_part(_sized(GT, "gt"), "'global_trend_label'", "'global_trend_label'", "0", "last", label="trend"),
    _claim_part(_sized(GT, "ncd"), "'global_net_change'", "'global_net_change'", "0", "last", delta="delta_pct"),
    _claim_part(RAMPS, "'ramp_' || rank", "'ramp'", "s", "e", delta="dp"),
    _claim_part(f"WITH {PHASE} SELECT * FROM pq", "'phase_' || phase", "'phase'", "s", "e", delta="delta_pct", label="label"),
    _claim_part(_sized(VL, "vl"), "'volatility'", "'volatility_most_segment'", "0", "last", label=VOLATILITY),
    _claim_part(f"WITH {TOPK} SELECT * FROM tk", "kind || '_' || rank", "kind", idx="i", z="z"),
    _claim_part(_sized(WIN, "(SELECT DISTINCT series_key, w_start FROM win)"), "'seasonality'", "'seasonality'", "0", "last"),
    _claim_part(CORRS, "'corr_' || rank", "'lagged_corr'"),
])


@query("l1_build_claims", CLAIMS)
def l1(spark, d):
    return claims_of(spark, d, VARS).select(*KEY, "id", "type", "start", "end", "idx", F.round("delta_pct", 4).alias("delta_pct"), F.round("z", 4).alias("z"), "label")


@query("l1_claim_counts", f"WITH {RAMP.format(least=24, dz=0.8)} SELECT series_key, w_start, count(*) AS ramps FROM rk WHERE rank < 3 GROUP BY ALL")
def l1r(spark, d):
    return claims_of(spark, d).where("type = 'ramp'").groupBy(*KEY).agg(F.count("*").alias("ramps"))


@query("l2_time_at", f"WITH {STATS} SELECT series_key, w_start, strftime(max(CASE WHEN i = least(greatest(series_key * 3 - 5, 0), n - 1) THEN ts END), '%Y-%m-%d %H:%M') AS time FROM zz GROUP BY ALL")
def l2(spark, d):
    from ..operators.windows import window_arrays

    arrays = window_arrays(supp_windows(spark, d).withColumn("time", F.date_format("ts", "yyyy-MM-dd HH:mm")), ["time"])
    return arrays.select(*KEY, c.time_at(F.col("time"), F.col("series_key").cast("int") * 3 - 5).alias("time"))


def shaken(spark, d):
    """Claims of which some are wrong: net changes off by 0 to 2 points, z by 0 to 0.4, labels of every fifth series."""
    off = F.col("w_start") % 3
    shaken_ = claims_of(spark, d).withColumns({
        "delta_pct": F.when(F.col("type") == "global_net_change", F.col("delta_pct") + off * 0.9).otherwise(F.col("delta_pct")),
        "z": F.when(F.col("type") == "peak", F.col("z") + off * 0.15).otherwise(F.col("z")),
        "label": F.when((F.col("type") == "global_trend_label") & (F.col("series_key") % 5 == 0), "up").otherwise(F.col("label")),
    })
    return c.validate_claims(shaken_, supp_windows(spark, d, extra=VARS, by_window=True))


@query("l3_validated_trend", f"WITH {GT} SELECT series_key, w_start, CASE WHEN series_key % 5 = 0 THEN 'up' ELSE trend END = trend AS ok FROM gt")
def l3t(spark, d):
    return shaken(spark, d).where("type = 'global_trend_label'").select(*KEY, "ok")


@query("l3_validated_net", f"WITH {GT} SELECT series_key, w_start, (w_start % 3) * 0.9 <= 1 AS ok FROM ncd")
def l3n(spark, d):
    return shaken(spark, d).where("type = 'global_net_change'").select(*KEY, "ok")


@query("l3_validated_peaks", f"WITH {TOPK} SELECT series_key, w_start, 'peak_' || rank AS id, (w_start % 3) * 0.15 <= 0.2 AS ok FROM tk WHERE kind = 'peak'")
def l3p(spark, d):
    return shaken(spark, d).where("type = 'peak'").select(*KEY, "id", "ok")


@query("l3_validated_phases", f"WITH {PHASE} SELECT series_key, w_start, 'phase_' || phase AS id, true AS ok FROM pq")
def l3h(spark, d):
    return shaken(spark, d).where("type = 'phase'").select(*KEY, "id", "ok")


@query("l4_repaired_trend", f"WITH {GT} SELECT series_key, w_start, trend AS label_raw, CASE WHEN trend = 'flat' AND abs(delta_pct) >= 10 THEN CASE WHEN k0 = 'ramp_down' AND k1 = 'ramp_up' THEN 'down_then_up' WHEN k0 = 'ramp_up' AND k1 = 'ramp_down' THEN 'up_then_down' WHEN delta_pct > 0 THEN 'up' ELSE 'down' END ELSE trend END AS label_final FROM gt JOIN ncd USING (series_key, w_start) LEFT JOIN (SELECT series_key, w_start, arg_min(kind, s) AS k0, arg_max(kind, s) AS k1 FROM ({RAMPS}) GROUP BY ALL) USING (series_key, w_start)")
def l4(spark, d):
    return c.repair_trend(claims_of(spark, d)).where("type = 'global_trend_label'").select(*KEY, "label_raw", "label_final")


@query("l5_amplitude_note", f"WITH {TOPK} SELECT series_key, w_start, CASE WHEN series_key % 2 = 0 AND max(CASE WHEN rank IS NOT NULL THEN abs(delta_pct) END) >= 98 THEN 'low_short_term_but_large_amplitude' END AS note FROM (SELECT DISTINCT series_key, w_start FROM zz) LEFT JOIN tk USING (series_key, w_start) GROUP BY series_key, w_start")
def l5(spark, d):
    """Every second series is said to be of low volatility; some windows reach 98 % off the mean, others don't."""
    calm = claims_of(spark, d).withColumn("label", F.when((F.col("type") == "volatility_most_segment") & (F.col("series_key") % 2 == 0), "low").otherwise(F.col("label")))
    return c.amplitude_note(calm, 98.0).where("type = 'volatility_most_segment'").select(*KEY, "note")


@query("l6_policy", f"WITH {GT} SELECT series_key, w_start, CAST(count(*) FILTER (WHERE series_key % 5 <> 0 OR trend = 'up') AS BIGINT) AS trends, CAST(1 AS BIGINT) AS nets FROM gt GROUP BY ALL")
def l6(spark, d):
    kept = c.apply_policy(shaken(spark, d))
    return kept.groupBy(*KEY).agg(F.count_if(F.col("type") == "global_trend_label").alias("trends"), F.count_if(F.col("type") == "global_net_change").alias("nets"))


@query("l7_budget", f"WITH {TOPK} SELECT series_key, w_start, kind AS type, CAST(i AS INT) AS idx, round(z, 6) AS z FROM tk WHERE rank = 0")
def l7(spark, d):
    return c.apply_budget(claims_of(spark, d)).where("type in ('peak', 'valley')").select(*KEY, "type", "idx", F.round("z", 6).alias("z"))


@query("a21_claim_check", f"WITH {GT} SELECT series_key, w_start, CAST((series_key % 5 = 0 AND trend <> 'up')::INT + ((w_start % 3) * 0.9 > 1)::INT AS BIGINT) AS n_failed FROM gt")
def a21(spark, d):
    some = shaken(spark, d).where("type in ('global_trend_label', 'global_net_change')")
    return c.claim_check(some).select(*KEY, "n_failed")


@query("a23_best_extremes", f"WITH {THIN} SELECT series_key, w_start, kind, i, value FROM th QUALIFY row_number() OVER (PARTITION BY series_key, w_start, kind ORDER BY CASE WHEN kind = 'peak' THEN value ELSE -value END DESC, i) = 1")
def a23(spark, d):
    from ..operators import events as e

    return t.best_extreme(e.thin(e.extrema(supp_windows(spark, d, by_window=True))), KEY).select(*KEY, "kind", "i", "value")


# Spans chosen one by one in a recursive table, the strongest first; then ramps and extremes behind them.
IOU = "greatest(0, least({a}.e, {b}.e) - greatest({a}.s, {b}.s) + 1)"
MMR = f"""pb AS (SELECT *, greatest(1.5 * abs(end_v - start_v), 0.05 * abs(start_v), 1e-8) AS bound FROM pq),
 sc AS (SELECT series_key, w_start, s, e, abs(delta_pct) + 3 * ln(1 + e - s + 1) + 50 * std + CASE WHEN max_v > greatest(start_v, end_v) + bound OR min_v < least(start_v, end_v) - bound THEN 10 ELSE 0 END AS score FROM pb),
 bk AS (SELECT *, least(4, CAST(floor((s - min(s) OVER v) / (max(e) OVER v - min(s) OVER v + 1) * 5) AS INT)) AS b, row_number() OVER (v ORDER BY score DESC, s) AS o FROM sc WINDOW v AS (PARTITION BY series_key, w_start)),
 mm AS (SELECT series_key, w_start, [{{'s': s, 'e': e, 'b': b}}] AS chosen, 1 AS k FROM bk WHERE o = 1
  UNION ALL SELECT series_key, w_start, list_append(chosen, pick), k + 1 FROM (
   SELECT mm.series_key, mm.w_start, any_value(mm.chosen) AS chosen, any_value(k) AS k, arg_max({{'s': bk.s, 'e': bk.e, 'b': bk.b}}, (bk.score - 25 * list_max(list_transform(mm.chosen, lambda c: {IOU.format(a='c', b='bk')} / (c.e - c.s + bk.e - bk.s + 2 - {IOU.format(a='c', b='bk')}))) + CASE WHEN list_contains(list_transform(mm.chosen, lambda c: c.b), bk.b) THEN 0 ELSE 8 END, -o)) AS pick
   FROM mm JOIN bk ON bk.series_key = mm.series_key AND bk.w_start = mm.w_start AND NOT list_contains(list_transform(mm.chosen, lambda c: c.s), bk.s) WHERE k < 5 GROUP BY mm.series_key, mm.w_start)),
 lg AS (SELECT series_key, w_start, unnest(chosen) AS c FROM mm QUALIFY k = max(k) OVER (PARTITION BY series_key, w_start))"""
TARGETS = f"""WITH RECURSIVE {PHASE}, {MMR}, rp AS (SELECT * FROM ({RAMPS})), ex AS (SELECT * FROM (WITH {TOPK} SELECT * FROM tk)),
 al AS (SELECT series_key, w_start, 0 AS g, row_number() OVER (PARTITION BY series_key, w_start ORDER BY c.s) AS r, 'phase' AS type, c.s AS s, c.e AS e FROM lg
  UNION ALL SELECT series_key, w_start, 1, row_number() OVER (PARTITION BY series_key, w_start ORDER BY abs(dp) DESC, rank) AS r, 'ramp', s, e FROM rp QUALIFY r <= 2
  UNION ALL SELECT series_key, w_start, 2, row_number() OVER (PARTITION BY series_key, w_start ORDER BY abs(z) DESC, kind, rank) AS r, kind, i, i FROM ex QUALIFY r <= 2)
 SELECT series_key, w_start, CAST(row_number() OVER (PARTITION BY series_key, w_start ORDER BY g, r) - 1 AS INT) AS segment_id, type, CAST(s AS INT) AS "start", CAST(e AS INT) AS "end" FROM al"""


@query("e10_e11_target_segments", TARGETS)
def e11(spark, d):
    return c.target_segments(claims_of(spark, d))


def records(spark, d):
    return c.caption_records(supp_windows(spark, d, extra=VARS, by_window=True), VARS, "supp")


@query("l8_caption_records")
def l8(spark, d):
    r = records(spark, d)
    return r.select("dataset", "series_key", "indices", F.size("timeseries").alias("steps"), F.size("claims").alias("claims"), "claim_check.pass", F.col("descriptions")[0].alias("zh"), F.col("descriptions")[1].alias("en"))


@query("t15_prompt_payload")
def t15(spark, d):
    return c.prompt_payload(records(spark, d))


@query("t14_thinned_phases", f"WITH {PHASE}, r AS (SELECT *, row_number() OVER (PARTITION BY series_key, w_start ORDER BY phase) - 1 AS r, count(*) OVER (PARTITION BY series_key, w_start) AS c FROM pq) SELECT series_key, w_start, phase FROM r WHERE c <= 5 OR r < 2 OR r >= c - 2 OR (r - 2) % greatest(1, (c - 4) // 2) = 0")
def t14(spark, d):
    return thinned_phases(phases(supp_windows(spark, d, by_window=True))).select(*KEY, "phase")


@query("t13_phase_forms", f"""WITH {PHASE}, r AS (SELECT *, row_number() OVER (PARTITION BY series_key, w_start ORDER BY phase) - 1 AS r, count(*) OVER (PARTITION BY series_key, w_start) AS c FROM pq),
 kept AS (SELECT *, greatest(1.5 * abs(end_v - start_v), 0.05 * abs(start_v)) AS bound, lag(label) OVER (PARTITION BY series_key, w_start ORDER BY phase) AS before FROM (SELECT * FROM r WHERE c <= 5 OR r < 2 OR r >= c - 2 OR (r - 2) % greatest(1, (c - 4) // 2) = 0))
 SELECT series_key, w_start, phase, label, CASE WHEN min_v < least(start_v, end_v) - bound THEN 'dip' WHEN max_v > greatest(start_v, end_v) + bound THEN 'spike' WHEN before = label THEN 'continue' ELSE 'plain' END AS form FROM kept""")
def t13(spark, d):
    return phase_forms(thinned_phases(phases(supp_windows(spark, d, by_window=True)))).select(*KEY, "phase", "label", "form")


@query("t13_told_extremes", f"WITH {TOPK} SELECT series_key, w_start, CAST(row_number() OVER (PARTITION BY series_key, w_start ORDER BY kind, i) - 1 AS INT) AS place, kind AS type, CAST(i AS INT) AS idx FROM tk")
def t13e(spark, d):
    own = claims_of(spark, d).where("type in ('peak', 'valley')").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("ord", "type", "idx"))).alias("claims"))
    told = own.select(*KEY, F.posexplode(told_extremes(F.col("claims"))).alias("place", "c"))
    return told.select(*KEY, "place", "c.type", "c.idx")


def v_records(spark, d):
    """orders as caption records: a trend, a net change, a peak, a valley and a seasonality claim each."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    null = lambda kind: F.lit(None).cast(kind)

    def signed(x, digits):
        """Rounded as the SQL's engine does, in doubles instead of the decimals that are shown; texts show -0.0."""
        near = F.round(x * 10.0**digits, 0) / 10.0**digits
        return F.when(near == 0, x * 0.0).otherwise(near)

    types = {n: ty for n, ty in c.DATA.items() if n not in ("min_v", "max_v", "std")}
    data = lambda **v: F.struct(*[v.get(n, null(ty)).cast(ty).alias(n) for n, ty in types.items()])
    claim = lambda kind, idx, d_: F.struct(F.lit(kind).alias("id"), F.lit(kind).alias("type"), idx.cast("int").alias("idx"), d_.alias("data"))
    claims_ = F.array(
        claim("global_trend_label", null("int"), data(label=F.when(k % 2 == 0, "up").otherwise("flat"), label_final=F.when(k % 4 == 1, "down"))), claim("global_net_change", null("int"), data(delta_pct=signed(p / 777 - 300, 2))),
        claim("peak", k % 9, data(value=signed(p / 100, 0))), claim("peak", k % 7, data(value=F.lit(2000.0))), claim("valley", k % 5, data(value=signed(-p / 100, 0))), claim("seasonality", null("int"), data(has=k % 3 == 0, period=F.when(k % 3 == 0, k % 12))),
    )
    dense = F.struct(F.struct(F.lit("").alias("zh"), F.when(k % 2 == 0, F.concat(F.lit("caption "), k)).alias("en")).alias("global"), F.struct(null("string").alias("zh"), null("string").alias("en")).alias("domain_integrated"),
        F.array(F.struct((k % 20).cast("int").alias("start"), (k % 20 + k % 40).cast("int").alias("end"), F.lit("phase").alias("type"), F.concat(F.lit("段 "), k).alias("description_zh"), F.when(k % 3 == 0, F.concat(F.lit(" part  "), k)).alias("description_en"))).alias("local"))
    return table(spark, d, "orders").select(F.lit("o").alias("dataset"), F.lit("t").alias("task"), k.cast("string").alias("series_key"), F.array(F.array(p)).alias("timeseries"), null("string").alias("label"), F.struct(F.when(k % 2 == 0, "low").alias("volatility")).alias("features"), claims_.alias("claims"), F.struct((k % 5 != 0).alias("pass")).alias("claim_check"), F.array(F.when(k % 7 != 0, F.lit("d0")).otherwise(" ")).alias("descriptions"), dense.alias("dense_captions"))


FACTS = """f AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 1 THEN 'down' WHEN o_orderkey % 2 = 0 THEN 'up' ELSE 'flat' END AS trend, round(o_totalprice / 777 - 300, 2) AS delta, greatest(round(o_totalprice / 100, 0), 2000) AS pv, CASE WHEN round(o_totalprice / 100, 0) >= 2000 THEN o_orderkey % 9 ELSE o_orderkey % 7 END AS pi, round(-o_totalprice / 100, 0) AS vv, o_orderkey % 5 AS vi, o_orderkey % 3 = 0 AS has, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 12 END AS period, CASE WHEN o_orderkey % 2 = 0 THEN 'low' END AS vol FROM orders)"""


@query("b1_facts", f"WITH {FACTS} SELECT CAST(k AS VARCHAR) AS series_key, trend, delta AS delta_pct, CASE WHEN delta > 0 THEN 'pos' WHEN delta < 0 THEN 'neg' ELSE 'zero' END AS sign, CAST(pi AS INT) AS peak_idx, pv AS peak_value, CAST(vi AS INT) AS valley_idx, vv AS valley_value, has, CAST(period AS INT) AS period, vol AS volatility FROM f")
def b1(spark, d):
    f = v_records(spark, d).withColumn("f", t.facts(F.col("claims"), F.col("features.volatility")))
    return f.select("series_key", "f.trend", "f.delta_pct", F.col("f.net_change_sign").alias("sign"), F.col("f.peak.idx").alias("peak_idx"), F.col("f.peak.value").alias("peak_value"), F.col("f.valley.idx").alias("valley_idx"), F.col("f.valley.value").alias("valley_value"), "f.seasonality.has", "f.seasonality.period", "f.volatility")


FACT_TEXT = f"""WITH {FACTS} SELECT CAST(k AS VARCHAR) AS series_key, printf('Overall trend is %s with a net %s of about %.2f%%. A peak occurs around index %d (value ≈ %.3f). A valley occurs around index %d (value ≈ %.3f). %s Overall volatility is %s.', trend, CASE WHEN delta > 0 THEN 'increase' WHEN delta < 0 THEN 'decrease' ELSE 'little net change' END, delta, pi, pv, vi, vv, CASE WHEN has THEN 'Seasonality is detected with period ≈ ' || period || '.' ELSE 'No clear seasonality is detected.' END, coalesce(vol, 'unknown')) AS caption FROM f"""


@query("t12_fact_captions", FACT_TEXT)
def t12(spark, d):
    f = v_records(spark, d).withColumn("f", t.facts(F.col("claims"), F.col("features.volatility")))
    return f.select("series_key", t.fact_caption(F.col("f")).alias("caption"))


@query("b2_sft_rows", "SELECT 'o:t:' || o_orderkey || '::' || style || '_en' || CASE WHEN style = 'facts_only' THEN '' WHEN o_orderkey % 2 = 0 OR o_orderkey % 7 <> 0 THEN v ELSE '_single' END AS id FROM orders, (VALUES ('caption_only'), ('facts_only'), ('json_caption')) s(style), (VALUES ('_natural'), ('_template')) x(v) WHERE (style <> 'facts_only' AND (o_orderkey % 2 = 0 OR o_orderkey % 7 <> 0)) OR v = '_natural'")
def b2(spark, d):
    return t.build_sft(v_records(spark, d), both=True).select("id")


def prompts_sql(lang: str) -> str:
    return "(VALUES " + ", ".join(f"('{style}', '{prompt}')" for style, own, prompt in t.PROMPTS if own == lang) + ") s(style, prompt)"


@query("t16_prompts", f"SELECT 'o:t:' || o_orderkey || '::' || style || '_zh' || CASE WHEN style = 'facts_only' THEN '' ELSE '_single' END AS id, prompt FROM orders, {prompts_sql('zh')}")
def t16(spark, d):
    return t.build_sft(v_records(spark, d), lang="zh").select("id", "prompt")


@query("b3_sft_counts", "SELECT count(*) AS n_in, CAST(sum(CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 2 = 0 OR o_orderkey % 7 <> 0 THEN 5 ELSE 3 END) AS BIGINT) AS n_out, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS n_skipped FROM orders")
def b3(spark, d):
    """Two rows a style with a caption where there is a natural one, else one; one row of facts."""
    every = v_records(spark, d)
    return t.sft_counts(every, t.build_sft(t.passed(every), both=True))


@query("p11_passed", "SELECT CAST(o_orderkey AS VARCHAR) AS series_key FROM orders WHERE o_orderkey % 5 <> 0")
def p11(spark, d):
    return t.passed(v_records(spark, d)).select("series_key")


@query("p12_captioned", "SELECT CAST(o_orderkey AS VARCHAR) AS series_key FROM orders WHERE o_orderkey % 7 <> 0")
def p12(spark, d):
    return t.captioned(v_records(spark, d)).select("series_key")


@query("b4_flat_captions", "SELECT conv_id AS sample_id, least(count(*), 3) AS c, least(count(*), 3) AS own FROM conversations GROUP BY conv_id")
def b4(spark, d):
    """How many captions each sample keeps, and how many of these stand at different places of its list under their own text."""
    lists = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("sample_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    samples = lists.select("sample_id", F.col("p.text").alias("captions"), F.col("sample_id").alias("group_key"))
    flat = t.flat_captions(samples, 3).join(samples.select("sample_id", "captions"), "sample_id")
    own = F.count_distinct(F.when(F.get("captions", F.col("position")).eqNullSafe(F.col("text")), F.col("position")))
    return flat.groupBy("sample_id").agg(F.count("*").alias("c"), own.alias("own"))


@query("b5_flat_events", "SELECT o_orderkey AS sample_id, least(greatest(s // 8, 0), 7) AS ps, least(greatest(CAST(ceil((e + 1) / 8.0) AS BIGINT), s // 8 + 1), 8) AS pe FROM (SELECT o_orderkey, o_orderkey % 20 AS s, o_orderkey % 20 + o_orderkey % 40 AS e FROM orders)")
def b5(spark, d):
    samples = v_records(spark, d).select(F.col("series_key").cast("long").alias("sample_id"), F.lit(64).alias("n"), F.transform("dense_captions.local", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["type"].alias("type"), e["description_zh"].alias("text"))).alias("local"))
    return t.flat_events(samples, 8, 5).select("sample_id", "ps", "pe")


@query("b6_local_events", "SELECT CAST(o_orderkey AS VARCHAR) AS series_key, CASE WHEN o_orderkey % 3 = 0 THEN 'part ' || o_orderkey ELSE '段 ' || o_orderkey END AS text FROM orders")
def b6(spark, d):
    return t.local_events(v_records(spark, d)).select("series_key", "text")


@query("b7_combined_text", "SELECT conv_id AS row, string_agg(trim(role), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def b7(spark, d):
    return t.combine_series_text(table(spark, d, "conversations").select(F.col("conv_id").alias("row"), F.col("turn").alias("position"), F.col("role").alias("text")))
