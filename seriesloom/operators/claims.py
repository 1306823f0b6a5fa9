"""Claims about windows: built from features, checked against the points, repaired, thinned, and put into records.

A claim is a row: series_key, w_start, ord (its place), id, type, start, end, idx and the wide set of DATA columns,
of which a type fills its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..sources.scratch import stored
from . import corr as corr_ops
from . import events, features
from .features import EPS, window_features
from .windows import KEY

DATA = {
    "label": "string", "label_final": "string", "label_raw": "string", "kind": "string", "start_v": "double", "end_v": "double", "delta_pct": "double", "value": "double", "z": "double", "delta_pct_vs_mean": "double",
    "has": "boolean", "period": "int", "strength": "double", "most": "int", "var": "string", "corr": "double", "lag": "int", "stable": "boolean", "note": "string", "min_v": "double", "max_v": "double", "std": "double",
}
ORDER = ("global_trend_label", "global_net_change", "ramp", "phase", "volatility_most_segment", "peak", "valley", "seasonality", "lagged_corr")


def _claim(claim: str, number=None, start=None, end=None, idx=None, **data) -> Column:
    """A claim as a struct."""
    name = F.lit({"volatility_most_segment": "volatility", "lagged_corr": "corr"}.get(claim, claim))
    place = F.lit(0) if number is None else number
    whole = [F.lit(ORDER.index(claim) * 1000) + place, name if number is None else F.concat_ws("_", name, number.cast("string")), F.lit(claim)]
    spans = [F.lit(None) if c is None else c for c in (start, end, idx)]
    cells = [data.get(k, F.lit(None)).cast(t).alias(k) for k, t in DATA.items()]
    return F.struct(whole[0].cast("int").alias("ord"), whole[1].alias("id"), whole[2].alias("type"), *[s.cast("int").alias(n) for s, n in zip(spans, ("start", "end", "idx"), strict=True)], *cells)


def _lag_claims(variables: list[str], least: float = 0.3, count: int = 3) -> Column:
    """The `count` greatest correlations of a window at or above `least`, as corr.kept_correlations() ranks them."""
    names = F.array(*[F.lit(v) for v in variables])
    found = F.transform("lags", lambda c: F.struct((-F.abs(c["corr"])).alias("o"), F.element_at(names, c["var"] + 1).alias("name"), c.alias("c"), corr_ops.is_stable(c).alias("stable")))
    kept = F.slice(F.array_sort(F.filter(found, lambda x: F.abs(x["c"]["corr"]) >= least)), 1, count)
    return F.transform(kept, lambda x, i: _claim("lagged_corr", i, var=x["name"], corr=x["c"]["corr"], lag=x["c"]["lag"], stable=x["stable"]))


def with_claims(known: DataFrame, variables: list[str] = ()) -> DataFrame:
    """Rows of features.window_features() with all claims about the window as an array, in order of ord."""
    last = F.col("n") - 1
    every = lambda events_, claim: F.transform(events_, claim)
    z = lambda e: {"value": e["value"], "z": e["z"], "delta_pct_vs_mean": e["delta_pct"]}
    spread = ("label", "start_v", "end_v", "delta_pct", "min_v", "max_v", "std")
    season = _claim("seasonality", None, F.lit(0), last, has=F.col("season.has") & F.col("season.period").isNotNull(), period=F.col("season.period"), strength=F.col("season.strength"))
    parts = [
        F.array(
            _claim("global_trend_label", None, F.lit(0), last, label=F.col("trend")),
            _claim("global_net_change", None, F.lit(0), last, start_v=F.col("start_v"), end_v=F.col("end_v"), delta_pct=F.col("delta_pct")),
        ),
        every("ramps", lambda e, k: _claim("ramp", k, e["start"], e["end"], kind=e["kind"], delta_pct=e["delta_pct"])),
        every("phases", lambda e: _claim("phase", e["phase"], e["start"], e["end"], **{c: e[c] for c in spread})),
        F.array(_claim("volatility_most_segment", None, F.lit(0), last, label=F.col("volatility"), most=F.col("most"))),
        every("peaks", lambda e, k: _claim("peak", k, idx=e["i"], **z(e))),
        every("valleys", lambda e, k: _claim("valley", k, idx=e["i"], **z(e))),
        F.array(season),
    ]
    if variables:
        parts.append(_lag_claims(list(variables)))
    return events.with_events(known).withColumn("claims", F.concat(*parts)).drop("ramps", "phases", "peaks", "valleys")


def build_claims(windows: DataFrame, variables: list[str] = (), known: DataFrame | None = None) -> DataFrame:
    """All claims of windows (value: the target; `variables`: columns to correlate with it), a row each.

    They come from a window's row of features.window_features() (`known`, if the caller has them), exploded once; points
    are brought together once, by window. Callers with many of them have them dealt by window (scan.dealt()).
    """
    known = window_features(windows, list(variables)) if known is None else known
    # no list is empty; inline() would have Spark test that first, on a copy of all that the list is made of
    return with_claims(known, variables).select(*KEY, F.inline_outer("claims"))


def _verdict(own, w, variables: list[str]) -> tuple[Column, Column, Column]:
    """ok, reason and evidence of the claim with the fields own(name), in the window with the columns w(name)."""
    value = lambda c: F.get(w("value"), own(c))
    kind = own("type")
    delta = (value("end") - value("start")) / F.when(value("start").isNotNull() | value("end").isNotNull(), w("scale")) * 100
    near = F.abs(delta - own("delta_pct")) <= F.when(kind == "global_net_change", 1.0).otherwise(2.0)
    z = F.when(value("idx").isNotNull(), F.when(w("std") < EPS, F.lit(0.0)).otherwise((value("idx") - w("mean")) / w("std")))
    names = F.array(*[F.lit(v) for v in variables]) if variables else F.array().cast("array<string>")
    lag = F.try_element_at(F.filter(w("lags"), lambda c: F.element_at(names, c["var"] + 1) == own("var")), F.lit(1))
    has, period = w("acf.has"), w("acf.period")
    ok = (
        F.when(kind == "global_trend_label", w("trend") == own("label"))
        .when(kind.isin("global_net_change", "ramp", "phase"), near)
        .when(kind.isin("peak", "valley"), (F.abs(z - own("z")) <= 0.2) & F.when(kind == "peak", z >= 1.0).otherwise(z <= -1.0))
        .when(kind == "seasonality", (has == own("has")) & (~has | own("period").isNull() | (F.abs(period - own("period")) <= 1)))
        .when(kind == "volatility_most_segment", w("most") == own("most"))
        .when(kind == "lagged_corr", (F.abs(lag["corr"] - own("corr")) <= 0.05) & (lag["lag"] == own("lag")) & (F.abs(lag["corr"]) >= 0.3))
    )
    evidence = (
        F.when(kind == "global_trend_label", w("trend")).when(kind.isin("peak", "valley"), F.round(z, 4).cast("string")).when(kind == "seasonality", F.concat_ws("/", has.cast("string"), period.cast("string")))
        .when(kind == "volatility_most_segment", w("most").cast("string")).when(kind == "lagged_corr", F.concat_ws("/", F.round(lag["corr"], 4).cast("string"), lag["lag"].cast("string"))).otherwise(F.round(delta, 4).cast("string"))
    )
    sound = F.coalesce(ok, F.lit(False))
    reason = F.when(sound, "").when((kind == "lagged_corr") & lag.isNull(), "var missing").when(kind == "phase", "phase_delta_mismatch").otherwise("mismatch")
    return sound, reason, evidence


def validate_claims(claims: DataFrame, windows: DataFrame, variables: list[str] = (), known: DataFrame | None = None) -> DataFrame:
    """Adds ok, reason and evidence (the recomputed number or word, as text) by recomputing each claim from the points.

    Tolerances: net change 1 point, ramps and phases 2, z 0.2, period 1, correlation 0.05. Seasonality is checked by
    autocorrelation alone, so a period that only the spectrum shows does not pass. A claim meets its window's row of
    features.window_features() (`known`, if the caller has them stored) in one join.
    """
    known = window_features(windows, list(variables), check=True) if known is None else known
    fields = ("mean", "std", "scale", "trend", "most", "acf", "lags", "value")
    all_ = claims.join(known.select(*KEY, F.struct(*fields).alias("_w")), KEY, "left")
    ok, reason, evidence = _verdict(F.col, lambda c: F.col(f"_w.{c}"), variables)
    return all_.select(*claims.columns, ok.alias("ok"), reason.alias("reason"), evidence.alias("evidence"))


def claim_check(checked: DataFrame) -> DataFrame:
    """n, n_failed, pass and the first ten failed ids of each window."""
    failed = F.transform(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("ord", "id")))), lambda x: x["id"])
    return checked.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("n_failed"), F.bool_and("ok").alias("pass"), F.slice(failed, 1, 10).alias("failed"))


def repair_trend(claims: DataFrame, least: float = 10.0) -> DataFrame:
    """Fills label_raw and label_final of the trend claim: a flat label with a net change of at least 10 % becomes
    what the first and last ramp say if there are ramps both ways, else the sign of the change."""
    w = Window.partitionBy(*KEY)
    net = F.max(F.when(F.col("type") == "global_net_change", F.col("delta_pct"))).over(w)
    is_ramp = F.col("type") == "ramp"
    first = F.min(F.when(is_ramp, F.struct("start", "kind"))).over(w)["kind"]
    last = F.max(F.when(is_ramp, F.struct("start", "kind"))).over(w)["kind"]
    both = F.when((first == "ramp_down") & (last == "ramp_up"), "down_then_up").when((first == "ramp_up") & (last == "ramp_down"), "up_then_down")
    repaired = F.coalesce(both, F.when(net > 0, "up").otherwise("down"))
    is_trend = F.col("type") == "global_trend_label"
    change = is_trend & (F.col("label") == "flat") & (F.abs(net) >= least)
    out = claims.withColumns({"label_raw": F.when(is_trend, F.col("label")), "label_final": F.when(change, repaired).when(is_trend, F.col("label"))})
    if "reason" in claims.columns:
        out = out.withColumn("reason", F.when(change & (F.col("label_raw") != F.col("label_final")), F.concat("reason", F.lit("|repaired:flat_vs_delta"))).otherwise(F.col("reason")))
    return out


def amplitude_note(claims: DataFrame, least: float = 30.0) -> DataFrame:
    """Notes a low step volatility beside an extreme at least 30 % off the mean."""
    reach = F.max(F.abs("delta_pct_vs_mean")).over(Window.partitionBy(*KEY))
    noted = (F.col("type") == "volatility_most_segment") & (F.col("label") == "low") & (reach >= least)
    return claims.withColumn("note", F.when(noted, "low_short_term_but_large_amplitude").otherwise(F.col("note")))


def apply_policy(claims: DataFrame) -> DataFrame:
    """Failed correlations stay as unstable, failed seasonality as absent, other failed claims go; the net change
    always stays."""
    failed, kind = ~F.col("ok"), F.col("type")
    kept = claims.where(F.col("ok") | kind.isin("lagged_corr", "seasonality", "global_net_change"))
    corr, season = failed & (kind == "lagged_corr"), failed & (kind == "seasonality")
    return kept.withColumns({
        "stable": F.when(corr, F.lit(False)).otherwise(F.col("stable")), "has": F.when(season, F.lit(False)).otherwise(F.col("has")), "period": F.when(season, F.lit(None).cast("int")).otherwise(F.col("period")),
        "ok": F.when(corr | season, F.lit(True)).otherwise(F.col("ok")),
    })


def apply_budget(claims: DataFrame, peaks: int = 1, valleys: int = 1, corrs: int = 1) -> DataFrame:
    """At most so many peaks and valleys by abs(z) and correlations (stable ones first, then by size)."""
    order = Window.partitionBy(*KEY, "type").orderBy(F.desc(F.coalesce("stable", F.lit(False))), F.desc(F.abs(F.coalesce("z", "corr", F.lit(0.0)))), "ord")
    most = F.when(F.col("type") == "peak", peaks).when(F.col("type") == "valley", valleys).when(F.col("type") == "lagged_corr", corrs)
    return claims.withColumn("_r", F.row_number().over(order)).where(most.isNull() | (F.col("_r") <= most)).drop("_r")


def target_segments(claims: DataFrame) -> DataFrame:
    """The segments worth a text: up to five phases by diversity, then two ramps by abs(delta_pct), then two extremes
    by abs(z): segment_id, type, start, end."""
    scored = events.phase_score(claims.where("type = 'phase'"))
    lists = scored.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(F.col("start"), F.col("end"), F.col("score")))).alias("p"))
    chosen = lists.select(*KEY, F.posexplode(F.transform(kernels.select_mmr("p"), lambda i: F.element_at("p", i + 1))).alias("r", "s"))
    phases = chosen.select(*KEY, F.lit(0).alias("g"), "r", F.lit("phase").alias("type"), "s.start", "s.end")

    def top(kinds: list[str], by: str, group: int) -> DataFrame:
        rows = claims.where(F.col("type").isin(kinds)).withColumn("r", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc(F.abs(by)), "ord")) - 1).where("r < 2")
        return rows.select(*KEY, F.lit(group).alias("g"), "r", "type", F.coalesce("start", "idx").alias("start"), F.coalesce("end", "idx").alias("end"))

    every = phases.unionByName(top(["ramp"], "delta_pct", 1)).unionByName(top(["peak", "valley"], "z", 2))
    return every.select(*KEY, (F.row_number().over(Window.partitionBy(*KEY).orderBy("g", "r")) - 1).alias("segment_id"), "type", "start", "end")


def checked_claims(rows: DataFrame, variables: list[str] = (), least: float = 10.0, reach: float = 30.0) -> DataFrame:
    """Rows of with_claims() (features with `check`) with their claims as apply_policy(amplitude_note(repair_trend(
    validate_claims()))) leaves them, with ok and reason; adds pass and n_failed as in claim_check()."""
    names = ["ord", "id", "type", "start", "end", "idx", *DATA]

    def judged(c: Column) -> Column:
        ok, reason, _ = _verdict(lambda x: c[x], F.col, variables)
        return F.struct(*[c[x].alias(x) for x in names], ok.alias("ok"), reason.alias("reason"))

    of = lambda kind: F.filter("claims", lambda c: c["type"] == kind)
    ramps = F.transform(of("ramp"), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind")))
    out = rows.withColumn("claims", F.transform("claims", judged))
    out = out.withColumns({
        "pass": F.forall("claims", lambda c: c["ok"]), "n_failed": F.size(F.filter("claims", lambda c: ~c["ok"])), "_net": F.array_max(F.transform(of("global_net_change"), lambda c: c["delta_pct"])),
        "_first": F.array_min(ramps)["kind"], "_last": F.array_max(ramps)["kind"], "_reach": F.array_max(F.transform("claims", lambda c: F.abs(c["delta_pct_vs_mean"]))),
    })
    first, last, net = F.col("_first"), F.col("_last"), F.col("_net")
    both = F.when((first == "ramp_down") & (last == "ramp_up"), "down_then_up").when((first == "ramp_up") & (last == "ramp_down"), "up_then_down")
    repaired = F.coalesce(both, F.when(net > 0, "up").otherwise("down"))

    def settled(c: Column) -> Column:
        kind, ok = c["type"], c["ok"]
        is_trend, corr, season = kind == "global_trend_label", ~ok & (kind == "lagged_corr"), ~ok & (kind == "seasonality")
        change = is_trend & (c["label"] == "flat") & (F.abs(net) >= least)
        noted = (kind == "volatility_most_segment") & (c["label"] == "low") & (F.col("_reach") >= reach)
        new = {
            "label_raw": F.when(is_trend, c["label"]), "label_final": F.when(change, repaired).when(is_trend, c["label"]), "note": F.when(noted, "low_short_term_but_large_amplitude").otherwise(c["note"]),
            "stable": F.when(corr, F.lit(False)).otherwise(c["stable"]), "has": F.when(season, F.lit(False)).otherwise(c["has"]), "period": F.when(~season, c["period"]),
        }
        reason = F.when(change, F.concat(c["reason"], F.lit("|repaired:flat_vs_delta"))).otherwise(c["reason"])
        return F.struct(*[new.get(x, c[x]).alias(x) for x in names], (ok | corr | season).alias("ok"), reason.alias("reason"))

    kept = F.filter("claims", lambda c: c["ok"] | c["type"].isin("lagged_corr", "seasonality", "global_net_change"))
    return out.withColumn("claims", F.transform(kept, settled)).drop("_net", "_first", "_last", "_reach")


def with_segments(rows: DataFrame) -> DataFrame:
    """Adds the segments of target_segments() to rows of claims, as an array of type, start and end in their order."""
    fields = ("start", "end", "start_v", "end_v", "delta_pct", "min_v", "max_v", "std")
    scored = F.transform(F.filter("claims", lambda c: c["type"] == "phase"), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), events.score_of(*[c[x] for x in fields]).alias("score")))
    segment = lambda kind, s: F.struct(kind.alias("type"), s["start"].alias("start"), s["end"].alias("end"))

    def top(kinds: list[str], by: str) -> Column:
        own = F.filter("claims", lambda c: c["type"].isin(kinds))
        order = F.transform(own, lambda c: F.struct((-F.coalesce(F.abs(c[by]), F.lit(-1.0))).alias("o"), c["ord"].alias("ord"), c["type"].alias("type"), F.coalesce(c["start"], c["idx"]).alias("start"), F.coalesce(c["end"], c["idx"]).alias("end")))
        return F.transform(F.slice(F.array_sort(order), 1, 2), lambda s: segment(s["type"], s))

    out = rows.withColumn("_scored", F.array_sort(scored)).withColumn("_chosen", kernels.select_mmr("_scored"))
    phases = F.transform("_chosen", lambda i: segment(F.lit("phase"), F.get("_scored", i)))
    return out.withColumn("segments", F.concat(phases, top(["ramp"], "delta_pct"), top(["peak", "valley"], "z"))).drop("_scored", "_chosen")


def time_at(times, i):
    """The time text at a place, clamped to the array."""
    return F.element_at(times, F.least(F.greatest(i, F.lit(0)), F.size(times) - 1) + 1)


def caption_records(windows: DataFrame, variables: list[str], dataset: str, task: str = "forecasting", target: str = "value", domain_context: str = "") -> DataFrame:
    """Whole records of windows with ts: checked and repaired claims, features, segments and a rendered caption.

    A window's points meet once; all else is done within its row. Callers with many windows have them dealt by window
    (scan.dealt()).
    """
    from .render import render_zh, summary_en

    points = windows.select(*KEY, "w_end", "n", "i", "value", *variables, F.date_format("ts", "yyyy-MM-dd HH:mm").alias("time"))
    # stored, since the choice of segments is a kernel over what comes of other kernels
    known = stored(window_features(points, variables, ["time"], check=True), "features")
    rows = checked_claims(with_claims(known, variables), variables)
    data = lambda c: F.struct(*[F.round(c[k], 4).alias(k) if t == "double" else c[k].alias(k) for k, t in DATA.items() if k != "std"])
    at = lambda i: F.when(i.isNotNull(), time_at(F.col("time"), i))
    claim = lambda c: F.struct(c["ord"].alias("ord"), c["id"].alias("id"), c["type"].alias("type"), F.lit(target).alias("target"), *[c[x].alias(x) for x in ("start", "end", "idx")], *[at(c[x]).alias(f"t_{x}") for x in ("start", "end", "idx")], data(c).alias("data"), F.lit(None).cast("string").alias("sentence"), c["ok"].alias("ok"), c["reason"].alias("reason"))
    rows = with_segments(rows).withColumn("claims", F.transform("claims", claim))
    joined = rows.withColumn("segments", F.transform("segments", lambda s, i: F.struct(i.alias("segment_id"), s["start"].alias("start"), s["end"].alias("end"), time_at(F.col("time"), s["start"]).alias("t_start"), time_at(F.col("time"), s["end"]).alias("t_end"), s["type"].alias("type"))))
    names = [target, *variables]
    step = lambda i: F.array(*[F.element_at(c, i + 1) for c in ("value", *variables)])
    matrix = F.transform(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), step)
    pick = lambda kind: F.try_element_at(F.filter("claims", lambda c: c["type"] == kind), F.lit(1))["data"]
    season = pick("seasonality")
    strength = features.strength_label(F.coalesce(season["has"], F.lit(False)), season["strength"])
    related = F.transform(F.filter("claims", lambda c: c["type"] == "lagged_corr"), lambda c: F.struct(F.array(F.lit(target), c["data"]["var"]).alias("pair"), c["data"]["corr"].alias("rho")))
    features_ = F.struct(pick("global_trend_label")["label_raw"].alias("trend"), pick("volatility_most_segment")["label"].alias("volatility"), F.struct(season["period"].alias("period"), strength.alias("strength")).alias("seasonality"), related.alias("correlations"))
    meta = F.array(*[F.struct(F.lit(v).alias("name"), F.lit(i).alias("index"), F.lit("feature" if i else "target").alias("role"), F.lit(v).alias("meaning"), F.lit("").alias("unit")) for i, v in enumerate(names)])
    joined = joined.withColumns({"_zh": render_zh(F.col("claims"), target, F.col("series_key"), F.col("w_start"), F.col("time")), "_en": summary_en(F.col("claims"))})
    zh, en = F.col("_zh"), F.col("_en")
    texts = F.transform("segments", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["t_start"].alias("t_start"), s["t_end"].alias("t_end"), s["type"].alias("type"), F.lit("").alias("description_zh"), F.lit("").alias("description_en")))
    return joined.select(
        F.lit(dataset).alias("dataset"), F.lit(task).alias("task"), F.col("series_key").cast("string").alias("series_key"), F.array("w_start", "w_end").cast("array<int>").alias("indices"), "time", matrix.alias("timeseries"), meta.alias("variables"),
        F.lit(None).cast("string").alias("label"), features_.alias("features"), F.transform("claims", lambda c: c.dropFields("ord", "data.min_v", "data.max_v")).alias("claims"), F.struct(F.col("pass"), F.col("n_failed").alias("n_failed")).alias("claim_check"),
        F.array(zh, en).alias("descriptions"), F.struct(F.struct(zh.alias("zh"), en.alias("en")).alias("global"), F.struct(zh.alias("zh"), en.alias("en")).alias("domain_integrated"), texts.alias("local"), F.lit("timestamp").alias("time_kind")).alias("dense_captions"), F.lit(domain_context).alias("domain_context"),
    )


def prompt_payload(records: DataFrame) -> DataFrame:
    """series_key, indices and one JSON text a record for an external writer: sound claims, features, local spans, domain."""
    sound = F.transform(F.filter("claims", lambda c: F.coalesce(c["ok"], F.lit(True))), lambda c: F.struct(c["id"].alias("id"), c["type"].alias("type"), c["start"].alias("start"), c["end"].alias("end"), c["idx"].alias("idx"), c["data"].alias("data")))
    spans = F.transform("dense_captions.local", lambda s, i: F.struct(i.alias("segment_id"), s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end")))
    return records.select("series_key", "indices", F.to_json(F.struct("features", sound.alias("claims"), spans.alias("segments"), "domain_context")).alias("payload"))
