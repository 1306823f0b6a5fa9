"""Queries over retrieval, grounding and caption quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.kernels import rouge_l
from ..operators import retrieval as r
from ..operators import texteval as m
from .views import table

Q, SQL = {}, {}
# The reference's defaults (eval_grounding.py): longest span, spans kept, series on the shortlist.
SPAN, KEEP, NEAR = 32, 5, 50


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def side(spark, d, k: int, group: str = "label"):
    e = table(spark, d, "embeddings").where(F.col("vec_id") % 2 == k)
    key = F.col("label").cast("long") if group == "label" else F.floor(F.col("vec_id") / 2)
    return e.select(F.col("vec_id").alias("id"), key.alias("group_key"), F.col("embedding").cast("array<double>").alias("vec"))


EMB = "e0 AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), emb AS (SELECT id, label, id // 2 AS inst, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-8)) AS v FROM e0)"


def ranks(key: str, q: int) -> str:
    return f"""{EMB}, s AS (SELECT a.id, b.id AS c, a.{key} = b.{key} AS pos, list_inner_product(a.v, b.v) AS sim FROM emb a JOIN emb b ON a.id % 2 = {q} AND b.id % 2 = {1 - q}),
 o AS (SELECT id, pos, row_number() OVER (PARTITION BY id ORDER BY sim DESC, c) AS rn FROM s),
 rk AS (SELECT id, coalesce(min(CASE WHEN pos THEN rn END), count(*) + 1) AS rank FROM o GROUP BY id)"""


@query("r1_normalized", f"WITH {EMB} SELECT id, CAST(unnest(range(len(v))) AS INT) AS dim, round(unnest(v), 9) AS x FROM emb")
def r1(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode(r.normalized(F.col("embedding").cast("array<double>"))).alias("dim", "x"))
    return e.withColumn("x", F.round("x", 9))


@query("r2_similarities", f"WITH {EMB}, s AS (SELECT a.id, b.id AS candidate, list_inner_product(a.v, b.v) AS sim FROM emb a JOIN emb b ON a.id % 2 = 0 AND b.id % 2 = 1) SELECT id, candidate, round(sim, 9) AS sim, row_number() OVER (PARTITION BY id ORDER BY sim DESC, candidate) AS rank FROM s QUALIFY rank <= 10")
def r2(spark, d):
    return r.shortlist(side(spark, d, 0), side(spark, d, 1), 10).withColumn("sim", F.round("sim", 9))


@query("r3_first_positive_rank", f"WITH {ranks('label', 0)} SELECT id, rank FROM rk")
def r3(spark, d):
    return r.first_positive_rank(side(spark, d, 0), side(spark, d, 1))


@query("r4_diagonal_rank", f"WITH {ranks('inst', 1)} SELECT id, rank FROM rk")
def r4(spark, d):
    return r.first_positive_rank(side(spark, d, 1, "inst"), side(spark, d, 0, "inst"))


REPORT = "SELECT '{0}' AS direction, count(*) AS queries, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 9) AS r1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 9) AS r5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 9) AS r10, quantile_cont(rank, 0.5) AS median, round(avg(rank), 9) AS mean, round(avg(1.0 / rank), 9) AS mrr FROM ({1})"


@query("r5_retrieval_report", REPORT.format("ts_to_text", f"WITH {ranks('inst', 0)} SELECT rank FROM rk") + " UNION ALL " + REPORT.format("text_to_ts", f"WITH {ranks('inst', 1)} SELECT rank FROM rk"))
def r5(spark, d):
    a, b = side(spark, d, 0, "inst"), side(spark, d, 1, "inst")
    one = r.rank_report(r.first_positive_rank(a, b)).withColumn("direction", F.lit("ts_to_text"))
    both = one.unionByName(r.rank_report(r.first_positive_rank(b, a)).withColumn("direction", F.lit("text_to_ts")))
    return both.withColumns({c: F.round(c, 9) for c in ("r1", "r5", "r10", "mean", "mrr")})


SPANS = "sp AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 60 AS a0, l_partkey % 60 + l_linenumber AS a1, l_suppkey % 60 AS b0, l_suppkey % 60 + CAST(l_quantity AS BIGINT) AS b1 FROM lineitem)"


@query("r6_iou", f"WITH {SPANS}, x AS (SELECT *, greatest(least(a1, b1) - greatest(a0, b0), 0) AS h, greatest(least(a1, b1) - greatest(a0, b0) + 1, 0) AS k FROM sp) SELECT l_orderkey, l_linenumber, l_partkey, round(h / (a1 - a0 + b1 - b0 - h), 9) AS half_open, round(k / (a1 - a0 + 1 + b1 - b0 + 1 - k), 9) AS inclusive FROM x")
def r6(spark, d):
    s, p = F.col("l_suppkey") % 60, F.col("l_partkey") % 60
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", p.alias("a0"), (p + F.col("l_linenumber")).alias("a1"), s.alias("b0"), (s + F.col("l_quantity").cast("long")).alias("b1"))
    ends = [F.col(c) for c in ("a0", "a1", "b0", "b1")]
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.round(r.iou(*ends), 9).alias("half_open"), F.round(r.iou(*ends, inclusive=True), 9).alias("inclusive"))


TOP = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), st AS (SELECT id, v, unnest(range(0, 64)) AS s FROM v), se AS (SELECT id, v, s, unnest(range(s + 1, least(s + {m}, 64) + 1)) AS e FROM st), sc AS (SELECT id, s, e, round(list_sum(v[s + 1:e]) / (e - s), 12) AS score FROM se), tp AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, e - s, s) AS rank FROM sc QUALIFY rank <= {k})"
TRUTH = "tr AS (SELECT vec_id AS id, CAST(vec_id % 50 AS INT) AS gs, CAST(vec_id % 50 + 1 + vec_id % 9 AS INT) AS ge FROM embeddings)"


def v_scores(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("values"))


def v_truth(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 50).cast("int").alias("gs"), (F.col("vec_id") % 50 + 1 + F.col("vec_id") % 9).cast("int").alias("ge"))


@query("r7_top_spans", f"WITH {TOP.format(m=8, k=5)} SELECT id, CAST(s AS INT) AS \"start\", CAST(e AS INT) AS \"end\", round(score, 9) AS score, CAST(rank AS INT) AS rank FROM tp")
def r7(spark, d):
    return r.top_spans(v_scores(spark, d), SPAN, KEEP).withColumn("score", F.round("score", 9))


@query("r8_pointing", f"WITH {TRUTH}, x AS (SELECT vec_id AS id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings), t AS (SELECT id, arg_max(i, (v, -i)) AS place FROM x GROUP BY id) SELECT id, CAST(place AS INT) AS place, place >= gs AND place < ge AS hit FROM t JOIN tr USING (id)")
def r8(spark, d):
    return r.pointing(v_scores(spark, d), v_truth(spark, d))


RECALL = "SELECT count(*) AS queries, round(avg(b1), 9) AS miou, " + ", ".join(f"round(avg(CASE WHEN b{k} >= {b} THEN 1.0 ELSE 0 END), 9) AS r{k}_iou{int(b * 10)}" for k in (1, 5) for b in (0.3, 0.5, 0.7)) + " FROM bb"
OVER = "ov AS (SELECT id, rank, greatest(least(e, ge) - greatest(s, gs), 0) AS h, e - s + ge - gs AS u FROM tp JOIN tr USING (id)), bb AS (SELECT id, max(CASE WHEN rank <= 1 THEN h / (u - h) END) AS b1, max(h / (u - h)) AS b5 FROM ov GROUP BY id)"


@query("r9_span_recall", f"WITH {TOP.format(m=8, k=5)}, {TRUTH}, {OVER} {RECALL}")
def r9(spark, d):
    out = r.span_recall(r.top_spans(v_scores(spark, d), SPAN, KEEP), v_truth(spark, d))
    return out.select("queries", *[F.round(c, 9).alias(c) for c in out.columns if c != "queries"])


def v_patches(spark, d):
    return table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("series"), (F.col("vec_id") % 10).cast("int").alias("patch"), F.col("embedding").cast("array<double>").alias("vec"))


PATCH = EMB + ", pt AS (SELECT id // 10 AS series, CAST(id % 10 AS INT) AS patch, v FROM emb)"


@query("r10_within_series", f"WITH {PATCH}, sc AS (SELECT q.id, p.patch, round(list_inner_product(q.v, p.v), 9) AS s FROM emb q JOIN pt p ON p.series = q.id // 10) SELECT id, arg_max(patch, (s, -patch)) AS place, round(max(s), 8) AS score FROM sc GROUP BY id")
def r10(spark, d):
    q = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 10).alias("series"), F.col("embedding").cast("array<double>").alias("vec"))
    best = r.top_spans(r.patch_scores(q, v_patches(spark, d)).select("id", "values"), 1, 1)
    return best.select("id", F.col("start").alias("place"), F.round("score", 8).alias("score"))


def v_series(spark, d):
    """A series' vector: the mean of its patches."""
    each = v_patches(spark, d).select("series", F.posexplode("vec").alias("dim", "x")).groupBy("series", "dim").agg(F.avg("x").alias("x"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"])
    return each.groupBy("series").agg(vec.alias("vec")).select(F.col("series").alias("id"), F.lit(0).cast("long").alias("group_key"), "vec")


def v_queries(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("group_key"), F.col("embedding").cast("array<double>").alias("vec"))


SERIES = "sd AS (SELECT id // 10 AS series, unnest(range(64)) AS dim, unnest(v) AS x FROM e0), sm AS (SELECT series, dim, avg(x) AS x FROM sd GROUP BY ALL), sv AS (SELECT series, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-8)) AS v FROM (SELECT series, list(x ORDER BY dim) AS v FROM sm GROUP BY series))"


@query("r11_corpus_grounding", f"""WITH {PATCH}, {SERIES}, sh AS (SELECT q.id, c.series FROM emb q CROSS JOIN sv c QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY list_inner_product(q.v, c.v) DESC, c.series) <= {NEAR}),
 sc AS (SELECT sh.id, sh.series, p.patch, round(list_inner_product(q.v, p.v), 12) AS s FROM sh JOIN emb q ON q.id = sh.id JOIN pt p ON p.series = sh.series), b AS (SELECT id, series, max(s) AS score FROM sc GROUP BY ALL)
 SELECT id, series, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, series) AS INT) AS rank, round(score, 9) AS score FROM b QUALIFY rank <= {KEEP}""")
def r11(spark, d):
    g = r.corpus_grounding(v_queries(spark, d), v_series(spark, d), v_patches(spark, d), near=NEAR, most=SPAN, count=KEEP)
    return g.select("id", "series", "rank", F.round("score", 9).alias("score"))


@query("r12_best_patch_shortlist", f"WITH {PATCH}, sc AS (SELECT q.id, p.series, max(list_inner_product(q.v, p.v)) AS sim FROM emb q CROSS JOIN pt p GROUP BY ALL) SELECT id, series, round(sim, 9) AS sim, CAST(row_number() OVER (PARTITION BY id ORDER BY sim DESC, series) AS INT) AS rank FROM sc QUALIFY rank <= 5")
def r12(spark, d):
    patches = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 10).alias("group_key"), F.col("embedding").cast("array<double>").alias("vec"))
    return r.best_patch_shortlist(v_queries(spark, d), patches, 5).withColumn("sim", F.round("sim", 9))


@query("r13_span_embedding", "WITH x AS (SELECT vec_id // 10 AS span_id, unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v, vec_id % 10 AS p FROM embeddings) SELECT span_id, CAST(dim AS INT) AS dim, round(avg(v), 9) AS value FROM x WHERE p >= span_id % 4 AND p < span_id % 4 + 3 GROUP BY ALL")
def r13(spark, d):
    patches = v_patches(spark, d)
    low = (F.col("series") % 4).cast("int")
    spans = patches.select("series").distinct().select(F.col("series").alias("span_id"), "series", low.alias("ps"), (low + 3).alias("pe"))
    return r.span_embedding(spans, patches).withColumn("value", F.round("value", 9))


@query("m1_parsed_answers", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'cap ' || user_id ELSE 'plain ' || user_id || ' } {' END AS caption, CASE WHEN event_id % 2 = 0 THEN event_type END AS trend FROM events")
def m1(spark, d):
    e = table(spark, d, "events")
    good = F.format_string('Sure: {"facts": {"trend": "%s"}, "caption": " cap %d "} done', "event_type", "user_id")
    rows = e.select("event_id", F.when(F.col("event_id") % 2 == 0, good).otherwise(F.format_string(" plain %d } {", "user_id")).alias("hyp"))
    return m.parse_answer(rows).select("event_id", "caption", F.col("facts.trend").alias("trend"))


def v_facts(spark, d):
    o = table(spark, d, "orders")
    trend = F.when(F.col("o_orderkey") % 3 == 0, "up").otherwise("down")
    gt = F.struct(trend.alias("trend"), (F.col("o_totalprice") / 1000).alias("delta_pct"), F.struct((F.col("o_orderkey") % 10).cast("double").alias("idx"), F.lit(1.0).alias("value")).alias("peak"), F.struct((F.col("o_orderkey") % 2 == 0).alias("has"), F.lit(None).cast("double").alias("period")).alias("seasonality"))
    pred = F.when(F.col("o_orderkey") % 5 != 0, F.struct(F.lit("up").alias("trend"), F.lit(100.0).alias("delta_pct"), F.struct((F.col("o_orderkey") % 7).cast("double").alias("idx"), F.lit(3.0).alias("value")).alias("peak"), F.struct(F.lit(True).alias("has"), F.lit(4.0).alias("period")).alias("seasonality")))
    rest = lambda s: s.withField("volatility", F.lit(None).cast("string")).withField("net_change_sign", F.lit(None).cast("string")).withField("valley", F.lit(None).cast("struct<idx: double, value: double>"))
    return o.select(F.col("o_orderkey").alias("id"), rest(gt).alias("gt"), rest(pred).alias("pred"))


FM = "fm AS (SELECT o_orderkey AS id, unnest(['fact_acc/trend', 'fact_mae/delta_pct', 'fact_mae/peak_idx', 'fact_mae/peak_value', 'fact_acc/seasonality_has']) AS metric, unnest([CAST(o_orderkey % 3 = 0 AS DOUBLE), abs(o_totalprice / 1000 - 100), CAST(abs(o_orderkey % 10 - o_orderkey % 7) AS DOUBLE), 2.0, CAST(o_orderkey % 2 = 0 AS DOUBLE)]) AS value FROM orders WHERE o_orderkey % 5 <> 0)"


@query("m2_factual_metrics", f"WITH {FM} SELECT id, metric, round(value, 9) AS value FROM fm")
def m2(spark, d):
    return m.factual_metrics(v_facts(spark, d)).withColumn("value", F.round("value", 9))


@query("m3_metric_means", f"WITH {FM} SELECT metric, round(avg(value), 6) AS mean, count(*) AS rows FROM fm GROUP BY metric")
def m3(spark, d):
    return m.metric_means(m.factual_metrics(v_facts(spark, d))).withColumn("mean", F.round("mean", 6))


def v_pairs(spark, d):
    c = table(spark, d, "conversations")
    said = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    asked = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("ref"))
    return asked.join(said, ["conv_id", "turn"]).select(F.concat_ws("/", "conv_id", "turn").alias("id"), "ref", "hyp")


# The table of longest common subsequences row by row: a line is the running maximum of its cells.
LCS = """WITH RECURSIVE p AS (SELECT a.conv_id || '/' || a.turn AS id, regexp_extract_all(lower(coalesce(a.text, '')), '[a-z0-9]+') AS r, regexp_extract_all(lower(coalesce(b.text, '')), '[a-z0-9]+') AS h
   FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant'),
 lcs AS (SELECT id, r, h, 0 AS i, list_transform(r, lambda x: 0) AS line FROM p
  UNION ALL SELECT id, r, h, i, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])) FROM (
   SELECT id, r, h, i + 1 AS i, list_transform(range(1, len(r) + 1), lambda j: CASE WHEN r[j] = h[i + 1] THEN coalesce(line[j - 1], 0) + 1 ELSE line[j] END) AS c FROM lcs WHERE i < len(h)))
 SELECT id, round(CASE WHEN len(r) = 0 OR len(h) = 0 THEN 0.0 ELSE 2 * line[-1] / (len(r) + len(h)) END, 9) AS rouge_l FROM lcs WHERE i = len(h)"""


@query("m4_rouge_l", LCS)
def m4(spark, d):
    return v_pairs(spark, d).select("id", F.round(rouge_l("ref", "hyp"), 9).alias("rouge_l"))


GRAMS = """p AS (SELECT a.conv_id || '/' || a.turn AS id, regexp_extract_all(a.text, '\\w+|[^\\w\\s]') AS r, regexp_extract_all(b.text, '\\w+|[^\\w\\s]') AS h FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant'),
 o AS (SELECT unnest(range(1, 5)) AS n), hg AS (SELECT id, n, g, count(*) AS c FROM (SELECT id, n, unnest(list_transform(range(1, len(h) - n + 2), lambda i: array_to_string(h[i:i + n - 1], ' '))) AS g FROM p, o) GROUP BY ALL),
 rg AS (SELECT id, n, g, count(*) AS c FROM (SELECT id, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], ' '))) AS g FROM p, o) GROUP BY ALL),
 bc AS (SELECT n, CAST(sum(least(hg.c, coalesce(rg.c, 0))) AS BIGINT) AS matched, CAST(sum(hg.c) AS BIGINT) AS total FROM hg LEFT JOIN rg USING (id, n, g) GROUP BY n)"""


@query("m5_bleu_counts", f"WITH {GRAMS} SELECT CAST(n AS INT) AS n, matched, total FROM bc")
def m5c(spark, d):
    return m.bleu_counts(v_pairs(spark, d))


@query("m5_corpus_bleu", f"WITH {GRAMS}, z AS (SELECT CAST(sum(len(r)) AS BIGINT) AS ref_len, CAST(sum(len(h)) AS BIGINT) AS hyp_len FROM p), s AS (SELECT sum(CASE WHEN matched > 0 THEN ln(matched / total) END) / 4 AS lg, count(*) FILTER (WHERE matched > 0) AS orders FROM bc), q AS (SELECT *, CASE WHEN hyp_len >= ref_len THEN 1.0 ELSE exp(1 - ref_len / greatest(hyp_len, 1)) END AS pen FROM z, s) SELECT round(CASE WHEN orders = 4 THEN 100 * pen * exp(lg) ELSE 0 END, 9) AS bleu, round(pen, 9) AS penalty, ref_len, hyp_len FROM q")
def m5(spark, d):
    return m.corpus_bleu(v_pairs(spark, d)).withColumns({"bleu": F.round("bleu", 9), "penalty": F.round("penalty", 9)})
