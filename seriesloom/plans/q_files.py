"""Queries over readers, writers, the user hook and the incremental job: data derived from the tables is written in
the input formats and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hooks import with_hook
from ..operators import tables as t
from ..operators.texteval import factual_metrics, metric_means
from ..sources import readers as r
from ..sources import series_source
from ..sources import writers as w
from ..streaming.incremental import stream_records
from .q_data import v_fred
from .q_eval import FM, v_facts
from .q_records import CLAIMS, FACT_TEXT, prompts_sql, records, v_records
from .q_windows import GT
from .shared import shared_path
from .views import USER, table, v_daily, v_user, window_cte

Q, SQL = {}, {}
#: Files that a task writes, where each series has one of its own.
FILES = 100


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


DAILY = "SELECT strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') AS date, round(sum(l_quantity), 2) AS qty, CAST(count(*) AS DOUBLE) AS lines FROM lineitem GROUP BY 1"


def wide_files(spark, d):
    path = shared_path(spark, "wide")
    wide = v_daily(spark, d).select(F.date_format("day", "yyyy-MM-dd").alias(" date "), F.col("qty").alias(" qty"), F.col("lines").alias("lines "), F.lit("x").alias("note"))
    wide.write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path, header=True)
    return path


@query("s1_s3_wide_csv", DAILY)
def s1(spark, d):
    return r.read_wide_csv(spark, wide_files(spark, d))


def labelled_files(spark, d):
    path = shared_path(spark, "labelled")
    lists = v_user(spark, d).groupBy("series_key").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("p"))
    k = F.col("series_key") % 6
    label = F.when(k == 0, "bad").otherwise(F.format_string("%d.0", k))
    lists.select(F.concat_ws("\t", label, F.array_join(F.transform("p.value", lambda v: v.cast("string")), "\t")).alias("value")).write.text(path)
    return path


@query("s5_labelled_rows", "WITH e AS (SELECT user_id, arg_max(event_id, event_id) AS m, count(*) AS n, round(sum(value), 2) AS s FROM events GROUP BY 1) SELECT CASE WHEN user_id % 6 <> 0 THEN CAST(user_id % 6 AS INT) END AS label, CAST(sum(n) AS BIGINT) AS points, round(sum(s), 2) AS total, count(*) AS rows FROM e GROUP BY 1")
def s5(spark, d):
    rows = r.read_labelled(spark, labelled_files(spark, d), "user", "TRAIN")
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return rows.groupBy("label").agg(F.sum("size").alias("points"), F.round(F.sum(total), 2).alias("total"), F.count("*").alias("rows"))


@query("s5b_label_last", "SELECT CAST(user_id AS INT) AS label, count(*) AS points FROM events GROUP BY 1")
def s5b(spark, d):
    lists = v_user(spark, d).groupBy("series_key").agg(F.collect_list(F.col("value").cast("string")).alias("p"))
    lines = lists.select(F.concat(F.array_join("p", ", "), F.lit("  "), F.col("series_key").cast("string")).alias("value"))
    return r.parse_labelled(lines, r"[\s,]+", label_last=True).select("label", F.col("size").cast("long").alias("points"))


def metric_files(spark, d):
    path = shared_path(spark, "metrics")
    rows = v_user(spark, d).select(F.col("series_key").alias("u"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("value").cast("string").alias("value"))
    # tasks by the number of files, which cost more than their few bytes tell
    tasks = -(-rows.agg(F.count_distinct("u")).first()[0] // FILES)
    rows.repartition(max(tasks, 1), "u").write.partitionBy("u").csv(f"{path}/group", header=True)
    return path


@query("s6_metric_tree", "SELECT 'group/u=' || user_id AS series, count(*) AS points, round(sum(value), 2) AS total FROM events GROUP BY 1")
def s6(spark, d):
    path = metric_files(spark, d)
    series = F.regexp_extract("series_key", r"^(.*)/[^/]*$", 1)
    return r.read_metrics(spark, path).groupBy(series.alias("series")).agg(F.count("*").alias("points"), F.round(F.sum("value"), 2).alias("total"))


def economic_files(spark, d):
    path = shared_path(spark, "economic")
    rows = v_fred(spark, d)
    body = F.to_json(F.struct(F.col("k").alias("index"), "cols", "timestamp", F.col("series")["timeseries1"].alias("timeseries1"), F.col("series")["timeseries2"].alias("timeseries2"), F.lit("m").alias("message")))
    rows.select(F.explode(F.array(body, F.lit("{bad"))).alias("value")).write.text(path)
    return path


@query("s10_s11_economic", "WITH o AS (SELECT o_custkey AS k, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS t, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), p AS (SELECT k, t, unnest(['a', 'b']) AS name, unnest([CASE WHEN k % 11 <> 0 THEN v ELSE 0 END, CASE WHEN k % 11 <> 0 AND k % 17 <> 0 AND t < n - k % 30 THEN v ELSE 0 END]) AS value FROM o WHERE true) SELECT CAST(k AS VARCHAR) AS index, name, count(*) AS points, round(sum(value), 2) AS total FROM p WHERE k % 13 <> 0 OR name = 'a' GROUP BY ALL")
def s10(spark, d):
    points = r.economic_points(r.read_economic(spark, economic_files(spark, d)))
    return points.groupBy("index", "name").agg(F.count("*").alias("points"), F.round(F.sum("value"), 2).alias("total"))


@query("u1_datasets", " UNION ALL ".join(f"SELECT '{name}' AS dataset, CAST(sum(points) AS BIGINT) AS points, round(sum(total), 1) AS total FROM ({sql})" for name, sql in (("daily", f"SELECT 1 AS points, qty AS total FROM ({DAILY})"), ("ucr2018", SQL["s5_labelled_rows"]), ("nab", SQL["s6_metric_tree"]), ("fred", SQL["s10_s11_economic"]))))
def u1(spark, d):
    """Each reader of the registry by its name."""
    wide = r.read_dataset(spark, "daily", wide_files(spark, d)).select(F.lit("daily").alias("dataset"), F.lit(1).alias("size"), F.col("qty").alias("value"))
    ucr = r.read_dataset(spark, "ucr2018", labelled_files(spark, d), series="user").select(F.lit("ucr2018"), "size", F.aggregate("values", F.lit(0.0), lambda a, x: a + x))
    nab = r.read_dataset(spark, "nab", metric_files(spark, d)).select(F.lit("nab"), F.lit(1), "value")
    fred = r.economic_points(r.read_dataset(spark, "fred", economic_files(spark, d))).select(F.lit("fred"), F.lit(1), "value")
    return wide.union(ucr).union(nab).union(fred).groupBy("dataset").agg(F.sum("size").alias("points"), F.round(F.sum("value"), 1).alias("total"))


def source_points(spark, d, read, names=("daily", "ucr2018", "nab", "fred")):
    """Files of the formats through the data source; `read` is a reader or a stream's reader of the format."""
    series_source.register(spark)
    files = {"daily": (wide_files, {"series": "qty"}), "ucr2018": (labelled_files, {"series": "user"}), "nab": (metric_files, {}), "fred": (economic_files, {})}
    return reduce(DataFrame.unionByName, [read(n).options(dataset=n, **files[n][1]).load(files[n][0](spark, d)) for n in names])


@query("u1_series_source", SQL["u1_datasets"])
def u1_source(spark, d):
    """The registry as a data source of Spark."""
    points = source_points(spark, d, lambda _: spark.read.format("seriesloom"))
    return points.groupBy("dataset").agg(F.count("*").alias("points"), F.round(F.sum("value"), 1).alias("total"))


@query("u1_series_stream", SQL["u1_datasets"])
def u1_stream(spark, d):
    """The same as streams: all files there are, then the sink is read."""
    path = shared_path(spark, "stream")
    points = source_points(spark, d, lambda name: spark.readStream.format("seriesloom").option("log", f"{path}/seen/{name}"))
    points.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(series_source.POINTS).parquet(f"{path}/out")
    return out.groupBy("dataset").agg(F.count("*").alias("points"), F.round(F.sum("value"), 1).alias("total"))


@query("s6_s10_series_source", f"SELECT 'nab' AS dataset, series, points, total FROM ({SQL['s6_metric_tree']}) UNION ALL SELECT 'fred', index || '/' || name, points, total FROM ({SQL['s10_s11_economic']})")
def s6_source(spark, d):
    """Metric files and economic lines by series."""
    points = source_points(spark, d, lambda _: spark.read.format("seriesloom"), ("nab", "fred"))
    series = F.when(F.col("dataset") == "nab", F.regexp_extract("series_key", r"^(.*)/[^/]*$", 1)).otherwise(F.col("series_key"))
    return points.groupBy("dataset", series.alias("series")).agg(F.count("*").alias("points"), F.round(F.sum("value"), 2).alias("total"))


@query("s13_readme", "WITH t AS (SELECT l_suppkey, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_orderkey, l_linenumber, l_partkey) || chr(10) AS text FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey AS supplier, CAST(least(len(text), 8000) AS INT) AS chars, md5(substr(text, 1, 8000)) AS digest FROM t")
def s13(spark, d):
    """One file a supplier, with the parts of its lines in order; longer ones are cut."""
    path = shared_path(spark, "readme")
    parts = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey")))
    texts = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.transform(parts, lambda p: p["l_partkey"].cast("string")), " ").alias("value"))
    texts.repartition("l_suppkey").write.partitionBy("l_suppkey").text(path)
    supplier = F.regexp_extract("path", r"l_suppkey=(\d+)", 1).cast("long")
    return r.read_readme(spark, path).select(supplier.alias("supplier"), F.length("text").cast("int").alias("chars"), F.md5("text").alias("digest"))


@query("k1_k2_records", "SELECT CAST(o_orderkey AS VARCHAR) AS series_key, o_orderkey % 5 <> 0 AS pass, 1 AS c FROM orders")
def k1(spark, d):
    path = shared_path(spark, "records")
    rows = v_records(spark, d).withColumn("indices", F.array(F.lit(0), F.lit(0)))
    w.write_records(rows.where("cast(series_key as long) % 2 = 0"), path)
    w.append_records(rows, path)
    w.append_records(rows, path)  # nothing is left to append
    return r.read_records(spark, path).groupBy("series_key", "claim_check.pass").agg(F.count("*").cast("int").alias("c"))


@query("k3_sft_rows", f"SELECT 'o:t:' || o_orderkey || '::' || style || '_en' || CASE WHEN style = 'facts_only' THEN '' ELSE '_single' END AS id, prompt, CASE WHEN style = 'caption_only' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'caption ' || o_orderkey WHEN o_orderkey % 7 <> 0 THEN 'd0' ELSE caption END END AS output FROM orders JOIN ({FACT_TEXT}) x ON x.series_key = CAST(o_orderkey AS VARCHAR), {prompts_sql('en')}")
def k3(spark, d):
    path = shared_path(spark, "sft")
    w.write_sft(t.build_sft(v_records(spark, d)), path)
    return spark.read.schema("id string, prompt string, output string").json(path).select("id", "prompt", F.when(F.col("id").contains("caption_only"), F.col("output")).alias("output"))


def prediction_files(spark, d):
    path = shared_path(spark, "predictions")
    facts = v_facts(spark, d)
    w.write_predictions(facts, metric_means(factual_metrics(facts)), path)
    return path


@query("k4_predictions", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'up' ELSE 'down' END AS truth, round(o_totalprice / 1000, 6) AS delta_pct, CASE WHEN o_orderkey % 5 <> 0 THEN 'up' END AS said FROM orders")
def k4(spark, d):
    back = spark.read.schema("id long, gt struct<trend: string, delta_pct: double>, pred struct<trend: string>").json(f"{prediction_files(spark, d)}/predictions")
    return back.select("id", F.col("gt.trend").alias("truth"), F.round("gt.delta_pct", 6).alias("delta_pct"), F.col("pred.trend").alias("said"))


@query("k4_metric_file", f"WITH {FM} SELECT metric, round(avg(value), 6) AS mean FROM fm GROUP BY metric")
def k4m(spark, d):
    back = spark.read.schema("metrics map<string, double>").json(f"{prediction_files(spark, d)}/metrics")
    return back.select(F.explode("metrics").alias("metric", "mean")).withColumn("mean", F.round("mean", 6))


@query("x2_merged_shards", "SELECT 'set' || o_orderkey % 16 AS source_dataset, CAST(o_orderkey AS VARCHAR) AS series_key FROM orders")
def x2(spark, d):
    """One file a data set under the name that such files have: written by Spark, then renamed."""
    path = shared_path(spark, "shards")
    rows = v_records(spark, d).withColumn("kind", F.col("series_key").cast("long") % 16)
    rows.repartition(16, "kind").write.partitionBy("kind").json(path)
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for file in fs.globStatus(at(f"{path}/kind=*/*.json")):
        kind = file.getPath().getParent().getName().removeprefix("kind=")
        fs.rename(file.getPath(), at(f"{path}/ucr_set{kind}_train.jsonl"))
    return r.read_shards(spark, f"{path}/ucr_*_train.jsonl").select("source_dataset", "series_key")


@query("s12_read_records", f"WITH {GT}, c AS (SELECT series_key, w_start, count(*) AS claims FROM ({CLAIMS}) GROUP BY ALL), w AS (SELECT DISTINCT series_key, w_start, w_end, n FROM win) SELECT CAST(series_key AS VARCHAR) AS series_key, CAST(w_start AS INT) AS w_start, CAST(w_end AS INT) AS w_end, CAST(claims AS INT) AS claims, CAST(n AS INT) AS steps, trend FROM w JOIN c USING (series_key, w_start) JOIN gt USING (series_key, w_start)")
def s12(spark, d):
    path = shared_path(spark, "window-records")
    w.write_records(records(spark, d), path, partitioned=True)
    back = r.read_records(spark, path)
    return back.select("series_key", F.col("indices")[0].alias("w_start"), F.col("indices")[1].alias("w_end"), F.size("claims").alias("claims"), F.size("timeseries").alias("steps"), "features.trend")


@query("u3_caption_hook", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'hook ' || doc_id ELSE 'base' END AS caption FROM documents")
def u3(spark, d):
    samples = table(spark, d, "documents").select("doc_id", F.lit("base").alias("caption"))
    return with_hook(samples, lambda row: f"hook {row['doc_id']}" if row["doc_id"] % 3 == 0 else "no")


@query("y1_stream_records", f"WITH {USER}, {window_cte('usr', 32, 16)} SELECT CAST(series_key AS VARCHAR) AS series_key, w_start, w_start + n - 1 AS w_end FROM win GROUP BY ALL")
def y1(spark, d):
    root = shared_path(spark, "stream")
    points = v_user(spark, d).select(F.col("series_key").cast("string").alias("series_key"), "t", "ts", "value")

    def build(win):
        spans = win.where("i = 0").select("series_key", F.array("w_start", "w_end").cast("array<int>").alias("indices"))
        return spans.select(F.lit("events").alias("dataset"), "series_key", "indices")

    files = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by series, so that each is whole in one file
    for part in (0, 1):  # two arrivals
        points.where(F.col("series_key").cast("long") % 2 == part).repartition(files, "series_key").write.mode("append").parquet(f"{root}/in")
        stream_records(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", build, 32, 16)
    back = r.read_records(spark, f"{root}/out")
    return back.select("series_key", F.col("indices")[0].cast("long").alias("w_start"), F.col("indices")[1].cast("long").alias("w_end"))


@query("y1_growing_series", f"WITH {USER}, {window_cte('usr', 32, 16)} SELECT CAST(series_key AS VARCHAR) AS series_key, w_start, w_end, count(*) AS points, round(sum(value), 4) AS total FROM win WHERE n = 32 GROUP BY ALL")
def y1g(spark, d):
    """Each user's series in three arrivals, cut anywhere; windows end up as in the batch job."""
    root = shared_path(spark, "growing")
    points = v_user(spark, d).select(F.col("series_key").cast("string").alias("series_key"), "t", "ts", "value")
    size = points.groupBy("series_key").agg(F.count("*").alias("n"))
    cut = points.join(size, "series_key").withColumn("part", F.floor(F.col("t") * 3 / F.col("n")))

    def build(win):
        values = F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda p: p["value"])
        spans = win.groupBy("series_key", "w_start", "w_end").agg(F.array(values).alias("timeseries"))
        return spans.select(F.lit("events").alias("dataset"), "series_key", F.array("w_start", "w_end").cast("array<int>").alias("indices"), "timeseries")

    for part in (0, 1, 2):
        cut.where(F.col("part") == part).select(*points.columns).write.mode("append").parquet(f"{root}/in")
        stream_records(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", build, 32, 16, growing=True)
    back, series = r.read_records(spark, f"{root}/out"), F.col("timeseries")[0]
    total = F.round(F.aggregate(series, F.lit(0.0), lambda a, x: a + x), 4)
    return back.select("series_key", F.col("indices")[0].cast("long").alias("w_start"), F.col("indices")[1].cast("long").alias("w_end"), F.size(series).cast("long").alias("points"), total.alias("total"))
