"""Readers and sinks as queries: each writes files of the shape it reads into the shared folder, from the shared tables,
and reads them back through the reader; SQL gives what should come out.
"""

from __future__ import annotations

import http.server
import json
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import parse_qs, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import joins, ranking
from .plans import reports
from .queries import _TEXTS, _sql_answer, query
from .sources import archives, paged, readers, sinks, staging
from .sources.keyed import KeyedCache
from .streaming import incremental


def folder(t, name: str) -> tuple[SparkSession, str]:
    spark = t("region").sparkSession
    return spark, staging.new_path(spark, name)


def put(df: DataFrame, path: str, file: str) -> None:
    """One row of text as a file of this name, by way of Spark's writer, so on any file system."""
    spark = df.sparkSession
    part = staging.new_path(spark, "part")
    df.coalesce(1).write.text(part)
    paths = spark._jvm.org.apache.hadoop.fs.Path
    fs = paths(part).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(paths(path))
    written = [x.getPath() for x in fs.listStatus(paths(part)) if x.getPath().getName().startswith("part-")]
    fs.rename(written[0], paths(f"{path}/{file}"))
    fs.delete(paths(part), True)


def as_array(df: DataFrame, *order: str) -> DataFrame:
    """A small table as one JSON array."""
    return df.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*df.columns).alias("_r")))), lambda x: x["_r"])).alias("value"))


ITEM_SQL = "o_orderkey AS index, 'v' || o_custkey AS video_path, CASE WHEN o_orderkey % 3 = 0 THEN 'yes' ELSE 'b' END AS answer"


def order_items(t) -> DataFrame:
    kind = F.when(F.col("o_orderkey") % 3 == 0, F.lit(None)).otherwise("multiple_choice_4")
    answer = F.when(F.col("o_orderkey") % 3 == 0, " Yes ").otherwise("B")
    path = F.concat(F.lit("v"), F.col("o_custkey").cast("string"))
    return t("orders").select(F.col("o_orderkey").alias("index"), path.alias("video_path"), F.col("o_orderpriority").alias("question"), answer.alias("answer"), kind.cast("string").alias("type"), F.lit(1).alias("more"))


@query(f"SELECT {ITEM_SQL}, CASE WHEN o_orderkey % 3 = 0 THEN 'yes_no' ELSE 'mcq4' END AS type FROM orders")
def answer_key_lines(t):
    spark, path = folder(t, "items")
    sinks.json_lines(order_items(t), path)
    return readers.truth(spark, path).select("index", "video_path", "answer", "type")


@query("SELECT n_nationkey AS index, n_name AS video_path, 'mcq4' AS type FROM nation UNION ALL SELECT 1000 + r_regionkey, r_name, 'yes_no' FROM region")
def item_arrays_and_lines(t):
    spark, path = folder(t, "arrays")
    put(as_array(t("nation").select(F.col("n_nationkey").alias("index"), F.col("n_name").alias("video_path")), "index"), path, "a.json")
    lines = t("region").select(F.to_json(F.struct((1000 + F.col("r_regionkey")).alias("index"), F.col("r_name").alias("video_path"), F.lit("yes_no").alias("type"))).alias("value"))
    put(lines, path, "b.jsonl")
    return readers.mcq_items(spark, path).select("index", "video_path", "type")


@query("""SELECT 'uniform' AS sampler, 8 AS num_frames, 'none' AS ablation, CAST(n_nationkey AS BIGINT) AS index, n_name AS model_output, 'uniform' AS strategy FROM nation
UNION ALL SELECT 'random', 4, 'shuffled_frames', CAST(r_regionkey AS BIGINT), r_name, 'random' FROM region""")
def prediction_cells(t):
    spark, path = folder(t, "predictions")
    flat = t("nation").select(F.col("n_nationkey").alias("index"), F.col("n_name").alias("model_output"), F.lit("uniform").alias("strategy"))
    nested = t("region").select(F.col("r_regionkey").alias("index"), F.col("r_name").alias("model_output"), F.struct(F.lit("random").alias("strategy"), F.lit(2).alias("seed")).alias("frames"))
    for name in ("m_s_uniform8.json", "_m_s_uniform8.json", "m_s_uniform8_metrics.json", "m_smoke_s_uniform8.json"):
        put(as_array(flat, "index"), path, name)
    put(as_array(nested, "index"), path, "m_s_random4_shuf7.json")
    put(spark.range(1).select(F.lit("{broken").alias("value")), path, "m_s_uniform16.json")
    return readers.predictions(spark, path).select("sampler", "num_frames", "ablation", "index", "model_output", "strategy")


@query("SELECT 'hornet' AS sampler, 16 AS num_frames, 'videos/' || n_name AS key, CAST(n_nationkey AS INT) AS first_index, CAST(n_regionkey AS INT) AS second_index, n_nationkey * 0.5 AS scale FROM nation")
def frozen_selections(t):
    spark, path = folder(t, "selections")
    entry = F.struct(F.array("n_nationkey", "n_regionkey").alias("indices"), F.array(F.col("n_nationkey") * 0.5).alias("scales"))
    items = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("videos/"), F.col("n_name")), entry)))
    chosen = t("nation").agg(F.to_json(F.struct(F.struct(F.lit("hornet").alias("sampler")).alias("meta"), items.alias("items"))).alias("value"))
    put(chosen, path, "hornet16.json")
    put(chosen, path, "notes.json")
    got = readers.selections(spark, path)
    return got.select("sampler", "num_frames", "key", F.col("indices")[0].alias("first_index"), F.col("indices")[1].alias("second_index"), F.col("scales")[0].alias("scale"))


@query("SELECT 'uniform' AS sampler, CAST(r_regionkey + 1 AS INT) AS num_frames, CASE WHEN r_regionkey % 2 = 0 THEN '' ELSE 'full_pool64' END AS variant, r_regionkey / 8.0 AS I_Acc, CAST(r_regionkey AS BIGINT) AS TP FROM region")
def quad_metric_files(t):
    spark, path = folder(t, "quad-metrics")
    rows = t("region").select("r_regionkey", (F.col("r_regionkey") / 8).alias("I_Acc"), F.struct(F.col("r_regionkey").alias("TP")).alias("confusion"))
    documents = sinks.metrics_json(rows, ["r_regionkey"])
    for i in range(5):
        name = f"m_uniform{i + 1}{'_full_pool64' if i % 2 else ''}_metrics.json"
        put(documents.where(F.col("r_regionkey") == i).select("document"), path, name)
        put(documents.where(F.col("r_regionkey") == i).select("document"), path, f"m{name}")
    return readers.quad_metrics(spark, path, "m").select("sampler", "num_frames", "variant", "I_Acc", F.col("confusion.TP").alias("TP"))


@query("SELECT 'f2c' AS sampler, CAST(r_regionkey + 1 AS INT) AS num_frames, r_regionkey * 10.0 AS Acc_pct, r_regionkey * 1.0 AS short_pct FROM region WHERE r_regionkey <> 3")
def mcq_metric_files(t):
    spark, path = folder(t, "mcq-metrics")
    short = F.create_map(F.lit("short"), F.struct((F.col("r_regionkey") * 1.0).alias("Acc_pct")))
    config = F.struct(F.when(F.col("r_regionkey") == 3, "no_video").otherwise("none").alias("ablation"))
    rows = t("region").select("r_regionkey", (F.col("r_regionkey") * 10.0).alias("Acc_pct"), short.alias("by_duration"), config.alias("config"))
    documents = sinks.metrics_json(rows, ["r_regionkey"])
    for i in range(5):
        put(documents.where(F.col("r_regionkey") == i).select("document"), path, f"m_f2c{i + 1}_metrics.json")
    return readers.mcq_metrics(spark, path, "m").select("sampler", "num_frames", "Acc_pct", F.col("by_duration")["short"]["Acc_pct"].alias("short_pct"))


@query("SELECT 'uniform' AS strategy, CAST(event_id % 4 AS INT) AS nframes, CASE WHEN event_id % 4 = 0 THEN 'no_video' ELSE 'none' END AS ablation, event_id AS index, event_type AS gold, CAST(event_id % 2 AS INT) AS correct, event_id || ' 7' AS frame_indices FROM events")
def per_question_files(t):
    """Written by cell, with some rows twice; each question counts once a cell."""
    spark, path = folder(t, "per-question")
    k = F.col("event_id")
    rows = t("events").select(
        F.lit("uniform").alias("strategy"), (k % 4).cast("int").alias("nframes"), F.when(k % 4 == 0, "no_video").otherwise("none").alias("ablation"), k.alias("index"), F.col("event_type").alias("gold"),
        (k % 2).cast("int").alias("correct"), F.array(k.cast("int"), F.lit(7)).alias("frame_indices"), F.array(F.lit(1.5)).alias("f2c_scales"),
    )
    sinks.cells(rows.unionByName(rows.where("index % 5 = 0")), path)
    return readers.per_question(spark, path).select("strategy", "nframes", "ablation", "index", "gold", "correct", "frame_indices")


SWEEP = """SELECT c_mktsegment AS model, 'd' AS dataset, 'uniform' AS sampler, CAST(c_nationkey AS INT) AS num_frames, CAST(count(*) AS DOUBLE) AS I_Acc FROM customer WHERE c_nationkey % 3 = 0 GROUP BY ALL"""


@query(f"SELECT * FROM ({SWEEP}) WHERE num_frames % 2 = 0")
def sweep_file(t):
    """Cells of a sweep with a result that belong to one dataset and are no ablation."""
    spark, path = folder(t, "sweep")
    cells = t("customer").where("c_nationkey % 3 = 0").groupBy(F.col("c_mktsegment").alias("model"), F.col("c_nationkey").alias("num_frames")).agg(F.count("*").alias("n"))
    rows = cells.select("model", F.lit("d").alias("dataset"), F.lit("uniform").alias("sampler"), "num_frames", F.when(F.col("num_frames") % 2 == 0, F.col("n")).alias("I_Acc"), F.lit(None).cast("string").alias("ablation"))
    more = rows.withColumn("dataset", F.lit("e")).unionByName(rows.withColumn("ablation", F.lit("no_video")))
    sinks.table_csv(rows.unionByName(more), path)
    return readers.sweep(spark, path, "d").select("model", "dataset", "sampler", "num_frames", "I_Acc")


@query("SELECT event_id AS index, CASE WHEN event_id % 2 = 0 THEN 8 ELSE 0 END AS nframes, 'a \"b\", c' AS gold FROM events WHERE event_id % 3 < 2 OR event_id % 2 = 1")
def combined_export(t):
    """Rows without a budget stay only in the arm without video."""
    spark, path = folder(t, "combined")
    k = F.col("event_id")
    rows = t("events").select(k.alias("index"), F.when((k % 2 == 0) & (k % 3 < 2), 8).alias("nframes"), F.when(k % 2 == 1, "no_video").alias("ablation"), F.lit('a "b", c').alias("gold"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return readers.combined_cells(spark, path).select("index", "nframes", "gold")


@query("SELECT count(*) AS n, false AS shrunk, true AS grew FROM (SELECT c_custkey FROM customer UNION ALL SELECT c_custkey FROM customer)")
def export_never_shrinks(t):
    spark, path = folder(t, "guarded")
    df = t("customer").select("c_custkey")
    sinks.replace_unless_smaller(df, path)
    shrunk = sinks.replace_unless_smaller(df.where("c_custkey % 2 = 0"), path)
    grew = sinks.replace_unless_smaller(df.unionByName(df), path)
    return sinks.current(spark, path).agg(F.count("*").alias("n")).select("n", F.lit(shrunk).alias("shrunk"), F.lit(grew).alias("grew"))


@query("""WITH u AS (SELECT DISTINCT user_id AS video FROM events), n AS (SELECT count(*) FILTER (video % 2 = 0) AS first_run, count(*) FILTER (video % 2 = 1) + count(*) FILTER (video % 6 = 0) AS second_run, count(*) FILTER (video % 6 = 0) AS half_done FROM u)
SELECT video, 3 AS total, CAST(10 * video + CASE WHEN video % 6 = 0 THEN 2 WHEN video % 2 = 0 THEN 1 ELSE 2 END AS DOUBLE) AS first_number, first_run, second_run, CAST(0 AS BIGINT) AS third_run FROM u, n""")
def self_filling_cache(t):
    """Three fills: half of the keys, of which every third comes out broken; all keys; all again, which computes nothing.

    A write that was never published, and broken entries put on top of good ones, change nothing.
    """
    spark, path = folder(t, "cache")
    cache = KeyedCache(spark, path, ["video", "total"], F.size("embeddings") == F.col("total"))
    wanted = t("events").select(F.col("user_id").alias("video"), F.lit(3).alias("total"))
    vector = lambda n: F.array(*[F.array(10.0 * F.col("video") + F.lit(float(n)))] * 3)
    broken = lambda n: F.slice(vector(n), 1, 2)
    first = cache.filled(wanted.where("video % 2 = 0"), lambda k: k.withColumn("embeddings", F.when(F.col("video") % 6 == 0, broken(1)).otherwise(vector(1))))
    second = cache.filled(wanted, lambda k: k.withColumn("embeddings", vector(2)))
    cache.table.put(wanted.distinct().withColumn("embeddings", vector(3)))
    cache.upsert(wanted.distinct().withColumn("embeddings", broken(4)))
    third = cache.filled(wanted.distinct(), lambda k: k.withColumn("embeddings", vector(5)))
    counts = {name: F.lit(run.computed).cast("long") for name, run in (("first_run", first), ("second_run", second), ("third_run", third))}
    return third.rows.select("video", "total", F.col("embeddings")[0][0].alias("first_number")).withColumns(counts)


@query("SELECT n_nationkey AS index, n_name AS video_path FROM nation")
def sources_by_extension(t):
    """The first source that can be read, by its extension: one is absent, one is a table, the last isn't asked."""
    spark, path = folder(t, "sources")
    rows = t("nation").select(F.col("n_nationkey").alias("index"), F.col("n_name").alias("video_path"))
    rows.write.parquet(f"{path}/x.parquet")
    sources = (f"{path}/absent.parquet", f"{path}/x.parquet", f"{path}/y.json")
    return readers.first_readable([lambda s=s: readers.rows_of(spark, s) for s in sources]).select("index", "video_path")


@query("SELECT regexp_replace(p_name, ' ', '_', 'g') || p_partkey % 500 AS video_id, max('z' || lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS zip FROM part WHERE p_partkey % 4 <> 0 GROUP BY 1")
def archive_index(t):
    stem = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), (F.col("p_partkey") % 500).cast("string"))
    ending = F.when(F.col("p_partkey") % 4 == 0, ".txt").when(F.col("p_partkey") % 4 == 1, ".MP4").otherwise(".webm")
    files = t("part").select(F.concat(F.lit("z"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("zip"), F.concat(F.lit("d/e/"), stem, ending).alias("member"), F.lit(1).cast("long").alias("size"))
    return readers.archive_members(files).select("video_id", "zip")


@query("""WITH m AS (SELECT p_partkey, 'z' || lpad(CAST(p_partkey // 300 AS VARCHAR), 9, '0') || '.zip' AS zip, regexp_replace(p_name, ' ', '_', 'g') || p_partkey % 500 AS video_id, p_name || ' ' || p_partkey AS content FROM part WHERE p_partkey % 4 <> 0)
SELECT video_id, max(zip) AS zip, arg_max(content, p_partkey) AS content, CAST(octet_length(encode(arg_max(content, p_partkey))) AS BIGINT) AS size FROM m GROUP BY video_id""")
def zip_members(t):
    """Archives of 300 members each are written, found by their central directories, and the chosen members read back."""
    spark, path = folder(t, "zips")
    k = F.col("p_partkey")
    stem = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), (k % 500).cast("string"))
    ending = F.when(k % 4 == 0, ".txt").when(k % 4 == 1, ".MP4").otherwise(".webm")
    zip_name = F.concat(F.lit("z"), F.lpad(F.floor(k / 300).cast("string"), 9, "0"), F.lit(".zip"))
    rows = t("part").select(zip_name.alias("zip"), k.alias("place"), F.concat(F.lit("d/e/"), stem, ending).alias("member"), F.concat("p_name", F.lit(" "), k.cast("string")).alias("content"))

    def write(group: pd.DataFrame) -> pd.DataFrame:
        import io
        import zipfile

        system, at = archives._system(path)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for r in group.sort_values("place").itertuples():
                z.writestr(f"{r.place}/{r.member}", r.content)
        system.create_dir(at)
        with system.open_output_stream(f"{at}/{group['zip'].iloc[0]}") as f:
            f.write(out.getvalue())
        return group[["zip"]].head(1)

    rows.groupBy("zip").applyInPandas(write, "zip string").count()
    spark.dataSource.register(archives.ZipIndexSource)
    chosen = readers.archive_members(spark.read.format("zip_index").load(path))
    return archives.extracted(chosen).select("video_id", text.base_name(F.col("zip")).alias("zip"), F.col("content").cast("string").alias("content"), "size")


@query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS nation FROM customer")
def paged_table(t):
    """Rows of a local server that tells no total, hands out at most 150 rows a request and fails every third page once."""
    spark, path = folder(t, "pages")
    numbered = ranking.dense_index(t("customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("nation")), "c_custkey", "at")
    staging.written(numbered, path)
    spark.dataSource.register(paged.PagedSource)
    with served(path, most=150) as url:
        got = spark.read.format("paged_rows").option("url", url).option("page", 200).option("wait", 0.05).load()
        got = staging.written(got, staging.new_path(spark, "paged"))
    return got.select(F.from_json("value", "c_custkey long, c_name string, nation long").alias("r")).select("r.*")


@contextmanager
def served(path: str, most: int) -> Iterator[str]:
    """A paged table over Parquet with dense numbers in `at`, of which a request reads its own rows only."""
    from pyarrow import compute as pc
    from pyarrow import dataset

    files = dataset.dataset(path, format="parquet")
    failed: set[int] = set()

    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            q = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
            at, end = q["offset"], q["offset"] + min(q["length"], most)
            status, body = 503, b""
            if at // 200 % 3 != 1 or at in failed:
                rows = files.to_table(filter=(pc.field("at") >= at) & (pc.field("at") < end)).sort_by("at").drop_columns("at").to_pylist()
                status, body = 200, json.dumps({"rows": [{"row": r} for r in rows]}).encode()
            failed.add(at)
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{server.server_port}/rows"
    finally:
        server.shutdown()
        server.server_close()


FACTS = f"""WITH x AS (SELECT conv_id * 100 + turn AS index, turn, x FROM {_TEXTS}),
f AS (SELECT index, type, CASE WHEN index % 2 = 0 THEN 'yes' ELSE 'a' END AS gold, CAST({_sql_answer('x', 'type')} AS INT) AS code FROM (SELECT *, (['yes_no', 'multiple_choice', 'yes_no', 'mcq4'])[CAST(turn % 4 AS INT) + 1] AS type FROM x WHERE index % 7 <> 0)),
l AS (SELECT *, CASE WHEN code < 0 THEN '' WHEN type = 'yes_no' THEN (['no', 'yes'])[code + 1] WHEN type = 'multiple_choice' THEN (['b', 'a'])[code + 1] ELSE substr('abcd', code + 1, 1) END AS extracted FROM f)
SELECT 'uniform' AS strategy, 8 AS nframes, index, CASE WHEN type <> 'mcq4' THEN index // 4 ELSE -1 END AS instance_id, 'v' || index AS video_path, gold, extracted, CAST(code >= 0 AND extracted = gold AS INT) AS correct,
CASE WHEN index % 3 = 0 THEN 1 WHEN index % 5 = 0 THEN 2 ELSE -1 END AS first_frame FROM l"""


def _predicted(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predictions, answer key (without every seventh item) and selections, by index or by path."""
    rows = t("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("index"), "turn", F.col("text").alias("model_output"))
    fixed = {"sampler": F.lit("uniform"), "num_frames": F.lit(8), "ablation": F.lit("none"), "pred_file": F.lit("f.json"), "video_path": F.lit(""), "question": F.lit(""), "error": F.lit(None).cast("string")}
    kind = F.element_at(F.array(*map(F.lit, ("yes_no", "multiple_choice", "yes_no", "mcq4"))), (F.col("turn") % 4 + 1).cast("int"))
    options = F.array(*map(F.lit, ("A. one thing", "B. another thing", "C. a third thing.", "D. no")))
    path = F.concat(F.lit("v"), F.col("index").cast("string"))
    key = rows.where("index % 7 <> 0").select("index", path.alias("video_path"), F.lit("q").alias("question"), F.when(F.col("index") % 2 == 0, "yes").otherwise("a").alias("answer"), kind.alias("type"), options.alias("options"), F.lit("short").alias("duration"), F.lit("t").alias("task_type"))
    entry = lambda on, key, n: rows.where(on).select(F.lit("uniform").alias("sampler"), F.lit(8).alias("num_frames"), key.alias("key"), F.array(F.lit(n)).alias("indices"), F.lit(None).cast("array<double>").alias("scales"))
    selections = entry("index % 3 = 0", F.col("index").cast("string"), 1).unionByName(entry("index % 5 = 0", path, 2))
    return rows.drop("turn").withColumns(fixed), key, selections


@query(FACTS)
def fact_rows(t):
    predictions, key, selections = _predicted(t)
    facts = reports.fact_rows(predictions, key, selections)
    facts = facts.withColumns({"instance_id": F.coalesce("instance_id", F.lit(-1)), "first_frame": F.coalesce(F.col("frame_indices")[0], F.lit(-1))})
    return facts.select("strategy", "nframes", "index", "instance_id", "video_path", "gold", "extracted", "correct", "first_frame")


@query(f"SELECT strategy, nframes, count(*) AS n, CAST(sum(correct) AS BIGINT) AS correct FROM ({FACTS}) GROUP BY 1, 2")
def ingested_scores(t):
    """From predictions through per-question files to a cell's score."""
    spark, path = folder(t, "ingested")
    predictions, key, selections = _predicted(t)
    sinks.cells(reports.fact_rows(predictions, key, selections).drop("type", "code"), path)
    rows = readers.per_question(spark, path)
    return rows.groupBy("strategy", "nframes").agg(F.count("*").alias("n"), F.sum("correct").alias("correct"))


@query("""WITH r AS (SELECT p_partkey, 'v' || p_size AS video_id, (['short', 'Long ', '', 'medium'])[CAST(p_partkey % 4 AS INT) + 1] AS duration, ' C ' AS answer FROM part WHERE p_partkey % 9 <> 0),
k AS (SELECT p_partkey, video_id, lower(trim(duration)) AS duration FROM r WHERE lower(trim(duration)) IN ('', 'short', 'long')),
v AS (SELECT video_id FROM k GROUP BY 1 ORDER BY min(p_partkey) LIMIT 30),
j AS (SELECT k.* FROM k JOIN v USING (video_id) WHERE CAST(substr(video_id, 2) AS INT) % 2 = 0)
SELECT p_partkey AS pos, row_number() OVER (ORDER BY p_partkey) - 1 AS index, video_id, duration, 'C' AS answer, 'videos/' || video_id || '.mp4' AS video_path, 'mcq4' AS type FROM j""")
def prepared_mcq(t):
    k = F.col("p_partkey")
    duration = F.element_at(F.array(*map(F.lit, ("short", "Long ", "", "medium"))), (k % 4 + 1).cast("int"))
    video = F.when(k % 9 != 0, F.concat(F.lit("v"), F.col("p_size").cast("string")))
    raw = t("part").select(k.alias("pos"), k.cast("string").alias("question_id"), video.alias("video_id"), duration.alias("duration"), F.lit(" C ").alias("answer"), F.array(*map(F.lit, "ABCD")).alias("options"))
    index = t("part").where("p_size % 2 = 0").select(F.concat(F.lit("v"), F.col("p_size").cast("string")).alias("video_id"))
    out = reports.prepared_mcq(raw, ["short", "long"], index, most_videos=30, require_video=True)
    return out.select("pos", "index", "video_id", "duration", "answer", "video_path", "type")


#: Models as tokens, some of them the beginning of another one, and their folders; files of them, of no one, and of no set.
_TOKENS = "SELECT replace(p_name, ' ', '_') || '_' || p_partkey || t.ending AS token, 'm' || p_partkey || t.mark AS folder FROM part, (VALUES ('', ''), ('_hi', '+'), ('_hi_res', '++')) AS t(ending, mark) WHERE t.ending = '' OR p_partkey % 3 = 0"
_FILES = """SELECT p_partkey, replace(p_name, ' ', '_') || '_' || p_partkey || CASE WHEN p_partkey % 6 = 0 THEN '_hi' WHEN p_partkey % 6 = 3 THEN '_hi_res' WHEN p_partkey % 6 = 1 THEN '_hi' WHEN p_partkey % 6 = 2 THEN 'x' ELSE '' END
|| CASE WHEN p_partkey % 5 = 0 THEN '_zzz' WHEN p_partkey % 5 = 1 THEN '_m' ELSE '_main' END AS stem FROM part"""


@query(f"""WITH k AS ({_TOKENS}), f AS ({_FILES}), j AS (SELECT p_partkey, stem, arg_max(token, length(token)) AS subject, arg_max(folder, length(token)) AS folder FROM f JOIN k ON stem = token OR starts_with(stem, token || '_') GROUP BY 1, 2),
d AS (SELECT *, split_part(substr(stem, length(subject) + 2), '_', 1) AS t FROM j)
SELECT '/r/' || stem || CASE WHEN p_partkey % 2 = 0 THEN '_uniform8.json' ELSE '_f2c16_pool4_novid.json' END AS file, subject, folder, 'MAIN' AS dataset, stem AS prefix FROM d WHERE t IN ('m', 'main')""")
def runs_of_file_names(t):
    """File names of thousands of models, aliases among them, resolved by one look-up of their beginnings."""
    k = F.col("p_partkey")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), k.cast("string"))
    ends = F.array(*(F.struct(F.lit(e).alias("ending"), F.lit(m).alias("mark")) for e, m in (("", ""), ("_hi", "+"), ("_hi_res", "++"))))
    tokens = t("part").select(k, name.alias("name"), F.explode(ends).alias("e")).where("e.ending = '' or p_partkey % 3 = 0")
    subjects = tokens.select(F.concat("name", "e.ending").alias("token"), F.concat(F.lit("m"), k.cast("string"), F.col("e.mark")).alias("folder"))
    ending = F.when(k % 6 == 3, "_hi_res").when((k % 6).isin(0, 1), "_hi").when(k % 6 == 2, "x").otherwise("")
    token = F.when(k % 5 == 0, "_zzz").when(k % 5 == 1, "_m").otherwise("_main")
    cell = F.when(k % 2 == 0, "_uniform8.json").otherwise("_f2c16_pool4_novid.json")
    files = t("part").select(F.concat(F.lit("/r/"), name, ending, token, cell).alias("file"))
    datasets = t("region").select(F.explode(F.array(F.lit("m"), F.lit("main"))).alias("token"), F.lit("MAIN").alias("dataset"))
    return joins.runs_of(files, subjects, datasets).select("file", "subject", "folder", "dataset", "prefix")


@query("SELECT event_id AS index, event_type || '!' AS model_output FROM events")
def resumed_stream(t):
    """Three runs over files that overlap: each key is answered once, and a run answers only what is new."""
    spark, path = folder(t, "stream")
    rows = t("events").select(F.col("event_id").alias("index"), "event_type")
    answer = lambda df: df.select("index", "event_type", F.concat("event_type", F.lit("!")).alias("model_output"))
    for part in ("index % 3 = 0", "index % 3 = 0 or index % 2 = 0", "index % 6 > 0"):
        rows.where(part).write.mode("append").parquet(f"{path}/in")
        items = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        incremental.answered_stream(items, answer, f"{path}/out", f"{path}/checkpoint", ["index"])
    return sinks.current(spark, f"{path}/out").select("index", "model_output")


_ITEMS = "SELECT event_id AS index, 'u' || user_id AS video_path, event_type FROM events UNION ALL SELECT event_id, 'w', event_type FROM events WHERE event_id % 11 = 0"


def _items_of_events(t) -> DataFrame:
    """Events as items; every eleventh index stands for two items, told apart by path."""
    e = t("events").select(F.col("event_id").alias("index"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("video_path"), "event_type")
    return e.unionByName(e.where("index % 11 = 0").withColumn("video_path", F.lit("w")))


@query(f"SELECT index, video_path, event_type || '!' AS model_output, CAST(NULL AS VARCHAR) AS error, CAST(CASE WHEN index % 3 < 2 AND (index % 5 = 0 OR index % 7 = 0) THEN 2 ELSE 1 END AS BIGINT) AS attempts FROM ({_ITEMS})")
def failures_asked_again(t):
    """In the first run every fifth answer is an error and every seventh blank; the second brings new items, old ones
    once more, and asks again for what failed, and for nothing else."""
    spark, path = folder(t, "again")
    items = _items_of_events(t)
    k = F.col("index")
    good = F.concat("event_type", F.lit("!"))
    failing = lambda df: df.withColumns({"model_output": F.when(k % 5 == 0, None).when(k % 7 == 0, "  ").otherwise(good), "error": F.when(k % 5 == 0, "RateLimit: 429")})
    working = lambda df: df.withColumns({"model_output": good, "error": F.lit(None).cast("string")})
    for part, answer in (("index % 3 < 2", failing), ("index % 3 > 0", working)):
        items.where(part).write.mode("append").parquet(f"{path}/in")
        incremental.answered_stream(spark.readStream.schema(items.schema).parquet(f"{path}/in"), answer, f"{path}/out", f"{path}/checkpoint")
    attempts = sinks.current(spark, f"{path}/out").groupBy("index", "video_path").agg(F.count("*").alias("attempts"))
    return incremental.results(spark, f"{path}/out").join(attempts, ["index", "video_path"]).select("index", "video_path", "model_output", "error", "attempts")


@query(f"SELECT index, video_path, event_type || '?' AS model_output, CAST(1 AS BIGINT) AS answers, 2 AS cut_runs FROM ({_ITEMS})")
def timeboxed_stream(t):
    """Two runs whose time is up after one batch, and one that ends: together what one whole run gives."""
    spark, path = folder(t, "boxed")
    items = _items_of_events(t)
    items.repartition(5).write.parquet(f"{path}/in")
    answer = lambda df: df.withColumns({"model_output": F.concat("event_type", F.lit("?")), "error": F.lit(None).cast("string")})
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    runs = [incremental.answered_stream(stream, answer, f"{path}/out", f"{path}/checkpoint", seconds=s) for s in (0, 0, None)]
    cut = sum(not r.finished for r in runs)
    out = sinks.current(spark, f"{path}/out").groupBy("index", "video_path").agg(F.first("model_output").alias("model_output"), F.count("*").alias("answers"))
    return out.withColumn("cut_runs", F.lit(cut))


@query(f"SELECT index, video_path, event_type || CASE WHEN index % 97 = 5 THEN ' at last' ELSE ' at once' END AS model_output, CASE WHEN index % 97 = 5 THEN 'ValueError: no frames' END AS first_error FROM ({_ITEMS})")
def isolated_failures(t):
    """A model that raises on some items: the others of their batches are answered, and a second run asks only for those."""
    spark, path = folder(t, "isolated")
    items = _items_of_events(t)

    def call(word, rows):
        if word == "at once" and (rows["index"] % 97 == 5).any():
            raise ValueError("no frames")
        return rows["event_type"] + " " + word

    staging.written(incremental.predicted(items, lambda: "at once", call), f"{path}/first")
    first = spark.read.parquet(f"{path}/first")
    second = incremental.predicted_again(items, first, lambda: "at last", call)
    return second.drop("error").join(first.select("index", "video_path", F.col("error").alias("first_error")), ["index", "video_path"]).select("index", "video_path", "model_output", "first_error")


@query("SELECT 'uniform' AS sampler, CAST(event_id % 3 AS INT) AS num_frames, count(*) AS n, CAST(sum(event_id % 2) AS BIGINT) AS correct FROM events GROUP BY ALL")
def streamed_scores(t):
    spark, path = folder(t, "scores")
    rows = t("events").select(F.lit("uniform").alias("sampler"), (F.col("event_id") % 3).cast("int").alias("num_frames"), (F.col("event_id") % 2).alias("correct"))
    rows.repartition(4).write.parquet(path)
    name = f"scores_{path.rsplit('-', 1)[-1]}"
    stream = incremental.running_scores(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path), name)
    stream.processAllAvailable()
    stream.stop()
    return spark.table(name).select("sampler", "num_frames", "n", "correct")

