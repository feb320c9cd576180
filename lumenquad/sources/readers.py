"""Readers: explicit schemas, file names as columns, nothing inferred and nothing read on the driver."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import text


def _filled(row: str) -> Column:
    """Whether a parsed row holds anything: what doesn't parse is a row of nulls."""
    return F.col(row).isNotNull() & (F.to_json(row) != "{}")


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that hold a JSON array or a JSON object a line; which one, each file's first character tells.

    Columns `_file` and `_pos` (0-based place in its file) come along; files that don't parse give no rows.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("_file"), F.col("value"))
    array = F.startswith(F.ltrim("value"), F.lit("["))
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    listed = F.when(array, F.from_json("value", f"array<struct<{schema}>>")).otherwise(F.transform(lines, lambda x: F.from_json(x, schema)))
    return files.select("_file", F.posexplode(listed).alias("_pos", "_row")).where(_filled("_row")).select("_file", "_pos", "_row.*")


def json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a file of one JSON object; files that don't parse or hold something else are left out."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("_file"), F.from_json("value", schema).alias("_row"), F.startswith(F.ltrim("value"), F.lit("{")).alias("_ok"))
    return files.where(F.col("_ok") & _filled("_row")).select("_file", "_row.*")


def names(schema: str) -> list[str]:
    return T.StructType.fromDDL(schema).fieldNames()


def items(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark items in core columns and the optional ones."""
    return json_rows(spark, path, schemas.MCQ_ITEM).drop("_file")


def truth(spark: SparkSession, path: str) -> DataFrame:
    """The answer key: gold trimmed and in lower case, one name for the four-way type, yes_no where none is given."""
    kind = F.when(F.col("type") == "multiple_choice_4", "mcq4").otherwise(F.coalesce("type", F.lit("yes_no")))
    return items(spark, path).withColumn("type", kind).withColumn("answer", F.lower(F.trim("answer")))


def mcq_items(spark: SparkSession, path: str) -> DataFrame:
    return items(spark, path).withColumn("type", F.coalesce("type", F.lit("mcq4")))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction files of whole cells, with the cell from the file name; run metadata from either place.

    Of two files for one cell (variants apart) all rows stay, told apart by `pred_file` and `variant`.
    """
    rows = json_rows(spark, path, schemas.PREDICTION)
    cell = text.cell_of(F.col("_file"))
    kept = rows.where(text.readable_prediction(F.col("_file"))).withColumn("_cell", cell).where("_cell is not null")
    return kept.select(
        "_cell.*", F.col("_file").alias("pred_file"), F.col("_pos").alias("pos"), "index", "video_path", "question", "model_output", "error", "ts",
        F.coalesce("strategy", "frames.strategy").alias("strategy"), F.coalesce("seed", "frames.seed").alias("seed"), "n_frames_sent", "prompt_tokens", "frame_indices", "f2c_scales",
    )


def selections(spark: SparkSession, path: str) -> DataFrame:
    """Frozen selections: sampler, num_frames, key, indices, sizes, scales; other files of the folder are left out."""
    rows = json_files(spark, path, schemas.SELECTION)
    sampler, n = (F.regexp_extract("_file", r"^(uniform|random|hornet|f2cfull|f2c)(\d+)\.json$", g) for g in (1, 2))
    rows = rows.withColumn("sampler", sampler).withColumn("num_frames", F.nullif(n, F.lit("")).cast("int")).where("sampler <> ''")
    return rows.select("sampler", "num_frames", F.explode("items").alias("key", "_e")).select("sampler", "num_frames", "key", "_e.*")


def _metric_cell(prefix: str) -> Column:
    pattern = rf"^\Q{prefix}\E_(uniform|random|hornet|burst|f2cfull|f2c)(\d+)((?:_full|_noencoder)?(?:_pool\d+)?)_metrics\.json$"
    part = lambda g: F.regexp_extract("_file", pattern, g)
    return F.when(part(1) != "", F.struct(part(1).alias("sampler"), F.nullif(part(2), F.lit("")).cast("int").alias("num_frames"), F.ltrim(part(3), F.lit("_")).alias("variant")))


def quad_metrics(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    rows = json_files(spark, path, schemas.QUAD_METRICS).withColumn("_cell", _metric_cell(prefix)).where("_cell is not null")
    return rows.select("_cell.*", *names(schemas.QUAD_METRICS))


def mcq_metrics(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    rows = json_files(spark, path, schemas.MCQ_METRICS).withColumn("_cell", _metric_cell(prefix)).where("_cell is not null")
    plain = F.coalesce("config.ablation", F.lit("none")) == "none"
    return rows.where(plain).select("_cell.*", *names(schemas.MCQ_METRICS))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, blank as null, with the file's name."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', nullValue="").withColumn("_file", F.col("_metadata.file_name"))


def per_question(spark: SparkSession, path: str) -> DataFrame:
    """Per-question rows in their types; one row a cell and index, whatever number of files holds it."""
    rows = schemas.conform(csv_rows(spark, path), schemas.PER_QUESTION)
    return rows.dropDuplicates(["strategy", "nframes", "ablation", "index"])


def combined_cells(spark: SparkSession, path: str) -> DataFrame:
    """A combined export: rows without a budget stay only in the arm without video, with budget 0."""
    rows = csv_rows(spark, path).withColumn("nframes", F.expr("try_cast(nframes as int)")).withColumn("ablation", F.coalesce("ablation", F.lit("none")))
    rows = rows.where("nframes is not null or ablation = 'no_video'").withColumn("nframes", F.coalesce("nframes", F.lit(0)))
    return schemas.conform(rows, schemas.PER_QUESTION)


def sweep(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """Cells of sweep tables that have a result and are no ablation."""
    rows = csv_rows(spark, path)
    if dataset:
        rows = rows.where(F.col("dataset") == dataset)
    if "ablation" in rows.columns:
        rows = rows.where(F.coalesce("ablation", F.lit("none")) == "none")
    metric = "I_Acc" if "I_Acc" in rows.columns else "Acc"
    numbers = [c for c in rows.columns if c not in ("model", "dataset", "sampler", "ablation", "_file")]
    return rows.where(F.col(metric).isNotNull()).select("model", "dataset", "sampler", *(F.col(c).cast("double").alias(c) for c in numbers), "_file").withColumn("num_frames", F.col("num_frames").cast("int"))


def first_readable(readers: list[Callable[[], DataFrame]]) -> DataFrame:
    """The first of several sources that can be read."""
    errors = []
    for read in readers:
        try:
            df = read()
            df.schema  # noqa: B018 - a missing path or a bad footer fails here
            return df
        except (PySparkException, Py4JJavaError, OSError) as error:  # Spark's and the file system's, no one's slip
            errors.append(str(error).splitlines()[0])
    raise FileNotFoundError("; ".join(errors))


def rows_of(spark: SparkSession, source: str, schema: str = schemas.MCQ_ITEM) -> DataFrame:
    """A table by its extension."""
    if source.endswith(".parquet"):
        return spark.read.parquet(source)
    if source.endswith(".csv"):
        return csv_rows(spark, source)
    return json_rows(spark, source, schema).drop("_file", "_pos")


def archive_members(files: DataFrame) -> DataFrame:
    """Media files of archives by the stem of their name; of equal stems the last archive counts, and its last entry.

    files: zip, member, size, as of format("zip_index") (whose place in the archive, pos, tells which entry is last; by
    the member's name where it's absent).
    """
    media = files.where(F.lower("member").rlike(r"\.(mp4|mkv|webm|mov|avi)$")).withColumn("video_id", text.stem(F.col("member")))
    values = [c for c in files.columns if c != "error"]
    best = F.max_by(F.struct(*values), F.struct("zip", "pos" if "pos" in values else "member")).alias("m")
    return media.groupBy("video_id").agg(best).select("video_id", "m.*")
