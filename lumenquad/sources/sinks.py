"""Sinks: tables by Spark's commit protocol; small reports as one file; a result never shrinks unseen."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .versions import ConflictError, VersionedTable


def cells(rows: DataFrame, path: str) -> None:
    """Per-question rows as CSV, a folder a cell."""
    rows.withColumn("frame_indices", _joined(rows, "frame_indices")).withColumn("f2c_scales", _joined(rows, "f2c_scales")).write.partitionBy("strategy", "nframes", "ablation").mode("overwrite").option("header", True).csv(path)


def _joined(rows: DataFrame, name: str):
    kind = dict(rows.dtypes)[name]
    return F.array_join(F.transform(name, lambda x: x.cast("string")), " ") if kind.startswith("array") else F.col(name)


def cell_names(rows: DataFrame, subject: str, dataset: str) -> DataFrame:
    """Name of each cell's file."""
    tag = text.cell_tag(F.col("strategy"), F.col("nframes"), F.col("ablation"))
    return rows.select("strategy", "nframes", "ablation").distinct().withColumn("file", F.concat(F.lit(f"{subject}_{dataset}_per_question_"), tag, F.lit(".csv")))


def metrics_json(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """A JSON document for each row, marked as derived."""
    body = F.struct(*(c for c in metrics.columns if c not in keys), F.lit(True).alias("_derived"))
    return metrics.select(*keys, F.to_json(body).alias("document"))


def table_csv(df: DataFrame, path: str) -> None:
    """A report of few rows in one file; null is blank."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def pretty_json(df: DataFrame, path: str, most: int = 10_000) -> None:
    """A small result (at most `most` rows, or it is refused) as one indented JSON file on the driver."""
    rows = df.toJSON().take(most + 1)
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write a table")
    with open(path, "w", encoding="utf-8") as f:
        json.dump([json.loads(r) for r in rows], f, indent=2, ensure_ascii=False)


def replace_unless_smaller(df: DataFrame, path: str) -> bool:
    """Publishes df as the next version of a table unless it has fewer rows; tells whether it did. `current` reads it.

    If another writer comes first, its version is what counts: the sizes are compared again.
    """
    table = VersionedTable(df.sparkSession, path)
    folder, rows = table.put(df)
    while True:
        base = table.current()
        if base is not None and rows < base.rows:
            table.drop(folder)
            return False
        try:
            table.replace(folder, rows, base)
        except ConflictError:
            continue
        table.vacuum()
        return True


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a table of versions; None if there are none yet."""
    return VersionedTable(spark, path).read()
