"""Small reports: CSV and JSON files, Markdown tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _as_file(spark: SparkSession, folder: str, path: str) -> None:
    """Move the one part of ``folder`` to ``path``, in whatever store it lies."""
    names, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    source, target = names.Path(folder), names.Path(path)
    fs = source.getFileSystem(conf)
    part = next(f.getPath() for f in fs.listStatus(source) if f.getPath().getName().startswith("part-"))
    fs.delete(target, True)
    if not fs.rename(part, target):
        raise OSError(f"{path} can't be written")
    fs.delete(source, True)


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A report table as one CSV file; arrays and maps as JSON."""
    flat = df.select(*[F.to_json(c).alias(c) if kind.startswith(("map", "array", "struct")) else F.col(f"`{c}`") for c, kind in df.dtypes])
    (flat.orderBy(*order) if order else flat).coalesce(1).write.mode("overwrite").csv(f"{path}.parts", header=True)
    _as_file(df.sparkSession, f"{path}.parts", path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A report table again, with the types its values show; empty cells are missing."""
    return spark.read.csv(path, header=True, inferSchema=True)


def write_json(df: DataFrame, path: str) -> None:
    """A record per row as one file of JSON lines."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}.parts")
    _as_file(df.sparkSession, f"{path}.parts", path)


def markdown_table(df: DataFrame, digits: int = 1, order: list[str] | None = None) -> str:
    """A report table, whole, as Markdown; doubles with ``digits``, missing values empty."""
    rows = (df.orderBy(*order) if order else df).collect()

    def cell(x: object) -> str:
        return "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)

    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(x) for x in row) + " |" for row in rows)]) + "\n"


def write_text(path: str, text: str) -> Path:
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(text)
    return out
