"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.sources.store import new_path

CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage: what follows restarts from the files when an executor is lost. The shuffle files of the write go
    with it, so a chain of such tables holds one step's shuffle on disk and not all of them.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def crc32_mod(column: str, n: int):
    """crc32 of an id as decimal text, modulo ``n`` (NULL ids count as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def part_count(df: DataFrame, rows_per_part: int, least: int = 8) -> int:
    """Partitions for ``df`` at ``rows_per_part`` rows each: follows the data, at least ``least``."""
    return max(least, -(-df.count() // rows_per_part))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it as long as ``df`` has such a column."""
    while wanted.lower() in {c.lower() for c in df.columns}:
        wanted = f"_{wanted}"
    return wanted
