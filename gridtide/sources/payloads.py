"""Weather API payloads: a struct of parallel arrays under ``hourly``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIME = "yyyy-MM-dd'T'HH:mm"


def hourly_rows(df: DataFrame, payload: str, variables: list[str]) -> DataFrame:
    """A row per hour of each payload (JSON text): time (NTZ, UTC) and the variables as doubles.

    A payload without ``hourly.time`` or one of the variables fails the job with the name of what is missing.
    """
    schema = "hourly struct<time: array<string>, " + ", ".join(f"{v}: array<double>" for v in variables) + ">"
    rows = df.withColumn("_p", F.from_json(payload, schema)["hourly"])
    for name in ["time", *variables]:
        missing = F.raise_error(F.lit(f"payload has no hourly.{name}")).cast("boolean")
        rows = rows.filter(F.when(F.col("_p")[name].isNull(), missing).otherwise(F.lit(True)))
    zipped = F.arrays_zip(*[F.col("_p")[n].alias(n) for n in ["time", *variables]])
    out = rows.select(*[c for c in df.columns if c != payload], F.explode(zipped).alias("_h"))
    return out.select(*[c for c in df.columns if c != payload], F.to_timestamp_ntz("_h.time", F.lit(TIME)).alias("time"), *[F.col("_h")[v].alias(v) for v in variables])
