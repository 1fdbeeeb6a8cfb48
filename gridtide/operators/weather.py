"""Weather per location to one national series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.operators.windows import in_block, interpolated, owned, halo

HOUR = 3600
#: Plausible ranges of temperature (degrees C) and radiation (W/m2).
TEMPERATURE, RADIATION = (-35.0, 45.0), (0.0, 1300.0)


def location_weights(locations: DataFrame, population: DataFrame) -> DataFrame:
    """location, weight: the population that each location stands for, as a share of all of it.

    locations: location, shares map<region, share>; population: region, people.
    """
    rows = locations.select("location", F.explode("shares").alias("region", "share")).join(population, "region")
    total = population.agg(F.sum("people").alias("all"))
    return rows.groupBy("location").agg(F.sum(F.col("share") * F.col("people")).alias("people")).crossJoin(F.broadcast(total)).select("location", (F.col("people") / F.col("all")).alias("weight"))  # one row


def region_weights(population: DataFrame) -> DataFrame:
    total = population.agg(F.sum("people").alias("all"))
    return population.crossJoin(F.broadcast(total)).select("region", (F.col("people") / F.col("all")).alias("weight"))  # one row


def to_interval_start(df: DataFrame, keys: list[str], t: str = "utc_start") -> DataFrame:
    """Readings at the hour's start to hour means: temperature with the next reading, radiation from the next one.

    On a regular hourly grid; the last hour has no next reading and stays missing.
    """
    rows, w = halo(df, 0, HOUR, t), in_block(keys, t)
    rows = rows.withColumn("temperature_c", (F.col("temperature_2m") + F.lead("temperature_2m").over(w)) / 2).withColumn("radiation_wm2", F.lead("shortwave_radiation").over(w))
    return owned(rows).drop("temperature_2m", "shortwave_radiation")


def national(df: DataFrame, weights: DataFrame, t: str = "utc_start", limit: int = 3, complete: bool = True) -> DataFrame:
    """utc_start, temperature_c, radiation_wm2: weighted over all locations.

    A value missing in any location is missing, or, unless ``complete``, the others' weights stand for it. Hours with
    neither value are dropped; then both values are masked where either is implausible or missing, and gaps of up to
    ``limit`` rows inside are interpolated, both in one pass.
    """
    joined = df.join(weights, "location")  # a row per location
    known = weights.agg(F.count("*").alias("locations"), F.sum("weight").alias("total"))

    def mean(x: str):
        if not complete:
            return (F.sum(F.col(x) * F.col("weight")) / F.sum(F.when(F.col(x).isNotNull(), F.col("weight")))).alias(x)
        full = F.count(x) == F.max("locations")
        return F.when(full, F.sum(F.col(x) * F.col("weight")) / F.max("total")).alias(x)

    hours = joined.crossJoin(known).groupBy(t).agg(mean("temperature_c"), mean("radiation_wm2")).filter("temperature_c is not null or radiation_wm2 is not null")
    good = F.col("temperature_c").between(*TEMPERATURE) & F.col("radiation_wm2").between(*RADIATION)
    masked = hours.withColumns({c: F.when(good, F.col(c)) for c in ("temperature_c", "radiation_wm2")})
    return interpolated(masked, [], ["temperature_c", "radiation_wm2"], HOUR, limit, "first", t).drop("interpolated")
