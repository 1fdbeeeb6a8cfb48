"""python -m gridtide {data,train,evaluate,anomalies,all} [--config FILE] [--skip-download] [--force] [--verbose]"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from gridtide import ship
from gridtide.plans import stages
from gridtide.sources.config import load_config
from gridtide.sources.fetch import FetchError


def main(args: list[str] | None = None) -> int:
    """Exit code 2 where raw files could not be fetched."""
    parser = argparse.ArgumentParser(prog="gridtide", description=__doc__)
    parser.add_argument("stage", choices=["data", "train", "evaluate", "anomalies", "all"])
    parser.add_argument("--config", default="config.yaml")
    parser.add_argument("--skip-download", action="store_true")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--verbose", "-v", action="store_true")
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.DEBUG if given.verbose else logging.INFO)
    config = load_config(given.config)
    spark = SparkSession.builder.appName("gridtide").getOrCreate()
    ship(spark)
    wanted = ["data", "train", "evaluate", "anomalies"] if given.stage == "all" else [given.stage]
    for stage in wanted:
        logging.info("stage %s", stage)
        if stage == "data":
            try:
                stages.run_data(spark, config, not given.skip_download, given.force)
            except FetchError as error:
                logging.error("%s", error)
                return 2
        else:
            getattr(stages, f"run_{stage}")(spark, config)
    return 0


if __name__ == "__main__":
    sys.exit(main())
