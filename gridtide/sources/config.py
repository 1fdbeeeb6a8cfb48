"""Configuration: one YAML file, paths relative to it."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

from gridtide.operators.features import ForecastSetup
from gridtide.operators.holidays import CalendarSetup, Period

#: Defaults of every section; a configuration file overrides single keys.
DEFAULTS: dict[str, Any] = {
    "timezone": "Europe/Zurich",
    "seed": 42,
    "paths": {"raw": "data/raw", "interim": "data/interim", "processed": "data/processed", "models": "models", "reports": "reports"},
    "load": {"years": [], "url_template": "", "sheet": "Zeitreihen0h15", "header_prefix": "", "unit": "kWh", "range_mw": [2000.0, 15000.0], "interpolate": 4, "long_gaps": "first"},
    "split": {"start": None, "test_start": None, "end": None, "first_fold": None, "fold_months": 3, "folds": 8},
    "forecast": {"issue_hour": 10, "lag_hours": [48, 72, 168, 336], "weekly_mean_weeks": 4},
    "weather": {"api_url": "", "start": None, "end": None, "variables": ["temperature_2m", "shortwave_radiation"], "heating_base": 16.0, "cooling_base": 22.0, "locations": []},
    "population": {},
    "calendar": {"threshold": 0.5, "school": []},
    "models": {"ridge_alpha": 1.0, "trees": 600, "leaves": 63, "least": 30, "rate": 0.03, "quantile_trees": 300, "quantile_leaves": 15, "quantile_least": 200, "quantiles": [0.05, 0.1, 0.9, 0.95], "intervals": [[0.05, 0.95], [0.1, 0.9]]},
    "anomaly": {"interval": [0.05, 0.95], "residual_rate": 0.01, "least_width": 200.0, "trees": 300, "sample": 2048, "forest_rate": 0.002, "min_run": 4, "gap_hours": 2, "top": 10, "seeds": [0, 1, 2, 3, 4], "per_kind": 10, "injection": {}},
}


def _merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    return {k: _merged(base[k], over[k]) if isinstance(base.get(k), dict) and isinstance(over.get(k), dict) and base[k] else over.get(k, base.get(k)) for k in base | over}


@dataclass(frozen=True)
class Config:
    values: dict[str, Any]
    root: Path

    def __getitem__(self, section: str) -> Any:
        if section not in self.values:
            raise KeyError(f"the configuration has no section {section}")
        return self.values[section]

    def path(self, kind: str, *parts: str) -> str:
        return str(self.root.joinpath(self["paths"][kind], *parts))

    def population(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted((k, float(v)) for k, v in self["population"].items()), "region string, people double")

    def region_shares(self) -> dict[str, float]:
        total = sum(map(float, self["population"].values()))
        return {k: v / total for k, v in self["population"].items()}

    def locations(self, spark: SparkSession) -> DataFrame:
        """location, shares: which part of which region's people each weather location stands for."""
        return spark.createDataFrame([(x["name"], {k: float(v) for k, v in x["shares"].items()}) for x in self["weather"]["locations"]], "location string, shares map<string,double>")

    def forecast_setup(self) -> ForecastSetup:
        f, w = self["forecast"], self["weather"]
        return ForecastSetup(self["timezone"], int(f["issue_hour"]), tuple(f["lag_hours"]), int(f["weekly_mean_weeks"]), float(w["heating_base"]), float(w["cooling_base"]))

    def calendar_setup(self) -> CalendarSetup:
        c = self["calendar"]
        return CalendarSetup(self.region_shares(), float(c["threshold"]), tuple(Period(**p) for p in c["school"]))


def load_config(path: str | Path, root: str | Path | None = None) -> Config:
    path = Path(path)
    return Config(_merged(DEFAULTS, yaml.safe_load(path.read_text()) or {}), Path(root) if root else path.resolve().parent)
