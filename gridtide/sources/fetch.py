"""Fetching raw files over HTTP: to a part file, checked, then renamed. Driver-side plumbing before any Spark job."""

from __future__ import annotations

import csv
import hashlib
import json
import os
import urllib.parse
import urllib.request
from datetime import datetime, timezone
from pathlib import Path

from gridtide.sources.config import Config
from gridtide.sources.workbook import LEAST_BYTES, MAGIC


class FetchError(RuntimeError):
    """Files that could not be fetched, with what to do about it."""


def is_workbook(path: Path, least: int = LEAST_BYTES) -> bool:
    if not path.exists() or path.stat().st_size < least:
        return False
    with path.open("rb") as f:
        return f.read(4) == MAGIC


def sha256_of(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _get(url: str, timeout: int = 120) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        return answer.read()


def _place(path: Path, content: bytes) -> None:
    part = path.with_suffix(path.suffix + ".part")
    path.parent.mkdir(parents=True, exist_ok=True)
    part.write_bytes(content)
    os.replace(part, path)


def fetch_workbooks(config: Config, force: bool = False, get=_get, least: int = LEAST_BYTES) -> list[dict]:
    """A record per year; files that are there and valid stay unless ``force``. All failures come in one error."""
    records, failed = [], []
    for year in config["load"]["years"]:
        path, url = Path(config.path("raw", f"load-{year}.xlsx")), config["load"]["url_template"].format(year=year)
        if force or not is_workbook(path, least):
            try:
                _place(path, get(url))
                if not is_workbook(path, least):
                    raise ValueError("what came is no workbook")
            except (OSError, ValueError) as error:
                failed.append(f"{year}: {error}; save {url} as {path}")
                continue
        records.append(record(path, url))
    if failed:
        raise FetchError("\n".join(failed))
    return records


def fetch_weather(config: Config, force: bool = False, get=_get) -> list[dict]:
    """A CSV file per location, from the API's parallel arrays."""
    w, records = config["weather"], []
    for place in w["locations"]:
        path = Path(config.path("raw", f"weather-{place['name']}.csv"))
        query = urllib.parse.urlencode({"latitude": place["latitude"], "longitude": place["longitude"], "start_date": w["start"], "end_date": w["end"], "hourly": ",".join(w["variables"]), "timezone": "UTC"})
        url = f"{w['api_url']}?{query}"
        if force or not path.exists():
            hourly = json.loads(get(url)).get("hourly", {})
            if missing := [v for v in ["time", *w["variables"]] if v not in hourly]:
                raise FetchError(f"{place['name']}: the answer has no {', '.join(missing)}")
            path.parent.mkdir(parents=True, exist_ok=True)
            part = path.with_suffix(".part")
            with part.open("w", newline="") as f:
                out = csv.writer(f)
                out.writerow(["time", *w["variables"]])
                out.writerows(zip(hourly["time"], *(hourly[v] for v in w["variables"]), strict=True))
            os.replace(part, path)
        records.append(record(path, url))
    return records


def record(path: Path, url: str) -> dict:
    return {"file": path.name, "url": url, "bytes": path.stat().st_size, "sha256": sha256_of(path), "retrieved": datetime.fromtimestamp(path.stat().st_mtime, timezone.utc).isoformat()}


def write_manifest(config: Config, records: list[dict]) -> Path:
    path = Path(config.path("raw", "manifest.json"))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(records, indent=2) + "\n")
    return path
