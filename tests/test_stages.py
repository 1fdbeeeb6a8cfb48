"""The stages end to end on synthetic workbooks and weather files."""

import json
import zipfile
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
import yaml

from gridtide.plans import stages
from gridtide.sources import fetch, workbook
from gridtide.sources.config import load_config

ZONE = "Europe/Zurich"
#: Quarter hours of January to April 2022: 120 days, one of them an hour short.
STEPS = 120 * 96 - 4
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def write_book(path, rows, sheet="Zeitreihen0h15"):
    def cell(ref, v):
        return f'<c r="{ref}"><v>{v}</v></c>' if isinstance(v, float) else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'

    body = "".join(f'<row r="{i}">{cell(f"A{i}", a)}{cell(f"B{i}", b)}</row>' for i, (a, b) in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="{sheet}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>')


@pytest.fixture(scope="module")
def config(tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    (root / "raw").mkdir()
    zone, noise = ZoneInfo(ZONE), 17
    t, end, rows = datetime(2021, 12, 31, 23), datetime(2022, 4, 30, 22), [["", "Energy\nTotal"], ["Zeitstempel", "kWh"]]
    while t < end:
        local = t.replace(tzinfo=ZoneInfo("UTC")).astimezone(zone)
        noise = (noise * 1103 + 12345) % 32768
        # A ramp up to 13 o'clock and down again, lower on Sundays, in steps of the month, with a little noise.
        mw = 4000 + 150 * (13 - abs(local.hour - 13)) - 400 * (local.weekday() == 6) - 60 * local.month + noise / 400
        rows.append([local.strftime("%d.%m.%Y %H:%M"), mw * 250])
        t += timedelta(minutes=15)
    write_book(root / "raw" / "load-2022.xlsx", rows)
    for k, name in enumerate(("North", "South")):
        lines = ["time,temperature_2m,shortwave_radiation"]
        for h in range(24 * 160):
            at = datetime(2021, 11, 28) + timedelta(hours=h)
            lines.append(f"{at:%Y-%m-%dT%H:%M},{3 + 2 * k + h % 24 / 3 + h // 24 % 9:.2f},{max(0, 90 * (6 - abs(h % 24 - 12))):.1f}")
        (root / "raw" / f"weather-{name}.csv").write_text("\n".join(lines) + "\n")
    values = {
        "paths": {k: k for k in ("raw", "interim", "processed", "models", "reports")},
        "load": {"header_prefix": "Energy", "range_mw": [2000, 15000]},
        "split": {"start": "2022-01-01", "test_start": "2022-04-12", "end": "2022-05-01", "first_fold": "2022-03-12", "fold_months": 1, "folds": 1},
        "weather": {"locations": [{"name": "North", "shares": {"ZH": 1.0, "TI": 0.5}}, {"name": "South", "shares": {"TI": 0.5, "GE": 1.0}}]},
        "population": {"ZH": 1500, "GE": 500, "TI": 350},
        "models": {"trees": 20, "leaves": 7, "least": 10, "rate": 0.1, "quantile_trees": 10, "quantile_leaves": 5, "quantile_least": 40},
        "anomaly": {"trees": 30, "sample": 256, "seeds": [0], "per_kind": 2, "injection": {"spike": {"min_len": 1, "max_len": 2, "min_mag": 0.3, "max_mag": 0.6}, "drop": {"min_len": 3, "max_len": 9, "min_mag": 0.25, "max_mag": 0.5}, "level_shift": {"min_len": 10, "max_len": 30, "min_mag": 0.1, "max_mag": 0.25}, "flatline": {"min_len": 12, "max_len": 24}}},
    }
    (root / "config.yaml").write_text(yaml.safe_dump(values))
    return load_config(root / "config.yaml")


def test_all_stages(spark, config):
    stages.run_data(spark, config, download=False)
    quarter = spark.read.parquet(config.path("interim", "load15"))
    assert quarter.count() == STEPS and quarter.filter("load_mw is null").count() == 0
    assert spark.read.parquet(config.path("processed", "hourly")).filter("load_mw is null").count() == 0
    record = json.loads((config.root / "reports" / "validation.json").read_text())
    assert record["years"][0]["rows"] == STEPS and record["years"][0]["convention"] == "start" and json.loads(record["years"][0]["dst_days"]) == {"2022-03-27": 92}
    wanted = ("utc_start", "utc_end", "expected_intervals", "observed_intervals", "duplicate_utc_intervals", "missing_intervals", "out_of_range_values", "interpolated_intervals", "remaining_missing_intervals", "longest_identical_run", "hourly_rows", "hourly_incomplete", "weather")
    assert set(record) == {"years", *wanted} and record["duplicate_utc_intervals"] == 0 and record["hourly_rows"] == STEPS // 4
    stages.run_train(spark, config)
    out = stages.run_evaluate(spark, config)
    best = {r["model"]: r["mape_pct"] for r in out["metrics_test"].collect()}
    assert set(best) == set(stages.MODELS) and all(v < 50 for v in best.values())
    assert (config.root / "reports" / "metrics_test.csv").read_text().startswith("model,") and out["gain_share"].count() > 5
    found = stages.run_anomalies(spark, config)
    assert {r["method"] for r in found["injection_summary"].collect()} == {"residual", "isolation_forest", "flatline_rule", "residual_or_isolation_forest", "all_three_combined"}
    assert (config.root / "reports" / "results.md").exists() and (config.root / "reports" / "anomalies.md").exists()


def test_sheet_source(spark, config, tmp_path):
    spark.dataSource.register(workbook.SheetSource)
    rows = spark.read.format("xlsx_sheet").option("sheet", "Zeitreihen0h15").load(config.path("raw", "load-2022.xlsx"))
    assert rows.count() == STEPS + 2
    assert workbook.valid_files(spark, config.path("raw"), 1000).first()["valid"]
    assert not workbook.valid_files(spark, config.path("raw"), 10**9).first()["valid"]


def test_wrong_unit_fails(spark, config):
    from gridtide.operators.cleaning import checked_header

    head = spark.createDataFrame([("Energy\nTotal", "MWh")], "header string, unit string")
    with pytest.raises(Exception, match="unexpected unit"):
        checked_header(head, "Energy", "kWh").count()


def test_fetch(tmp_path):
    (tmp_path / "c.yaml").write_text(yaml.safe_dump({"paths": {"raw": "raw"}, "load": {"years": [2024], "url_template": "http://host/{year}.xlsx"}, "weather": {"api_url": "http://host/api", "start": "2024-01-01", "end": "2024-01-02", "locations": [{"name": "North", "latitude": 1.0, "longitude": 2.0, "shares": {"ZH": 1}}]}}))
    config = load_config(tmp_path / "c.yaml")
    book = fetch.fetch_workbooks(config, get=lambda url: b"PK\x03\x04" + b"0" * 100, least=50)
    assert book[0]["bytes"] == 104 and len(book[0]["sha256"]) == 64
    with pytest.raises(fetch.FetchError, match="2024"):
        fetch.fetch_workbooks(config, force=True, get=lambda url: b"no", least=50)
    with pytest.raises(fetch.FetchError, match="shortwave"):
        fetch.fetch_weather(config, get=lambda url: b'{"hourly": {"time": [], "temperature_2m": []}}')
    records = fetch.fetch_weather(config, get=lambda url: b'{"hourly": {"time": ["2024-01-01T00:00"], "temperature_2m": [1.5], "shortwave_radiation": [null]}}')
    assert fetch.write_manifest(config, book + records).exists()


def odd_book(path, prefix="x:", late=False):
    """A workbook of 500 rows: date cells of a built-in and an own format, shared and inline strings, a prefix, gaps."""
    serial = (datetime(2022, 1, 1) - (datetime(1904, 1, 1) if late else datetime(1899, 12, 30))).days
    p, body, want = prefix, "", []
    shared = ["Header", "odd <&> label", "  01.01.2022 00:45  "]
    for i in range(1, 501):
        r, n = (f' r="{i if i < 400 else i + 100}"' if i % 2 else ""), i if i < 400 or i == 400 else i + 100
        at = datetime(2022, 1, 1) + timedelta(minutes=15 * i)
        if i == 1:
            cells, row = f'<{p}c r="B1" t="s"><{p}v>0</{p}v></{p}c>', (1, None, "Header")
        elif i % 5 == 0:
            cells, row = f'<{p}c r="A{n}" t="s"><{p}v>2</{p}v></{p}c><{p}c r="B{n}" t="s"><{p}v>1</{p}v></{p}c>', (n, "01.01.2022 00:45", "odd <&> label")
        elif i % 5 == 1:
            cells, row = f'<{p}c r="A{n}" t="inlineStr"><{p}is><{p}t>x{i}</{p}t></{p}is></{p}c><{p}c r="C{n}"><{p}v>7</{p}v></{p}c>', (n, f"x{i}", None)
        else:
            style = 1 + i % 2
            cells, row = f'<{p}c r="A{n}" s="{style}"><{p}v>{serial + i / 96!r}</{p}v></{p}c><{p}c r="B{n}" s="1"><{p}v>{i}.5</{p}v></{p}c>', (n, f"{at:%d.%m.%Y %H:%M}", f"{i}.5")
        body += f"<{p}row{r}>{cells}</{p}row>"
        want.append(row)
    name = prefix.rstrip(":")
    space = f'xmlns:{name}="{MAIN}"' if name else f'xmlns="{MAIN}"'
    items = "".join(f"<{p}si><{p}t>{t.replace('&', '&amp;').replace('<', '&lt;')}</{p}t></{p}si>" for t in shared)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><workbookPr date1904="{int(late)}"/><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="200" formatCode="dd\\.mm\\.yyyy hh:mm"/><numFmt numFmtId="201" formatCode="0.00 &quot;day&quot;"/></numFmts><cellXfs><xf numFmtId="201"/><xf numFmtId="200"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f'<?xml version="1.0"?><{p}sst {space} count="3">{items}</{p}sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0"?><{p}worksheet {space}><{p}cols><{p}col/></{p}cols><{p}sheetData>{body}</{p}sheetData><{p}pageMargins/></{p}worksheet>')
    return want


@pytest.mark.parametrize("prefix, late", [("x:", True), ("", False)])
def test_sheets_are_read_in_segments(spark, tmp_path, prefix, late):
    want = odd_book(tmp_path / "a.xlsx", prefix, late)
    odd_book(tmp_path / "b.xlsx", prefix, late)
    assert workbook.sheet_segments(spark, str(tmp_path), "S", 2000).filter("kind = 'rows'").groupBy("file").count().filter("count > 10").count() == 2
    for size in (2000, workbook.SEGMENT):
        rows = workbook.read_sheets(spark, f"file://{tmp_path}", "S", size).filter("file = 'b.xlsx'").orderBy("row_no").collect()
        assert [tuple(r)[1:] for r in rows] == want
    assert list(workbook.sheet_rows((tmp_path / "a.xlsx").read_bytes(), "S")) == want
    with pytest.raises(ValueError, match="no sheet"):
        list(workbook.sheet_rows((tmp_path / "a.xlsx").read_bytes(), "T"))


def test_short_sheets_fail(spark, tmp_path):
    write_book(tmp_path / "short.xlsx", [["", "Energy"], ["Zeitstempel", "kWh"]])
    with pytest.raises(Exception, match="fewer than three rows"):
        workbook.read_sheets(spark, str(tmp_path), "Zeitreihen0h15").count()
