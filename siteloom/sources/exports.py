"""Sinks: JSON, CSV, HTML report and XLSX workbooks. Reports are bounded: the caller limits what is collected."""

from __future__ import annotations

import html
import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a report may hold at most; tables beyond it are written as files, not as reports.
REPORT_ROWS = 100_000


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """All cells quoted, quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def rows(df: DataFrame, most: int = REPORT_ROWS) -> list[list]:
    """Header and rows of a table that must not have more than ``most`` rows."""
    got = df.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report holds {most} rows at most; write the table to files")
    return [df.columns, *[list(r) for r in got]]


def _column(i: int) -> str:
    name = ""
    while i >= 0:
        name, i = chr(65 + i % 26) + name, i // 26 - 1
    return name


def _sheet(table: list[list], choices: dict[int, list[str]] | None = None) -> str:
    out = ['<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">']
    out.append('<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData>')
    for r, line in enumerate(table, 1):
        cells = []
        for c, v in enumerate(line):
            at = f"{_column(c)}{r}"
            if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf"):
                cells.append(f'<c r="{at}"><v>{v}</v></c>')
            elif v is not None:
                text = "".join(ch for ch in str(v) if ch in "\t\n\r" or ord(ch) >= 32)[:32767]
                cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
        out.append(f'<row r="{r}">{"".join(cells)}</row>')
    out.append("</sheetData>")
    if table and table[0]:
        out.append(f'<autoFilter ref="A1:{_column(len(table[0]) - 1)}{max(len(table), 1)}"/>')
    if choices:
        rules = "".join(f'<dataValidation type="list" allowBlank="1" sqref="{_column(c)}2:{_column(c)}{max(len(table), 2)}"><formula1>"{escape(",".join(v))}"</formula1></dataValidation>' for c, v in choices.items())
        out.append(f'<dataValidations count="{len(choices)}">{rules}</dataValidations>')
    return "".join(out) + "</worksheet>"


def xlsx(sheets: dict[str, list[list]], choices: dict[str, dict[int, list[str]]] | None = None) -> bytes:
    """A workbook of stored (uncompressed) parts with inline strings, frozen header rows and filters."""
    names = [n.translate(str.maketrans("[]:*?/\\", "       "))[:31] or f"Sheet{i}" for i, n in enumerate(sheets, 1)]
    ns = "http://schemas.openxmlformats.org"
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{ns}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="rId1" Type="{ns}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{ns}/spreadsheetml/2006/main" xmlns:r="{ns}/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{ns}/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{ns}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>",
    }
    for i, (name, table) in enumerate(sheets.items(), 1):
        parts[f"xl/worksheets/sheet{i}.xml"] = _sheet(table, (choices or {}).get(name))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def checklist(issues: DataFrame, rollup: DataFrame, scores: DataFrame) -> bytes:
    """Workbook of an audit: scores, grouped issues with a state to choose, issues by page."""
    grouped = rows(rollup)
    table = [[*grouped[0], "state"], *[[*r, "open"] for r in grouped[1:]]]
    return xlsx({"Scores": rows(scores), "Issues": table, "Pages": rows(issues)}, {"Issues": {len(grouped[0]): ["open", "in progress", "done"]}})


def content_checklist(pages: DataFrame, words: str = "") -> bytes:
    """Workbook of topic pages, by kind and the least complete first, with a state to choose. ``pages`` as of ``views.topic_pages``."""
    from ..operators.views import topic_pages

    table = rows(topic_pages(pages, words).select("type", "title", "url", "topic", "completeness"))
    return xlsx({"Content": [[*table[0], "state"], *[[*r, "open"] for r in table[1:]]]}, {"Content": {len(table[0]): ["open", "in progress", "done"]}})


def plan_workbook(plan: DataFrame) -> bytes:
    """Workbook of a content plan (``content.plan``), one row per item, in the order of months, places and priorities."""
    return xlsx({"Plan": rows(plan.select("month", "place", "action", "title", "priority").orderBy("month", F.col("place").asc_nulls_last(), F.desc("priority"), "action", "title"))})


def html_report(title: str, tables: dict[str, DataFrame], most: int | None = None) -> str:
    """One page with a table for each entry. With ``most``, tables are cut there and say how many rows they have."""
    parts = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        got = (df if most is None else df.limit(most)).toLocalIterator()
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in got)
        whole = "" if most is None else f"<p>{most} of {df.count()} rows at most</p>"
        parts.append(f"<h2>{html.escape(name)}</h2>{whole}<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>")
    return "".join(parts)
