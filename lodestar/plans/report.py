"""Reports as JSON, Markdown, HTML or a workbook, from the small result frames."""

from __future__ import annotations

import html
import io
import json
import zipfile
from typing import Any

from lodestar.plans.described import with_texts
from lodestar.plans.run import Report

#: Failing rows shown of each rule; the frame itself has all.
SHOWN = 50


#: What a failed rule means: {n} of {total} ({pct} %), in the columns {where}.
TEXTS = {
    "null_check": "{n} of {total} cells ({pct} %) are empty, in {where}",
    "duplicate_check": "{n} of {total} rows ({pct} %) occur more than once",
    "type_check": "{n} of {total} columns hold another type than expected: {where}",
    "range_check": "{n} of {total} numbers ({pct} %) lie far from the others, in {where}",
    "pattern_check": "{n} of {total} texts ({pct} %) don't follow their column's pattern, in {where}",
    "unique_check": "{n} rows repeat a value that should be unique, in {where}",
    "referential_integrity_check": "{n} of {total} references ({pct} %) point to no row, in {where}",
    "cardinality_check": "{n} of {total} columns have one value only or nearly as many as rows: {where}",
    "distribution_check": "{n} of {total} numeric columns are skewed, heavy-tailed or not normal: {where}",
    "correlation_check": "{n} columns or pairs of columns say the same",
    "row_completeness_check": "{n} of {total} rows ({pct} %) are mostly empty",
    "multivariate_outlier_check": "{n} of {total} rows ({pct} %) are unlike the others in all numbers together",
    "email_check": "{n} of {total} addresses ({pct} %) are malformed, in {where}",
    "special_chars_check": "{n} of {total} texts ({pct} %) hold control, invisible or unusual characters, in {where}",
    "string_length_check": "{n} of {total} texts ({pct} %) are too short or too long, in {where}",
    "trim_check": "{n} of {total} texts ({pct} %) begin or end with spaces, in {where}",
    "case_consistency_check": "{n} of {total} texts ({pct} %) are written in another case than their column, in {where}",
    "phone_check": "{n} of {total} phone numbers ({pct} %) are malformed, in {where}",
    "zip_code_check": "{n} of {total} postal codes ({pct} %) are malformed, in {where}",
    "rfc_curp_check": "{n} of {total} tax or population codes ({pct} %) are malformed, in {where}",
    "invalid_date_check": "{n} of {total} values ({pct} %) are no dates, in {where}",
    "date_range_check": "{n} of {total} dates ({pct} %) are too early or after now, in {where}",
    "date_inconsistency_check": "{n} of {total} pairs of dates ({pct} %) are in the wrong order",
    "freshness_check": "{n} of {total} dates ({pct} %) are too old, in {where}",
    "latency_check": "{n} of {total} rows ({pct} %) arrived too long after their event",
    "cross_consistency_check": "{n} of {total} rows ({pct} %) break a rule between columns: {where}",
    "functional_dependency_check": "{n} of {total} values ({pct} %) determine more than one value of another column",
    "class_balance_check": "{n} of {total} columns have one category for nearly all rows: {where}",
    "boolean_bias_check": "{n} of {total} yes-or-no columns have nearly one answer: {where}",
    "derived_column_check": "{n} of {total} values ({pct} %) differ from their formula, in {where}",
    "drift_check": "{n} of {total} rows ({pct} %) have categories that the reference doesn't know, in {where}",
    "schema_evolution_check": "{n} columns were added, removed or changed: {where}",
    "volume_anomaly_check": "the number of rows is {n} ({pct} %) away from what was expected",
    "sequential_integrity_check": "{n} numbers are missing from running columns: {where}",
    "missing_fk_check": "{n} of {total} foreign keys ({pct} %) have no parent, in {where}",
    "fuzzy_name_match": "{n} of {total} rows ({pct} %) have a name much like another's",
    "fuzzy_id_match": "{n} of {total} rows ({pct} %) have a document number much like another's",
    "similar_dob": "{n} of {total} rows ({pct} %) have a birth date a few days from another's",
    "person_composite_similarity": "{n} of {total} rows ({pct} %) are much like another over several fields",
    "personas_similares": "{n} of {total} rows ({pct} %) are probably a person that another row has",
    "custom_sql_rule": "{n} of {total} rows ({pct} %) are returned by the query",
    "custom_expression_rule": "{n} of {total} rows ({pct} %) break the predicate",
    "custom_python_rule": "{n} of {total} rows ({pct} %) are marked by the function",
}


def describe(finding) -> str:
    """One sentence about a finding."""
    if finding.errored:
        return f"{finding.rule_name} could not be evaluated"
    if finding.passed:
        return f"{finding.rule_name}: {finding.total} values checked, none that counts against it"
    names = (d.get("column") or d.get("target") or d.get("rule") or d.get("child") for d in finding.details)
    where = ", ".join(dict.fromkeys(str(n) for n in names if n)) or "all columns"
    text = TEXTS.get(finding.rule_name, "{n} of {total} ({pct} %) fail, in {where}")
    return f"{finding.rule_name}: " + text.format(n=finding.failed, total=finding.total, pct=finding.failure_pct, where=where)


def describe_detail(detail: dict[str, Any]) -> str:
    """A detail of a finding as text: its column, then what was measured."""
    head = detail.get("column") or detail.get("target") or detail.get("rule") or detail.get("child")
    rest = ", ".join(f"{k.replace('_', ' ')} {v}" for k, v in detail.items() if v is not None and v != head)
    return f"{head}: {rest}" if head and rest else str(head or rest)


def as_dict(report: Report, shown: int = SHOWN) -> dict[str, Any]:
    rows: dict[str, list[dict[str, Any]]] = {}
    for f in report.findings:
        if f.failures is not None and f.failed and shown:
            rows[f.rule_name] = [r.asDict() for r in with_texts(f.failures).orderBy("column", "row_id").limit(shown).collect()]
    return {
        "score": report.score,
        "label": report.label,
        "results": [{"rule_name": f.rule_name, "description": f.description, "severity": f.severity, "passed": f.passed, "total": f.total, "failed": f.failed, "failure_pct": f.failure_pct, "errored": f.errored, "text": describe(f), "recommendation": f.recommendation, "details": f.details, "detail_texts": [describe_detail(d) for d in f.details], "failures": rows.get(f.rule_name, [])} for f in report.findings],
        "recommendations": report.recommendations(),
    }


def to_json(report: Report, shown: int = SHOWN) -> str:
    """Values without a JSON form as text; infinities too."""

    def safe(v: Any) -> Any:
        if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
            return str(v)
        if isinstance(v, dict):
            return {str(k): safe(x) for k, x in v.items()}
        if isinstance(v, list | tuple):
            return [safe(x) for x in v]
        return v

    return json.dumps(safe(as_dict(report, shown)), default=str, ensure_ascii=False, indent=1)


def _read(report: Report | dict[str, Any], shown: int) -> dict[str, Any]:
    """A report, or what ``to_json`` wrote of one, as a dictionary."""
    return report if isinstance(report, dict) else as_dict(report, shown)


def to_markdown(report: Report | dict[str, Any]) -> str:
    own = _read(report, 0)
    lines = [f"# Data quality: {own['score']} ({own['label']})", "", "| rule | severity | passed | total | failed | % |", "| --- | --- | --- | --- | --- | --- |"]
    lines += [f"| {r['rule_name']} | {r['severity']} | {'yes' if r['passed'] else 'no'} | {r['total']} | {r['failed']} | {r['failure_pct']} |" for r in own["results"]]
    advice = own["recommendations"]
    return "\n".join([*lines, *(["", "## Recommendations", ""] if advice else []), *(f"- **{r['rule']}**: {r['text']}" for r in advice)]) + "\n"


def to_html(report: Report | dict[str, Any], shown: int = SHOWN) -> str:
    e = lambda v: html.escape(str(v))
    own, body = _read(report, shown), []
    for r in own["results"]:
        rows = "".join(f"<tr><td>{e(x['column'])}</td><td>{e(x['row_id'])}</td><td>{e(x['value'])}</td></tr>" for x in r["failures"])
        notes = "".join(f"<li>{e(x)}</li>" for x in r.get("detail_texts", []))
        body.append(f"<section class='{'ok' if r['passed'] else 'bad'}'><h2>{e(r['rule_name'])}</h2><p>{e(r['text'])}</p>" + (f"<ul>{notes}</ul>" if notes else "") + (f"<p><em>{e(r['recommendation'])}</em></p>" if r["recommendation"] else "") + (f"<table><tr><th>column</th><th>row</th><th>value</th></tr>{rows}</table>" if rows else "") + "</section>")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Data quality</title><style>body{{font-family:sans-serif}}.ok h2{{color:#276749}}.bad h2{{color:#9b2c2c}}td,th{{border:1px solid #ccc;padding:2px 6px}}</style></head><body><h1>{e(own['score'])} ({e(own['label'])})</h1>{''.join(body)}</body></html>"


def to_workbook(report: Report) -> bytes:
    """An .xlsx of one sheet with the results."""
    head = ["rule_name", "severity", "passed", "total", "failed", "failure_pct", "recommendation"]
    rows = [head] + [[f.rule_name, f.severity, f.passed, f.total, f.failed, f.failure_pct, f.recommendation] for f in report.findings]

    def cell(v: Any) -> str:
        if isinstance(v, int | float) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        return f"<c t='inlineStr'><is><t>{html.escape('' if v is None else str(v))}</t></is></c>"

    sheet = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
    space = "http://schemas.openxmlformats.org"
    files = {
        "[Content_Types].xml": f"<Types xmlns='{space}/package/2006/content-types'><Default Extension='rels' ContentType='application/vnd.openxmlformats-package.relationships+xml'/><Default Extension='xml' ContentType='application/xml'/><Override PartName='/xl/workbook.xml' ContentType='application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml'/><Override PartName='/xl/worksheets/sheet1.xml' ContentType='application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml'/></Types>",
        "_rels/.rels": f"<Relationships xmlns='{space}/package/2006/relationships'><Relationship Id='r1' Type='{space}/officeDocument/2006/relationships/officeDocument' Target='xl/workbook.xml'/></Relationships>",
        "xl/workbook.xml": f"<workbook xmlns='{space}/spreadsheetml/2006/main' xmlns:r='{space}/officeDocument/2006/relationships'><sheets><sheet name='results' sheetId='1' r:id='r1'/></sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f"<Relationships xmlns='{space}/package/2006/relationships'><Relationship Id='r1' Type='{space}/officeDocument/2006/relationships/worksheet' Target='worksheets/sheet1.xml'/></Relationships>",
        "xl/worksheets/sheet1.xml": f"<worksheet xmlns='{space}/spreadsheetml/2006/main'><sheetData>{sheet}</sheetData></worksheet>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, "<?xml version='1.0' encoding='UTF-8'?>" + text)
    return out.getvalue()


def to_pdf(report: Report) -> bytes:
    """A plain one-font PDF of the Markdown text."""
    lines = to_markdown(report).splitlines()
    pages = [lines[i : i + 60] for i in range(0, len(lines), 60)] or [[]]
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{4 + 2 * i} 0 R' for i in range(len(pages)))}] /Count {len(pages)} >>".encode(), b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"]
    for i, page in enumerate(pages):
        text = b"BT /F1 8 Tf 36 800 Td 12 TL " + b" ".join(b"(" + line[:110].encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj T*" for line in page) + b" ET"
        objects += [f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>".encode(), b"<< /Length " + str(len(text)).encode() + b" >>\nstream\n" + text + b"\nendstream"]
    out, places = io.BytesIO(), []
    out.write(b"%PDF-1.4\n")
    for i, o in enumerate(objects, 1):
        places.append(out.tell())
        out.write(f"{i} 0 obj\n".encode() + o + b"\nendobj\n")
    start = out.tell()
    out.write(f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places))
    out.write(f"trailer << /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode())
    return out.getvalue()


def store(report: Report, path: str, report_id: str) -> None:
    """Appends results, details and failures as Parquet under ``path``; failures are written by the executors."""
    from pyspark.sql import functions as F

    for name, df in (("results", report.results()), ("details", report.details()), ("failures", report.failures())):
        df.withColumn("report_id", F.lit(report_id)).write.mode("append").parquet(f"{path}/{name}")
    report.spark.createDataFrame([(report_id, float(report.score), report.label)], "report_id string, score double, label string").withColumn("executed_at", F.current_timestamp()).write.mode("append").parquet(f"{path}/reports")
