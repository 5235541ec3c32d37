"""Files that people read: grade workbooks, Markdown and charts of one team at a time, from frames of a team's size.

A report is written where its rows are: each group of rows becomes one file's bytes in a task, and files are written by
the reader's own means (a folder of Parquet rows, or local files for a few)."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{}</Types>'
_SHEET_TYPE = '<Override PartName="/xl/worksheets/sheet{}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
_REL = '<Relationship Id="rId{}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" Target="{}"/>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def _column(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def _cell(ref: str, v: object) -> str:
    if v is None or (isinstance(v, float) and pd.isna(v)):
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'


def workbook(sheets: dict[str, tuple[list[str], list[tuple]]]) -> bytes:
    """An xlsx file: sheet name -> (header, rows). Names are cut to 31 characters without those that are not allowed."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        def put(name: str, text: str) -> None:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)  # the same rows give the same bytes

        n = range(1, len(sheets) + 1)
        put("[Content_Types].xml", _TYPES.format("".join(_SHEET_TYPE.format(i) for i in n)))
        put("_rels/.rels", _RELS.format(_REL.format(1, "officeDocument", "xl/workbook.xml")))
        put("xl/_rels/workbook.xml.rels", _RELS.format("".join(_REL.format(i, "worksheet", f"worksheets/sheet{i}.xml") for i in n)))
        clean = ["".join(ch for ch in name if ch not in r"[]:*?/\\")[:31] or f"Sheet{i}" for i, name in enumerate(sheets, 1)]
        tabs = "".join(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, name in enumerate(clean, 1))
        put("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_MAIN}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{tabs}</sheets></workbook>')
        for i, (header, rows) in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">{"".join(_cell(f"{_column(j)}{r}", v) for j, v in enumerate(row))}</row>' for r, row in enumerate([header, *rows], 1))
            put(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def _md(v: object, digits: int) -> str:
    if v is None or (isinstance(v, float) and pd.isna(v)):
        return "–"
    text = f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    return text.replace("|", "\\|").replace("\n", " ")


def markdown_table(header: list[str], rows: list[tuple], digits: int = 2) -> str:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(header), line(["---"] * len(header)), *[line([_md(v, digits) for v in row]) for row in rows]])


def grades_markdown(project: str, final: float | None, students: list[tuple[str, float | None]], flags: list[tuple[str, str, str]], digits: int = 2) -> str:
    """A project's grade, its students by grade with competition ranks (equal grades share one), and their flags, severest first."""
    ranked = sorted(students, key=lambda s: (-(s[1] if s[1] is not None else -1.0), s[0]))
    rows = [(1 + sum(1 for _, g in students if g is not None and grade is not None and g > grade + 1e-9) if grade is not None else None, name, grade) for name, grade in ranked]
    order = {"CRITICAL": 0, "WARNING": 1, "INFO": 2}
    parts = [f"# {project}", f"Project grade: **{_md(final, digits)}**", markdown_table(["Rank", "Student", "Grade"], rows, digits)]
    if flags:
        parts += ["## Flags", markdown_table(["Student", "Severity", "Flag"], sorted(flags, key=lambda f: (order.get(f[1], 3), f[0], f[2])), digits)]
    return "\n\n".join(parts) + "\n"


def stacked_bars(title: str, rows: list[tuple[str, dict[str, float]]], colours: dict[str, str], width: int = 640, height: int = 22) -> str:
    """An SVG of one bar a row, its parts side by side, all to the scale of the longest."""
    most = max((sum(p.values()) for _, p in rows), default=0) or 1
    left, out = 140, [f'<text x="4" y="16" font-weight="bold">{escape(title)}</text>']
    for i, (name, parts) in enumerate(rows, 1):
        x, y = float(left), 8 + i * height
        out.append(f'<text x="4" y="{y + height * 0.6:.0f}">{escape(name)}</text>')
        for part, value in parts.items():
            w = value / most * (width - left - 8)
            out.append(f'<rect x="{x:.1f}" y="{y}" width="{w:.1f}" height="{height - 6}" fill="{colours.get(part, "#888")}"><title>{escape(part)}: {value:g}</title></rect>')
            x += w
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{16 + (len(rows) + 1) * height}" font-family="sans-serif" font-size="12">{"".join(out)}</svg>'


def grade_files(grades: DataFrame, digits: int = 2) -> DataFrame:
    """path, content: a workbook and a Markdown file for each project. grades: project, project_final, student, student_final, flags (array<struct<severity, flag>>). A project is one task's group, as it is a team."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = str(pdf["project"].iloc[0])
        final = None if pd.isna(pdf["project_final"].iloc[0]) else float(pdf["project_final"].iloc[0])
        students = [(str(s), None if pd.isna(g) else float(g)) for s, g in zip(pdf["student"], pdf["student_final"])]
        flags = [(str(s), f["severity"], f["flag"]) for s, fs in zip(pdf["student"], pdf["flags"]) for f in (fs if fs is not None else [])]
        name = "".join(ch if ch.isalnum() else "-" for ch in p.lower()).strip("-") or "project"
        book = workbook({"Grades": (["student", "grade"], sorted(students)), "Flags": (["student", "severity", "flag"], sorted(flags)), "Project": (["project", "grade"], [(p, final)])})
        return pd.DataFrame({"path": [f"{name}.xlsx", f"{name}.md"], "content": [book, grades_markdown(p, final, students, flags, digits).encode()]})

    return grades.groupBy("project").applyInPandas(one, "path string, content binary")


def save_files(files: DataFrame, folder: str) -> list[str]:
    """Writes path and content rows to a local folder, one row at a time on the driver; for the few files of a course."""
    out = []
    for row in files.orderBy("path").toLocalIterator():
        target = Path(folder) / row["path"]
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(bytes(row["content"]))
        out.append(str(target))
    return out


def save_tables(tables: dict[str, DataFrame], folder: str, by: str) -> None:
    """Report datasets as Parquet, a folder for each table and each value of ``by``; a rerun replaces only the values that it has."""
    for name, df in tables.items():
        df.withColumn(f"_{by}", F.col(by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(f"_{by}").parquet(f"{folder}/{name}")
