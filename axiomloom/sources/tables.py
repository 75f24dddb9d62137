"""Tables of terms from CSV, OpenDocument and Excel files; all values are trimmed text.

Term tables are small and are read on the driver, in order, so that messages can name
the row; :func:`frame` hands them to Spark. For large CSV files with the same contract,
:func:`read_csv` reads on the executors.
"""

from __future__ import annotations

import csv
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An OpenDocument sheet ends after so many empty rows: its styled but empty rest may be a million.
EMPTY_ROWS = 1000
_OFFICE = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"
_TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class TableError(ValueError):
    """A table, or a row of one, that can't be used."""


@dataclass
class Row:
    """A row by lower-case column name; missing optional columns give their default."""

    table: Table
    number: int
    values: dict[str, str]

    def __getitem__(self, column: str) -> str:
        column = column.strip().lower()
        if column in self.values:
            return self.values[column]
        if column in self.table.required:
            raise TableError(f"The required column {column!r} is missing in {self.place()}.")
        return self.table.defaults.get(column, "")

    def __contains__(self, column: str) -> bool:
        return column.strip().lower() in self.values

    def __iter__(self) -> Iterator[str]:
        return iter(self.values)

    def place(self) -> str:
        return f"row {self.number} of table {self.table.name!r} in {self.table.file}"


@dataclass
class Table:
    """One table of a file."""

    file: str
    name: str
    columns: list[str]
    rows: list[tuple[int, list[str]]]
    required: set[str] = field(default_factory=set)
    defaults: dict[str, str] = field(default_factory=dict)

    def need(self, *columns: str) -> Table:
        """Declares required columns; one that is missing is an error."""
        self.required |= {c.strip().lower() for c in columns}
        if missing := self.required - set(self.columns):
            raise TableError(f"Table {self.name!r} in {self.file} lacks the required columns: {', '.join(sorted(missing))}.")
        return self

    def __iter__(self) -> Iterator[Row]:
        for number, values in self.rows:
            yield Row(self, number, dict(zip(self.columns, values, strict=True)))


def _named(file: str, name: str, header: list[str]) -> list[str]:
    columns = [c.strip().lower() for c in header]
    for k, c in enumerate(columns):
        if c in columns[:k]:
            raise TableError(f"The column name {c!r} is used more than once in table {name!r} of {file}.")
    return columns


def read_csv_tables(path: str) -> list[Table]:
    """The one table of a CSV file. Rows of blank cells are passed over; a row of another length than the header is an error."""
    with open(path, encoding="utf-8-sig", newline=None) as lines:
        rows = list(csv.reader(lines))
    if not rows:
        raise TableError(f"{path} has no header row.")
    columns, out = _named(path, "table", rows[0]), []
    for number, row in enumerate(rows[1:], 2):
        values = [v.strip() for v in row]
        if not any(values):
            continue
        if len(values) != len(columns):
            raise TableError(f"Row {number} of {path} has {len(values)} fields where {len(columns)} are expected.")
        out.append((number, values))
    return [Table(path, "table", columns, out)]


def _sheet(path: str, name: str, rows: Iterator[list[str]], most_empty: int | None = None) -> Table | None:
    """A sheet's table: columns to the first blank name, rows to the last, or to ``most_empty`` empty ones."""
    header = next(rows, None)
    if header is None:
        return None
    width = next((k for k, c in enumerate(header) if not c.strip()), len(header))
    columns, out, empty = _named(path, name, header[:width]), [], 0
    for number, row in enumerate(rows, 2):
        values = [v.strip() for v in row[:width]]
        values += [""] * (width - len(values))
        if any(values):
            out.append((number, values))
            empty = 0
        else:
            empty += 1
            if empty == most_empty:
                break
    return Table(path, name, columns, out)


def read_odf_tables(path: str) -> list[Table]:
    """The sheets of an ``.ods`` or flat ``.fods`` file."""
    data = Path(path).read_bytes()
    if zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as z:
            data = z.read("content.xml")
    root = ElementTree.fromstring(data)

    def cells(row) -> list[str]:
        out: list[str] = []
        empty = 0  # cells that only count once another one follows: the last run is padding to the sheet's edge
        for c in row:
            if c.tag in (f"{_TABLE}table-cell", f"{_TABLE}covered-table-cell"):
                text = "\n".join("".join(p.itertext()) for p in c.findall(f"{_TEXT}p"))
                times = int(c.get(f"{_TABLE}number-columns-repeated", 1))
                if text:
                    out += [""] * empty + [text] * times
                    empty = 0
                else:
                    empty += times
        return out

    def rows(table):
        for row in table.iter(f"{_TABLE}table-row"):
            values = cells(row)
            for _ in range(min(int(row.get(f"{_TABLE}number-rows-repeated", 1)), EMPTY_ROWS if not any(values) else 1 << 20)):
                yield values

    sheets = [_sheet(path, t.get(f"{_TABLE}name", ""), rows(t), EMPTY_ROWS) for t in root.iter(f"{_TABLE}table")]
    return [s for s in sheets if s]


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


#: Number formats that every workbook has; fixed values of the file format.
BUILT_IN_FORMATS = {
    1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM",
    20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0;(#,##0)", 38: "#,##0;(#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;(#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss.0", 49: "@",
}
_FORMAT_PART = re.compile(r'"([^"]*)"|\\(.)|_.|\*.|\[[^\]]*\]|AM/PM|A/P|y+|m+|d+|h+|s+(?:\.0+)?|.', re.I)


def _plain_number(number: float) -> str:
    return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)


def _shown_date(number: float, form: str, epoch: datetime) -> str:
    """A day number by a date format; ``m`` after hours or before seconds are minutes."""
    at = epoch + timedelta(seconds=round(number * 86_400, 3))
    parts = [m for m in _FORMAT_PART.finditer(form.split(";")[0])]
    signs = [m[0].lower() for m in parts]
    clock = any(x in ("am/pm", "a/p") for x in signs)
    letters = [(k, x.strip("[]")) for k, x in enumerate(signs) if x.strip("[]")[:1] in tuple("ymdhs") and parts[k][1] is None and parts[k][2] is None]
    minutes = {k for i, (k, x) in enumerate(letters) if x[0] == "m" and (i and letters[i - 1][1][0] == "h" or i + 1 < len(letters) and letters[i + 1][1][0] == "s")}
    out = []
    for k, (m, x) in enumerate(zip(parts, signs, strict=True)):
        n = len(x)
        if m[1] is not None or m[2] is not None:
            out.append(m[1] if m[1] is not None else m[2])
        elif x in ("[h]", "[hh]"):
            out.append(str(int(number * 24 + 1e-9)))
        elif x in ("am/pm", "a/p"):
            out.append(("AM" if at.hour < 12 else "PM")[: 2 if n > 3 else 1])
        elif x[0] == "y":
            out.append(f"{at.year % 100:02d}" if n <= 2 else str(at.year))
        elif k in minutes:
            out.append(f"{at.minute:0{min(n, 2)}d}")
        elif x[0] == "m":
            out.append([str(at.month), f"{at.month:02d}", _MONTHS[at.month - 1][:3], _MONTHS[at.month - 1], _MONTHS[at.month - 1][0]][min(n, 5) - 1])
        elif x[0] == "d":
            out.append([str(at.day), f"{at.day:02d}", _DAYS[at.weekday()][:3], _DAYS[at.weekday()]][min(n, 4) - 1])
        elif x[0] == "h":
            hour = (at.hour - 1) % 12 + 1 if clock else at.hour
            out.append(f"{hour:0{min(n, 2)}d}")
        elif x[0] == "s":
            whole, _, part = x.partition(".")
            out.append(f"{at.second:0{min(len(whole), 2)}d}" + (f".{at.microsecond:06d}"[: len(part) + 1] if part else ""))
        elif x[0] not in "[_*":
            out.append(m[0])
    return "".join(out)


_MONTHS = "January February March April May June July August September October November December".split()
_DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()


def _shown(number: float, form: str, epoch: datetime) -> str:
    """A number as a sheet shows it: dates and times, fixed decimals, thousands, percent, exponents; others plainly."""
    bare = re.sub(r'"[^"]*"|\\.|\[(?!h)[^\]]*\]', "", form)
    if form.lower() in ("", "general", "@"):
        return _plain_number(number)
    if re.search("[ymdhs]", bare, re.I):
        return _shown_date(number, form, epoch)
    sections = form.split(";")
    section = sections[1] if number < 0 and len(sections) > 1 else sections[2] if number == 0 and len(sections) > 2 else sections[0]
    digits = re.search(r"[#0?,]*[#0?](?:\.[0#?]*)?(?:E[+-]0+)?|\.[0#?]+", re.sub(r'"[^"]*"|\\.', lambda m: " " * len(m[0]), section))
    if not digits:
        return "".join(m[1] or m[2] or "" for m in _FORMAT_PART.finditer(section)) or _plain_number(number)
    own = digits[0]
    x = abs(number) if section is not sections[0] or len(sections) == 1 else number
    x = x * 100 if "%" in section else x
    whole, _, part = own.partition(".")
    part, power = part.split("E")[0] if "E" in part else part, "E" in own
    places = len(part)
    text = f"{x:.{places}E}" if power else f"{Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP):{',' if ',' in whole else ''}.{places}f}"
    if power:
        a, _, b = text.partition("E")
        text = f"{a}E{'-' if b[0] == '-' else '+' if '+' in own else ''}{abs(int(b)):0{max(own.split('E')[1].count('0'), 1)}d}"
    for _ in range(len(part) - len(part.rstrip("#?"))):
        text = text[:-1] if text.endswith("0") and "." in text else text
    text = text.removesuffix(".") if part else text
    least = whole.replace(",", "").count("0")
    sign = "-" if number < 0 and section is sections[0] else ""
    text = text.removeprefix("-")
    head, dot, tail = text.partition(".")
    head = head.zfill(least) if least > len(head) else "" if head == "0" and not least and dot else head
    before, after = section[: digits.start()], section[digits.end() :]
    literal = lambda t: "".join(m[1] if m[1] is not None else m[2] if m[2] is not None else "" if m[0][0] in "[_*" else m[0] for m in _FORMAT_PART.finditer(t))
    return sign + literal(before) + head + dot + tail + literal(after)


def read_xlsx_tables(path: str) -> list[Table]:
    """The sheets of an ``.xlsx`` file, as the sheet shows them, formulas by their stored values; an error cell is an error."""
    with zipfile.ZipFile(path) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_SHEET}si")]
        forms: list[str] = []
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = BUILT_IN_FORMATS | {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_SHEET}numFmt")}
            forms = [own.get(int(x.get("numFmtId", 0)), "") for cells in styles.findall(f"{_SHEET}cellXfs") for x in cells.findall(f"{_SHEET}xf")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book, sheets = ElementTree.fromstring(z.read("xl/workbook.xml")), []
        since_1904 = any(w.get("date1904") in ("1", "true") for w in book.iter(f"{_SHEET}workbookPr"))
        epoch = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30)
        for s in book.iter(f"{_SHEET}sheet"):
            target = targets[s.get(f"{_REL}id")]
            sheets.append((s.get("name"), ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))))

    def value(c, name) -> str:
        kind, v = c.get("t", "n"), c.find(f"{_SHEET}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
        if v is None and c.find(f"{_SHEET}f") is not None:
            raise TableError(f"Cell {c.get('r')} of sheet {name!r} in {path} holds a formula without a stored value.")
        text = "" if v is None else v.text or ""
        if kind == "e":
            raise TableError(f"Cell {c.get('r')} of sheet {name!r} in {path} holds the error {text}.")
        if kind == "s":
            return shared[int(text)]
        if kind == "b":
            return "TRUE" if text == "1" else "FALSE"
        if kind == "n" and text:
            style = int(c.get("s", 0))
            return _shown(float(text), forms[style] if style < len(forms) else "", epoch)
        return text

    def rows(sheet, name):
        last = 0
        for row in sheet.iter(f"{_SHEET}row"):
            at = int(row.get("r", last + 1))
            for _ in range(at - last - 1):
                yield []
            last, values = at, []
            for c in row.findall(f"{_SHEET}c"):
                k = _column(c.get("r")) if c.get("r") else len(values)
                values += [""] * (k - len(values)) + [value(c, name)]
            yield values

    found = [_sheet(path, n, rows(s, n)) for n, s in sheets]
    return [t for t in found if t]


READERS = {".csv": read_csv_tables, ".ods": read_odf_tables, ".fods": read_odf_tables, ".xlsx": read_xlsx_tables}


def read_tables(path: str) -> list[Table]:
    """All tables of a file, by its extension."""
    ext = Path(path).suffix
    if ext == ".xls":
        raise TableError(f"{path}: the old binary Excel format is not supported; save the file as .xlsx.")
    if ext not in READERS:
        raise TableError(f"{path}: unsupported input file format {ext!r}.")
    return READERS[ext](path)


def table(path: str, which: int | str = 0) -> Table:
    """One table by number or name; KeyError without it."""
    found = read_tables(path)
    hit = found[which : which + 1] if isinstance(which, int) and which >= 0 else [t for t in found if t.name == which]
    if not hit:
        raise KeyError(f"{path} has no table {which!r}.")
    return hit[0]


def frame(spark: SparkSession, t: Table) -> DataFrame:
    """A table as a DataFrame, with where each row is."""
    names = [*t.columns, "_file", "_table", "_row_num"]
    kinds = ", ".join(f"`{c}` string" for c in names[:-1]) + ", `_row_num` long"
    return spark.createDataFrame([(*values, t.file, t.name, number) for number, values in t.rows], kinds)


def read_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """CSV files: trimmed text, lower-case names, no nulls, no rows of blank cells; a row of another length fails.

    Files with line ends inside of quotes are read one task each. Where there are none,
    ``multiline`` false lets large files be split.
    """
    raw = spark.read.option("header", True).option("multiLine", multiline).option("mode", "FAILFAST").option("enforceSchema", False).option("escape", '"').csv(path)
    cols = [F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c.strip().lower()) for c in raw.columns]
    if len({c.strip().lower() for c in raw.columns}) < len(raw.columns):
        raise TableError(f"A column name is used more than once in {path}.")
    rows = raw.select(*cols)
    return rows.where(F.concat(*[F.col(f"`{c}`") for c in rows.columns]) != "")


def text_of(path: str) -> str:
    """All tables of a file as CSV text, each under its name."""
    from io import StringIO

    out = StringIO()
    for t in read_tables(path):
        out.write(f"# {t.name}\n")
        w = csv.writer(out, lineterminator="\n")
        w.writerow(t.columns)
        w.writerows(values for _, values in t.rows)
    return out.getvalue()
