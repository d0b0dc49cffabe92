"""Workbooks as tables of cells: a data source over zipped sheet XML.

``spark.read.format("xlsx")`` gives a row for each cell of every workbook
below a path. Sheets are parsed as streams; of a file only its shared strings
are held. Writing cells to a workbook that is there changes these cells and
nothing else: rows that have none go through as they are, and so do all other
parts, but that tables grow to the last row written. Other workbooks are made
new. Files are dealt to tasks by size, and appear by a commit.
"""

from __future__ import annotations

import codecs
import re
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quiresmith.functions.formulas import column_name, column_number, shift
from quiresmith.sources.stores import move_in, store_of

#: A cell: its workbook, sheet and the sheet's place, row and column from 1, kind (number, text, boolean, error, or null where there is only a style), value as text, formula without its sign, and number of its style. Each sheet has a row of kind ``sheet`` at row 0.
CELLS = "book string, sheet string, place int, row int, col int, kind string, value string, formula string, style int"
#: Bytes of files that a task reads, about (zipped: a megabyte is a few hundred thousand cells); cells of a batch; bytes that a sheet is read by.
TASK_BYTES, BATCH, PIECE = 1 << 20, 4096, 1 << 16
#: Fixed values of the format: kinds of cells by their mark.
KINDS = {"s": "text", "str": "text", "inlineStr": "text", "d": "text", "b": "boolean", "e": "error", "n": "number"}
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PARTS = "http://schemas.openxmlformats.org/package/2006/relationships"

_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _plain(text: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def _texts(element: ElementTree.Element) -> str:
    """The text of a string item, of all its runs, without readings."""
    out = []
    for child in element:
        if _local(child.tag) == "t":
            out.append(child.text or "")
        elif _local(child.tag) == "r":
            out += [t.text or "" for t in child if _local(t.tag) == "t"]
    return _plain("".join(out))


def _elements(stream, name: str) -> Iterator[ElementTree.Element]:
    """Whole elements of a name, one at a time; what came before is let go."""
    path: list[ElementTree.Element] = []
    for event, element in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            path.append(element)
            continue
        path.pop()
        if _local(element.tag) == name:
            yield element
            element.clear()
            if path:
                path[-1].remove(element)


def _related(book: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Kind and path, by id, of the parts that a part names."""
    folder, _, file = part.rpartition("/")
    at = f"{folder}/_rels/{file}.rels"
    if at not in book.namelist():
        return {}
    found = {}
    for x in ElementTree.fromstring(book.read(at)):
        target = x.get("Target", "")
        steps: list[str] = []
        for step in (target[1:] if target.startswith("/") else f"{folder}/{target}").split("/"):
            steps = steps[:-1] if step == ".." else steps if step in ("", ".") else [*steps, step]
        found[x.get("Id")] = (x.get("Type", "").rpartition("/")[2], "/".join(steps))
    return found


def sheets_of(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and part of each sheet, in order."""
    parts = _related(book, "xl/workbook.xml")
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    out = []
    for x in root.iter():
        if _local(x.tag) == "sheet":
            link = next(v for k, v in x.attrib.items() if _local(k) == "id")
            if parts[link][0] == "worksheet":
                out.append((x.get("name"), parts[link][1]))
    return out


def _place(reference: str) -> tuple[int, int]:
    m = re.fullmatch(r"([A-Za-z]+)([0-9]+)", reference)
    if not m:
        raise ValueError(f"no cell is called {reference}")
    return int(m[2]), column_number(m[1])


def cells_of(stream, strings: list[str]) -> Iterator[tuple[int, int, str | None, str | None, str | None, int | None]]:
    """row, col, kind, value, formula, style of the cells of a sheet's stream. Shared formulas are written out."""
    row, shared = 0, {}
    for line in _elements(stream, "row"):
        row, col = int(line.get("r", row + 1)), 0
        for c in line:
            if _local(c.tag) != "c":
                continue
            row_, col = _place(c.get("r")) if c.get("r") else (row, col + 1)
            parts = {_local(x.tag): x for x in c}
            mark, value, formula = c.get("t", "n"), None, None
            if "v" in parts and parts["v"].text is not None:
                value = parts["v"].text
                value = strings[int(value)] if mark == "s" else _plain(value)
            elif "is" in parts:
                value = _texts(parts["is"])
            if "f" in parts:
                f = parts["f"]
                formula = f.text
                if f.get("t") == "shared":
                    if formula:
                        shared[f.get("si")] = (formula, row_, col)
                    elif f.get("si") in shared:
                        first, r0, c0 = shared[f.get("si")]
                        formula = shift(first, row_ - r0, col - c0)
            kind = KINDS.get(mark) if value is not None or formula else None
            style = c.get("s")
            yield row_, col, kind, value, formula, int(style) if style else None


def read_book(file) -> Iterator[tuple]:
    """sheet, place, row, col, kind, value, formula, style of a workbook's cells."""
    with zipfile.ZipFile(file) as book:
        strings: list[str] = []
        at = next((p for kind, p in _related(book, "xl/workbook.xml").values() if kind == "sharedStrings"), None)
        if at in book.namelist():
            with book.open(at) as stream:
                strings = [_texts(x) for x in _elements(stream, "si")]
        for place, (name, part) in enumerate(sheets_of(book)):
            yield name, place, 0, 0, "sheet", None, None, None
            with book.open(part) as stream:
                for cell in cells_of(stream, strings):
                    yield name, place, *cell


@dataclass(frozen=True)
class Cell:
    """What to write to a cell; kind ``style`` changes its style alone."""

    row: int
    col: int
    kind: str | None
    value: str | None
    formula: str | None
    style: int | None


def _cell_xml(cell: Cell, style: int | None, prefix: str = "") -> str:
    p = prefix
    name = f"{column_name(cell.col)}{cell.row}"
    head = f'<{p}c r="{name}"' + (f' s="{style}"' if style is not None else "")
    if cell.formula:
        return f"{head}><{p}f>{escape(cell.formula)}</{p}f></{p}c>"
    if cell.value is None:
        return f"{head}/>"
    if cell.kind == "text":
        text = re.sub(r"[\x00-\x08\x0b-\x1f]|_(?=x[0-9A-Fa-f]{4}_)", lambda m: f"_x{ord(m[0]):04X}_", cell.value)
        return f'{head} t="inlineStr"><{p}is><{p}t xml:space="preserve">{escape(text)}</{p}t></{p}is></{p}c>'
    mark = {"boolean": ' t="b"', "error": ' t="e"'}.get(cell.kind, "")
    return f"{head}{mark}><{p}v>{escape(cell.value)}</{p}v></{p}c>"


def _patched_row(row: int, text: str, cells: dict[int, Cell], prefix: str, replaced: dict[str, tuple[str, int, int]]) -> str:
    """A row's XML with cells put in or changed; ``replaced`` gets the shared formulas that are overwritten where they are spelled out."""
    p = re.escape(prefix)
    head = re.match(rf"<{p}row\b[^>]*?/?>", text)[0] if text else f'<{prefix}row r="{row}">'
    own = {}
    for m in re.finditer(rf"<{p}c\b[^>]*?(?:/>|>.*?</{p}c>)", text[len(head) :], re.DOTALL):
        found = re.search(r'\sr="([A-Za-z]+)[0-9]+"', m[0][: m[0].index(">")])
        own[column_number(found[1]) if found else max(own, default=0) + 1] = m[0]
    for col, cell in cells.items():
        old = own.get(col, "")
        old_style = re.search(r'^[^>]*\ss="([0-9]+)"', old)
        style = cell.style if cell.style is not None else int(old_style[1]) if old_style else None
        if cell.kind == "style" and old:
            start = old.index(">") - (old[old.index(">") - 1] == "/")
            own[col] = re.sub(r'\ss="[0-9]+"', "", old[:start]) + f' s="{style}"' + old[start:]
            continue
        m = re.search(rf'<{p}f\b([^>]*)>([^<]*)</{p}f>', old)
        if m and 't="shared"' in m[1] and (si := re.search(r'\bsi="([0-9]+)"', m[1])):
            replaced[si[1]] = (ElementTree.fromstring(f"<t>{m[2]}</t>").text or "", row, col)
        own[col] = _cell_xml(cell, style, prefix)
    head = re.sub(r'\sspans="[^"]*"', "", head)
    head = head[:-2].rstrip() + ">" if head.endswith("/>") else head
    return head + "".join(own[c] for c in sorted(own)) + f"</{prefix}row>"


def _spelled_out(row: int, text: str, prefix: str, replaced: dict[str, tuple[str, int, int]]) -> str:
    """A row's XML in which cells that shared a formula now gone have their own."""

    def one(m: re.Match) -> str:
        si = re.search(r'\bsi="([0-9]+)"', m[3])
        if 't="shared"' not in m[3] or not si or si[1] not in replaced:
            return m[0]
        formula, r0, c0 = replaced[si[1]]
        return f"{m[1]}<{prefix}f>{escape(shift(formula, row - r0, column_number(m[2]) - c0))}</{prefix}f>"

    p = re.escape(prefix)
    return re.sub(rf'(<{p}c\b[^>]*?\sr="([A-Za-z]+)[0-9]+"[^>]*>)<{p}f\b([^>]*?)/>', one, text)


def patch_sheet(source, out, cells: dict[int, dict[int, Cell]]) -> None:
    """Copies a sheet's XML from one stream to another, with cells (by row and column) put in. Rows without any pass unchanged."""
    left, buffer, prefix, inside = sorted(cells), "", "", False
    decoder = codecs.getincrementaldecoder("utf-8")()
    replaced: dict[str, tuple[str, int, int]] = {}
    last, most_row, most_col = 0, max(cells), max(c for r in cells.values() for c in r)

    def write(text: str) -> None:
        out.write(text.encode())

    def wider(m: re.Match) -> str:
        first, _, end = m[2].partition(":")
        (r0, c0), (r1, c1) = _place(first), _place(end or first)
        return f'{m[1]}"{column_name(min(c0, *(c for r in cells.values() for c in r)))}{min(r0, left[0])}:{column_name(max(c1, most_col))}{max(r1, most_row)}"'

    while True:
        data = source.read(PIECE)
        buffer += decoder.decode(data, not data)
        if not inside:
            m = re.search(r"<((?:\w+:)?)sheetData\s*(/?)>", buffer)
            if not m:
                if data:
                    continue
                raise ValueError("the sheet has no rows part")
            prefix, inside = m[1], True
            write(re.sub(rf'(<{re.escape(prefix)}dimension\b[^>]*?ref=)"([A-Z]+[0-9]+(?::[A-Z]+[0-9]+)?)"', wider, buffer[: m.start()], count=1) + f"<{prefix}sheetData>")
            buffer = buffer[m.end() :] if not m[2] else f"</{prefix}sheetData>" + buffer[m.end() :]
        p, at = re.escape(prefix), 0
        for m in re.finditer(rf"<{p}row\b[^>]*?(?:/>|(?<!/)>.*?</{p}row>)|</{p}sheetData>", buffer, re.DOTALL):
            if m[0].startswith("</"):
                while left:
                    row = left.pop(0)
                    write(_patched_row(row, "", cells[row], prefix, replaced))
                write(buffer[m.start() :])
                while data := source.read(PIECE):
                    out.write(data)
                return
            number = re.search(r'\sr="([0-9]+)"', m[0][: m[0].index(">")])
            last = int(number[1]) if number else last + 1
            while left and left[0] < last:
                row = left.pop(0)
                write(_patched_row(row, "", cells[row], prefix, replaced))
            text = _spelled_out(last, m[0], prefix, replaced) if replaced else m[0]
            write(_patched_row(left.pop(0), text, cells[last], prefix, replaced) if left and left[0] == last else text)
            at = m.end()
        buffer = buffer[at:]
        if not data:
            raise ValueError("the sheet's rows do not end")


def _grown(table: bytes, last: int) -> bytes:
    """A table part whose range ends at ``last`` at least, if it starts before."""
    text = table.decode()
    m = re.search(r'<(?:\w+:)?table\b[^>]*?\sref="([A-Z]+)([0-9]+):([A-Z]+)([0-9]+)"', text)
    if not m or int(m[2]) > last or int(m[4]) >= last:
        return table
    return text.replace(f'ref="{m[1]}{m[2]}:{m[3]}{m[4]}"', f'ref="{m[1]}{m[2]}:{m[3]}{last}"').encode()


def patch_book(source, out, cells: dict[str, dict[int, dict[int, Cell]]]) -> None:
    """Copies a workbook with cells (by sheet, row and column) put in.

    Parts other than the sheets written to keep their bytes, but for tables
    that grow, and the order of calculation, which is left out: it is made
    anew when the workbook is opened.
    """
    with zipfile.ZipFile(source) as book, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        parts = dict(sheets_of(book))
        if missing := set(cells) - set(parts):
            raise ValueError(f"the workbook has no sheet {sorted(missing)[0]}")
        mine = {parts[name]: rows for name, rows in cells.items()}
        tables: dict[str, int] = {}
        for part, rows in mine.items():
            for kind, at in _related(book, part).values():
                if kind == "table":
                    tables[at] = max(rows)
        for info in book.infolist():
            if info.filename == "xl/calcChain.xml":
                continue
            if info.filename in mine:
                with book.open(info) as a, new.open(info.filename, "w", force_zip64=True) as b:
                    patch_sheet(a, b, mine[info.filename])
                continue
            data = book.read(info)
            if info.filename in tables:
                data = _grown(data, tables[info.filename])
            elif info.filename in ("[Content_Types].xml", "xl/_rels/workbook.xml.rels") and b"calcChain" in data:
                data = re.sub(rb"<(?:Override|Relationship)\b[^>]*calcChain[^>]*/>", b"", data)
            new.writestr(info.filename, data)


def new_book(out, cells: Iterable[tuple[str, Cell]]) -> None:
    """Writes a workbook of cells that come by sheet, row and column; nothing but the row at hand is held."""
    xml = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    names: list[str] = []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        sheet, row, line = None, 0, []

        def end_row() -> None:
            if line:
                sheet.write(f'<row r="{row}">{"".join(line)}</row>'.encode())
                line.clear()

        def end_sheet() -> None:
            end_row()
            if sheet is not None:
                sheet.write(b"</sheetData></worksheet>")
                sheet.close()

        for name, cell in cells:
            if not names or names[-1] != name:
                end_sheet()
                names.append(name)
                sheet = book.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True)
                sheet.write(f'{xml}<worksheet xmlns="{MAIN}"><sheetData>'.encode())
            if cell.row != row:
                end_row()
            row = cell.row
            if row:
                line.append(_cell_xml(cell, cell.style))
        end_sheet()
        numbers = range(1, len(names) + 1)
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for n in numbers)
        book.writestr("[Content_Types].xml", f'{xml}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        book.writestr("_rels/.rels", f'{xml}<Relationships xmlns="{PARTS}"><Relationship Id="rId1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        sheets = "".join(f'<sheet name={quoteattr(name)} sheetId="{n}" r:id="rId{n}"/>' for n, name in zip(numbers, names))
        book.writestr("xl/workbook.xml", f'{xml}<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets>{sheets}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{n}" Type="{LINKS}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in numbers)
        book.writestr("xl/_rels/workbook.xml.rels", f'{xml}<Relationships xmlns="{PARTS}">{links}</Relationships>')


@dataclass
class _Files(InputPartition):
    files: list[tuple[str, str]]  # path, name of the workbook


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Files]:
        from quiresmith.sources.stores import dealt

        return [_Files(x) for x in dealt(self.path, ".xlsx", TASK_BYTES)]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        names = [c.split()[0] for c in CELLS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

        for path, name in partition.files:
            with store.open_input_file(path) as file:
                rows = []
                try:
                    for cell in read_book(file):
                        rows.append((name, *cell))
                        if len(rows) == BATCH:
                            yield batch(rows)
                            rows = []
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError, zlib.error, struct.error) as bad:
                    raise ValueError(f"{path}: {bad!r}") from bad
                if rows:
                    yield batch(rows)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)  # temporary path, name of the workbook


class _Writer(DataSourceArrowWriter):
    """Tasks write whole workbooks to a folder beside the others; the commit moves them to their names."""

    def __init__(self, options: dict[str, str]):
        import uuid

        self.path, self.base = options["path"], options.get("base", options["path"])
        self.folder = f"_books-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from itertools import groupby

        store, root = store_of(self.path)
        base_store, base = store_of(self.base)
        task, out = TaskContext.get(), _Written()
        store.create_dir(f"{root}/{self.folder}", recursive=True)
        fields = ("book", "sheet", "row", "col", "kind", "value", "formula", "style")
        rows = (r for batch in iterator for r in zip(*(batch.column(c).to_pylist() for c in fields)))
        cells = ((book, sheet, Cell(*cell)) for book, sheet, *cell in rows)
        for name, mine in groupby(cells, lambda x: x[0]):
            at = f"{root}/{self.folder}/{task.taskAttemptId()}-{len(out.files)}"
            old = f"{base}/{name}.xlsx"
            with store.open_output_stream(at) as stream:
                if base_store.get_file_info(old).is_file:
                    wanted: dict[str, dict[int, dict[int, Cell]]] = {}
                    for _, sheet, cell in mine:
                        if cell.row:
                            wanted.setdefault(sheet, {}).setdefault(cell.row, {})[cell.col] = cell
                    with base_store.open_input_file(old) as source:
                        patch_book(source, stream, wanted)
                else:
                    new_book(stream, ((sheet, cell) for _, sheet, cell in mine))
            out.files.append((at, name))
        return out

    def commit(self, messages: list[_Written | None]) -> None:
        move_in(self.path, self.folder, ".xlsx", [x for m in messages if m for x in m.files], replace=True)

    def abort(self, messages: list[_Written | None]) -> None:
        move_in(self.path, self.folder, ".xlsx", [], replace=True)


class XlsxSource(DataSource):
    """Format ``xlsx``. Reading: ``path`` is a folder, searched throughout, or a file.

    Writing (mode append) takes cells with those of a workbook together and in
    order; see ``sinks.write_cells``. A workbook below ``base`` (by default
    ``path``) of that name is the one that is changed.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format ``xlsx`` known to a session."""
    spark.dataSource.register(XlsxSource)
