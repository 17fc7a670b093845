"""Text of office files. They are zipped XML, so the standard library is enough."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

from pyspark.sql import DataFrame, types as T

# XML namespaces of the office formats.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SLIDE = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"

# What elements other than text stand for.
WORD_MARKS = {f"{WORD}tab": "\t", f"{WORD}br": "\n", f"{WORD}cr": "\n", f"{WORD}noBreakHyphen": "-"}
DRAWING_MARKS = {f"{DRAWING}br": "\v"}


def _xml(archive: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(archive.read(name))


def _listed_parts(archive: zipfile.ZipFile, main: str, item: str) -> list[str]:
    """The parts the main part lists as `item`, in its order, which need not be the order of their names."""
    folder, name = posixpath.split(main)
    links = {r.get("Id"): r.get("Target") for r in _xml(archive, f"{folder}/_rels/{name}.rels").iter(f"{PACKAGE}Relationship")}
    targets = [links[e.get(f"{LINK}id")] for e in _xml(archive, main).iter(item)]
    return [t.lstrip("/") if t.startswith("/") else posixpath.normpath(f"{folder}/{t}") for t in targets]


def docx_text(archive: zipfile.ZipFile) -> str:
    """Paragraphs of the body itself; tables and text boxes are not among them."""
    def runs_of(child):
        if child.tag == f"{WORD}hyperlink":
            return child.findall(f"{WORD}r")
        return [child] if child.tag == f"{WORD}r" else []

    def text(paragraph):
        runs = [run for child in paragraph for run in runs_of(child)]
        return "".join(e.text or "" if e.tag == f"{WORD}t" else WORD_MARKS.get(e.tag, "") for run in runs for e in run)

    return "\n".join(text(p) for p in _xml(archive, "word/document.xml").findall(f"{WORD}body/{WORD}p"))


def pptx_text(archive: zipfile.ZipFile) -> str:
    """Text shapes of the slides in show order; groups and tables are not text shapes."""
    def paragraph(p):
        return "".join(DRAWING_MARKS.get(e.tag) or e.findtext(f"{DRAWING}t") or "" for e in p)

    shapes = []
    for name in _listed_parts(archive, "ppt/presentation.xml", f"{SLIDE}sldId"):
        for shape in _xml(archive, name).findall(f"{SLIDE}cSld/{SLIDE}spTree/{SLIDE}sp"):
            shapes.append("\n".join(paragraph(p) for p in shape.findall(f"{SLIDE}txBody/{DRAWING}p")))
    return "\n".join(shapes)


def _cell_text(cell, shared: list[str]) -> str:
    """A cell as text; empty for empty, zero and false ones. Dates stay the numbers they are stored as."""
    kind = cell.get("t", "n")
    formula = cell.findtext(f"{SHEET}f")
    raw = cell.findtext(f"{SHEET}v") or ""
    if formula:
        return f"={formula}"
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{SHEET}t"))
    if not raw:
        return ""
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "True" if raw == "1" else ""
    if kind != "n":
        return raw
    number = float(raw) if set(raw.lower()) & set(".e") else int(raw)
    return str(number) if number else ""


def xlsx_text(archive: zipfile.ZipFile) -> str:
    """A line per row, its cells joined by blanks; a row that is left out between others is an empty line."""
    shared = []
    if "xl/sharedStrings.xml" in archive.namelist():
        shared = ["".join(t.text or "" for t in item.iter(f"{SHEET}t"))
                  for item in _xml(archive, "xl/sharedStrings.xml").findall(f"{SHEET}si")]
    lines = []
    for name in _listed_parts(archive, "xl/workbook.xml", f"{SHEET}sheet"):
        last = 0
        for row in _xml(archive, name).iter(f"{SHEET}row"):
            number = int(row.get("r", last + 1))
            lines.extend([""] * (number - last - 1))
            lines.append(" ".join(filter(None, (_cell_text(c, shared) for c in row.findall(f"{SHEET}c")))))
            last = number
    return "".join(line + "\n" for line in lines)


def _zipped(read):
    def run(content: bytes) -> str:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            return read(archive)

    return run


READERS = {"docx": _zipped(docx_text), "pptx": _zipped(pptx_text), "xlsx": _zipped(xlsx_text)}


def parse_files(files: DataFrame, readers: dict[str, Callable[[bytes], str]]) -> DataFrame:
    """Replace `content` by `text`, read by the reader of the file's extension, and `_error`, which says why there is none."""
    kept = [f for f in files.schema.fields if f.name != "content"]
    names = [f.name for f in kept]

    def read(content, extension):
        try:
            return readers[extension](content), None
        except Exception as error:  # whatever is wrong with one file must not end the job
            return None, f"{type(error).__name__}: {error}"

    def run(batches):
        for batch in batches:
            found = [read(c, e) for c, e in zip(batch["content"], batch["file_extension"])]
            yield batch[names].assign(text=[t for t, _ in found], _error=[e for _, e in found])

    return files.select(*names, "content").mapInPandas(
        run, T.StructType(kept + [T.StructField("text", T.StringType()), T.StructField("_error", T.StringType())]))
