"""Text of office documents, books and notebooks: archives of XML and JSON, read by the standard library."""

import io
import json
import re
import xml.etree.ElementTree as tree
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .readers import html_text

#: what a file may unpack to: an archive that claims more is refused
MOST = 512 << 20


def _local(tag):
    return re.sub(r"^\{.*\}", "", tag)


def _runs(node, text, line, breaks=()):
    """The text of ``text`` elements, a line for each ``line`` element around them."""
    out = []
    for block in (n for n in node.iter() if _local(n.tag) in line):
        parts = ["\n" if _local(n.tag) in breaks else (n.text or "") for n in block.iter() if _local(n.tag) in text or _local(n.tag) in breaks]
        if "".join(parts).strip():
            out.append("".join(parts).strip())
    return out


def _numbered(names, pattern):
    return sorted((n for n in names if re.search(pattern, n)), key=lambda n: [int(x) for x in re.findall(r"\d+", n)])


def _sheet(root, shared):
    rows = []
    for row in (n for n in root.iter() if _local(n.tag) == "row"):
        cells = []
        for c in (n for n in row if _local(n.tag) == "c"):
            value = "".join(n.text or "" for n in c.iter() if _local(n.tag) in ("v", "t"))
            cells.append(shared[int(value)] if c.get("t") == "s" and value.isdigit() and int(value) < len(shared) else value)
        if any(cells):
            rows.append("\t".join(cells))
    return rows


def document_text(content: bytes, kind: str) -> str:
    """Readable text of docx, pptx, xlsx, odt, epub, ipynb, html or plain bytes; '' for what can't be read.

    PDF pages, images and audio need programs outside and give ''.
    """
    if kind in ("pdf", "image", "audio"):
        return ""
    if kind == "html":
        return html_text(content.decode("utf-8", "replace"))
    if kind == "ipynb":
        return "\n\n".join(source for _, _, source in notebook_cells(content.decode("utf-8", "replace")))
    if kind not in ("docx", "pptx", "xlsx", "odt", "epub"):
        return content.decode("utf-8", "replace")
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if sum(i.file_size for i in z.infolist()) > MOST:
                return ""
            names, root = z.namelist(), lambda n: tree.fromstring(z.read(n))
            if kind == "docx":
                return "\n".join(_runs(root("word/document.xml"), {"t"}, {"p"}, {"br", "tab"}))
            if kind == "odt":
                return "\n".join("".join(n.itertext()).strip() for n in root("content.xml").iter() if _local(n.tag) in ("p", "h") and "".join(n.itertext()).strip())
            if kind == "pptx":
                return "\n\n".join("\n".join(_runs(root(n), {"t"}, {"p"})) for n in _numbered(names, r"^ppt/slides/slide\d+\.xml$"))
            if kind == "xlsx":
                shared = ["".join(t.text or "" for t in s.iter() if _local(t.tag) == "t") for s in root("xl/sharedStrings.xml") if _local(s.tag) == "si"] if "xl/sharedStrings.xml" in names else []
                return "\n\n".join("\n".join(_sheet(root(n), shared)) for n in _numbered(names, r"^xl/worksheets/sheet\d+\.xml$"))
            pages = [n for n in names if re.search(r"\.x?html?$", n)]
            spine = next((n for n in names if n.endswith(".opf")), None)
            if spine:
                book, base = root(spine), spine.rpartition("/")[0]
                files = {n.get("id"): f"{base}/{n.get('href')}".lstrip("/") for n in book.iter() if _local(n.tag) == "item"}
                ordered = [files.get(n.get("idref")) for n in book.iter() if _local(n.tag) == "itemref"]
                pages = [n for n in ordered if n in names] or pages
            return "\n\n".join(t for t in (html_text(z.read(n).decode("utf-8", "replace")) for n in pages) if t)
    except (zipfile.BadZipFile, KeyError, tree.ParseError, ValueError):
        return ""


def notebook_cells(text: str):
    """[(number, kind, source)] of a notebook's cells that aren't empty; [] for what is no notebook."""
    try:
        cells = json.loads(text)["cells"]
    except (ValueError, KeyError, TypeError):
        return []
    out = []
    for i, c in enumerate(cells if isinstance(cells, list) else []):
        source = c.get("source", "") if isinstance(c, dict) else ""
        source = "".join(source) if isinstance(source, list) else str(source)
        if source.strip():
            out.append((i, str(c.get("cell_type", "")), source))
    return out


def texts(files: DataFrame) -> DataFrame:
    """(path, format, text) of ``files(path, format, content)``, as ``readers.files`` gives them."""

    def run(batches):
        for batch in batches:
            paths, kinds, contents = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(kinds, pa.string()), pa.array([document_text(c or b"", k) for c, k in zip(contents, kinds)], pa.string())], names=["path", "format", "text"])

    return files.select("path", "format", "content").mapInArrow(run, "path string, format string, text string")


def extraction_route(kind, has_schema, n_tables, n_chars):
    """'structured' for a PDF with a schema that has tables or is but a picture (under 40 characters of text), else 'text'."""
    pick = (kind == "pdf") & has_schema & ((n_tables > 0) | (n_chars < 40))
    return F.when(pick, "structured").otherwise("text")
