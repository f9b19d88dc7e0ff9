"""Chunkers.  Plain functions of a text, applied batch-wise over Arrow; counts are in
characters or bytes as each docstring says."""

import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.store import arrow

OID = "6ba7b8129dad11d180b400c04fd430c8"
HEADING = r"^(?:глава|chapter)\s+\d+"
CODE_START = r"^(?:func |def |class |type |async def |function |export |public |private |impl |fn )"


def uuid5(name: Column, space: str = OID) -> Column:
    """RFC 4122 version-5 id of a name, from SHA-1 alone."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12)]
    return F.concat_ws("-", *parts)


def paragraphs(text):
    return [p.strip() for p in text.replace("\r\n", "\n").split("\n\n") if p.strip()]


def merged_paragraphs(text, least=80, most=2000):
    """[(text, chapter)]: paragraphs joined while under ``most`` characters; a buffer below ``least`` is dropped.

    A chunk carries the chapter that is current when it is flushed.
    """
    out, held, chapter = [], "", 0
    for p in paragraphs(text):
        if re.match(HEADING, p, re.IGNORECASE):
            chapter += 1
        if held and len(held) + len(p) >= most:
            if len(held) >= least:
                out.append((held, chapter))
            held = ""
        held = f"{held}\n\n{p}" if held else p
    if len(held) >= least:
        out.append((held, chapter))
    return out


def sentences(text):
    return [s for s in re.split(r"(?<=[.!?])[ \t\n\f\r]+", text.strip(" \t\n\f\r")) if s]


def merged_sentences(text, least=30, most=256):
    """Sentences joined by spaces while under ``most`` bytes; one of less than ``least`` bytes at the end joins the chunk before."""
    out, held = [], ""
    for s in sentences(text):
        if held and len(held.encode()) + 1 + len(s.encode()) > most:
            out.append(held)
            held = s
        else:
            held = f"{held} {s}" if held else s
    if held:
        if out and len(held.encode()) < least:
            out[-1] += " " + held
        else:
            out.append(held)
    return out


def sliding(text, window=1000, overlap=200, least=80):
    """Windows of characters that end at a sentence within a fifth of the window, else a space, else where they must."""
    overlap = min(max(overlap, 0), window // 2)
    out, at = [], 0
    while at < len(text):
        stop = min(len(text), at + window)
        if stop < len(text):
            slack = window // 5
            low, high = max(at + 1, stop - slack), min(len(text), stop + slack)
            ends = [m.end() for m in re.finditer(r"[.!?](?=\s)", text[low:high])]
            if ends:
                stop = low + min(ends, key=lambda e: (abs(low + e - stop), e))
            elif (space := text.rfind(" ", low, stop)) > at:
                stop = space
        piece = text[at:stop].strip()
        if len(piece) < least and out:
            break
        if piece:
            out.append(piece)
        if stop >= len(text):
            break
        at = max(stop - overlap, at + 1)
    return out


def rows(text, size=20):
    """The first line before each ``size`` lines that follow; batches that only repeat it are left out."""
    lines = [x for x in text.replace("\r\n", "\n").split("\n") if x.strip()]
    if not lines:
        return []
    head, rest = lines[0], lines[1:]
    if not rest:
        return [head]
    groups = ["\n".join(rest[i : i + size]) for i in range(0, len(rest), size)]
    return [f"{head}\n{g}" for g in groups if g != head]


def code(text, most=2000, least=10):
    """Top-level definitions; what stands before the first is prepended to it; long ones are split by lines."""
    blocks, held = [], []
    for line in text.split("\n"):
        if re.match(CODE_START, line) and any(x.strip() for x in held) and any(re.match(CODE_START, x) for x in held):
            blocks.append("\n".join(held))
            held = []
        held.append(line)
    blocks.append("\n".join(held))
    out = []
    for b in blocks:
        while len(b) > most:
            cut = b.rfind("\n", 1, most)
            cut = cut if cut > 0 else most
            out.append(b[:cut])
            b = b[cut:].lstrip("\n")
        out.append(b)
    return [x for x in out if len(x.strip()) >= least]


def parent_child(text):
    """[(parent index, parent text, [(child index, text)])], child numbers running through the document."""
    out, n = [], 0
    for i, (p, _) in enumerate(merged_paragraphs(text)):
        kids = [(n + k, s) for k, s in enumerate(merged_sentences(p))]
        n += len(kids)
        out.append((i, p, kids))
    return out


def sections(text):
    """[(character offset, title)]: Markdown headings of levels 1-4, chapters, and title-case lines before a blank one."""
    out, at = [], 0
    lines = text.split("\n")
    for i, line in enumerate(lines):
        s = line.strip()
        blank_after = i + 1 < len(lines) and not lines[i + 1].strip()
        if m := re.match(r"#{1,4}\s+(.+)$", s):
            out.append((at, m[1].strip()))
        elif re.match(HEADING, s, re.IGNORECASE):
            out.append((at, s))
        elif blank_after and 3 <= len(s.encode()) <= 80 and s[:1].isupper() and s[-1:] not in ".!?,;:":
            odd = sum(not (c.isalpha() or c == " ") for c in s)
            words = [w for w in s.split() if len(w) > 3]
            if odd <= 0.2 * len(s) and all(w[0].isupper() for w in words):
                out.append((at, s))
        at += len(line) + 1
    return out


def section_at(found, offset):
    """The last section that begins at or before ``offset``, or ''."""
    title = ""
    for at, name in found:
        if at > offset:
            break
        title = name
    return title


def heading_paths(markdown):
    """[(offset, [titles from the top])] of Markdown headings."""
    stack, out, at = [], [], 0
    for line in markdown.split("\n"):
        if m := re.match(r"(#{1,6})\s+(.+)$", line):
            level = len(m[1])
            stack = [x for x in stack if x[0] < level] + [(level, m[2].strip())]
            out.append((at, [t for _, t in stack]))
        at += len(line) + 1
    return out


STRATEGIES = {
    "merged": lambda t: [x for x, _ in merged_paragraphs(t)],
    "sentence": merged_sentences,
    "sliding": sliding,
    "row": rows,
    "code": code,
}


def chunks(docs: DataFrame, strategy: str = "sentence", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_index, chunk_id, text): ids are version-5 UUIDs of '<doc>-<index>'.  Null texts have no chunk."""
    cut = STRATEGIES[strategy]

    def run(batches):
        for batch in batches:
            out = [(d, i, str(uuid.uuid5(uuid.NAMESPACE_OID, f"{d}-{i}")), c) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for i, c in enumerate(cut(t))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["doc", "chunk_index", "chunk_id", "text"])

    return arrow(docs).select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, "doc string, chunk_index long, chunk_id string, text string")


def simple_paragraphs(docs: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each paragraph of ``least`` characters or more, numbered densely; built-in functions only."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(F.col(text_col), "\r\n", "\n"), "\n\n"), lambda p: F.btrim(p, F.lit(" \t\n\r"))), lambda p: F.char_length(p) >= least)
    return docs.select(id_col, F.posexplode(parts).alias("chunk_index", "text"))


def fixed_windows(docs: DataFrame, window: int, step: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Windows of characters at fixed steps; built-in functions only."""
    starts = F.expr(f"sequence(0, greatest(char_length(`{text_col}`) - 1, 0), {step})")
    return docs.where(F.char_length(text_col) > 0).select(id_col, text_col, F.posexplode(starts).alias("chunk_index", "at")).select(
        id_col, "chunk_index", F.expr(f"substring(`{text_col}`, at + 1, {window})").alias("text")
    )


def row_groups(docs: DataFrame, size: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ``row`` strategy in built-in functions: header, then groups of lines."""
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda x: F.trim(x) != "")
    d = docs.select(id_col, lines.alias("l")).where(F.size("l") > 1).select(id_col, F.col("l")[0].alias("head"), F.slice("l", F.lit(2), F.size("l") - 1).alias("l"))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / size).cast("int")), lambda g: F.array_join(F.slice(F.col("l"), g * size + 1, size), "\n"))
    return d.select(id_col, "head", F.posexplode(groups).alias("chunk_index", "body")).where("body <> head").select(id_col, "chunk_index", F.concat_ws("\n", "head", "body").alias("text"))


def linked(chunks, document: str, order: str):
    """``chunks`` with the ids before and after each in its document, prev_id and next_id."""
    from pyspark.sql import Window

    w = Window.partitionBy(document).orderBy(order)
    return chunks.withColumns({"prev_id": F.lag("id").over(w), "next_id": F.lead("id").over(w)})


def _table(docs, id_col, text_col, each, schema, kinds):
    """Rows ``each(text)`` of every text, a batch at a time, after its id."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            out = [(d, *row) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for row in each(d, t)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), *kinds))], names=names)

    return arrow(docs).select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def parent_children(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, parent_index, parent_id, chunk_index, chunk_id, text): sentence chunks below merged paragraphs, numbered through the document."""

    def each(d, t):
        for i, _, kids in parent_child(t):
            parent = str(uuid.uuid5(uuid.NAMESPACE_OID, f"{d}-{i}"))
            for n, c in kids:
                yield i, parent, n, str(uuid.uuid5(uuid.NAMESPACE_OID, f"{parent}-child-{n}")), c

    schema = "doc string, parent_index long, parent_id string, chunk_index long, chunk_id string, text string"
    return _table(docs, id_col, text_col, each, schema, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()))


def document_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, at, title) of every section, ``at`` in characters."""
    return _table(docs, id_col, text_col, lambda d, t: sections(t), "doc string, at long, title string", (pa.int64(), pa.string()))


def headings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, at, path) of every Markdown heading, its titles from the top."""
    return _table(docs, id_col, text_col, lambda d, t: heading_paths(t), "doc string, at long, path array<string>", (pa.int64(), pa.list_(pa.string())))
