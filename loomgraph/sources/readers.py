"""Sources: file formats, HTML, git logs, Markdown with front matter, RDF, JSON lines."""

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .store import arrow

# fixed values: extensions and what they hold
FORMATS = {
    "pdf": ("pdf",), "docx": ("docx",), "pptx": ("pptx",), "xlsx": ("xlsx",), "html": ("html", "htm"), "epub": ("epub",), "odt": ("odt",), "md": ("md", "markdown"),
    "json": ("json",), "xml": ("xml",), "yaml": ("yaml", "yml"), "csv": ("csv",), "log": ("log",), "txt": ("txt",),
    "ipynb": ("ipynb",), "image": ("png", "jpg", "jpeg", "gif", "webp"), "audio": ("mp3", "wav", "ogg", "m4a", "flac"),
}
#: first bytes, in hexadecimal
MAGIC = {"pdf": "25504446", "image": "89504E47", "zip": "504B0304"}


def file_format(name: Column, content: Column) -> Column:
    """Extension, else first bytes, else 'txt'."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for kind, exts in FORMATS.items():
        out = F.coalesce(out, F.when(ext.isin(*exts), kind))
    for kind, head in MAGIC.items():
        out = F.coalesce(out, F.when(F.hex(F.substring(content, 1, len(head) // 2)) == head, kind))
    return F.coalesce(out, F.lit("txt"))


def files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, name, length, sha256, format, content) of the files below a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select("path", name.alias("name"), "length", F.sha2("content", 256).alias("sha256"), file_format(name, F.col("content")).alias("format"), "content")


# fixed values: elements without readable text, and those whose text is kept
DROPPED = {"script", "style", "nav", "footer", "header", "aside", "iframe", "noscript"}
KEPT = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "pre", "code", "td", "th", "blockquote", "figcaption"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Page(HTMLParser):
    """Collects each kept element's text, nested ones also inside their parents, by root candidate."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.found, self.all = [], [], {"article": [], "main": [], "body": []}
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "br":
                self.handle_data("\n")
            return
        if tag == "p":  # a paragraph ends where the next begins
            self._close("p", limit={"article", "main", "body", "div", "li", "td", "blockquote"})
        roots = {t for t, *_ in self.stack}
        block = None
        if tag in KEPT and not self.hidden:
            block = {"tag": tag, "text": [], "in": {r for r in self.all if r in roots}}
            self.found.append(block)
        self.stack.append((tag, block))
        self.hidden += tag in DROPPED

    def _close(self, tag, limit=()):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                for t, _ in self.stack[k:]:
                    self.hidden -= t in DROPPED
                del self.stack[k:]
                return
            if self.stack[k][0] in limit:
                return

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        if self.hidden:
            return
        for _, block in self.stack:
            if block is not None:
                block["text"].append(data)
        open_roots = {t for t, _ in self.stack}
        for r, texts in self.all.items():
            if r in open_roots:
                texts.append(data)


def html_text(html: str) -> str:
    """Readable text of a page: kept elements of article, else main, else body, headings with #, joined by blank lines."""
    page = _Page()
    page.feed(html or "")
    page.close()
    root = next((r for r in ("article", "main", "body") if page.all[r]), None)
    out = []
    for b in page.found:
        text = " ".join("".join(b["text"]).split())
        if text and (root is None or root in b["in"]):
            out.append(f"{'#' * int(b['tag'][1])} {text}" if b["tag"][0] == "h" and b["tag"][1:].isdigit() else text)
    if out:
        return "\n\n".join(out)
    return " ".join("".join(page.all[root]).split()) if root else ""


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, text) of ``pages(page_id, html)``."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([html_text(h) for h in batch.column(1).to_pylist()], pa.string())], names=["page_id", "text"])

    return arrow(pages).select("page_id", "html").mapInArrow(run, "page_id long, text string")


def git_commits(lines: DataFrame) -> DataFrame:
    """(repo, sha, author, day, subject, files) of logs' ``lines(repo, pos, line)``: headers are hash|author|date|subject."""
    head = F.col("line").rlike(r"^[0-9a-f]{40}\|[^|]*\|[^|]*\|")
    grouped = lines.withColumn("head", head).withColumn("commit", F.sum(F.col("head").cast("int")).over(Window.partitionBy("repo").orderBy("pos")))
    part = F.split("line", r"\|", 4)
    one = F.max(F.when(F.col("head"), F.struct(part[0].alias("sha"), part[1].alias("author"), part[2].alias("day"), part[3].alias("subject"))))
    names = F.transform(F.sort_array(F.collect_list(F.when(~F.col("head") & (F.trim("line") != ""), F.struct("pos", "line")))), lambda x: x["line"])
    return grouped.where("commit > 0").groupBy("repo", "commit").agg(one.alias("h"), names.alias("files")).select("repo", "h.*", "files")


def front_matter(docs: DataFrame) -> DataFrame:
    """``docs(name, text)`` with their front matter's fields as a map, and the body; INDEX and MEMORY files are left out."""
    block = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---\n?", 1)
    pairs = F.transform(F.filter(F.split(block, "\n"), lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.btrim(F.regexp_replace(x, "^[^:]*:", ""), F.lit(" \"'"))))
    keep = ~F.upper(F.regexp_replace("name", r"\.[^.]*$", "")).isin("INDEX", "MEMORY")
    return docs.where(keep).select("name", F.map_from_entries(pairs).alias("meta"), F.regexp_replace("text", r"(?s)\A---\n.*?\n---\n?", "").alias("body"))


# fixed values: elements of an ontology that are terms
TERMS = ("Class", "ObjectProperty", "DatatypeProperty", "NamedIndividual")


def _terms(xml):
    import xml.etree.ElementTree as tree

    try:
        root = tree.fromstring(xml)
    except tree.ParseError:
        return
    for node in root.iter():
        kind = re.sub(r"^\{.*\}", "", node.tag)
        uri = next((v for k, v in node.attrib.items() if k.endswith(("}about", "}ID"))), None)
        if uri and kind in TERMS:
            parent = next((v for child in node if child.tag.endswith("}subClassOf") for k, v in child.attrib.items() if k.endswith("}resource")), None)
            label = next((child.text for child in node if child.tag.endswith("}label")), None)
            yield kind, uri, uri.rsplit("#", 1)[-1] if "#" in uri else uri.rsplit("/", 1)[-1], label, parent


def ontologies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, kind, uri, name, label, parent) of the terms of RDF/XML texts; broken ones have none."""

    def run(batches):
        for batch in batches:
            out = [(d, *row) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for row in _terms(t)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["doc", "kind", "uri", "name", "label", "parent"])

    return arrow(docs).select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, "doc string, kind string, uri string, name string, label string, parent string")


def ontology(spark: SparkSession, xml: str) -> DataFrame:
    """(kind, uri, name) of the classes and properties of one RDF/XML text."""
    return ontologies(spark.range(1).select(F.col("id").alias("doc_id"), F.lit(xml).alias("text"))).select("kind", "uri", "name")


def audit_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines log, once per id."""
    return spark.read.schema(schema).json(path).dropDuplicates(["id"])


def ingest(items: DataFrame) -> DataFrame:
    """(pos, sha256, id, already_exists) of ``items(pos, owner, content)``: the first of equal contents is new, ids are version-5 UUIDs of hash and owner."""
    from ..operators.chunk import uuid5

    rows = items.withColumn("sha256", F.sha2("content", 256))
    first = Window.partitionBy("sha256").orderBy("pos")
    return rows.select("pos", "sha256", uuid5(F.concat("sha256", "owner")).alias("id"), (F.row_number().over(first) > 1).alias("already_exists"))


def dataset_links(links: DataFrame, ingested: DataFrame) -> DataFrame:
    """``links(dataset_id, data_id)`` with those of ``ingested(id, dataset_id)``, files that were there already among them; each once."""
    return links.select("dataset_id", "data_id").union(ingested.where("dataset_id <> ''").select("dataset_id", F.col("id").alias("data_id"))).distinct()


def notes(docs: DataFrame, kind: str = "", since: str = "") -> DataFrame:
    """``front_matter`` of ``docs(name, text)``, those of a type and of a date from ``since`` on, if given."""
    out = front_matter(docs)
    out = out.where(F.col("meta")["type"] == kind) if kind else out
    return out.where(F.coalesce(F.col("meta")["date"], F.lit("")) >= since) if since else out


def search_commits(commits: DataFrame, needle: str, limit: int = 20) -> DataFrame:
    """Commits whose subject, author or files contain the needle, case aside, the latest first."""
    hit = F.contains(F.lower(F.concat_ws("\n", "subject", "author", "files")), F.lit(needle.lower()))
    return commits.where(hit).orderBy(F.desc("day"), "sha").limit(limit)


def busiest_files(commits: DataFrame, n: int = 10) -> DataFrame:
    """(file, commits, authors): the files that most commits touch."""
    each = commits.select("sha", "author", F.explode(F.array_distinct("files")).alias("file"))
    return each.groupBy("file").agg(F.count("*").alias("commits"), F.countDistinct("author").alias("authors")).orderBy(F.desc("commits"), "file").limit(n)
