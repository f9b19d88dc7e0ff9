"""WARC archives compressed record by record against an embedded Zstandard dictionary.

An archive is a skippable frame (magic 0x184D2A5D) holding a dictionary built from records of
the whole archive, then one Zstandard frame per record, a warcinfo record first; any record
can be read alone.  Of records with equal payloads of at least ``least`` bytes, that with the
largest page_id is a response and the others are revisit records naming it, whose HTTP headers
still tell the payload's length; shorter payloads are always responses.  A record's id is made
of its page_id and its payload's digest.

Edge cases: null html is the empty payload; null url is the empty target; a null page_id
sorts below all numbers, and its record's id has none; rows that share page_id and payload
share a record id, and if that page_id is the largest, are all responses; extra columns are
ignored; an empty table writes no archive and gives no rows.
"""

import base64
import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._store import fresh_path, read_file, reading_tasks, stored, tune, write_file

MAGIC = 0x184D2A5D
#: bytes of records from which an archive's dictionary is built, bytes of records of an archive (held in memory), bytes of a dictionary
SAMPLE_BYTES, ARCHIVE_BYTES, DICTIONARY_BYTES = 4 << 20, 32 << 20, 64 << 10
#: the tables have no time of capture
DATE = "1970-01-01T00:00:00Z"


def record_id(page_id, digest):
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def page_of(name):
    """The page_id in a record's id, or None."""
    found = name.removeprefix("<urn:page:").partition(":")[0]
    return int(found) if found else None


def _framed(lines, block):
    return "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(name, date=DATE):
    """The warcinfo record of an archive."""
    return _framed(["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:archive:{name}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n")


def record(page_id, url, payload, digest, refers_to, date=DATE):
    """One WARC/1.1 record's bytes; a revisit has no payload, but the HTTP headers that tell its length."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}"]
    lines += ["WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Date: {date}"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return _framed([*lines, "Content-Type: application/http; msgtype=response"], http + (payload if refers_to is None else b""))


def parse(data):
    """(headers, HTTP headers, payload) of a record's bytes; checks its lengths."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record of the wrong length")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http.decode(), payload


def dictionary(records, size=DICTIONARY_BYTES):
    """A Zstandard dictionary from records; raw content where there is too little to train on."""
    import zstandard

    samples = [r[i : i + 16384] for r in records for i in range(0, len(r), 16384)]
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_chunks(records, level=6):
    """An archive's bytes, as chunks, of a list of records: the dictionary learns from records spread over all of it."""
    import zstandard

    step = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    made = dictionary(records[::step])
    raw = made.as_bytes()
    yield struct.pack("<II", MAGIC, len(raw)) + raw
    press = zstandard.ZstdCompressor(level=level, dict_data=made)
    for r in records:
        yield press.compress(r)


def read_archive(data):
    """Each record's bytes."""
    import zstandard

    magic, size = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("no dictionary frame leads the archive")
    raw = data[8 : 8 + size]
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    view, at = memoryview(data), 8 + size
    while at < len(data):
        one = unpress.decompressobj()
        parts, step = [], 1 << 16
        while not one.eof:
            piece = view[at : at + step]
            parts.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(parts)


def _write(uri, date):
    def run(batches):
        from pyspark import TaskContext

        here = TaskContext.get()
        number, held, total = here.partitionId() << 20, [], 0

        def close():
            name = f"pages-{number:014d}.warc.zst"
            size = write_file(f"{uri}/{name}", str(here.taskAttemptId()), archive_chunks([info(name, date), *held]))
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (number, len(held), size)], names=["archive", "n_records", "n_bytes"])

        for batch in batches:
            for page_id, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(record(page_id, url, html.encode(), digest, refers, date))
                total += len(held[-1])
                if total >= ARCHIVE_BYTES:
                    yield close()
                    number, held, total = number + 1, [], 0
        if held:
            yield close()

    return run


def _read(uri):
    def row(raw):
        headers, http, payload = parse(raw)
        kind = headers["WARC-Type"]
        if kind == "warcinfo":
            return None
        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        told = next(int(x.split(": ")[1]) for x in http.split("\r\n") if x.startswith("Content-Length: "))
        if kind == "response" and (len(payload) != told or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError("a payload that doesn't have its length or digest")
        refers = headers.get("WARC-Refers-To")
        return page_of(headers["WARC-Record-ID"]), told, digest, kind, None if refers is None else page_of(refers), headers["WARC-Target-URI"]

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]

    def run(batches):
        for batch in batches:
            for number in batch.column(0).to_pylist():
                rows = []
                for raw in read_archive(read_file(f"{uri}/pages-{number:014d}.warc.zst")):
                    rows += filter(None, [row(raw)])
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def write_warc(pages: DataFrame, uri: str, least: int = 1000, date: str = DATE) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives under ``uri``; (archive, n_records, n_bytes) of each.

    Payloads that repeat are found from digests alone: a grouped maximum, written, then a left
    join whose hot digests Spark may split, since both sides are plain reads.
    """
    tune(pages.sparkSession)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    digests = rows.where(F.octet_length("html") >= least).select("digest", "page_id")
    repeated = stored(digests.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("again"), "last"), "warc-repeated")
    told = rows.join(repeated, F.col("digest") == F.col("again"), "left").withColumn("refers", F.expr("if(last is null or page_id <=> last, null, last)"))
    return stored(told.select("page_id", "url", "html", "digest", "refers").mapInArrow(_write(uri, date), "archive long, n_records long, n_bytes long"), "warc-archives")


def read_warc(archives: DataFrame, uri: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri) of every record."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"
    return archives.select("archive").repartition(reading_tasks(archives), "archive").mapInArrow(_read(uri), schema)


def op7_warc(spark, sf_dir):
    uri = fresh_path(spark, "warc")
    return read_warc(write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), uri), uri).drop("target_uri")


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to FROM q
"""
