"""Token-id files: a concatenated id array with Elias-Fano document boundaries.

A corpus is cut by ranges of doc_id into parts; part p is one file:

    TOKB | version, id width | n documents, n ids, bytes of boundaries, bytes of doc_ids
    Elias-Fano boundaries (each document's end, counted from the part's first id)
    Elias-Fano doc_ids (minus the part's least), least doc_id, number of null doc_ids
    ids, little-endian unsigned, of 16 bits where all of the part's fit in them, else of 32

so that a document is found by two selects, in about two bytes each and no 64-bit table.
Text is tokenised once per distinct piece of a slice.  Pieces end at ASCII white space and
where a letter and plain punctuation meet, A-Z folded: this tokenizer folds case itself and
its pre-tokens never span such a place, so a text's ids are its pieces' ids in a row.

Edge cases: null or empty texts give only the end id; documents with equal doc_id stand
next to each other, ordered by their text; null doc_ids come first; extra columns are
ignored; an empty table writes no part and gives no rows.
"""

import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._store import fresh_path, read_file, reading_tasks, stored, tune, write_file
from ._text import distinct_names, lower_ascii, span_hashes, text_slices, word_spans
from .eliasfano import EliasFano, encode

HEAD = "<4sHHQQQQ"
TAIL = "<qQ"
#: ids after which a task starts its next file
FILE_IDS = 1 << 25


def pieces(data, offs):
    """(hashes, second hashes, starts, ends, first_piece, folded data) of the pieces of each text.

    Not cut: before or after an apostrophe, which joins contractions, and < | >, which may
    belong to a special token.  A text slice with "<|" isn't folded, as special tokens aren't.
    """
    raw = data.tobytes()
    if b"<|" not in raw:
        data = lower_ascii(data)
    starts, ends, _ = word_spans(data, offs)
    kind = np.zeros(256, np.uint8)
    kind[65:91] = kind[97:123] = 1
    kind[[i for i in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)) if i not in b"'<>|"]] = 2
    here = kind[data]
    cut = np.flatnonzero(here[1:] * here[:-1] == 2) + 1
    cut = cut[~np.isin(cut, offs)]
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    one, two = span_hashes(np.ascontiguousarray(data), starts, ends)
    return one, two, starts, ends, np.searchsorted(starts, offs), data


class WordEncoder:
    """Ids of texts by way of their distinct pieces; at most ``keep`` of them are remembered.

    A piece is known by two unrelated 64-bit hashes.  A slice in which two pieces share the
    first one, with each other or with a remembered piece, is encoded text by text.
    """

    def __init__(self, path, keep=1_000_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.clear()

    def clear(self):
        self.hashes, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.lengths, self.starts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encoded(self, texts):
        """(ids in a row, number of each text's) by the library itself."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.array([len(x) for x in found], np.int64)
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def learn(self, hashes, checks, words):
        if len(self.hashes) + len(hashes) > self.keep:
            self.clear()
        ids, lengths = self.encoded(words)
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        self.ids = np.concatenate([self.ids, ids])
        at = np.searchsorted(self.hashes, hashes)  # both sorted: a merge
        self.hashes, self.checks = np.insert(self.hashes, at, hashes), np.insert(self.checks, at, checks)
        self.lengths, self.starts = np.insert(self.lengths, at, lengths), np.insert(self.starts, at, starts)

    def encode(self, data, offs, end_id=None):
        """(ids, boundaries): all texts' ids in a row, and each text's end among them."""
        plain = data
        hashes, checks, s, e, first, data = pieces(data, offs)
        distinct, second, where, which = distinct_names(hashes, checks)
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        if (self.checks[at[known]] != second[known]).any() or (distinct[1:] == distinct[:-1]).any():
            raw = plain.tobytes()
            ids, lengths = self.encoded([raw[a:b].decode("utf-8", "replace") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())])
            bounds = np.concatenate([[0], np.cumsum(lengths)])
        else:
            if not known.all():
                raw = data.tobytes()
                if len(self.hashes) + int((~known).sum()) > self.keep:
                    self.clear()
                    known[:] = False
                new = where[~known]
                self.learn(distinct[~known], second[~known], [raw[a:b].decode("utf-8", "replace") for a, b in zip(s[new].tolist(), e[new].tolist())])
                at = np.searchsorted(self.hashes, distinct)
            lengths, starts = self.lengths[at][which], self.starts[at][which]
            total = np.zeros(len(lengths) + 1, np.int64)
            np.cumsum(lengths, out=total[1:])
            take = np.repeat(starts - total[:-1], lengths) + np.arange(total[-1])
            ids, bounds = self.ids[take], total[first]
        if end_id is None:
            return ids, bounds[1:]
        return np.insert(ids, bounds[1:], end_id), bounds[1:] + np.arange(1, len(bounds))


def worker_encoder(path):
    """The Python worker's encoder: loaded once a worker, its pieces serve later tasks too."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_worker_encoders", {})
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def part_bytes(doc_ids, ids, ends):
    """One part's file as a list of chunks."""
    nulls = sum(d is None for d in doc_ids)
    numbers = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(numbers[0]) if len(numbers) else 0
    bounds, names = encode(ends), encode((numbers - least).astype(np.uint64))
    total, width = sum(len(x) for x in ids), 2 if max((int(x.max()) for x in ids if len(x)), default=0) < 1 << 16 else 4
    return [struct.pack(HEAD, b"TOKB", 1, width, len(doc_ids), total, len(bounds), len(names)), bounds, names, struct.pack(TAIL, least, nulls), *[x.astype(f"<u{width}").tobytes() for x in ids]]


class Part:
    """A part's file: ``len``, ``doc_id(i)``, ``span(i)`` and ``ids(i)``."""

    def __init__(self, data):
        magic, version, width, self.n, self.total, bounds, names = struct.unpack_from(HEAD, data)
        if (magic, version) != (b"TOKB", 1) or width not in (2, 4):
            raise ValueError("not a token-id part")
        self.bounds, self.names = EliasFano(data, struct.calcsize(HEAD)), EliasFano(data, struct.calcsize(HEAD) + bounds)
        self.least, self.nulls = struct.unpack_from(TAIL, data, struct.calcsize(HEAD) + bounds + names)
        self.array = np.frombuffer(data, f"<u{width}", self.total, struct.calcsize(HEAD) + bounds + names + struct.calcsize(TAIL))

    def __len__(self):
        return self.n

    def doc_id(self, i):
        return None if i < self.nulls else self.least + self.names[i - self.nulls]

    def span(self, i):
        return (self.bounds[i - 1] if i else 0), self.bounds[i]

    def ids(self, i):
        a, b = self.span(i)
        return self.array[a:b]


def _write(uri, path, end_id):
    def run(batches):
        from pyspark import TaskContext

        here = TaskContext.get()
        encoder, number = None, here.partitionId() << 20

        def close(doc_ids, ids, ends, total):
            size = write_file(f"{uri}/part-{number:014d}.tokb", str(here.taskAttemptId()), part_bytes(doc_ids, ids, np.concatenate(ends)))
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (number, len(doc_ids), total, size)], names=["part", "n_docs", "n_ids", "n_bytes"])

        doc_ids, ids, ends, total = [], [], [], 0
        for batch in batches:
            names = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for first, count, data, offs in text_slices(batch, "text"):
                encoder = encoder or worker_encoder(path)
                found, bounds = encoder.encode(data, offs, end_id)
                doc_ids += names[first : first + count]
                ids.append(found)
                ends.append(bounds + total)
                total += len(found)
                if total >= FILE_IDS:
                    yield close(doc_ids, ids, ends, total)
                    doc_ids, ids, ends, total, number = [], [], [], 0, number + 1
        if doc_ids:
            yield close(doc_ids, ids, ends, total)

    return run


def _read(uri):
    def run(batches):
        for batch in batches:
            for part, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p = Part(read_file(f"{uri}/part-{part:014d}.tokb"))
                ends, names = p.bounds.all(), p.names.all() + p.least
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                raw = memoryview(p.array.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None] * p.nulls + names.tolist(), pa.int64()), pa.array(begins + start), pa.array(ends - begins), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def write_token_ids(docs: DataFrame, uri: str, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write ``docs(doc_id, text)`` under ``uri``; (part, n_docs, n_ids, n_bytes, start) of the files written.

    Each range of doc_id is one task and one or more files; a file's ids, about ``FILE_IDS``
    of four bytes, are held in memory until its boundaries are known.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed = rows.repartitionByRange(max(int(parts), 1), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    made = stored(placed.mapInArrow(_write(uri, tokenizer, end_id), "part long, n_docs long, n_ids long, n_bytes long"), "token-parts")
    # a few numbers a file: a running total over the files
    return made.withColumn("start", F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def read_token_ids(parts: DataFrame, uri: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of ``write_token_ids``."""
    return parts.select("part", "start").repartition(reading_tasks(parts), "part").mapInArrow(_read(uri), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_id_corpus(docs: DataFrame, tokenizer: str, end_id: int = 1, uri: str | None = None) -> DataFrame:
    uri = uri or fresh_path(docs.sparkSession, "token-ids")
    return read_token_ids(write_token_ids(docs, uri, tokenizer, end_id), uri)


def op10_token_ids(spark, sf_dir):
    import public_tokenizers

    return token_id_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
