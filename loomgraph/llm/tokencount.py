"""Token counts by offset-mapped attribution.

A document is encoded once, whole.  Its tokens' character spans (a character belongs to each
token that holds a byte of it) are interval-joined, both sides sorted, to the spans of its
sections, and a token that crosses a boundary is allocated by a rule: ``start`` (the section
of its first character), ``majority`` (the section with most of its characters, the earlier
one on a tie) or ``split`` (each section its share of the characters).
Sections are a text's lines, each with its line feed, or several fields in a row.

White space of ``LONG_RUN`` characters and more is encoded beside the library's pattern, whose
matcher recurses over such runs: the pattern makes one piece of a run without its last
character, which begins the next piece, or of the whole run where the text ends.

Edge cases: a null or empty text has no tokens and no sections; a null field is an empty
section, which gets no token; equal or null doc_ids give a row each; extra columns are
ignored; an empty table gives no rows.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._store import tune
from ._text import text_slices


def load_ranks(path):
    """Mergeable ranks of a tiktoken vocabulary file."""
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def worker_encoding(path, pattern):
    """The Python worker's (encoding, byte length of each id), loaded once a worker."""
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_worker_encodings", {})
    if path not in kept:
        ranks = load_ranks(path)
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            lengths[i] = len(token)
        kept[path] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return kept[path]


LONG_RUN = 4096
#: Unicode's White_Space, which the pattern's \\s means
_RUN = re.compile("[\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


def encoded(encoding, text):
    """``encoding.encode_ordinary(text)``, for texts with white space of any length."""
    out, at = [], 0
    for run in _RUN.finditer(text):
        begin, end = run.span()
        if end < len(text):
            end -= 1  # the last one may begin the next word's piece
        out += encoding.encode_ordinary(text[at:begin])
        out += encoding._core_bpe.encode_single_piece(text[begin:end].encode())
        at = end
    return out + encoding.encode_ordinary(text[at:]) if at else encoding.encode_ordinary(text)


def attribute(begins, ends, bounds, rule="majority"):
    """(tokens per section, crossing tokens) of tokens over [begin, end) and sections between ``bounds``.

    Both are sorted.  Sections tile the text and may be empty; a token is never empty.
    """
    sections = len(bounds) - 1
    first = np.searchsorted(bounds, begins, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    crossing = np.flatnonzero(first != last)
    if rule == "start" or not len(crossing):
        return np.bincount(first, minlength=sections).astype(np.float64), len(crossing)
    inside = np.ones(len(ends), bool)
    inside[crossing] = False
    counts = np.bincount(first[inside], minlength=sections).astype(np.float64)
    for k in crossing.tolist():
        s = np.arange(first[k], last[k] + 1)
        share = np.minimum(bounds[s + 1], ends[k]) - np.maximum(bounds[s], begins[k])
        if rule == "split":
            counts[s] += share / share.sum()
        elif rule == "majority":
            counts[s[share.argmax()]] += 1
        else:
            raise ValueError(f"no such rule: {rule}")
    return counts, len(crossing)


def _count(path, pattern, rule, fields):
    def run(batches):
        for batch in batches:
            encoding, lengths = worker_encoding(path, pattern)
            ids = batch.column(0)
            for first, count, data, offs in text_slices(batch, "text"):
                raw = data.tobytes()
                # characters before each byte: a byte that continues one adds none
                letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                feeds = np.flatnonzero(data == 10) + 1
                sizes = batch.column(2).slice(first, count).to_pylist() if fields else None
                rows = []
                for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                    if fields:
                        bounds = np.concatenate([[0], np.cumsum(sizes[i])]).astype(np.int64)
                    elif a == b:
                        bounds = np.zeros(1, np.int64)
                    else:
                        inner = letters[feeds[np.searchsorted(feeds, a, side="right") : np.searchsorted(feeds, b)]] - letters[a]
                        bounds = np.concatenate([[0], inner, [letters[b] - letters[a]]])
                    tokens = encoded(encoding, raw[a:b].decode("utf-8", "replace")) if b > a else []
                    if tokens:
                        ends = a + np.cumsum(lengths[tokens])
                        # the character of a token's first byte, and the one after that of its last
                        begins = letters[np.concatenate([[a], ends[:-1]]) + 1] - letters[a] - 1
                        counts, crossing = attribute(begins, letters[ends] - letters[a], bounds, rule)
                    else:
                        counts, crossing = np.zeros(len(bounds) - 1), 0
                    rows.append((len(tokens), len(counts), crossing, counts))
                at = np.cumsum([0] + [r[1] for r in rows]).astype(np.int32)
                flat = np.concatenate([r[3] for r in rows])
                values = pa.array(flat) if rule == "split" else pa.array(flat.astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, count).cast(pa.int64())] + [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)] + [pa.ListArray.from_arrays(at, values)],
                    names=["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"],
                )

    return run


def token_counts(docs: DataFrame, path: str, pattern: str, rule: str = "majority", fields=None) -> DataFrame:
    """(doc_id, n_tokens, n_sections, n_crossing, section_tokens) of each row.

    ``fields`` names columns that, in a row, make the document and are its sections;
    without it the sections are the lines of ``text``.
    """
    tune(docs.sparkSession)
    if fields:
        parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(*parts).alias("text"), F.array(*[F.length(p).cast("long") for p in parts]).alias("sizes"))
    else:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "double" if rule == "split" else "long"
    return rows.mapInArrow(_count(path, pattern, rule, bool(fields)), f"doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<{kind}>")


def op5_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
