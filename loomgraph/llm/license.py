"""License scans: ordered signature rules behind a keyword prefilter, overlaps resolved by priority.

A text is reduced to its lower-case words.  One pass of an Aho-Corasick automaton over them finds
the phrases that rules hang on; only rules with a phrase in the text run their pattern, over the
whole text, and a match counts if it contains one of its rule's phrases.  A detection inside the interval of another one of higher priority, or of equal
priority and greater length, is suppressed ("general public license" inside a notice of the lesser
one); of equal intervals and priorities the earlier rule stays.  The base phrases are counted at
every place, and their labels stay whatever is suppressed.

The score is the weight of the strongest detection: 1 for clauses and tags, 0.9 for notices
and base phrases, 0.6 for names, 0.3 for hints, 0 without any.

Edge cases: a null or empty text has no words and no labels (the empty string); a null doc_id and
repeated rows are scanned as they are; words of non-ASCII letters count as words; extra columns
are ignored; an empty table gives an empty result.
"""

from bisect import bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import license_rules as known
from ._store import tune
from ._text import text_slices


def word_table():
    """Byte to byte: A-Z lower-cased, what no word contains to a space."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[:48] = table[58:65] = table[91:97] = table[123:128] = 32
    return table


def normalised(data, offs):
    """(bytes, offsets, words): each text's words with a space before each, and their number."""
    flat = word_table()[data]
    gap = flat == 32
    edge = np.zeros(len(flat) + 1, bool)
    edge[offs] = True
    before = np.ones(len(flat), bool)
    before[1:] = gap[:-1]
    starts = ~gap & (before | edge[:-1])
    # a word's bytes with a space before the first: words never cross texts
    sizes = (~gap).astype(np.int64) + starts
    out = np.full(int(sizes.sum()), 32, np.uint8)
    ends = np.cumsum(sizes)
    out[ends[~gap] - 1] = flat[~gap]
    bounds = np.concatenate([[0], ends])[offs]
    return out, bounds, np.diff(np.concatenate([[0], np.cumsum(starts)])[offs])


@cache
def scanner():
    """(automaton of all phrases, rules of each phrase, rules)."""
    import ahocorasick

    table = known.rules()
    by = {phrase: [] for phrase in known.BASE.values()}
    for number, rule in enumerate(table):
        for gate in rule.gates:
            by.setdefault(gate, []).append(number)
    automaton = ahocorasick.Automaton()
    for phrase in by:
        automaton.add_word(f" {phrase} ", phrase)
    automaton.make_automaton()
    return automaton, by, table


def base_places(text: str, phrases) -> list:
    """(character, label) of every place of the ``phrases`` in a spaced text."""
    out = []
    for label, phrase in known.BASE.items():
        if phrase in phrases:
            at = text.find(f" {phrase} ")
            while at >= 0:
                out.append((at + 1, label))
                at = text.find(f" {phrase} ", at + 1)
    return out


def unsuppressed(found: list) -> list:
    """Of (start, end, rule number, priority) those that no stronger one contains."""
    out, stronger = [], []
    for priority in sorted({f[3] for f in found}, reverse=True):
        own = sorted((f for f in found if f[3] == priority), key=lambda f: (f[0], -f[1], f[2]))
        starts = [s for s, _ in stronger]
        reach, furthest = -1, []
        for _, end in stronger:
            reach = max(reach, end)
            furthest.append(reach)
        reach = -1
        for f in own:
            i = bisect_right(starts, f[0])
            if f[1] > reach and not (i and furthest[i - 1] >= f[1]):  # an earlier or longer one of this priority; a higher one
                out.append(f)
            reach = max(reach, f[1])
        stronger = sorted(stronger + [f[:2] for f in own])
    return sorted(out)


def detections(text: str):
    """(base places, detections) of a spaced text, both with character positions."""
    automaton, by, table = scanner()
    phrases = {phrase for _, phrase in automaton.iter(text)}
    if not phrases:
        return [], []
    found = []
    for number in sorted({n for p in phrases for n in by[p]}):
        rule = table[number]
        found += [(*m.span(m.lastindex or 0), number, rule.priority) for m in rule.pattern.finditer(text) if any(f" {gate} " in f" {m[0]} " for gate in rule.gates)]
    return base_places(text, phrases), unsuppressed(found)


class Places:
    """Word numbers of characters of a spaced text."""

    def __init__(self, text):
        self.spaces = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 32) if text.isascii() else np.array([i for i, c in enumerate(text) if c == " "])

    def __call__(self, character):
        return int(np.searchsorted(self.spaces, character)) - 1


def texts(batch):
    """(row, spaced text, words) of each text of a batch."""
    for first, count, data, offs in text_slices(batch, "text"):
        flat, bounds, words = normalised(data, offs)
        raw = flat.tobytes()
        for i in range(count):
            yield first + i, raw[bounds[i] : bounds[i + 1]].decode() + " ", int(words[i])


def _scan(batches):
    table = scanner()[2]
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        rows = []
        for _, text, n_words in texts(batch):
            base, found = detections(text)
            place = Places(text) if base or found else None
            starts = [place(at) for at, _ in base]
            own = sorted({label for _, label in base})
            weight = max([0.9] * bool(base) + [table[f[2]].weight for f in found], default=0.0)
            rows.append((n_words, len(base), min(starts, default=None), max(starts, default=None), ",".join(own), ",".join(sorted({*own, *(table[f[2]].label for f in found)})), weight, len(found)))
        cols = list(zip(*rows)) if rows else [[]] * 8
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", *(c.split()[0] for c in COLUMNS)])


COLUMNS = ["n_words long", "n_base long", "first_word long", "last_word long", "base_labels string", "labels string", "score double", "n_detections long"]


def license_labels(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections) of every row of ``docs(doc_id, text)``."""
    tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scan, "doc_id long, " + ", ".join(COLUMNS))


def _spans(batches):
    table = scanner()[2]
    for batch in batches:
        ids, out = batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), []
        for row, text, _ in texts(batch):
            found = detections(text)[1]
            if found:
                place = Places(text)
                out += [(ids[row], table[n].label, table[n].kind, p, place(a), place(b - 1), text[a:b]) for a, b, n, p in found]
        cols = list(zip(*out)) if out else [[]] * 7
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "label", "kind", "priority", "first_word", "last_word", "words"])


def license_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, label, kind, priority, first_word, last_word, words): the detections that stay, one a row."""
    tune(docs.sparkSession)
    rows = docs.select(docs.doc_id.cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_spans, "doc_id long, label string, kind string, priority int, first_word long, last_word long, words string")


def op13_license(spark, sf_dir):
    return license_labels(spark.read.parquet(f"{sf_dir}/documents.parquet"))
