"""Dates in text, and ranges from them."""

import datetime as dt
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.store import arrow

# fixed values: month names as they begin in running text
MONTHS = {
    1: ("янв", "jan"), 2: ("фев", "feb"), 3: ("мар", "mar"), 4: ("апр", "apr"), 5: ("мая", "май", "may"), 6: ("июн", "jun"),
    7: ("июл", "jul"), 8: ("авг", "aug"), 9: ("сен", "sep"), 10: ("окт", "oct"), 11: ("ноя", "nov"), 12: ("дек", "dec"),
}
ISO = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"


def _date(y, m, d):
    """Overflowing months and days roll over, as 31 February to 3 March."""
    y, m = y + (m - 1) // 12, (m - 1) % 12 + 1
    try:
        return dt.date(y, m, 1) + dt.timedelta(days=d - 1)
    except (ValueError, OverflowError):
        return None


def dates(text, reference):
    """[(date, matched text, confidence)] by date: ISO 1.0, month names .9, slashed or dotted .8, bare years .7.

    A missing day is 1, a missing year the reference's; a number over 31 beside a month is a year.
    """
    found = {}

    def add(raw, day, confidence):
        if day is not None and found.get(raw, (None, 0))[1] < confidence:
            found[raw] = (day, confidence)

    for m in re.finditer(r"(\d{4})-(\d{2})-(\d{2})", text, re.ASCII):
        add(m[0], _date(int(m[1]), int(m[2]), int(m[3])), 1.0)
    low = text.lower()
    names = "|".join(n for v in MONTHS.values() for n in v)
    of = {n: k for k, v in MONTHS.items() for n in v}
    for m in re.finditer(rf"(?:(\d{{1,4}})\s+)?({names})[a-zа-яё]*\.?(?:\s+(\d{{1,4}}))?(?:,?\s+(\d{{4}}))?", low, re.ASCII):
        numbers = [int(x) for x in (m[1], m[3], m[4]) if x]
        if not numbers:
            continue
        day = next((n for n in numbers if 1 <= n <= 31), 1)
        year = next((n for n in numbers if n > 31), reference.year)
        add(m[0].strip(), _date(year, of[m[2]], day), 0.9)
    for m in re.finditer(r"(\d{1,2})[./](\d{1,2})[./](\d{4})", text, re.ASCII):
        add(m[0], _date(int(m[3]), int(m[2]), int(m[1])), 0.8)
    for m in re.finditer(r"(\d{4})[./](\d{1,2})[./](\d{1,2})", text, re.ASCII):
        add(m[0], _date(int(m[1]), int(m[2]), int(m[3])), 0.8)
    for m in re.finditer(r"(?:^|[\s(,])(1\d{3}|20\d{2}|2100)(?:$|[\s),.])", text, re.ASCII):
        add(m[1], _date(int(m[1]), 1, 1), 0.7)
    return sorted(((d, raw, c) for raw, (d, c) in found.items()), key=lambda x: (x[0], x[1]))


def date_range(days):
    """(from, to) of dates; one 1 January alone means its whole year."""
    if not days:
        return None
    a, b = min(days), max(days)
    if a == b and (a.month, a.day) == (1, 1):
        b = dt.date(a.year, 12, 31)
    return a, b


def extract_dates(docs: DataFrame, reference: dt.date, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, day, raw, confidence) of every date in every text."""

    def run(batches):
        for batch in batches:
            out = [(i, d, raw, c) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for d, raw, c in dates(t, reference)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.date32(), pa.string(), pa.float64()))], names=["doc", "day", "raw", "confidence"])

    return arrow(docs).select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, "doc string, day date, raw string, confidence double")


def iso_dates(text: Column) -> Column:
    """The distinct ISO dates of a text that are dates; built-in functions only."""
    return F.filter(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(ISO), F.lit(0))), lambda x: F.try_to_date(x, "yyyy-MM-dd")), lambda x: x.isNotNull())


def snippet(text: Column, needle: Column, around: int = 80) -> Column:
    """Up to ``around`` characters on both sides of the first occurrence; '' where there is none."""
    at = F.position(needle, text)
    begin = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(text, begin, at + F.char_length(needle) + around - begin)).otherwise(F.lit(""))


def link_events(dates: DataFrame, entities: DataFrame):
    """(nodes, edges) of dates(doc, day, raw) and entities(doc, entity) of the same texts.

    A day is one node, temporal_<day>, named after its first raw text; each entity of a text
    HAPPENED_AT each of its dates.
    """
    name = F.concat(F.lit("temporal_"), F.date_format("day", "yyyy-MM-dd"))
    nodes = dates.groupBy(name.alias("id")).agg(F.min_by("raw", F.struct("doc", "raw")).alias("name"), F.lit("TemporalEvent").alias("type"))
    edges = dates.select("doc", name.alias("target"), "raw").join(entities, "doc")
    return nodes, edges.select(F.col("entity").alias("source"), F.lit("HAPPENED_AT").alias("relation"), "target", F.concat_ws(" happened at ", "entity", "raw").alias("edge_text"))


def date_ranges(days: DataFrame, by: str, day: str) -> DataFrame:
    """(by, begin, end) of dates; one 1 January alone means its whole year."""
    each = days.groupBy(by).agg(F.min(day).alias("begin"), F.max(day).alias("end"))
    year = (F.col("begin") == F.col("end")) & (F.month("begin") == 1) & (F.dayofmonth("begin") == 1)
    return each.withColumn("end", F.when(year, F.make_date(F.year("begin"), F.lit(12), F.lit(31))).otherwise(F.col("end")))
