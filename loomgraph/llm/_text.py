"""Whole-batch text kernels on Arrow string buffers (NumPy, no per-word Python).

Everything works on the UTF-8 bytes.  The word separators (space and 0x09-0x0D)
and the letters folded by ``lower`` (A-Z) are ASCII, so byte-level scanning is exact.  A word is named by two unrelated 64-bit hashes
where its identity counts across texts (counts, ids), by one inside a text's shingle set.
"""

import hashlib

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def text_slices(batch, column, max_bytes=500_000):
    """Yield (first_row, n_rows, data, offsets) pieces of a batch's string column.

    Null is the empty text.  A piece holds whole texts and at most ``max_bytes``
    bytes, or one longer text.
    """
    arr = batch.column(batch.schema.get_field_index(column))
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    if n == 0:
        return
    _, off_buf, data_buf = arr.buffers()
    offs = np.frombuffer(off_buf, np.int64, count=arr.offset + n + 1)[arr.offset :]
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offs, offs[row] + max_bytes, side="right")) - 1
        stop = min(n, max(stop, row + 1))
        yield row, stop - row, data[offs[row] : offs[stop]], offs[row : stop + 1] - offs[row]
        row = stop


def mix64(x):
    """Finalise 64-bit values so that every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base, n):
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def lower_ascii(data):
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def word_spans(data, offs):
    """(starts, ends, first_word): word byte spans, and each text's first word number."""
    n = len(data)
    white = np.zeros(256, bool)
    white[[9, 10, 11, 12, 13, 32]] = True
    gap = np.ones(n + 1, bool)
    gap[:n] = white[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    left = np.ones(n, bool)
    left[1:] = gap[: n - 1]
    starts = np.flatnonzero(~gap[:n] & (left | edge[:n]))
    ends = np.flatnonzero(~gap[:n] & (gap[1:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def prefix_hash(data):
    """Running polynomial sums S with S[j]-S[i] = BASE**i * hash(data[i:j]) modulo 2**64.

    For bucket keys of short strings, whose bytes are compared afterwards: long strings
    collide modulo a power of two.
    """
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
    return sums


#: spans longer than this many bytes are digested by BLAKE2
LONG_SPAN = 128


def _scramble(x):
    """Another finaliser than ``mix64``, with other shifts and factors."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(data, starts, ends, both=True):
    """Two unrelated 64-bit hashes of the bytes of each span, together its 128-bit name (one, if not ``both``).

    Eight bytes a step, each step finalised, so that no sum of bytes decides; a span's length
    begins its chain.  Spans above ``LONG_SPAN`` bytes take the halves of a BLAKE2 digest.
    """
    size = (ends - starts).astype(np.int64)
    first = mix64(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    second = _scramble(size.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D)) if both else None
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    live, at = np.flatnonzero((size > 0) & (size <= LONG_SPAN)), 0
    whole = len(live) == len(size)
    while len(live):
        left = (size if whole else size[live]) - at
        chunk = words[(starts if whole else starts[live]) + at]
        short = left < 8
        chunk = np.where(short, chunk & ((np.uint64(1) << (np.where(short, left, 0) * 8).astype(np.uint64)) - np.uint64(1)), chunk)
        h = first if whole else first[live]
        first[live] = mix64((h ^ chunk) * np.uint64(BASE) + (h >> np.uint64(29)))
        if both:
            h = second if whole else second[live]
            second[live] = _scramble((h << np.uint64(23) | h >> np.uint64(41)) + chunk * np.uint64(0x9FB21C651E98DF25))
        live, at, whole = live[left > 8], at + 8, False
    raw = memoryview(data)
    for k in np.flatnonzero(size > LONG_SPAN).tolist():
        name = hashlib.blake2b(raw[int(starts[k]) : int(ends[k])], digest_size=16).digest()
        first[k] = int.from_bytes(name[:8], "little")
        if both:
            second[k] = int.from_bytes(name[8:], "little")
    return first, second


def distinct_names(first, second):
    """(first, second, place of one, number of each): the distinct 128-bit names, sorted."""
    u, where, which = np.unique(first, return_index=True, return_inverse=True)
    if (second[where][which] == second).all():
        return u, second[where], where, which
    order = np.lexsort((second, first))  # two names share their first half
    a, b = first[order], second[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(new) - 1
    return a[new], b[new], order[new], which


def word_hashes(data, offs, lower=True, both=False):
    """(hashes, starts, ends, first_word) of the words of each text; with ``both``, (hashes, second hashes, ...)."""
    if lower:
        data = lower_ascii(data)
    starts, ends, first = word_spans(data, offs)
    one, two = span_hashes(np.ascontiguousarray(data), starts, ends, both)
    return (one, two, starts, ends, first) if both else (one, starts, ends, first)


def gram_hashes(words, n, salt=0):
    """Hashes of every n consecutive entries of ``words`` (length len-n+1)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(m, (n + salt * 1_000_003) & ((1 << 64) - 1), np.uint64)
    for j in range(n):
        acc = mix64(acc * np.uint64(BASE) + words[j : j + m])
    return acc


def shingle_sets(data, offs, n=5):
    """Each text's sorted distinct word-shingle hashes.

    A text of one to n-1 words has its whole word sequence as its single shingle;
    a text without words has the empty set.
    """
    words, _, _, first = word_hashes(data, offs)
    grams = gram_hashes(words, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            out.append(s[keep])
        elif b > a:
            out.append(gram_hashes(words[a:b], b - a, salt=1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
