"""Near-duplicates among short texts, where bands alone lose links."""

import random

import numpy as np

from loomgraph.llm import _text, minhash

#: 3 of 4 shingles shared, and no band
LOST = "w133974 w220091 w297346 w795963 w812181 w268065 w125293 w819765"


def band_keys(texts):
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    sig = minhash.densified_signatures(_text.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), offs), 128)
    return sig.reshape(len(texts), 32, 4)


def test_short_texts_lose_no_link(spark):
    r = random.Random(11)
    pairs = [(LOST, LOST.rsplit(" ", 1)[0])]
    for _ in range(30_000):
        w = [f"w{r.randrange(1_000_000)}" for _ in range(r.randrange(8, 13))]
        pairs.append((" ".join(w), " ".join(w[:-1])))
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert {x.doc_id: x.component_id for x in found.collect()} == {d: d // 2 * 2 for d, _ in rows}
    a, b = band_keys([p[0] for p in pairs]), band_keys([p[1] for p in pairs])
    missed = int((~(a == b).all(2).any(1)).sum())
    assert 1 <= missed < 20  # of 30,001: what bands alone would have lost


def test_short_templates(spark):
    """Families of one template below and at the threshold, with copies in numbers, against all pairs."""
    from test_llm import linked, shingles

    r = random.Random(4)
    rows = []
    for _ in range(12):
        base = [f"t{r.randrange(10_000)}" for _ in range(r.randrange(1, 30))]
        for _ in range(25):
            w = list(base)
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = f"e{r.randrange(6)}"
            rows.append(" ".join(w[: r.randrange(max(1, len(w) - 2), len(w) + 1)]))
    rows += [rows[0]] * 300
    table = list(enumerate(rows))
    want = linked({d: shingles(t) for d, t in table})
    found = minhash.near_duplicates(spark.createDataFrame(table, "doc_id long, text string"))
    assert {x.doc_id: x.component_id for x in found.collect()} == want
