"""Hard negatives, the Merkle manifest and license scans against brute force, on nulls, ties, repeated rows, long texts and empty tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import license, license_rules, merkle, negatives

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
VECTORS = "vec_id long, embedding array<double>, label int, row string, rank int, score string, q int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, idx int, n int, leaf string"


# hard negatives


def mined(rows, share=(80, 100)):
    """All pairs, with Python integers; a row counts for itself."""
    ok = [(i, v, int(l), [max(-(1 << 62), min(1 << 62, math.floor(256 * x))) for x in e]) for i, (v, e, l) in enumerate(rows) if v is not None and l is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    score = lambda a, b: max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, b))))
    out = []
    for i, anchor, label, q in ok:
        if anchor % 100:
            continue
        others = sorted(((-score(q, p), v, lab) for j, v, lab, p in ok if j != i), key=lambda t: t[:2])
        for ps, positive, _ in [t for t in others if t[2] == label][:5]:
            fits = [(v, -s) for s, v, lab in others if lab != label and share[0] * -ps <= share[1] * -s <= share[1] * -ps]
            out += [(anchor, positive, k, v, -ps, s) for k, (v, s) in enumerate(fits[:5], 1)]
    return sorted(out)


def got(df, share=(80, 100)):
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, share).collect()))


def odd_vectors():
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(12)], r.randrange(3)) for i in range(330)]
    rows += [(100, rows[100][1], rows[100][2]), (7, rows[7][1], 1), (400, rows[5][1], 0), (401, rows[5][1], 0), (402, rows[5][1], 1)]  # repeated ids and vectors
    rows += [(500, None, 1), (501, [1.0] * 12, None), (None, [1.0] * 12, 1), (502, [math.nan] * 12, 1), (503, [math.inf] + [0.0] * 11, 1), (504, [None] + [0.0] * 11, 1)]
    rows += [(600, [0.5, 0.25], 2), (601, [], 2), (700, [0.0] * 12, 0), (701, [0.0] * 12, 1), (702, [0.0] * 12, 0)]  # short, empty and zero vectors
    return rows


@pytest.mark.parametrize("share", [(80, 100), (50, 100)])
def test_negatives(spark, share):
    rows = odd_vectors()
    df = spark.createDataFrame([(*x, "r", 9, "s", 8) for x in rows], VECTORS)
    assert got(df, share) == mined(rows, share)


def test_negatives_of_wide_components(spark):
    rows = [(i, [x * 1e9 for x in e], l) for i, e, l in odd_vectors()[:120]] + [(200, [1e300] * 12, 1), (300, [1e300] * 12, 1), (301, [-1e300] * 12, 2)]
    assert got(spark.createDataFrame([(*x, "r", 9, "s", 8) for x in rows], VECTORS)) == mined(rows)


def test_negatives_of_nothing(spark):
    assert got(spark.createDataFrame([], VECTORS)) == []
    assert got(spark.createDataFrame([(100, [1.0], 1, "", 1, "", 1)], VECTORS)) == []


def test_negatives_in_small_blocks(spark, monkeypatch):
    """Lists kept over many blocks, with one label on a third of the rows and large groups of equal vectors."""
    for name, value in {"BLOCK": 16, "STRIP": 8, "SPAN": 3, "CHUNK": 32}.items():
        monkeypatch.setattr(negatives, name, value)
    r = random.Random(5)
    kinds = [[r.gauss(0, 0.2) for _ in range(8)] for _ in range(40)]
    rows = [(i, r.choice(kinds[:3] if i % 3 == 0 else kinds), 0 if i % 3 == 0 else r.randrange(40)) for i in range(500)]
    assert got(spark.createDataFrame([(*x, "r", 9, "s", 8) for x in rows], VECTORS)) == mined(rows)


def test_negatives_of_many_small_files(spark):
    """A task reads several files of the stored rows, the largest first, so that labels come out of order."""
    r, parts = random.Random(5), spark.conf.get("spark.sql.shuffle.partitions")
    rows = [(i, [r.gauss(0, 0.3) for _ in range(12)], r.randrange(10)) for i in range(800)]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert got(spark.createDataFrame([(*x, "r", 9, "s", 8) for x in rows], VECTORS)) == mined(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_bounds_rule_out_no_pair():
    """What a stage drops has an exact product outside of what was asked for."""
    rng = np.random.default_rng(1)
    axes, _ = np.linalg.qr(rng.standard_normal((32, 32)))
    sides = []
    for n in (50, 300):
        q = np.floor(256 * rng.standard_normal((n, 32)) * 2.0 ** -np.arange(32)).astype("<i8")
        sides.append(negatives.Side(*(np.arange(n, dtype="<i8").tobytes() for _ in range(3)), 8, q.tobytes(), axes, [4, 12]))
    a, b = sides
    exact = (a.q @ b.q.T).astype(np.int64)
    asked = float(np.quantile(exact, 0.95))
    i, j = negatives.survivors(a, 0, 50, b, 0, 300, [4, 12], lambda i, low, high: high >= asked)
    kept = np.zeros(exact.shape, bool)
    kept[i, j] = True
    assert (kept | (exact < asked)).all() and kept.sum() < exact.size / 2
    assert (negatives.exact(a, i, b, j) == exact[i, j]).all()


# Merkle manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """(root, paths): a path has for each level the nodes before and after."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i // 16 * 16
            paths[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 16])))
        nodes, at = [digest("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)], [i // 16 for i in at]
    return nodes[0], paths


def manifest_of(rows):
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows]
    for r in rows:
        r["leaf"] = leaf_of([r[c] for c in merkle.FIELDS])
        lowered = None if r["text"] is None else r["text"].translate(LOWER)
        touched = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        r["own"] = leaf_of([r[c] for c in merkle.FIELDS[:-1]] + [lowered]) if touched else r["leaf"]
    sources, out, done = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode())), [], []
    for s in sources:
        mine = sorted((r for r in rows if r["source"] == s), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"]))
        done.append((mine, *tree([r["leaf"] for r in mine])))
    root, tops = tree([d[1] for d in done]) if done else (None, [])
    for (mine, subroot, paths), top in zip(done, tops):
        for r, path in zip(mine, paths):
            node, proof = r["own"], ""
            for before, after in path + top:
                node, proof = digest(before + node + after), proof + before + after
            out.append((r["doc_id"], r["leaf"], subroot, root, digest(proof), node, node == root))
    return sorted(out, key=repr)


def manifest_rows(spark, rows):
    df = spark.createDataFrame([(*r, "t", 1, 2, "l") for r in rows], DOCS)
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return sorted(map(tuple, merkle.manifest(df, touched).collect()), key=repr)


def odd_docs(n=700):
    r = random.Random(9)
    rows = [(i, r.choice(["Some Text", "ÉCOLE öß", "plain", "", None, "X" * 5000]), r.choice(["en", None]), "hot" if i % 3 else r.choice([None, "", "a", "é", "Z", f"s{i % 40}"]), r.choice([i, None])) for i in range(n)]
    return rows + rows[:40] + [(None, "No ID", "en", "hot", 1), (None, None, None, None, None), (None, None, None, None, None)]


def test_manifest(spark):
    rows = odd_docs()
    assert manifest_rows(spark, rows) == manifest_of(rows)


def test_manifest_of_many_blocks(spark, monkeypatch):
    """Trees above several passes: blocks of 16 leaves in place of 4096."""
    monkeypatch.setattr(merkle, "CLIMB", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rows = odd_docs(900)
    assert manifest_rows(spark, rows) == manifest_of(rows)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_manifest_of_few(spark, n):
    rows = [(i, "A", "en", "s", 1) for i in range(n)]
    assert manifest_rows(spark, rows) == manifest_of(rows)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 272, 273, 1000, 4095, 4096])
def test_traversal(n):
    leaves = [digest(str(i)) for i in range(n)]
    root, paths = tree(leaves)
    levels = merkle.levels_of(n)
    assert list(merkle.traversal(leaves, levels)) == paths and merkle.climbed(leaves, levels) == root
    for climb in {levels, 3}:  # the last block of a larger tree climbs all levels, single runs included
        nodes, want = leaves, [[] for _ in leaves]
        for k in range(climb):
            for i in range(n):
                own = i // 16**k
                run = own // 16 * 16
                want[i].append(("".join(nodes[run:own]), "".join(nodes[own + 1 : run + 16])))
            nodes = [digest("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        assert list(merkle.traversal(leaves, climb)) == want


# license scans

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def scanned(text):
    """Every rule on every text, every pair of detections compared."""
    words = WORDS.findall((text or "").translate(LOWER))
    places = [(i, label) for label, phrase in license_rules.BASE.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    spaced = "".join(" " + w for w in words) + " "
    found = [(*m.span(m.lastindex or 0), n, r) for n, r in enumerate(license_rules.rules()) for m in r.pattern.finditer(spaced) if any(f" {g} " in f" {m[0]} " for g in r.gates)]

    def beats(x, y):
        if not (x[0] <= y[0] and x[1] >= y[1]) or x is y:
            return False
        return x[3].priority > y[3].priority or x[3].priority == y[3].priority and ((x[:2] != y[:2]) or x[2] < y[2])

    kept = [y for y in found if not any(beats(x, y) for x in found)]
    starts, base = [i for i, _ in places], sorted({label for _, label in places})
    weight = max([0.9] * bool(places) + [f[3].weight for f in kept], default=0.0)
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *(f[3].label for f in kept)})), weight, len(kept)


TEXTS = {
    "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "This work is licensed under the GNU General Public License": "gpl", "All rights reserved.": "all-rights-reserved", "SPDX-License-Identifier: (LGPL-2.1-only OR BSD-3-Clause)": "bsd-3-clause,lgpl-2.1",
    "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.": "lgpl-2.1",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd", "under CC BY-NC-SA 3.0": "cc-by-nc,cc-by-nc-sa", "mozilla public license, v. 2.0": "mpl-2",
    "fahren mit dem Bus": "", "the general public and a license": "", "UNDER\tTHE\x00mit-LICENSE": "mit", "": "",
}


@pytest.fixture(scope="module")
def licensed():
    r = random.Random(2)
    phrases = [*TEXTS, *license_rules.BASE.values(), *(g for rule in license_rules.rules()[::7] for g in rule.gates)]
    mixed = [" ".join(r.choice([*phrases, "filler", "words", "émigré", "under", "1"]) for _ in range(r.randrange(1, 60))) for _ in range(120)]
    return [*TEXTS, None, *mixed, "x" * 100_000, "Released under the MIT License. " * 3000, "under the mit license apache license version 2"]


def test_license_labels(spark, licensed):
    rows = [(i if i % 9 else None, t, "x", "y", "z") for i, t in enumerate(licensed)] + [(1, TEXTS and "Released under the MIT License.", "", "", "")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string, score string, n_words string")
    short = [(d, t) for d, t, *_ in rows if len(t or "") < 50_000]
    found = [tuple(r) for r in license.license_labels(df).collect()]
    assert len(found) == len(rows)
    want = sorted(((d, *scanned(t)) for d, t in short), key=repr)
    long = {i for i, (_, t, *_) in enumerate(rows) if len(t or "") >= 50_000}
    assert sorted((f for i, f in enumerate(found) if i not in long), key=repr) == want
    repeated = [f for i, f in enumerate(found) if i in long]
    assert [f[1:6] for f in repeated] == [(1, 0, None, None, ""), (15000, 3000, 1, 14996, "mit")]


def test_license_texts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = {r.doc_id: r.labels for r in license.license_labels(df).collect()}
    assert [found[i] for i in range(len(TEXTS))] == list(TEXTS.values())
    spans = license.license_spans(df.where("text like '%SPDX%'")).collect()
    assert [(s.label, s.kind, s.first_word, s.last_word, s.words) for s in spans] == [("lgpl-2.1", "tag", 3, 6, "lgpl 2 1 only"), ("bsd-3-clause", "tag", 8, 10, "bsd 3 clause")]


def test_license_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = sorted((tuple(r) for r in license.license_labels(docs).collect()), key=repr)
    assert found == sorted(((r.doc_id, *scanned(r.text)) for r in docs.collect()), key=repr)
    assert license.license_labels(docs.limit(0)).count() == 0


def test_license_rules_are_gated():
    """Every phrase is normalised, as the texts are that it is looked for in."""
    for rule in license_rules.rules():
        for gate in rule.gates:
            assert re.fullmatch(r"[a-z0-9]+( [a-z0-9]+)*", gate), (rule.label, gate)
    assert len(license_rules.rules()) > 300
