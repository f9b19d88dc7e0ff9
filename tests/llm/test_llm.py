"""The corpus operators against brute force, and on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import _text, classlm, decontaminate, eliasfano, minhash, mixing, quality, queries, suffix, tokencount, tokenids, toxicity, warc
from loomgraph.llm.components import connected_components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, kept string, n_words string, start int, probability string"


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd_rows():
    r = random.Random(7)
    words = ["alpha", "Beta", "gamma,", "délta", "x|y", "the", "of", "and"] + [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, long = text(400), text(30_000)
    rows = [
        (1, base), (2, base), (3, base.replace("w1 ", "q1 ", 1)), (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (7, "one"), (8, "two words"), (None, base), (None, None),
        (9, long), (10, long[:100_000] + " tail"), (11, "a" * 3000), (12, base.upper()), (13, text(60) + "\n" + text(60)), (14, "é" * 500 + " <|endoftext|> don't STOP…"),
    ]
    return [(d, t, *x) for (d, t), x in zip(rows, [("en", "a", "k", "n", 1, "p"), (None, None, None, None, None, None)] * len(rows))]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(sets):
    """Smallest reachable id of each id, by comparing all pairs that share a shingle."""
    at, pairs, parent = collections.defaultdict(list), collections.Counter(), {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for g in s:
            for other in at[g]:
                pairs[other, d] += 1
            at[g].append(d)
    for (a, b), n in pairs.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in sets}


@pytest.mark.parametrize("table", ["real", "odd"])
def test_minhash(spark, odd, table):
    df = docs_of(spark) if table == "real" else odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    sets = {r.doc_id: shingles(r.text) for r in df.collect()}
    want = linked(sets)
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {d: (len(s), want[d], want[d] == d) for d, s in sets.items()}


def test_minhash_edges(spark, odd, none):
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.near_duplicates(odd).count() == odd.count()
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns
    # two texts of one doc_id: each is linked by itself
    x, y = (" ".join(f"{c}{i}" for i in range(100)) for c in "xy")
    two = spark.createDataFrame([(5, x), (5, y), (3, x + " more"), (9, y + " more"), (4, "alone")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(two).collect()) == [(3, 3), (4, 4), (5, 3), (5, 5), (9, 5)]
    assert sorted((r.doc_id, r.text[:1]) for r in minhash.keep_one(two).collect()) == [(3, "x"), (4, "a"), (5, "y")]
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({d for d, *_ in odd_rows() if d} - {2, 3, 12})
    many = [(i, " ".join(f"v{(i // 40) * 1000 + k}" for k in range(200) if (k * 7 + i) % 97)) for i in range(400)]
    df = spark.createDataFrame(many, "doc_id long, text string")
    want = linked({d: shingles(t) for d, t in many})
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == want


def test_minhash_template_family(spark):
    # pairs at 90 / 110 = 0.82, all others at 84 / 116 = 0.72: one crowded family, and texts of half its size
    def text(pair, side, k):
        return " ".join([f"t{i}" for i in range(84 // k)] + [f"p{k}x{pair}x{i}" for i in range(6 // k)] + [f"o{k}x{pair}x{side}x{i}" for i in range(10 // k)])

    docs = [(1000 * k + pair + 300 * side, text(pair, side, k)) for k in (1, 2) for pair in range(300) for side in (0, 1)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=1).collect()}
    assert got == {d: d - 300 * ((d % 1000) // 300) for d, _ in docs}


def test_minhash_sparse_family(spark):
    # 600 texts from one template with 4 words replaced, mostly below the threshold, 10 with 2: their links stand in one crowded bucket
    r = random.Random(11)
    base = [f"t{i}" for i in range(200)]

    def text(k, n):
        w = list(base)
        for i in r.sample(range(200), n):
            w[i] = f"x{k}y{i}"
        return " ".join(w)

    docs = [(k, text(k, 4 if k < 600 else 2)) for k in range(610)]
    want = linked({d: shingles(t) for d, t in docs})
    assert {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == want


@pytest.mark.parametrize("n", [1024, 2048, 65_536])
def test_words_that_sums_cannot_tell(n):
    tie = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    other = tie.translate({97: "b", 98: "a"})
    data = np.frombuffer(f"{tie} {other} {tie}".encode(), np.uint8)
    first, second, *_ = _text.word_hashes(data, np.array([0, len(data)]), both=True)
    assert first[0] != first[1] and second[0] != second[1] and (first[0], second[0]) == (first[2], second[2])


def test_names_with_a_common_half():
    a, b = np.array([5, 5, 9, 5, 1], np.uint64), np.array([7, 8, 9, 7, 1], np.uint64)
    one, two, where, which = _text.distinct_names(a, b)
    assert one.tolist() == [1, 5, 5, 9] and two.tolist() == [1, 7, 8, 9] and (one[which] == a).all() and (two[which] == b).all() and (a[where] == one).all()


def test_pieces_with_a_common_half(monkeypatch):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    whole, pieces = Tokenizer.from_file(path), tokenids.WordEncoder(path)
    right = _text.span_hashes

    def weak(data, starts, ends, both=True):
        first, second = right(data, starts, ends, both)
        return first % np.uint64(7), second

    monkeypatch.setattr(tokenids, "span_hashes", weak)
    for text in ("one", "two three", "one two three four five six seven eight nine ten", "one"):
        data = np.frombuffer(text.encode(), np.uint8)
        assert pieces.encode(data, np.array([0, len(data)]))[0].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_densified_signatures_estimate_jaccard():
    r = np.random.default_rng(1)
    a = r.integers(1, 2**63, 900).astype(np.uint64)
    b = np.concatenate([a[:700], r.integers(1, 2**63, 200).astype(np.uint64)])
    s = minhash.densified_signatures([np.unique(a), np.unique(b), a[:1]], 512)
    assert abs((s[0] == s[1]).mean() - 700 / 1100) < 0.08 and (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


@pytest.mark.parametrize("size", [1 << 20, 700])
def test_components(spark, size):
    """In one partition, and in many with steps between them."""
    pairs = [(i, i + 1) for i in range(0, 60) if i != 30] + [(5, 5), (None, 3)] + [(1000, k) for k in range(900, 990)]
    random.Random(2).shuffle(pairs)
    e = spark.createDataFrame(pairs, "a long, b long").repartition(16)
    assert {r.node: r.component for r in connected_components(e, size=size).collect()} == {i: 0 if i <= 30 else 31 for i in range(61)} | {i: 900 for i in [*range(900, 990), 1000]}
    assert connected_components(e.where("false"), size=size).count() == 0


def brute_repeats(texts, n=200):
    seen = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def test_suffix_hot_middle(spark, monkeypatch):
    """Distinct pieces around one middle: parts above the bound are divided to single windows."""
    monkeypatch.setattr(suffix, "HOT", 8)
    r = random.Random(9)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    middle, sides = noise(190), [noise(8) for _ in range(5)]
    texts = [noise(150) + r.choice(sides) + middle + r.choice(sides) + noise(150) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix.remove_repeats(df).orderBy("doc_id").collect()]
    want = brute_repeats([t.encode() for t in texts])
    assert got == want and sum(w[1] > 0 for w in want) > 0


@pytest.mark.parametrize("hot", [1024, 2])
def test_suffix(spark, odd, none, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    df = odd.where("doc_id is null or doc_id <> 9")
    rows = df.collect()
    want = sorted(map(str, zip([r.doc_id for r in rows], brute_repeats([(r.text or "").encode() for r in rows]))))
    got = suffix.remove_repeats(df).collect()
    assert sorted(str((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))) for r in got) == want
    assert suffix.remove_repeats(none).count() == 0


def test_suffix_blocks(monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 300)
    r = random.Random(3)
    data = np.frombuffer("".join(r.choice("ab") for _ in range(5000)).encode(), np.uint8)
    text, _, sample, lo, hi = suffix.cover_samples(data, np.array([0, 1000, 1000, 5000]), 100, 20)
    covered = collections.Counter(p for a, b in zip(lo, hi) for p in range(a, b + 1))
    assert covered == {p: 1 for p in [*range(0, 901), *range(1000, 4901)]}
    assert ((sample >= hi) & (sample <= lo + 80)).all()


def test_class_model(spark, odd, none):
    df = odd.union(docs_of(spark).select("doc_id", "text", "lang", "source", *[F.lit(None).cast(t).alias(c) for c, t in (("kept", "string"), ("n_words", "string"), ("start", "int"), ("probability", "string"))]))
    rows = [(r.doc_id, WORD.findall((r.text or "").translate(LOWER)) + ["\n"]) for r in df.collect()]
    held = lambda d: zlib.crc32(str(d if d is not None else "").encode()) % 5 == 1
    c = collections.Counter(w for d, ws in rows if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    key = lambda d, h, t, k, b: (-1 if d is None else d, h, t, k, round(b, 6))
    want = sorted(key(d, held(d), len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for d, w in rows)
    found = classlm.score_texts(df).collect()
    got = sorted(key(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score) for r in found)
    assert [g[:4] for g in got] == [w[:4] for w in want] and np.allclose([g[4] for g in got], [w[4] for w in want])
    test = [r for r in found if r.held_out]
    assert {r.train_tokens for r in found} == {n} and sum(r.score for r in test) > sum(r.base_score for r in test)
    assert classlm.score_texts(none).count() == 0


def test_class_model_is_a_distribution(spark, odd):
    """Transitions and emissions add up to one, and scores are those of a word by word reading."""
    df = odd.select("doc_id", "text").union(docs_of(spark).select("doc_id", "text"))
    texts = [(r.doc_id, WORD.findall((r.text or "").translate(LOWER))) for r in df.collect()]
    held = lambda d: zlib.crc32(str(d if d is not None else "").encode()) % 5 == 1
    m = classlm.fit(spark.createDataFrame([(" ".join(w),) for d, w in texts if not held(d)], "text string"))
    assert np.allclose((10 ** m["transition"]).sum(1), 1)
    name = lambda w: [int(x[0]) for x in classlm.token_names(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[:2]]
    tail = {(r.key % 2**64, r.check): (r.n, r["class"]) for r in m["known"].collect()}
    classes, emission, history = {}, {}, {}
    for k, c, cls, e, h in zip(m["words"].tolist(), m["checks"].tolist(), m["chosen"].tolist(), m["emission"].tolist(), m["history"].tolist()):
        classes[k, c], emission[k, c], history[k, c] = cls, e, h
    for key, (n, cls) in tail.items():
        assert classes.setdefault(key, cls) == cls
        want = math.log10(n - classlm.DISCOUNT) - m["log_size"][cls]
        assert emission.setdefault(key, want) == pytest.approx(want)
    for c in range(2, classlm.CLASSES):
        assert sum(10**e for k, e in emission.items() if classes[k] == c) == pytest.approx(1 if c in classes.values() else 0)
    assert len(tail) > 1000 and len(set(h for h in history.values())) > 30
    want = []
    for d, ws in texts:
        h = total = 0
        for w in ws:
            k = tuple(name(w))
            c = classes.get(k, classlm.RARE_CLASS)
            total += m["transition"][h, c] + emission.get(k, -m["log_size"][classlm.RARE_CLASS])
            h = history.get(k, classlm.RARE_CLASS)
        want.append((-1 if d is None else d, len(ws) + 1, total + m["transition"][h, 0]))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.score) for r in classlm.score_texts(df).collect()]
    assert np.allclose(sorted(got), sorted(want))


def test_exchange_recovers_classes():
    """Two kinds of words that always alternate end in different classes, whatever the start."""
    r = np.random.default_rng(0)
    kinds, c = r.integers(0, 2, 40), classlm.CLASSES
    of = 2 + r.integers(0, 2, 40)
    pairs = [(i, j, 10) for i in range(40) for j in range(40) if kinds[i] != kinds[j]]
    before = -np.inf
    while True:
        table, right, left = np.zeros((c, c)), np.zeros((40, c)), np.zeros((40, c))
        for i, j, m in pairs:
            table[of[i], of[j]] += m
            right[i, of[j]] += m
            left[j, of[i]] += m
        now = classlm._x_log_x(table).sum() - classlm._x_log_x(table.sum(1)).sum() - classlm._x_log_x(table.sum(0)).sum()
        assert now >= before  # one move at a time never lowers the likelihood
        before = now
        best, gain = classlm.exchange(right, left, of, table)
        k = int(gain.argmax())
        if gain[k] <= 1e-6:
            break
        of[k] = best[k]
    assert all(len(set(kinds[of == cl])) == 1 for cl in set(of))


def test_decontamination(spark, odd, none):
    docs, bench = docs_of(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    split = lambda t: " ".join(re.findall(r"[^\s!-/:-@\[-`{-~]+", t.lower()))
    items = {r.item_id: f" {split(r.text)} " for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in f" {split(r.text)} "}
    got = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.share == 1} == want
    w = [f"item{i}" for i in range(30)]
    edited = [x if i % 4 else f"other{i}" for i, x in enumerate(w)]
    bench = spark.createDataFrame([(1, " ".join(w), "x"), (2, "tiny one", "x"), (3, None, "x"), (4, "", "x")], "item_id long, text string, doc_id string")
    rows = [(1, "pre " * 50 + " ".join(w).upper() + " post"), (2, "a b c " + ", ".join(edited)), (3, " ".join(w[:8]) + " and nothing more of it"), (4, "so tiny one here"), (5, None), (6, ""), (None, " ".join(w)), (7, " ".join(w)), (7, " ".join(w))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    found = decontaminate.contaminated(df, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (2, 1), (4, 2), (None, 1), (7, 1)}
    (r,) = found.where("doc_id = 1").collect()
    assert (r.word_start, r.word_end, r.share) == (50, 80, 1.0)
    left = decontaminate.without_leaks(df, bench)
    assert left.columns == df.columns and sorted(x.doc_id for x in left.collect()) == [3, 5, 6]
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(df, bench.where("false")).count() == 0


def test_alignment_is_smith_waterman():
    r = random.Random(5)
    for _ in range(40):
        a, b = [[r.randrange(4) for _ in range(r.randrange(1, 9))] for _ in range(2)]
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align([a], [b])[0][0] == h.max()


def test_mixing(spark, odd, none):
    rows = mixing.sample(docs_of(spark)).withColumn("t", F.expr(mixing.TOKENS)).collect()
    for d, power in mixing.FLATTEN.items():
        own, have = collections.Counter(), collections.Counter()
        for r in rows:
            have[r[f"m_{d}"]] += r.t * r.probability
            own[r[f"m_{d}"]] += r.t
        n = sum(own.values())
        z = sum((v / n) ** power for v in own.values())
        goal = {k: min((v / n) ** power / z, mixing.BOOST * v / n) for k, v in own.items()}
        for k, g in goal.items():
            assert have[k] / sum(have.values()) == pytest.approx(g / sum(goal.values()), rel=1e-6)
    assert len(own) > 2 and 0.5 < sum(r.kept for r in rows) / sum(r.probability for r in rows) < 1.5
    kept = mixing.sampled(odd)
    assert kept.columns == odd.columns and mixing.sampled(none).count() == 0
    targets = spark.createDataFrame([("source", "a", 3.0), ("source", "", 1.0), ("lang", "xx", 1.0)], "dimension string, value string, share double")
    t = mixing.sample(odd.withColumn("lang", F.lit("en")), targets, "'all'").withColumn("t", F.expr(mixing.TOKENS)).groupBy("m_source").agg(F.sum(F.col("t") * F.col("probability")).alias("x")).collect()
    x = {r.m_source: r.x for r in t}
    assert x["a"] / x[""] == pytest.approx(3.0, rel=1e-8)


def test_mixing_far_and_impossible_targets(spark):
    rows = [(0, "w " * 10, "x", "en", "t")] + [(i, "w " * 1000, "y", "en", "t") for i in range(1, 101)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    target = lambda *t: spark.createDataFrame(list(t), "dimension string, value string, share double")
    found = mixing.sample(df, target(("source", "x", 1.0), ("source", "y", 1.0)), "topic").collect()
    have = collections.Counter()
    for r in found:
        have[r.source] += len(r.text.split()) * r.probability
    assert have["x"] == pytest.approx(have["y"]) == 10
    # every text of source x is German and the other way round: their shares can't differ
    tied = df.withColumn("lang", F.expr("if(source = 'x', 'de', 'en')"))
    with pytest.raises(ValueError, match="can't be met"):
        mixing.rake(tied.selectExpr("source as m_source", "lang as m_lang", "'' as m_topic", "10L as tokens").groupBy("m_source", "m_lang", "m_topic").agg(F.sum("tokens").alias("tokens")),
                    target(("source", "x", 1.0), ("source", "y", 1.0), ("lang", "de", 3.0), ("lang", "en", 1.0)), rounds=4)


def test_token_counts(spark, odd, none):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    encoding, lengths = tokencount.worker_encoding(path, P.PATTERN)
    for r, g in zip(odd.collect(), tokencount.token_counts(odd, path, P.PATTERN).collect()):
        ids = encoding.encode_ordinary(r.text or "")
        assert g.n_tokens == len(ids) == sum(g.section_tokens)
        assert g.n_sections == (len((r.text or "").split("\n")) - (r.text or "").endswith("\n") if r.text else 0)
    f = spark.createDataFrame([(1, "hel", "lo wor", None, "ld")], "doc_id long, a string, b string, c string, d string")
    fields = ["a", "b", "c", "d"]
    one = tokencount.token_counts(f, path, P.PATTERN, fields=fields).first()
    assert one.n_tokens == len(encoding.encode_ordinary("hello world")) == 2 and one.n_crossing == 2 and one.section_tokens == [1, 1, 0, 0]
    assert tokencount.token_counts(f, path, P.PATTERN, "start", fields).first().section_tokens == [1, 1, 0, 0]
    assert tokencount.token_counts(f, path, P.PATTERN, "split", fields).first().section_tokens == pytest.approx([0.6, 0.4 + 4 / 6, 0, 2 / 6])
    assert tokencount.token_counts(none, path, P.PATTERN).count() == 0


def brute_attribution(encoding, text, bounds, rule):
    """Each token by its characters, one by one."""
    at, owners = 0, [max(i for i, b in enumerate(bounds[:-1]) if b <= c and bounds[i + 1] > c) for c in range(len(text))]
    raw, counts, crossing = text.encode(), [0.0] * (len(bounds) - 1), 0
    for t in encoding.encode_ordinary(text):
        end = at + len(encoding.decode_single_token_bytes(t))
        before, through = raw[:at].decode(errors="ignore"), raw[:end]
        while through and len(through) < len(raw) and raw[len(through)] & 0xC0 == 0x80:
            through = raw[: len(through) + 1]
        own = collections.Counter(owners[len(before) : len(through.decode())])
        crossing += len(own) > 1
        if rule == "split":
            for s, n in own.items():
                counts[s] += n / sum(own.values())
        else:
            counts[min(own) if rule == "start" else min(own, key=lambda s: (-own[s], s))] += 1
        at = end
    return counts, crossing


@pytest.mark.parametrize("rule", ["start", "majority", "split"])
def test_token_attribution(spark, rule):
    import public_tokenizers as P

    path, r = P.path("byte_bpe_50k.tiktoken"), random.Random(4)
    encoding, _ = tokencount.worker_encoding(path, P.PATTERN)
    parts = ["the ", "word", "s", "é", "中文", "😀", "\n", "  ", " ", "\n\n", "12", "…", "'s", "ing", "\u3000"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(150)]
    lines = {i: t for i, t in enumerate(texts)}
    for x in tokencount.token_counts(spark.createDataFrame(list(lines.items()), "doc_id long, text string"), path, P.PATTERN, rule).collect():
        bounds = [0] + [i + 1 for i, c in enumerate(lines[x.doc_id]) if c == "\n" and i + 1 < len(lines[x.doc_id])] + ([len(lines[x.doc_id])] if lines[x.doc_id] else [])
        want = brute_attribution(encoding, lines[x.doc_id], bounds, rule)
        assert x.section_tokens == pytest.approx(want[0]) and x.n_crossing == want[1]
    rows = [(i, *["".join(r.choice(parts) for _ in range(r.randrange(4))) for _ in range(3)]) for i in range(150)]
    for x, row in zip(tokencount.token_counts(spark.createDataFrame(rows, "doc_id long, a string, b string, c string"), path, P.PATTERN, rule, ["a", "b", "c"]).orderBy("doc_id").collect(), rows):
        want = brute_attribution(encoding, "".join(row[1:]), np.cumsum([0] + [len(t) for t in row[1:]]).tolist(), rule)
        assert x.section_tokens == pytest.approx(want[0]) and x.n_crossing == want[1]


def test_token_counts_of_long_white_space(spark):
    import public_tokenizers as P

    path, r = P.path("byte_bpe_50k.tiktoken"), random.Random(1)
    encoding, lengths = tokencount.worker_encoding(path, P.PATTERN)
    for _ in range(40):
        text = "".join(r.choice([" ", "\n", "\t", " \n", "\u3000"]) * r.choice([1, 3, 4096, 9000]) + r.choice(["", "a", "word", "'s", "12", "!", " é"]) for _ in range(4))
        assert tokencount.encoded(encoding, text) == encoding.encode_ordinary(text)
    found = tokencount.token_counts(spark.createDataFrame([(1, "a" + " " * 2_000_000 + "b\n")], "doc_id long, text string"), path, P.PATTERN).first()
    assert found.n_tokens == 2_000_002 and found.section_tokens == [2_000_002]


def test_warc(spark, none):
    big = "<p>" + "x" * 1500
    rows = [(1, "http://a\r\nEvil: 1", big), (2, None, big), (3, "http://c", "small"), (4, "http://c", "small"), (5, "u", None), (6, "u", ""), (None, "u", big), (9, "é", "ü" * 900), (7, "u", "y" * 400_000), (7, "u", "y" * 400_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    from loomgraph.llm._store import fresh_path, read_file

    uri = fresh_path(spark, "warc-test")
    made = warc.write_warc(df, uri)
    got = sorted((-1 if r.page_id is None else r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_warc(made, uri).collect())
    assert got == [(-1, "revisit", 2, 1503), (1, "revisit", 2, 1503), (2, "response", None, 1503), (3, "response", None, 5), (4, "response", None, 5), (5, "response", None, 0), (6, "response", None, 0), (7, "response", None, 400_000), (7, "response", None, 400_000), (9, "response", None, 1800)]
    raw = read_file(f"{uri}/pages-{made.first().archive:014d}.warc.zst")
    assert raw[:4] == bytes.fromhex("5d2a4d18")
    assert warc.read_warc(warc.write_warc(df.where("false"), uri + "e"), uri + "e").count() == 0


def test_toxicity(spark, odd, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs_of(spark).join(labels, "doc_id").select("doc_id", "text", "quality", "toxic").collect()
    more = [(1000 + k * 1000 + r.doc_id, r.text + f" n{k}", r.quality, r.toxic) for k in range(6) for r in rows]
    more += [(50_000 + i, f"some plain words number {i} you vile wretch{i % 3} here", 1, 1) for i in range(120)]
    df = spark.createDataFrame(more, "doc_id long, text string, quality int, toxic int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    found = toxicity.toxicity(df.select("doc_id", "text"), df.where(~held).select("doc_id", "quality", "toxic")).join(df.where(held).select("doc_id", F.col("toxic").alias("truth")), "doc_id").collect()
    hits = sum(r.toxic and r.truth for r in found)
    assert hits >= 0.85 * sum(r.truth for r in found) and sum(r.toxic and not r.truth for r in found) <= 0.05 * len(found)
    assert toxicity.toxicity(odd, labels).count() == odd.count() and toxicity.toxicity(none, labels).count() == 0
    assert {r.p_toxic for r in toxicity.toxicity(odd, labels.where("false")).collect()} == {0.0}


def brute_quality(text):
    t = text or ""
    w = WORD.findall(t)
    at = collections.defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {i + k for g in at.values() if len(g) > 1 for i in g for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


@pytest.mark.parametrize("table", ["real", "odd"])
def test_quality_measures(spark, odd, table):
    df = docs_of(spark) if table == "real" else odd
    for r in quality.measured(df.select("doc_id", "text")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(r.text)


def test_quality_cutoffs(spark, odd, none):
    for n, k, p in ((2000, 0, 0.005), (2000, 3, 0.005), (500, 499, 0.9), (10, 10, 0.1), (100_000, 400, 0.005)):
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p)) for j in range(k + 1))
        assert spark.range(1).select(F.expr(quality.binomial_tail(f"{k}L", f"{n}L", p))).first()[0] == pytest.approx(min(exact, 1.0), rel=1e-8)
    text = " ".join(f"word{i}" for i in range(60))
    good = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"), F.lit("en").alias("lang"))
    junk = spark.range(3000, 3100).select(F.col("id").alias("doc_id"), F.lit(text.replace(" ", "# ")).alias("text"), F.lit("en").alias("lang"))
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    kept = {r.doc_id for r in quality.quality_rules(good.union(junk), labels).where("kept").collect()}
    assert kept == set(range(3000))
    few = quality.quality_rules(good.union(junk), labels.where("doc_id < 50"))
    assert few.where("kept").count() == 3100  # too few labels: nothing is rejected
    # one stratum needs ln(0.05) / ln(0.975) = 118.3 labels; the strictest level exceeds all words here
    for n, level in ((118, None), (119, 14)):
        assert [tuple(r) for r in quality.quality_rules(good, labels.where(f"doc_id < {n}")).select("n_good", "level").distinct().collect()] == [(n, level)]
    # P(Bin(1000, 0.025) <= 16) = 0.036, <= 17: 0.060; texts with symbols in half of their words exceed level 4
    for bad, level in ((16, 14), (17, 3)):
        marked = F.when(F.col("doc_id") < bad, F.lit(" ".join(f"w{i}#" if i % 2 else f"w{i}" for i in range(60))))
        found = quality.quality_rules(good.where("doc_id < 1000").withColumn("text", F.coalesce(marked, "text")), labels)
        assert sum(math.comb(1000, j) * 0.025**j * 0.975 ** (1000 - j) for j in range(bad + 1)) <= 0.05 or level == 3
        assert found.select("level").distinct().collect() == [(level,)] and found.where("kept").count() == (1000 - bad if level == 14 else 1000)
    assert quality.keep_good(odd, labels).columns == odd.columns and quality.keep_good(none, labels).count() == 0


def test_token_ids(spark, odd, none):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t, start, want = Tokenizer.from_file(path), 0, []
    for r in sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in sorted(tokenids.token_id_corpus(odd, path).collect(), key=lambda r: r.start)] == want
    assert tokenids.token_id_corpus(none, path).count() == 0


def test_pieces_encode_like_whole_texts():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path, r = P.path("word_bpe_49k.json"), random.Random(2)
    whole, pieces = Tokenizer.from_file(path), tokenids.WordEncoder(path, keep=3000)
    parts = list("abcSTre'’.,!?|<>&*#-_0123 \t\n\r\x0b  éÉİßǅ́̈ﬁ中　‍😀") + ["<|endoftext|>", "<|startoftext|>", "'s", "'re", "don't", "<|ENDOFTEXT|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(6000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    for first, count, data, offs in _text.text_slices(batch, "text", 5000):
        ids, ends = pieces.encode(data, offs)
        for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
            assert ids[a:b].tolist() == whole.encode(texts[first + i], add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 511, 512, 513, 5000])
def test_elias_fano(n):
    r = random.Random(n)
    v = sorted(r.randrange(10 ** r.choice([1, 3, 7])) for _ in range(n))
    e = eliasfano.EliasFano(b"xx" + eliasfano.encode(v) + b"yy", 2)
    assert e.all().tolist() == v and all(e[i] == v[i] for i in r.sample(range(n), min(n, 200)))


def test_part_reader():
    ids = [np.array([70_000, 5, 1], np.uint32), np.array([9, 1], np.uint32)]
    p = tokenids.Part(b"".join(tokenids.part_bytes([None, -4, 12], ids, np.array([1, 3, 5]))))
    assert [p.doc_id(i) for i in range(3)] == [None, -4, 12] and p.ids(1).tolist() == [5, 1] and p.span(2) == (3, 5)


def test_pipeline(spark, tmp_path):
    docs = docs_of(spark)
    first = corpus_pipeline.quality_stage(spark, docs, SF)
    judged = {r.doc_id: r.kept for r in quality.quality_rules(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == {d for d, k in judged.items() if k}
    second = corpus_pipeline.near_duplicate_stage(spark, first, SF).cache()
    want = linked({r.doc_id: shingles(r.text) for r in first.collect()})
    assert {r.doc_id for r in second.collect()} == {d for d, c in want.items() if d == c}
    third = corpus_pipeline.decontamination_stage(spark, second, SF).cache()
    items = [r.text.lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in third.collect()} == {r.doc_id for r in second.collect() if not any(i in r.text.lower() for i in items)}
    fourth = corpus_pipeline.mixing_stage(spark, third, SF)
    assert fourth.columns == docs.columns and {r.doc_id for r in fourth.collect()} < {r.doc_id for r in third.collect()}
    last = corpus_pipeline.token_stage(spark, fourth, SF)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in fourth.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id for r in last.collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, other = queries.queries()[name](spark, SF), c.sql(queries.oracle_sql()[name])
    order = sorted(mine.columns)
    assert sorted(other.columns) == order
    at = [other.columns.index(x) for x in order]
    assert sorted(repr(tuple(r[x] for x in order)) for r in mine.collect()) == sorted(repr(tuple(r[k] for k in at)) for r in other.fetchall())


@pytest.mark.parametrize("table", ["odd", "none"])
def test_pipeline_on_odd_tables(spark, odd, none, tmp_path, table):
    """The whole run over nulls, empty and very long texts, repeated rows and clashing columns, and over an empty table."""
    docs = odd if table == "odd" else none
    docs.withColumn("doc_id", F.col("doc_id")).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("true" if table == "odd" else "false").write.parquet(str(tmp_path / f"{name}.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    good = {r.doc_id for r in docs.collect() if not brute_quality(r.text)[-1]}
    assert {r.doc_id for r in found} <= good and (table == "none" or len(found) > 0)
