"""Operators 11 and 12 against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stayflow.llm import resample, spelling

from .helpers import EDGES, LOWER, edge_docs, no_docs

SF = "/root/testdata/sf0.001"
FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, gram=1):
    words = FEATURE.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, gram + 1) for i in range(len(words) - n + 1)]


def scores_by_hand(rows, goal, gram=1, buckets=10000, least=20, percent=10):
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(at(f) for _, t in rows for f in features(t, gram)[1])
    t = Counter(at(f) for x in goal for f in features(x, gram)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, text in rows:
        words, found = features(text, gram)
        weight = sum(gain(at(f)) for f in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return out


@pytest.mark.parametrize("gram, percent, least", [(1, 10, 20), (3, 37, 0), (1, 100, 5), (1, 0, 0)])
def test_draw_equals_brute_force(spark, gram, percent, least):
    docs, goal = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = resample.resample(docs.repartition(3), goal, percent=percent, least_words=least, gram=gram).collect()
    want = scores_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in goal.collect()], gram, least=least, percent=percent)
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def test_draw_from_hostile_rows(spark):
    goal = spark.createDataFrame([("one word été",), (None,)], "text string")
    got = resample.resample(edge_docs(spark), goal, least_words=1, percent=50).collect()
    want = scores_by_hand([(e[0], e[1]) for e in EDGES], ["one word été"], least=1, percent=50)
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))
    assert resample.resample(no_docs(spark), goal).count() == 0
    assert resample.resample(edge_docs(spark), goal.limit(0)).count() == len(EDGES)


def test_bracket_is_widened_until_it_holds_the_cutoff(spark):
    rng = random.Random(3)
    rows = [(i, i, rng.choice([5, rng.randrange(10**6)])) for i in range(3000)]
    scores = spark.createDataFrame(rows, "id long, digest long, score long")
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    for k in (1, 2, 299, 1500, 1501, 2990, 3000):
        for error in (0.0001, 0.01, 0.3):
            got = {r["id"] for r in scores.where(resample.cutoff(scores, k, 3000, error)).collect()}
            assert got == {r[0] for r in order[:k]}
    sketch = type(scores).approxQuantile
    try:  # a sketch that is plainly wrong costs further rounds and no result
        type(scores).approxQuantile = lambda self, c, p, e: [x - 1e5 if e < 0.05 else x for x in sketch(self, c, p, e)]
        assert {r["id"] for r in scores.where(resample.cutoff(scores, 40, 3000, 0.001)).collect()} == {r[0] for r in order[:40]}
    finally:
        type(scores).approxQuantile = sketch


def test_runs_of_words_in_chunks(monkeypatch):
    text = " ".join(random.Random(2).choice(["a", "bé", "c3", "dd-dd"]) for _ in range(500))
    whole = np.sort(np.concatenate([f for _, f in resample.bucket_chunks(text, 3)]))
    monkeypatch.setattr(resample, "CHUNK", 40)
    parts = list(resample.bucket_chunks(text, 3))
    assert len(parts) > 20 and (np.sort(np.concatenate([f for _, f in parts])) == whole).all()


# ---------------------------------------------------------------- spelling


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_by_hand(rows, damage=199, letters=6, count=5, dominance=5):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % damage else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= count}
    form, near = {}, {}
    for w in n:
        near[w] = [x for x in n if is_near(w, x)]
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= dominance * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def damaged(rng, n):
    words = ["".join(rng.choice("abcdeé÷") for _ in range(rng.randint(3, 9))) for _ in range(40)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(words[: rng.randint(1, 40)])
            k = rng.randrange(len(w))
            w = rng.choice([w] * 6 + [w[:k] + rng.choice("abß") + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + "c" + w[k:]])
            text.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("damage, count, dominance", [(199, 5, 5), (7, 2, 2)])
def test_variants_equal_brute_force(spark, damage, count, dominance):
    rows = damaged(random.Random(damage), 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = spelling.variants(docs, damage=damage, letters=4, count=count, dominance=dominance).collect()
    want = variants_by_hand(rows, damage, 4, count, dominance)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100
    assert any(r["form"] and r["root"] != r["form"] for r in got) or dominance == 5


def search(words):
    """Near pairs of one table of words, as the tasks find them."""
    words = [w.encode("latin-1") for w in words]
    rows = []
    for k, w in enumerate(words):
        counts = spelling.vectors([w])[0]
        for part in range(spelling.PARTS):
            top = counts[spelling.PART_OF == part].tobytes()
            rows += [((part, top, len(w) + s), part, s, k) for s in (0, 1)]
    number = {r: i for i, r in enumerate(sorted({r[0] for r in rows}))}
    rows.sort(key=lambda r: number[r[0]])
    route, part, shorter = (np.array(x, np.int64) for x in zip(*[(number[r[0]], r[1], r[2]) for r in rows]))
    own = [words[r[3]] for r in rows]
    out = []
    for i, j in spelling.near_pairs(route, part, shorter, own):
        out += [tuple(sorted((own[a].decode("latin-1"), own[b].decode("latin-1")))) for a, b in zip(i.tolist(), j.tolist())]
    return out


@pytest.mark.parametrize("held, leaf", [(400_000, 64), (7, 1), (400_000, 1)])
def test_trie_reports_every_near_pair_once(monkeypatch, held, leaf):
    monkeypatch.setattr(spelling, "HELD", held)
    monkeypatch.setattr(spelling, "LEAF", leaf)
    rng = random.Random(held + leaf)
    words = sorted({"".join(rng.choice("abcÀÄé" if rng.random() < 0.9 else "xyzw") for _ in range(rng.randint(1, 6))) for _ in range(250)})
    got = search(words)
    want = {(a, b) for k, a in enumerate(words) for b in words[k + 1 :] if is_near(a, b)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_blocks_of_few_rows_find_the_same(spark, monkeypatch):
    rows = damaged(random.Random(6), 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = spelling.word_counts(docs, letters=4, count=1).persist()
    want = sorted(map(str, spelling.near_words(words).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(str, spelling.near_words(words).collect())) == want and len(want) > 50
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        words.unpersist()


def test_spelling_of_hostile_rows(spark):
    rows = [(e[0], e[1]) for e in EDGES]
    got = spelling.variants(edge_docs(spark), letters=3, count=1, dominance=2).collect()
    assert {tuple(r) for r in got} == variants_by_hand(rows, letters=3, count=1, dominance=2) and got
    with pytest.raises(ValueError):
        spelling.variants(edge_docs(spark), dominance=1)
    assert spelling.variants(no_docs(spark)).count() == 0
    long = "ab" * 50000
    text = f"{long} {long} {long}a x{long[1:]} " * 5
    got = spelling.variants(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert {(len(r["word"]), r["n"], r["n_near"]) for r in got} == {(100000, 10, 2), (100001, 5, 1), (100000, 5, 1)}
