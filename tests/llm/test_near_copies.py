"""The pipeline's near-duplicate stage against brute force over five-word shingles."""

import random

import pytest

import corpus_pipeline
from stayflow.llm import near_copies

from .helpers import EDGES, edge_docs, no_docs

SF = "/root/testdata/sf0.001"


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").encode("utf-8").lower().split()
        out.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def kept_by_hand(rows):
    """Ids of the first of each class of (id, text), and the number of pairs of differing sets at 0.8 or more."""
    sets, root, pairs = sets_of([t for _, t in rows]), list(range(len(rows))), 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            common = len(a & b) if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) else 0
            if a == b or common >= 0.8 * (len(a) + len(b) - common):
                pairs += a != b
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {rows[find(r)][0] for r in range(len(rows))}, pairs


def varied(rng):
    """Copies of three texts with more and more words changed, about the threshold on both sides."""
    rows = []
    for base in range(3):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        for copy in range(40):
            own = list(words)
            for at in rng.sample(range(150), rng.randint(0, 6)):
                own[at] = f"x{rng.randrange(5000)}"
            rows.append((base * 100 + copy, " ".join(own)))
    return rows


def test_stage_drops_every_near_copy_that_brute_force_finds(spark):
    rows = varied(random.Random(3))
    want, pairs = kept_by_hand(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()}
    assert pairs > 500 and len(want) > 3 and got == want


def test_candidates_reach_the_threshold():
    rng, hit, all_ = random.Random(4), 0, 0
    for _ in range(300):
        words = [f"w{rng.randrange(9999)}" for _ in range(400)]
        own = list(words)
        for at in rng.sample(range(400), 9):
            own[at] = "x" + own[at]
        a, b = near_copies.shingles(" ".join(words)), near_copies.shingles(" ".join(own))
        same = len(set(a.tolist()) & set(b.tolist()))
        if 0.8 <= same / (len(a) + len(b) - same) < 0.84:
            all_ += 1
            hit += bool(set(near_copies.band_keys(a)) & set(near_copies.band_keys(b)))
    assert all_ > 100 and hit == all_


def test_near_dedup_of_the_small_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    kept = near_copies.near_dedup(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == kept_by_hand(rows)[0]


def test_near_dedup_of_hostile_rows(spark):
    kept = near_copies.near_dedup(edge_docs(spark))
    rows = sorted(((e[0], e[1]) for e in EDGES), key=lambda e: (e[0] is None, e[0] or 0))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(kept_by_hand(rows)[0])
    assert near_copies.near_dedup(no_docs(spark)).count() == 0


def test_shingles_of_long_texts_in_chunks(monkeypatch):
    rng = random.Random(7)
    text = " ".join("".join(rng.choice("abCé1") for _ in range(rng.randint(1, 9))) for _ in range(900))
    whole = near_copies.shingles(text).tolist()
    monkeypatch.setattr(near_copies.word_chunks, "__defaults__", (16,))
    assert near_copies.shingles(text).tolist() == whole


def copies_of_one(words, n, changes, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    rows = []
    for i in range(n):
        own = list(base)
        for at in rng.sample(range(words), rng.randint(*changes)):
            own[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("words, changes", [(45, (1, 4)), (200, (2, 14)), (200, (0, 8))])
def test_candidates_follow_the_links_in_large_groups(spark, monkeypatch, words, changes):
    seen = []
    plain = near_copies._linked

    def counted(pairs, sets, similarity):
        seen.append(pairs.count())
        return plain(pairs, sets, similarity)

    monkeypatch.setattr(near_copies, "_linked", counted)
    total = {}
    for n in (200, 400):
        rows = copies_of_one(words, n, changes, 5)
        seen.clear()
        got = {r["doc_id"] for r in near_copies.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == kept_by_hand(rows)[0]
        total[n] = sum(seen)
    # all pairs would be 79,800
    assert total[400] < 5_000 and total[400] < 3 * total[200] + 500


def test_prefix_filter_loses_no_link(spark):
    rows = copies_of_one(60, 120, (0, 5), 9)
    sets = [near_copies.shingles(t).view("int64").tolist() for _, t in rows]
    tokens = spark.createDataFrame([(i, len(s), i, x) for i, s in enumerate(sets) for x in s], "fp long, n long, class long, shingle long")
    held = [(i, s, near_copies.sketch(near_copies.shingles(t)).tolist()) for i, (s, (_, t)) in enumerate(zip(sets, rows))]
    table = spark.createDataFrame(held, "fp long, shingles array<long>, sketch array<long>")
    got = {(r["u"], r["v"]) for r in near_copies._prefix_pairs(tokens, table, 0.8).collect()}
    own = [set(s) for s in sets]
    linked = {(i, j) for i in range(120) for j in range(i) if own[i] != own[j] and len(own[i] & own[j]) / len(own[i] | own[j]) >= 0.8}
    assert len(linked) > 100 and linked <= got


def test_sketches_bound_the_difference():
    rng = random.Random(1)
    for n in (0, 3, 40, 700):
        base = [rng.getrandbits(64) for _ in range(n)]
        a, b = (near_copies.np.unique(near_copies.np.array(base + [rng.getrandbits(64) for _ in range(k)], "uint64")) for k in (5, 30))
        bits = int(near_copies.np.bitwise_count(near_copies.sketch(a) ^ near_copies.sketch(b)).sum())
        assert 0 < bits <= len(set(a.tolist()) ^ set(b.tolist()))


def test_what_simhash_links_is_verified_beside_the_keys(spark, monkeypatch):
    words = [f"w{k}" for k in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, "far " * 3 + " ".join(reversed(words))), (4, None), (5, " ")]
    docs, calls, plain = spark.createDataFrame(rows, "doc_id long, text string"), [], near_copies.simhash.links
    monkeypatch.setattr(near_copies.simhash, "links", lambda *a: calls.append(1) or plain(*a))
    monkeypatch.setattr(near_copies, "band_keys", lambda found: [])  # candidates of the fingerprints alone
    got = {r["doc_id"] for r in near_copies.near_dedup(docs).collect()}
    near = bin((near_copies.simhash.fingerprint(rows[0][1]) ^ near_copies.simhash.fingerprint(rows[1][1])) & (2**64 - 1)).count("1") <= 4
    assert near and calls and got == {1, 3, 4}
