"""Operator 13 against a brute-force model that counts in dictionaries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict



from stayflow.llm import ngram_lm

from .helpers import EDGES, LOWER, WORD, edge_docs, no_docs

SF = "/root/testdata/sf0.001"


def tokens_of(text):
    return [*re.findall(WORD, (text or "").translate(LOWER)), None]


def in_training(id_):
    return zlib.crc32(("" if id_ is None else str(id_)).encode()) % 7 != 2


def discounts(counts):
    n = Counter(min(c, 5) for c in counts)
    if not all(n[k] for k in (1, 2, 3, 4)):
        return [0, 0.5, 0.5, 0.5]
    y = n[1] / (n[1] + 2 * n[2])
    raw = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3])
    return [0, *[min(max(d, 0.1), k) for k, d in enumerate(raw, 1)]]


class ByHand:
    def __init__(self, rows):
        self.words, self.pairs = Counter(), Counter()
        for id_, text in rows:
            if in_training(id_):
                found = tokens_of(text)
                self.words.update(found)
                self.pairs.update(zip(["begin", *[("w", t) for t in found[:-1]]], found))
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.follows = Counter(w for _, w in self.pairs)
        self.next = defaultdict(Counter)
        for (a, w), c in self.pairs.items():
            self.next[a][w] = c
        self.high, self.low = discounts(self.pairs.values()), discounts(self.follows.values())
        self.left = sum(self.low[min(c, 3)] for c in self.follows.values()) / max(1, len(self.pairs))
        self.of = {a: (sum(own.values()), sum(self.high[min(c, 3)] for c in own.values())) for a, own in self.next.items()}

    def alone(self, w):
        c = self.follows[w]
        return max(c - self.low[min(c, 3)], 0) / len(self.pairs) + self.left / (self.v + 1)

    def after(self, a, w):
        own = self.next.get(a)
        if not own:
            return self.alone(w)
        total, back = self.of[a]
        return max(own[w] - self.high[min(own[w], 3)], 0) / total + back / total * self.alone(w)

    def row(self, text):
        found = tokens_of(text)
        base = sum(math.log10((self.words[t] + 1) / (self.n + self.v + 1)) for t in found)
        score = sum(math.log10(self.after(a, w)) for a, w in zip(["begin", *[("w", t) for t in found[:-1]]], found))
        return len(found), sum(self.words[t] > 0 for t in found), self.n, base, score


def close(a, b):
    return abs(a - b) <= 1e-9 * max(1, abs(b))


def compare(rows, got):
    model = ByHand(rows)
    want = Counter((i, not in_training(i), *model.row(t)[:3], round(model.row(t)[3], 6), round(model.row(t)[4], 6)) for i, t in rows)
    assert Counter((r[0], r[1], r[2], r[3], r[4], round(r[5], 6), round(r[6], 6)) for r in got) == want


def test_whole_table_equals_brute_force(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    compare(rows, ngram_lm.language_scores(docs).collect())
    # many small files, packets and parts of texts change nothing
    for name, value in (("BLOCK", 1 << 10), ("WORDS", 1 << 11), ("COUNTED", 500), ("CHUNK", 300), ("KNOWN", 64)):
        monkeypatch.setattr(ngram_lm, name, value)
    compare(rows, ngram_lm.language_scores(docs.repartition(3)).collect())


def test_probabilities_of_all_next_words_add_up_to_one(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 30)))) for i in range(80)]
    model = ngram_lm.train(spark.createDataFrame(rows, "doc_id long, text string"))
    scorer = ngram_lm.Scorer(model)
    every = ngram_lm.np.arange(-1, scorer.v)
    for first in range(-1, scorer.v + 1):
        p = scorer.after(ngram_lm.np.full(len(every), first), every)
        assert p.min() > 0 and abs(p.sum() - 1) < 1e-9


def test_trained_text_is_likelier_than_shuffled_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200")
    model = ngram_lm.train(docs)
    held = [t for i, t in docs.select("doc_id", "text").collect() if not in_training(i)][:40]
    rng = random.Random(1)
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in held]
    scorer = ngram_lm.Scorer(model)
    own, other = scorer.texts(held), scorer.texts(mixed)
    assert sum(a > b for a, b in zip(own[:, 3], other[:, 3])) >= 38
    assert own[:, 3].sum() > own[:, 2].sum()


def test_hostile_rows(spark):
    got = ngram_lm.language_scores(edge_docs(spark)).collect()
    compare([(e[0], e[1]) for e in EDGES], got)
    assert ngram_lm.language_scores(no_docs(spark)).count() == 0
    held = [(i, "a b") for i in range(200) if not in_training(i)][:3]
    rows = ngram_lm.language_scores(spark.createDataFrame(held, "doc_id long, text string")).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) for r in rows] == [(3, 0, 0, 0.0)] * 3


def test_arrays_through_another_file_system(spark, tmp_path, monkeypatch):
    """Where the folder is not mounted, arrays are fetched, mapped and unlinked."""
    from pyarrow import fs

    monkeypatch.setattr(ngram_lm, "_reader", lambda uri: (fs.LocalFileSystem(), uri))
    values = ngram_lm.np.arange(1000)
    ngram_lm.stored(str(tmp_path / "m"), "a", values)
    assert (ngram_lm.mapped(str(tmp_path / "m"), "a", "i8") == values).all()


