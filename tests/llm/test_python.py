"""Operators 1, 4, 5, 6, 7 and 9."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayflow.llm import components, decontaminate, language_id, quality, simhash, substring_dedup, token_counts

from .helpers import EDGES, LOWER, SCHEMA, edge_docs, linked, no_docs
from .helpers import simhash as simhash_by_hand

ASCII_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_components_of_random_graphs_and_of_a_chain(spark):
    rng = random.Random(4)
    for edges in ([(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)], [(i, i + 1) for i in range(70)], [(5, 5)], []):
        parent = {}

        def find(x, parent=parent):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got == {x: find(x) for x in parent if find(x) != x}


def near(rng, base, most):
    for b in rng.sample(range(64), rng.randint(0, most)):
        base ^= 1 << b
    return base


@pytest.mark.parametrize("hot", [1024, 4])
def test_links_join_just_what_brute_force_joins(spark, hot):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(60)}
    for center in [rng.getrandbits(64), 0, (1 << 64) - 1]:
        values |= {near(rng, center, 5) for _ in range(80)}
    values = sorted(values)
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    edges = simhash.links(fps, hot)
    for r in edges.collect():
        assert (r["u"] ^ r["v"]).bit_count() <= 4 if (r["u"] < 0) == (r["v"] < 0) else ((r["u"] ^ r["v"]) & (2**64 - 1)).bit_count() <= 4
    root = {r["node"]: r["root"] for r in components.components(edges).collect()}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    classes = [root.get(s, s) for s in signed]
    want = linked(values)
    assert len(set(zip(classes, want, strict=True))) == len(set(classes)) == len(set(want))


def test_each_link_is_reported_once_without_hot_keys(spark):
    rng = random.Random(6)
    values = sorted({near(rng, 0, 4) for _ in range(150)})
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    got = [tuple(r) for r in simhash.links(fps).collect()]
    pairs = sum((a ^ b).bit_count() <= 4 for i, a in enumerate(values) for b in values[:i])
    assert len(got) == len(set(got)) == pairs


def test_fingerprints_of_long_texts_in_chunks(monkeypatch):
    rng = random.Random(7)
    text = " ".join("".join(rng.choice("abCé1") for _ in range(rng.randint(1, 9))) for _ in range(900))
    whole = simhash.fingerprint(text) & (2**64 - 1)
    assert whole == simhash_by_hand(text)
    monkeypatch.setattr(simhash.word_chunks, "__defaults__", (64,))
    assert simhash.fingerprint(text) & (2**64 - 1) == whole


def test_classes_and_dedup_of_hostile_rows(spark):
    docs = edge_docs(spark)
    got = simhash.simhash_classes(docs).collect()
    order = sorted(EDGES, key=lambda e: (e[0] is None, e[0] or 0))
    prints = [simhash_by_hand(e[1]) for e in order]
    want = Counter((e[0], f"{p:016x}", order[r][0]) for e, p, r in zip(order, prints, linked(prints), strict=True))
    assert Counter(tuple(r) for r in got) == want
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({order[r][0] for r in linked(prints)})
    assert simhash.near_dedup(no_docs(spark)).count() == simhash.simhash_classes(no_docs(spark)).count() == 0


def hits_by_hand(docs, items):
    windows = {}
    for item, text in items:
        w = ASCII_WORD.findall((text or "").translate(LOWER))
        size = min(10, len(w))
        for i in range(len(w) - size + 1) if size else ():
            windows.setdefault(tuple(w[i : i + size]), set()).update([item] if item is not None else [])
    out = []
    for d in docs:
        w = ASCII_WORD.findall((d[1] or "").translate(LOWER))
        hit, found = set(), set()
        for window, owners in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found |= owners
        out.append((d[0], len(w), len(hit), ",".join(sorted(map(str, found)))))
    return Counter(out)


def contaminated_rows():
    rng = random.Random(8)
    words = ["the", "Of", "été", "a1", "x", "y", "z"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), None, None, None) for i in range(60)]
    items = [(9, "Secret, OF-x"), (10, None), (11, ""), (12, "été z z"), (None, "y y y"), (9, "Secret, OF-x")]
    items += [(100 + i, rows[i][1][: rng.randint(30, 80)].upper().replace("É", "é")) for i in range(6)]
    rows.append((77, "Before secret of X! after, secret of. x", None, None, None))
    return rows + [rows[-1]], items


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_contamination_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rows, items = contaminated_rows()
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench).collect()
    assert Counter((r["id"], r["n_words"], len(r["hits"]), ",".join(r["items"])) for r in got) == hits_by_hand(rows, items)


def test_hit_documents_or_spans_go(spark):
    docs = edge_docs(spark).unionByName(edge_docs(spark).where("doc_id = 8").withColumn("text", F.lit("Say: One two three FOUR five, six. Été")).withColumn("doc_id", F.lit(99)))
    bench = spark.createDataFrame([(1, "one TWO three four five")], "item_id long, text string")
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(EDGES) - 2
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminated(docs, bench, mode="span").collect()}
    assert cut[99] == "Say: , six. Été" and cut[8] == "" and cut[3] is None and cut[6] == "one"
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminated(docs, none).count() == len(EDGES) + 1
    assert decontaminate.contamination(no_docs(spark), bench).count() == 0


def test_scan_finds_windows_across_chunks(monkeypatch):
    windows = decontaminate.Windows([("i", "b c d e f g h i j k l m")])
    text = "a b c d e f g h i j k l m n"
    whole = windows.scan(text)
    monkeypatch.setattr(decontaminate, "CHUNK", 3)
    assert windows.scan(text) == whole == (14, list(range(1, 13)), {"i"})


def cut_by_hand(rows, ends=r"[.!?,;:](?=[\x20\x09-\x0D])|\n", least=2, run_words=25):
    """(id, text) in rank order -> spans and text left, unit by unit."""
    seen, out = set(), []
    for _, text in rows:
        if text is None:
            out.append(([], None))
            continue
        edges = [0, *(m.end() for m in re.finditer(ends, text)), len(text)]
        run, spans, flags = [], [], []
        for s, e in zip(edges, edges[1:]):
            words = text[s:e].translate(LOWER).encode().split()
            if len(words) >= least:
                key = b" ".join(words)
                flags.append((s, e, len(words), key in seen))
                seen.add(key)
        for s, e, n, again in [*flags, (0, 0, 0, False)]:
            if again:
                run.append((s, e, n))
            else:
                if run and sum(n for *_, n in run) >= run_words:
                    spans.append((run[0][0], run[-1][1]))
                run = []
        kept, at = "", 0
        for s, e in spans:
            kept, at = kept + text[at:s], e
        out.append((spans, kept + text[at:]))
    return out


def test_repeated_runs_of_clauses_equal_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [rng.choice(["alpha", "Beta", "gamma", "é", "x1"]) + str(k) for k in range(60)]
    passages = [" ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", ".", "!", "\n", ";"]) for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(60):
        own = lambda: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ". ", ","]) for _ in range(rng.randint(0, 40)))
        rows.append((i, own() + rng.choice(["", ". " + rng.choice(passages) + " ", rng.choice(passages)[:150] + ". "]) + own(), None, None, None))
    rows += [(60, None, None, None, None), (61, "", None, None, None), (None, passages[0], None, None, None), (62, passages[0], None, None, None)]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for run_words in (25, 5):
        want = {r[0]: w for r, w in zip(order, cut_by_hand([(r[0], r[1]) for r in order], run_words=run_words))}
        got = substring_dedup.dedup_units(spark.createDataFrame(rows, SCHEMA).repartition(4), run_words=run_words).collect()
        assert {r["doc_id"]: ([tuple(s) for s in r["removed"]], r["text"]) for r in got} == want
        assert sum(bool(w[0]) for w in want.values()) > 10


def test_units_of_lines_paragraphs_and_hostile_rows(spark):
    rows = [
        (2, "Shared  line of words\nown line of two\nshared line of words\nx y", None, None, None), (1, "SHARED line of words", None, None, None),
        (3, "x y\nown line of two", None, None, None), (3, "x y\nown line of two", None, None, None), (4, None, None, None, None),
    ]
    got = {r["doc_id"]: r for r in substring_dedup.dedup_units(spark.createDataFrame(rows, SCHEMA), unit="line", min_words=3, run_words=3).collect()}
    assert got[1]["text"] == rows[1][1] and got[2]["text"] == "own line of two\nx y" and got[3]["text"] == "x y\n" and got[4]["text"] is None
    assert [tuple(s) for s in got[2]["removed"]] == [(0, 22), (38, 59)] and got[2]["kept_in"] == [1] and got[3]["kept_in"] == [2]
    rows = [(1, "a b c\nd e f\n\ng h i", None, None, None), (2, "z\n\na b c\nd e f\n\n", None, None, None)]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.dedup_units(spark.createDataFrame(rows, SCHEMA), unit="paragraph", run_words=5).collect()}
    assert got == {1: rows[0][1], 2: "z\n\n"}
    out = substring_dedup.dedup_units(edge_docs(spark), run_words=5)
    assert out.count() == len(EDGES) and substring_dedup.dedup_units(no_docs(spark)).count() == 0
    assert {r["doc_id"] for r in out.where(F.size("removed") > 0).collect()} == {2, 9}


def test_many_affected_documents_are_joined_by_a_shuffle(spark, monkeypatch):
    docs = edge_docs(spark)
    want = sorted(map(str, substring_dedup.dedup_units(docs, run_words=5).collect()))
    monkeypatch.setattr(substring_dedup, "BROADCAST_ROWS", 0)
    assert sorted(map(str, substring_dedup.dedup_units(docs, run_words=5).collect())) == want


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return public_tokenizers.path("byte_bpe_50k.json"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts_equal_the_library(spark):
    path, library = tokenizer()
    rows = [*EDGES, (50, "a <|endoftext|> b" * 3, "en", "a", 1), (51, "don't  stop…\n\n  now 42", "en", "a", 1)]
    got = token_counts.token_counts(spark.createDataFrame(rows, SCHEMA), path).collect()
    want = Counter((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False))) for r in rows)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    assert token_counts.token_counts(no_docs(spark), path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_parts_of_a_text_count_like_the_whole(seed):
    _, library = tokenizer()
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "a", " ", "\n", "12 ", "don't ", "é ", "<|endoftext|>", "!", " x y "]) for _ in range(800))
    parts = list(token_counts.parts(text, 20))
    assert "".join(parts) == text and len(parts) > 5
    count = lambda t: len(library.encode(t, add_special_tokens=False))
    assert sum(map(count, parts)) == count(text)


def test_sentence_pieces_are_counted_whole(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(spark.createDataFrame([(1, "Some words here.", "", "", 1), (2, None, "", "", 1)], SCHEMA), path).collect()}
    assert got == {1: len(library.encode("Some words here.")), 2: 0}


def test_ngrams_of_all_words_are_those_of_each():
    found = ["abc", "été", "x", "abc", "longerword"]
    buckets, owner = language_id.hashed(found)
    for i, w in enumerate(found):
        alone, _ = language_id.hashed([w])
        assert sorted(buckets[owner == i]) == sorted(alone)
        assert len(alone) == sum(max(0, len(w) + 2 - n + 1) for n in language_id.GRAMS) + 1
    assert 0 <= buckets.min() and buckets.max() < language_id.BUCKETS
    assert len(set(language_id.hashed([f"w{i}" for i in range(3000)])[0])) > 2000


SYLLABLES = {"en": ["the", "ing", "and", "th", "wh"], "fr": ["eau", "que", "ou", "é", "les"], "de": ["sch", "und", "ein", "ü", "ich"]}


def prose(spark, n=240):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 60))]
        rows.append((i, " ".join(words), lang, "s", 1))
    return spark.createDataFrame(rows + [(900, "123 !!", "en", "s", 1), (901, None, "en", "s", 1), (None, "the and", None, None, None)], SCHEMA)


def test_languages_of_held_out_texts(spark):
    docs = prose(spark)
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id < 900 AND held_out").collect()
    assert len(got) > 40 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    odd = {r["doc_id"]: r for r in language_id.identify(docs).where("doc_id >= 900 OR doc_id IS NULL").collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (900, 901)) and odd[None]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in odd.values())


def test_texts_without_a_letter_have_no_language(spark):
    model = language_id.train(prose(spark))
    assert [language_id.predict_text(model, t) for t in ("½ ²", "Ⅷ", "①", "12 _ !", "", None)] == [("und", 0.0)] * 6
    assert language_id.words("the½ing ①und Ⅷ the") == Counter({"the": 2, "ing": 1, "und": 1})


def test_prediction_equals_a_plain_loop(spark):
    docs = prose(spark)
    model = language_id.train(docs)
    for r in docs.where("text IS NOT NULL").collect()[:200]:
        found = re.findall(r"[^\W\d_]+", r["text"].lower())
        buckets = [int(b) for w in found for b in language_id.hashed([w])[0]]
        if not buckets:
            continue
        z = (sum(model.logits[b].astype(float) for b in buckets) / len(buckets) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        lang, score = language_id.predict_text(model, r["text"])
        assert lang == model.languages[int(p.argmax())] and score == pytest.approx(p.max(), abs=1e-5)


def test_language_is_no_input_of_its_prediction(spark):
    docs = prose(spark)
    model = language_id.train(docs)
    as_is = sorted(map(str, language_id.predict(docs, model, id=F.col("doc_id")).collect()))
    blind = docs.withColumn("lang", F.lit(None)).withColumn("source", F.lit("q"))
    assert sorted(map(str, language_id.predict(blind, model, id=F.col("doc_id")).collect())) == as_is


def test_languages_without_labels_or_rows(spark):
    bare = prose(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(bare).collect()} == {"und"}
    assert language_id.identify(no_docs(spark)).count() == 0
    assert language_id.identify(edge_docs(spark)).count() == len(EDGES)


def graded(spark, n=400):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 60))]
        text = " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, "en", rng.choice(["a", "b", None]), 1))
        if i % 2:
            labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + [(None, 1, 0), (1, None, 0), labels[0]], "doc_id long, quality int, toxic int"), rows


def test_quality_keeps_clean_documents(spark):
    docs, labels, rows = graded(spark)
    got = {r["doc_id"]: r for r in quality.quality(docs, labels, F.col("source"), F.col("lang")).collect()}
    assert len(got) == len(rows) and all(got[r[0]]["keep"] == r[1].endswith(".") for r in rows)
    kept = quality.quality_filter(docs, labels, F.col("source"), F.col("lang"))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["keep"]}


def test_sparse_sites_shrink_toward_their_parents(spark):
    rows = [("big", "x", 0.9)] * 50 + [("big", "y", 0.1)] * 50 + [("lone", "z", 0.1)] + [("other", "w", 0.8)] * 60
    table = spark.createDataFrame([(h, p, v + (i % 5 - 2) * 0.02) for i, (h, p, v) in enumerate(rows)], "host string, path string, p double")
    s = quality.sites(table)
    got = {(r["host"], r["path"]): r for r in quality.judged(table, s, s.mean).collect()}
    assert abs(s.mean - got["lone", "z"]["p_host"]) < 1e-9 and abs(s.mean - got["lone", "z"]["p_path"]) < 1e-9
    assert got["big", "x"]["p_path"] > 0.8 and got["big", "y"]["p_path"] < 0.2 and 0.4 < got["big", "x"]["p_host"] < 0.6


def test_quality_of_hostile_rows_and_without_labels(spark, monkeypatch):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = edge_docs(spark)
    out = quality.quality_filter(docs, none, F.col("source"), F.col("lang"))
    assert out.columns == docs.columns and out.count() == len(EDGES)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (10, 0, 0)], "doc_id long, quality int, toxic int")
    few = quality.quality(docs, labels, F.col("source"), F.col("lang"))
    assert few.count() == len(EDGES)
    assert quality.quality(no_docs(spark), labels, F.col("source"), F.col("lang")).count() == 0
    monkeypatch.setattr("stayflow.llm.common.BROADCAST_ROWS", 0)
    assert quality.quality(docs, labels, F.col("source"), F.col("lang")).count() == len(EDGES)


def posteriors_by_hand(rows, prior):
    """(host, path, p) rows -> (p_host, p_path, posterior), sums in dictionaries."""
    hosts, paths = {}, {}
    for h, t, p in rows:
        for table, key in ((hosts, h), (paths, (h, t))):
            n, s, ss = table.get(key, (0, 0.0, 0.0))
            table[key] = (n + 1, s + p, ss + p * p)
    mean = sum(p for *_, p in rows) / len(rows)

    def weight(table, parent):
        big = {k: v for k, v in table.items() if v[0] > 1}
        n = sum(v[0] for v in big.values())
        if n <= len(big):
            return quality.MOST_PRIOR
        within = sum(ss - s * s / m for m, s, ss in big.values()) / (n - len(big))
        spread = sum(m * (s / m - parent(k)) ** 2 for k, (m, s, _) in big.items())
        between = (spread - len(big) * within) / n
        return quality.MOST_PRIOR if between <= 0 else min(quality.MOST_PRIOR, max(quality.LEAST_PRIOR, within / between))

    a = weight(hosts, lambda _: mean)
    b = weight(paths, lambda k: (hosts[k[0]][1] + a * mean) / (hosts[k[0]][0] + a))
    logit = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    out = []
    for h, t, p in rows:
        p_host = (hosts[h][1] - p + a * mean) / (hosts[h][0] - 1 + a)
        p_path = (paths[h, t][1] - p + b * p_host) / (paths[h, t][0] - 1 + b)
        out.append((p_host, p_path, 1 / (1 + math.exp(-(logit(p) + logit(p_path) - logit(prior))))))
    return out


def test_posteriors_equal_two_dictionaries(spark):
    docs, labels, _ = graded(spark)
    got = quality.quality(docs, labels, F.col("source"), F.pmod("doc_id", F.lit(7)).cast("string")).collect()
    prior = quality.train(docs, labels).prior
    want = posteriors_by_hand([(r["host"], r["path"], r["p"]) for r in got], prior)
    assert {r["host"] for r in got} == {"a", "b", None}
    for r, (p_host, p_path, posterior) in zip(got, want):
        assert (r["p_host"], r["p_path"], r["posterior"]) == (pytest.approx(p_host), pytest.approx(p_path), pytest.approx(posterior))
        assert r["keep"] == (r["posterior"] >= quality.KEEP_FROM)
