"""Operators 2, 3, 8 and 10."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stayflow.llm import exact_dedup, line_dedup, mixing, sharding

from .helpers import BLANK, CLASHES, EDGES, SCHEMA, WORD, edge_docs, no_docs


def size_of(text):
    return len((text or "").encode()) + 1


def test_places_are_gapless_and_sizes_near_equal(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 4000), None, None, None) for i in range(2000)]
    got = sharding.shard_places(spark.createDataFrame(rows, SCHEMA), 16).collect()
    assert len(got) == 2000
    load, places = Counter(), defaultdict(list)
    for r in got:
        text = rows[r["doc_id"]][1]
        assert r["size"] == size_of(text) and r["text_crc32"] == zlib.crc32(text.encode())
        load[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert set(load) == set(range(16)) and max(load.values()) <= 1.002 * min(load.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_shards_of_hostile_rows(spark):
    got = sharding.shard_places(edge_docs(spark), 3).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((e[0], size_of(e[1])) for e in EDGES)
    for s in range(3):
        places = sorted(r["slot"] for r in got if r["shard"] == s)
        assert places == list(range(len(places)))
    out = sharding.shard_documents(edge_docs(spark), 3)
    assert out.count() == len(EDGES) and out.schema["shard"].dataType.typeName() == "integer"
    assert set(CLASHES) <= set(out.columns)
    assert sharding.shard_places(no_docs(spark), 4).count() == 0


def test_one_record_a_third_of_all_rows_keeps_its_places_apart(spark):
    docs = spark.range(900).select(F.when(F.col("id") < 300, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.shard_places(docs, 4).groupBy("shard").agg(F.count_distinct("slot").alias("d"), F.count(F.lit(1)).alias("n"), F.max("slot").alias("m")).collect()
    assert all(r["d"] == r["n"] == r["m"] + 1 for r in got) and sum(r["n"] for r in got) == 900


def test_rebalancing_moves_little_and_versions_stay(spark):
    rng = random.Random(2)
    size = [rng.randint(1, 1000) for _ in range(512)]
    rows = sharding.SlotMap(spark.conf.get("spark.checkpoint.dir") + f"/map-{rng.random()}", 1, sharding.rebalanced([s % 8 for s in range(512)], size, 8), size, [1] * 512).store(spark)
    more = sharding.grown(rows, spark, 9)
    load = Counter()
    for s, shard in enumerate(more.shards):
        load[shard] += size[s]
    assert max(load.values()) <= 1.01 * min(load.values())
    moved = sum(a != b for a, b in zip(rows.shards, more.shards, strict=True))
    assert moved <= 512 / 9 * 1.6
    assert sharding.load_map(spark, rows.path, 1).shards == rows.shards
    assert sharding.load_map(spark, rows.path).version == 2


def fill(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = share * sum(sizes.values())
    full = {}
    while True:
        open_ = [s for s in names if s not in full]
        left, w = total - sum(full.values()), sum(weight[s] for s in open_)
        target = {s: left * weight[s] / w for s in open_}
        above = [s for s in open_ if target[s] > cap * sizes[s]]
        if not above:
            return full | target
        full |= {s: cap * sizes[s] for s in above}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_equal_repeated_sharing(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 100, rng.randint(1, 10**6)]) for i in range(12)} | {None: 50}
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(table).collect()}
    want = fill(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)


def test_mix_follows_its_rates_and_repeats_itself(spark):
    rows = [(i, "w " * (1 + i % 40), "en", f"s{i % 5}" if i % 3 else "big", i) for i in range(6000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.mix_plan(docs).persist()
    for r in plan.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") / F.col("size")).alias("times")).collect():
        assert abs(r["taken"] - r["target"]) < 0.1 * r["target"] and r["times"] <= 2
    copies = {r["doc_id"]: r["copies"] for r in plan.collect()}
    assert Counter(r["doc_id"] for r in mixing.mix(docs).collect()) == Counter({k: v for k, v in copies.items() if v})
    assert {r["doc_id"]: r["copies"] for r in mixing.mix_plan(docs.repartition(7)).collect()} == copies


def test_mix_of_hostile_rows_and_of_many_sources(spark, monkeypatch):
    docs = edge_docs(spark)
    plan = mixing.mix_plan(docs)
    assert Counter((r["doc_id"], r["size"]) for r in plan.collect()) == Counter((e[0], len(re.findall(WORD, e[1] or ""))) for e in EDGES)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix_plan(no_docs(spark)).count() == 0
    monkeypatch.setattr("stayflow.llm.common.BROADCAST_ROWS", 0)
    assert sorted(map(str, mixing.mix_plan(docs).collect())) == sorted(map(str, plan.collect()))


def dedup_by_hand(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(BLANK, " ", r[1] or "")].append(r[0])
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            out[(i, min(known) if known else None, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


def stored(spark, docs):
    from stayflow.session import shared_path

    path = shared_path(spark, "docs")
    docs.write.parquet(path)
    return path


def test_exact_dedup_keeps_one_row_of_each_text(spark):
    path = stored(spark, edge_docs(spark))
    got = exact_dedup.dedup_exact(spark, path).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == dedup_by_hand(EDGES)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({r["text_sha256"] for r in got})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.dedup_exact(spark, stored(spark, no_docs(spark))).count() == 0


def test_texts_that_share_a_digest_are_told_apart_by_their_bytes(spark):
    path = stored(spark, spark.createDataFrame([(i, f"text {i % 9}", None, None, None) for i in range(60)], SCHEMA))
    weak = lambda text: F.substring(F.sha2(text, 256), 1, 1)
    key = lambda r: (r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])
    assert sorted(map(key, exact_dedup.dedup_exact(spark, path, digest=weak).collect())) == sorted(map(key, exact_dedup.dedup_exact(spark, path).collect()))


def test_state_goes_on_where_it_stopped(spark):
    first = spark.createDataFrame([(i, f"text {i % 4}", None, None, None) for i in range(8, 16)], SCHEMA)
    path, folder = stored(spark, first), stored(spark, first) + "-state"
    run = lambda: exact_dedup.run_ledger(spark, path, "doc_id", "text", exact_dedup.full_digest, folder)
    assert {(r["n"], r["first"]["id"]) for r in run().collect()} == {(2, 8), (2, 9), (2, 10), (2, 11)}
    spark.createDataFrame([(1, "text 0", None, None, None), (2, "new", None, None, None)], SCHEMA).write.mode("append").parquet(path)
    assert {(r["n"], r["first"]["id"]) for r in run().collect()} == {(3, 1), (2, 9), (2, 10), (2, 11), (1, 2)}


def lines_by_hand(rows, run, words=50):
    """Deleted line numbers by comparing every run with every earlier one."""
    rows = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    seen, deleted = set(), {}
    for no_id, i, text in rows:
        norm = [(k, re.sub(BLANK, " ", x).strip(" ")) for k, x in enumerate(text.split("\n"))]
        norm = [(k, x) for k, x in norm if x]
        gone = set()
        for at in range(len(norm)):
            for size in range(1, min(run, len(norm) - at) + 1):
                part = tuple(x for _, x in norm[at : at + size])
                if size < run and sum(len(x.split(" ")) for x in part) < words:
                    continue
                if part in seen:
                    gone |= {k for k, _ in norm[at : at + size]}
                seen.add(part)
        deleted[(None if no_id else i, text)] = sorted(gone)
    return deleted


@pytest.mark.parametrize("seed,run", [(1, 3), (2, 2), (3, 4)])
def test_winnowing_deletes_just_the_later_runs(spark, seed, run):
    rng = random.Random(seed)
    pool = [f"line {i}" for i in range(6)] + [""]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 25))), None, None, None) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = lines_by_hand(rows, run)
    for r in line_dedup.dedup_lines(docs, run=run).join(docs.selectExpr("doc_id", "text AS original"), "doc_id").collect():
        gone = want[(r["doc_id"], r["original"])]
        assert r["deleted_lines"] == gone
        assert r["text"] == "\n".join(x for k, x in enumerate(r["original"].split("\n")) if k not in gone)


def test_short_runs_of_many_words_are_deleted_too(spark, monkeypatch):
    rng = random.Random(11)
    pool = [" ".join(f"w{i}" for _ in range(n)) for i, n in enumerate((2, 3, 4, 6, 9, 12))]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6))), None, None, None) for i in range(80)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = lines_by_hand(rows, 4, 10)
    for limit in (50_000, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", limit)
        got = line_dedup.dedup_lines(docs, run=4, words=10).join(docs.selectExpr("doc_id", "text AS original"), "doc_id").collect()
        assert all(r["deleted_lines"] == want[(r["doc_id"], r["original"])] for r in got)
    assert 20 < sum(map(bool, want.values())) < 80


def test_runs_name_their_source_and_extend(spark):
    rows = [(1, "a\nb\nc\nd\ne\nf", None, None, None), (2, "x\nb\nc\nd\ne\ny", None, None, None)]
    got = line_dedup.repeated_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["id"], r["start"], r["end"], r["source_id"], r["source_start"]) for r in got] == [(2, 1, 5, 1, 1)]


def test_line_dedup_of_hostile_rows(spark):
    docs = edge_docs(spark)
    out = line_dedup.dedup_lines(docs)
    rows = out.collect()
    assert Counter((r["doc_id"], r["text"] is None) for r in rows) == Counter((e[0], e[1] is None) for e in EDGES)
    assert {r["doc_id"]: r["n_deleted"] for r in rows if r["n_deleted"]} == {2: 3}
    assert line_dedup.dedup_lines(no_docs(spark)).count() == 0


def test_exact_dedup_in_many_batches_looks_digests_up_in_state(spark):
    from stayflow.session import shared_path

    docs = spark.createDataFrame([(i, f"text {i % 7}", None, None, None) for i in range(40)], SCHEMA).repartition(6)
    path, folder = stored(spark, docs), shared_path(spark, "many-batches")
    got = exact_dedup.dedup_exact(spark, path, folder=folder, batch_bytes=1)
    assert exact_dedup.BATCH_BYTES * 4 <= 30 * 10**9
    assert spark.read.parquet(f"{folder}/ledger").where("batch >= 0").select("batch").distinct().count() == 6
    assert sorted(map(str, got.collect())) == sorted(map(str, exact_dedup.dedup_exact(spark, path, batch_bytes=1 << 40).collect()))
