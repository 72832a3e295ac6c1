"""Near copies by the Jaccard similarity of word shingles: MinHash bands find candidates, the shingles decide.

Two texts are linked if the sets of their shingles (five words, ASCII case and white space aside) have a similarity of
at least 0.8. Every set gets 32 keys, each of five least hashes; sets at 0.8 share none of them with a probability of
0.67 ** 32, about 3e-6 (measured recall against brute force in the tests). No pair is linked before its shingle sets themselves were compared.

SimHash, the method of `op5_simhash`, comes first: what its operator links (four words, four bits), and texts of one fingerprint, are
candidates beside those of the keys, and their shingles decide about them too. By itself it would miss most pairs at 0.8 (README).

Texts of one shingle set are one row before anything is indexed. In each key's group all members are compared with the
least and the greatest one, which joins dense groups; after that members of different classes are compared. In a group of up to
HOT members these are all its pairs. Sets that stand under larger groups go through a prefix filter together: ordered by how
many of these sets hold a shingle, rarest first, two similar sets share one of their first shingles (the first ninth of the smaller,
the first fifth of the larger one), so candidates follow the links and not the square of a group. Every candidate is given out
once; likelier ones are verified first, and a comparison inside a class, which would join nothing, is left out.

Defined cases: a text of fewer than five words is one shingle; texts without words, null among them, are one class; null
ids and repeated rows as in `simhash.near_dedup`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from stayflow.functions.columns import q
from stayflow.llm.common import kept_whole
from stayflow.llm.components import components
from stayflow.llm import simhash
from stayflow.llm.simhash import LOWER, first_of_each, word_chunks

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 32, 5
#: Members of a key's group beyond which its pairs come from rare shingles, not from all members.
HOT = 16
#: Pairs of a text that the first round verifies, and pairs a text up to which all are verified at once.
FIRST, ALL = 2, 4
#: Rows of kept tables that one task reads at least.
PAIRS_A_TASK, SETS_A_TASK = 20_000, 2_000
#: Bits of a set's parity sketch.
SKETCH = 512
#: Shingles that are hashed at a time.
STEP = 1024
_RNG = np.random.default_rng(SEED)
FLIPS = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64)
FACTORS = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)


def _hashes(words: list[bytes], shingle: int) -> np.ndarray:
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: max(1, len(words) - shingle + 1)].tolist()
    lasts = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, lasts, strict=True)], dtype=np.uint64))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles of one text, in order."""
    parts, tail = [], []
    for words in word_chunks((text or "").encode("utf-8", "surrogatepass").translate(LOWER)):
        tail = tail + words
        if len(tail) >= shingle:
            parts.append(_hashes(tail, shingle))
            tail = tail[len(tail) - shingle + 1 :]
    if not parts:
        return _hashes(tail, shingle) if tail else np.zeros(0, np.uint64)
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def band_keys(found: np.ndarray) -> list[int]:
    """Signed keys of one shingle set; an empty set has none."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), STEP):
        least = np.minimum(least, ((found[at : at + STEP] ^ FLIPS) * FACTORS).min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def sketch(found: np.ndarray) -> np.ndarray:
    """SKETCH bits, each the parity of the shingles whose hash names it: sets differ in at least as many shingles as their
    sketches in bits."""
    odd = np.bincount((found & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, digest, fp, n, mark, keys) of every row: `fp` names its shingle set, `n` is the set's size, `mark` its SimHash fingerprint."""
    rows = docs.select(q(id_col).alias("id"), q(text_col).cast("string").alias("text"), F.xxhash64(q(text_col)).alias("digest"))
    numbers = [StructField(c, LongType()) for c in ("digest", "fp", "n", "mark")]
    out = StructType([rows.schema["id"], *numbers, StructField("keys", ArrayType(LongType()))])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, n, marks, keys = [], [], [], []
            for t in b.column("text"):
                found = shingles(t.as_py(), shingle)
                marks.append(simhash.fingerprint(t.as_py()))
                fp.append(xxhash.xxh3_64_intdigest(found.tobytes()))
                n.append(len(found))
                keys.append(band_keys(found))
            made = [pa.array(np.array(fp, np.uint64).view(np.int64)), *(pa.array(c, pa.int64()) for c in (n, marks)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("digest"), *made], ["id", "digest", "fp", "n", "mark", "keys"])

    return rows.mapInArrow(of_batches, out)


def _fewer(kept: DataFrame, rows: int) -> DataFrame:
    """A kept table read by a task for every so many of its counted rows, so that small ones leave few files a shuffle."""
    return kept.coalesce(max(1, -(-kept.count() // rows)))


def _sets(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(fp, shingles, sketch) of the chosen (fp, id, digest)."""
    rows = docs.select(q(id_col).alias("d_id"), q(text_col).cast("string").alias("text"), F.xxhash64(q(text_col)).alias("d_digest"))
    same = F.col("d_id").eqNullSafe(F.col("id")) & (F.col("d_digest") == F.col("digest"))
    rows = rows.join(chosen, same).select("fp", "text").dropDuplicates(["fp"])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t.as_py(), shingle) for t in b.column("text")]
            arrays = [pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64())), pa.array([sketch(f) for f in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("fp"), *arrays], ["fp", "shingles", "sketch"])

    return _fewer(kept_whole(rows.mapInArrow(of_batches, "fp long, shingles array<long>, sketch array<long>")), SETS_A_TASK)


def _sizes_allow(a: Column, b: Column, similarity: float) -> Column:
    return F.least(a, b) / F.greatest(a, b) >= similarity


def _sketches_allow(a: Column, b: Column, n: Column, similarity: float) -> Column:
    """Whether sets of `n` shingles together may be similar enough, by the bits in which their sketches differ."""
    apart = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SKETCH // 64)), F.lit(0))
    return apart <= n * ((1 - similarity) / (1 + similarity)) + F.lit(1e-9)


def _possible(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v, weight) that their sketches do not rule out; a sketch is a fraction of a set."""
    short = sets.select("fp", F.size("shingles").alias("n"), "sketch")
    ends = [short.select(F.col("fp").alias(e), F.col("n").alias(f"{e}_n"), F.col("sketch").alias(f"{e}_s")) for e in ("u", "v")]
    both = pairs.join(ends[0], "u").join(ends[1], "v")
    return both.where(_sketches_allow(F.col("u_s"), F.col("v_s"), F.col("u_n") + F.col("v_n"), similarity)).select("u", "v", "weight")


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets are similar enough."""
    left, right = sets.select(F.col("fp").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("fp").alias("v"), F.col("shingles").alias("b"))
    both = pairs.join(left, "u").join(right, "v").withColumn("common", F.size(F.array_intersect("a", "b")))
    return both.where(F.col("common") / (F.size("a") + F.size("b") - F.col("common")) >= similarity).select("u", "v")


def _taken(pairs: DataFrame, most: int) -> DataFrame:
    """The pairs of each u that share most, `most` of them."""
    order = Window.partitionBy("u").orderBy(F.col("weight").desc(), "v")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one class of the links found so far."""
    roots = components(found, few_tasks=True)
    named = pairs
    for end in ("u", "v"):
        root = roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        named = named.join(root, end, "left")
    return named.where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v", "weight")


def _settled(pairs: DataFrame, sets: DataFrame, similarity: float, found: DataFrame | None = None) -> DataFrame | None:
    """Links among candidate pairs (u, v, weight), enough to join all that are linked, with those found before.

    While pairs are many times the texts, every text has its likeliest ones verified, and what that joins needs no comparison
    any more; each round verifies more of what is left, the last one all of it.
    """
    left, most = kept_whole(_possible(pairs, sets, similarity)), FIRST
    while True:
        n, texts = left.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
        if not n:
            return found
        left = left.coalesce(max(1, -(-n // PAIRS_A_TASK)))
        last = n <= ALL * texts
        now = left if last else kept_whole(_taken(left, most))
        links_ = _fewer(kept_whole(_linked(now, sets, similarity)), PAIRS_A_TASK)
        found = links_ if found is None else kept_whole(found.unionByName(links_))
        if last:
            return found
        left = kept_whole(_apart(left.join(now, ["u", "v"], "left_anti"), found))
        most *= 8


def _prefix_pairs(tokens: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): pairs of different classes that may reach the similarity, from the sets' rarest shingles.

    `tokens` are (fp, n, class, shingle) of all sets that stand under hot keys. In one order of shingles, rarest first, a
    similar pair shares one of the smaller set's first shingles with the first of the larger one, at places that leave enough behind them.
    Sketches rule most near misses out inside the join.
    """
    counts = tokens.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"))
    listed = tokens.join(counts, "shingle").groupBy("fp", "n", "class").agg(F.array_sort(F.collect_list(F.struct("c", "shingle"))).alias("t"))
    n = F.size("t")
    whole = lambda c: F.ceil(c - F.lit(1e-9)).cast("int")
    probed, held = n - whole(n * similarity) + 1, n - whole(n * (2 * similarity / (1 + similarity))) + 1
    first = listed.withColumn("held", held).select("fp", "n", "class", "held", F.posexplode(F.slice("t", F.lit(1), probed)).alias("p", "e"))
    first = kept_whole(first.where("e.c > 1").select("fp", "n", "class", (F.col("p") < F.col("held")).alias("is_held"), "p", F.col("e.shingle").alias("shingle")))
    first = first.join(sets.select("fp", "sketch"), "fp")
    # under one shingle, members of the largest class meet only those outside it
    classes = first.groupBy("shingle", "class").agg(F.count(F.lit(1)).alias("m"))
    largest = classes.groupBy("shingle").agg(F.max_by("class", F.struct("m", "class")).alias("largest"), F.count(F.lit(1)).alias("n_classes"))
    among = kept_whole(first.join(largest.where("n_classes > 1").select("shingle", "largest"), "shingle"))
    x = among.where(F.col("class") != F.col("largest")).select("shingle", *[F.col(c).alias(f"x_{c}") for c in ("fp", "n", "class", "is_held", "p", "sketch")])
    once_ = (F.col("class") == F.col("largest")) | (F.col("x_fp") > F.col("fp"))
    smaller = F.struct("x_n", "x_fp") < F.struct("n", "fp")
    roles = F.when(smaller, F.col("x_is_held")).otherwise(F.col("is_held"))
    behind = 1 + F.least(F.col("x_n") - F.col("x_p") - 1, F.col("n") - F.col("p") - 1)
    enough = behind >= whole((F.col("x_n") + F.col("n")) * (similarity / (1 + similarity)))
    apart = (F.col("x_class") != F.col("class")) & once_ & roles & enough & _sizes_allow(F.col("x_n"), F.col("n"), similarity)
    apart &= _sketches_allow(F.col("x_sketch"), F.col("sketch"), F.col("x_n") + F.col("n"), similarity)
    pairs = x.join(among, "shingle").where(apart).select(F.greatest("x_fp", "fp").alias("u"), F.least("x_fp", "fp").alias("v"))
    return pairs.groupBy("u", "v").agg(F.count(F.lit(1)).alias("weight"))


def fingerprint_pairs(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(u, v): sets whose SimHash fingerprints are equal or linked, of sizes that allow the similarity; `nodes` are (fp, n, mark).

    A fingerprint's least set stands for it; the others of that fingerprint are its pairs.
    """
    sized = nodes.where(F.col("n") > 0)
    least = kept_whole(sized.groupBy("mark").agg(F.min(F.struct("fp", "n")).alias("one"), F.count(F.lit(1)).alias("m")))
    alike = sized.join(least.where(F.col("m") > 1), "mark").where(F.col("fp") != F.col("one.fp"))
    ends = [least.select(F.col("mark").alias(c), F.col("one").alias(f"{c}_one")) for c in ("u", "v")]
    near = simhash.links(least.select(F.col("mark").alias("fp"))).join(ends[0], "u").join(ends[1], "v")
    pairs = alike.select(F.struct("fp", "n").alias("u_one"), F.col("one").alias("v_one")).unionByName(near.select("u_one", "v_one"))
    pairs = pairs.where(_sizes_allow(F.col("u_one.n"), F.col("v_one.n"), similarity))
    return kept_whole(pairs.select(F.greatest("u_one.fp", "v_one.fp").alias("u"), F.least("u_one.fp", "v_one.fp").alias("v")).distinct())


def links(index: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, hot: int = HOT, more: DataFrame | None = None) -> DataFrame:
    """(u, v): enough of the linked pairs among `index` (key, fp, n) to join all that are linked and share a key, and those
    of the candidates `more` (u, v) that are linked."""
    ends = index.groupBy("key").agg(F.min(F.struct("fp", "n")).alias("first"), F.max(F.struct("fp", "n")).alias("last"), F.count(F.lit(1)).alias("m"))
    ended = index.join(ends, "key").select("fp", "n", F.explode(F.array("first", "last")).alias("end"))
    ended = ended.where((F.col("fp") != F.col("end.fp")) & _sizes_allow(F.col("n"), F.col("end.n"), similarity))
    stars = ended.select(F.greatest("fp", "end.fp").alias("u"), F.least("fp", "end.fp").alias("v"))
    stars = stars if more is None else stars.unionByName(more)
    tried = kept_whole(stars.groupBy("u", "v").agg(F.count(F.lit(1)).alias("weight")))
    found = _settled(tried, sets, similarity)
    if found is None:
        return index.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    roots = components(found, few_tasks=True)
    classed = index.join(roots, F.col("fp") == F.col("node"), "left").select("key", "fp", "n", F.coalesce("root", "fp").alias("class"))
    classed = _fewer(kept_whole(classed), PAIRS_A_TASK)
    # a group of one class, which most groups are, has nothing left to compare
    groups = classed.groupBy("key", "class").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(
        F.max_by("class", F.struct("m", "class")).alias("largest"), F.count(F.lit(1)).alias("n_classes"), F.sum("m").alias("m")
    ).where(F.col("n_classes") > 1)
    among = kept_whole(classed.join(groups.select("key", "largest", (F.col("m") > hot).alias("hot")), "key"))
    few = among.where(~F.col("hot"))
    outside = few.where(F.col("class") != F.col("largest")).select("key", F.col("fp").alias("u"), F.col("n").alias("m"), F.col("class").alias("own"))
    once_ = (F.col("class") == F.col("largest")) | (F.col("u") > F.col("fp"))
    apart = (F.col("own") != F.col("class")) & _sizes_allow(F.col("m"), F.col("n"), similarity) & once_
    across = outside.join(few, "key").where(apart)
    rest = across.groupBy(F.greatest("u", "fp").alias("u"), F.least("u", "fp").alias("v")).agg(F.count(F.lit(1)).alias("weight"))
    members = _fewer(kept_whole(among.where("hot").select("fp", "n", "class").distinct()), SETS_A_TASK)
    if not members.isEmpty():
        tokens = members.join(sets, "fp").select("fp", "n", "class", F.explode("shingles").alias("shingle"))
        rest = rest.unionByName(_prefix_pairs(tokens, sets, similarity)).groupBy("u", "v").agg(F.max("weight").alias("weight"))
    return _settled(rest.join(tried, ["u", "v"], "left_anti"), sets, similarity, found)


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """One document of each class of linked texts: the least id (then the least text digest). Of equal rows one stays."""
    marks = kept_whole(signatures(docs, id_col, text_col, shingle))
    one = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "digest")).alias("one")
    # texts of one set may differ in order and so in fingerprint; the least stands for them, whatever the partitions
    nodes = marks.groupBy("fp").agg(one, F.first("n").alias("n"), F.min("mark").alias("mark"), F.first("keys").alias("keys"))
    index = nodes.select(F.explode("keys").alias("key"), "fp", "n", "one")
    shared = index.groupBy("key").count().where(F.col("count") > 1).select("key")
    index = _fewer(kept_whole(index.join(shared, "key")), PAIRS_A_TASK)
    more = fingerprint_pairs(nodes.select("fp", "n", "mark"), similarity)
    named = nodes.join(more.select(F.explode(F.array("u", "v")).alias("fp")).distinct(), "fp", "left_semi")
    chosen = index.select("fp", "one.id", "one.digest").unionByName(named.select("fp", "one.id", "one.digest")).dropDuplicates(["fp"])
    sets = _sets(docs, chosen, id_col, text_col, shingle)
    roots = components(links(index.select("key", "fp", "n"), sets, similarity, more=more), few_tasks=True)
    named = marks.select("id", "digest", "fp").join(roots, F.col("fp") == F.col("node"), "left")
    return first_of_each(docs, named.select(F.coalesce("root", "fp").alias("root"), "id", "digest"), id_col, text_col)
