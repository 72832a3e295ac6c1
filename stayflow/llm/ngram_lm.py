"""Interpolated modified Kneser-Ney bigram model, counted in Spark and read by workers as memory-mapped sorted arrays.

Three passes. Words are counted; their 64-bit hashes are stored as sorted arrays in the shared folder, a word's number is its
place in them. Pairs of numbers are counted: tasks sum up what they read, pairs are dealt by their place in the order
of all pairs (so that a word that follows or precedes everything spreads over many tasks), every task adds up one stretch and
stores it as sorted arrays. What a pair tells about its words (how often the first goes on, with how many words; how many words
the second follows) is summed by number and stored as arrays again, one entry a number, so that a number is its place. Then texts are scored: numbers and pair counts are
found by bisection in the mapped arrays, whose pages the workers of a machine share. The driver holds totals and file names.

P(w | v) = max(c(vw) - D, 0) / c(v) + g(v) P(w), where P(w) is the same over the number of words that w follows, and
ends at 1 / (V + 1) for every word, the unknown one included. D has three values an order, from the numbers of pairs seen
once to four times. A text begins with a mark and ends with a token of its own; an unknown word is followed by P(w).

The arrays lie below the folder that `spark.checkpoint.dir` names; where that is no mounted folder, a worker fetches an array
through the file system of its address into its own temporary folder, maps it and unlinks it. They take 12 bytes a distinct pair.
Files appear under their final name when they are whole, so a task that is run again replaces them by the same.

Defined cases: a null text is empty and holds the end alone; a null id counts as an empty one; repeated rows count each;
with no training rows every token has the same probability 1; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import Any
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from stayflow.functions.columns import q
from stayflow.llm.common import kept_whole, once
from stayflow.llm.simhash import LOWER, word_chunks
from stayflow.session import shared_path

#: Training rows are those whose crc32 of the id leaves another remainder than HELD_OUT.
FOLDS, HELD_OUT = 7, 2
#: The end token; no word holds a blank.
END = b" "
#: Entries of one array file, distinct words or pairs that a task holds, and bytes of text taken at a time.
BLOCK, COUNTED, CHUNK = 1 << 20, 1 << 20, 1 << 21
#: Entries of a file of words or of their sums, and words a worker keeps.
WORDS, KNOWN = 1 << 22, 1 << 19
LEAST_DISCOUNT = 0.1


def held_out(id_: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % folds == fold


def tokens(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in parts, the last of which ends in END."""
    parts = word_chunks((text or "").encode("utf-8", "surrogatepass").translate(LOWER), CHUNK)
    held = next(parts, [])
    for more in parts:
        yield held
        held = more
    yield [*held, END]


# ---------------------------------------------------------------- arrays


def _reader(uri: str) -> tuple[Any, str] | None:
    """File system and path of an address, None for a mounted folder."""
    if urlparse(uri).scheme in ("", "file"):
        return None
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _path(uri: str) -> str:
    return unquote(urlparse(uri).path) if uri.startswith("file:") else uri


def stored(folder: str, name: str, values: np.ndarray) -> None:
    """Writes one array so that it is seen whole or not at all."""
    uri = f"{folder}/{name}"
    reached, draft = _reader(uri), f"-{uuid.uuid4().hex}"
    if reached is None:
        os.makedirs(_path(folder), exist_ok=True)
        with open(_path(uri) + draft, "wb") as f:
            values.tofile(f)
        os.replace(_path(uri) + draft, _path(uri))
        return
    system, path = reached
    system.create_dir(path.rsplit("/", 1)[0])
    with system.open_output_stream(path + draft) as f:
        f.write(values.tobytes())
    system.move(path + draft, path)


def mapped(folder: str, name: str, kind: str) -> np.ndarray:
    uri = f"{folder}/{name}"
    reached = _reader(uri)
    if reached is None:
        return np.memmap(_path(uri), kind, "r")
    system, path = reached
    with tempfile.NamedTemporaryFile() as local, system.open_input_stream(path) as f:
        while part := f.read(1 << 24):
            local.write(part)
        local.flush()
        return np.memmap(local.name, kind, "r")


class Blocks:
    """Sorted keys with values beside them in files; (block, first key, entries) names the files in order."""

    def __init__(self, folder: str, kind: str, rows: list[tuple[int, int, int]], values: dict[str, str], keys: str = "i8"):
        self.folder, self.kind, self.rows, self.values, self.key_kind = folder, kind, rows, values, keys
        self.first = np.array([r[1] for r in rows], np.int64)
        self.offset = np.concatenate(([0], np.cumsum([r[2] for r in rows], dtype=np.int64)))
        self.open: dict[tuple[int, str], np.ndarray] = {}

    def array(self, at: int, part: str) -> np.ndarray:
        if (at, part) not in self.open:
            self.open[at, part] = mapped(self.folder, f"{self.kind}-{self.rows[at][0]}.{part}", self.values.get(part, self.key_kind))
        return self.open[at, part]

    def _met(self, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(block, places in `wanted`, places in the block) of the keys that are there; `wanted` is sorted, so pages are read in order."""
        edges = [*np.searchsorted(wanted, self.first).tolist(), len(wanted)]
        for at, (lo, hi) in enumerate(zip(edges, edges[1:])):
            if lo < hi:
                keys, mine = self.array(at, "keys"), wanted[lo:hi]
                found = np.searchsorted(keys, mine)
                there = np.flatnonzero(keys[np.minimum(found, len(keys) - 1)] == mine)
                yield at, there + lo, found[there]

    def places(self, wanted: np.ndarray) -> np.ndarray:
        """Place of every key among all, -1 if it is not there; `wanted` is sorted."""
        out = np.full(len(wanted), -1, np.int64)
        for at, mine, found in self._met(wanted):
            out[mine] = found + self.offset[at]
        return out

    def of(self, wanted: np.ndarray, part: str) -> np.ndarray:
        """Value of every key, zero if it is not there; `wanted` is sorted, and a block is met by its own keys only."""
        out = np.zeros(len(wanted), self.values[part])
        for at, mine, found in self._met(wanted):
            out[mine] = self.array(at, part)[found]
        return out

    def at(self, places: np.ndarray, part: str) -> np.ndarray:
        """Values at places, zero at -1."""
        out = np.zeros(len(places), self.values[part])
        for at in range(len(self.rows)):
            lo, hi = int(self.offset[at]), int(self.offset[at + 1])
            mine = np.flatnonzero((places >= lo) & (places < hi))
            if len(mine) == len(places):
                return self.array(at, part)[places - lo]
            if len(mine):
                out[mine] = self.array(at, part)[places[mine] - lo]
        return out


class Writer:
    """Takes sorted keys with values to add up and stores them as one block."""

    def __init__(self, folder: str, kind: str, values: dict[str, str]):
        self.folder, self.kind, self.values = folder, kind, values

    def write(self, block: int, keys: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        out = {"keys": keys[new].astype(np.int64)} | {k: np.add.reduceat(columns[k], new).astype(v) for k, v in self.values.items()}
        for part, values in out.items():
            stored(self.folder, f"{self.kind}-{block}.{part}", values)
        return out


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Whole blocks, gathered from batches sorted by `block`."""
    held: list[pa.RecordBatch] = []
    now = None

    def gathered() -> tuple[int, dict[str, np.ndarray]]:
        table = pa.Table.from_batches(held)
        return now, {c: table.column(c).to_numpy() for c in table.column_names if c != "block"}

    for b in batches:
        block = b.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            if held and block[lo] != now:
                yield gathered()
                held = []
            now = int(block[lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield gathered()


def _dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows of one block in one task, sorted; several blocks a task, so that their number evens out."""
    return rows.repartition(max(1, blocks), "block").sortWithinPartitions("block", "key")


# ---------------------------------------------------------------- model


class Numbers:
    """Word -> number through the mapped hash arrays; the words met last are kept."""

    def __init__(self, words: Blocks):
        self.words, self.known = words, {}

    def __call__(self, found: list[bytes]) -> np.ndarray:
        numbers = list(map(self.known.get, found))
        if None in numbers:
            new = {w for w, k in zip(found, numbers) if k is None}
            if len(self.known) + len(new) > KNOWN:
                self.known = {}
                new = set(found)
            listed = list(new)
            hashes = np.fromiter(map(_hash, listed), np.uint64, len(listed)).view(np.int64)
            order = np.argsort(hashes)
            places = np.empty(len(listed), np.int64)
            places[order] = self.words.places(hashes[order])
            self.known.update(zip(listed, places.tolist(), strict=True))
            numbers = map(self.known.__getitem__, found)
        return np.fromiter(numbers, np.int64, len(found))


def _before(lasts: list[int], parts: list[np.ndarray], second: np.ndarray) -> np.ndarray:
    """The number before each of `second`, the parts in a row; `lasts` has those before the parts."""
    first = np.empty_like(second)
    first[1:] = second[:-1]
    first[np.cumsum([0, *map(len, parts[:-1])])] = lasts
    return first


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def _training(docs: DataFrame, id_col: str, text_col: str, folds: int, fold: int) -> DataFrame:
    return docs.where(~held_out(q(id_col), folds, fold)).select(q(text_col).cast("string").alias("text"))


def _word_blocks(spark: SparkSession, train: DataFrame, folder: str) -> tuple[Blocks, int]:
    """Stores the hash and count of every training word; (arrays, tokens)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def packet() -> pa.RecordBatch:
            keys = np.fromiter(map(_hash, found), np.uint64, len(found)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(list(found.values()), pa.int64())], ["key", "n"])

        for b in batches:
            for t in b.column("text"):
                for part in tokens(t.as_py()):
                    found.update(part)
                if len(found) >= COUNTED:
                    yield packet()
                    found.clear()
        if found:
            yield packet()

    counts = kept_whole(train.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    v, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = max(0, int(np.ceil(np.log2(max(1, v) / WORDS))))
    # hashes are even over their range: its stretches are blocks of about one size
    block = F.shiftright(F.col("key"), 64 - bits) + (1 << bits >> 1) if bits else F.lit(0)
    writer = Writer(folder, "word", {"n": "i8"})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, c in _blocks_of(batches):
            out = writer.write(k, c["key"], {"n": c["n"]})
            yield pa.RecordBatch.from_pylist([{"block": k, "first": int(out["keys"][0]), "entries": len(out["keys"])}], _MANIFEST)

    rows = _dealt(counts.select(block.cast("long").alias("block"), "key", "n"), 1 << bits)
    return Blocks(folder, "word", _manifest(rows.mapInArrow(write, "block long, first long, entries long")), {"n": "i8"}), total


_MANIFEST = pa.schema([("block", pa.int64()), ("first", pa.int64()), ("entries", pa.int64())])


def _manifest(rows: DataFrame) -> list[tuple[int, int, int]]:
    """One row a file of about BLOCK entries."""
    return sorted((r["block"], r["first"], r["entries"]) for r in rows.collect())


def _running(words: Blocks) -> np.ndarray:
    """Training tokens before each block of words."""
    return np.concatenate(([0], np.cumsum([int(words.array(at, "n").sum()) for at in range(len(words.rows))], dtype=np.int64)))


class Places:
    """Block of a pair by its place in the order of all pairs, as far as word counts tell it: the tokens before its first
    word, and of that word's own tokens the share that its second word's number is of all."""

    def __init__(self, words: Blocks, v: int, tokens_: int, blocks: int):
        self.words, self.v, self.blocks, self.total = words, v, blocks, max(1, tokens_)
        self.sums: dict[int, np.ndarray] = {}
        self.before = _running(words)
        self.begins = max(1, tokens_ // 20)

    def __call__(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        start, width = np.full(len(first), self.total, np.int64), np.full(len(first), self.begins, np.int64)
        block = np.searchsorted(self.words.offset, first, "right") - 1
        for at in np.unique(block[first < self.v]).tolist():
            if at not in self.sums:
                self.sums[at] = np.concatenate(([0], np.cumsum(self.words.array(at, "n"))))
            mine = np.flatnonzero((block == at) & (first < self.v))
            own = first[mine] - self.words.offset[at]
            start[mine] = self.before[at] + self.sums[at][own]
            width[mine] = self.sums[at][own + 1] - self.sums[at][own]
        place = start + (width * (second / self.v)).astype(np.int64)
        return place * self.blocks // (self.total + self.begins)


def _discounts(of: np.ndarray) -> list[float]:
    """D1, D2, D3+ from the numbers of entries with count one to four; a half where those are missing. Corpora full of copies
    give estimates below zero, which would leave nothing for unseen pairs: LEAST_DISCOUNT holds them."""
    n1, n2, n3, n4 = (float(x) for x in of)
    if not (n1 and n2 and n3 and n4):
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, LEAST_DISCOUNT), float(k + 1)) for k, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3))]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, fold: int = HELD_OUT) -> dict:
    """Counts and stores the model of the training rows; the result names its files and holds its totals."""
    spark = docs.sparkSession
    folder = shared_path(spark, "lm")
    texts = _training(docs, id_col, text_col, folds, fold)
    words, total = _word_blocks(spark, texts, folder)
    v = int(words.offset[-1])
    if not v:
        return {"folder": folder, "tokens": 0, "words": [], "pairs": [], "sums": [], "distinct": 0, "high": [0.0] * 3, "low": [0.0] * 3, "floor": 1.0}
    blocks = max(1, total // BLOCK)
    spec, key = words.rows, uuid.uuid4().hex

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = once(key, lambda: Blocks(folder, "word", spec, {"n": "i8"}))
        number, place = Numbers(held), Places(held, v, total, blocks)
        found: list[np.ndarray] = []
        lasts: list[int] = []
        size = 0

        def packet() -> pa.RecordBatch:
            every = np.concatenate(found)
            keys, n = np.unique(_before(lasts, found, every) * v + every, return_counts=True)
            first, second = np.divmod(keys, v)
            return pa.RecordBatch.from_arrays([pa.array(place(first, second).astype(np.int32)), pa.array(keys), pa.array(n.astype(np.int32))], ["block", "key", "n"])

        for b in batches:
            for t in b.column("text"):
                last = v
                for part in tokens(t.as_py()):
                    if part:
                        own = number(part)
                        found.append(own)
                        lasts.append(last)
                        last, size = int(own[-1]), size + len(own)
                if size >= COUNTED:
                    yield packet()
                    found, lasts, size = [], [], 0
        if size:
            yield packet()

    writer = Writer(folder, "pair", {"n": "i4"})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, c in _blocks_of(batches):
            out = writer.write(k, c["key"], {"n": c["n"]})
            n = out["n"].astype(np.int64)
            first, second = np.divmod(out["keys"], v)
            kinds = np.minimum(n, 5)
            number, at = np.unique(first, return_inverse=True)
            by_count = [np.bincount(at[kinds == x], minlength=len(number)) for x in (1, 2)] + [np.bincount(at[kinds >= 3], minlength=len(number))]
            follows, times = np.unique(second, return_counts=True)
            zero = np.zeros(len(follows), np.int64)
            columns = {
                "number": (number, follows), "total": (np.bincount(at, n).astype(np.int64), zero), "n1": (by_count[0], zero),
                "n2": (by_count[1], zero), "n3": (by_count[2], zero), "follows": (np.zeros(len(number), np.int64), times),
            }
            yield _sums(k, int(out["keys"][0]), len(n), np.bincount(kinds, minlength=6)[1:5], columns)

    dealt = _dealt(texts.mapInArrow(pairs, "block int, key long, n int"), blocks)
    # the written sums stand for the pass: the blocks are stored once, and again only where a task is lost
    sums = kept_whole(dealt.mapInArrow(write, _SUMS))
    of = sums.where("number is null")
    made = _manifest(of.select("block", F.col("total").alias("first"), F.col("follows").alias("entries")))
    exactly = of.agg(*[F.sum(c) for c in ("n1", "n2", "n3", "n4")]).first()
    by_word = sums.where("number is not null").groupBy(F.col("number").alias("key")).agg(*[F.sum(c).alias(c) for c in _OF_WORD])
    by_word = kept_whole(by_word.withColumn("block", F.expr(f"key div {WORDS}")))
    seen = by_word.agg(*[F.count_if(F.col("follows") == k) for k in (1, 2, 3, 4)], F.count_if(F.col("follows") >= 3), F.sum("follows")).first()
    sum_writer = Writer(folder, "sum", _OF_WORD)

    def write_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, c in _blocks_of(batches):
            out = sum_writer.write(k, c["key"], c)
            yield pa.RecordBatch.from_pylist([{"block": k, "first": int(out["keys"][0]), "entries": len(out["keys"])}], _MANIFEST)

    of_words = _manifest(_dealt(by_word, v // WORDS + 1).mapInArrow(write_sums, "block long, first long, entries long"))
    low = _discounts(np.array(seen[:4]))
    back = (low[0] * seen[0] + low[1] * seen[1] + low[2] * seen[4]) / seen[5]
    return {
        "folder": folder, "tokens": total, "words": spec, "pairs": made, "sums": of_words, "distinct": seen[5],
        "high": _discounts(np.array(exactly)), "low": low, "floor": back / (v + 1),
    }


_OF_WORD = {"total": "i8", "n1": "i4", "n2": "i4", "n3": "i4", "follows": "i4"}
_SUMS = "block long, number long, total long, n1 long, n2 long, n3 long, n4 long, follows long"


def _sums(block: int, first: int, entries: int, exactly: np.ndarray, columns: dict[str, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Sums by word of one block, and one row without a number: the block's first key, entries, and pairs seen once to four times."""
    joined = {k: np.concatenate(x) for k, x in columns.items()}
    n = len(joined["number"])
    head = {"number": None, "total": first, "n1": int(exactly[0]), "n2": int(exactly[1]), "n3": int(exactly[2]), "follows": entries}
    arrays = {"block": pa.array([block] * (n + 1), pa.int64())}
    for c in ("number", "total", "n1", "n2", "n3"):
        arrays[c] = pa.concat_arrays([pa.array([head[c]], pa.int64()), pa.array(joined[c].astype(np.int64))])
    arrays["n4"] = pa.concat_arrays([pa.array([int(exactly[3])], pa.int64()), pa.array(np.zeros(n, np.int64))])
    arrays["follows"] = pa.concat_arrays([pa.array([head["follows"]], pa.int64()), pa.array(joined["follows"].astype(np.int64))])
    return pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))


class Scorer:
    """log10 probabilities from the mapped arrays of a model."""

    def __init__(self, model: dict):
        folder = model["folder"]
        self.words = Blocks(folder, "word", model["words"], {"n": "i8"})
        self.pairs = Blocks(folder, "pair", model["pairs"], {"n": "i4"})
        self.sums = Blocks(folder, "sum", model["sums"], _OF_WORD)
        self.number, self.v, self.model = Numbers(self.words), int(self.words.offset[-1]), model
        self.high, self.low = (np.array([0.0, *model[k]]) for k in ("high", "low"))

    def alone(self, second: np.ndarray) -> np.ndarray:
        """P(w) of numbers, -1 for an unknown word."""
        n = self.sums.at(second, "follows")
        return np.maximum(n - self.low[np.minimum(n, 3)], 0) / max(1, self.model["distinct"]) + self.model["floor"]

    def after(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """P(w | v) of numbers; `first` is the number of words for the beginning of a text."""
        p = self.alone(second)
        total = self.sums.at(first, "total")
        seen = np.flatnonzero(total > 0)
        first, second, total = first[seen], second[seen], total[seen]
        back = sum(self.high[k] * self.sums.at(first, f"n{k}") for k in (1, 2, 3)) / total
        keys = np.where(second >= 0, first * self.v + second, -1)
        order = np.argsort(keys)
        n = np.zeros(len(keys), np.int64)
        n[order] = self.pairs.of(keys[order], "n")
        p[seen] = np.maximum(n - self.high[np.minimum(n, 3)], 0) / total + back * p[seen]
        return p

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """(tokens, known tokens, base score, score) of texts, some megabytes of them at a time."""
        out = np.zeros((len(texts), 4))
        total, held, size = self.model["tokens"], [], 0

        def settle() -> None:
            if not held:
                return
            who = np.repeat([h[0] for h in held], [len(h[2]) for h in held])
            second = np.concatenate([h[2] for h in held])
            first = _before([h[1] for h in held], [h[2] for h in held], second)
            base = np.log10((self.words.at(second, "n") + 1) / (total + self.v + 1)) if total else np.zeros(len(second))
            score = np.log10(self.after(first, second)) if total else base
            for column, value in ((0, np.ones(len(who))), (1, (second >= 0).astype(float)), (2, base), (3, score)):
                out[:, column] += np.bincount(who, value, len(texts))
            held.clear()

        for i, text in enumerate(texts):
            last = self.v
            for part in tokens(text):
                if part:
                    own = self.number(part) if total else np.full(len(part), -1, np.int64)
                    held.append((i, last, own))
                    last, size = int(own[-1]), size + len(own)
                    if size >= COUNTED // 2:
                        settle()
                        size = 0
        settle()
        return out


def scored(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, fold: int = HELD_OUT) -> DataFrame:
    """Every document with its counts, base score, log10 probability and perplexity under the model."""
    rows = docs.select(q(id_col).alias("id"), held_out(q(id_col), folds, fold).alias("held_out"), q(text_col).cast("string").alias("text"))
    numbers = [StructField("n_tokens", LongType()), StructField("n_known", LongType()), StructField("base_score", DoubleType()), StructField("score", DoubleType())]
    out, key = StructType([rows.schema["id"], rows.schema["held_out"], *numbers]), uuid.uuid4().hex

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = once(key, lambda: Scorer(model))
        for b in batches:
            made = scorer.texts(b.column("text").to_pylist())
            arrays = [pa.array(made[:, k].astype(np.int64)) for k in (0, 1)] + [pa.array(made[:, k]) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), *arrays], [f.name for f in out])

    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return rows.mapInArrow(of_batches, out).select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"),
        "base_score", "score", perplexity.alias("perplexity"),
    )


def language_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return scored(docs, train(docs, id_col, text_col), id_col, text_col)
