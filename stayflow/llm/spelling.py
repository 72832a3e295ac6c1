"""Spelling variants: words one inserted, deleted or replaced letter apart, grouped under the form that dominates them.

Every word is a vector of letter counts, one level of a trie a letter (accented letters share levels). One edit adds at
most one letter and takes at most one away, so two near words differ by a surplus of one on at most one level and a
deficit of one on at most one other. The search walks the trie depth first with a budget of one surplus and one deficit, for
a block of words at a time; the words at the leaves it reaches are verified letter by letter.

The trie is spread over the cluster by its first levels. Levels are dealt into three parts; an edit touches at most two of
them, so near words agree on one whole part. Every word stands in three tries, each of which has another part on top, and
is routed by that part's counts and a length: the top is walked without budget, by a shuffle. A pair is reported in the first part
that it agrees on, hence once. Leaves of many words are narrowed by halves: one edit leaves the first or the last half as it was.

Defined cases: a null text has no words; a null id counts as an empty one; repeated rows count as often as they stand;
words of one count and spelling are one row; a table without words gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayflow.functions.columns import q
from stayflow.llm.common import kept_whole
from stayflow.llm.simhash import LOWER

#: One damaged spelling in so many (word, document) pairs.
DAMAGE = 199
LEAST_LETTERS, LEAST_COUNT, DOMINANCE = 6, 5, 5
RUN = re.compile(rb"[A-Za-z\xc0-\xff]+")
#: Levels of the trie in the order of English letter frequency, so that it branches early; accented letters follow.
LETTERS = b"etaoinshrdlcumwfgypbvkjxqz"
ACCENTS = 4
LEVELS = len(LETTERS) + ACCENTS
PARTS = 3
LEVEL_OF = np.zeros(256, np.int64)
LEVEL_OF[np.frombuffer(LETTERS, np.uint8)] = np.arange(len(LETTERS))
LEVEL_OF[0xC0:] = len(LETTERS) + np.arange(0x40) % ACCENTS
PART_OF = np.arange(LEVELS) % PARTS
#: Words that are searched in one block; nodes and candidate pairs held at a time; words of a leaf that are compared directly.
BLOCK, HELD, LEAF = 40_000, 400_000, 64
#: Distinct words counted before a task hands them on.
COUNTED = 200_000


def runs_of(text: str | None) -> list[bytes]:
    """Maximal letter runs in Latin-1 bytes, A-Z lower-cased; any other character ends a run."""
    return RUN.findall((text or "").encode("latin-1", "replace").translate(LOWER))


def spelled(run: bytes, id_: str, damage: int = DAMAGE) -> bytes:
    h = zlib.crc32(f"{id_}:{run.decode('latin-1')}".encode())
    if h % damage:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = DAMAGE, letters: int = LEAST_LETTERS, count: int = LEAST_COUNT
) -> DataFrame:
    """(word, n): the words of enough letters that occur often enough."""
    rows = docs.select(F.coalesce(q(id_col).cast("string"), F.lit("")).alias("id"), q(text_col).cast("string").alias("text")).where("text is not null")

    def packet(found: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in found], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(found.values()), pa.int64())], ["word", "n"])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for id_, text in zip(b.column("id").to_pylist(), b.column("text"), strict=True):
                # a word with a letter less may still be long enough, a shorter one never is
                own = Counter(r for r in runs_of(text.as_py()) if len(r) >= letters)
                for run, n in own.items():
                    word = spelled(run, id_, damage)
                    if len(word) >= letters:
                        found[word] += n
                if len(found) >= COUNTED:
                    yield packet(found)
                    found = Counter()
        if found:
            yield packet(found)

    counted = rows.mapInArrow(of_batches, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= count)


def vectors(words: list[bytes]) -> np.ndarray:
    """Letter counts by level."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8)
    at = np.repeat(np.arange(len(words)), sizes) * LEVELS + LEVEL_OF[flat]
    return np.minimum(np.bincount(at, minlength=len(words) * LEVELS), 65535).astype(np.uint16).reshape(len(words), LEVELS)


def routes(words: DataFrame) -> DataFrame:
    """(route, part, shorter, word, n): three places of every word, and again three among words one letter longer."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                own = [w.encode("latin-1") for w in b.column("word").to_pylist()]
                counts = vectors(own)
                for part in range(PARTS):
                    tops = np.ascontiguousarray(counts[:, PART_OF == part])
                    for shorter in (0, 1):
                        route = [
                            xxhash.xxh64_intdigest(top.tobytes(), (len(w) + shorter) * PARTS + part) for top, w in zip(tops, own, strict=True)
                        ]
                        same = [pa.array(np.full(len(own), x, np.int32)) for x in (part, shorter)]
                        arrays = [pa.array(np.array(route, np.uint64).view(np.int64)), *same, b.column("word"), b.column("n")]
                        yield pa.RecordBatch.from_arrays(arrays, ["route", "part", "shorter", "word", "n"])

    return words.mapInArrow(of_batches, "route long, part int, shorter int, word string, n long")


class Trie:
    """Nodes by level over the sorted vectors of one block of words; the first level is the route."""

    def __init__(self, route: np.ndarray, counts: np.ndarray):
        columns = np.column_stack([np.unique(route, return_inverse=True)[1].astype(np.int64), counts.astype(np.int64)])
        self.order = np.lexsort(columns.T[::-1])
        columns = columns[self.order]
        new = np.zeros(len(columns), bool)
        new[:1] = True
        self.keys, node = [], np.zeros(len(columns), np.int64)
        for level in range(columns.shape[1]):
            new[1:] |= columns[1:, level] != columns[:-1, level]
            at = np.flatnonzero(new)
            # (parent, count) of every node, in order: a child is found by bisection
            self.keys.append((node[at] << 32) | columns[at, level])
            node = np.cumsum(new) - 1
        self.starts = np.append(np.flatnonzero(new), len(columns))

    def children(self, level: int, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the nodes have a child of that count, and the child."""
        keys, wanted = self.keys[level], (node << 32) | count
        at = np.searchsorted(keys, wanted)
        there = (count >= 0) & (keys[np.minimum(at, len(keys) - 1)] == wanted)
        return np.flatnonzero(there), at[there]

    def search(self, entry: np.ndarray, counts: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, leaf) pairs within the budgets; `entry` is a query's node on the first level."""
        n = len(entry)
        stack = [(1, np.arange(n), entry, np.ones(n, np.int8), deficit.astype(np.int8))]
        while stack:
            level, who, node, more, less = stack.pop()
            if level > counts.shape[1]:
                yield who, node
                continue
            if len(who) > HELD:
                half = len(who) // 2
                stack += [(level, *(x[half:] for x in (who, node, more, less))), (level, *(x[:half] for x in (who, node, more, less)))]
                continue
            count = counts[who, level - 1].astype(np.int64)
            found = []
            for step, use_more, use_less in ((0, 0, 0), (1, 1, 0), (-1, 0, 1)):
                may = np.flatnonzero((more >= use_more) & (less >= use_less))
                at, child = self.children(level, node[may], count[may] + step)
                at = may[at]
                found.append((who[at], child, more[at] - np.int8(use_more), less[at] - np.int8(use_less)))
            stack.append((level + 1, *(np.concatenate(x) for x in zip(*found, strict=True))))


def _halves(words: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first `size` // 2 letters and of the last `size` - `size` // 2."""
    digest, sizes = zlib.crc32, size.tolist()
    first = np.fromiter((digest(w[: s // 2]) for w, s in zip(words, sizes, strict=True)), np.int64, len(words))
    last = np.fromiter((digest(w[len(w) - (s - s // 2) :]) for w, s in zip(words, sizes, strict=True)), np.int64, len(words))
    return first, last


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether b is a with exactly one letter replaced or inserted."""
    head = 0
    while head < len(a) and a[head] == b[head]:
        head += 1
    return a != b and (a[head + 1 :] == b[head + 1 :] if len(a) == len(b) else a[head:] == b[head + 1 :])


def near_pairs(route: np.ndarray, part: np.ndarray, shorter: np.ndarray, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of near words in whole routes, j at least as long as i, each pair in the first part that it agrees on."""
    counts, sizes = vectors(words), np.fromiter(map(len, words), np.int64, len(words))
    held = np.flatnonzero(shorter == 0)
    if not len(held):
        return
    trie = Trie(route[held], counts[held])
    row = held[trie.order]
    first, last = _halves(words, sizes + shorter)
    values = np.unique(route[held])
    entry = np.searchsorted(values, route)
    asked = np.flatnonzero(values[np.minimum(entry, len(values) - 1)] == route)
    tops = [np.ascontiguousarray(counts[:, PART_OF == p]) for p in range(PARTS - 1)]

    def verified(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = ((first[i] == first[j]) | (last[i] == last[j])) & ((shorter[i] == 1) | (i < j))
        i, j = i[keep], j[keep]
        for p, top in enumerate(tops):
            earlier = (part[i] > p) & (top[i] == top[j]).all(axis=1)
            i, j = i[~earlier], j[~earlier]
        keep = np.fromiter((one_edit(words[a], words[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))
        return i[keep], j[keep]

    for who, leaf in trie.search(entry[asked], counts[asked], shorter[asked] == 0):
        who, start, size = asked[who], trie.starts[leaf], trie.starts[leaf + 1] - trie.starts[leaf]
        few = size <= LEAF
        w, s, z = who[few], start[few], size[few]
        step = max(1, HELD // LEAF)
        for at in range(0, len(w), step):
            z_ = z[at : at + step]
            i = np.repeat(w[at : at + step], z_)
            j = row[np.repeat(s[at : at + step], z_) + np.arange(z_.sum()) - np.repeat(np.cumsum(z_) - z_, z_)]
            yield verified(i, j)
        # leaves of many words: joined by their halves, one block of the leaf's words sorted by each
        many = np.flatnonzero(~few)
        for leaf_id in np.unique(leaf[many]).tolist():
            members = row[trie.starts[leaf_id] : trie.starts[leaf_id + 1]]
            asking = who[many[leaf[many] == leaf_id]]
            for side, other in ((first, None), (last, first)):
                order = members[np.argsort(side[members], kind="stable")]
                lo, hi = (np.searchsorted(side[order], side[asking], s) for s in ("left", "right"))
                for a, x, y in zip(asking.tolist(), lo.tolist(), hi.tolist(), strict=True):
                    j = order[x:y]
                    if other is not None:
                        j = j[other[j] != other[a]]
                    yield verified(np.full(len(j), a), j)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for the near words of every word of (word, n), both ways."""
    dealt = routes(words).repartition("route").sortWithinPartitions("route")

    def found(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        own = [w.encode("latin-1") for w in table.column("word").to_pylist()]
        route, part, shorter = (table.column(c).to_numpy() for c in ("route", "part", "shorter"))
        word, n = table.column("word").combine_chunks(), table.column("n").combine_chunks()
        for i, j in near_pairs(route, part, shorter, own):
            if len(i):
                a, b = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
                yield pa.RecordBatch.from_arrays([word.take(a), word.take(b), n.take(b)], ["word", "near", "near_n"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= BLOCK and b.num_rows:
                # whole routes only: what stands under the last one may go on in the next batch
                route = b.column("route").to_numpy()
                cut = int(np.searchsorted(route, route[-1]))
                if cut:
                    yield from found([*held[:-1], b.slice(0, cut)])
                    held, rows = [b.slice(cut)], b.num_rows - cut
        if held and rows:
            yield from found(held)

    return dealt.mapInArrow(search, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by following (word, form) to the end; a step doubles the way, counts grow along it, so there is no cycle."""
    at = kept_whole(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("via"), F.col("root").alias("next"))
        joined = kept_whole(at.join(on, F.col("root") == F.col("via"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return at


def variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = DAMAGE, letters: int = LEAST_LETTERS, count: int = LEAST_COUNT,
    dominance: int = DOMINANCE,
) -> DataFrame:
    """One row per word: n, n_near, its form (the commonest near word that dominates it), the form's n, and the root of its forms."""
    if dominance < 2:
        raise ValueError("a form must be commoner than its word, or forms could run in a circle")
    words = kept_whole(word_counts(docs, id_col, text_col, damage, letters, count))
    best = F.min(F.struct((-F.col("near_n")).alias("down"), F.col("near").alias("form"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    strong = -F.col("best.down") >= dominance * F.col("n")
    joined = kept_whole(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.form")).alias("form"),
        F.when(strong, -F.col("best.down")).alias("form_n"),
    ))
    roots = _roots(joined.where("form is not null"))
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
