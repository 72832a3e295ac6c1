"""Language identification: averaged hashed subword embeddings under a linear softmax.

Words give character n-grams, hashed into buckets; a text is the mean of its buckets' embeddings, and a softmax over
a linear map of the mean names the language. Stochastic gradient descent in numpy fits both on the driver from a
bounded sample: at most about TRAIN_ROWS labelled rows, dealt evenly over the languages and picked by hashes of
their ids. Executors turn the sampled texts into bucket counts, so no text reaches the driver. A part of
the sample is kept from the fit; on it the softmax temperature is set, and the lowest score at which at most
MAX_ERROR of the accepted texts are wrong. Predictions below it are flagged as rejected.

At prediction the two linear steps are one table of bucket logits, under a megabyte a few languages, broadcast
to the scan. Whole texts are read; the n-grams of a text's distinct words are hashed as arrays.

Defined cases: a text that is null or has no letter is `und` with score 0; without labelled rows every
text is `und`; labels of null are not learned; rows may repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayflow.functions.columns import q
from stayflow.llm.common import once, text_chunks

TRAIN_ROWS = 2000
BUCKETS, DIM, EPOCHS, RATE = 1 << 15, 16, 6, 0.5
GRAMS = (2, 3, 4)
#: Short extracts of each sampled text that join the fit, so that short texts are known too.
EXTRACTS, EXTRACT_WORDS = 3, 6
MAX_ERROR = 0.01
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
#: Distinct words of a text whose n-grams are held at a time.
SLICE = 20_000
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def hashed(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the word) of every n-gram inside <word>, and of every whole <word>.

    The words' code points are one array, so each n takes a few array operations for all words.
    """
    marked = [f"<{w}>" for w in found]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(marked)), lengths)
    hashes, owners = [], []
    for n in GRAMS:
        last = len(points) - n + 1
        inside = np.flatnonzero(owner[:last] == owner[n - 1 :])
        h = np.full(len(inside), n, np.uint64)
        for k in range(n):
            h = h * STEP + points[inside + k]
        hashes.append(h)
        owners.append(owner[inside])
    powers = np.cumprod(np.full(lengths.max(), STEP))
    hashes.append(np.add.reduceat(points * powers[np.arange(len(points)) - starts[owner]], starts))
    owners.append(np.arange(len(marked)))
    h = np.concatenate(hashes)
    h = (h ^ (h >> np.uint64(32))) * MIX
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), np.concatenate(owners)


def words(text: str | None) -> Counter[str]:
    found: Counter[str] = Counter()
    for chunk in text_chunks(text or ""):
        found.update(WORD.findall(chunk.lower()))
    # numbers that are no digits (fractions, Roman and circled ones) are no letters: they end a word
    for mixed in [w for w in found if not w.isalpha()]:
        n = found.pop(mixed)
        for part in "".join(c if c.isalpha() else " " for c in mixed).split():
            found[part] += n
    return found


def slices(found: Counter[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, count) of the n-grams of a text, SLICE distinct words at a time."""
    names, counts = list(found), np.fromiter(found.values(), np.float64, len(found))
    for a in range(0, len(names), SLICE):
        buckets, owner = hashed(names[a : a + SLICE])
        yield buckets, counts[a : a + SLICE][owner]


def bucket_counts(found: Counter[str]) -> tuple[np.ndarray, np.ndarray]:
    total = sum(np.bincount(b, n, BUCKETS) for b, n in slices(found))
    ids = np.flatnonzero(total)
    return ids.astype(np.int32), total[ids].astype(np.float32)


@dataclass
class Model:
    """Languages, bucket logits [BUCKETS, languages], bias, temperature and the least score that is accepted."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    accept: float = 0.0


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(examples: list[tuple[int, np.ndarray, np.ndarray, bool]], languages: list[str], seed: int = 7) -> Model:
    """examples: (label, bucket ids, counts, kept for calibration)."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, b = np.zeros((k, DIM), np.float32), np.zeros(k, np.float32)
    train = [x for x in examples if not x[3]] or examples
    steps, step = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(train)):
            label, ids, counts, _ = train[i]
            share = counts / counts.sum()
            h = share @ e[ids]
            g = _softmax(w @ h + b)
            g[label] -= 1
            rate = RATE * (1 - step / steps)
            back = w.T @ g
            w -= rate * np.outer(g, h)
            b -= rate * g * 0.1
            e[ids] -= rate * share[:, None] * back * min(len(ids), 50)
            step += 1
    model = Model(languages, e @ w.T, b)
    held = [x for x in examples if x[3]] or examples
    raw = np.array([(c / c.sum()) @ model.logits[ids] + b for _, ids, c, _ in held])
    truth = np.array([x[0] for x in held])
    rows = np.arange(len(truth))
    fits = {t: -np.log(np.maximum(_softmax(raw / t)[rows, truth], 1e-12)).mean() for t in np.geomspace(0.05, 5, 41)}
    model.temperature = float(min(fits, key=fits.get))
    p = _softmax(raw / model.temperature)
    order = np.argsort(-p.max(axis=1), kind="stable")
    wrong = np.cumsum(p.argmax(axis=1)[order] != truth[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(wrong <= MAX_ERROR)
    model.accept = float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", usable: Column | None = None, rows: int = TRAIN_ROWS) -> Model | None:
    """Fits on at most about `rows` rows that are `usable` and have a language; None if there are none."""
    labelled = docs.where(q(lang_col).isNotNull() & q(text_col).isNotNull() & (F.lit(True) if usable is None else usable))
    chosen = labelled.select(q(lang_col).cast("string").alias("lang"), q(text_col).cast("string").alias("text"), F.xxhash64(q(id_col).cast("string"), F.lit("lang")).alias("h"))
    # the languages are few: they are the classes of the model
    per_language = {r["lang"]: r["n"] for r in chosen.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not per_language:
        return None
    languages = sorted(per_language)
    quota = rows / len(languages)
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, quota / per_language[name]))])
    position = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = chosen.where(position < share[F.col("lang")])

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, text, h in zip(batch.column("lang"), batch.column("text"), batch.column("h")):
                lang, h = lang.as_py(), h.as_py()
                found = words(text.as_py())
                if not found:
                    continue
                held = (h >> 40) % 5 == 0
                picks = list(found)
                rng = np.random.default_rng(h & 0x7FFFFFFF)
                extracts = [Counter(picks[i] for i in rng.integers(0, len(picks), rng.integers(1, EXTRACT_WORDS + 1))) for _ in range(EXTRACTS)]
                for bag in (found, *extracts):
                    ids, counts = bucket_counts(bag)
                    out.append((lang, ids.tobytes(), counts.tobytes(), held))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary()), pa.array([o[3] for o in out], pa.bool_())],
                ["lang", "ids", "counts", "held"],
            )

    drawn = sample.mapInArrow(featured, "lang string, ids binary, counts binary, held boolean").collect()  # about `rows` * (1 + EXTRACTS) rows of at most BUCKETS entries
    examples = sorted(((languages.index(r["lang"]), bytes(r["ids"]), bytes(r["counts"]), r["held"]) for r in drawn), key=lambda x: x[:3])
    if not examples:
        return None
    return fit([(y, np.frombuffer(i, np.int32), np.frombuffer(c, np.float32), held) for y, i, c, held in examples], languages)


def predict_text(model: Model, text: str | None) -> tuple[str, float]:
    z, n = np.zeros(len(model.languages)), 0.0
    for buckets, counts in slices(words(text)):
        z += counts @ model.logits[buckets]
        n += counts.sum()
    if not n:
        return UNKNOWN, 0.0
    p = _softmax((z / n + model.bias) / model.temperature)
    best = int(p.argmax())
    return model.languages[best], float(p[best])


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", **keep: Column) -> DataFrame:
    """The kept expressions with lang_pred, score and rejected for every row."""
    if model is None:
        return docs.select(*[c.alias(n) for n, c in keep.items()], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    # plain values, so that a worker needs no module to read them
    held, key = docs.sparkSession.sparkContext.broadcast(astuple(model)), uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double")
    def named(texts):
        import pandas as pd

        fitted = once(key, lambda: Model(*held.value))
        return pd.DataFrame([predict_text(fitted, t) for t in texts], columns=["lang_pred", "score"])

    found = docs.select(*[c.alias(n) for n, c in keep.items()], named(q(text_col).cast("string")).alias("found"))
    return found.select(*keep, "found.lang_pred", "found.score", (F.col("found.score") < model.accept).alias("rejected"))


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Trains outside the held-out quarter and predicts every row. A null id is not held out."""
    out = F.coalesce(held_out(q(id_col)), F.lit(False))
    model = train(docs, id_col, text_col, lang_col, ~out)
    found = predict(docs, model, text_col, id=q(id_col), held_out=out)
    return found.select(F.col("id").alias(id_col), "held_out", "lang_pred", "score", "rejected")
