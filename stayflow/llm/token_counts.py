"""Token counts of whole texts with a public tokenizer.

Arrow batches go to the tokenizer library in groups of about equal bytes and only lengths come back. A long text
is cut where a space stands between two ASCII letters: the byte-level pre-tokenizer always starts a token at
such a space, so the counts of the parts add up to the count of the whole. A text without such a place stays in
one part, and sentence-piece models get whole texts.

The vocabulary file (one to two MB) is read on the driver and broadcast; executors need no copy of it.

Defined cases: a null text is empty and has 0 bytes and tokens; special strings in a text are what the library
makes of them by default; ids may be null or repeated; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stayflow.functions.columns import q
from stayflow.llm.common import once

LIMIT = 1024
#: Characters of a part of a long text, and of all parts that are encoded together.
PART, BATCH = 1 << 16, 1 << 18
SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts of about `size`, cut before safe spaces only."""
    start = 0
    while len(text) - start > size:
        found = SAFE.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def _lengths_of(model: bytes, kind: str) -> Callable[[list[str]], list[int]]:
    """The library's batch call, reduced to lengths. One worker has one core, so the library gets one thread."""
    if kind == ".json":
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_buffer(model)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]


def counted(texts: Iterator[str], lengths: Callable[[list[str]], list[int]], cut: bool) -> Iterator[int]:
    """Token counts in order; parts are encoded in groups of BATCH characters."""
    owners: list[int] = []
    group: list[str] = []
    totals: list[int] = []
    held = 0

    def encode() -> None:
        for owner, n in zip(owners, lengths(group), strict=True):
            totals[owner] += n
        owners.clear()
        group.clear()

    for text in texts:
        totals.append(0)
        for part in parts(text) if cut else (text,):
            if part:
                owners.append(len(totals) - 1)
                group.append(part)
                held += len(part)
            if held >= BATCH:
                encode()
                held = 0
    encode()
    yield from totals


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit. `path` is the tokenizer's file on the driver."""
    kind = os.path.splitext(path)[1]
    if kind not in (".json", ".model"):
        raise ValueError(f"no tokenizer library for {path}")
    with open(path, "rb") as f:
        model, key = docs.sparkSession.sparkContext.broadcast(f.read()), uuid.uuid4().hex
    text = F.coalesce(q(text_col).cast("string"), F.lit(""))
    rows = docs.select(q(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = StructType([rows.schema["id"], StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = once(key, lambda: _lengths_of(model.value, kind))
        for b in batches:
            n = list(counted((t.as_py() for t in b.column("text")), lengths, kind == ".json"))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(of_batches, out).select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
