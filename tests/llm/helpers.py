"""Small hostile tables and brute-force counterparts for the corpus operators."""

import re

import numpy as np
import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Column names that the operators use inside.
CLASHES = ["row", "id", "digest", "size", "shard", "u", "p", "n", "host", "path", "fp", "salt", "hits", "removed", "copies", "text_crc32"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

EDGES = [
    (1, "A first line of text\nsecond line here now\nthird line of it all\nand a tail", "en", "a", 1),
    (2, "intro of two\nA first line of text\nsecond line here now\nthird line of it all\nother end", "en", "a", None),
    (3, None, None, None, None),
    (4, "", "fr", "b", 0),
    (5, "  \t\n ", "fr", None, 3),
    (6, "one", "en", "c", 3),
    (7, "one", "en", "c", 3),
    (7, "one", "en", "c", 3),
    (None, "one", "de", "c", 3),
    (None, None, "de", "c", 3),
    (8, "One  two\tthree four five", "en", "b", 5),
    (9, "One two three four five", "en", "b", 5),
    (10, "été à la plage ñandú 123 été", "fr", "d", 7),
    (11, "word " * 30000, "en", "d", 9),
]


def edge_docs(spark, clash=True):
    docs = spark.createDataFrame(EDGES, SCHEMA).repartition(3)
    if clash:
        docs = docs.selectExpr("*", *[f"'x{i}' AS `{c}`" for i, c in enumerate(CLASHES)])
    return docs


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def simhash(text):
    words = re.findall(WORD, (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(values, bits=4):
    """Index of the least member reachable, for every value."""
    a = np.array(values, dtype=np.uint64)
    parent = list(range(len(a)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= bits):
            x, y = find(i), find(int(j))
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]
