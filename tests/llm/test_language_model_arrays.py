"""Look-ups in the stored arrays of the language model."""

import numpy as np

from stayflow.llm import ngram_lm as L


def test_values_of_keys_open_only_blocks_that_may_hold_them(tmp_path):
    rows, all_keys, all_n = [], [], []
    for k in range(5):
        keys = np.arange(100 * k, 100 * k + 50, 2, dtype=np.int64)
        n = (keys % 7 + 1).astype("i4")
        L.stored(str(tmp_path), f"pair-{k}.keys", keys)
        L.stored(str(tmp_path), f"pair-{k}.n", n)
        rows.append((k, int(keys[0]), len(keys)))
        all_keys += keys.tolist()
        all_n += n.tolist()
    blocks, known = L.Blocks(str(tmp_path), "pair", rows, {"n": "i4"}), dict(zip(all_keys, all_n))
    wanted = np.array([-1, -1, 100, 100, 101, 148, 149, 302, 399])
    assert blocks.of(wanted, "n").tolist() == [known.get(k, 0) for k in wanted.tolist()]
    assert {at for at, _ in blocks.open} <= {1, 3}
    assert blocks.places(wanted).tolist() == [all_keys.index(k) if k in known else -1 for k in wanted.tolist()]
    assert blocks.of(np.array([], np.int64), "n").tolist() == []


def test_numbers_before_start_anew_with_every_part():
    parts = [np.array([4, 5, 6]), np.array([7]), np.array([8, 9])]
    assert L._before([1, 2, 3], parts, np.concatenate(parts)).tolist() == [1, 4, 5, 2, 3, 8]


def test_numbers_of_words_with_a_full_memory(tmp_path, monkeypatch):
    words = [f"w{i}".encode() for i in range(40)]
    keys = np.sort(np.array([L._hash(w) for w in words], np.uint64).view(np.int64))
    L.stored(str(tmp_path), "word-0.keys", keys)
    monkeypatch.setattr(L, "KNOWN", 10)
    number = L.Numbers(L.Blocks(str(tmp_path), "word", [(0, int(keys[0]), len(keys))], {"n": "i8"}))
    at = {int(k): i for i, k in enumerate(keys)}
    for part in (words[:8], words[4:12], [b"none", words[0], b"none"], words):
        assert number(part).tolist() == [at.get(int(np.uint64(L._hash(w)).view(np.int64)), -1) for w in part]
