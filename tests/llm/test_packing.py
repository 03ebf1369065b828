import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from linkwright.llm import packing as P


def check_plan(histogram, capacity):
    ranks, bins = {}, {}
    for length, first, count, sequence, per, offset in P.plan(histogram, capacity).tolist():
        for i in range(count):
            ranks.setdefault(length, set()).add(first + i)
            bins.setdefault(sequence + i // per, []).append((offset + i % per * length, length))
    assert {n: len(r) for n, r in ranks.items()} == {n: c for n, c in histogram.items() if c}
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity and sum(3 * n > capacity for _, n in own) <= 2
    return len(bins)


@pytest.mark.parametrize("seed", range(60))
def test_plans_hold_and_are_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([9, 10, 30, 100, 4096])
    lengths = [rng.randint(1, capacity if rng.random() < 0.5 else max(1, capacity // 4)) for _ in range(rng.randint(0, 400))]
    histogram = {}
    for n in lengths:
        histogram[n] = histogram.get(n, 0) + 1
    bins = check_plan(histogram, capacity)
    assert bins <= 1.25 * sum(lengths) / capacity + 2 + sum(3 * n > 2 * capacity for n in lengths)


def test_large_items_are_matched_as_often_as_can_be():
    assert check_plan({60: 10, 40: 10}, 100) == 10
    assert check_plan({50: 7}, 100) == 4
    assert check_plan({66: 3, 35: 3, 34: 3}, 100) == 5  # three pairs of 66 and 34, and the 35s in pairs
    assert check_plan({100: 5}, 100) == 5
    assert check_plan({1: 1000}, 100) == 10


def expected(rows, capacity=4096):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((doc, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=repr)


def check_rows(rows, capacity=4096):
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_pack(spark, documents, cluttered):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["The", "cat's", "é,", "x.", "1234", "<|endoftext|>", "İ", "don't", "a b", "..."]) for _ in range(rng.randint(0, 900)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "word " * 9000), (903, "a" * 30_000), (None, "no id"), (5, rows[5][1]), (904, "ſt ﬁ ΌΔΥΣΣΕΎΣ שָׁלוֹם हिन्दी 漢字")]
    got = P.pack(spark, cluttered(documents(rows))).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr) == expected(rows)
    assert check_rows(got) <= -(-sum(r["length"] for r in got) // 4096) + 1
    assert P.pack(spark, documents([])).collect() == []


def test_equal_lengths_over_many_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_ROWS", 7)
    got = P.pack(spark, documents([(i, "one two three") for i in range(300)]), capacity=9).collect()
    assert len(got) == 300 and check_rows(got, 9) == 150
