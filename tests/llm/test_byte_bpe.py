import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from linkwright.llm import byte_bpe as B

PATH = public_tokenizers.path(B.VOCABULARY)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={})


def texts():
    rng = random.Random(1)
    own = ["".join(rng.choice("abcdeé中😀 \n\t'sl1=") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    own += ["a" * 5000, "ab" * 3000, "=" * 1000 + " " * 777 + "x", "aaab" * 100, "".join(rng.choice("aeinrst") for _ in range(3000)), "", None, "\x00 ", "0123456789" * 50, "the" * 17, "don't we'll <|endoftext|>", " " * 50]
    return own + ["".join(rng.choice("aeinrsth") for _ in range(rng.randint(40, 120))) for _ in range(100)]


def test_same_ids_as_tiktoken_and_back(reference):
    rows = texts()
    for text, (packed, decoded) in zip(rows, B.encode_texts(rows, PATH), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == reference.encode_ordinary(text or "")
        assert decoded == (text or "").encode()


def test_very_long_words(reference):
    """Words of hundreds of thousands of signs without a blank, in the time of a few queries."""
    rng = random.Random(2)
    cjk = "".join(chr(0x4E00 + min(int(rng.expovariate(1 / 1500)), 20000)) for _ in range(60_000))
    for text in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)), cjk, "".join(rng.choice("ABCdefGHIjkl0189+/") for _ in range(200_000))):
        packed, decoded = next(iter(B.encode_texts([text], PATH)))
        assert np.frombuffer(packed, "<u4").tolist() == reference.encode_ordinary(text) and decoded == text.encode()


def test_parts_that_nothing_cuts(monkeypatch):
    """The array way and the database way give the same ids."""
    rng = random.Random(3)
    bpe = B.Bpe(PATH)
    parts = [b"a" * 9001, b"ab" * 3000, b"=" * 777, "".join(rng.choice("aeinrst") for _ in range(700)).encode(), "été".encode() * 40]
    got = bpe.merge(parts)
    assert [bpe.contract(p) for p in parts] == [got[p] for p in parts]
    monkeypatch.setattr(B, "HUGE", 100)
    assert bpe.merge(parts) == got


def test_full_cache(reference, monkeypatch):
    monkeypatch.setattr(B, "CACHE_ENTRIES", 5)
    rows = [f"word{i} and word{i + 1} again" for i in range(40)]
    bpe = B.Bpe(PATH)
    for text in rows:
        ids, decoded = bpe.learn({*text.split(" ")})
        for w in text.split(" "):
            assert np.frombuffer(ids[w], "<u4").tolist() == reference.encode_ordinary(w) and decoded[ids[w]] == w.encode()
    assert len(bpe.ids) == 5


def test_query_rows(spark, documents, cluttered, reference):
    rows = [*((i, t) for i, t in enumerate(texts()[:60])), (700, None), (701, ""), (None, "no id"), (3, texts()[3])]
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in B.digests(cluttered(documents(rows))).collect()), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = {k: reference.encode_ordinary(t or "") for k, (_, t) in enumerate(rows)}
    assert got == sorted(((d, len(ids[k]), sha(np.array(ids[k], "<u4").tobytes()), sha((t or "").encode())) for k, (d, t) in enumerate(rows)), key=repr)
    assert B.digests(documents([])).collect() == []
    assert B.encode(documents([(1, "hi there")])).first()["ids"] == reference.encode_ordinary("hi there")
