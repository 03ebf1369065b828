import numpy as np
import pytest

from linkwright.llm import embedding_dedup as E


def brute(rows, floor=0.98):
    n = len(rows)
    x = [np.array(v, float) if lab is not None and E.usable(v) else None for _, v, lab in rows]
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]):
                a, b = x[i] / np.abs(x[i]).max(), x[j] / np.abs(x[j]).max()
                link[i, j] = link[j, i] = a @ b / np.sqrt((a @ a) * (b @ b)) >= floor
    root = E.forest(link)
    out = []
    for i, (vec, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        c = min(ids, default=None)
        out.append((vec, int(link[i].sum()), c, vec == c))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], lab) for i, v, lab in rows], "vec_id long, embedding array<float>, label int")


def result(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=repr)


def vectors(seed, n=400, d=64):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, d))
    out = []
    for i in range(n):
        v = centres[rng.integers(20)] + rng.standard_normal(d) * rng.choice([0, 0.05, 0.12, 0.2, 1.0])
        out.append((int(i * 7 % 1009), v.astype(np.float32).tolist(), int(rng.integers(3))))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rows = vectors(seed)
    assert result(E.near_vectors(spark, frame(spark, rows))) == brute(rows)


def test_a_large_group_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    rows = [(i, (centre + rng.standard_normal(64) * 0.14).astype(np.float32).tolist(), 1) for i in range(200)] + [(300 + i, centre.astype(np.float32).tolist(), 1) for i in range(50)]
    monkeypatch.setattr(E, "BLOCK", 40)
    assert result(E.near_vectors(spark, frame(spark, rows))) == brute(rows)


def test_edges(spark, cluttered):
    one = [1.0] + [0.0] * 63
    rows = [(1, None, 1), (2, [], 1), (3, [0.0] * 64, 1), (4, [None] * 64, 1), (5, [float("nan")] + one[1:], 1), (6, [float("inf")] + one[1:], 1), (7, one, None), (8, one, 1), (9, [2.0] + one[1:], 1), (10, one, 2), (None, one, 1), (11, [1.0, 0.0, 0.0], 1), (12, [1.0], 1), (13, [1e-30] + one[1:], 1), (8, one, 1), (14, [3e38] + one[1:], 1), (15, [-1.0] + one[1:], 1), (16, [-0.0, 1.0] + [0.0] * 62, 3), (17, [0.0, 1.0] + [0.0] * 62, 3)]
    assert result(E.near_vectors(spark, cluttered(frame(spark, rows)))) == brute(rows)
    assert result(E.near_vectors(spark, frame(spark, []))) == []


@pytest.mark.parametrize("size", [E.WORDS, E.code_size(100_000), E.code_size(10_000_000)])
def test_every_link_shares_a_filter(size):
    """Recall of the filters themselves, over pairs just above the limit, with the codes of larger labels too."""
    rng = np.random.default_rng(9)
    found, posted = 0, 0
    for _ in range(500):
        x = rng.standard_normal(64)
        x /= np.linalg.norm(x)
        y = rng.standard_normal(64)
        y -= (x @ y) * x
        y /= np.linalg.norm(y)
        z = 0.98 * x + np.sqrt(1 - 0.98**2) * y
        found += len(np.intersect1d(E.filters(x, size), E.filters(z, size))) > 0
        posted += len(E.filters(x, size))
        assert (np.unpackbits(np.frombuffer(E.sketch(x), np.uint8)) != np.unpackbits(np.frombuffer(E.sketch(z), np.uint8))).sum() <= E.DIFFERENT
    assert found >= (499 if size == E.WORDS else 490) and posted / 500 < 1.5 * E.LEAST


@pytest.mark.parametrize("size", [E.WORDS, 30])
def test_list_decoding_finds_the_best_filters(size):
    rng = np.random.default_rng(3)
    rotation, words, _, cap = E.codes(64, size)
    for _ in range(25):
        x = rng.standard_normal(64)
        x /= np.linalg.norm(x)
        s = np.einsum("bwd,bd->bw", words, (x @ rotation).reshape(E.BLOCKS, -1))
        every = (s[0][:, None, None, None] + s[1][None, :, None, None] + s[2][None, None, :, None] + s[3][None, None, None, :]).ravel()
        got = E.filters(x, size)
        assert set(got.tolist()) == set(np.argsort(-every)[: len(got)].tolist()) and len(got) == max(E.LEAST, int((every >= cap).sum()))
