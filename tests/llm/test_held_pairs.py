"""Large groups of near copies: what a task holds doesn't follow their square."""

import tracemalloc
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from cohortlens.llm import jaccard_join as j

T = Fraction(4, 5)


def near_copies(seed, m, n=60):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n).astype(np.uint64)
    return [np.unique(np.concatenate([base[rng.random(n) > 0.06], rng.integers(0, 2**63, 3).astype(np.uint64)])) for _ in range(m)]


@pytest.mark.parametrize("held", [1, 50, 1 << 20])
def test_links_and_classes_in_blocks_equal_brute_force(monkeypatch, held):
    monkeypatch.setattr(j, "HELD_PAIRS", held)
    sets = [*near_copies(1, 30), *near_copies(2, 17), *near_copies(3, 1)]
    m = len(sets)
    alike = np.array([[a != b and 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b])) for b in range(m)] for a in range(m)])
    assert 0 < alike[:30, :30].sum() < 30 * 29
    reach = (alike | np.eye(m, dtype=bool)).astype(float)
    for _ in range(6):
        reach = ((reach @ reach) > 0).astype(float)
    weights = np.arange(1, m + 1)
    shared = [np.array([7, 9][: i % 3], np.int64) for i in range(m)]
    here = np.array([[len(np.intersect1d(a, b)) == 0 for b in shared] for a in shared])
    for side in (None, np.arange(m) % 2):
        links, label = j.compare(sets, weights, shared, side, T)
        pairs = alike if side is None else alike & (side[:, None] != side[None, :])
        assert (links == (pairs & here) @ weights).all()
        if side is None:
            assert (label == reach.argmax(1)).all()


def test_compare_holds_a_bounded_number_of_pairs():
    sets = near_copies(4, 3000)
    none, one = [np.zeros(0, np.int64)] * 3000, np.ones(3000, np.int64)
    tracemalloc.start()
    links, _ = j.compare(sets, one, none, None, T)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert links.sum() > 10**6
    assert peak < 150e6  # 3000 times 3000 numbers of 8 bytes are 72 MB, several times over


def test_near_copies_in_a_bucket_are_not_asked_again_once_connected(monkeypatch):
    asked = []
    monkeypatch.setattr(j, "_counts", lambda data, f=j._counts: asked.append(1) or f(data))
    rows = sorted((b, len(x), bytes([b, i // 256, i % 256]), j.sketch(x)) for b in (1, 2) for i, x in enumerate(near_copies(b, 400)))
    cols = list(zip(*rows, strict=True))
    table = pa.table({"bucket": pa.array(cols[0], pa.int64()), "n": pa.array(cols[1], pa.int64()), "sig": pa.array(cols[2], pa.binary()), "sketch": pa.array(cols[3], pa.binary())})
    out = [r for b in j._part_buckets(T)(iter(table.to_batches())) for r in b.to_pylist()]
    assert len(out) == 800 and {(r["sig"][0], r["m"]) for r in out} == {(1, 400), (2, 400)} and len({r["to"] for r in out}) == 2
    assert len(asked) < 20 * 800  # every pair: 320,000
