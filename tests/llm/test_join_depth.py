"""Recall of the chosen-path join where buckets are split a second and a third time."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cohortlens.llm import jaccard_join as j
from tests.llm.test_set_operators import brute_join, docs


def _pairs(rng, n):
    """Texts in pairs just above the threshold: two of some 100 words replaced."""
    texts = []
    for i in range(n):
        w = [f"p{i}w{x}" for x in range(rng.randrange(96, 130))]
        other = list(w)
        for at in rng.sample(range(6, len(w) - 6), 2):
            other[at] = f"z{at}"
        texts += [" ".join(w), " ".join(other)]
    return texts


def _levels(texts, depth):
    """The buckets of every text at each level, all buckets split: the operator's own choice."""
    rate = 1 / j.THRESHOLD
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(n)]), pa.array(range(n)), pa.array(texts)], names=["key", "id", "text"])
    first = pa.Table.from_batches(list(j._first_level(j.WORDS, rate, j.RUNS)(iter([batch]))))
    paths = [sorted(set(x)) for x in first.column("buckets").to_pylist()]
    tokens, offs = j.token_sets(pa.array(texts), j.WORDS)
    sets = [tokens[a:b] for a, b in zip(offs, offs[1:], strict=False)]
    yield sets, paths
    for _ in range(depth - 1):
        rows = pa.RecordBatch.from_arrays(
            [pa.array([i.to_bytes(4) for i in range(n)], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(paths, pa.list_(pa.int64()))],
            names=["sig", "tokens", "paths"],
        )
        found = [set() for _ in range(n)]
        for out in j._next_level(rate)(iter([rows])):
            for sig, bucket in zip(out.column("sig").to_pylist(), out.column("bucket").to_pylist(), strict=True):
                found[int.from_bytes(sig)].add(bucket)
        paths = [sorted(x) for x in found]
        yield sets, paths


def test_pairs_near_the_threshold_share_a_bucket_at_every_depth():
    texts = _pairs(random.Random(2), 2000)
    for depth, (sets, paths) in enumerate(_levels(texts, j.MAX_DEPTH), 1):
        linked = kept = 0
        for a in range(0, len(texts), 2):
            n = len(np.intersect1d(sets[a], sets[a + 1]))
            if 5 * n >= 4 * (len(sets[a]) + len(sets[a + 1]) - n):
                linked += 1
                kept += bool(set(paths[a]) & set(paths[a + 1]))
        assert linked >= 1000
        print(f"depth {depth}: {kept} of {linked} linked pairs share a bucket")
        assert kept >= 0.999 * linked


@pytest.mark.parametrize("seed", [1])
def test_join_whose_buckets_reach_the_third_level_equals_brute_force(spark, monkeypatch, seed):
    """Passages that a fifth of all texts share: their buckets hold 80 sets, 16 after one split and
    more than the four allowed after two."""
    rng = random.Random(seed)
    passages = [[f"q{p}w{x}" for x in range(10)] for p in range(60)]
    texts = []
    for i in range(200):
        w = [x for p in sorted(rng.sample(range(60), 12)) for x in passages[p]]
        other = list(w)
        for at in rng.sample(range(len(w)), 2):
            other[at] = f"z{i}"
        texts += [" ".join(w), " ".join(other)]
    levels, real = [], j._next_level
    monkeypatch.setattr(j, "_next_level", lambda rate: levels.append(rate) or real(rate))
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in j.join_groups(docs(spark, texts), bucket_sets=4).collect()}
    assert len(levels) == j.MAX_DEPTH - 1 == 2
    want = brute_join(texts)
    assert sum(x[1] for x in want.values()) >= 300
    assert got == want
