"""Vector codes, sharded Lloyd and the source schedule against brute force and SQL."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from cohortlens.llm import registry, sharded_lloyd, source_schedule, vector_codes

SMALL = "/root/testdata/sf0.001"
WS = r"[^\x20\x09-\x0D]+"
VEC = "vec_id long, embedding array<float>, label int, id string, v long, chunk long, code string, error long, cluster int, _label int, part int"
DOC = "doc_id long, text string, lang string, source string, no long, size long, h long, tie long, start long, take long, slot long, block long, id string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 2, "c", 3, 4, 5, 6) for i, v, label in rows], VEC)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, *[9] * 8, "x") for i, t, s in rows], DOC)


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_sharded_lloyd", "op13_source_mix"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SMALL)
    want = con.sql(f"select {', '.join(sorted(got.columns))} from ({registry.ORACLE_SQL[name]})").fetchall()
    assert rows_of(got) == sorted(want, key=repr)


# --- vector codes


def test_equal_average_search_is_exact():
    rng = np.random.default_rng(1)
    for k, d, spread in ((1, 3, 5), (256, 16, 400), (100, 1, 9), (40, 5, 2), (256, 16, 1 << 24), (7, 0, 1)):
        entries, x = rng.integers(-spread, spread + 1, (k, d)), rng.integers(-spread, spread + 1, (1300, d))
        at, best = vector_codes.nearest(x, entries)
        every = ((x[:, None, :] - entries[None, :, :]) ** 2).sum(2)
        assert (at == every.argmin(1)).all() and (best == every.min(1)).all()


def by_hand(kept, parts, entries, rounds):
    """Codes and codebooks by comparing everything, in Python integers."""
    kept = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dim]
    wide = -(-dim // parts)
    cut = lambda v, p: (v + [0] * (wide * parts - dim))[p * wide : (p + 1) * wide]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, v, _ in kept:
                members[near(cut(v, p), books[p])[1]].append(cut(v, p))
            for e, xs in members.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for i, v, label in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    per = Counter()
    for _, _, error, label in out:
        per[label] += error
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, code, error, per[label], sha) for i, code, error, label in out]


def test_codes_against_brute_force_with_nulls_ties_and_repeats(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=10) * 3], int(i) % 3) for i in range(60)]
    rows += [rows[5], rows[5], (None, rows[6][1], None), (None, [0.0] * 10, None), (70, [1e30] + [0.0] * 9, None), (-0, rows[7][1], 1)]
    bad = [(100, None, 1), (101, [None] * 10, 1), (102, [float("nan")] + [0.0] * 9, 1), (103, [float("inf")] + [0.0] * 9, 2), (104, [1.0] * 4, 2), (105, [], 2)]
    got = vector_codes.compress(vectors(spark, rows + bad), entries=9, rounds=3)
    lim = vector_codes.LIMIT
    kept = [(i, [max(-lim, min(lim, math.floor(x * 1024))) for x in v], label) for i, v, label in rows]
    want = by_hand(kept, 4, 9, 3)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_codes_of_no_rows_and_of_empty_vectors(spark):
    assert vector_codes.compress(vectors(spark, [])).collect() == []
    assert vector_codes.compress(vectors(spark, [(1, None, None)])).collect() == []
    got = vector_codes.compress(vectors(spark, [(1, [], 1), (2, [], None), (3, [1.0], 1)])).collect()
    assert sorted((x.vec_id, x.code, x.error) for x in got) == [(1, "00000000", 0), (2, "00000000", 0)]


def test_decoded_codes_are_the_entries(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    kept = vector_codes.quantise(df)
    books, dim = vector_codes.fit(kept, rounds=1)
    codes = vector_codes.encode(kept, books, dim)
    back = vector_codes.decode(codes, books, dim).join(kept.select("id", "v"), "id").collect()
    assert len(back) == df.count()
    for x in back:
        assert sum((round(a * 1024) - b) ** 2 for a, b in zip(x.approx, x.v, strict=True)) == x.error


# --- sharded Lloyd


def lloyd(kept, k, rounds):
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cents = [list(v) for _, v in sorted(kept, key=key)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(cents))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[near(v)[1]].append(v)
        for e, xs in members.items():
            cents[e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = [(i, near(v)) for i, v in kept]
    per = Counter()
    for _, (d, e) in out:
        per[e] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(i, e, d, per[e], sum(per.values()), sha[e]) for i, (d, e) in out]


@pytest.mark.parametrize("blocks,chunk", [(4, 4096), (3, 7), (1, 10), (11, 5)])
def test_lloyd_against_brute_force(spark, blocks, chunk):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=10) * (1 + 40 * (i % 2))], 0) for i in range(50)]
    rows += [rows[3], rows[3], (None, rows[4][1], 0), (60, [0.5] * 10, 1), (61, [0.5] * 10, 1), (62, [-0.001] * 10, 1)]
    bad = [(100, None, 1), (101, [1.0] * 9, 1), (102, [float("nan")] * 10, 1), (103, [None] * 10, 1), (104, [], 1)]
    got = sharded_lloyd.cluster(vectors(spark, rows + bad), clusters=6, dim=10, blocks=blocks, chunk=chunk)
    want = lloyd([(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows], 6, 3)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_lloyd_of_few_and_no_rows(spark):
    assert sharded_lloyd.cluster(vectors(spark, [])).collect() == []
    rows = [(1, [0.5] * 64, 0), (2, [0.5] * 64, 0), (3, [-3.0] * 64, None)]
    got = {x.vec_id: (x.cluster, x.distance, x.inertia) for x in sharded_lloyd.cluster(vectors(spark, rows)).collect()}
    assert got[1] == got[2] and got[1][1:] == (0, 0) and got[3][0] != got[1][0]


def test_packed_numbers_come_back():
    for x in ([], [0, 255], [-128, 127], [-129], [65535, 0], [70000], [-70000], [2**40, -(2**40)]):
        assert sharded_lloyd.unpack(sharded_lloyd.pack(np.array(x, np.int64))).tolist() == x


# --- source schedule


def shares(sizes):
    """Targets by refilling until none is above, in exact fractions."""
    from fractions import Fraction

    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        above = {s for s in names if s not in capped and Fraction(rest * w[s], free) > 3 * sizes[s]}
        if not above:
            return {s: Fraction(3 * sizes[s]) if s in capped else Fraction(rest * w[s], free) for s in names}
        capped |= above


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(4)
    rows = [(int(i), " ".join(f"w{i}.{j}" for j in range(int(rng.integers(0, 60)))), "hot" if i % 2 else "b") for i in range(120)]
    rows += [(200, "x " * 3, "a"), (201, None, "a"), (202, "", None), (203, "one\ttwo\x0bthree four", None), (None, "n u l l", "é"), (None, None, "é"), (204, " \n", "zero")]
    rows += [(205, " ".join(f"long{j}" for j in range(3000)), "z"), rows[1], rows[1], rows[1]]
    return rows


@pytest.mark.parametrize("block", [7, 256])
def test_mix_takes_targets_whole_blocks_and_no_document_too_often(spark, corpus, block):
    df = docs(spark, corpus)
    sizes = Counter()
    for _, t, s in corpus:
        sizes[s] += len(re.findall(WS, t or ""))
    want = shares(dict(sizes) | {s: sizes[s] for _, _, s in corpus})
    got = source_schedule.taken(df, block=block).collect()
    assert len(got) == len(corpus)
    assert sum(x.size for x in got) == sum(sizes.values()) and all(0 <= x.taken <= 3 * x.size for x in got)
    by_source = defaultdict(lambda: [0, None, None])
    pieces = source_schedule.mix(df, block=block).collect()
    for p in pieces:
        by_source[p.source][0] += p.words
    for s, t in want.items():
        assert by_source[s][0] == int(t)  # rounded down
    for x in got:
        assert any(math.isclose(x.target, float(t), rel_tol=1e-12) and x.source_size == sizes[s] for s, t in want.items())
    assert sum(x.taken for x in got) == sum(p.words for p in pieces)
    slots = defaultdict(list)
    for p in pieces:
        slots[p.slot].append(p)
    for own in slots.values():
        own.sort(key=lambda p: p["at"])
        assert len({p.source for p in own}) == 1 and own[0]["at"] == 0  # one block of one source
        assert all(a["at"] + a.words == b["at"] for a, b in zip(own, own[1:], strict=False)) and own[-1]["at"] + own[-1].words <= block
    again = source_schedule.taken(df.repartition(5), block=block)
    assert rows_of(again) == sorted((tuple(x[c] for c in sorted(again.columns)) for x in got), key=repr)


def test_slots_are_the_golden_points_through_the_cumulative_targets(spark, corpus):
    block = 7
    rows = source_schedule.measure(docs(spark, corpus))
    sources = source_schedule.targets(rows, block=block)
    info = sorted(sources.where("take > 0").collect(), key=lambda s: s.no)
    got = sorted((x["slot"], x["no"]) for x in source_schedule.schedule(sources, block).collect())
    whole = sum(s["take"] for s in info)
    points = -(-whole // block)
    want, have = [], Counter()
    for i in range(points):
        v = (i * source_schedule.GOLDEN % source_schedule.UNIT) * whole // source_schedule.UNIT
        own = next(s for s in info if v < sum(x["take"] for x in info if x.no <= s.no))
        if have[own.no] < own.need:
            want.append((i, own.no))
            have[own.no] += 1
    closing = [s.no for s in info for _ in range(s.need - have[s.no])]
    assert got == sorted(want + [(points + j, no) for j, no in enumerate(closing)])
    # Every stretch holds the sources in proportion, within a few slots.
    for s in info:
        for upto in range(1, points, 37):
            assert abs(sum(no == s.no for i, no in want if i < upto) - upto * s["take"] / whole) <= 2 + math.log2(points)


def test_mixed_texts_are_the_words_of_the_pieces(spark, corpus):
    df = docs(spark, corpus)
    texts = {x.slot: x.text for x in source_schedule.mixed_text(df, block=7).collect()}
    pieces = defaultdict(list)
    own = defaultdict(set)
    for i, t, s in corpus:
        own[i, s].add(tuple(re.findall(WS, t or "")))
    for p in source_schedule.mix(df, block=7).collect():
        words = next(w for w in own[p.doc_id, p.source] if len(w) >= p["first"] + p.words)
        pieces[p.slot].append((p["at"], words[p["first"] : p["first"] + p.words]))
    assert texts == {k: " ".join(w for _, part in sorted(v) for w in part) for k, v in pieces.items()}


def test_mix_of_no_rows_and_of_empty_texts(spark):
    assert source_schedule.taken(docs(spark, [])).collect() == []
    got = source_schedule.taken(docs(spark, [(1, None, "a"), (2, " ", None), (2, "", "b")])).collect()
    assert sorted((x.doc_id, x["size"], x.source_size, x.target, x.taken) for x in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_many_sources_join_in_parts_and_match_the_broadcast(spark, corpus, monkeypatch):
    df = docs(spark, corpus)
    want = rows_of(source_schedule.taken(df, block=7))
    monkeypatch.setattr(source_schedule, "SOURCES", 0)
    monkeypatch.setattr(source_schedule, "SLOTS", 16)
    monkeypatch.setattr(source_schedule, "NUMBERS", 2)
    assert rows_of(source_schedule.taken(df, block=7)) == want
