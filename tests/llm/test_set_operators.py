"""Extraction, passages, Jaccard join, packing, decontamination and the pipeline against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations, product

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm import decontaminate, html_extract, html_training, jaccard_join, packing, registry, suffix_dedup
from cohortlens.llm.common import shingles, words

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, sig string, row long, key string, id string, bucket long"
WS = r"[^\x20\x09-\x0D]+"


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", None, "t", 7, "k", "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_words_are_cut_at_ascii_white_space_only():
    texts = ["", None, "a", " b\tc\x0bd ", "é f g" * 3, "x" * 100 + " y", "  "]
    row, start, end, h = words(pa.array(texts))
    got = defaultdict(list)
    raw = "".join(t or "" for t in texts).encode()
    for r, a, b in zip(row, start, end, strict=True):
        got[int(r)].append(raw[a:b].decode())
    assert [got[i] for i in range(len(texts))] == [re.findall(WS, t or "") for t in texts]
    by = {}
    for r, a, b, x in zip(row, start, end, h, strict=True):
        assert by.setdefault(raw[a:b], x) == x
    assert len(set(by.values())) == len(by)
    assert len(shingles(row, h, 5)[0]) == sum(max(0, len(v) - 4) for v in got.values())


# --- extraction


def test_field_on_held_out_pages():
    chain = html_extract.trained()
    xs, ys = html_extract.labelled(html_training.pages(200, 10**6))
    wrong = sum(a != b for x, y in zip(xs, ys, strict=True) for a, b in zip(chain.viterbi(x), y, strict=True))
    assert wrong <= 0.01 * sum(map(len, ys))


def test_viterbi_is_the_best_of_all_state_sequences():
    rng = np.random.default_rng(0)
    chain = html_extract.Chain({f"f{i}": i for i in range(5)}, rng.normal(size=(5, 2)), rng.normal(size=(2, 2)))
    for n in range(1, 7):
        seq = [[f"f{j}" for j in rng.integers(0, 5, 2)] for _ in range(n)]
        value = lambda s: sum(chain.weights[int(f[1:]), y] for b, y in zip(seq, s, strict=True) for f in b) + sum(chain.moves[a, b] for a, b in zip(s, s[1:]))  # noqa: B023, E731
        assert np.isclose(value(chain.viterbi(seq)), max(map(value, product((0, 1), repeat=n))))


def test_likelihood_fit_learns_a_transition():
    chain = html_extract.Chain.fit([[["a"], ["b"], ["b"]], [["c"], ["b"], ["b"]]] * 5, [[1, 1, 1], [0, 0, 0]] * 5, rounds=80)
    assert chain.viterbi([["a"], ["b"], ["b"]]) == [1, 1, 1] and chain.viterbi([["c"], ["b"], ["b"]]) == [0, 0, 0]


def test_articles_of_the_table(spark):
    p = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in p.collect()}
    got = html_extract.extract(p).collect()
    assert len(got) == len(html)
    same = 0
    for r in got:
        body = re.search(r"(?s)<article>(.*?)(?:</article>|<footer|\Z)", html[r.page_id])[1]
        from html import unescape

        same += r.text == " ".join(unescape(re.sub(r"<[^>]*>", " ", body)).split())
        assert r.n_chars == len(r.text)
    assert same >= 0.99 * len(html)


def test_odd_pages(spark):
    pages = [None, "", "just text", "<p>", "<", "<!-- x", "<script>var a='<p>no</p>'</script>", "<article><p>One &amp; two&nbsp;&#233; <b>th</b>ree,\n four five.</p></article>" * 2,
             "<div class='comments'><p>" + "a reader says so. " * 9 + "</p></div>", "<a title=\"a>b\" href='x'>", "<p>" + "long text here. " * 50_000]
    d = spark.createDataFrame([(i, "u", h, "z") for i, h in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(d).collect()}
    assert len(got) == len(pages) and all(got[i].text == "" for i in (0, 1, 3, 5, 6, 8))
    assert got[7].text == "One & two é three, four five. One & two é three, four five."
    assert got[10].text == ("long text here. " * 50_000).strip()
    assert html_extract.extract(d.limit(0)).count() == 0


# --- passages


def brute_passages(texts, least):
    w = [re.findall(WS, t or "") for t in texts]
    where = defaultdict(set)
    for i, x in enumerate(w):
        for j in range(len(x) - least + 1):
            where[tuple(x[j : j + least])].add(i)
    out = set()
    for i, x in enumerate(w):
        hit = sorted({k for j in range(len(x) - least + 1) if len(where[tuple(x[j : j + least])]) > 1 for k in range(j, j + least)})
        for j, k in enumerate(hit):
            if not j or hit[j - 1] != k - 1:
                first = k
            if j + 1 == len(hit) or hit[j + 1] != k + 1:
                out.add((i, first, k + 1))
    return out


def test_passages_equal_brute_force(spark):
    rng = random.Random(3)
    shared = [prose(rng, n) for n in (49, 50, 51, 80, 200)]
    texts = [None, "", "x " * 200, "x " * 60 + "y", "one two"]
    for _ in range(60):
        x = prose(rng, rng.randrange(0, 150))
        for s in rng.sample(shared, rng.randrange(3)):
            a = rng.randrange(0, 20)
            x += s[a:] + prose(rng, rng.randrange(0, 30))
        texts.append(rng.choice([" ", "\n"]).join(x))
    texts += [texts[10], " ".join(shared[3] + shared[3])]
    got = {(r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeated_passages(docs(spark, texts)).collect()}
    assert got == brute_passages(texts, 50) and got
    assert suffix_dedup.repeated_passages(docs(spark, [])).count() == 0


def test_passages_of_the_table_equal_brute_force(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = d.collect()
    got = {(r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeated_passages(d).collect()}
    assert got == {(rows[i].doc_id, a, b) for i, a, b in brute_passages([r.text for r in rows], 50)}


# --- Jaccard join


def brute_join(texts):
    def tokens(t):
        w = re.findall(WS, t or "")
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])

    s = [tokens(t) for t in texts]
    near = defaultdict(set)
    for a, b in combinations(range(len(s)), 2):
        n = len(s[a] & s[b])
        if 5 * n >= 4 * (len(s[a]) + len(s[b]) - n):
            near[a].add(b)
            near[b].add(a)
    out, label = {}, {}
    for i in range(len(s)):
        if i not in label:
            todo, seen = [i], {i}
            while todo:
                new = near[todo.pop()] - seen
                seen |= new
                todo += new
            label |= dict.fromkeys(seen, i)
        out[i] = (label[i], len(near[i]), s.count(s[i]))
    return out


def variants(rng):
    texts = [None, "", " \n", "a", "a", "a b c d", "a b c d e", "x " * 500, "x " * 400]
    for _ in range(12):
        base = prose(rng, rng.choice([6, 12, 30, 150, 400]), 5000)
        for _ in range(rng.randrange(1, 9)):
            x = list(base)
            for _ in range(rng.randrange(0, max(2, len(x) // 40 + 1))):
                x[rng.randrange(len(x))] = f"z{rng.randrange(9)}"
            texts.append(" ".join(x))
    return texts


@pytest.mark.parametrize("bucket_sets", [1500, 3])
def test_join_equals_brute_force(spark, bucket_sets):
    texts = variants(random.Random(5))
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in jaccard_join.join_groups(docs(spark, texts), bucket_sets=bucket_sets).collect()}
    assert got == brute_join(texts)


def test_join_of_the_table_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    want = {tuple(r) for r in con.execute(registry.ORACLE_SQL["op6_ngram_jaccard"]).fetchall()}
    assert {tuple(r) for r in registry.QUERIES["op6_ngram_jaccard"](spark, SMALL).collect()} == want


def test_join_of_nulls_repeats_and_nothing(spark):
    got = jaccard_join.join_groups(docs(spark, ["p q r s t u", "p q r s t u", "v", "p q r s t u"], [None, 4, 4, 4])).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 4, 2, 3), (4, 4, 2, 3), (4, 4, 2, 3), (4, 4, 0, 1)], key=str)
    assert jaccard_join.join_groups(docs(spark, [])).count() == 0
    kept = jaccard_join.keep_one(docs(spark, ["p q r s t u", "p q r s t u", "v", "p q r s t u"], [None, 4, 4, 4]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(4, "p q r s t u"), (4, "v")] and kept.columns == docs(spark, []).columns


def test_only_texts_that_are_asked_for_are_shuffled(spark, tmp_path):
    texts = [f"text number {i} of the table" for i in range(500)]
    docs(spark, texts).write.parquet(f"{tmp_path}/d")
    d = spark.read.parquet(f"{tmp_path}/d").select(jaccard_join._key("doc_id", "text").alias("key"), "doc_id", "text")
    sigs = jaccard_join.signatures(*jaccard_join.token_sets(pa.array(texts), 5))
    names = spark.createDataFrame([(i, bytearray(sigs[i])) for i in (3, 77, 401)], "doc_id long, sig binary")
    asked = jaccard_join._asked(d.join(names, "doc_id").select("key", "sig"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with jaccard_join.runtime_filters(spark, asked.count()):
            got = jaccard_join._fetch(d, asked, 5)
            plan = got._jdf.queryExecution().optimizedPlan().toString()
            got = {bytes(r.sig) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "might_contain" in plan and got == {sigs[i] for i in (3, 77, 401)}


def test_linked_pair_that_shares_few_buckets(spark):
    # 4 of 5 shingles in common; the pair shares two buckets in the first 16 runs.
    w = [f"{c}173798" for c in "abcdefghi"]
    got = jaccard_join.join_groups(docs(spark, [" ".join(w[:8]), " ".join(w)])).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got) == [(0, 0, 1, 1), (1, 0, 1, 1)]
    assert jaccard_join.RUNS >= 24  # at depth 3 a run keeps a pair at the threshold with a chance of 0.37


def test_blocks_count_every_pair_once():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) > 0.03], rng.integers(0, 2**63, 5).astype(np.uint64)])) for _ in range(40)]
    from fractions import Fraction

    want = np.array([sum(5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)) for b in sets) - 1 for a in sets])
    seen, one = [np.zeros(0, np.int64)] * 40, np.ones(40, np.int64)
    assert (jaccard_join.compare(sets, one, seen, None, Fraction(4, 5))[0] == want).all()
    half = np.arange(40) % 2
    both = jaccard_join.compare(sets, one, seen, half, Fraction(4, 5))[0]
    for s in (0, 1):
        at = np.flatnonzero(half == s)
        both[at] += jaccard_join.compare([sets[i] for i in at], one[at], [seen[i] for i in at], None, Fraction(4, 5))[0]
    assert (both == want).all()


# --- packing


def check_packing(got, texts, length=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_file())
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in texts.items()}
    by, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        seqs[r.sequence_id].append((r.offset, r.length))
    assert set(by) == set(ids)
    for i, pieces in by.items():
        at = 0
        for s, n, crc, total in sorted(pieces):
            assert s == at and n > 0 and total == len(ids[i])
            assert crc == zlib.crc32(np.array(ids[i][s : s + n], dtype="<u4").tobytes())
            at += n
        assert at == len(ids[i])
    for p in seqs.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= length
    return sum(map(len, ids.values())) / (len(seqs) * length)


ODD = ["", None, "a", "It's THE <|endoftext|> é İ ß 𝔘 🙂 '’s 12 3½ x y​", "x" * 3000, "don't we'll 'S ÀÉ çÿ×÷ <|startoftext|>x", "Σς word\x1cword\x85"]


def test_packing_round_trip(spark):
    texts = dict(enumerate(ODD)) | {100 + r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    d = docs(spark, list(texts.values()), list(texts))
    assert check_packing(packing.pack(d).collect(), texts) > 0.99
    check_packing(packing.pack(d, shard_bytes=50_000).collect(), texts)
    assert packing.pack(docs(spark, [])).count() == 0
    same = packing.pack(docs(spark, ["a b c"] * 3, [None, 1, 1])).collect()
    assert len(same) == 3 and sorted(r.offset for r in same) == [0, 4, 8]


def test_bm25_and_greedy_fill():
    import math

    rng = random.Random(2)
    texts = [" ".join(prose(rng, rng.randrange(1, 60), 40)) for _ in range(30)]
    row, _, _, h = words(pa.array(texts))
    _, term = np.unique(h, return_inverse=True)
    index = packing.Index(30, row, term, int(term.max()) + 1)
    w = [t.split() for t in texts]
    mean = sum(map(len, w)) / 30
    for q in range(30):
        for d in range(30):
            n = Counter(w[d])
            want = 0
            for x in set(w[q]):
                df = sum(x in y for y in w)
                want += max(0, math.log((30 - df + 0.5) / (df + 0.5))) * n[x] * 2.2 / (n[x] + 1.2 * (0.25 + 0.75 * len(w[d]) / mean))
            assert np.isclose(index.scores(q)[d], want)
    order = [p[0] for p in packing.fill([10, 10, 10, 10], lambda s: np.array([[0, 1, 2, 3], [0] * 4, [0] * 4, [0, 5, 4, 0]][s], float), 100)]
    assert order == [0, 3, 2, 1]  # by the seed's scores, while the window is open
    assert packing.fill([15, 8], lambda s: np.zeros(2), 10) == [(0, 0, 10, 0, 0), (0, 10, 5, 1, 0), (1, 0, 5, 1, 5), (1, 5, 3, 2, 0)]


def test_packing_counts_and_topics_come_from_all_documents(spark):
    rng = random.Random(5)
    texts = [" ".join([*prose(rng, 30, 300), f"{i % 70}topic"]) for i in range(2500)] + ["", None, "a a a"]
    d = docs(spark, texts).select("text", F.col("doc_id").alias("row")).repartition(7)
    counts = packing._summed(d.select("text"), packing._counted).reshape(-1)
    want = np.zeros(1 << packing.WEIGHT_BITS, np.int64)
    for x in texts:
        _, _, _, h = words(pa.array([x], pa.string()))
        want[np.unique(h >> np.uint64(64 - packing.WEIGHT_BITS)).astype(np.int64)] += 1
    assert (counts == want).all()
    points, _, _ = packing.draws(pa.array(texts, pa.string()), packing.weights(counts, len(texts)))
    rows = [(i, bytearray(x.tobytes())) for i, x in enumerate(points)]
    got = [packing.fit_topics(spark.createDataFrame(rows, "row long, point binary").repartition(n)) for n in (1, 6)]
    assert (got[0] == got[1]).all()  # exact sums: no topic depends on how the rows were dealt
    start = spark.createDataFrame(rows, "row long, point binary").orderBy(F.xxhash64("row")).limit(packing.TOPICS).collect()
    centres = np.array([np.frombuffer(r.point, np.int8) for r in start])
    for _ in range(packing.ROUNDS):  # every document moves its centre
        near = (points.astype(np.int64) @ centres.T.astype(np.int64)).argmax(1)
        for c in set(near.tolist()):
            if (total := points[near == c].sum(0, dtype=np.int64)).any():
                centres[c] = np.clip(np.rint(total * (packing.UNIT / np.linalg.norm(total))), -127, 127)
    assert (got[0] == centres).all()


def test_related_documents_share_a_shard(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(300):  # pairs of near copies, far apart in the table
        w = prose(rng, 120, 20_000)
        texts.append((w, [*w[:55], *prose(rng, 10, 20_000), *w[65:]]))
    texts = [" ".join(a) for a, _ in texts] + [" ".join(b) for _, b in texts] + [" ".join(prose(rng, 100, 20_000))] * 200
    d = docs(spark, texts)
    got = packing.pack(d, shard_bytes=20_000).collect()
    check_packing(got, dict(enumerate(texts)))
    shard = {r.doc_id: r.sequence_id >> 32 for r in got}
    assert len(set(shard.values())) > 20
    assert sum(shard[i] == shard[300 + i] for i in range(300)) > 180  # dealt at random: about 10
    sizes = Counter()
    for i, s in shard.items():
        sizes[s] += len(texts[i]) + 16
    assert max(sizes.values()) <= 21_000  # copies fill as many shards as they need


# --- decontamination


def brute_tiles(a, b, least):
    """Greedy string tiling by the definition: the longest unmarked run, first in the item, then in the document."""
    ua, ub, got = [False] * len(a), [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ua[i + n] and not ub[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return got
        ua[i : i + n] = ub[j : j + n] = [True] * n
        got.append(n)


def test_tiling_equals_the_definition():
    rng = random.Random(4)
    for _ in range(60):
        a, b = [[rng.randrange(4) for _ in range(rng.randrange(5, 40))] for _ in range(2)]
        h = lambda x: np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(77)
        tiles = decontaminate.tile(h(a), h(b), np.zeros(len(b), int), 3)
        assert sorted(t[2] for t in tiles) == sorted(brute_tiles(a, b, 3))
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in tiles)


@pytest.mark.parametrize("block_bytes", [16 << 20, 200])
def test_leaks(spark, block_bytes):
    rng = random.Random(6)
    items = [prose(rng, n, 3000) for n in (15, 20, 40, 60, 4)]
    turned = items[3][30:] + prose(rng, 9) + items[3][:30]
    texts = {0: None, 1: "", 2: " ".join(prose(rng, 300, 3000)), 3: " ".join(prose(rng, 30) + items[0] + prose(rng, 5)), 4: " ".join(turned),
             5: " ".join(items[2][:15] + prose(rng, 20)), 6: " ".join(items[1] + items[2]), 7: "\n".join(items[1] * 3), 8: " ".join(items[4])}
    bench = spark.createDataFrame([(i, " ".join(x), "c") for i, x in enumerate(items)] + [(9, None, "c"), (10, "", "c"), (11, " ".join(items[0]), "c")], "item_id long, text string, id string")
    d = docs(spark, list(texts.values()), list(texts))
    got = {(r.doc_id, r.item_id, r.matched_words, r.item_words) for r in decontaminate.find_leaks(d, bench, block_bytes=block_bytes).collect()}
    assert got == {(3, 0, 15, 15), (3, 11, 15, 15), (4, 3, 60, 60), (6, 1, 20, 20), (6, 2, 40, 40), (7, 1, 20, 20)}
    kept = decontaminate.drop_leaks(d, bench, block_bytes=block_bytes)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 5, 8] and kept.columns == d.columns
    assert decontaminate.find_leaks(d, bench.limit(0)).count() == 0 and decontaminate.find_leaks(d.limit(0), bench).count() == 0
    assert decontaminate.drop_leaks(d, bench.limit(0)).count() == len(texts)


def test_leaks_in_capitals_and_with_changed_punctuation(spark):
    rng = random.Random(8)
    item = [*prose(rng, 12, 3000), "straße", "Ôter", "λόγος", "don't", *prose(rng, 4, 3000)]
    marked = [f"“{w}”," if i % 3 == 0 else f"({w})…" if i % 3 == 1 else w for i, w in enumerate(item)]
    own = prose(rng, 15, 3000)
    texts = {1: " ".join([*own, *item]).upper(), 2: " ".join([*own, *marked]), 3: " ".join(w.replace("'", "") + "x" for w in item)}
    bench = spark.createDataFrame([(5, " ".join(item)), (6, "... ... ... ... ...")], "item_id long, text string")
    got = decontaminate.find_leaks(docs(spark, list(texts.values()), list(texts)), bench).collect()
    assert {(r.doc_id, r.item_id, r.matched_words, r.item_words, r.n_tiles) for r in got} == {(1, 5, 20, 20, 1), (2, 5, 20, 20, 1)}
    assert [decontaminate.fold(w) for w in ("«A-B!»", "--", "É", "İ")] == ["a-b", "--", "é", "i̇"]


def test_leaks_of_the_table_equal_brute_force(spark):
    d, b = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id): r.matched_words for r in decontaminate.find_leaks(d, b).collect()}
    want = {}
    items = [(r.item_id, r.text.split()) for r in b.collect()]
    for r in d.collect():
        w = re.findall(WS, r.text)
        seeds = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for i, x in items:
            if any(tuple(x[k : k + 5]) in seeds for k in range(len(x) - 4)):
                n = sum(brute_tiles(x, w, 5))
                if 2 * n >= len(x):
                    want[r.doc_id, i] = n
    assert got == want and got


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    docs_ = spark.read.parquet(f"{SMALL}/documents.parquet")
    first, seen = docs_.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs_
        stage(spark, before, SMALL).write.parquet(str(tmp_path / name))
        docs_ = spark.read.parquet(str(tmp_path / name))
        assert docs_.columns == first
        seen.append(({r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in docs_.collect()}))
    (a, b), (c, d), (e, f), (g, h) = seen
    good = {r.doc_id for r in registry.QUERIES["op5_quality_rules"](spark, SMALL).where("kept").collect()}
    assert set(b) == good
    ids = sorted(c)
    want = brute_join([c[i] for i in ids])
    assert set(d) == {ids[x[0]] for x in want.values()}
    leaks = {r.doc_id for r in registry.QUERIES["op8_decontamination"](spark, SMALL).collect()}
    assert set(f) == set(e) - leaks
    assert set(h) == set(g) and all(("AKIA" not in h[i]) for i in h)
    assert all(h[i] == g[i] for i in g if "[SECRET]" not in h[i])
    assert check_packing(corpus_pipeline.run(spark, SMALL).collect(), h) > 0.95


def test_sketches_rule_out_no_pair_at_the_threshold():
    from fractions import Fraction

    rng = np.random.default_rng(5)
    sets = []
    for n in (1, 2, 5, 9, 40, 300, 700, 3000, 40000):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        for lose in (0, 0.02, 0.1, 0.11, 0.12, 0.2, 0.5):
            cut = int(round(n * lose))
            sets.append(np.unique(np.concatenate([base[cut:], rng.integers(0, 2**63, cut).astype(np.uint64)])))
            sets.append(np.unique(base[cut:]) if cut < n else base)
    sets.sort(key=len)
    n = np.array([len(x) for x in sets])
    a, b = jaccard_join.may_be_linked(n, np.zeros(len(n), np.int64), [jaccard_join.sketch(x) for x in sets], Fraction(4, 5))
    kept = set(zip(a.tolist(), b.tolist()))
    linked = {(i, j) for i, j in combinations(range(len(sets)), 2) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (n[i] + n[j])}
    assert linked <= kept
    far = [(i, j) for i, j in combinations(range(len(sets)), 2) if n[i] >= 300 and not len(np.intersect1d(sets[i], sets[j]))]
    assert not kept & set(far)  # sets without a common token are told apart


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_buckets_are_parted_alike_however_the_rows_come(batch):
    from fractions import Fraction

    rng = np.random.default_rng(6)
    rows = []
    for bucket in (-5, 3, 9, 12):
        for _ in range(3):
            base = rng.integers(0, 2**63, 200).astype(np.uint64)
            for _ in range(int(rng.integers(1, 4))):
                x = np.unique(np.concatenate([base[:190], rng.integers(0, 2**63, 10).astype(np.uint64)]))
                rows.append((bucket, len(x), rng.bytes(16), jaccard_join.sketch(x), base[0]))
    rows.sort(key=lambda r: r[:3])
    cols = list(zip(*rows, strict=True))
    table = pa.table({"bucket": pa.array(cols[0], pa.int64()), "n": pa.array(cols[1], pa.int64()), "sig": pa.array(cols[2], pa.binary()), "sketch": pa.array(cols[3], pa.binary())})
    out = [r for b in jaccard_join._part_buckets(Fraction(4, 5))(iter(table.to_batches(max_chunksize=batch))) for r in b.to_pylist()]
    family = {sig: (bucket, base) for bucket, _, sig, _, base in rows}
    sizes = Counter(family.values())
    assert {r["sig"] for r in out} == {s for s, f in family.items() if sizes[f] > 1}
    parts = defaultdict(set)
    for r in out:
        parts[r["bucket"]].add(family[r["sig"]])
        assert r["m"] == sizes[family[r["sig"]]] and family[r["to"]] == family[r["sig"]]
    assert all(len(p) == 1 for p in parts.values()) and len(parts) == sum(v > 1 for v in sizes.values())
