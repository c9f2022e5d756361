"""Mixing sources to target weights by a low-discrepancy schedule.

The size of a document is its number of words. Sources, by code point and null last, weigh
1, 2, 3, 1, ... and share the sum of all sizes by weight; a target stops at 3 times
its source's size, and the excess is shared by weight among the others until none is above.

Method. Each source's documents are shuffled (by a keyed hash) and laid end to end, and that
line is cut into blocks of ``BLOCK`` words. Slot i of the mix is the point frac(i * golden
ratio), computed in whole numbers modulo 10^18; the sources' cumulative targets divide
the unit interval, so a point falls to a source. The r-th slot of a source takes its r-th
block, going through the line again after the last. As every stretch of the sequence is spread
evenly, every stretch of the mix holds the sources in proportion. A source whose target is
reached passes its further slots; words that the finite sequence left short follow in
closing slots. So each source gives its target rounded down, and no document more than 3 times.

Results: ``mix``: one row for each piece of a document in a slot; ``mixed_text``: the text of
each slot; ``taken``: for each document its size, its source's size and target, the words
taken, and its first and last slot (-1 if none).

Null texts and texts without words have size 0 and are never taken. Null sources are one
source. Null ids share a hash; ties are ordered by size and by the text's hash, so repeated
rows lie next to each other and reruns agree. Long documents go over many blocks. No rows: no
rows; if all are empty, all targets are 0. Other columns are not read.

Scale. Texts are read once for sizes and never shuffled by ``taken``. A hot source is laid
out and ranked in buckets of its hash and of its slots, with prefix sums over the buckets;
points meet the cumulative targets in a sorted sweep in bins of equal width, to which the
sequence gives equal numbers of points; blocks and slots are joined by (source, block), which
is even. Only totals, and one number a partition, reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import WORD, cut, cut_table, table

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK = 256
SEED = 13
#: The fraction of the golden ratio in units of 10^-18, odd and not divisible by 5: all points differ.
GOLDEN, UNIT = 618033988749894849, 10**18
#: Slots in a bin or a chunk, buckets of a source's documents (of 60 hash bits), sources in a bucket.
SLOTS, BUCKET_BITS, NUMBERS = 65_536, 12, 10_000
#: Sources that are broadcast; more are joined in as many parts of each source as SALT.
SOURCES, SALT = 100_000, 64


def _before(df: DataFrame, by: list[str], bucket: Column, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each one, in order: within its
    bucket (buckets follow the order) and over the buckets before."""
    df = df.withColumn("_b", bucket)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    base = df.groupBy(*by, "_b").agg(F.sum(value).alias("_s"))
    base = base.withColumn("_base", zero(F.sum("_s").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))).drop("_s")
    inner = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, zero(F.sum(value).over(inner))).join(base, [*by, "_b"]).withColumn(name, F.col(name) + F.col("_base")).drop("_b", "_base")


def _numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``no``, its place from 0 in that order: a range sort and one count a partition."""
    rows = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).cast("int")
    counts = {x["p"]: x["n"] for x in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    base, bases = 0, [(-1, 0)]
    for p in sorted(counts):
        bases.append((p, base))
        base += counts[p]
    first = df.sparkSession.createDataFrame(bases, "_p int, _first long")  # one row a partition
    rows = rows.withColumn("_p", part).join(F.broadcast(first), "_p")
    return rows.withColumn("no", F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_p", "_first")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, with_text: bool = False) -> DataFrame:
    """id, source, size, h (60 bits that shuffle the documents) and tie of each document."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long").alias("h"), F.xxhash64(text_col).alias("tie"),
        *([F.col(text_col).alias("text")] if with_text else []),
    )


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """no, source, source_size, target, take (the target rounded down), n_blocks and need (slots)
    of each source."""
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = cut(_numbered(found, F.col("source").isNull(), F.col("source")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int")).cast("long")
    found = found.withColumn("w", weight)
    wide = lambda c: c.cast("decimal(19,0)")
    free, rest = 1, 0

    def above() -> Column:
        """Whether a source's share of what is left, rest / free a weight, is above its limit.
        That share only grows as others reach their limits."""
        return wide(F.lit(rest)) * wide(F.col("w")) > wide(F.col("source_size") * most) * wide(F.lit(free))

    whole = found.agg(F.sum("source_size").alias("s"), F.sum("w").alias("w")).first()
    free, rest = whole["w"] or 1, whole["s"] or 0
    while True:
        x = found.agg(F.sum(F.when(above(), F.col("source_size") * most)).alias("s"), F.sum(F.when(~above(), F.col("w"))).alias("w")).first()
        new = (x["w"] or 1, (whole["s"] or 0) - (x["s"] or 0))
        if new == (free, rest):
            break
        free, rest = new
    share = F.col("w") * F.lit(rest)
    found = found.withColumns(
        {
            "target": F.when(above(), (F.col("source_size") * most).cast("double")).otherwise(share.cast("double") / F.lit(free).cast("double")),
            "take": F.when(above(), F.col("source_size") * most).otherwise(F.call_function("div", share, F.lit(free).cast("long"))),
            "n_blocks": F.ceil(F.col("source_size") / block).cast("long"),
        }
    )
    found = found.withColumn("need", F.expr(f"case when source_size = 0 then 0 else (take div source_size) * n_blocks + (take % source_size + {block - 1}) div {block} end"))
    return cut(found.drop("w"))


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with their source's columns; a hot source is joined in parts."""
    named = sources.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if sources.count() <= SOURCES:
        return rows.join(F.broadcast(named), same).drop("_source")
    many = named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = rows.withColumn("_mine", F.pmod("h", F.lit(SALT)).cast("int"))
    return dealt.join(many, same & (F.col("_mine") == F.col("_salt"))).drop("_source", "_mine", "_salt")


def lay_out(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with no, source_size, target and start, the words before a document in its
    source's shuffled line. Start names a document that has words."""
    placed = _with_source(rows, sources.select("no", "source", "source_size", "target"))
    return _before(placed, ["no"], F.shiftright("h", 60 - BUCKET_BITS), ["h", "size", "tie"], "size", "start")


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, no, pass, block and words of each slot of the mix."""
    spark = sources.sparkSession
    lines = sources.where("take > 0").select("no", "source_size", "take", "n_blocks", "need")
    lines = cut(_before(lines, [], F.floor(F.col("no") / NUMBERS), ["no"], "take", "lo"))
    whole = lines.agg(F.sum("take")).first()[0] or 0
    points = -(-whole // block)
    bins = max(1, -(-points // SLOTS))
    width = max(1, -(-whole // bins))
    wide = lambda c: c.cast("decimal(20,0)")
    u = (wide(F.col("i")) * F.lit(GOLDEN).cast("decimal(18,0)")).cast("decimal(38,0)") % F.lit(UNIT).cast("decimal(19,0)")
    v = F.call_function("div", wide(u) * F.lit(whole).cast("decimal(18,0)"), F.lit(UNIT).cast("decimal(19,0)")).cast("long")
    drawn = spark.range(0, points, 1, bins).select(F.col("id").alias("i")).select("i", v.alias("v"))
    drawn = drawn.select(F.expr(f"v div {width}").alias("bin"), "v", "i", F.lit(None).cast("long").alias("own"))
    spans = lines.select("no", "lo", F.expr(f"explode(sequence(lo div {width}, (lo + take - 1) div {width}))").alias("bin"))
    spans = spans.select("bin", F.greatest("lo", F.col("bin") * width).alias("v"), F.lit(None).cast("long").alias("i"), F.col("no").alias("own"))
    sweep = Window.partitionBy("bin").orderBy("v", F.col("i").isNotNull(), "own").rowsBetween(Window.unboundedPreceding, 0)
    met = spans.unionByName(drawn).withColumn("no", F.last("own", ignorenulls=True).over(sweep)).where("i is not null").select("i", "no")
    ranked = _before(met.withColumn("one", F.lit(1)), ["no"], F.expr(f"i div {SLOTS}"), ["i"], "one", "r")
    ranked = cut_table(ranked.select("no", "i", "r"))
    have = ranked.groupBy("no").agg(F.count(F.lit(1)).alias("have"))
    lines = lines.join(have, "no", "left").withColumn("have", F.least(F.coalesce("have", F.lit(0)), F.col("need")))
    short = _before(lines.withColumn("lack", F.col("need") - F.col("have")), [], F.floor(F.col("no") / NUMBERS), ["no"], "lack", "after")
    closing = short.where("lack > 0").select("no", F.expr("explode(sequence(have, need - 1))").alias("r"), "have", "after")
    closing = closing.select("no", (F.lit(points) + F.col("after") + F.col("r") - F.col("have")).alias("slot"), "r")
    slots = ranked.select("no", F.col("i").alias("slot"), "r").unionByName(closing)
    lines = lines.select("no", "source_size", "take", "n_blocks", "need")
    slots = slots.join(F.broadcast(lines) if lines.count() <= SOURCES else lines, "no").where("r < need")
    slots = slots.selectExpr("slot", "no", "r div n_blocks as pass", "r % n_blocks as block", "source_size", "take")
    return slots.selectExpr("slot", "no", "pass", "block", f"least({block}, source_size - block * {block}, take - pass * source_size - block * {block}) as words")


def _pieces(placed: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """slot, no, pass, start (the document's), first (its first word), at (in the slot), words."""
    cut_up = placed.where("size > 0").select("no", "start", "size", F.expr(f"explode(sequence(start div {block}, (start + size - 1) div {block}))").alias("block"))
    cut_up = cut_up.select(
        "no", "block", "start", F.greatest(F.lit(0).cast("long"), F.col("start") - F.col("block") * block).alias("at"),
        F.greatest(F.lit(0).cast("long"), F.col("block") * block - F.col("start")).alias("first"),
        F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block).cast("long")).alias("end"),
    )
    met = cut_up.join(slots, ["no", "block"]).where("words > at")
    return met.select("slot", "no", "pass", "start", "first", "at", (F.least("end", "words") - F.col("at")).alias("words"))


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, weights: tuple[int, ...], most: int, block: int) -> tuple[DataFrame, DataFrame]:
    rows = cut_table(measure(docs, id_col, text_col, source_col, seed))
    sources = targets(rows, weights, most, block)
    placed = cut_table(lay_out(rows, sources))
    return placed, _pieces(placed, schedule(sources, block), block)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = SEED,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """slot, at, id, source, pass, first, words: word ``first`` and on of a document stand at
    word ``at`` of the slot. By (slot, at) the pieces are the mix."""
    placed, pieces = _plan(docs, id_col, text_col, source_col, seed, weights, most, block)
    who = placed.where("size > 0").select("no", "start", F.col("id").alias(id_col), F.col("source").alias(source_col))
    return pieces.join(who, ["no", "start"]).select("slot", "at", id_col, source_col, "pass", "first", "words")


def mixed_text(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = SEED,
               id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """slot, source, text: the words of each slot, joined by one space."""
    placed, pieces = _plan(docs, id_col, text_col, source_col, seed, weights, most, block)
    key = ["source", "size", "h", "tie"]
    texts = measure(docs, id_col, text_col, source_col, seed, with_text=True).where("size > 0").dropDuplicates(key)  # repeated rows have one text
    same = placed.where("size > 0").select("no", "start", *key)
    texts = same.join(texts, [same[c].eqNullSafe(texts[c]) for c in key]).select("no", "start", same["source"].alias("source"), "text")
    parts = pieces.join(texts, ["no", "start"])
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    parts = parts.withColumn("part", F.array_join(F.slice(words, (F.col("first") + 1).cast("int"), F.col("words").cast("int")), " "))
    return parts.groupBy("slot", "source").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("p")).select(
        "slot", F.col("source").alias(source_col), F.array_join(F.col("p")["part"], " ").alias(text_col)
    )


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = SEED,
          id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size, source_size, target, taken, first_slot, last_slot of every document."""
    placed, pieces = _plan(docs, id_col, text_col, source_col, seed, weights, most, block)
    sums = pieces.groupBy("no", "start").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
    # Only documents with words are taken; those without may share a start with one.
    sums = sums.withColumnsRenamed({"no": "_no", "start": "_start"})
    found = placed.join(sums, (F.col("no") == F.col("_no")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0), "left")
    return found.select(F.col("id").alias(id_col), "size", "source_size", "target", *[F.coalesce(c, F.lit(none)).cast("long").alias(c) for c, none in (("taken", 0), ("first_slot", -1), ("last_slot", -1))])


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents"))


#: The targets in closed form (sources reach their limits in the order of size by weight),
#: the points by an as-of join, all in whole numbers.
OP13_SQL = rf"""
with d as (select row_number() over () as row, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
 substr(md5('{SEED}:' || coalesce(doc_id::varchar, 'null')), 1, 15) as h from documents),
s0 as (select source, sum(size)::bigint as s, row_number() over (order by source nulls last) - 1 as no from d group by source),
s1 as (select *, no % 3 + 1 as w from s0),
s2 as (select *, coalesce(sum({MOST} * s) over o, 0) as cs, coalesce(sum(w) over o, 0) as cw, sum(s) over () as ts, sum(w) over () as tw from s1
 window o as (order by s * 6 // w, no rows between unbounded preceding and 1 preceding)),
s3 as (select *, w * (ts - cs) > {MOST} * s * (tw - cw) as capped from s2),
s4 as (select *, ts - coalesce(sum({MOST} * s) filter (capped) over (), 0) as rest, sum(w) filter (not capped) over () as free from s3),
s as (select source, no, s, case when capped then ({MOST} * s)::double else (rest * w)::double / free::double end as target,
 (case when capped then {MOST} * s else (rest * w) // free end)::bigint as take, (s + {BLOCK - 1}) // {BLOCK} as nb from s4),
t as (select *, (take // s * nb + (take % s + {BLOCK - 1}) // {BLOCK})::bigint as need, (sum(take) over (order by no) - take)::bigint as lo from s where take > 0),
m as (select sum(take)::hugeint as whole, ((sum(take) + {BLOCK - 1}) // {BLOCK})::bigint as points from t),
p as (select i, (((i::hugeint * {GOLDEN}) % {UNIT}) * whole // {UNIT})::bigint as v from m, lateral (select unnest(range(points)) as i)),
r as (select i as slot, t.no, row_number() over (partition by t.no order by i) - 1 as r from p asof join t on p.v >= t.lo),
k as (select t.no, need, least(need, count(slot))::bigint as have from t left join r using (no) group by t.no, need),
c as (select no, have, need, (sum(need - have) over (order by no) - (need - have))::bigint as after from k),
e as (select (points + after + q - have)::bigint as slot, no, q as r from c, m, lateral (select unnest(range(have, need)) as q)),
x as (select slot, no, r // nb as pass, r % nb as block, s, take from (from r union all by name from e) join t using (no) where r < need),
y as (select *, least({BLOCK}, s - block * {BLOCK}, take - pass * s - block * {BLOCK}) as words from x),
l as (select d.row, no, size, (sum(size) over (partition by no order by h, size, d.row) - size)::bigint as start from d join s0 on d.source is not distinct from s0.source),
q as (select row, no, start - b * {BLOCK} as lo, start + size - b * {BLOCK} as hi, b from l, lateral (select unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) as b) where size > 0),
z as (select row, sum(least(hi, words) - greatest(lo, 0))::bigint as taken, min(slot) as first_slot, max(slot) as last_slot
 from q join y on q.no = y.no and q.b = y.block where least(hi, words) > greatest(lo, 0) group by row)
select doc_id, size, s.s as source_size, target, coalesce(taken, 0) as taken, coalesce(first_slot, -1) as first_slot, coalesce(last_slot, -1) as last_slot
from d join s on d.source is not distinct from s.source left join z using (row)
"""
