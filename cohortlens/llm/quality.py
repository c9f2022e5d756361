"""Quality rules: fixed base rules, then robust multivariate outliers. DataFrame functions only.

Base. A text fails with fewer than 50 words or with more than half of its words in
repeated three-word windows.

Method. For each language and source the minimum-covariance-determinant estimate of four
transformed statistics is found by concentration steps: distances from the present centre
and scatter, the ``H_SHARE`` nearest rows, their mean and covariance. Each group goes on for itself until its
log determinant falls by no more than ``LEAST_DROP``; there is no limit of steps, and
as determinants have a floor, there is an end. Two deterministic starts (median and MAD;
mean and covariance) take their steps together; the smaller determinant wins. A text is rejected when its squared Mahalanobis distance,
with the consistency factor of the half-sample, passes ``CUTOFF``.

Statistics are held as fixed-point integers of 1/1024, so sums are exact and the result
does not depend on the order of rows. The nearest rows are all rows up to a distance bin
(1/64 in the logarithm), the first that reaches the share. Variances have a floor
(``FLOOR``), so a group of all-equal rows rejects nothing near it. Groups of fewer than
``MIN_GROUP`` rows are judged in the pool of such groups of their language, and these
pools, if small too, in one pool; a pool under ``MIN_POOL`` rows rejects nothing.

Null text has no words and fails the base. Null language or source is a group of its own.
Repeated rows count each time and give one row each. Long texts are read whole. No rows:
no rows. Columns other than id, text, language and source are not read.

Scale. The texts are read once; what follows is a narrow table in the shared folder. Every
step is a partial aggregate per group (a group with a third of all rows is as many partial
rows as tasks) and a join of a table of one row a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import SPACE, cut, cut_narrow, table

#: Base rules. Fixed values.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"

H_SHARE = 0.75
#: A group's steps end when its log determinant falls by no more.
LEAST_DROP = 1e-9
#: Consistency factor for four dimensions at a share of 0.75.
CONSISTENCY = 1.485
#: Squared distance from which a text is an outlier: ten robust standard deviations.
CUTOFF = 100.0
#: Least standard deviations: log mean word length, root symbols a word, root repeated
#: lines a word, share of words in repeated windows.
FLOOR = (0.03, 0.03, 0.02, 0.05)
MIN_GROUP, MIN_POOL = 200, 50
SCALE = 1024
#: Models (a few dozen numbers) that are broadcast to their rows.
MODELS = 20_000

P = len(FLOOR)


def _held(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns behind a generator, so that each is computed once for a row and not
    once for each place that uses it."""
    fields = F.struct(*[c.alias(n) for n, c in cols.items()])
    return df.select("*", F.inline(F.array(fields)))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, ``keep`` columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    d = docs.select(F.col(id_col).alias("id"), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = _held(
        d,
        words=F.array_remove(F.split("text", SPACE + "+"), ""),
        lines=F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0),
        word_chars=F.length(F.translate("text", WHITE, "")).cast("long"),
        n_symbols=(F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long"),
    ).drop("text")
    n = F.size("words")
    d = d.withColumns({"n_words": n.cast("long"), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")}).drop("lines")
    many = F.greatest(n - 2, F.lit(0))
    windows = F.arrays_zip(F.slice("words", 1, many).alias("a"), F.slice("words", F.least(F.lit(2), n + 1), many).alias("b"), F.slice("words", F.least(F.lit(3), n + 1), many).alias("c"))
    # 64-bit hashes of the windows, compared within one text only.
    d = _held(d, h=F.transform(windows, lambda x: F.xxhash64(x["a"], x["b"], x["c"]))).drop("words")
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = _held(d, s=F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs).otherwise(F.slice(pairs, 1, 0))).drop("h")
    three = lambda i: F.array(i, i + 1, i + 2)
    twice = F.zip_with("s", F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), lambda x, y: F.when(x["h"] == y["h"], F.concat(three(x["i"]), three(y["i"]))))
    spots = F.flatten(F.filter(twice, lambda x: x.isNotNull()))
    return d.withColumn("n_repeat_words", F.size(F.array_distinct(spots)).cast("long")).drop("s")


def _vector() -> list[Column]:
    w = F.greatest("n_words", F.lit(1))
    raw = [F.log(F.greatest("word_chars", F.lit(1)) / w), F.sqrt(F.col("n_symbols") / w), F.sqrt(F.col("n_dup_lines") / w), F.col("n_repeat_words") / w]
    return [F.round(x * SCALE).cast("long").alias(f"x{i}") for i, x in enumerate(raw)]


def _distance() -> Column:
    """Squared distance to the centre m* by forward substitution with the factor l**."""
    z: list[Column] = []
    for i in range(P):
        rest = F.col(f"x{i}") / SCALE - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * z[j]
        z.append(rest / F.col(f"l{i}{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0])


def _factor(sums: DataFrame, *more: str) -> DataFrame:
    """Centre, Cholesky factor of the floored covariance and its log determinant for each
    group, from exact sums n, s*, s**."""
    n = F.col("n").cast("double")
    d = sums.select("g", *more, *[(F.col(f"s{i}") / n / SCALE).alias(f"m{i}") for i in range(P)],
                    *[((F.col(f"s{i}{j}") / n - F.col(f"s{i}") / n * (F.col(f"s{j}") / n)) / SCALE**2 + (FLOOR[i] ** 2 if i == j else 0)).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)])
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            d = d.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    det = sum((F.log(f"l{i}{i}") for i in range(1, P)), F.log("l00"))
    return d.select("g", *more, *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i in range(P) for j in range(i + 1)], (2 * det).alias("det"))


def _sums(rows: DataFrame, *more: str) -> DataFrame:
    x = [F.col(f"x{i}") for i in range(P)]
    wide = lambda c: F.sum(c.cast("decimal(20,0)"))
    return rows.groupBy("g", *more).agg(F.count(F.lit(1)).alias("n"), *[wide(x[i]).alias(f"s{i}") for i in range(P)], *[wide(x[i] * x[j]).alias(f"s{i}{j}") for i in range(P) for j in range(i + 1)])


def _step(rows: DataFrame, model: DataFrame) -> DataFrame:
    """One concentration step of each model (g, start): that of the group's nearest rows."""
    near = rows.join(model, "g").withColumn("bin", F.floor(F.log1p(_distance()) * 64)).select("g", "start", "bin", *[f"x{i}" for i in range(P)])
    hist = cut_narrow(near.groupBy("g", "start", "bin").agg(F.count(F.lit(1)).alias("k")))
    so_far = Window.partitionBy("g", "start").orderBy("bin")
    total = Window.partitionBy("g", "start")
    last = hist.withColumn("upto", F.sum("k").over(so_far)).withColumn("all", F.sum("k").over(total))
    last = last.where(F.col("upto") >= F.ceil(F.col("all") * H_SHARE)).groupBy("g", "start").agg(F.min("bin").alias("last"))
    return _factor(_sums(near.join(last, ["g", "start"]).where("bin <= last"), "start"), "start")


def _starts(rows: DataFrame) -> DataFrame:
    """The two first models of each group."""
    mid = cut_narrow(rows.groupBy("g").agg(*[F.percentile(f"x{i}", 0.5).alias(f"m{i}") for i in range(P)]))
    away = rows.join(mid, "g").groupBy("g").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(P)], *[F.percentile(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5).alias(f"a{i}") for i in range(P)]
    )
    robust = away.select(
        "g", *[(F.col(f"m{i}") / SCALE).alias(f"m{i}") for i in range(P)],
        *[(F.greatest(1.4826 * F.col(f"a{i}") / SCALE, F.lit(FLOOR[i])) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(P) for j in range(i + 1)],
        F.lit(0.0).alias("det"),
    )
    return cut_narrow(robust.withColumn("start", F.lit(0)).unionByName(_factor(_sums(rows)).withColumn("start", F.lit(1))))


def estimate(rows: DataFrame) -> DataFrame:
    """Minimum-determinant centre and factor for each group of the rows (g, x0..)."""
    starts = _starts(rows)
    side = F.broadcast if starts.count() <= MODELS else lambda df: df
    model, found = cut_narrow(_step(rows, side(starts))), None
    while model.limit(1).count():  # only groups that still fall are read on
        new = _step(rows, side(model))
        was = model.select("g", "start", F.col("det").alias("was"))
        falls = F.coalesce(F.col("was") - F.col("det") > LEAST_DROP, F.lit(False))
        new = cut_narrow(new.join(was, ["g", "start"]).withColumn("falls", falls).drop("was"))
        done = new.where("not falls").drop("falls")
        found = done if found is None else found.unionByName(done)
        model = new.where("falls").drop("falls")
    if found is None:
        found = model
    nth = Window.partitionBy("g").orderBy("det", "m0")
    return found.withColumn("k", F.row_number().over(nth)).where("k = 1").drop("k", "det", "start")


def _judged(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"))
    own = own.withColumn("_row", F.xxhash64("_id", "_text"))
    stats = text_statistics(own, "_id", "_text", ("_lang", "_source", "_row"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    stats = cut(stats.withColumn("base_failed", failed).withColumns({f"x{i}": c for i, c in enumerate(_vector())}))
    rows = stats.where("not base_failed")
    by_lang = F.concat(F.lit("l"), F.coalesce(F.concat(F.lit("="), "_lang"), F.lit("")))
    by_both = F.concat(by_lang, F.lit("\x00s"), F.coalesce(F.concat(F.lit("="), "_source"), F.lit("")))
    names = rows.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("n")).withColumn("own", F.col("n") >= MIN_GROUP)
    pool = Window.partitionBy(F.col("_lang"), F.col("own"))
    names = names.withColumn("pooled", F.sum("n").over(pool)).withColumn(
        "g", F.when(F.col("own"), by_both).when(F.col("pooled") >= MIN_GROUP, by_lang).otherwise("")
    )
    names = cut_narrow(names.select(F.col("_lang").alias("nl"), F.col("_source").alias("ns"), "g"))
    named = F.col("_lang").eqNullSafe(F.col("nl")) & F.col("_source").eqNullSafe(F.col("ns"))
    grouped = cut_narrow(rows.join(names, named).select("g", *[f"x{i}" for i in range(P)]))
    sizes = grouped.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_POOL)
    model = cut_narrow(estimate(cut_narrow(grouped.join(sizes.select("g"), "g", "left_semi"))))
    judged = stats.join(names, named, "left").join(model, "g", "left")
    far = F.coalesce(_distance() / CONSISTENCY > CUTOFF, F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~far)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, the five counts, base_failed, kept: one row for each row of ``docs``."""
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return _judged(docs, id_col, text_col, lang_col, source_col).select(F.col("id").alias(id_col), *out)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns. Rows of equal id, text, language and
    source share one verdict."""
    key = ("_lang", "_source", "_row")
    bad = _judged(docs, id_col, text_col, lang_col, source_col).where("not kept").select(*key).distinct()
    row = docs.select(F.struct(*docs.columns).alias("_doc"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_k"), F.col(lang_col).alias("_l"), F.col(source_col).alias("_s"))
    same = (F.col("_k") == F.col("_row")) & F.col("_l").eqNullSafe(F.col("_lang")) & F.col("_s").eqNullSafe(F.col("_source"))
    return row.join(bad, same, "left_anti").select(*[F.col("_doc")[c].alias(c) for c in docs.columns])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
