"""Secret scan with multipart credential linking. DataFrame functions only.

Strong parts are reported wherever they stand: assignments to a secret-like name, access
key identifiers, long hexadecimal runs. Weak candidates are reported only where
complementary parts stand in the same scope:

- ``secret``: a 40-character mixed run, next to an identifier: an access key's, or an ``ident``;
- ``ident``: a user, client or account name assignment, next to a secret of any kind;
- ``endpoint``: a url or host with a port, next to both an identifier and a secret.

So a secret that makes a name reportable is itself reportable by that name.

Scopes. Each part is an interval that reaches ``REACH`` code points to either side; two parts
are next to each other when their intervals meet. The interval join asks only whether a part
of some kinds is met, so it takes the nearest end before and the nearest start behind over
the sorted parts of a text: linear in the parts, no pairs are formed, nothing is chained.

Positions. Spark's regex functions give matches, not places. The pieces between matches
(``split``) and the matches (``regexp_extract_all``) alternate, so running sums of their
lengths are the places, in code points. Two patterns carry their least length inside the
pattern: for a run of one character class this equals dropping short matches afterwards.

Null text is an empty text; every input row gives one row, repeated rows and null ids too
(rows with candidates are numbered and written once). Long texts are scanned whole. No
rows: no rows. Columns other than the id and the text are not read.

Scale. Rows without any candidate are answered in the scan. The others are narrow after
the scan: one shuffle by row number of part lengths. No join, no broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import cut, table

#: Base kinds in their fixed order; then the method's weak kinds. Fixed values.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENT = r"""(?i)\b(user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]{3,})"""
ENDPOINT = r"\b(?:https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{2,5}\b"
SECRET = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])"
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "secret": SECRET, "ident": IDENT, "endpoint": ENDPOINT}
BASE = ("assign", "access", "hex")
#: A value of at least so many characters makes an assignment a secret.
MIN_VALUE = 6
#: Code points that a part reaches to either side.
REACH = 200


def _pieces(text: Column, kind: str) -> Column:
    """(kind, piece length, match length, kept) for every piece of one kind, in order."""
    rx = KINDS[kind]
    lens = F.transform(F.split(text, rx, -1), lambda x: F.length(x))
    found = F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    if kind == "assign":
        kept = F.transform(F.regexp_extract_all(text, F.lit(rx), F.lit(2)), lambda v: F.length(v) >= MIN_VALUE)
    elif kind == "secret":
        kept = F.transform(found, lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]"))
    else:
        kept = F.transform(found, lambda v: F.lit(True))
    of = F.arrays_zip(lens.alias("gap"), F.transform(found, lambda v: F.length(v)).alias("size"), kept.alias("kept"))
    rows = F.transform(
        of,
        lambda x, i: F.struct(
            F.lit(list(KINDS).index(kind)).alias("kind"), i.alias("nth"), x["gap"].alias("gap"), x["size"].alias("size"), x["kept"].alias("kept")
        ),
    )
    rows = F.filter(rows, lambda x: x["size"].isNotNull())
    return F.when(text.rlike(rx), rows).otherwise(F.slice(rows, 1, 0)) if kind in ("secret", "ident", "endpoint") else rows


def _has_candidate(text: Column) -> Column:
    """A weak part matters only next to a strong identifier or secret, or next to others."""
    strong = reduce(lambda a, b: a | b, [text.rlike(KINDS[k]) for k in ("access", "hex", "assign", "secret")])
    return F.coalesce(strong, F.lit(False))


def _spans(hits: DataFrame) -> DataFrame:
    """Reported parts of the numbered texts: row, kind (number), start, end."""
    arrays = F.concat(*[_pieces(F.col("text"), k) for k in KINDS])
    parts = hits.select("row", F.explode(arrays).alias("p")).select("row", "p.*")
    run = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum(F.col("gap").cast("long") + F.col("size")).over(run)
    parts = parts.withColumn("end", ends).withColumn("start", F.col("end") - F.col("size")).where("kept")
    # For each class of parts: the nearest end before and the nearest start behind, in order of start.
    order = Window.partitionBy("row").orderBy("start", "end", "kind")
    ahead, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    number = {k: i for i, k in enumerate(KINDS)}

    def near(*kinds: str) -> Column:
        of = F.col("kind").isin([number[k] for k in kinds])
        before = F.col("start") - F.max(F.when(of, F.col("end"))).over(ahead) <= 2 * REACH
        after = F.min(F.when(of, F.col("start"))).over(behind) - F.col("end") <= 2 * REACH
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    ident, key = near("access", "ident"), near("assign", "hex", "secret")
    linked = (
        F.when(F.col("kind") == number["secret"], ident)
        .when(F.col("kind") == number["ident"], key)
        .when(F.col("kind") == number["endpoint"], ident & key)
        .otherwise(True)
    )
    return parts.withColumn("linked", linked).where("linked").select("row", "kind", "start", "end")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    say = lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, say), ",")


def _per_row(hits: DataFrame) -> DataFrame:
    """row, spans: an array of (start, kind, end) in order, for rows that have any."""
    return _spans(hits).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_assign, n_access, n_hex, base_sha256, spans."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    is_hit = _has_candidate(F.col("text"))
    hits = cut(d.where(is_hit).withColumn("row", F.monotonically_increasing_id()))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    got = hits.select("row", "id").join(_per_row(hits), "row", "left").select("id", F.coalesce("found", empty).alias("found"))
    rest = d.where(~is_hit).select("id", empty.alias("found"))
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return got.unionByName(rest).select(
        F.col("id").alias(id_col),
        *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``mark``; all rows and
    columns stay, ``n_chars`` (where there is one) is counted again for changed rows."""
    names = docs.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    is_hit = _has_candidate(text)
    # Columns have names of their own on the way, so that none clashes.
    own = {c: f"_{i}" for i, c in enumerate(names)}
    hits = cut(docs.where(is_hit).select(*[F.col(c).alias(n) for c, n in own.items()], text.alias("text"), F.monotonically_increasing_id().alias("row")))
    found = _per_row(hits.select("row", "text"))
    # Overlapping spans are merged; cuts are the borders of what stays.
    merged = F.aggregate(
        "found", F.array().cast("array<struct<s:bigint,e:bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1))["e"], F.lit(-1)) >= x["start"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                     F.array(F.struct(F.try_element_at(acc, F.lit(-1))["s"].alias("s"), F.greatest(F.try_element_at(acc, F.lit(-1))["e"], x["end"]).alias("e")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("s"), x["end"].alias("e"))))),
    )
    j = hits.join(found, "row", "left").withColumn("m", F.explode(F.array(F.coalesce(merged, F.array().cast("array<struct<s:bigint,e:bigint>>")))))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("m", lambda x: x["e"]))
    ends = F.concat(F.transform("m", lambda x: x["s"]), F.array(F.length("text").cast("long")))
    j = j.withColumn("keep", F.explode(F.array(F.arrays_zip(starts.alias("a"), ends.alias("b")))))
    clean = F.array_join(F.transform("keep", lambda x: F.substring(F.col("text"), (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int"))), mark)
    new = {text_col: clean}
    if "n_chars" in names:
        new["n_chars"] = F.length(clean).cast(docs.schema["n_chars"].dataType)
    changed = j.select(*[(new[c] if c in new else F.col(n)).alias(c) for c, n in own.items()])
    return docs.where(~is_hit).unionByName(changed)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
