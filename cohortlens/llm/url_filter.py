"""URL filter by a sort-merge range join.

A rule is (host, path, verdict). It fits its host and every subdomain of it when the
url's path starts with the rule's path; the longest fitting rule wins, at equal length
``block`` before ``allow``, and a url that no rule fits gets the default verdict.

Method. The host's labels are written in reverse, each closed by a dot, so "host or
subdomain of" becomes "starts with", and a rule becomes an interval of the sorted keys.
Rules and urls are range-partitioned by one set of split points over (key, path); a rule
goes to each partition that its interval touches. Every partition is sorted and swept
once with a stack of the nested rules whose interval is open.

Scale. Split points come from a sample of ``SPLIT_SAMPLE`` keys a partition, which only
balances the work. A host with a third of all urls spreads over many partitions, as its
urls differ in path and row hash. The sweep holds the stack, never a group.

Null urls and urls without ``://`` have an empty host and path and fit no rule. Repeated
rows are judged and returned one by one. No rules: every url gets the default. Columns
other than the id and the url are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import cut, parts, ship, table

#: (host, path, verdict). Fixed values of the query.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
#: Sampled keys for each partition when split points are chosen.
SPLIT_SAMPLE = 40

_LAST = "\U0010ffff"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def lower_ascii(host: Column) -> Column:
    """A-Z lower-cased, as hosts of urls and of rules are compared."""
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _span(bounds: list[str]):
    """Adds the first and last partition that a row's interval touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [pa.array([bisect_right(bounds, x) for x in b.column(c).to_pylist()], pa.int32()) for c in ("lo", "hi")]
            rest = b.drop_columns(["lo", "hi"])
            yield pa.RecordBatch.from_arrays([*rest.columns, *at], names=[*rest.schema.names, "pid_lo", "pid_hi"])

    return run


def _sweep(default: str):
    """Rows sorted by key, a rule before the urls of its interval."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rules: list[tuple[str, dict, list]] = []  # (host key, {path: (rule, verdict)}, path lengths), nested
        pid = None
        for batch in batches:
            out = []
            b = batch.to_pydict()
            for p, key, kind, uid, host, path, rule, verdict in zip(
                b["pid"], b["key"], b["kind"], b["id"], b["host"], b["path"], b["rule"], b["verdict"], strict=True
            ):
                if p != pid:
                    open_rules, pid = [], p
                while open_rules and not key.startswith(open_rules[-1][0]):
                    open_rules.pop()
                if kind == 0:
                    if not open_rules or open_rules[-1][0] != key:
                        open_rules.append((key, {}, []))
                    _, kept, sizes = open_rules[-1]
                    if len(path) not in sizes:
                        sizes.append(len(path))
                    if path not in kept or verdict == "block":
                        kept[path] = (rule, verdict)
                    continue
                best = None
                for _, kept, sizes in open_rules:
                    for size in sizes:
                        hit = kept.get(path[:size]) if size <= len(path) else None
                        if hit and (best is None or (len(hit[0]), hit[1] == "block") > (len(best[0]), best[1] == "block")):
                            best = hit
                out.append((uid, host, path, best[0] if best else None, best[1] if best else default))
            if out:
                types = [batch.schema.field("id").type, *[pa.string()] * 4]
                cols = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "host", "path", "rule", "verdict"])

    return run


def filter_urls(
    urls: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    partitions: int | None = None,
) -> DataFrame:
    """One row for each row of ``urls``: id, host, path, rule, verdict.

    ``rules`` has the string columns host, path and verdict (``allow`` or ``block``).
    """
    spark = urls.sparkSession
    ship(spark)
    n = partitions or parts(spark)
    u = urls.select(
        F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    ).withColumn("key", reversed_host(F.col("host")))
    r = rules.select(
        lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("verdict")
    ).where("host is not null and verdict is not null")
    r = r.select(
        F.lit(None).cast(u.schema["id"].dataType).alias("id"), "host", "path", reversed_host(F.col("host")).alias("key"),
        F.concat("host", "path").alias("rule"), "verdict",
    )
    # The row's own hash closes the key, so many rows of one url can still be split.
    full = F.concat_ws("\x00", "key", "path", F.hex(F.xxhash64("id")))
    u = u.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string"), "kind": F.lit(1), "lo": full})
    u = cut(u)
    rows = u.count()
    share = min(1.0, SPLIT_SAMPLE * n / max(rows, 1))
    seen = sorted(x.lo for x in u.select("lo").sample(share, seed=7).collect())
    bounds = sorted({seen[len(seen) * i // n] for i in range(1, n)}) if seen else []
    both = u.withColumn("hi", F.col("lo")).unionByName(
        r.withColumns({"kind": F.lit(0), "lo": F.col("key"), "hi": F.concat("key", F.lit(_LAST))})
    )
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.drop("lo", "hi").schema.fields)
    placed = both.mapInArrow(_span(bounds), kept + ", pid_lo int, pid_hi int")
    placed = placed.withColumn("pid", F.explode(F.sequence("pid_lo", "pid_hi"))).drop("pid_lo", "pid_hi")
    swept = placed.repartition(n, "pid").sortWithinPartitions("pid", "key", "kind", "path")
    idt = u.schema["id"].dataType.simpleString()
    out = swept.mapInArrow(_sweep(default), f"id {idt}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)


def rules_frame(spark: SparkSession, rules=None) -> DataFrame:
    return spark.createDataFrame(RULES if rules is None else rules, "host string, path string, verdict string")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rules_frame(spark))


_HOST = "translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = f"""
with u as (select row_number() over () as rid, page_id, coalesce({_HOST}, '') as host,
                  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from pages),
r(rh, rp, rv) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
j as (select u.*, rh || rp as rule, rv,
             row_number() over (partition by rid order by length(rh || rp) desc nulls last) as k
      from u left join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select page_id, host, path, rule, coalesce(rv, 'allow') as verdict from j where k = 1
"""
