import duckdb

import __spark_entry__ as E
from cohortlens.plans.registry import QUERIES

SMOKE = "/root/testdata/sf0.001"
TABLES = "customer part orders lineitem documents".split()


def test_entry_runs_with_stable_schema(spark):
    df = E.entry(spark)
    assert df.columns == ["status", "Category", "length_of_reviews", "review_count"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.queries()) and set(QUERIES) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_headline_queries_match_oracle_at_smoke_scale(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    for name in ["q1_bar", "q2_bar", "q1_bar_compat", "q2_bar_compat", "q1_box_summary", "stage_counts"]:
        df = E.queries()[name](spark, SMOKE)
        cols = sorted(df.columns)
        ours = sorted(tuple(r[c] for c in cols) for r in df.collect())
        res = con.execute(E.oracle_sql()[name])
        names = [d[0] for d in res.description]
        theirs = sorted(tuple(dict(zip(names, r))[c] for c in cols) for r in res.fetchall())
        assert sorted(names) == cols, name
        assert ours == theirs, name
