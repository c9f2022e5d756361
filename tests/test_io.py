import os
import json
import tempfile

import pytest
from pyspark.sql import types as T

from cohortlens.schemas import SchemaMismatch, check_schema
from cohortlens.sources import export_tsv, read_source, read_tsv
from conftest import rows


def _tmp():
    return tempfile.mkdtemp(prefix="cohortlens-test-")


def test_tsv_round_trip_with_awkward_values(spark):
    schema = T.StructType(
        [T.StructField("Category", T.StringType()), T.StructField("n", T.LongType())]
    )
    data = [("tab\there", 1), ('quote "q"', 2), ("line\nbreak", 3), (None, 4), ("Café Ünïcode", 5), ("", 6)]
    df = spark.createDataFrame(data, schema)
    path = _tmp() + "/out"
    export_tsv(df, path, single_file=True)
    back = read_tsv(spark, path, schema)
    assert rows(back, "n", "Category") == sorted((n, c) for c, n in data)


def test_single_file_holds_every_row(spark):
    path = _tmp() + "/big"
    export_tsv(spark.range(10_000), path, single_file=True)
    assert sum(f.startswith("part-") for f in os.listdir(path)) == 1
    assert spark.read.option("sep", "\t").option("header", "true").csv(path).count() == 10_000


def test_malformed_json_fails(spark):
    d = _tmp()
    with open(f"{d}/tax.json", "w") as f:
        json.dump([{"alias": "a", "title": "A", "parents": []}], f, indent=2)
    with pytest.raises(Exception, match="MALFORMED"):
        read_source(spark, "taxonomy", f"{d}/tax.json").collect()


@pytest.mark.parametrize("kind", ["business", "user"])
def test_bz2_json(spark, kind):
    import bz2

    d = _tmp()
    row = {"business_id": "b", "categories": "A, B", "user_id": "u", "elite": "2012", "other": 1}
    with bz2.open(f"{d}/x.json.bz2", "wt") as f:
        f.write(json.dumps(row) + "\n")
    got = read_source(spark, kind, f"{d}/x.json.bz2").first().asDict()
    assert "other" not in got and got[f"{kind}_id"] == kind[0]


def test_json_reader_declared_schema_and_multiline(spark):
    d = _tmp()
    with open(f"{d}/tax.json", "w") as f:
        json.dump(
            [{"alias": "a", "title": "A", "parents": []}, {"alias": "b", "title": "B", "parents": ["a"], "x": 1}],
            f,
            indent=2,
        )
    tax = read_source(spark, "taxonomy", f"{d}/tax.json", multi_line=True)
    assert tax.columns == ["alias", "title", "parents"]
    assert rows(tax, "alias") == [("a",), ("b",)]
    with open(f"{d}/rev.json", "w") as f:
        f.write(json.dumps({"review_id": "r", "user_id": "u", "business_id": "b", "date": "2012-01-02",
                            "text": "hello", "stars": 5}) + "\n")
    rev = read_source(spark, "review", f"{d}/rev.json")
    assert rev.first()["text"] == "hello"


def test_schema_check_reports_problems(spark):
    bad = spark.createDataFrame([(1, 2)], "user_id long, elite long")
    with pytest.raises(SchemaMismatch, match="elite"):
        check_schema(bad, "user")
    no_text = spark.createDataFrame([("r", "u", "b", "d")], "review_id string, user_id string, business_id string, date string")
    with pytest.raises(SchemaMismatch, match="text"):
        check_schema(no_text, "review")


def test_export_charts_round_trip(spark):
    from pyspark.sql import types as T

    from cohortlens.plans.exports import export_charts
    from cohortlens.plans.registry import analysis_for

    a = analysis_for(spark, "/root/testdata/sf0.001")
    expected = rows(a.q1_bar, "status", "Category", "review_count")
    paths = export_charts(a, _tmp() + "/charts", checkpoint_fallback=_tmp())
    schema = T.StructType(
        [
            T.StructField("status", T.StringType()),
            T.StructField("Category", T.StringType()),
            T.StructField("length_of_reviews", T.DoubleType()),
            T.StructField("review_count", T.LongType()),
        ]
    )
    back = read_tsv(spark, paths["q1_bar"], schema)
    assert rows(back, "status", "Category", "review_count") == expected
    import glob

    assert len(glob.glob(paths["q1_bar"] + "/part-*")) == 1
    assert read_tsv(spark, paths["q2_box_rows"], "Category string, length_of_review long, new_filtered_elites string").count() == a.q2_box_rows.count()


def test_tsv_lines_are_the_written_lines(spark):
    from cohortlens.sources import tsv_lines

    df = spark.createDataFrame([("a b", 1.5, 2), ('q"t', None, 3), ("t\tb", 0.1, None), (None, 2.0, 4), ("", 3.0, 5)], "c string, m double, n long")
    path = _tmp() + "/lines"
    export_tsv(df, path, single_file=True)
    written = spark.read.text(path).collect()
    got = sorted(r["line"] for r in tsv_lines(df).collect())
    assert got == sorted(r["value"] for r in written if r["value"] != "c\tm\tn")
    assert "a b\t1.5\t2" in got and '"t\tb"\t0.1\t' in got


def test_ingest_reviews_partitioned_by_year(spark):
    from cohortlens.sources import ingest_to_parquet

    d = _tmp()
    with open(f"{d}/review.json", "w") as f:
        for i in range(30):
            f.write(json.dumps({"review_id": f"r{i}", "user_id": "u", "business_id": "b",
                                "date": f"{2010 + i % 3}-01-0{1 + i % 9}", "text": "x" * i, "cool": 1}) + "\n")
    ingest_to_parquet(spark, "review", f"{d}/review.json", f"{d}/review_pq")
    import os

    assert sorted(p for p in os.listdir(f"{d}/review_pq") if p.startswith("review_year=")) == [
        "review_year=2010", "review_year=2011", "review_year=2012"
    ]
    back = read_source(spark, "review", f"{d}/review_pq", fmt="parquet")
    assert back.count() == 30
    pruned = back.filter("date >= '2012'")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in pruned
