from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.operators import taxonomy
from conftest import rows

TAX_SCHEMA = "alias string, title string, parents array<string>"
BIZ_SCHEMA = "business_id string, name string, city string, state string, categories string"


def _taxonomy(spark):
    data = [
        ("a", "A", []),
        ("b", "B", []),
        ("c", "C", ["a"]),
        ("cy", "C2", ["a", "b"]),
        ("n", "N", None),
        ("a2", "A", ["b"]),  # second category holding root title "A"
    ]
    return spark.createDataFrame(data, TAX_SCHEMA)


def test_roots_are_empty_parent_lists_only(spark):
    roots = taxonomy.top_level_taxonomy(_taxonomy(spark))
    assert rows(roots, "alias") == [("a",), ("b",)]


def test_titles_distinct_and_compat_fan_out(spark):
    tax = _taxonomy(spark)
    assert rows(taxonomy.top_level_titles(tax)) == [("A",), ("B",)]
    # The notebook's self-join on title: "A" is held by two categories -> two rows.
    assert rows(taxonomy.top_level_titles(tax, compat=True)) == [("A",), ("A",), ("B",)]


def test_business_lists_split_and_tag(spark):
    biz = spark.createDataFrame(
        [
            ("1", "x", None, None, "A, B , C"),
            ("2", "x", None, None, "A,A"),
            ("3", "x", None, None, " A"),
            ("4", "x", None, None, "A,"),
            ("5", "x", None, None, None),
            ("6", "x", None, None, "C, C2"),
        ],
        BIZ_SCHEMA,
    )
    lists = taxonomy.business_category_list(biz)
    got = {r["business_id"]: r["catList"] for r in lists.collect()}
    assert got["1"] == ["A", "B", "C"]
    assert got["3"] == [" A"]  # blanks at the ends are not trimmed
    assert got["4"] == ["A", ""]  # trailing empty element kept
    assert got["5"] is None
    titles = taxonomy.top_level_titles(_taxonomy(spark))
    tagged = taxonomy.business_top_level(lists, titles)
    # A repeated category counts once; " A", null lists and child-only lists drop out.
    assert rows(tagged, "business_id", "Category") == [("1", "A"), ("1", "B"), ("2", "A"), ("4", "A")]


def test_tagging_plans_no_nested_loop(spark):
    biz = spark.createDataFrame([("1", "x", None, None, "A, B")], BIZ_SCHEMA)
    tagged = taxonomy.business_top_level(
        taxonomy.business_category_list(biz), taxonomy.top_level_titles(_taxonomy(spark))
    )
    plan = tagged._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


words = st.sampled_from(["A", "B", "C", "D", " A", "", "a"])


@settings(max_examples=15, deadline=None)
@given(
    lists=st.lists(st.one_of(st.none(), st.lists(words, max_size=5)), min_size=1, max_size=12),
    roots=st.lists(st.sampled_from(["A", "B", "C", "E"]), min_size=1, max_size=4, unique=True),
)
def test_explode_join_equals_theta_join(spark, lists, roots):
    data = [(str(i), None if l is None else ",".join(l)) for i, l in enumerate(lists)]
    biz = spark.createDataFrame(data, "business_id string, categories string").select(
        "business_id", F.lit("n").alias("name"), F.lit(None).cast("string").alias("city"),
        F.lit(None).cast("string").alias("state"), "categories",
    )
    titles = spark.createDataFrame([(t,) for t in roots], "Category string")
    lists_df = taxonomy.business_category_list(biz)
    ours = taxonomy.business_top_level(lists_df, titles)
    theta = lists_df.join(titles, F.expr("array_contains(catList, Category)")).select(
        "Category", "business_id"
    )
    assert rows(ours) == rows(theta)
