from pyspark.sql import functions as F

from cohortlens.functions import columns as C
from cohortlens.operators import cohorts, measures
from conftest import rows

REVIEW_SCHEMA = "review_id string, user_id string, business_id string, date string, text string"
USER_SCHEMA = "user_id string, yelping_since string, elite string"


def test_review_dedupe_grain_and_null_text(spark):
    reviews = spark.createDataFrame(
        [
            ("r1", "u1", "b1", "2012-01-01", "abcd"),
            ("r1", "u1", "b1", "2012-01-01", "wxyz"),  # same id, same length: one row
            ("r2", "u1", "b1", "2013-05-05", "abcd"),  # same user/business/length, other day
            ("r3", "u1", "b1", "2012-01-01", "ab"),
            ("r4", "u2", "b1", "2012-01-01", None),
        ],
        REVIEW_SCHEMA,
    )
    got = measures.review_lengths(reviews)
    assert rows(got, "review_id", "length_of_review") == [
        ("r1", 4), ("r2", 4), ("r3", 2), ("r4", None)
    ]
    assert dict(got.dtypes)["length_of_review"] == "bigint"


def test_precomputed_length_is_used(spark):
    reviews = spark.createDataFrame(
        [("r1", "u1", "b1", "2012-01-01", 7)],
        "review_id string, user_id string, business_id string, date string, length_of_review int",
    )
    assert rows(measures.review_lengths(reviews), "length_of_review") == [(7,)]


def test_lengths_count_characters_not_bytes(spark):
    df = spark.createDataFrame([("é日本語 x",)], "t string")
    assert df.select(C.text_length("t")).first()[0] == 6


def _users(spark):
    return spark.createDataFrame(
        [
            ("u1", None, "2012, 2010"),
            ("u2", None, "2012"),
            ("u3", None, "None"),
            ("u4", None, ""),
            ("u5", None, None),
        ],
        USER_SCHEMA,
    )


def test_status_corrected_and_compat(spark):
    users = _users(spark)
    fixed = dict(rows(cohorts.user_status(users), "user_id", "status"))
    compat = dict(rows(cohorts.user_status(users, compat=True), "user_id", "status"))
    assert fixed == {"u1": "elite", "u2": "elite", "u3": "non-elite", "u4": "non-elite", "u5": "non-elite"}
    # The notebook's CASE: only the sentinel is non-elite besides null; '' counts as elite.
    assert compat == {"u1": "elite", "u2": "elite", "u3": "non-elite", "u4": "elite", "u5": "non-elite"}


def test_elite_users_and_first_year(spark):
    years = cohorts.user_elite_years(_users(spark))
    assert rows(cohorts.elite_users(years), "user_id") == [("u1",), ("u2",)]
    assert rows(cohorts.elite_users(years, compat=True), "user_id") == [("u1",), ("u2",), ("u4",)]
    assert rows(cohorts.first_elite_year(years)) == [("u1", 2010), ("u2", 2012)]


def test_pre_post_corrected_vs_compat_labels(spark):
    df = spark.createDataFrame(
        [("2011-12-31",), ("2012-01-01",), ("2012-12-31",), ("2013-01-01",)], "date string"
    ).withColumn("first", F.lit(2012)).withColumn("first_text", F.lit("2012"))
    got = {
        r["date"]: (r["fixed"], r["compat"])
        for r in df.select(
            "date",
            C.pre_post_label(C.year_number("date"), "first").alias("fixed"),
            C.pre_post_label_compat("first_text", "date").alias("compat"),
        ).collect()
    }
    assert got["2011-12-31"] == (C.PRE_LABEL, C.POST_LABEL)  # labels swapped in compat
    assert got["2012-01-01"] == (C.POST_LABEL, C.PRE_LABEL)  # '2012' sorts before '2012-…'
    assert got["2013-01-01"] == (C.POST_LABEL, C.PRE_LABEL)


def test_compat_first_year_is_per_group_not_per_user(spark):
    dated = spark.createDataFrame(
        [
            ("2013-02-02", 10, "b1", "u1", "Food", "2010", ["2010"]),
            ("2013-02-02", 10, "b2", "u2", "Food", "2015", ["2015"]),
        ],
        "date string, length_of_review long, business_id string, user_id string, "
        "Category string, elite string, elites array<string>",
    )
    got = cohorts.first_elite_year_compat(dated)
    # Both users share (Category, length, date): one row, the earliest year wins.
    assert rows(got) == [("Food", 10, "2013-02-02", "2010")]
    exploded = cohorts.exploded_elite_years(dated)
    assert exploded.count() == 2
