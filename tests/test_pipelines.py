"""Whole pipelines on a small literal star, checked against plain Python over its rows."""

import re

import pytest

from cohortlens.plans.pipelines import CohortAnalysis
from cohortlens.plans.registry import QUERIES, analysis_for
from conftest import rows

SMOKE = "/root/testdata/sf0.001"


BUSINESS = {"b1": "Food, Bars", "b2": "Food", "b3": "Shops, Food, Pizza", "b4": "Pizza", "b5": None}
TAXONOMY = [("food", "Food", []), ("bars", "Bars", ["food"]), ("shops", "Shops", []), ("pizza", "Pizza", ["food"])]
USERS = {"u1": "2012, 2010", "u2": "None", "u3": "2015", "u4": "", "u5": None}
TEXTS = ["aaaa", "bb", "cccccc", "dddddddddd", None, "e", "ffff"]
# (review, user, business, date, text); b6 is an unknown business
REVIEWS = [
    (f"r{i % 37}", f"u{1 + i % 5}", f"b{1 + (i * 7) % 6}", f"{2009 + i % 8}-0{1 + i % 9}-1{i % 10}", TEXTS[i % len(TEXTS)])
    for i in range(40)
]


@pytest.fixture(scope="module")
def star(spark):
    return CohortAnalysis(
        spark.createDataFrame([(b, None, None, None, c) for b, c in BUSINESS.items()], "business_id string, name string, city string, state string, categories string"),
        spark.createDataFrame(REVIEWS, "review_id string, user_id string, business_id string, date string, text string"),
        spark.createDataFrame([(u, None, e) for u, e in USERS.items()], "user_id string, yelping_since string, elite string"),
        spark.createDataFrame(TAXONOMY, "alias string, title string, parents array<string>"),
    )


def _tagged():
    """(category, review) pairs of the literal rows, as plain Python."""
    roots = {title for _, title, parents in TAXONOMY if not parents}
    for r in set(REVIEWS):
        for category in roots & set(re.split(r"\s*,\s*", BUSINESS.get(r[2]) or "")):
            yield category, r


def _means(rows_):
    """{key: (mean, count)} of (key, length) rows; a missing length counts nowhere."""
    by = {}
    for key, length in rows_:
        by.setdefault(key, []).append(length)
    kept = {k: [x for x in v if x is not None] for k, v in by.items()}
    return {k: (sum(v) / len(v) if v else None, len(v)) for k, v in kept.items()}


def _length(r):
    return None if r[4] is None else len(r[4])


def test_q1_compat_on_literal_rows(star):
    grain = {(c, r[1], r[2], _length(r)) for c, r in _tagged()}
    status = lambda u: "elite" if USERS[u] not in (None, "None") else "non-elite"
    want = _means(((status(u), c), n) for c, u, _, n in grain)
    got = {(r["status"], r["Category"]): (r["length_of_reviews"], r["review_count"]) for r in star.q1_bar_compat.collect()}
    assert got == want


def test_q2_compat_on_literal_rows(star):
    first = {}
    for c, r in _tagged():
        if USERS[r[1]] not in (None, "None"):
            key = (c, _length(r), r[3])
            year = min(re.split(r"\s*,\s*", USERS[r[1]]))
            first[key] = min(first.get(key, year), year)
    label = lambda year, date: "Post-elite review" if year > date else "Pre-elite review"
    want = _means(((c, label(y, d)), n) for (c, n, d), y in first.items())
    got = {(r["Category"], r["new_filtered_elites"]): (r["length_of_review"], r["review_counts"]) for r in star.q2_bar_compat.collect()}
    assert got == want


def test_a_review_without_a_year_has_no_label(spark, star):
    odd = [("r90", "u1", "b1", None, "xx"), ("r91", "u1", "b1", "soon", "yy"), ("r92", "u1", "b1", "2013-01-01", "zz")]
    a = CohortAnalysis(star.business, spark.createDataFrame(odd, star.review.schema), star.user, star.taxonomy)
    labels = {r["review_id"]: r["new_filtered_elites"] for r in a.pre_post_labels.collect()}
    assert labels == {"r90": None, "r91": None, "r92": "Post-elite review"}
    assert [r["review_counts"] for r in a.q2_bar.collect()] == [1]


def test_only_four_digit_entries_are_years(spark, star):
    users = spark.createDataFrame([("u1", None, "2019,20,20,2021"), ("u2", None, "20")], star.user.schema)
    a = CohortAnalysis(star.business, star.review, users, star.taxonomy)
    assert {(r["user_id"], r["first_elite_year"]) for r in a.first_elite_year.collect()} == {("u1", 2019)}


def test_unknown_businesses_are_left_out(star):
    assert {r["business_id"] for r in star.q1_by_business.collect()} <= set(BUSINESS)


def test_categories_without_a_reference_cohort_stay(spark, star):
    users = spark.createDataFrame([(f"u{i}", None, "2012") for i in range(1, 6)], star.user.schema)
    a = CohortAnalysis(star.business, star.review, users, star.taxonomy)
    got = a.share_above_q3.collect()
    assert {r["Category"] for r in got} == {"Food", "Shops"} and {r["share_above_q3"] for r in got} == {None}


def test_sides_are_measured_without_a_single_task_limit(star, monkeypatch):
    seen = []
    agg = type(star.user).agg
    monkeypatch.setattr(type(star.user), "agg", lambda self, *a, **k: seen.append(agg(self, *a, **k)) or seen[-1])
    CohortAnalysis(star.business, star.review, star.user, star.taxonomy)._fits("status")
    assert seen and all("Limit" not in _plan(df) for df in seen)


def test_q1_counts_add_up_to_joined_rows(star):
    per_cat = {}
    for r in star.q1_bar.collect():
        per_cat[r["Category"]] = per_cat.get(r["Category"], 0) + r["review_count"]
    joined = {}
    for r in star.reviews_with_status.filter("length_of_review IS NOT NULL").collect():
        joined[r["Category"]] = joined.get(r["Category"], 0) + 1
    assert per_cat == joined


def test_pre_plus_post_equals_elite_rows(star):
    q2 = {}
    for r in star.q2_bar.collect():
        q2[r["Category"]] = q2.get(r["Category"], 0) + r["review_counts"]
    q1 = {r["Category"]: r["review_count"] for r in star.q1_bar.filter("status = 'elite'").collect()}
    assert q2 == q1


def test_box_summary_counts_equal_bar_counts(star):
    bar = dict(((r["status"], r["Category"]), r["review_count"]) for r in star.q1_bar.collect())
    box = dict(((r["status"], r["Category"]), r["n"]) for r in star.q1_box_summary.collect())
    assert box == {k: v for k, v in bar.items() if v > 0}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def smoke(spark):
    return analysis_for(spark, SMOKE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loop_or_cartesian_and_text_never_shuffled(smoke, name):
    plan = _plan(QUERIES[name](smoke))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    for line in plan.splitlines():
        if "Exchange" in line:
            assert not re.search(r"\btext#", line), line


def test_scans_are_pruned(smoke):
    plan = _plan(smoke.q1_bar)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas, plan
    for s in schemas:
        assert "l_shipdate" not in s and "o_orderpriority" not in s and "c_name" not in s
