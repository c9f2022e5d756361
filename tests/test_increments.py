"""Partials by ingest date: any order, repeats across dates, dates sent again."""

import uuid

import pytest

from cohortlens.config import checkpoint_dir
from cohortlens.plans import increments
from cohortlens.plans.increments import IncrementalSummaries
from cohortlens.plans.pipelines import CohortAnalysis
from conftest import rows
from test_pipelines import REVIEWS, star  # noqa: F401

#: Days with repeats within a day and across days.
DAYS = {"2024-01-01": REVIEWS[:15], "2024-01-02": REVIEWS[10:22] + REVIEWS[11:13], "2024-01-03": REVIEWS[:3] + REVIEWS[20:30], "2024-01-04": REVIEWS[25:] + [REVIEWS[0], REVIEWS[12]]}


def _frame(spark, star, some):  # noqa: F811
    return spark.createDataFrame(some, star.review.schema)


def _kept(spark, star):  # noqa: F811
    return IncrementalSummaries(spark, f"{checkpoint_dir(spark)}/inc-{uuid.uuid4().hex}", star.business, star.user, star.taxonomy)


def _same(spark, star, kept, days):  # noqa: F811
    a = CohortAnalysis(star.business, _frame(spark, star, [r for d in days.values() for r in d]), star.user, star.taxonomy)
    assert rows(kept.q1_bar, *a.q1_bar.columns) == rows(a.q1_bar)
    assert rows(kept.q2_bar, *a.q2_bar.columns) == rows(a.q2_bar)


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [3, 1, 0, 2]])
def test_increments_equal_one_batch_run_after_each_step(spark, star, order):  # noqa: F811
    kept, came = _kept(spark, star), {}
    for i in order:
        day = list(DAYS)[i]
        came[day] = DAYS[day]
        settled = kept.update(day, _frame(spark, star, DAYS[day]))
        assert settled[0] == day and all(d > day for d in settled[1:])
        _same(spark, star, kept, came)
    assert kept.dates() == sorted(came)


def test_a_date_sent_again_replaces_what_it_held(spark, star):  # noqa: F811
    kept, days = _kept(spark, star), dict(DAYS)
    for day, some in days.items():
        kept.update(day, _frame(spark, star, some))
    first = "2024-01-01"
    # The first day loses reviews that later days hold too, so these own them now.
    days[first] = REVIEWS[5:9]
    assert kept.update(first, _frame(spark, star, days[first])) == list(DAYS)
    _same(spark, star, kept, days)
    assert kept.update(first, _frame(spark, star, days[first])) == [first]  # the same again touches no other
    _same(spark, star, kept, days)
    days[first] = []
    kept.update(first, _frame(spark, star, []))
    _same(spark, star, kept, days)


def test_rebuild_after_the_users_changed(spark, star):  # noqa: F811
    kept = _kept(spark, star)
    for day in list(DAYS)[:2]:
        kept.update(day, _frame(spark, star, DAYS[day]))
    users = spark.createDataFrame([(f"u{i}", None, "2011" if i < 4 else "None") for i in range(1, 6)], star.user.schema)
    kept.user = users
    kept.rebuild()
    _same(spark, CohortAnalysis(star.business, star.review, users, star.taxonomy), kept, dict(list(DAYS.items())[:2]))


def test_nothing_yet_and_names_that_are_no_partitions(spark, star):  # noqa: F811
    kept = _kept(spark, star)
    assert kept.q1_bar.collect() == [] and kept.dates() == []
    with pytest.raises(ValueError):
        kept.update("2024/01", _frame(spark, star, []))


def test_a_new_date_is_not_copied_or_compared(spark, star, monkeypatch):  # noqa: F811
    plans, write = [], increments.write_stage
    monkeypatch.setattr(increments, "write_stage", lambda df, d=None: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, d))
    kept = _kept(spark, star)
    day = "2024-01-02"
    kept.update(day, _frame(spark, star, DAYS[day]))
    # Only the partials are written as a stage: no copy of the reviews, no second deduplication.
    assert len(plans) == 1
    assert not [x for p in plans for x in p.splitlines() if "Aggregate" in x and "review_id" in x]
    assert "LeftAnti" not in plans[0] and plans[0].count("Join") <= 4
    _same(spark, star, kept, {day: DAYS[day]})
