"""Inputs and stages as named views, and the questions typed in SQL over them."""

from cohortlens.plans.views import INPUTS, Q1_SQL, Q2_SQL, STAGES, register_views, typed
from conftest import rows
from test_pipelines import star  # noqa: F401


def test_typed_questions_equal_the_compat_stages(spark, star):  # noqa: F811
    assert register_views(star, "t_") == ["t_" + n for n in INPUTS + STAGES]
    q1 = typed(star, Q1_SQL, "t_", none="None", holder="elite", other="non-elite")
    assert rows(q1) == rows(star.q1_bar_compat, *q1.columns)
    q2 = typed(star, Q2_SQL, "t_", none="None", post="Post-elite review", pre="Pre-elite review")
    assert rows(q2) == rows(star.q2_bar_compat, *q2.columns)
    for stage in ("category_reviews", "reviews_with_status_compat", "pre_post_labels_compat"):
        want = getattr(star, stage)
        assert sorted(map(tuple, spark.table(f"t_{stage}").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    one = spark.sql("SELECT count(*) AS n FROM t_reviews_with_status WHERE status = :s", args={"s": "elite"}).first().n
    assert one == star.reviews_with_status.where("status = 'elite'").count()
