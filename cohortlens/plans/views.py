"""The inputs and stages as session views, so that the questions can be typed in SQL.

Views are lazy, like the frames they name: registering runs nothing but the job that bounds
the join sides. ``prefix`` keeps two analyses in one session apart; a view that is registered
again replaces the older one, and frames built before keep theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortlens.plans.pipelines import CohortAnalysis

INPUTS = ["business", "review", "user", "taxonomy"]
STAGES = [
    "top_level_titles", "business_category_list", "business_top_level", "review_lengths", "category_reviews",
    "distinct_category_reviews", "user_elite_years", "reviews_with_status", "reviews_with_status_compat", "first_elite_year",
    "pre_post_labels", "dated_category_reviews", "dated_reviews_with_elite", "exploded_elite_years", "first_elite_year_compat",
    "pre_post_labels_compat",
]


def register_views(a: CohortAnalysis, prefix: str = "", stages: list[str] | None = None) -> list[str]:
    """Register the inputs and stages as temporary views; returns their names."""
    names = []
    for name in [*INPUTS, *(STAGES if stages is None else stages)]:
        getattr(a, name).createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names


#: Question 1 and question 2 of the notebook's form, from the inputs to the summary, over the views.
Q1_SQL = """
WITH tagged AS (
  SELECT DISTINCT r.user_id, r.business_id, t.Category, r.length_of_review
  FROM {p}review_lengths r JOIN {p}business_top_level t ON r.business_id = t.business_id),
labelled AS (
  SELECT g.Category, g.length_of_review, CASE WHEN u.elite != :none THEN :holder ELSE :other END AS status
  FROM tagged g JOIN {p}user u ON g.user_id = u.user_id)
SELECT status, Category, avg(length_of_review) AS length_of_reviews, count(length_of_review) AS review_count
FROM labelled GROUP BY status, Category"""

Q2_SQL = """
WITH years AS (
  SELECT d.Category, d.length_of_review, d.date, explode(u.elites) AS year
  FROM {p}dated_category_reviews d JOIN {p}user_elite_years u ON d.user_id = u.user_id
  WHERE size(u.elites) >= 1 AND u.elite != :none),
firsts AS (SELECT Category, length_of_review, date, min(year) AS first FROM years GROUP BY Category, length_of_review, date),
labelled AS (
  SELECT DISTINCT Category, date, length_of_review, first, if(first > date, :post, :pre) AS new_filtered_elites FROM firsts)
SELECT Category, new_filtered_elites, avg(length_of_review) AS length_of_review, count(length_of_review) AS review_counts
FROM labelled GROUP BY Category, new_filtered_elites"""


def typed(a: CohortAnalysis, text: str, prefix: str, **args: str) -> DataFrame:
    """A typed question over the views of ``prefix``; ``:name`` stands for an argument."""
    return a.review.sparkSession.sql(text.replace("{p}", prefix), args=args)
