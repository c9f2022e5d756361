from cohortlens.operators.cohorts import (
    elite_users,
    exploded_elite_years,
    first_elite_year,
    first_elite_year_compat,
    pre_post_labels,
    pre_post_labels_compat,
    user_elite_years,
    user_status,
    with_status,
)
from cohortlens.operators.joins import fits, sized_broadcast
from cohortlens.operators.measures import review_lengths, review_years
from cohortlens.operators.summaries import (
    box_summary,
    cohort_gap,
    flag_outliers,
    mean_and_count,
    mean_from_partials,
    min_volume,
    partial_sums,
    promising_users,
    share_above_reference_q3,
)
from cohortlens.operators.taxonomy import (
    business_category_list,
    business_top_level,
    top_level_taxonomy,
    top_level_titles,
)

__all__ = [
    "box_summary",
    "business_category_list",
    "business_top_level",
    "cohort_gap",
    "elite_users",
    "exploded_elite_years",
    "first_elite_year",
    "first_elite_year_compat",
    "flag_outliers",
    "mean_and_count",
    "mean_from_partials",
    "min_volume",
    "partial_sums",
    "pre_post_labels",
    "pre_post_labels_compat",
    "promising_users",
    "review_lengths",
    "review_years",
    "fits",
    "share_above_reference_q3",
    "sized_broadcast",
    "top_level_taxonomy",
    "top_level_titles",
    "user_elite_years",
    "user_status",
    "with_status",
]
