"""The cohort questions over co-located tables.

Every deduplication of the reviews holds the user and the business, so rows of different
keys never merge: each stage is the union of the stage over the bucketed part, where no
review is exchanged on the key, and over the hot keys' part, where reviews are spread by
their whole identity and the partner is broadcast. Means are finished from both parts'
partial sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortlens.operators import summaries
from cohortlens.plans.pipelines import Q2_LABEL, CohortAnalysis
from cohortlens.sources.colocated import Colocated

PARTNERS = {"user_id": "user", "business_id": "business"}


class _HotPart(CohortAnalysis):
    """Reviews of the hot keys: their partner rows are those of few keys."""

    partner = ""

    def _fits(self, side: str) -> bool:
        own = {"user": ("status", "first_year"), "business": ("business_top",)}[self.partner]
        return side in own or super()._fits(side)


class ColocatedAnalysis:
    def __init__(self, tables: Colocated, business: DataFrame, user: DataFrame, taxonomy: DataFrame):
        sides = {"business": business, "user": user}
        partner = PARTNERS[tables.key]
        self.bucketed = CohortAnalysis(review=tables.reviews, taxonomy_df=taxonomy, **(sides | {partner: tables.partner}))
        self.hot = _HotPart(review=tables.hot_reviews, taxonomy_df=taxonomy, **(sides | {partner: tables.hot_partner}))
        self.hot.partner = partner

    def rows(self, stage: str) -> DataFrame:
        """A row-level stage of ``CohortAnalysis``."""
        return getattr(self.bucketed, stage).unionByName(getattr(self.hot, stage))

    def _means(self, partials: str, keys: list[str], **names: str) -> DataFrame:
        both = [getattr(part, partials) for part in (self.bucketed, self.hot)]
        return summaries.mean_from_partials(both[0]().unionByName(both[1]()), keys, **names)

    @property
    def q1_bar(self) -> DataFrame:
        return self._means("q1_partials", ["status", "Category"])

    @property
    def q1_bar_compat(self) -> DataFrame:
        return self._means("q1_partials_compat", ["status", "Category"])

    @property
    def q2_bar(self) -> DataFrame:
        return self._means("q2_partials", ["Category", Q2_LABEL], mean_name="length_of_review", count_name="review_counts")
