"""Cohort analytics on Spark: compare how groups of users write, per category."""

from cohortlens.config import build_session, checkpoint_dir, cut_lineage, recommended_conf
from cohortlens.plans.pipelines import CohortAnalysis

__all__ = ["CohortAnalysis", "build_session", "checkpoint_dir", "cut_lineage", "recommended_conf"]
