from cohortlens.plans.pipelines import CohortAnalysis

__all__ = ["CohortAnalysis"]
