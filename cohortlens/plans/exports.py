"""The chart inputs of both questions written as tab-separated files.

Summaries (one row per cohort and category) go to a single file each; row-level
box-plot inputs stay one file per task. The review stage shared by all four is
checkpointed first, so the four writes read it instead of recomputing it.
"""

from __future__ import annotations

from cohortlens.plans.pipelines import CohortAnalysis
from cohortlens.sources.sinks import export_tsv

SHARED_STAGES = ("review_lengths",)


def export_charts(
    analysis: CohortAnalysis,
    out_dir: str,
    compat: bool = False,
    checkpoint_fallback: str | None = None,
) -> dict[str, str]:
    """Write ``q1_bar``, ``q1_box_rows``, ``q2_bar`` and ``q2_box_rows`` (or the
    notebook's forms with ``compat=True``) under ``out_dir``; returns name -> path."""
    analysis.materialize(*SHARED_STAGES, fallback_dir=checkpoint_fallback)
    if compat:
        outputs = {
            "q1_bar": (analysis.q1_bar_compat, True),
            "q1_box_rows": (analysis.reviews_with_status_compat.select("status", "Category", "length_of_review"), False),
            "q2_bar": (analysis.q2_bar_compat, True),
            "q2_box_rows": (
                analysis.pre_post_labels_compat.select("Category", "length_of_review", "new_filtered_elites"),
                False,
            ),
        }
    else:
        outputs = {
            "q1_bar": (analysis.q1_bar, True),
            "q1_box_rows": (analysis.q1_box_rows, False),
            "q2_bar": (analysis.q2_bar, True),
            "q2_box_rows": (analysis.q2_box_rows, False),
        }
    paths = {}
    for name, (df, single) in outputs.items():
        path = f"{out_dir.rstrip('/')}/{name}"
        export_tsv(df, path, single_file=single)
        paths[name] = path
    return paths
