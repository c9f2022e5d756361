from cohortlens.functions.columns import (
    ELITE,
    NO_STATUS,
    NON_ELITE,
    POST_LABEL,
    PRE_LABEL,
    first_status_year,
    holds_status,
    pre_post_label,
    pre_post_label_compat,
    split_list,
    status_label,
    text_length,
    year_number,
    year_text,
)

__all__ = [
    "ELITE",
    "NO_STATUS",
    "NON_ELITE",
    "POST_LABEL",
    "PRE_LABEL",
    "first_status_year",
    "holds_status",
    "pre_post_label",
    "pre_post_label_compat",
    "split_list",
    "status_label",
    "text_length",
    "year_number",
    "year_text",
]
