"""Column expressions shared by the operators. All built-in functions, so every
expression stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the analysed notebook's values for the
# results to line up with its exports.
#   list separator pattern: \s*,\s*
#   "no status" sentinel in the elite field: None
#   cohort labels (status): elite, non-elite
#   before/after labels: Pre-elite review, Post-elite review
#   date parts separator: -
# ---------------------------------------------------------------------------
LIST_SEPARATOR = r"\s*,\s*"
NO_STATUS = "None"
ELITE = "elite"
NON_ELITE = "non-elite"
PRE_LABEL = "Pre-elite review"
POST_LABEL = "Post-elite review"
DATE_SEPARATOR = "-"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_list(c: str | Column) -> Column:
    """Comma list -> array. Blanks around commas go; blanks at the ends stay, as does
    an empty trailing element (``'A,'`` -> ``['A', '']``). Null stays null."""
    return F.split(_col(c), LIST_SEPARATOR)


def text_length(c: str | Column) -> Column:
    """The review measure: characters of the whole text, as bigint (null text -> null)."""
    return F.length(_col(c)).cast("long")


def year_text(date: str | Column) -> Column:
    """Leading ``yyyy`` part of a ``yyyy-MM-dd[...]`` string, kept as a string."""
    return F.split(_col(date), DATE_SEPARATOR).getItem(0)


def year_number(date: str | Column) -> Column:
    """Leading year as int; null when the date does not start with a number."""
    return year_text(date).try_cast("int")


def holds_status(elite: str | Column, compat: bool = False) -> Column:
    """True when the elite field names at least one status year.

    compat=True keeps the notebook's test ``elite != 'None'`` (null -> false, but
    ``''`` -> true). The corrected form treats null, blank and the sentinel alike.
    """
    e = _col(elite)
    if compat:
        return F.coalesce(e != F.lit(NO_STATUS), F.lit(False))
    trimmed = F.trim(e)
    return e.isNotNull() & (trimmed != F.lit("")) & (trimmed != F.lit(NO_STATUS))


def status_label(elite: str | Column, compat: bool = False) -> Column:
    return F.when(holds_status(elite, compat), F.lit(ELITE)).otherwise(F.lit(NON_ELITE))


def first_status_year(elites: str | Column) -> Column:
    """Earliest status year of one user, from the split year list, as int.

    Only four-digit entries are years, so ``['None']``, ``['']`` or ``['20']`` give null.
    One expression per row: no explode, no shuffle.
    """
    years = F.filter(F.transform(_col(elites), lambda y: F.trim(y)), lambda y: y.rlike("^[0-9]{4}$"))
    return F.array_min(F.transform(years, lambda y: y.cast("int")))


def pre_post_label(review_year: str | Column, first_year: str | Column) -> Column:
    """Corrected rule: a review written in a year before the first status year is
    'pre'; the first year itself and later are 'post'. Null without either year."""
    before = _col(review_year) < _col(first_year)
    return F.when(before, F.lit(PRE_LABEL)).when(~before, F.lit(POST_LABEL))


def pre_post_label_compat(first_year_text: str | Column, date_text: str | Column) -> Column:
    """The notebook's rule as written: string comparison of a year with a full date,
    and 'Post' when the first year sorts after the date."""
    return F.when(_col(first_year_text) > _col(date_text), F.lit(POST_LABEL)).otherwise(
        F.lit(PRE_LABEL)
    )
