"""Top-level categories and the tagging of businesses with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.columns import split_list
from cohortlens.operators.joins import TITLE_ROWS, JoinSide, sized_broadcast


def top_level_taxonomy(taxonomy: DataFrame) -> DataFrame:
    """Categories with an empty parent list. A null list is not a root (its size is
    null under ANSI, -1 otherwise; never 0)."""
    return taxonomy.filter(F.size("parents") == 0).select("alias", "title")


def top_level_titles(taxonomy: DataFrame, compat: bool = False) -> DataFrame:
    """One row per top-level title, column ``Category``.

    compat=True reproduces the notebook's self-join of roots with every category on
    the title: a title held by k categories gives k rows (and k-fold counts later).
    The default keeps each title once.
    """
    roots = top_level_taxonomy(taxonomy)
    if compat:
        every = taxonomy.select(F.col("title").alias("Category"))
        return roots.join(every, roots.title == every.Category).select("Category")
    return roots.select(F.col("title").alias("Category")).distinct()


def business_category_list(business: DataFrame) -> DataFrame:
    """Business attributes with the category list split into ``catList``."""
    return business.select(
        "business_id", "name", "city", "state", split_list("categories").alias("catList")
    )


def _titles_side(titles: DataFrame) -> DataFrame:
    return sized_broadcast(titles, TITLE_ROWS)


def business_top_level(
    business_lists: DataFrame, titles: DataFrame, join_side: JoinSide = _titles_side
) -> DataFrame:
    """(Category, business_id) for every top-level title found in a business's list.

    The notebook joins on ``array_contains(catList, Category)``, a theta join Spark
    plans as a nested loop. Here each list is exploded once (deduplicated first, as
    ``array_contains`` is a predicate) and equi-joined to the title set, broadcast
    when counted small (``join_side`` decides; by default a bounded count).
    """
    entries = business_lists.select(
        "business_id", F.explode(F.array_distinct("catList")).alias("Category")
    )
    return entries.join(join_side(titles), "Category").select("Category", "business_id")
