"""Declared schemas of the four inputs and a check that fails early on a wrong frame.

Only the fields the analysis touches are declared. Identifier columns accept a
string or an integral type, so the same operators run on the JSON export (string
ids) and on warehouse tables keyed by integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Input field names, which must equal those of the exported data.
#   business: business_id, name, city, state, categories
#   review:   review_id, user_id, business_id, date, text
#   user:     user_id, yelping_since, elite
#   taxonomy: alias, title, parents

BUSINESS_SCHEMA = T.StructType(
    [
        T.StructField("business_id", T.StringType(), False),
        T.StructField("name", T.StringType(), True),
        T.StructField("city", T.StringType(), True),
        T.StructField("state", T.StringType(), True),
        T.StructField("categories", T.StringType(), True),
    ]
)

REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("review_id", T.StringType(), False),
        T.StructField("user_id", T.StringType(), False),
        T.StructField("business_id", T.StringType(), False),
        T.StructField("date", T.StringType(), True),
        T.StructField("text", T.StringType(), True),
    ]
)

USER_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.StringType(), False),
        T.StructField("yelping_since", T.StringType(), True),
        T.StructField("elite", T.StringType(), True),
    ]
)

TAXONOMY_SCHEMA = T.StructType(
    [
        T.StructField("alias", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("parents", T.ArrayType(T.StringType()), True),
    ]
)

_ID = (T.StringType, T.LongType, T.IntegerType)
_STR = (T.StringType,)

# Column -> accepted Spark type classes, per input.
REQUIRED = {
    "business": {"business_id": _ID, "categories": _STR},
    "review": {"review_id": _ID, "user_id": _ID, "business_id": _ID, "date": _STR},
    "user": {"user_id": _ID, "elite": _STR},
    "taxonomy": {"alias": _STR, "title": _STR, "parents": (T.ArrayType,)},
}


class SchemaMismatch(ValueError):
    pass


def check_schema(df: DataFrame, kind: str) -> DataFrame:
    """Return ``df`` unchanged if it carries the columns ``kind`` needs, else raise."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    problems = []
    for name, accepted in REQUIRED[kind].items():
        if name not in fields:
            problems.append(f"missing column {name!r}")
        elif not isinstance(fields[name], accepted):
            names = "/".join(t.__name__ for t in accepted)
            problems.append(f"{name!r} is {fields[name].simpleString()}, expected {names}")
    if kind == "taxonomy" and "parents" in fields and isinstance(fields["parents"], T.ArrayType):
        if not isinstance(fields["parents"].elementType, T.StringType):
            problems.append("'parents' must be array<string>")
    if kind == "review":
        if "text" in fields and not isinstance(fields["text"], T.StringType):
            problems.append("'text' must be string")
        if "length_of_review" in fields and not isinstance(
            fields["length_of_review"], (T.LongType, T.IntegerType)
        ):
            problems.append("'length_of_review' must be integral")
        if "text" not in fields and "length_of_review" not in fields:
            problems.append("needs 'text' (or its precomputed 'length_of_review')")
    if problems:
        raise SchemaMismatch(f"{kind}: " + "; ".join(problems))
    return df
