from cohortlens.sources.readers import (
    ingest_to_parquet,
    read_business,
    read_review,
    read_source,
    read_taxonomy,
    read_user,
)
from cohortlens.sources.sinks import export_tsv, read_tsv, tsv_lines

__all__ = [
    "export_tsv",
    "ingest_to_parquet",
    "read_business",
    "read_review",
    "read_source",
    "read_taxonomy",
    "read_tsv",
    "read_user",
    "tsv_lines",
]
