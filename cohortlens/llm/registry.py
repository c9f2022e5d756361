"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from cohortlens.llm.decontaminate import op8_decontamination
from cohortlens.llm.html_extract import op2_html_extraction
from cohortlens.llm.jaccard_join import OP6_SQL, op6_ngram_jaccard
from cohortlens.llm.packing import op7_packing
from cohortlens.llm.quality import op5_quality_rules
from cohortlens.llm.secrets import op9_secret_scans
from cohortlens.llm.sharded_lloyd import OP12_SQL, op12_sharded_lloyd
from cohortlens.llm.sharding import op1_sharding
from cohortlens.llm.source_schedule import OP13_SQL, op13_source_mix
from cohortlens.llm.suffix_dedup import op4_suffix_array_dedup
from cohortlens.llm.url_filter import OP3_SQL, op3_url_filters
from cohortlens.llm.vector_codes import OP11_SQL, op11_vector_codes
from cohortlens.llm.warc import op10_warc

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_html_extraction": op2_html_extraction,
    "op3_url_filters": op3_url_filters,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_packing": op7_packing,
    "op8_decontamination": op8_decontamination,
    "op9_secret_scans": op9_secret_scans,
    "op10_warc": op10_warc,
    "op11_vector_codes": op11_vector_codes,
    "op12_sharded_lloyd": op12_sharded_lloyd,
    "op13_source_mix": op13_source_mix,
}

#: Exact SQL; the other operators are tested against brute force.
ORACLE_SQL = {
    "op3_url_filters": OP3_SQL,
    "op6_ngram_jaccard": OP6_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_sharded_lloyd": OP12_SQL,
    "op13_source_mix": OP13_SQL,
}
