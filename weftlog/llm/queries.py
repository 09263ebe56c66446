"""The queries of this subpackage by name, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from . import oracles
from .decontaminate import op8_benchmark_decontamination
from .jaccard import op4_jaccard_join, op4_jaccard_links
from .licenses import op2_license_scan
from .packing import op7_best_fit_packing
from .quality import op6_quality_rules
from .repeats import op5_repeated_substrings
from .secrets import op1_secret_scan
from .token_files import op3_token_files
from .urls import op10_url_filter
from .warc import op9_warc

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_license_scan": op2_license_scan,
    "op3_token_files": op3_token_files,
    "op4_jaccard_join": op4_jaccard_join,
    "op4_jaccard_links": op4_jaccard_links,
    "op5_repeated_substrings": op5_repeated_substrings,
    "op6_quality_rules": op6_quality_rules,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_warc": op9_warc,
    "op10_url_filter": op10_url_filter,
}

ORACLE: dict[str, str] = {
    "op4_jaccard_join": oracles.OP4,
    "op5_repeated_substrings": oracles.OP5,
    "op6_quality_rules": oracles.OP6,
    "op8_benchmark_decontamination": oracles.OP8,
    "op9_warc": oracles.OP9,
}
