"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontam, jaccard, lattice, mixing, quality, secrets, shards, suffixes, surrogates, url_filter

MODULES = {
    "op1_pii_surrogates": surrogates,
    "op2_decontamination": decontam,
    "op3_lattice_lm": lattice,
    "op4_url_filter": url_filter,
    "op5_source_mixing": mixing,
    "op6_secret_scan": secrets,
    "op7_sharding": shards,
    "op8_quality_rules": quality,
    "op9_ngram_jaccard": jaccard,
    "op10_suffix_dedup": suffixes,
}


def queries() -> dict:
    return {name: m.query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL for name, m in MODULES.items() if getattr(m, "SQL", None)}
