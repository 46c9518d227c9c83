"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from importlib import import_module

#: One module for each operator; each has QUERIES and ORACLES.
MODULES = ("line_dedup", "quality_rules", "url_filter", "packing", "html_extract", "substring_dedup", "decontaminate", "jaccard_join", "quality_classifier", "secret_scan", "collocations", "simhash", "centroid_clustering")


def _merged(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"{__package__}.{name}"), what)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLES")
