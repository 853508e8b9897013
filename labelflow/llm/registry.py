"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from labelflow.llm import (bpe_codec, cross_parse, exact_dedup, fagin, harmonic, jaccard_join,
                           line_dedup, max_sketch, nbsvm, pu_toxicity, secret_scan, source_mix, spelling)

MODULES = (harmonic, cross_parse, pu_toxicity, fagin, secret_scan, line_dedup, jaccard_join, nbsvm,
           bpe_codec, exact_dedup, max_sketch, spelling, source_mix)

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
