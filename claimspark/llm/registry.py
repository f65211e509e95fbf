"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import alignment, embeddings, fingerprints, html_text, jaccard, languages, mixing, packing, pieces, repeats, token_counts, toxicity, vector_codes

_MODULES = (mixing, token_counts, html_text, toxicity, languages, packing, repeats, jaccard, embeddings, fingerprints, alignment, vector_codes, pieces)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
