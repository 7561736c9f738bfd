"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from narralake.llm import (
    alignment,
    chat,
    divergence,
    jaccard,
    languages,
    lm,
    mixing,
    neighbours,
    packing,
    passages,
    secrets,
    tokens,
    topk,
)

MODULES = (
    chat, languages, tokens, mixing, topk, passages, packing, neighbours, lm, jaccard, alignment, secrets, divergence,
)

QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
