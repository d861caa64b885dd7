"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from lumenkpi.llm import kdtree, langid, linededup, neardup, packing, paragraphs, quality, secrets, syncmers, transducer

MODULES = (quality, langid, kdtree, neardup, secrets, packing, linededup, transducer, paragraphs, syncmers)


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in MODULES for k, q in m.ORACLES.items()}
