"""The queries of the document operators and their SQL."""

from __future__ import annotations

from marginalia.plans import corpus, extractions, language, memory, pages, papers, sources, structured, views

QUERIES = corpus.QUERIES | structured.QUERIES | memory.QUERIES | extractions.QUERIES | papers.QUERIES | language.QUERIES | sources.QUERIES | pages.QUERIES | views.QUERIES
ORACLES = corpus.ORACLES | structured.ORACLES | memory.ORACLES | extractions.ORACLES | papers.ORACLES | language.ORACLES | sources.ORACLES | pages.ORACLES | views.ORACLES
