"""Defaults of the engine's operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """PageRank, search and report settings."""

    damping: float = 0.85
    max_iterations: int = 50
    tolerance: float = 1e-6
    k1: int = 100
    k2: int = 10
    title_unicode: float = 2.0
    title_trigram: float = 2.0
    text_unicode: float = 1.0
    text_trigram: float = 1.0
    alpha: float = 0.8
    idf_threshold: float = 1.5
    min_citing_pages: int = 10
    min_citing_pages_tld: int = 1000
    min_citations: int = 1
    limit: int = 100


DEFAULT = EngineConfig()
ARTICLE, CATEGORY = 0, 14

#: Domains that archive others' pages, left out of the authority of domains.
ARCHIVES = ("archive.org", "archive.today", "ghostarchive.org", "web.archive.org")
