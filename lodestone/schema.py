"""Schemas of the model's tables."""

from __future__ import annotations

INTERNAL_TEXTS = "id long, hash string, text string"
INTERNAL_PAGES = "id long, ns int, title string, text_id long, in_degree long, out_degree long, rank1 double, rank2 double, authority double"
INTERNAL_LINKS = "source_id long, target_id long"
EXTERNAL_DOMAINS = "id long, name string, tld string"
EXTERNAL_PAGES = "id long, url string, domain_id long"
EXTERNAL_LINKS = "source_id long, target_id long"
REDIRECTS = "source_id long, target_id long"
RANKS_CSV = "id long, rank1 double, rank2 double, authority double"
QRELS = "key string, title string, rel int"
QUERIES = "key string, query string"
