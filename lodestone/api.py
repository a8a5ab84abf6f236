"""The reports and searches of the link model behind one object, with their usual defaults."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import ARTICLE, CATEGORY, DEFAULT, EngineConfig
from .operators import authority, explore, graph, search
from .storage import cut


class Engine:
    """Answers over the seven tables of the model (see ``operators.load``); ranks, degrees and authority are computed once, when needed."""

    def __init__(self, tables: dict[str, DataFrame], config: EngineConfig = DEFAULT):
        self.tables, self.config = tables, config

    @cached_property
    def pages(self) -> DataFrame:
        """Pages with degrees and ranks of both namespaces, and authority."""
        pages, links = self.tables["internal_pages"], self.tables["internal_links"]
        ranks = graph.page_ranks(pages, links, [ARTICLE, CATEGORY], self.config)
        counts = [graph.degrees(pages, links, ns) for ns in (ARTICLE, CATEGORY)]
        ranked = graph.with_ranks(pages, ranks).drop("in_degree", "out_degree", "authority")
        ranked = ranked.join(counts[0].unionByName(counts[1]), "id", "left")
        by_domain = authority.domain_authority(ranked, self.tables["external_links"], self.tables["external_pages"], self.tables["external_domains"])
        by_page = authority.page_authority(self.tables["external_links"], self.tables["external_pages"], by_domain)
        return cut(authority.with_authority(ranked, by_page))

    @cached_property
    def by_domain(self) -> DataFrame:
        t = self.tables
        return cut(authority.domain_authority(self.pages, t["external_links"], t["external_pages"], t["external_domains"]))

    @cached_property
    def index(self) -> search.SearchIndex:
        return search.stored(search.build(self.pages, self.tables["internal_texts"]))

    def search(self, query: str, interactive: bool = True) -> DataFrame:
        """The best pages with the first 64 words of their texts as ``snippet``."""
        return search.search_query(self.index, query, interactive, self.config).withColumn("snippet", explore.snippet(F.col("text")))

    def path(self, source: str, target: str) -> DataFrame:
        return graph.shortest_path(self.pages, self.tables["internal_links"], source, target)

    def degrees(self) -> DataFrame:
        return explore.degree_distribution(self.pages)

    def redirects(self) -> DataFrame:
        return explore.redirect_statistics(self.tables["internal_pages"], self.tables["redirects"])

    def pagerank(self, ns: int = ARTICLE, limit: int | None = None) -> DataFrame:
        return explore.top_pages(self.pages, ns, self.config.limit if limit is None else limit)

    def sources(self, min_citing_pages: int | None = None, limit: int | None = None) -> DataFrame:
        least = self.config.min_citing_pages if min_citing_pages is None else min_citing_pages
        return authority.top_domains(self.by_domain, least, self.config.limit if limit is None else limit)

    def page_sources(self, title: str, min_citations: int | None = None) -> DataFrame:
        t = self.tables
        profile = authority.page_profile(self.tables["internal_pages"], t["external_links"], t["external_pages"], t["external_domains"])
        return authority.page_sources(profile, title, self.config.min_citations if min_citations is None else min_citations)

    def tlds(self, min_citing_pages: int | None = None) -> DataFrame:
        least = self.config.min_citing_pages_tld if min_citing_pages is None else min_citing_pages
        return authority.top_tlds(authority.tld_authority(self.by_domain), least)
