"""Queries over the model; importing a module registers its queries."""

from . import by_search, contact_rules, dashboard, functions, hits, matching, mechanisms, pages, people, ranks, relations, relevance, scores, search_lists, small_rules, sources

__all__ = ["by_search", "contact_rules", "dashboard", "functions", "hits", "matching", "mechanisms", "pages", "people", "ranks", "relations", "relevance", "scores", "search_lists", "small_rules", "sources"]
