"""Training-data operators: scoring, classification, deduplication, packing, archives and search.

Nothing outside this subpackage imports it; ``lumenix.llm.queries`` registers its queries and SQL.
"""
