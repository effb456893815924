"""All registered queries of the engine."""

from __future__ import annotations

from tidelane.plans import basic_queries, media_queries, more_queries, quality_queries, registry, relational_queries, structure_queries, text_queries, timeline_queries  # noqa: F401


def flagship(spark, sf_dir):
    """Word streams to segments, scores, merged and selected highlights."""
    return text_queries.selected_highlights(spark, sf_dir)


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
