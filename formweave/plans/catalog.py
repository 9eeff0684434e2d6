"""All driver queries of the engine and their SQL."""

from __future__ import annotations

from . import box_queries, fact_queries, layer_queries, oracle_boxes, oracle_facts, oracle_layers, oracle_pages, oracle_study, oracle_text, page_queries, study_queries, text_queries


def queries() -> dict:
    return {**fact_queries.queries(), **text_queries.queries(), **box_queries.queries(), **page_queries.queries(), **study_queries.queries(), **layer_queries.queries()}


def oracle_sql() -> dict[str, str]:
    return {**oracle_facts.SQL, **oracle_text.SQL, **oracle_boxes.SQL, **oracle_pages.SQL, **oracle_study.SQL, **oracle_layers.SQL}
