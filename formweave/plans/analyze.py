"""The whole analysis of extracted documents, from lines and markup to links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fields as FL
from ..operators import forms as FM
from ..operators import layout, linking, markup_rows


def analyze_documents(tables: dict[str, DataFrame], store: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> dict[str, DataFrame]:
    """From ``pages``, ``lines``, ``rules``, ``controls`` and ``annotations`` (and ``documents``) to all
    derived tables.

    ``store`` is called on every table that later steps use more than once; pass a function that
    writes it to shared storage and reads it back, or the plans repeat their common parts.
    """
    pages, rules, controls, raw = (tables[n] for n in ("pages", "rules", "controls", "annotations"))
    tagged = layout.tag_markup(tables["lines"], raw)
    regions = store(layout.tag_regions(tagged, layout.body_bounds(pages, rules), layout.repeated_lines(tagged, pages)), "regions")
    bands = store(layout.detect_columns(regions, pages, controls), "bands")
    lines = store(layout.assign_columns(regions, bands), "lines")
    groups = store(layout.assign_roles(layout.group_lines(lines, layout.anchors(lines, controls, bands), rules), controls, bands), "groups")
    references = store(FM.cross_references(groups, raw, pages), "cross_references")
    named = store(FM.inherit_forms(FM.page_titles(groups, raw, pages), references), "named")
    forms = store(FM.collect_forms(named, references), "forms")
    page_forms = store(FM.page_forms(named, forms), "page_forms")
    fields = store(FL.extract_fields(groups, page_forms, controls, bands), "fields")
    annotations = store(markup_rows.extract_annotations(raw, page_forms), "annotations")
    links = store(linking.link_pages(annotations, fields, page_forms, bands), "links")
    return {**tables, "lines": lines, "bands": bands, "groups": groups, "page_forms": page_forms, "forms": forms, "cross_references": references, "fields": fields, "annotations": annotations, "links": links}


def summary(found: dict[str, DataFrame]) -> DataFrame:
    """Row counts of all tables, one row per table."""
    rows = None
    for name, df in found.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        rows = one if rows is None else rows.unionByName(one)
    return rows
