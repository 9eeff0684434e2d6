"""Layout: markup in the text layer, running headers, regions, columns, wrapped lines and roles.

Everything is keyed by (doc_id, page).  What a row must see of its page (rules, controls, bands) is
joined to it as one array, whose size is that of a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import LIST_CONTINUES, NEW_ITEM, TERMINATED, join_lines, normalize

GAP_RATIO, GUTTER_MIN, GUTTER_SHARE, ALIGN_TOL, SIZE_TOL, ROW_OVERLAP = 0.5, 12.0, 0.6, 2.0, 0.5, 0.5
FULL_WIDTH, CONTROL_NEAR, MARGIN, MIN_REPEATS, MAX_DEPTH = 0.7, 72.0, 0.12, 3, 6
PAGE = ["doc_id", "page"]


def with_page_array(rows: DataFrame, others: DataFrame, name: str, *columns: str) -> DataFrame:
    """``rows`` with the rows of ``others`` on the same page as an array of structs, in their order."""
    packed = others.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    return rows.join(packed, PAGE, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(packed.schema[name].dataType)))


def tag_markup(rows: DataFrame, annotations: DataFrame, share: float = 0.6) -> DataFrame:
    """``from_annotation``: whether ``share`` of a box's area lies in an annotation of its page."""
    joined = with_page_array(rows.drop("from_annotation"), annotations, "_rects", "bbox")
    return joined.withColumn("from_annotation", F.exists("_rects", lambda r: G.inside(F.col("bbox"), r.bbox) >= share)).drop("_rects")


def tag_blocks(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """Blocks are markup when they have lines and all are."""
    every = lines.groupBy(*PAGE, "block_no").agg(F.every("from_annotation").alias("from_annotation"))
    return blocks.drop("from_annotation").join(every, [*PAGE, "block_no"], "left").fillna({"from_annotation": False})


def line_key() -> list[Column]:
    """A line's identity across pages: its words and its height in steps of three points."""
    return [normalize(F.col("text")).alias("line_text"), F.bround(G.cy(F.col("bbox")) / 3, 0).cast("long").alias("line_y")]


def repeated_lines(lines: DataFrame, pages: DataFrame, share: float = 0.5) -> DataFrame:
    """Lines that stand at the same height on enough pages of a document."""
    seen = lines.filter(~F.col("from_annotation") & (F.trim("text") != "")).select(*PAGE, *line_key())
    counts = seen.groupBy("doc_id", "line_text", "line_y").agg(F.countDistinct("page").alias("on_pages"))
    total = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"))
    enough = F.greatest(F.lit(MIN_REPEATS), F.floor(F.col("page_count") * share))
    return counts.join(total, "doc_id").filter((F.col("page_count") >= MIN_REPEATS) & (F.col("on_pages") >= enough)).select("doc_id", "line_text", "line_y", "on_pages")


def body_bounds(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``body_top`` and ``body_bottom`` of every page, from full-width rules or fixed shares."""
    h = F.when(F.col("height") > 0, F.col("height")).otherwise(1.0)
    wide = rules.filter((F.col("orientation") == "H") & (F.col("span_pct") >= FULL_WIDTH)).join(pages.select(*PAGE, h.alias("h")), PAGE)
    found = wide.groupBy(*PAGE).agg(F.min(F.when(F.col("bbox.y1") < F.col("h") * 0.25, F.col("bbox.y1"))).alias("top"), F.max(F.when(F.col("bbox.y0") > F.col("h") * 0.85, F.col("bbox.y0"))).alias("bottom"))
    return pages.join(found, PAGE, "left").withColumn("body_top", F.coalesce("top", h * 0.08)).withColumn("body_bottom", F.coalesce("bottom", h * 0.92)).drop("top", "bottom")


def tag_regions(lines: DataFrame, bounded: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """``region`` of every line; repeated lines in the margins are running headers and footers."""
    h = F.when(F.col("height") > 0, F.col("height")).otherwise(1.0)
    rows = lines.drop("region").join(bounded.select(*PAGE, h.alias("_h"), "body_top", "body_bottom"), PAGE)
    y = G.cy(F.col("bbox"))
    region = F.when(y < F.col("body_top"), "HEADER").when(y > F.col("body_bottom"), "FOOTER").otherwise("BODY")
    if repeated is not None:
        rows = rows.select("*", *line_key()).join(repeated.select("doc_id", "line_text", "line_y", F.lit(True).alias("_again")), ["doc_id", "line_text", "line_y"], "left").drop("line_text", "line_y")
        region = F.when(F.col("_again") & (y < F.col("_h") * MARGIN), "HEADER").when(F.col("_again") & (y > F.col("_h") * (1 - MARGIN)), "FOOTER").otherwise(region)
    return rows.withColumn("region", region).drop("_h", "_again", "body_top", "body_bottom")


def body_lines(lines: DataFrame) -> DataFrame:
    return lines.filter((F.col("region") == "BODY") & ~F.col("from_annotation") & (F.trim("text") != ""))


def content_rows(rows: DataFrame) -> DataFrame:
    """Lines, words or blocks of the page itself, without markup."""
    return rows.filter(~F.col("from_annotation"))


def page_text(lines: DataFrame) -> DataFrame:
    """``text`` of every page: its own lines in stored order, one below the other."""
    packed = F.array_sort(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("text"))))
    return content_rows(lines).groupBy(*PAGE).agg(F.array_join(F.transform(packed, lambda x: x.text), "\n").alias("text"))


def groups_of_role(groups: DataFrame, role: str) -> DataFrame:
    """Labels of one role."""
    return groups.filter(F.col("role") == role)


def split_columns(spans: list[tuple[float, float, float, float]], left: float, right: float, depth: int = 0) -> list[tuple[float, float]]:
    """Column bands of boxes (x0, y0, x1, y1) between two edges.

    The widest blank run splits a band if most boxes have a partner in their row across it; both
    sides are then split in turn.  Sequential by nature, and bounded by a page.
    """
    whole = [(left, right)]
    if depth >= MAX_DEPTH or len(spans) < 2:
        return whole
    ordered = sorted((b[0], b[2]) for b in spans)
    edge, gap = ordered[0][1], (GUTTER_MIN, None)
    for begin, end in ordered[1:]:
        if begin - edge > gap[0] or (gap[1] is None and begin - edge >= gap[0]):
            gap = (begin - edge, (edge, begin))
        edge = max(edge, end)
    if gap[1] is None:
        return whole
    g0, g1 = gap[1]
    middle = [(b[0] + b[2]) / 2 for b in spans]
    sides = ([b for b, m in zip(spans, middle, strict=True) if m <= g0], [b for b, m in zip(spans, middle, strict=True) if m >= g1])

    def in_row(a, b) -> bool:
        short = min(a[3] - a[1], b[3] - b[1])
        return short > 0 and max(0.0, min(a[3], b[3]) - max(a[1], b[1])) / short >= 0.3

    paired = sum(any(in_row(b, o) for o in sides[m <= g0]) for b, m in zip(spans, middle, strict=True))
    if paired / len(spans) < GUTTER_SHARE or min(map(len, sides)) < 2:
        return whole
    return split_columns(sides[0], left, g0, depth + 1) + split_columns(sides[1], g1, right, depth + 1)


def detect_columns(lines: DataFrame, pages: DataFrame, controls: DataFrame) -> DataFrame:
    """Bands of every page: ``index``, ``x0``, ``x1`` and ``role_hint``."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            widths, packed = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            bands = [split_columns([(b["x0"], b["y0"], b["x1"], b["y1"]) for b in boxes or ()], 0.0, width) for width, boxes in zip(widths, packed, strict=True)]
            take = pa.array([i for i, found in enumerate(bands) for _ in found], pa.int64())
            flat = [(i, round(a, 2), round(b, 2)) for found in bands for i, (a, b) in enumerate(found)]
            index, x0, x1 = zip(*flat, strict=True) if flat else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(index, pa.int32()), pa.array(x0, pa.float64()), pa.array(x1, pa.float64())], ["doc_id", "page", "index", "x0", "x1"])

    kind = {c: pages.schema[c].dataType.simpleString() for c in PAGE}
    boxes = body_lines(lines).groupBy(*PAGE).agg(F.collect_list("bbox").alias("boxes"))
    rows = pages.select(*PAGE, F.col("width").cast("double").alias("width")).join(boxes, PAGE, "left")
    bands = rows.mapInArrow(run, f"doc_id {kind['doc_id']}, page {kind['page']}, index int, x0 double, x1 double")
    held = with_page_array(bands, controls, "_controls", "ord", "bbox").withColumn("_held", F.size(F.filter("_controls", lambda c: G.in_band(c.bbox, F.col("x0"), F.col("x1")))))
    count = F.count(F.lit(1)).over(Window.partitionBy(*PAGE))
    hint = (F.when(F.col("_n") < 2, "UNKNOWN").when(F.col("_n") == 2, F.when(F.col("index") == 0, "QUESTION_ZONE").otherwise("RESPONSE_ZONE"))
            .otherwise(F.when(F.col("_held") >= 2, "RESPONSE_ZONE").otherwise("UNKNOWN")))
    return held.withColumn("_n", count).withColumn("role_hint", hint).drop("_controls", "_held", "_n")


def _bands(rows: DataFrame, bands: DataFrame) -> DataFrame:
    return with_page_array(rows, bands, "bands", "index", "x0", "x1", "role_hint")


def assign_columns(lines: DataFrame, bands: DataFrame) -> DataFrame:
    """``column`` of body lines: the first band that holds half of their width."""
    fits = F.filter("bands", lambda b: G.in_band(F.col("bbox"), b.x0, b.x1))
    body = (F.col("region") == "BODY") & ~F.col("from_annotation") & (F.trim("text") != "")
    return _bands(lines.drop("column"), bands).withColumn("column", F.when(body & (F.size(fits) > 0), F.get(fits, 0).index)).drop("bands")


def _own_band(column: Column) -> Column:
    """The band of a column number as a struct, or null."""
    return F.get(F.filter("bands", lambda b: b.index == column), F.lit(0))


def anchors(lines: DataFrame, controls: DataFrame, bands: DataFrame) -> DataFrame:
    """Lines that start a field: for each control the topmost line in its row, band and reach."""
    rows = _bands(lines.filter(F.trim("text") != ""), bands).withColumn("_band", _own_band(F.col("column")))
    c = controls.select(*PAGE, F.col("ord").alias("control"), F.col("bbox").alias("cb"))
    near = rows.join(c, PAGE).filter((G.v_overlap(F.col("cb"), F.col("bbox")) >= ROW_OVERLAP) & (F.col("_band").isNull() | G.in_band(F.col("cb"), F.col("_band.x0"), F.col("_band.x1"), 0.3)) & G.near(F.col("bbox"), F.col("cb"), CONTROL_NEAR))
    top = near.groupBy(*PAGE, "control").agg(F.min_by("ord", F.struct(F.col("bbox.y0"), "ord")).alias("ord"))
    return top.select(*PAGE, "ord").distinct()


def group_lines(lines: DataFrame, anchor_lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Wrapped lines merged into labels: one row per label, numbered per page in reading order.

    A line goes on with the line before it or starts a new label, so labels are the islands
    between breaks in one ordered window per page.
    """
    rows = lines.filter(F.trim("text") != "").join(anchor_lines.withColumn("_anchor", F.lit(True)), [*PAGE, "ord"], "left")
    rows = with_page_array(rows, rules.filter("orientation = 'H'"), "_rules", "ord", "bbox")
    order = Window.partitionBy(*PAGE).orderBy(F.coalesce("column", F.lit(-1)), "bbox.y0", "bbox.x0", "ord")
    line = F.struct("text", "bbox", "size", "bold", "region", "column", "from_annotation", "block_no")
    rows = rows.withColumn("_a", F.lag(line).over(order))
    a, ab, b = F.col("_a"), F.col("_a.bbox"), F.col("bbox")
    ruled = F.exists("_rules", lambda r: (G.cy(r.bbox) >= ab.y1) & (G.cy(r.bbox) <= b.y0) & (G.h_overlap(r.bbox, ab) > 0))
    alike = (a.region == F.col("region")) & a.column.eqNullSafe(F.col("column")) & (a.from_annotation == F.col("from_annotation")) & ((F.col("region") == "BODY") | F.col("from_annotation"))
    fresh = F.coalesce("_anchor", F.lit(False)) | F.col("text").rlike(NEW_ITEM) | (a.text.rlike(TERMINATED) & ~F.col("text").rlike(LIST_CONTINUES)) | ruled
    styled = (F.abs(a["size"] - F.col("size")) <= SIZE_TOL) & (a.bold == F.col("bold")) & (b.y0 - ab.y1 <= GAP_RATIO * F.greatest(a["size"], F.col("size"), F.lit(1.0)))
    lined_up = ((F.abs(ab.x0 - b.x0) <= ALIGN_TOL) | (F.abs(ab.x1 - b.x1) <= ALIGN_TOL) | (F.abs(G.cx(ab) - G.cx(b)) <= ALIGN_TOL)) & (G.h_overlap(ab, b) >= 0.3)
    goes_on = alike & ~fresh & styled & (((a.block_no == F.col("block_no")) & ~a.from_annotation) | lined_up)
    rows = rows.withColumn("group_id", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(order) - 1).withColumn("_k", F.row_number().over(order))
    lines_of = F.array_sort(F.collect_list(F.struct("_k", "text", "ord", "from_annotation")))
    head = lambda c: F.min_by(c, "_k").alias(c)
    return rows.groupBy(*PAGE, F.col("group_id").cast("int").alias("group_id")).agg(
        join_lines(F.transform(lines_of, lambda x: x.text)).alias("text"), F.struct(F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1")).alias("bbox"),
        head("region"), head("column"), head("size"), head("bold"), F.array_sort(F.collect_set("block_no")).alias("block_ids"), F.count(F.lit(1)).cast("int").alias("line_count"), F.every("from_annotation").alias("markup_only"))


def assign_roles(groups: DataFrame, controls: DataFrame, bands: DataFrame) -> DataFrame:
    """``role``, ``role_confidence`` and ``role_evidence`` of every label."""
    body = groups.filter((F.col("region") == "BODY") & ~F.col("markup_only")).groupBy(*PAGE).agg(F.median("size").alias("_median"))
    rows = with_page_array(_bands(groups, bands), controls, "_controls", "ord", "bbox").join(body, PAGE, "left").fillna({"_median": 0.0})
    rows = rows.withColumn("_band", _own_band(F.col("column")))
    b, band = F.col("bbox"), F.col("_band")
    ended = F.col("text").rlike(TERMINATED)
    to_right = F.exists("_controls", lambda c: (c.bbox.x0 >= b.x1) & (G.v_overlap(c.bbox, b) >= ROW_OVERLAP))
    own = (F.size("bands") >= 2) & band.isNotNull() & F.exists("_controls", lambda c: (G.v_overlap(c.bbox, b) >= ROW_OVERLAP) & G.in_band(c.bbox, band.x0, band.x1, 0.3) & G.near(b, c.bbox, CONTROL_NEAR))
    short = (F.size(F.split(F.trim("text"), r"\s+")) <= 4) & ~ended
    hint = F.coalesce(band.role_hint, F.lit("UNKNOWN"))
    asks, answers = hint == "QUESTION_ZONE", hint == "RESPONSE_ZONE"
    points = lambda *pairs: sum((F.when(c, v).otherwise(0.0) for c, v in pairs), F.lit(0.0))
    question, response = points((asks, 0.5), (ended, 0.3), (to_right, 0.3)), points((answers, 0.5), (own, 0.4), (short, 0.1))
    why = F.array_compact(F.array(F.when(asks, "lies where questions stand"), F.when(answers, "lies where answers stand"), F.when(ended, "ends like a question"), F.when(to_right, "an answer box follows on its row"),
                                  F.when(own, "has an answer box in its band"), F.when(short, "few words")))
    spans = F.size(F.filter("bands", lambda x: G.in_band(b, x.x0, x.x1, 0.2))) > 1
    heading = (F.col("bold") | (F.col("size") > F.col("_median") + SIZE_TOL)) & ((F.size("bands") < 2) | spans)
    tagged = lambda role, confidence, evidence: F.struct(F.lit(role).alias("role"), confidence.cast("double").alias("role_confidence"), evidence.alias("role_evidence"))
    margin = lambda role: tagged(role, F.lit(0.9), F.array(F.concat(F.lit("in the "), F.lower("region"))))
    verdict = (F.when(F.col("markup_only"), tagged("UNKNOWN", F.lit(0.0), F.array(F.lit("markup, not page text")))).when(F.col("region") == "HEADER", margin("PAGE_HEADER")).when(F.col("region") == "FOOTER", margin("FOOTER"))
               .when(heading, tagged("SECTION_HEADER", F.lit(0.7), F.concat(why, F.array(F.lit("set off by weight or size")))))
               .when(F.greatest(question, response) == 0, tagged("UNKNOWN", F.lit(0.0), why)).when(question >= response, tagged("QUESTION", F.bround(F.least(question, F.lit(1.0)), 2), why))
               .otherwise(tagged("RESPONSE_OPTION", F.bround(F.least(response, F.lit(1.0)), 2), why)))
    return rows.withColumn("_v", verdict).select("*", "_v.*").drop("_v", "_band", "_controls", "_median", "bands")


def analyze(lines: DataFrame, pages: DataFrame, rules: DataFrame, controls: DataFrame, annotations: DataFrame) -> dict[str, DataFrame]:
    """The whole layout pass: ``lines`` with region and column, ``bands`` and ``groups`` with roles."""
    tagged = tag_markup(lines, annotations)
    regions = tag_regions(tagged, body_bounds(pages, rules), repeated_lines(tagged, pages))
    bands = detect_columns(regions, pages, controls)
    placed = assign_columns(regions, bands)
    groups = assign_roles(group_lines(placed, anchors(placed, controls, bands), rules), controls, bands)
    return {"lines": placed, "bands": bands, "groups": groups}
