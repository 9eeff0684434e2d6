"""Extracted layers of small annotated forms, built from coordinates.

Text boxes are approximated: text at baseline (x, y) with size s spans y - 1.08 s to y + 0.30 s and half
a size per character.
"""

from __future__ import annotations

W, H = 595.0, 842.0
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
SCHEMAS = {
    "documents": "doc_id string, path string, file_name string, page_count int",
    "pages": "doc_id string, page int, width double, height double",
    "lines": f"doc_id string, page int, ord int, block_no int, text string, bbox {BOX}, size double, bold boolean, from_annotation boolean",
    "rules": f"doc_id string, page int, ord int, bbox {BOX}, orientation string, span_pct double",
    "controls": f"doc_id string, page int, ord int, bbox {BOX}, kind string",
    "annotations": f"doc_id string, page int, ord int, text string, bbox {BOX}, text_color array<double>, font_name string, font_size double",
}
RED = [0.85, 0.1, 0.1]


def text(x, y, s, size=10.0, bold=False, right=None):
    length = 0.5 * size * len(s)
    x0 = right - length if right is not None else x
    return {"text": s, "bbox": (x0, y - 1.08 * size, x0 + length, y + 0.30 * size), "size": size, "bold": bold}


def simple(title, labels, notes, header="STUDY XYZ-123"):
    """A page of labels on the left, answer boxes beside them and markup on the right."""
    lines = ([text(60, 60, header, 9.0)] if header else []) + [text(60, 88, title, 13.0, True)] + [text(60, y, s) for s, y in labels]
    return {"lines": lines, "rules": [], "controls": [((180, y - 11, 300, y + 4), "BOX") for _, y in labels], "annotations": [(s, (330, y - 12, 540, y + 4), 8.0) for s, y in notes]}


def circle(x, y, r):
    return ((x - r, y - r, x + r, y + r), "CIRCLE")


def rule(y, x0=55, x1=540):
    return ((x0, y, x1, y), (x1 - x0) / W)


PAGE_4 = {
    "lines": [text(60, 60, "Version", 10.0, True), text(60, 76, "Generated On: 01 Jan 2024", 10.0, True)]
    + [text(60, 112 + 12 * i, s) for i, s in enumerate(["Please record", "protocol", "version on", "which subject", "is currently", "enrolled:"])]
    + [text(430, 112 + 20 * i, s) for i, s in enumerate(["Original", "Amendment 1", "Amendment 2", "Amendment 3", "Amendment 4"])],
    "rules": [rule(92), rule(216)], "controls": [circle(515, 108 + 20 * i, 5) for i in range(5)],
    "annotations": [("DS=Disposition", (60, 20, 240, 40), 9.0), ('SUPPDS.QVAL when QNAM = "PROTVER"', (250, 130, 420, 160), 9.0)],
}


def eligibility():
    lines, controls, y = [text(60, 40, "Form: Eligibility Criteria", 13.0, True), text(60, 56, "Generated On", 9.0)], [], 90
    for number, count in enumerate((4, 7, 8, 5), 1):
        for i in range(count):
            words = f"criterion {number} states a condition that runs on" if i else f"Subject meets inclusion criterion number {number}"
            lines.append(text(0, y, words, 10.0, right=480))
            if i == 0:
                controls.append(circle(492, y - 3, 6))
            y += 12
    return {"lines": lines, "rules": [rule(66)], "controls": controls, "annotations": [("EL=Eligibility", (60, 10, 200, 28), 9.0), ("See Page 7", (250, 30, 340, 50), 9.0)]}


STUDY_1 = [
    simple("Form: Demographics", [("Date of birth", 120), ("Age", 150), ("Sex", 180), ("Race", 210)],
           [("DM=Demographics", 88), ("BRTHDTC", 118), ("AGE", 148), ("SEX", 178), ("RACE", 208), ("RACEOTH when SUPPDM.QNAM=RACEOTH", 232), ("[NOT SUBMITTED]", 262)]),
    simple("Form: Medical History", [("Condition", 120), ("Start Date", 150), ("Ongoing", 180)], [("MH=Medical History", 88), ("MHTERM", 118), ("MHSTDTC", 148), ("MHENRF=ONGOING", 178)]),
    simple("Form: Medical History (continued)", [("Condition", 120), ("Stop Date", 150)], [("See Page 2", 88), ("MHENDTC", 148)]),
    PAGE_4, eligibility(),
]
STUDY_2 = [simple("Form: Adverse Events", [("Adverse event", 120), ("Start Date", 150), ("Stop Date", 180)], [("AE=Adverse Events", 88), ("AETERM", 118), ("AESTDTC", 148), ("AEENDTC", 178)], header="")]


def without_markup(pages):
    return [{**p, "annotations": []} for p in pages]


def tables(spark, doc_id, pages):
    """The extracted layer of one document; markup text appears among the lines too."""
    box = lambda b: tuple(map(float, b))
    rows = {name: [] for name in SCHEMAS}
    rows["documents"].append((doc_id, f"/in/{doc_id}.pdf", f"{doc_id}.pdf", len(pages)))
    for n, page in enumerate(pages, 1):
        rows["pages"].append((doc_id, n, W, H))
        lines = page["lines"] + [{"text": s, "bbox": b, "size": z, "bold": False} for s, b, z in page["annotations"]]
        rows["lines"] += [(doc_id, n, i, i, x["text"], box(x["bbox"]), x["size"], x["bold"], False) for i, x in enumerate(lines)]
        rows["rules"] += [(doc_id, n, i, box(b), "H", span) for i, (b, span) in enumerate(page["rules"])]
        rows["controls"] += [(doc_id, n, i, box(b), kind) for i, (b, kind) in enumerate(page["controls"])]
        rows["annotations"] += [(doc_id, n, i, s, box(b), RED, "Helv", z) for i, (s, b, z) in enumerate(page["annotations"])]
    return {name: spark.createDataFrame(rows[name], schema) for name, schema in SCHEMAS.items()}


def analysed(spark, doc_id, pages):
    from formweave.plans.analyze import analyze_documents

    return analyze_documents(tables(spark, doc_id, pages), lambda df, name: spark.createDataFrame(df.collect(), df.schema))
