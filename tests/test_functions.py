"""Text, markup and similarity functions on labelled cases."""

import pytest
from pyspark.sql import functions as F

from formweave.functions import geometry as G
from formweave.functions import markup as M
from formweave.functions import similarity as S
from formweave.functions import text as X


def evaluate(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in df.select("i", *(c(F.col("t")).alias(f"c{k}") for k, c in enumerate(columns))).orderBy("i").collect()]




def test_split_label(spark):
    got = evaluate(spark, ["1. Have x", "a) Systolic", "(3) Weight", "iv. Diastolic", "• Ongoing", "Date of birth:"], lambda T: X.item_number(T), lambda T: X.label(T))
    assert got == [("1.", "Have x"), ("a)", "Systolic"), ("(3)", "Weight"), ("iv.", "Diastolic"), ("•", "Ongoing"), ("", "Date of birth")]


def test_clean_title(spark):
    got = evaluate(spark, ["Form: Medical History (continued)", "CRF - Adverse Events", "Concomitant Medications cont'd", "Vital Signs [continued]"], lambda T: X.clean_title(T))
    assert got == ["Medical History", "Adverse Events", "Concomitant Medications", "Vital Signs"]


def test_normalize_folds_unicode(spark):
    assert evaluate(spark, [None, "", "  Ａge (y) ", "é_A!b\r\n", "ﬁeld"], lambda T: X.normalize(T)) == ["", "", "age y", "é_a b", "field"]


def test_statements(spark):
    got = evaluate(spark, ["AESTDTC AEENDTC", "CMTRT / CMDOSE", "VSORRES, VSORRESU", "MHENRF=ONGOING", "RACE see below", "", None], lambda T: M.statements(T))
    assert got == [["AESTDTC", "AEENDTC"], ["CMTRT", "CMDOSE"], ["VSORRES", "VSORRESU"], ["MHENRF=ONGOING"], ["RACE see below"], [], []]


@pytest.mark.parametrize("text,kind", [
    ("DM=Demographics", "DOMAIN_HEADER"), ("BRTHDTC", "VARIABLE"), ("DM.BRTHDTC", "VARIABLE"), ("MHENRF=ONGOING", "CONSTANT_ASSIGNMENT"), ("RACEOTH when SUPPDM.QNAM=RACEOTH", "SUPP_QUALIFIER"),
    ('SUPPDS.QVAL when QNAM = "PROTVER"', "SUPP_QUALIFIER"), ("[NOT SUBMITTED]", "NOT_SUBMITTED"), ("See Page 7", "CROSS_REFERENCE"), ("AGE derived from BRTHDTC and RFSTDTC", "DERIVATION_RULE"), ("free prose", "NOTE"), ("DS=COMPLETED", "CONSTANT_ASSIGNMENT")])
def test_classify(spark, text, kind):
    assert evaluate(spark, [text], lambda T: M.classify(T))[0].annot_type == kind


def test_first_markup_settles_a_coded_header(spark):
    got = evaluate(spark, ["DS=COMPLETED"], lambda T: M.classify(T, F.lit(True)))[0]
    assert (got.annot_type, got.domain, got.confidence) == ("DOMAIN_HEADER", "DS", 0.55)


def test_appearance(spark):
    got = evaluate(spark, ["0.85 0.1 0.1 rg /Helv 8.0 Tf", "0 g /Cour 0 Tf", "0 1 1 0 k /F1 9 Tf", ""], lambda T: M.parse_appearance(T))
    assert [(g.text_color, g.font_name, g.font_size) for g in got] == [([0.85, 0.1, 0.1], "Helv", 8.0), ([0.0, 0.0, 0.0], "Cour", 0.0), ([1.0, 0.0, 0.0], "F1", 9.0), (None, "", 0.0)]


def test_hex(spark):
    assert evaluate(spark, ["#D91A1A", "d91a1a", "red", ""], lambda T: M.from_hex(T)) == [[0.851, 0.102, 0.102], [0.851, 0.102, 0.102], None, None]


def test_similarity(spark):
    df = spark.createDataFrame([("conditions", "condition"), ("start date of condition", "start date"), ("date", "start date"), ("start date", "stop date"), ("start date", "end date"), ("", "x")], "a string, b string")
    got = [r[0] for r in df.select(S.similarity(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([0.9789, 0.7174, 0.5286, 0.5531, 0.4806, 0.0], abs=1e-4)


def test_relative_label_and_clamp(spark):
    box = lambda *v: F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"), strict=True)))
    field = box(100, 100, 200, 110)
    row = spark.range(1).select(*(G.relative_label(box(*v), field).alias(f"l{i}") for i, v in enumerate([(210, 102, 250, 108), (10, 102, 90, 108), (150, 102, 250, 108), (100, 120, 150, 130), (100, 80, 150, 90)])), G.clamp(box(580, -5, 700, 10), F.lit(595.0), F.lit(842.0)).alias("c")).first()
    assert list(row)[:5] == ["right_of_field", "left_of_field", "overlapping_field", "below_field", "above_field"]
    assert tuple(row.c.rect) == (473.0, 2.0, 593.0, 17.0) and len(row.c.notes) == 2


def test_foreign_domain(spark):
    assert evaluate(spark, ["DSTERM", "MHTERM", "AGE", "SEX", "BRTHDTC", ""], lambda T: M.foreign_domain(T, F.lit("MH"))) == ["DS", "", "", "", "", ""]
