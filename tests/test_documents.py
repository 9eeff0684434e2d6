"""The five-page study end to end."""

from collections import Counter


def rows(df, *cols):
    return [tuple(r) if len(cols) > 1 else r[0] for r in df.select(*cols).collect()]


def test_fields_per_page(study):
    assert Counter(rows(study["fields"], "page")) == {1: 4, 2: 3, 3: 2, 4: 1, 5: 4}


def test_forms(study):
    got = {r.name: (r.domain, r.source) for r in study["forms"].collect()}
    assert got == {"Demographics": ("DM", "TITLE_LINE"), "Medical History": ("MH", "TITLE_LINE"), "Disposition": ("DS", "DOMAIN_ANNOTATION"), "Eligibility Criteria": ("EL", "TITLE_LINE")}
    assert {r.name: (r.pages, r.continuation_pages) for r in study["forms"].collect()}["Medical History"] == ([2, 3], [3])


def test_columns(study):
    assert Counter(p for p in rows(study["bands"], "page") if p < 5) == {1: 1, 2: 1, 3: 1, 4: 2}


def test_annotation_types(study):
    assert Counter(rows(study["annotations"], "annot_type")) == {"DOMAIN_HEADER": 4, "VARIABLE": 7, "SUPP_QUALIFIER": 2, "CROSS_REFERENCE": 2, "NOT_SUBMITTED": 1, "CONSTANT_ASSIGNMENT": 1}


def accepted(study):
    links = study["links"].filter("NOT rejected")
    text = study["fields"].select("doc_id", "field_id", "text")
    mark = study["annotations"].select("doc_id", "annotation_id", study["annotations"]["text"].alias("mark"))
    return links.join(text, ["doc_id", "field_id"]).join(mark, ["doc_id", "annotation_id"])


def test_links(study):
    got = dict(rows(accepted(study), "text", "mark"))
    question = "Please record protocol version on which subject is currently enrolled"
    assert got == {"Date of birth": "BRTHDTC", "Age": "AGE", "Sex": "SEX", "Race": "RACE", "Condition": "MHTERM", "Start Date": "MHSTDTC", "Ongoing": "MHENRF=ONGOING", "Stop Date": "MHENDTC",
                   question: 'SUPPDS.QVAL when QNAM = "PROTVER"'}
    assert accepted(study).agg({"link_score": "avg"}).first()[0] > 0.7


def test_unlinked(study):
    from formweave.operators.linking import unlinked_annotations

    assert set(rows(unlinked_annotations(study["annotations"], study["links"]), "text")) == {"RACEOTH when SUPPDM.QNAM=RACEOTH", "[NOT SUBMITTED]"}


def test_options_belong_to_the_question(study):
    got = study["fields"].filter("page = 4").first()
    assert [o.text for o in got.options] == ["Original", "Amendment 1", "Amendment 2", "Amendment 3", "Amendment 4"]
