"""Line dedup cuts a text once where it reads it, not once for each line."""

from formweave.llm import line_dedup


def splits(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("split(")


def test_a_text_is_cut_once(spark):
    docs = spark.createDataFrame([(k, f"own line {k} of it\nshared by all of them\nvalue {k} is given here\n") for k in range(4)] + [(9, None), (10, "")], "doc_id long, text string")
    lines = line_dedup._lines(docs, "text", 2)
    assert splits(lines) == 1
    assert lines.filter("tokens IS NULL").count() == 0 and lines.select("at").distinct().count() == 3
    got = line_dedup.line_dedup(docs)
    assert splits(got) == 1
    assert {(r.doc_id, r.n_lines, r.n_dropped) for r in got.collect()} == {*((k, 4, 3) for k in range(4)), (9, 0, 0), (10, 1, 0)}
