"""Near-duplicate removal with null and repeated ids."""

from collections import Counter

from formweave.llm import jaccard


def test_rows_of_an_id_go_by_their_own_text(spark):
    base = [f"w{k}" for k in range(60)]
    near = " ".join([*base[:-1], "other"])
    kept = [(1, "One two three four five six"), (None, "clean text of its own here now"), (None, None), (4, "A b c d e f g"), (5, "unrelated words stay where they are"), (7, " ".join(base)), (8, "alone in its component as it is"), (9, "")]
    gone = [(None, "one two three four five six"), (5, "a b c d e f g"), (8, near)]
    docs = spark.createDataFrame([(i, t, 3) for i, t in kept + gone], "doc_id long, text string, n long")
    got = jaccard.distinct_documents(docs)
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == Counter((i, t, 3) for i, t in kept)
