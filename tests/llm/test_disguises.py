"""Disguised words against the features of the plain word."""

import pytest

from formweave.llm import toxicity

PLAIN = {"stupid": 40, "loser": 40, "idiot": 50, "scum": 30, "the": 900, "a": 800, "is": 500, "other": 200, "you": 300, "be": 200, "tree": 100, "still": 80}


def grams_of(words):
    grams = {}
    for w, n in words.items():
        p = "^^" + w + "$"
        for i in range(len(p) - 2):
            grams[p[i:i + 3]] = grams.get(p[i:i + 3], 0) + n
    return grams


@pytest.mark.parametrize("text,word", [("stu.pid", "stupid"), ("lo-ser", "loser"), ("i_d_iot", "idiot"), ("iidiioott", "idiot"), ("scuum", "scum"), ("is a i d i o t", "idiot"), ("you.idiot", "idiot"), ("i d i o t", "idiot"), ("1d10t", "idiot")])
def test_disguised_words_weigh_as_plain_ones(text, word):
    score = toxicity.Scorer(grams_of(PLAIN), {"=" + word: 3.0})
    assert score(text)[1] == score(word)[1] == 3.0


def test_plain_words_stay():
    restore = toxicity.Restorer(grams_of(PLAIN))
    assert [restore(w) for w in ("tree", "still", "other", "2024", "3.14")] == [[w] for w in ("tree", "still", "other", "2024", "3.14")]


def test_trigrams_are_counted_over_all_documents(spark):
    docs = spark.createDataFrame([(1, "one two two"), (2, "stupid one"), (3, "žluťoučký žluťoučký, two!"), (4, None), (None, "one")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    want = {}
    for words in (["one", "two"], ["stupid", "one"], ["žluťoučký", "žluťoučký", "two"], ["one"]):
        for gram, n in grams_of(dict.fromkeys(words, 1)).items():
            want[gram] = want.get(gram, 0) + n
    for gram, n in grams_of({"žluťoučký": 1}).items():  # with a comma it is another word of its text
        want[gram] += n
    assert toxicity.train(docs, labels)["grams"] == want
