"""Pieces of packed texts do not depend on how the encoder cuts words."""

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from formweave.llm import hub, packing


def test_simple_words_pass_the_pattern_by_and_pack_alike(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = hub.Encoder(hub.read_vocabulary(path).decode(), public_tokenizers.PATTERN)
    monkeypatch.setattr(coder, "pattern", None)  # simple words need no pattern
    texts = ["Plain words, no more.", "Ünd wörds..."]
    whole = Tokenizer.from_file(path)
    ids = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert [len(x) // 4 for x in coder.encode(pa.array(texts, pa.large_string()))] == list(map(len, ids))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(7, None)], "doc_id long, text string")
    got = {r.doc_id: r.length for r in packing.pack_documents(docs, path).collect()}
    assert got == {0: len(ids[0]) + 1, 1: len(ids[1]) + 1, 7: 1}
