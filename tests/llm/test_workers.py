"""What Python workers hold between operators."""

import weakref

import public_tokenizers

from formweave.llm import hub, jaccard, quality, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_a_worker_gives_up_the_memo_of_the_stage_before():
    scorer = weakref.ref(toxicity._scorer("model", {"grams": {"^^a": 1.0}, "weights": {}}))
    assert scorer() is toxicity._scorer("model", {})
    quality.features("some words")
    assert scorer() is None
    coder = weakref.ref(hub.encoder_for(hub.read_vocabulary(PATH)))
    jaccard.shingles("some words", 2)
    assert coder() is None
