"""What goes to the `tokenizers` library, and what comes back."""

import random
from array import array

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from formweave.llm import hub

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_only_distinct_words_go_to_the_library():
    coder = hub.Encoder(hub.read_vocabulary(PATH).decode(), public_tokenizers.PATTERN)
    asked, words = [], coder.words
    coder.words = lambda texts, **how: asked.extend(texts) or words(texts, **how)
    coder.encode(pa.array(["Lörem ipsum, ipsum. (dolor) sit\namet it's", "ipsum; Lörem sit"], pa.large_string()))
    sent = [w for text in asked for w in text.split(" ")]
    assert len(sent) == len(set(sent)) and coder.letters[10] not in sent
    assert len(sent) < 20


def test_ids_are_those_of_the_library():
    whole, rng = Tokenizer.from_file(PATH), random.Random(3)
    parts = ["Lörem", "ipsum", "it's", "'s", "’s", "x'll", "7", "a1b2", "²", "ª", "×", "÷", "ɏ", "ɐ", "Ωmega", "你好", "é", "🙂", "", " ", "\n", "\t", " ", "\x00", "\x01", ".", "...", "_", "[x]", "\\", "`", "^", "~", "\x7f", "<|endoftext|>", "퟿"]
    texts = ["", *("".join(rng.choice(parts) + rng.choice(["", "", " ", " ", "\n", ","]) for _ in range(rng.randint(1, 12))) for _ in range(3000))]
    coder = hub.Encoder(hub.read_vocabulary(PATH).decode(), public_tokenizers.PATTERN, limit=300)
    for k in range(0, len(texts), 500):
        got = coder.encode(pa.array(texts[k:k + 500], pa.large_string()))
        assert got == [array("I", whole.encode(t, add_special_tokens=False).ids).tobytes() for t in texts[k:k + 500]]
    assert len(coder.words_known) < 1000
