"""The `tokenizers` library over Arrow batches: whole texts to ids, each distinct piece once.

In the vocabulary's pattern a single blank between two characters that are not white space begins
a new pre-token, and a single line feed there is one of its own.  Most texts have no other white
space: Arrow cuts those at blanks and line feeds and numbers the distinct pieces.  Pieces of Latin
letters and signs are two pre-tokens, others are cut by the pattern; new pre-tokens go to the
library's own BPE model, spelt in the vocabulary's letters, one word each; and the ids of all texts
are gathered from that table.  All other texts, and all texts if the file is of another kind, go to
the library's tokenizer as they are.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import public_tokenizers

from .workers import held

#: Texts that are not cut: runs of white space or white space at an end, other white space than a
#: blank or a line feed, control characters.
_ODD = "[ \\n][ \\n]|^[ \\n]|[ \\n]$|[\\x{00}-\\x{09}\\x{0B}-\\x{1F}\\x{7F}-\\x{A0}\\x{1680}\\x{180E}\\x{2000}-\\x{200F}\\x{2028}-\\x{202F}\\x{205F}-\\x{206F}\\x{3000}\\x{FEFF}]"
_CUT = "\x01"
#: Pieces of Latin letters (below U+0250, in all versions of Unicode), maybe after a blank, and of signs after them, without
#: apostrophes: the pattern cuts between the letters and the signs, and nowhere else.
_SIMPLE = "^(?P<letters> ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)(?P<signs>[!-&(-/:-@\\[-`{-~]*)$"
#: Settings under which tokens would not spell the word that they make up.
_RESPELT = ("continuing_subword_prefix", "end_of_word_suffix", "unk_token", "byte_fallback", "dropout")


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file, read once on the driver and broadcast (a few MB, fixed)."""
    with open(path, "rb") as f:
        return f.read()


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary.

    Fixed rule of the file format: printable Latin-1 bytes stand for themselves, the others take
    the letters from U+0100 on in ascending order.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def gathered(pool: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Runs of ``n[k]`` values of ``pool`` from ``begin[k]``, one after another."""
    ends = np.concatenate([[0], np.cumsum(n)])
    return pool[np.repeat(begin - ends[:-1], n) + np.arange(ends[-1])]


class Encoder:
    """Encodes Arrow string arrays; remembers up to ``limit`` pieces between calls."""

    def __init__(self, content: str, pattern: str, limit: int = 500_000):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        whole = Tokenizer.from_str(content)
        self.whole = getattr(whole, "encode_batch_fast", whole.encode_batch)
        self.limit = limit
        spec = json.loads(content)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        pre = spec.get("pre_tokenizer") or {}
        self.plain = pattern == public_tokenizers.PATTERN and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        if self.plain:
            self.pattern = regex.compile(pattern)
            words = Tokenizer.from_str(json.dumps({**spec, "pre_tokenizer": None, "post_processor": None, "decoder": None, "added_tokens": []}))
            words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.words = getattr(words, "encode_batch_fast", words.encode_batch)
            self.letters = {**byte_letters(), 0: " "}
            vocabulary = words.get_vocab()
            self.plain = vocabulary.keys() >= set(byte_letters().values()) and not any(map(spec["model"].get, _RESPELT))
            self.spans = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
            self.spans[list(vocabulary.values())] = list(map(len, vocabulary))
            self.fixed = {"": b"", "\n": array("I", [vocabulary.get(self.letters[10], 0)]).tobytes()}
            self.known, self.words_known = dict(self.fixed), dict(self.fixed)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.whole(texts, add_special_tokens=False)]

    def _bpe(self, new: list[str], per_call: int = 20_000) -> list[bytes]:
        """Ids of new pre-tokens; the lengths of the tokens' spellings tell them apart."""
        out = []
        for k in range(0, len(new), per_call):
            spelt = "\0".join(new[k:k + per_call]).encode().decode("latin-1").translate(self.letters)
            ids = np.frombuffer(array("I", self.words([spelt], add_special_tokens=False)[0].ids), np.uint32)
            ends, spans = np.cumsum(list(map(len, spelt.split(" ")))), np.cumsum(self.spans[ids])
            cuts = np.searchsorted(spans, ends)
            if spans[-1] != ends[-1] or not np.array_equal(spans[cuts], ends):
                raise ValueError("tokens do not spell their words")
            raw, ends = ids.tobytes(), (4 * cuts + 4).tolist()
            out += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def _cut(self, new: list[str], per_call: int = 20_000) -> list[bytes]:
        """Ids of new pieces: the pattern cuts them, a line feed between two ends the first."""
        out = []
        for k in range(0, len(new), per_call):
            some = new[k:k + per_call]
            found = self.pattern.findall("\n".join(some))
            distinct = list(set(found))
            get, begin = dict(zip(distinct, self._known(self.words_known, distinct, self._bpe), strict=True)).__getitem__, 0
            ends = [i for i, w in enumerate(found) if w == "\n"]
            for end in [*ends, len(found)]:
                out.append(b"".join(map(get, found[begin:end])))
                begin = end + 1
        return out

    def _known(self, memo: dict, keys: list[str], learn) -> list[bytes]:
        """Ids of distinct strings by a memo, which begins anew beyond the limit."""
        table = list(map(memo.get, keys))
        at = [i for i, ids in enumerate(table) if ids is None]
        if at:
            new = [keys[i] for i in at]
            made = learn(new)
            if len(memo) + len(new) > self.limit:
                memo.clear()
                memo.update(self.fixed)
            memo.update(zip(new, made, strict=True))
            for i, ids in zip(at, made, strict=True):
                table[i] = ids
        return table

    def _plain(self, texts) -> list[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        cut = pc.replace_substring(pc.replace_substring(texts, "\n", f"{_CUT}\n{_CUT}"), " ", f"{_CUT} ")
        lists = pc.split_pattern(cut, _CUT)
        coded = lists.flatten().dictionary_encode()
        at, distinct = coded.indices.to_numpy(), coded.dictionary
        # a distinct piece is two words, or one piece and nothing
        parts = pc.extract_regex(distinct, _SIMPLE)
        simple = parts.is_valid()
        words = pa.concat_arrays([pc.struct_field(parts.filter(simple), k) for k in ("letters", "signs")]).dictionary_encode()
        strings = lambda x: x.to_numpy(zero_copy_only=False).tolist()
        table = self._known(self.words_known, strings(words.dictionary), self._bpe)
        mask, held = simple.to_numpy(zero_copy_only=False), len(table)
        table += self._known(self.known, strings(distinct.filter(pc.invert(simple))), self._cut)
        row = np.full((len(mask), 2), len(table))
        row[mask] = words.indices.to_numpy().reshape(2, -1).T
        row[~mask, 0] = np.arange(held, len(table))
        size = np.array([*map(len, table), 0], np.int64) >> 2
        pool = gathered(np.frombuffer(b"".join(table), np.uint32), (np.cumsum(size) - size)[row.ravel()], size[row.ravel()])
        size = size[row].sum(axis=1)
        n = size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = gathered(pool, (np.cumsum(size) - size)[at], n).astype("<u4").tobytes()
        cuts = (4 * ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]).tolist()
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts) -> list[bytes]:
        """Id bytes (little-endian unsigned 32 bits) of a string array without nulls."""
        import pyarrow.compute as pc

        if not self.plain:
            return self._whole(texts.to_pylist())
        odd = pc.match_substring_regex(texts, _ODD)
        for special in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        mask = odd.to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        for rows, encode in ((np.flatnonzero(~mask), self._plain), (np.flatnonzero(mask), lambda x: self._whole(x.to_pylist()))):
            if len(rows):
                for i, ids in zip(rows.tolist(), encode(texts.take(rows) if len(rows) < len(texts) else texts), strict=True):
                    out[i] = ids
        return out


def encoder_for(content: bytes) -> Encoder:
    """This worker's encoder of a vocabulary, made once and kept between tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return held(("hub", hash(content)), lambda: Encoder(content.decode(), public_tokenizers.PATTERN))


def encoded(content: bytes, texts, chunk: int = 6_000_000):
    """Id bytes of each text of an Arrow string array (null: empty), in order."""
    import pyarrow as pa
    import pyarrow.compute as pc

    coder, texts = encoder_for(content), pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0, np.int64)
    begin = 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        end = max(int(np.searchsorted(ends, before + chunk)), begin + 1)
        part = texts.slice(begin, end - begin)
        yield from coder.encode(pa.concat_arrays([part]))
        begin = end
