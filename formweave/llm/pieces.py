"""Cutting text where a byte-level BPE pre-tokeniser always cuts, so that pieces can be memoised.

In the pre-tokenisation pattern of this vocabulary a single space between two characters that are
not white space starts a new match, and a single line feed between two such characters is a match
of its own: no alternative runs over them.  Encoding the pieces (each with its leading space or
line feed) one by one therefore gives the ids of the whole text, and a piece met before needs no
work.  Runs of white space stay inside a piece.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

_CUT = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")


def cut(text: str) -> list[str]:
    """Pieces of ``text``; those after a space lost it, those after a line feed keep it."""
    return _CUT.split(text)


def ragged(piece: str) -> bool:
    """Whether ``piece``, without a first line feed, is empty or begins or ends with white space."""
    body = piece[1:] if piece[:1] == "\n" else piece
    return not body or body[0].isspace() or body[-1].isspace()


def _distinct(parts: list[list[str]]) -> tuple[set[str], set[str]]:
    heads, tails = {p[0] for p in parts}, set()
    for p in parts:
        tails.update(p)
    return heads, tails


class Memo:
    """Encodes whole texts through a bounded memo of pieces.

    ``encode_many(texts, lead)`` maps ``lead + text`` to id bytes (little-endian unsigned 32 bits).
    ``limit`` bounds the number of remembered pieces and ``longest`` the characters of one; beyond
    them pieces are encoded and forgotten.  Ragged pieces are never remembered: one among the
    parts of a text that was split at every space shows a run of white space, and such texts are
    cut again with care.
    """

    def __init__(self, encode_many: Callable[..., list[bytes]], limit: int = 500_000, longest: int = 40):
        self.encode_many, self.limit, self.longest = encode_many, limit, longest
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}
        self.feed = encode_many(["\n"], "")[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [t.replace("\n", " \n").split(" ") for t in texts]
        heads, tails = _distinct(parts)
        odd = {t for known, seen in ((self.first, heads), (self.rest, tails)) for t in seen.difference(known) if t.split() != [t] and ragged(t)}
        odd |= {t for t in heads.difference(self.first) if t[:1] == "\n"}
        if odd:
            parts = [p if odd.isdisjoint(p) else cut(t) for p, t in zip(parts, texts, strict=True)]
            heads, tails = _distinct(parts)
        if len(self.rest) > self.limit:
            self.rest.clear()
        if len(self.first) > self.limit // 8:
            self.first.clear()
        new, more = list(heads.difference(self.first)), list(tails.difference(self.rest))
        self.first.update(zip(new, self.encode_many(new, ""), strict=True))
        fed = [t for t in more if t[:1] == "\n" and not ragged(t)]
        self.rest.update((t, self.feed + x) for t, x in zip(fed, self.encode_many([t[1:] for t in fed], ""), strict=True))
        kept = [t for t in more if t[:1] == "\n" and ragged(t)]  # cut before the line feed: no space was lost
        spaced = [t for t in more if t[:1] != "\n"]
        for lead, some in (("", kept), (" ", spaced)):
            self.rest.update(zip(some, self.encode_many(some, lead), strict=True))
        first, rest = self.first, self.rest.__getitem__
        out = [first[p[0]] + b"".join(map(rest, p[1:])) for p in parts]
        for memo, added in ((first, new), (self.rest, more)):
            for t in added:
                if len(t) > self.longest or t.split() != [t] and ragged(t):
                    del memo[t]
        return out


def chunks(texts: list[str], limit: int = 4_000_000) -> Iterable[tuple[int, int]]:
    """Consecutive ranges of at least one text and about ``limit`` characters."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
