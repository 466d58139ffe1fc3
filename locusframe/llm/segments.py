"""Cached encoding of text by segments that every byte-level pre-tokeniser keeps apart.

Words repeat, so a worker encodes each distinct segment once and looks the rest up.  A cut is
made only where the pre-token pattern always has a boundary: before white space that follows
something else, and after a run of Latin letters that a blank or ASCII punctuation follows.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable

import numpy as np

#: White_Space of the Unicode character database, as the pattern's ``\s`` reads it.
WHITE = "\t-\r \x85\xa0  -     　"
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
SEGMENT = re.compile(
    # What follows a quantifier never fits its own characters, so none gives any back (possessive).
    f"[{WHITE}]*+[{_LATIN}]++(?=[{WHITE}!-/:-@\\[-`{{-~]|\\Z)|[{WHITE}]*+[^{WHITE}]++|[{WHITE}]++"
)
#: A segment that the pattern takes as one pre-token.
WORD = re.compile(f" ?[{_LATIN}]+")


class SegmentEncoder:
    """``encode_many`` maps segments to id lists; at most ``limit`` of them are remembered.

    Segments over ``longest`` characters are encoded each time, so memory stays bounded
    whatever the texts hold.
    """

    def __init__(self, encode_many: Callable[[list[str]], Iterable], limit: int = 1_000_000, longest: int = 64):
        self.encode_many, self.limit, self.longest = encode_many, limit, longest
        self.known: dict[str, bytes] = {}

    def _packed(self, segments: list[str]) -> Iterable[bytes]:
        return (array("I", ids).tobytes() for ids in self.encode_many(segments))

    def _encode(self, text: str) -> np.ndarray:
        segments = SEGMENT.findall(text)
        packed = list(map(self.known.get, segments))
        if None in packed:
            new = list({s for s, p in zip(segments, packed, strict=True) if p is None})
            fresh = dict(zip(new, self._packed(new), strict=True))
            packed = [fresh[s] if p is None else p for s, p in zip(segments, packed, strict=True)]
            short = {s: p for s, p in fresh.items() if len(s) <= self.longest}
            if len(self.known) + len(short) > self.limit:
                self.known.clear()
            if len(short) <= self.limit:
                self.known.update(short)
        return np.frombuffer(b"".join(packed), dtype="u4")

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [self._encode(t) for t in texts]


def batches(texts: list[str], most_chars: int = 2_000_000) -> Iterable[tuple[int, int]]:
    """Index ranges of neighbouring texts with about ``most_chars`` characters together."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most_chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
