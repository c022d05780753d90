"""Classes of code points as the tokenizers library has them: each is asked of the library when first met.

The library carries its own Unicode tables, older or newer than those of other packages, so no other table gives
its tokens for every text.
"""

from __future__ import annotations

import numpy as np
from tokenizers import Regex, pre_tokenizers

LETTER, NUMBER, OTHER, SPACE, UNKNOWN = 0, 1, 2, 4, 255
PATTERNS = [(LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")]


class Signs:
    """The class of each code point: LETTER, NUMBER, SPACE or OTHER, or what ``own`` says of some of them."""

    def __init__(self, own: dict[str, int] | None = None):
        self.at = np.full(0x110000, UNKNOWN, np.uint8)
        self.at[0xD800:0xE000] = OTHER  # no text holds them
        self.tests = [(kind, pre_tokenizers.Split(Regex(p), "removed")) for kind, p in PATTERNS]
        self.ask(np.arange(128))
        for sign, kind in (own or {}).items():
            self.at[ord(sign)] = kind

    def ask(self, points: np.ndarray) -> None:
        signs = "".join(map(chr, points.tolist()))
        self.at[points] = OTHER
        for kind, test in self.tests:
            match = np.ones(len(points), bool)
            for _, (a, b) in test.pre_tokenize_str(signs):  # what is left after the matches have gone
                match[a:b] = False
            self.at[points[match]] = kind

    def of(self, points: np.ndarray) -> np.ndarray:
        kinds = self.at[points]
        new = kinds == UNKNOWN
        if new.any():
            self.ask(np.unique(points[new]))
            kinds = self.at[points]
        return kinds

    def split(self, pattern, text: str) -> list[str]:
        """Matches of a pattern of \\p{L}, \\p{N} and \\s, with the library's classes: the pattern reads a text of
        stand-ins of like classes, sign for sign."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        shape = np.where(points < 128, points, STAND_IN[self.of(points)]).astype(np.uint8)
        return [text[m.start() : m.end()] for m in pattern.finditer(shape.tobytes().decode("ascii"))]


STAND_IN = np.full(256, ord("!"), np.uint8)
STAND_IN[[LETTER, NUMBER, SPACE]] = [ord("a"), ord("0"), ord(" ")]
