"""The tree that a parse makes: nodes with byte spans."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

Segment = tuple[int, int, int]  # start, end, virtual spaces before


class Node:
    __slots__ = ("end", "kids", "lazy", "props", "segments", "spans", "start", "type")

    def __init__(self, type: str, start: int, end: int, **props):
        self.type, self.start, self.end = type, start, end
        self.kids: list[Node] = []
        self.props = props
        self.spans: dict[str, tuple[int, int]] = {}
        self.segments: dict[str, list[Segment]] = {}
        self.lazy: Sequence[tuple[int, int]] = ()


class Joined:
    """The lines of a leaf as one text, and the way back to the source."""

    __slots__ = ("at", "lines", "text")

    def __init__(self, source: bytes, lines: list[Segment]):
        parts = [b" " * pad + source[a:b] for a, b, pad in lines]
        self.lines, self.text = lines, b"\n".join(parts)
        self.at, n = [], 0
        for p in parts:
            self.at.append(n)
            n += len(p) + 1

    def line(self, i: int) -> int:
        return max(0, bisect_right(self.at, i) - 1)

    def place(self, i: int) -> int:
        """The source offset of a position; virtual spaces are where their line starts."""
        if not self.lines:
            return 0
        k = bisect_right(self.at, i) - 1 if len(self.at) > 1 else 0
        a, b, pad = self.lines[k if k > 0 else 0]
        at = a + i - self.at[k if k > 0 else 0] - pad
        return a if at < a else b if at > b else at

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self.place(a), self.place(b)

    def pieces(self, a: int, b: int) -> list[Segment]:
        """The part of each line that a range covers."""
        out = []
        for k in range(self.line(a), self.line(b) + 1 if self.lines else 0):
            s, e, pad = self.lines[k]
            base = self.at[k]
            lo, hi = max(a, base) - base, min(b, base + pad + e - s) - base
            out.append((s + max(0, lo - pad), s + max(0, hi - pad), max(0, min(hi, pad) - lo)))
        return out
