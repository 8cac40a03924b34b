"""Ratios of matching blocks, asked only for pairs whose lengths allow the ratio that counts."""

from __future__ import annotations

import difflib


class Likeness:
    """Ratios of texts with known texts. What the matcher learns of a known text is kept for all texts that meet it."""

    def __init__(self, kept: int = 20_000) -> None:
        self._kept, self._known = kept, {}

    def ratio(self, a: str, b: str, least: float = 0.0) -> float:
        """The ratio of a with the known text b, or 0.0 where it cannot reach `least`: by lengths, then by characters."""
        total = len(a) + len(b)
        if total and 2 * min(len(a), len(b)) < least * total:
            return 0.0
        m = self._known.get(b)
        if m is None:
            if len(self._known) >= self._kept:
                self._known.clear()
            m = self._known[b] = difflib.SequenceMatcher(None, "", b)
        m.set_seq1(a)
        return m.ratio() if not least or m.quick_ratio() >= least else 0.0
