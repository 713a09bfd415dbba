"""License texts recognised by their words: the default detector that cleaning can be given."""

from __future__ import annotations

import re
from collections import Counter

from siltstone.functions.content import reflow

WINDOW = 16 * 1024  # characters that are compared
LEAST = 0.9


def _grams(text: str) -> Counter[tuple[str, ...]]:
    w = re.findall(r"[a-z0-9]+", text.lower())
    return Counter(zip(w, w[1:], strict=False)) if len(w) > 1 else Counter({(x,): 1 for x in w})


class TextDetector:
    """Names the known text whose word pairs agree best (Dice), if by at least `least`."""

    def __init__(self, texts: dict[str, str], least: float = LEAST):
        self.known = {k: _grams(t[:WINDOW]) for k, t in texts.items()}
        self.least = least

    def __call__(self, text: str) -> str | None:
        g = _grams(reflow(text[:WINDOW]))
        n = sum(g.values())
        best = max(((2 * sum((g & k).values()) / max(1, n + sum(k.values())), name) for name, k in self.known.items()), default=(0.0, ""))
        return best[1] if best[0] >= self.least and best[1] else None
