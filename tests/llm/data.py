"""Small tables with the cases every corpus operator must stand: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

WORDS = "the of and to idiot Ähre 12345678 a, b. don't naïve #### x|y 日本語 😀 zebra yacht <|endoftext|> sum".split()


def text(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n", "\t", "  "]) for _ in range(n))


def rows(seed: int = 7, n: int = 60):
    """(doc_id, text, source, score): score clashes with operators' own column names."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append((i, text(rng, rng.choice([0, 1, 3, 5, 40, 200])), rng.choice(["a", "b", "é", None]), float(i)))
    base = text(rng, 120)
    words = base.split()
    for k in range(8):  # near copies
        w = list(words)
        w[5 * k] = f"changed{k}"
        out.append((n + k, " ".join(w), "a", 0.0))
    out += [
        (n + 10, base, "a", None), (n + 11, base.upper(), "b", None), (n + 12, base, None, 1.0),
        (n + 13, None, "a", 1.0), (n + 14, "", None, 1.0), (None, "no id here at all", "a", None), (None, None, None, None),
        (n + 15, text(rng, 9000), "c", 1.0), (n + 16, "x" * 30000, "c", 1.0), (n + 17, "same row", "a", 1.0), (n + 17, "same row", "a", 1.0), (n + 17, "other row", "a", 1.0),
    ]
    return out


SCHEMA = "doc_id long, text string, source string, score double"
