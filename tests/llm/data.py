"""Small inputs with every awkward case, and plain versions of the operators to compare with."""

from __future__ import annotations

import random
import re

CONTENT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def lowered(text: str | None) -> str:
    return (text or "").translate(LOWER)


def rows_of(texts: list[str | None], start: int = 0) -> list[tuple]:
    return [(start + i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def awkward() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, repeated rows and repeated texts."""
    return [
        (0, None, None, None, None),
        (1, "", "en", "s", 0),
        (2, " \n\t ", "en", "s", 4),
        (3, "one", "en", "s", 3),
        (4, "Ein kurzer Text über é̀ 😀 <|endoftext|> don't I'LL", "de", "s", 50),
        (4, "Ein kurzer Text über é̀ 😀 <|endoftext|> don't I'LL", "de", "s", 50),
        (5, "word " * 60_000, "en", "s", 300_000),
        (None, "a document without id has words of its own", None, "s", 1),
        (6, "a document without id has words of its own", None, "s", 1),
        (7, "-- !! ..", "en", "s", 8),
    ]


def prose(n: int, seed: int, words: int = 60, vocabulary: int = 400) -> list[str]:
    rng = random.Random(seed)
    pool = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiouéü") for _ in range(rng.randint(1, 4))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(pool) for _ in range(rng.randint(1, words))) for _ in range(n)]


def union_find(nodes, links) -> dict:
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}
