"""Byte-level BPE of many texts at once: NumPy finds the pieces, the library encodes each distinct piece.

The pre-tokenizer's pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Its pieces
are runs of one class of characters, with four turns: a space before a run joins it; of white space before a run the last
character stands alone if it is no space; white space that ends a text is one piece; an apostrophe that begins a run may
open a contraction. ``tests/llm`` compares with the library on whole texts.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from silverprint.llm.texts import distinct_spans
from silverprint.llm.word_bpe import tokenizer

#: Distinct pieces whose ids a process keeps; beyond them it starts anew.
CACHE = 500_000
_SPACE, _LETTER, _NUMBER, _OTHER, _EDGE = range(5)
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point, and of the mark that stands between texts (one beyond the last)."""
    import regex

    everything = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    table = np.full(0x110001, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for match in regex.finditer(pattern, everything):
            points = np.frombuffer(match.group().encode("utf-32-le"), np.uint32)
            table[points] = kind
    table[0x110000] = _EDGE
    return table


def _piece_spans(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every piece in code points that hold an edge mark after each text."""
    kind = _classes()[codes]
    n = len(codes)
    starts = np.ones(n, bool)
    starts[1:] = kind[1:] != kind[:-1]
    nxt = np.append(kind[1:], _EDGE)
    # the last of the white space before a run
    last = (kind == _SPACE) & (nxt != _SPACE) & (nxt != _EDGE)
    starts[last] = True
    joins = np.flatnonzero(last & (codes == 32)) + 1
    starts[joins] = False
    joined = np.zeros(n, bool)
    joined[joins] = True
    marks = np.flatnonzero((codes == 39) & starts & ~joined)
    if len(marks):
        padded = np.append(codes, [0x110000] * 3)
        for tail in _CONTRACTIONS:
            hit = np.ones(len(marks), bool)
            for i, c in enumerate(tail, 1):
                hit &= padded[marks + i] == ord(c)
            at = marks[hit]
            starts[at + 1] = False
            after = at + 1 + len(tail)
            starts[after[after < n]] = True
            marks = marks[~hit]
    starts[kind == _EDGE] = True
    first = np.flatnonzero(starts)
    end = np.append(first[1:], n)
    inside = kind[first] != _EDGE
    return first[inside], end[inside]


class Encoder:
    """Ids of texts by the tokenizer of a vocabulary file; strings of special tokens become their ids."""

    def __init__(self, path: str):
        self.model = tokenizer(path)
        self.special = {t.content: i for i, t in self.model.get_added_tokens_decoder().items()}
        self.cut = re.compile(f"({'|'.join(map(re.escape, self.special))})")
        self.cache: dict[bytes, bytes] = {}
        # the library's byte alphabet: printable bytes stand for themselves, the others follow from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = (b for b in range(256) if b not in set(plain))
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _ids_of(self, piece: bytes) -> bytes:
        tokens = self.bpe.tokenize(piece.decode("latin-1").translate(self.alphabet))
        return np.array([t.id for t in tokens], np.uint32).tobytes()

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each has; no special tokens."""
        joined = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        edges = np.cumsum(lengths)
        codes = np.insert(np.frombuffer(joined.encode("utf-32-le"), np.uint32), edges, 0x110000)
        first, end = _piece_spans(codes)
        widths = (codes < 0x110000).view(np.uint8) + (codes >= 0x80).view(np.uint8) + (codes >= 0x800).view(np.uint8) + (codes >= 0x10000).view(np.uint8)
        widths[codes == 0x110000] = 0
        at = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(widths, out=at[1:])
        buffer = joined.encode()
        starts, ends = at[first], at[end]
        numbers, where = distinct_spans(buffer, starts, ends)
        if len(self.cache) > CACHE:
            self.cache.clear()
        known, found = self.cache, []
        self.bpe = self.model.model
        for s, e in zip(starts[where].tolist(), ends[where].tolist()):
            piece = buffer[s:e]
            ids = known.get(piece)
            if ids is None:
                ids = known[piece] = self._ids_of(piece)
            found.append(ids)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool = np.frombuffer(b"".join(found), np.uint32)
        offsets = np.cumsum(sizes) - sizes
        counts = sizes[numbers]
        before = np.cumsum(counts) - counts
        ids = pool[np.repeat(offsets[numbers] - before, counts) + np.arange(counts.sum())]
        of_text = np.searchsorted(edges + np.arange(len(texts)), first, side="left")
        return ids, np.bincount(of_text, counts, minlength=len(texts)).astype(np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has; null counts as empty."""
        texts = [t or "" for t in texts]
        if not any(s in t for t in texts for s in self.special):
            return self._plain(texts)
        # texts and special tokens in turn; all texts are encoded together
        parts = [self.cut.split(t) for t in texts]
        ids, counts = self._plain([p for row in parts for p in row[::2]])
        edges = np.cumsum(counts)
        marks = np.array([self.special[p] for row in parts for p in row[1::2]], np.uint32)
        plain = np.array([len(row) // 2 + 1 for row in parts], np.int64)
        behind = np.ones(len(edges), bool)  # is a special token behind it?
        behind[np.cumsum(plain) - 1] = False
        return np.insert(ids, edges[behind], marks), np.add.reduceat(counts + behind, np.cumsum(plain) - plain)
