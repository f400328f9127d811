"""Words, tokens and hashes of text, in bulk.

A *word* is a maximal run of Unicode letters and digits after lower-casing, canonical decomposition and removal of
combining marks; a hyphen at the end of a line followed by the rest of the word joins both parts.  The bulk path works
on the code points of a whole Arrow batch with numpy; texts holding a character that does not fold to exactly one base
character (Hangul syllables and the like) are folded one by one first, so both paths agree on every input.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex

def _ranges(cps: list[int]) -> str:
    """The inside of a character class."""
    runs = np.split(np.array(cps), np.flatnonzero(np.diff(cps) != 1) + 1)
    return "".join(f"{re.escape(chr(r[0]))}-{re.escape(chr(r[-1]))}" for r in runs)


_MARKS = regex.compile(r"\p{M}+")
_WORD = re.compile(r"[^\W_]+")  # letters and numbers of all kinds
#: By byte: what ASCII words are made of, and a space for all else.
_SPACED = bytes(c if c < 0x80 and chr(c).isalnum() else 0x20 for c in range(256))
_HYPHEN = regex.compile(r"(?<=[\p{L}\p{N}\p{M}])[-\u2010\u00ad][^\S\r\n\u2028]*(?:\r\n|[\n\r\u2028])[^\S\r\n\u2028]*(?=[\p{L}\p{N}])")

OTHER, WORD, SPACE, MARK = 0, 1, 2, 3


def join_hyphens(text: str) -> str:
    return _HYPHEN.sub("", text)


def fold(text: str) -> str:
    """Lower case, canonical decomposition, no combining marks."""
    low = text.lower()
    return low if low.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", low))


def words(text: str | None) -> list[str]:
    """The words of a text; none for null."""
    folded = fold(join_hyphens(text)) if text else ""
    return folded.encode().translate(_SPACED).decode().split() if folded.isascii() else _WORD.findall(folded)


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: folded character (-1 where it isn't one character), class of the folded one, class as it stands."""
    size = 0x110000
    folded = np.arange(size, dtype=np.int32)
    raw = np.zeros(size, dtype=np.uint8)
    for cp in range(0x30000):  # above: unassigned, tags and private use, which fold to themselves
        ch = chr(cp)
        kind = unicodedata.category(ch)
        raw[cp] = WORD if kind[0] in "LN" else MARK if kind[0] == "M" else SPACE if ch.isspace() else OTHER
        if cp >= 0x80 or 0x41 <= cp <= 0x5A:
            base = [c for c in unicodedata.normalize("NFD", ch.lower()) if unicodedata.category(c)[0] != "M"]
            folded[cp] = ord(base[0]) if len(base) == 1 else -2 if not base else -1
    for cp in range(0x30000, 0x33480):
        if unicodedata.category(chr(cp))[0] == "L":
            raw[cp] = WORD
    cls = np.where(folded >= 0, raw[np.maximum(folded, 0)], np.where(folded == -2, MARK, OTHER)).astype(np.uint8)
    return folded, cls, raw


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points, each text followed by a NUL, and where each text starts (with the total at the end)."""
    full = [t or "" for t in texts]
    lengths = np.fromiter((len(t) + 1 for t in full), dtype=np.int64, count=len(full))
    joined = "\0".join(full) + ("\0" if full else "")
    try:
        data = joined.encode("utf-32-le")
    except UnicodeEncodeError:
        data = joined.encode("utf-32-le", "surrogatepass")
    return np.frombuffer(data, dtype=np.uint32), np.concatenate([[0], np.cumsum(lengths)])


_R = np.random.default_rng(20240501).integers(1, 2**63, size=1 << 16, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n, _P, dtype=np.uint64)]))


@lru_cache(maxsize=1)
def _uneven() -> re.Pattern:
    """Finds a character that folds to more than one base character."""
    return re.compile("[" + _ranges(np.flatnonzero(tables()[0] == -1).tolist()) + "]")


def word_hashes(texts: list[str | None], chunk: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, in order, and for each text the index of its first word (with the total at the end).

    Equal words have equal hashes wherever they stand; null and empty texts have no words.  Texts are taken some
    ``chunk`` characters at a time, so the work arrays stay in the processor's cache.
    """
    uneven, full = _uneven(), []
    for t in texts:
        t = t or ""
        if not t.isascii() and uneven.search(t):
            t = fold(join_hyphens(t))
        elif "-" in t or "\u2010" in t or "\u00ad" in t:
            t = join_hyphens(t)
        full.append(t)
    hashes, counts, held, size = [], [], [], 0
    for t in full:
        held.append(t)
        size += len(t)
        if size >= chunk:
            _hash_chunk(held, hashes, counts)
            held, size = [], 0
    if held:
        _hash_chunk(held, hashes, counts)
    flat = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    return flat, np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64) if counts else np.zeros(1, dtype=np.int64)


def _hash_chunk(texts: list[str], hashes: list[np.ndarray], counts: list[np.ndarray]) -> None:
    folded, cls, _ = tables()
    cps, starts = code_points(texts)
    kind = cls[cps]
    keep = kind != MARK
    if not keep.all():
        starts = np.concatenate([[0], np.cumsum(keep)])[starts]
        cps, kind = cps[keep], kind[keep]
    is_word = kind == WORD
    edge = np.diff(np.concatenate([[0], is_word.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    counts.append(np.diff(np.searchsorted(begin, starts)))
    if not len(begin):
        return
    chars = folded[cps[is_word]]
    sizes = end - begin
    first = np.cumsum(sizes) - sizes
    # the powers restart at each word's first character
    within = np.arange(len(chars)) - np.repeat(first, sizes)
    value = (_R[chars & 0xFFFF] + chars.astype(np.uint64)) * _powers(int(sizes.max()))[within]
    hashes.append(mix(np.add.reduceat(value, first) + sizes.astype(np.uint64)))


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (as if all texts were one; the caller drops those across a border)."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * _P + hashes[k : len(hashes) - n + 1 + k]
    return mix(out)


def token_starts(cps: np.ndarray) -> np.ndarray:
    """True where a token starts: a run of letters and digits, or any other single character that isn't white space.
    NUL, the separator of code_points, starts none."""
    raw = tables()[2][cps]
    is_word = raw == WORD
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    return first | ((raw != WORD) & (raw != SPACE) & (cps != 0))
