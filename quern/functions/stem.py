"""French stems by the published Snowball algorithm, and other text functions that need Python: Arrow UDFs.

Stem distinct words, not texts: the vocabulary is far smaller.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiouyâàëéêèïîôûù"

#: The suffixes of each step of the algorithm, by what happens to them.
STANDARD = {
    "delete": "ance iqUe isme able iste eux ances iqUes ismes ables istes",
    "ic": "atrice ateur ation atrices ateurs ations",
    "log": "logie logies",
    "u": "usion ution usions utions",
    "ent": "ence ences",
    "ement": "ement ements",
    "ite": "ité ités",
    "if": "if ive ifs ives",
    "eaux": "eaux",
    "aux": "aux",
    "euse": "euse euses",
    "issement": "issement issements",
    "amment": "amment",
    "emment": "emment",
    "ment": "ment ments",
}
I_VERBS = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it"
E_VERBS = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez"
A_VERBS = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions"
BY_LENGTH = {k: sorted(v.split(), key=len, reverse=True) for k, v in {"i": I_VERBS, "e": E_VERBS, "a": A_VERBS, "ions": "ions"}.items()}
SUFFIXES = sorted(((s, k) for k, v in STANDARD.items() for s in v.split()), key=lambda x: -len(x[0]))


def _regions(w: str) -> tuple[int, int, int]:
    """Starts of RV, R1 and R2."""
    rv = len(w)
    if len(w) >= 3 and (w[0] in VOWELS and w[1] in VOWELS or w[:3] in ("par", "col", "tap")):
        rv = 3
    else:
        for k in range(1, len(w)):
            if w[k] in VOWELS:
                rv = k + 1
                break

    def after(start: int) -> int:
        for k in range(start + 1, len(w)):
            if w[k] not in VOWELS and w[k - 1] in VOWELS:
                return k + 1
        return len(w)

    r1 = after(0)
    return rv, r1, after(r1) if r1 < len(w) else len(w)


def _mark(w: str) -> str:
    """Vowels that act as consonants, in upper case."""
    w = re.sub(f"(?<=[{VOWELS}])u(?=[{VOWELS}])", "U", w)
    w = re.sub(f"(?<=[{VOWELS}])i(?=[{VOWELS}])", "I", w)
    w = re.sub(f"(?<=[{VOWELS}])y|y(?=[{VOWELS}])", "Y", w)
    return re.sub("(?<=q)u", "U", w)


def _standard(w: str, rv: int, r1: int, r2: int) -> tuple[str, bool, bool]:
    """After the first step: the word, whether it changed, and whether the verb steps must follow anyway."""
    for suffix, kind in SUFFIXES:
        if not w.endswith(suffix):
            continue
        at = len(w) - len(suffix)
        stem = w[:at]
        in_rv, in_r1, in_r2 = at >= rv, at >= r1, at >= r2
        if kind == "delete":
            return (stem, True, False) if in_r2 else (w, False, True)
        if kind == "ic":
            if not in_r2:
                return w, False, True
            if stem.endswith("ic"):
                stem = stem[:-2] if len(stem) - 2 >= r2 else stem[:-2] + "iqU"
            return stem, True, False
        if kind in ("log", "u", "ent"):
            return (stem + {"log": "log", "u": "u", "ent": "ent"}[kind], True, False) if in_r2 else (w, False, True)
        if kind == "ement":
            if not in_rv:
                return w, False, True
            if stem.endswith("iv") and len(stem) - 2 >= r2:
                stem = stem[:-2]
                if stem.endswith("at") and len(stem) - 2 >= r2:
                    stem = stem[:-2]
            elif stem.endswith("eus"):
                if len(stem) - 3 >= r2:
                    stem = stem[:-3]
                elif len(stem) - 3 >= r1:
                    stem = stem[:-3] + "eux"
            elif stem.endswith(("abl", "iqU")) and len(stem) - 3 >= r2:
                stem = stem[:-3]
            elif stem.endswith(("ièr", "Ièr")) and len(stem) - 3 >= rv:
                stem = stem[:-3] + "i"
            return stem, True, False
        if kind == "ite":
            if not in_r2:
                return w, False, True
            if stem.endswith("abil"):
                stem = stem[:-4] if len(stem) - 4 >= r2 else stem[:-4] + "abl"
            elif stem.endswith("ic"):
                stem = stem[:-2] if len(stem) - 2 >= r2 else stem[:-2] + "iqU"
            elif stem.endswith("iv") and len(stem) - 2 >= r2:
                stem = stem[:-2]
            return stem, True, False
        if kind == "if":
            if not in_r2:
                return w, False, True
            if stem.endswith("at") and len(stem) - 2 >= r2:
                stem = stem[:-2]
                if stem.endswith("ic"):
                    stem = stem[:-2] if len(stem) - 2 >= r2 else stem[:-2] + "iqU"
            return stem, True, False
        if kind == "eaux":
            return w[:-1], True, False
        if kind == "aux":
            return (stem + "al", True, False) if in_r1 else (w, False, True)
        if kind == "euse":
            return (stem, True, False) if in_r2 else (stem + "eux", True, False) if in_r1 else (w, False, True)
        if kind == "issement":
            return (stem, True, False) if in_r1 and stem and stem[-1] not in VOWELS else (w, False, True)
        if kind in ("amment", "emment"):
            return (stem + {"amment": "ant", "emment": "ent"}[kind], True, True) if in_rv else (w, False, True)
        return (stem, True, True) if stem and stem[-1] in VOWELS and len(stem) - 1 >= rv else (w, False, True)
    return w, False, True


def _verbs(w: str, rv: int, r2: int) -> tuple[str, bool]:
    for suffix in BY_LENGTH["i"]:
        if w.endswith(suffix) and len(w) - len(suffix) >= rv:
            at = len(w) - len(suffix)
            if at - 1 >= rv and w[at - 1] not in VOWELS:
                return w[:at], True
            break
    candidates = sorted(((s, k) for k in ("e", "a", "ions") for s in BY_LENGTH[k]), key=lambda x: -len(x[0]))
    for suffix, kind in candidates:
        at = len(w) - len(suffix)
        if w.endswith(suffix) and at >= rv:
            if kind == "ions":
                return (w[:at], True) if at >= r2 else (w, False)
            if kind == "a" and w[:at].endswith("e") and at - 1 >= rv:
                return w[: at - 1], True
            return w[:at], True
    return w, False


@lru_cache(maxsize=500_000)
def stem_word(word: str) -> str:
    """The French stem of a word; what is made of digits and signs only stays as it is."""
    w = word.lower()
    if not re.search(r"[^\d.,/:\-]", w):
        return w
    w = _mark(w)
    rv, r1, r2 = _regions(w)
    w, changed, go_on = _standard(w, rv, r1, r2)
    if go_on:
        w, verb = _verbs(w, rv, r2)
        changed = changed or verb
    if changed:
        w = w[:-1] + "i" if w.endswith("Y") else w[:-1] + "c" if w.endswith("ç") else w
    else:
        if w.endswith("s") and len(w) > 1 and w[-2] not in "aiouès":
            w = w[:-1]
        if w.endswith("ion") and len(w) - 3 >= max(r2, rv) and len(w) > 3 and w[-4] in "st" and len(w) - 4 >= rv:
            w = w[:-3]
        elif w.endswith(("ier", "ière", "Ier", "Ière")):
            n = 3 if w.endswith(("ier", "Ier")) else 4
            if len(w) - n >= rv:
                w = w[:-n] + "i"
        elif w.endswith("e") and len(w) - 1 >= rv:
            w = w[:-1]
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    return re.sub(f"[éè](?=[^{VOWELS}]+$)", "e", w).replace("I", "i").replace("U", "u").replace("Y", "y")


def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else stem_word(w))


def stem(c: Column) -> Column:
    """The stem of a word; null for null."""

    @F.pandas_udf("string")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for words in batches:
            yield _stems(words)

    return udf(c)


def stem_words(c: Column) -> Column:
    """The stems of an array of words; null for null.  Each distinct word of a batch is stemmed once."""

    @F.arrow_udf("array<string>")
    def udf(lists: pa.Array) -> pa.Array:
        coded = lists.flatten().dictionary_encode()
        stems = pa.array([None if w is None else stem_word(w) for w in coded.dictionary.to_pylist()], pa.string())
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), stems.take(coded.indices), mask=lists.is_null())

    return udf(c)


def heaviest(weights: Mapping[str, float], by: Callable[[str], str] = stem_word) -> dict[str, float]:
    """Stem -> the largest weight of the words that have it."""
    out: dict[str, float] = {}
    for word, weight in weights.items():
        out[by(word)] = max(weight, out.get(by(word), weight))
    return out


def normalize(c: Column, form: str = "NFKC") -> Column:
    """Unicode normal form, without control characters, with white space collapsed; null for null."""

    @F.pandas_udf("string")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else re.sub(r"\s+", " ", re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", unicodedata.normalize(form, t))).strip())

    return udf(c)


#: UTF-8 read as Latin-1, and what it was.
MOJIBAKE = {"Ã©": "é", "Ã¨": "è", "Ãª": "ê", "Ã«": "ë", "Ã ": "à", "Ã¢": "â", "Ã®": "î", "Ã¯": "ï", "Ã´": "ô", "Ã¹": "ù", "Ã»": "û", "Ã§": "ç", "â€™": "’", "â€œ": "“", "â€“": "–"}


def repair(c: Column) -> Column:
    """Undoes common mojibake."""
    for bad, good in MOJIBAKE.items():
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c
