"""Function words by language, and a vote on the language of a text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

#: Frequent function words, folded, by language.
FUNCTION_WORDS = {
    "fr": "le la les l un une des du de d et ou au aux en dans sur sous pour par avec sans que qui qu ne pas n est sont a ont ce cette ces se s il elle on nous vous je sa son ses leur leurs tout toute si lorsque quand peut doit devra pourra apres avant lors chez entre mais donc dont",
    "en": "the a an of to in on for with and or that this these those is are was were be been has have had not no by at from as it its their his her must may shall should can will would when who which if after before once both each any all than there do does",
    "de": "der die das den dem des ein eine einen einem einer und oder nicht ist sind war wird werden hat haben mit von zu zum zur im in auf fur bei nach vor wenn als auch nur sich es er sie wie aus uber durch kann muss soll darf dass jeder alle ohne bis zwei um je innerhalb",
    "es": "el la los las un una unos y o a de del al en con por para que no es son ser ha han se su sus lo como mas si cuando tras entre sin sobre este esta estos cada debe puede podra tiene dos pero ya antes segun",
    "it": "il lo gli la le un una di del della dei delle e o che non con per da in nel nella al alla sono si ha hanno quando se dopo prima deve puo come ogni",
    "pt": "o a os as um uma de do da dos das e ou que nao em no na nos nas com por para ao se quando apos antes deve pode sua seu cada sem mais",
    "nl": "de het een en of van te in op voor met niet is zijn wordt door aan bij als na dat die deze moet kan mag elke zonder om naar",
}
_LANGUAGES = {lang: frozenset(ws.split()) for lang, ws in FUNCTION_WORDS.items()}

#: The same words as they are written, where that differs.
ACCENTED = {"fr": "à où après même dès là être très côté", "de": "für über", "es": "él más cómo está podrá también según tú", "it": "è può così però più", "pt": "à é não após também são está", "nl": "één"}
#: Function words folded or not, by language; without a language those of all.
SPELLED = {lang: known | frozenset(ACCENTED.get(lang, "").split()) for lang, known in _LANGUAGES.items()}
SPELLED[None] = frozenset().union(*(SPELLED[x] for x in ("fr", "en", "de", "es")))


_OF_WORD: dict[str, tuple[str, ...]] = {}
for _lang, _known in _LANGUAGES.items():
    for _w in SPELLED[_lang]:
        _OF_WORD[_w] = (*_OF_WORD.get(_w, ()), _lang)


#: Words of one language that another hasn't.
_ONLY = {(a, b): _LANGUAGES[a] - _LANGUAGES[b] for a in _LANGUAGES for b in _LANGUAGES}


def votes(ws: list[str]) -> Counter:
    """For each language how many of the words, folded or in lower case, are among its function words."""
    got: dict[str, int] = {}
    for w, n in Counter(filter(_OF_WORD.__contains__, ws)).items():
        for lang in _OF_WORD[w]:
            got[lang] = got.get(lang, 0) + n
    return Counter(got)


def language(ws: list[str], least: int = 2, ties: bool = False) -> str | None:
    """The language with most function words; null if there are too few or, unless ``ties``, two languages are level
    (else the first of them in the order above)."""
    got = votes(ws)
    best = max((got[x] for x in got), default=0)
    top = [x for x in _LANGUAGES if got[x] == best]
    return top[0] if best >= least and (ties or len(top) == 1) else None


def sure(ws: list[str]) -> tuple[str | None, float]:
    """The language of words whose function words leave no doubt (four votes, and half as many again as any other
    language), and the share of its votes."""
    got = votes(ws).most_common(2)
    if got and got[0][1] >= 4 and (len(got) < 2 or got[0][1] >= 1.5 * got[1][1]):
        return got[0][0], got[0][1] / len(ws)
    return None, 0.0


def trigrams(w: str) -> list[str]:
    s = f" {w} "
    return [s[k : k + 3] for k in range(len(s) - 2)]


#: Share of a text's words that vote for its language, from which trigrams are learned of it.
DENSE = 0.2


class Tally:
    """Counts of words by language, of texts whose language is sure."""

    def __init__(self):
        self._held: dict[tuple[str, bool], Counter] = {}

    def add(self, ws: list[str]) -> None:
        lang, share = sure(ws)
        if lang:
            self._held.setdefault((lang, share >= DENSE), Counter()).update(ws)

    def __len__(self) -> int:
        return sum(map(len, self._held.values()))

    def words(self) -> dict[str, Counter]:
        """Words without those that are digits only, by language."""
        out: dict[str, Counter] = {}
        for (lang, _), held in self._held.items():
            out.setdefault(lang, Counter()).update({w: n for w, n in held.items() if not w.isdecimal()})
        return out

    def trigrams(self) -> dict[str, Counter]:
        """Three letters in a row, by language, of texts of which one word in five votes."""
        out: dict[str, Counter] = {}
        for (lang, dense), held in self._held.items():
            if dense:
                seen = out.setdefault(lang, Counter())
                for w, n in held.items():
                    if w.isalpha():
                        for x in trigrams(w):
                            seen[x] += n
        return out


class Dictionaries:
    """A naive Bayes model over the words of each language, learned from their counts."""

    def __init__(self, counts: dict[str, Counter]):
        # a language of a handful of texts is noise
        self.languages = [x for x in _LANGUAGES if x in counts and counts[x].total() >= 50]
        kept = [counts[x] for x in self.languages]
        every = set().union(*kept)
        totals = [c.total() + 0.1 * len(every) for c in kept]
        # words that are as frequent share their weights
        weights = lru_cache(maxsize=None)(lambda *ns: tuple(math.log((n + 0.1) / total) for n, total in zip(ns, totals)))
        self.weights: dict[str, tuple[float, ...]] = {w: weights(*(c[w] for c in kept)) for w in every}

    def scores(self, ws: list[str]) -> tuple[dict[str, float], int]:
        """Log likelihood of the known words by language, and how many are known."""
        known = [self.weights[w] for w in ws if w in self.weights]
        return dict(zip(self.languages, map(sum, zip(*known)))) if known else {}, len(known)


#: Trigrams of a language must be seen so often, and be so large a share of its trigrams, and so many must be counted, for
#: the model to judge.  The share keeps what is known of a language the same however many texts there are: slips and
#: quoted words come again in a larger corpus.
TRIGRAM_SEEN, TRIGRAM_SHARE, TRIGRAMS_LEARNED = 2, 1e-6, 20_000
#: Share of a text's trigrams that a language doesn't have, from which the text isn't in it.  Texts in a language that was
#: learned stay under 0.07, those in its relatives reach 0.16.
UNSEEN = 0.12


class Letters:
    """Which three letters in a row a language has, learned from their counts."""

    def __init__(self, counts: dict[str, Counter]):
        totals = {lang: c.total() for lang, c in counts.items()}
        self.known = {lang: frozenset(x for x, n in c.items() if n >= max(TRIGRAM_SEEN, TRIGRAM_SHARE * totals[lang])) for lang, c in counts.items() if totals[lang] >= TRIGRAMS_LEARNED}
        self.all = frozenset().union(*self.known.values())

    def unseen(self, ws: list[str], lang: str | None = None) -> float | None:
        """The share of trigrams that the language, or any of them, doesn't have; null if it wasn't learned."""
        known = self.all if lang is None else self.known.get(lang)
        if not known:
            return None
        total = missing = 0
        for w, n in Counter(ws).items():
            if w.isalpha():
                each = trigrams(w)
                total += n * len(each)
                missing += n * sum(x not in known for x in each)
        return missing / total if total else 0.0


#: The letters with marks, and other letters beyond a to z, of each language.
ALPHABETS = {"fr": "àâæçéèêëîïôœùûüÿ", "en": "é", "de": "äöüßé", "es": "áéíñóúü", "it": "àèéìíîòóùú", "pt": "áâãàçéêíóôõúü", "nl": "éèëïóöüá"}


def foreign_letters(text: str, lang: str | None) -> int:
    """How many words hold a Latin letter that the language (or none of those above) doesn't write."""
    own = ALPHABETS[lang] if lang else "".join(ALPHABETS.values())
    return sum(any(c > "\x7f" and c.isalpha() and c not in own and script(c) == "LATIN" for c in w) for w in unicodedata.normalize("NFC", text.lower()).split())


@lru_cache(maxsize=1 << 16)
def script(c: str) -> str:
    """The script of a letter, as its name begins; all of those that write Chinese and Japanese are one."""
    name = unicodedata.name(c, "").split(" ")[0].split("-")[0]
    return "CJK" if name in ("CJK", "HIRAGANA", "KATAKANA", "KANGXI") else name


_BEYOND_LATIN = re.compile(r"[^\W\d_\x00-\u024f\u1e00-\u1eff]")


def main_script(text: str) -> tuple[str | None, float]:
    """The script of most letters, and the share of the letters that is in it."""
    if not _BEYOND_LATIN.search(text):
        return ("LATIN", 1.0) if any(map(str.isalpha, text)) else (None, 0.0)
    got = Counter(map(script, filter(str.isalpha, text))).most_common(1)
    return (got[0][0], got[0][1] / sum(map(str.isalpha, text))) if got else (None, 0.0)


def against(ws: list[str], own: str):
    """For each language but ``own``: how many words only that one has, and how many only ``own`` has."""
    listed = [w for w in ws if w in _OF_WORD]
    for lang in _LANGUAGES:
        if lang != own:
            yield lang, sum(map(_ONLY[lang, own].__contains__, listed)), sum(map(_ONLY[own, lang].__contains__, listed))
