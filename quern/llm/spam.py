"""Keyword-stuffed pages, link lists and product tags.

A text is cut into sentences and lines.  Each gets a kind from its separators, links, prices, hashtags and share of
function words; the threshold of that share is calibrated for each language over the whole corpus.  Lines without
function words count as keywords only if the words they hold together are repeated within the text (share of the most
frequent words and word pairs, duplicate lines).  A language without a word list is told by its
letters: too many of a text's trigrams are in none of the listed languages, whose trigrams are learned from all
texts.  There a sentence is what ends like one and isn't a list, and only the rest can be keywords; where a script has
no spaces between words, only duplicate lines count as repetition.  A text is spam if more than half of its characters stand in links,
tags, product lines and repeated keywords.  Null, empty and blank texts are none.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .languages import SPELLED, UNSEEN, Letters, foreign_letters, main_script, votes
from .learned import TRIGRAM, learn
from .words import fold

#: A sentence is keywords when its share of function words is under this part of its language's mean:
#: for lists with separators, and in texts whose keywords are repeated: just enough, and through and through.
LISTED, REPEATED, ALL_REPEATED = 0.8, 0.7, 0.95
#: The same share for a language of which the corpus holds less than ENOUGH sentences.
DEFAULT_MEAN, ENOUGH = 0.38, 200
#: Keywords are repeated when at most this share of their words is distinct, or the five most frequent make up that much.
DISTINCT, TOP_FIVE, TOP_PAIRS, DOUBLED = 0.45, 0.45, 0.35, 0.4
LEAST_WORDS = 20
SPAM = 0.5
#: The share of function words is kept in so many steps.
STEPS = 20

#: Words of a sentence at least, and words for each comma or other separator in it.
SENTENCE, PER_MARK = 4, 4

_SEGMENT = re.compile(r"[\r\n\v\f\x85\u2028\u2029]+|(?<=[.!?])\s+")
_WIDE_SEGMENT = re.compile(_SEGMENT.pattern + "|(?<=[。！？])")
_ENDS = re.compile(r"[.!?…。！？।؟][\W_]*$")
_SEPARATOR = re.compile(r"[,;|/»·•،、，]| [-–] ")
_NO_SPACES = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_TOKEN = re.compile(r"[^\W\d_]+")
#: A host without a scheme: labels of one case, the last of letters only.
_HOST = r"(?<![\w.@])(?:[a-z0-9][\w-]+\.)+[a-z]{2,24}(?![\w.]*\w)(?:/\S*)?|(?<![\w.@])(?:[A-Z0-9][\w-]+\.)+[A-Z]{2,24}(?![\w.]*\w)(?:/\S*)?"
_LINK = re.compile(r"[a-z]+://|www\.|\]\(|<a\s|<A\s|[A-Z]+://|WWW\.|" + _HOST)
_LINK_TEXT = re.compile(r"\[[^\]]*\]\([^)]*\)|[A-Za-z]+://\S+|[Ww]{3}\.\S+|" + _HOST)
_PRICE = re.compile(r"\d\s*(?:€|EUR\b|\$|£)|[€$£]\s*\d")
_TAG = re.compile(r"(?<!\w)#\w+")
_TABLE = re.compile(r"^\s*\|.*\|\s*$|^[\s|:+-]+$")
_MOVE = re.compile(r"(?:\d+\.+\s*)?(?:[KQRBNTFCDRPSL]?[a-h]?[1-8]?x?[a-h][1-8](?:=?[QRBNDTFC])?[+#!?]*|[KQRBNTFCDSL][a-h1-8]?x?[a-h]?[1-8]?[+#]?|O-O(?:-O)?|0-0(?:-0)?|1-0|0-1|½[-–]½)")
PROSE, KEYWORDS, LINKS, PRODUCTS, TAGS, NEUTRAL = range(6)


_DOTTED = re.compile(r"\.[^\W\d_]")
#: What leads to the page numbers of a table of contents.
LEADERS = ("....", ". . .", "……", "····", "____")
_DIGIT = re.compile(r"\d")
#: Headings of lists of tags.
_TAG_LIST = re.compile(r"^\W*(?:hash)?(?:tags?|mots[- ]cl[ée]s|étiquettes|keywords?|labels?|schlagw[öo]rter|stichw[öo]rter|etiquetas|palabras clave|parole chiave|etichette|palavras-chave|trefwoorden|tagi|słowa kluczowe|теги|ключевые слова|标签|关键词)\s*[:：]", re.I)


def _kind(part: str, n: int, own: int) -> int:
    """The kind of a segment of n words, of which ``own`` are function words."""
    if not n or "|" in part and _TABLE.match(part) or any(map(part.__contains__, LEADERS)):
        return NEUTRAL
    if ("." in part[:-1] and _DOTTED.search(part) or "](" in part or "://" in part) and _LINK.search(part) and (n < 6 or 2 * sum(map(len, _LINK_TEXT.findall(part))) >= len(part)):
        return LINKS
    if 5 * own >= 2 * n:
        return PROSE
    marks = part.count(",") + part.count(";") + part.count("|") + part.count("/") + part.count("»") + part.count("·") + part.count("•") + part.count(" - ") + part.count(" – ")
    if marks >= 8 and n <= 4 * marks and not _DIGIT.search(part):
        return KEYWORDS
    if 3 * own >= n:
        return PROSE
    if "#" in part and len(tags := _TAG.findall(part)) >= 2 and 2 * sum(map(len, tags)) >= len(part):
        return TAGS
    if _TAG_LIST.match(part):
        return TAGS
    if 5 * own < n and _DIGIT.search(part):
        if _PRICE.search(part):
            return PRODUCTS
        pieces = part.split()
        if 3 * sum(_MOVE.fullmatch(w) is not None for w in pieces) >= 2 * len(pieces):
            return NEUTRAL
    return KEYWORDS if marks >= 8 and n <= 4 * marks else PROSE


def is_listed(ws: list[str], lang: str | None, letters: Letters | None) -> bool:
    """Whether the words are of one of the languages with a word list, of which ``lang`` is the likeliest."""
    unseen = letters.unseen(fold(" ".join(ws)).split()) if letters else None
    if unseen is not None:
        return unseen < UNSEEN
    # nothing was learned: the script and the letters with marks
    return main_script("".join(ws))[0] == "LATIN" and foreign_letters(" ".join(ws), lang) < 0.05 * len(ws)


def segments(text: str, letters: Letters | None = None) -> tuple[str | None, list[tuple[int, int, int, int]], float]:
    """The language, for each segment (kind, characters, words, share of function words in steps), and how repeated the
    words of the possible keywords are, from 0 to 1 (0.5: enough).

    Numbers aren't words here."""
    # a decomposed accent would cut its word in two: "de" and "partage"
    unspaced = not text.isascii() and len(_NO_SPACES.findall(text))
    parts = [p for x in (_WIDE_SEGMENT if unspaced else _SEGMENT).split(unicodedata.normalize("NFC", text)) if (p := x.strip())]
    tokens = [_TOKEN.findall(p.lower()) for p in parts]
    best = votes([w for ws in tokens for w in ws]).most_common(1)
    lang = best[0][0] if best and best[0][1] >= 3 else None
    known = SPELLED[lang]
    owns = [sum(map(known.__contains__, ws)) for ws in tokens]
    dense = unspaced and 2 * unspaced >= sum(len(w) for ws in tokens for w in ws)
    found = _judge(parts, tokens, owns, known, dense, True)
    suspect = found[1] >= 0.5 or any(k == KEYWORDS for k, *_ in found[0])
    if suspect and not is_listed([w for ws in tokens for w in ws], lang, letters):
        found = _judge(parts, tokens, owns, known, dense, False)
    return lang, *found


def _judge(parts: list[str], tokens: list[list[str]], owns: list[int], known: frozenset, dense: bool, listed: bool) -> tuple[list[tuple[int, int, int, int]], float]:
    """The segments and how repeated their words are.  ``listed``: the text's language has a word list; ``dense``: its
    script has no spaces."""
    out, held, lines = [], [], Counter()
    for part, ws, own in zip(parts, tokens, owns):
        n = len(ws)
        kind = _kind(part, n, own)
        if not listed and kind in (PROSE, KEYWORDS) and _ENDS.search(part) and (dense or n >= SENTENCE and n >= PER_MARK * len(_SEPARATOR.findall(part))):
            # how many of a sentence's words are function words there isn't known
            kind = NEUTRAL
        out.append((kind, len(part) - part.count(" "), n, STEPS * own // n if n else 0))
        if (kind == PROSE or kind == KEYWORDS) and 3 * own < n:
            held.append(ws)
            lines[" ".join(ws)] += 1
    repeated = 0.0
    if held:
        pool, pairs = Counter(), Counter()
        for ws in held:
            content = [w for w in ws if w not in known]
            pool.update(content)
            pairs.update(zip(content, content[1:]))
        total, of_pairs = pool.total(), pairs.total()
        if total >= LEAST_WORDS:
            few = 1 if total >= 3 * LEAST_WORDS else 0.66
            top = sum(c for _, c in pool.most_common(5)) / total
            top_pairs = sum(c for _, c in pairs.most_common(5)) / of_pairs if of_pairs >= LEAST_WORDS else 0
            doubled = 1 - len(lines) / lines.total() if lines.total() >= 8 else 0
            if dense:
                few = top_pairs = top = 0
            repeated = min(1.0, 0.5 * max(few * DISTINCT * total / len(pool), few * top / TOP_FIVE, few * top_pairs / TOP_PAIRS, doubled / DOUBLED))
    return out, repeated


def _measure(letters):
    names = ["key", "lang", "repeated", "kind", "chars", "words", "step"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text or text.isspace():
                    continue
                lang, found, repeated = segments(text, letters.value)
                # segments of a kind and step are added up: a text has a few such groups, however long it is
                groups: Counter = Counter()
                count: Counter = Counter()
                for kind, size, n, step in found:
                    groups[kind, step] += size
                    count[kind, step] += n
                ks = sorted(groups)
                rows.append((key, lang, repeated, [k for k, _ in ks], [groups[k] for k in ks], [count[k] for k in ks], [s for _, s in ks]))
            columns = list(zip(*rows)) if rows else [[]] * 7
            many = pa.list_(pa.int32())
            types = [batch.schema.field(0).type, pa.string(), pa.float64(), many, many, many, many]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


def spam_pages(df: DataFrame, key: str, text: str, checkpoint=lambda x: x) -> DataFrame:
    """``key`` and ``spam_share`` of the texts of which more than half is spam.

    ``checkpoint`` cuts the lineage of the measured segments, which are read twice: once for the calibration."""
    kind = df.schema[key].dataType.simpleString()
    given = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    letters = df.sparkSession.sparkContext.broadcast(Letters(*learn(given.select("text"), TRIGRAM)))
    measured = given.mapInArrow(_measure(letters), f"key {kind}, lang string, repeated double, kind array<int>, chars array<int>, words array<int>, step array<int>")
    measured = checkpoint(measured)
    # the mean share of function words over what reads like sentences, by language: one row for each, so a broadcast
    groups = F.filter(F.arrays_zip("kind", "words", "step"), lambda g: (g["kind"] == PROSE) & (g["step"] >= STEPS // 10))
    total = lambda f: F.aggregate(groups, F.lit(0).cast("long"), lambda x, g: x + f(g))
    means = (
        measured.where("lang is not null")
        .select("lang", total(lambda g: g["step"] * g["words"]).alias("known"), total(lambda g: g["words"]).alias("n"))
        .groupBy("lang")
        .agg((F.sum("known") / F.sum("n") / STEPS).alias("mean"), F.sum("n").alias("n"))
        .select("lang", F.when(F.col("n") >= ENOUGH, F.col("mean")).alias("mean"))
    )
    mean = F.coalesce("mean", F.lit(DEFAULT_MEAN)) * STEPS
    part = REPEATED + (ALL_REPEATED - REPEATED) * (2 * F.col("repeated") - 1)

    def is_spam(g: F.Column) -> F.Column:
        keywords = g["kind"].isin(PROSE, KEYWORDS) & (g["step"] < part * mean) & (F.col("repeated") >= 0.5)
        return g["kind"].isin(LINKS, PRODUCTS, TAGS) | (g["kind"] == KEYWORDS) & (g["step"] < LISTED * mean) | keywords

    each = F.arrays_zip("kind", "chars", "step")
    spam = F.aggregate(each, F.lit(0).cast("long"), lambda x, g: x + F.when(is_spam(g), g["chars"]).otherwise(0))
    chars = F.aggregate("chars", F.lit(0).cast("long"), lambda x, n: x + n)
    judged = measured.join(F.broadcast(means), "lang", "left").select("key", (spam / chars).alias("spam_share"))
    return judged.where(F.col("spam_share") > SPAM).distinct().withColumnRenamed("key", key)
