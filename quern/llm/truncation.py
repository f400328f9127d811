"""Text cut off by field limits.

A value counts as cut when its end can't be the end of a sentence.  The evidence comes from the corpus itself, gathered
as counts over all values and joined back to each value's last words, so no table is held in one place:

* a trie of the corpus vocabulary, as counts of every proper prefix: the last token is no known word, but begins some;
* the same trie within a context: after these two words the corpus has only longer words that begin like the last one;
* terminal contexts: how often sentences end after the last three (two, one) words, and how often they go on;
* length: values of this source and field pile up at exactly this length;
* what stands last: half a character, an opening mark, a comma, a hyphen or a bracket that isn't closed.

Texts are read in bulk, as arrays of code points; words and contexts are 64-bit hashes of kinds and folded words, which only
ever are counted and compared.  All counts of contexts are one table by hash; each distinct end of a value asks it once for
every length of context, and values then take the answer of their end.  Numbers and names, which stand in as kinds in
very many contexts, are spread over several keys of that join, and so are ends that very many values share.

Numbers and names are counted by kind.  Values of fewer than ``MIN_WORDS`` words are judged by the vocabulary and by
what stands last only; null, empty and blank ones are never cut.  Repeated rows count once, by key.  A value that ends in
a full stop, question mark or closing bracket is cut only by stricter bounds: its last word is none that the corpus has,
or one that hardly ever ends a sentence.  Values without a source share the limit of their kind.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W

MIN_WORDS = 4
#: Share of endings under which a context counts as one where sentences go on.
GOES_ON = 0.05
#: The same for values whose length is the limit of their source.
GOES_ON_AT_LIMIT = 0.5
#: A length is a limit if it is the longest, or nearly, and this many times as frequent as its neighbours.
PILE_UP = 3
LEAST_LIMIT = 40
#: For values that end in a full stop or closing mark: how often the corpus has longer words, and a
#: word that is seen so often and has at most this share of sentences end after it.
CLOSED_BEGINS, CLOSED_SEEN, CLOSED_ENDS = 5, 2000, 0.001
#: Keys over which a kind of word is spread, and rows of one end from which it is spread.
SPREAD, HOT = 32, 100_000
#: Characters of text that are read at a time.
CHUNK = 4 << 20
#: A bracket that is opened so near to the end, and not closed, was cut.
BRACKETS, OPEN_WITHIN = ("()", "[]", "«»"), 24

_ELLIPSIS = regex.compile(r"(?:\s*(?:[\[(]\s*)?(?:…|\.\.\.+)(?:\s*[\])])?)+$")
#: A note that the value was cut; it stands for an ellipsis.
_NOTE = regex.compile(r"\s*[\[(<]\s*(?:coup[ée]e?|tronqu[ée]e?|cut|truncated|abgeschnitten|gekürzt|cortado|truncado)\s*[\])>]\s*$", regex.I)
_STRONG = regex.compile(r"[.!?。؟][\s\"'»”’)\]*_]*$")
_SOFT = regex.compile(r"[;:)\]»”*_][\s*_]*$")
_END_GAP = regex.compile(r"^[\"'»”’)\]*_]*\s*[.!?;](?!\.)[\"'»”’)\]*_]*(?:\s|$)|^[\"'»”’)\]*_]*[^\S\n]*\n")
ENDS, GOES, UNSURE = 1, 0, 2


@lru_cache(maxsize=50_000)
def _gap(gap: str) -> int:
    if gap in (" ", "'", "’", "-"):
        return GOES
    if _ELLIPSIS.search(gap.rstrip()):
        return UNSURE
    return ENDS if _END_GAP.match(gap) else GOES


@lru_cache(maxsize=50_000)
def _mark(rest: str) -> str:
    bare = rest.strip()
    if not bare:
        return "space" if rest else "none"
    for name, pattern in (("ellipsis", _ELLIPSIS), ("strong", _STRONG), ("soft", _SOFT)):
        if pattern.search(bare):
            return name
    return "open"


NUMBER, NAME, BEGIN = (np.uint64(W.mix(np.array([k], dtype=np.uint64))[0]) for k in (101, 102, 103))


@lru_cache(maxsize=1)
def _first_letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: is it a digit, is it a capital."""
    digit, upper = np.zeros(0x110000, dtype=bool), np.zeros(0x110000, dtype=bool)
    for cp in range(0x20000):
        digit[cp], upper[cp] = chr(cp).isdigit(), chr(cp).isupper()
    return digit, upper


def _key(*parts: np.ndarray | np.uint64) -> np.ndarray:
    out = np.uint64(0)
    for part in parts:
        out = W.mix((out ^ part) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return out


class Reading:
    """Words of a batch of texts, as arrays over all words: ``row`` (the text), ``shape`` (hash of what stands for the word),
    ``plain`` (index of its folded form in ``forms``), ``a`` and ``b`` (shapes of two words of context), ``follows``
    (ENDS, GOES, UNSURE), ``last`` (of its text); and by text ``count`` of words and ``mark`` at the end."""

    def __init__(self, texts: Sequence[str]):
        folded, cls, _ = W.tables()
        digit, upper = _first_letters()
        # accents would only get in the way: all places are those of the text without them
        cps, starts = W.code_points([_NOTE.sub("…", t) if t[-1:] in ")]> \n" else t for t in texts])
        keep = cls[cps] != W.MARK
        starts = np.concatenate([[0], np.cumsum(keep)])[starts]
        cps = cps[keep]
        text = cps.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        is_word = cls[cps] == W.WORD
        edge = np.diff(np.concatenate([[0], is_word.view(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        n = len(begin)
        self.count = np.diff(np.searchsorted(begin, starts))
        self.row = np.repeat(np.arange(len(texts)), self.count)
        self.last = np.zeros(n, dtype=bool)
        self.last[np.cumsum(self.count)[self.count > 0] - 1] = True
        initial = np.concatenate([[True], self.last[:-1]]) if n else self.last
        # the folded words, each once
        low = np.where(folded[cps] >= 0, folded[cps], cps)
        sizes = end - begin
        chars = low[is_word].astype(np.uint64)
        first = np.cumsum(sizes) - sizes
        within = np.arange(len(chars)) - np.repeat(first, sizes)
        hashes = W.mix(np.add.reduceat(W.mix(chars + np.uint64(7)) * W._powers(int(sizes.max(initial=1)))[within], first) + sizes.astype(np.uint64)) if n else np.zeros(0, dtype=np.uint64)
        number = digit[cps[begin]]
        _, at, self.plain = np.unique(hashes, return_index=True, return_inverse=True)
        lower = low.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        self.forms = [lower[begin[k] : end[k]] for k in at.tolist()]
        self.number = number
        opening = np.where(number, NUMBER, hashes)
        within_sentence = np.where(~number & upper[cps[begin]], NAME, opening)
        # what stands between words: mostly one character
        self.follows = np.full(n, UNSURE, dtype=np.int8)
        inner = np.flatnonzero(~self.last)
        stop = begin[inner + 1] if len(inner) else inner
        single = stop - end[inner] == 1
        joint = np.isin(cps[end[inner]], [ord(c) for c in " '’-"]) if len(inner) else single
        self.follows[inner[single & joint]] = GOES
        rest = np.flatnonzero(~(single & joint))
        self.follows[inner[rest]] = [_gap(text[i:j]) for i, j in zip(end[inner[rest]].tolist(), stop[rest].tolist())]
        starting = initial.copy()
        starting[1:] |= self.follows[:-1] == ENDS
        self.shape = np.where(starting, opening, within_sentence)
        self.kind_of_word = self.shape != hashes
        back = lambda x, k: np.concatenate([np.full(min(k, n), BEGIN), x[: n - k]]) if n else x
        start_before = np.concatenate([[True], starting[:-1]]) if n else starting
        self.b = np.where(starting, BEGIN, back(self.shape, 1))
        self.a = np.where(starting, np.where(initial, BEGIN, back(self.shape, 1)), np.where(start_before, BEGIN, back(self.shape, 2)))
        ends = np.concatenate([end[self.last], np.zeros(0, dtype=np.int64)])
        self.mark = np.full(len(texts), "none", dtype=object)
        full = np.flatnonzero(self.count)
        self.mark[full] = [_mark(text[i:j]) for i, j in zip(ends.tolist(), (starts[full + 1] - 1).tolist())]


def _is_open(rest: str) -> bool:
    """Ends in what opens something or needs more."""
    return rest[-1:] in tuple(",«([{<-‐–'’/&+=") or rest[-1:] == '"' and rest.count('"') % 2 == 1 or any(rest.rfind(a, -OPEN_WITHIN) > rest.rfind(b) for a, b in BRACKETS)


#: Rows of counts (kind of row 0), words of the vocabulary (1) and ends of values (2).
_FIELDS = "row tinyint, kind string, source string, length int, short boolean, mark string, broken boolean, opening boolean, three long, two long, one long, here long, spread boolean, word string, plain string, marked long, unmarked long, goes long"


def _read(kinds: frozenset[str] | None):
    names = ["key", *(f.split()[0] for f in _FIELDS.split(", "))]
    types = {"tinyint": pa.int8(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "long": pa.int64()}

    def rows(n: int, key: pa.Array, **given) -> pa.RecordBatch:
        columns = [key]
        for f in _FIELDS.split(", "):
            name, kind = f.split()
            value = given.get(name)
            if value is None:
                column = pa.nulls(n, types[kind])
            elif isinstance(value, np.ndarray) and value.dtype == np.uint64:
                column = pa.array(value.view(np.int64))
            else:
                column = value if isinstance(value, (pa.Array, pa.ChunkedArray)) else pa.array(value, types[kind])
            columns.append(column.cast(types[kind]))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def process(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column("text").to_pylist()
        r = Reading(texts)
        kind_names, kind_of = np.unique(np.array(batch.column("kind").to_pylist(), dtype=object).astype(str), return_inverse=True)
        hashes, _ = W.word_hashes(["x" + k.encode().hex() for k in kind_names])
        kind = hashes[kind_of][r.row]
        one, two, three, here = _key(kind, r.shape), _key(kind, r.b, r.shape), _key(kind, r.a, r.b, r.shape), _key(kind, r.a, r.b)
        # shapes as words, for the tries
        forms = np.array([*r.forms, "#N", "#C"], dtype=object)
        shape_at = np.where(r.kind_of_word, np.where(r.shape == NUMBER, len(forms) - 2, len(forms) - 1), r.plain)
        plain_at = np.where(r.number, len(forms) - 2, r.plain)
        words = pa.array(forms, pa.string())
        none = lambda n: pa.nulls(n, batch.column("key").type)
        counted = batch.column("counted").to_numpy(zero_copy_only=False)[r.row]
        whole = np.isin(r.mark, ("strong", "soft"))[r.row]
        bare = (r.mark == "none")[r.row]
        known = counted & (~r.last | whole)
        seen = np.bincount(plain_at[known], minlength=len(forms))
        at = np.flatnonzero(seen)
        yield rows(len(at), none(len(at)), row=np.full(len(at), 1, dtype=np.int8), plain=words.take(pa.array(at)), marked=seen[at])
        asked = np.ones(len(kind_names), dtype=bool) if kinds is None else np.isin(kind_names, list(kinds))
        marked = np.where(r.last, whole, r.follows == ENDS)
        unmarked, goes = r.last & bare, ~r.last & (r.follows == GOES)
        use = np.flatnonzero(counted & asked[kind_of][r.row] & (marked | unmarked | goes))
        _, first, own = np.unique(three[use], return_index=True, return_inverse=True)
        at = use[first]
        sums = {c: np.bincount(own, weights=x[use], minlength=len(at)).astype(np.int64) for c, x in (("marked", marked), ("unmarked", unmarked), ("goes", goes))}
        yield rows(len(at), none(len(at)), row=np.zeros(len(at), dtype=np.int8), three=three[at], two=two[at], one=one[at], here=here[at], spread=r.kind_of_word[at], word=words.take(pa.array(shape_at[at])), **sums)
        ended = np.flatnonzero(r.last & batch.column("judged").to_numpy(zero_copy_only=False)[r.row])
        owner = r.row[ended]
        bare_ends = [texts[k].rstrip() for k in owner.tolist()]
        yield rows(
            len(ended),
            batch.column("key").take(pa.array(owner)),
            row=np.full(len(ended), 2, dtype=np.int8),
            kind=batch.column("kind").take(pa.array(owner)),
            source=batch.column("source").take(pa.array(owner)),
            length=[len(texts[k]) for k in owner.tolist()],
            short=r.count[owner] < MIN_WORDS,
            mark=r.mark[owner],
            broken=[t.endswith("\ufffd") for t in bare_ends],
            opening=[_is_open(t) for t in bare_ends],
            three=three[ended],
            two=two[ended],
            one=one[ended],
            here=here[ended],
            spread=r.kind_of_word[ended],
            word=words.take(pa.array(shape_at[ended])),
            plain=words.take(pa.array(plain_at[ended])),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            # several batches at a time, so that more is added up here, and few rows of long texts
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, 64):
                held.append(batch.slice(at, 64))
                size += int(lengths[at : at + 64].sum())
                if size >= CHUNK:
                    yield from process(pa.concat_batches(held))
                    held, size = [], 0
        if held:
            yield from process(pa.concat_batches(held))

    return run


def _prefixes(word: str) -> F.Column:
    """All proper prefixes; none for kinds such as #N."""
    w = F.col(word)
    return F.explode(F.when((F.length(w) > 1) & ~w.startswith("#"), F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda n: F.substring(w, F.lit(1), n))))


def _own_salt(spread: F.Column, by: F.Column) -> F.Column:
    return F.when(spread, F.pmod(F.xxhash64(by), F.lit(SPREAD))).otherwise(0).cast("int")


def _all_salts(spread: F.Column) -> F.Column:
    return F.explode(F.when(spread, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0))))


#: The signs by which values are found, in the order in which they are listed.
SIGNS = ("broken", "opening", "trie", "trie_here", "goes_on", "limit", "spaced", "closed_trie", "closed_never")


def cut_values(values: DataFrame, corpus: DataFrame | None = None, checkpoint=lambda df: df, kinds: Sequence[str] | None = None, hot: int = HOT) -> DataFrame:
    """The values that were cut.

    ``values``: key, kind, source, text, with distinct keys; ``corpus``: kind, text.  Statistics are those of ``corpus``
    by kind (the rows of ``values`` belong in it).  Without a ``corpus``, ``values`` is read once for both, and rows of a
    null key only add to the statistics.  ``kinds``: those that values have; contexts of others aren't counted.
    Returns key, kind, source, length, mark, the evidence, and the ``signs`` that hold.  ``checkpoint`` cuts the lineage of
    what was read, which is used once for each kind of evidence."""
    given = values.where("length(text) > 0")
    if corpus is None:
        given = given.select("key", "kind", "source", "text", F.lit(True).alias("counted"), F.col("key").isNotNull().alias("judged"))
    else:
        nothing = F.lit(None).cast(values.schema["key"].dataType)
        given = given.select("key", "kind", "source", "text", F.lit(False).alias("counted"), F.lit(True).alias("judged")).unionByName(corpus.where("length(text) > 0").select(nothing.alias("key"), "kind", F.lit(None).cast("string").alias("source"), "text", F.lit(True).alias("counted"), F.lit(False).alias("judged")))
    kind = values.schema["key"].dataType.simpleString()
    read = checkpoint(given.withColumn("kind", F.coalesce("kind", F.lit(""))).mapInArrow(_read(None if kinds is None else frozenset(kinds)), f"key {kind}, {_FIELDS}"))
    counts = read.where("row = 0").select("three", "two", "one", "here", "spread", "word", "marked", "unmarked", "goes")
    ended = read.where("row = 2").withColumn("origin", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))

    # the distinct ends, each of which asks once
    asks = ended.groupBy("three", "plain").agg(*(F.first(c).alias(c) for c in ("two", "one", "here", "spread", "word")), F.count("*").alias("values"))
    asks = asks.withColumn("ask", F.xxhash64("three", "plain"))

    # how often sentences end after each context, and how often they go on; contexts of three lengths are one table
    levels = lambda: F.explode(F.array(*(F.struct(F.lit(n).cast("tinyint").alias("level"), F.col(c).alias("context"), (F.col("spread") & F.lit(n < 3)).alias("wide")) for n, c in ((3, "three"), (2, "two"), (1, "one"))))).alias("x")
    totals = counts.select(levels(), "marked", "unmarked", "goes").groupBy("x.level", "x.context").agg(F.bool_or("x.wide").alias("wide"), F.sum("marked").alias("m"), F.sum("unmarked").alias("u"), F.sum("goes").alias("g"))
    totals = totals.withColumn("salt", _all_salts(F.col("wide"))).drop("wide")
    wanted = asks.select("ask", levels()).select("ask", "x.*").withColumn("salt", _own_salt(F.col("wide"), F.col("ask"))).drop("wide")
    found = wanted.join(totals, ["level", "context", "salt"])
    ends = found.groupBy("ask").agg(*(F.sum(F.when(F.col("level") == n, F.col(c))).alias(f"{c}{n}") for n in (3, 2, 1) for c in "mug"))

    # the trie of the vocabulary, and how often a last word is known
    vocabulary = read.where("row = 1").groupBy("plain").agg(F.sum("marked").alias("known"))
    begins = vocabulary.select(_prefixes("plain").alias("plain"), "known")
    lookup = vocabulary.select("plain", "known", F.lit(0).alias("begins")).unionByName(begins.select("plain", F.lit(0).alias("known"), F.col("known").alias("begins")))
    lookup = lookup.groupBy("plain").agg(F.sum("known").alias("known"), F.sum("begins").alias("begins"))
    # the trie within the contexts that ends stand in
    places = asks.select("here").distinct()
    longer = counts.select("here", "word", (F.col("marked") + F.col("goes")).alias("n")).join(places, "here", "left_semi")
    longer = longer.select("here", _prefixes("word").alias("word"), "n").groupBy("here", "word").agg(F.sum("n").alias("longer"))

    # lengths at which the values of a source pile up
    lengths = ended.groupBy("kind", "origin", "length").agg(F.count("*").alias("n"))
    by_source = Window.partitionBy("kind", "origin").orderBy("length").rangeBetween(-3, 3)
    limits = lengths.withColumn("near", (F.sum("n").over(by_source) - F.col("n")) / 6)
    limits = limits.where((F.col("length") >= LEAST_LIMIT) & (F.col("n") > PILE_UP * F.col("near") + 5)).select("kind", "origin", "length", F.lit(True).alias("at_limit"))

    answers = asks.join(lookup, "plain", "left").join(longer, ["here", "word"], "left").join(ends, "ask", "left").select("ask", "values", "known", "begins", "longer", *(f"{c}{k}" for c in "mug" for k in "123"))
    answers = checkpoint(answers)
    tails = ended.withColumn("ask", F.xxhash64("three", "plain")).select("ask", "key", "kind", "source", "origin", "length", "short", "mark", "broken", "opening")
    # ends of very many values are spread over several keys; at most one in ``hot`` values has such an end
    frequent = answers.where(F.col("values") > hot)
    if frequent.limit(1).count():
        parts = F.coalesce("parts", F.lit(1))
        frequent = frequent.select("ask", F.ceil(F.col("values") / hot).cast("int").alias("parts"))
        tails = tails.join(frequent, "ask", "left").withColumn("salt", F.pmod(F.xxhash64("key"), parts).cast("int")).drop("parts")
        answers = answers.join(frequent, "ask", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    else:
        tails, answers = tails.withColumn("salt", F.lit(0)), answers.withColumn("salt", F.lit(0))
    joined = tails.join(answers, ["ask", "salt"]).join(limits, ["kind", "origin", "length"], "left")
    joined = joined.fillna(0, ["known", "begins", "longer", *(f"{c}{k}" for c in "mug" for k in "123")]).fillna(False, ["at_limit"])
    closed = F.col("mark").isin("strong", "soft")
    own = F.when(closed | (F.col("mark") == "none"), 1).otherwise(0)
    total = {k: F.col(f"m{k}") + F.col(f"u{k}") - own + F.col(f"g{k}") for k in (3, 2, 1)}
    share = {k: (F.col(f"m{k}") + F.col(f"u{k}") - own) / total[k] for k in (3, 2, 1)}
    joined = joined.withColumn("p_end", F.when(total[3] >= 8, share[3]).when(total[2] >= 8, share[2]).when(total[1] >= 8, share[1]).when(total[3] >= 2, share[3]))
    here = F.col("m3") + F.col("g3")
    p = F.coalesce("p_end", F.lit(0.5))
    unknown = (F.col("known") == 0) & (F.col("begins") >= 2)
    only_longer = (F.col("longer") >= 3) & (here <= 0.02 * F.col("longer")) | (F.col("longer") >= 1) & (here == 0) & ((total[2] == 0) | (F.coalesce("p_end", F.lit(0.0)) < 0.3))
    limit = F.col("at_limit") & (F.coalesce("p_end", F.lit(0.0)) < F.when(F.col("mark") == "ellipsis", 0.9).otherwise(GOES_ON_AT_LIMIT))
    spaced = (F.col("mark") == "space") & F.col("at_limit")
    # a closed value's last word counts as a known one that ends a sentence: without the value itself, and by stricter bounds
    unseen = (F.col("known") <= 1) & (F.col("begins") >= CLOSED_BEGINS) & (F.col("longer") >= 3) & (here <= 1)
    never = F.coalesce((total[1] >= CLOSED_SEEN) & (share[1] <= CLOSED_ENDS) & (F.coalesce("p_end", F.lit(0.0)) <= CLOSED_ENDS), F.lit(False))
    short = F.col("short")
    # the context of a short value says little
    signs = {
        "broken": ~closed & F.col("broken"),
        "opening": ~closed & F.col("opening"),
        "trie": ~closed & unknown & (~short | (F.col("u1") <= own)),
        "trie_here": ~closed & ~short & only_longer,
        "goes_on": ~closed & ~short & (p < GOES_ON),
        "limit": ~closed & ~short & limit,
        "spaced": ~closed & ~short & spaced,
        "closed_trie": closed & unseen,
        "closed_never": closed & ~short & never,
    }
    held = F.array_compact(F.array(*(F.when(signs[name], F.lit(name)) for name in SIGNS)))
    return joined.withColumn("signs", held).where(F.size("signs") > 0).select("key", "kind", "source", "length", "mark", "p_end", "known", "begins", "longer", "at_limit", "signs")
