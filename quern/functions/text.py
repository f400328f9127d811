"""Text functions: Column -> Column, all of them built-in expressions.

Nulls stay null unless a function says otherwise.  Patterns name Unicode classes, so letters with accents count as
letters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
NOT_WORD = r"[^\p{L}\p{N}]+"


def fold(c: Column) -> Column:
    """Lower case without accents (precomposed Latin letters)."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def match_key(c: Column) -> Column:
    """Folded, with white space collapsed: for comparing texts."""
    return F.trim(F.regexp_replace(fold(c), r"\s+", " "))


def strip(c: Column) -> Column:
    """Without white space (of ASCII) at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Folded words in order."""
    return F.filter(F.split(fold(c), NOT_WORD), lambda w: w != "")


def terms(c: Column, least: int = 4, allowed: Sequence[str] = ()) -> Column:
    """Words of a query worth looking up: of ``least`` letters, or allowed ones."""
    known = F.array(*map(F.lit, allowed)) if allowed else F.array().cast("array<string>")
    return F.filter(F.split(F.lower(c), NOT_WORD), lambda w: (F.length(w) >= least) | (w != "") & F.array_contains(known, w))


def match_expression(c: Column) -> Column:
    """A full-text query: words stripped of other characters, each once in order, joined by OR."""
    stripped = F.transform(F.split(F.trim(c), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", ""))
    return F.array_join(F.array_distinct(F.filter(stripped, lambda w: w != "")), " OR ")


def keywords(c: Column, stop: Sequence[str], least: int = 3) -> Column:
    """Folded words that aren't stop words and have ``least`` letters."""
    return F.filter(F.array_except(tokens(c), F.array(*map(F.lit, stop))), lambda w: F.length(w) >= least)


def overlap(words: Column, text: Column) -> Column:
    """Share of ``words`` that ``text`` contains; null without words."""
    found = F.size(F.filter(words, lambda w: F.contains(text, w)))
    return F.try_divide(found, F.size(words))


def shared(a: Column, b: Column) -> Column:
    """Share of the distinct words of ``a`` that are among those of ``b``; null without words."""
    mine = F.array_distinct(a)
    return F.try_divide(F.size(F.array_intersect(mine, b)), F.size(mine))


def contains_any(c: Column, parts: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(F.lower(c), p))


def has_number(c: Column) -> Column:
    """A free-standing number of three or four digits."""
    return c.rlike(r"(?U)\b\d{3,4}\b")


def triggers(c: Column, strong: Sequence[str], weak: Sequence[str]) -> Column:
    """One strong term, or two weak ones and a number."""
    low = F.lower(c)
    hits = lambda terms: F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t)))
    return (hits(strong) >= 1) | (hits(weak) >= 2) & has_number(c)


def intent(c: Column, weights: Mapping[str, float], stem=lambda a: a) -> Column:
    """Sum of the weights of the distinct (stemmed) terms that occur, 0.5 more for a number, at most 3."""
    table = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    found = F.array_intersect(F.array_distinct(stem(tokens(c))), F.map_keys(table))
    score = F.aggregate(found, F.lit(0.0), lambda s, w: s + F.element_at(table, w))
    return F.least(score + F.when(has_number(c), 0.5).otherwise(0.0), F.lit(3.0))


def expand_abbreviations(c: Column, full: Mapping[str, str]) -> Column:
    """``X`` -> ``X (full)``, for whole words that no bracket follows yet."""
    for short, long in full.items():
        c = F.regexp_replace(c, rf"(?U)\b{short}\b(?!\s*\()", f"{short} ({long})")
    return c


def expand_words(c: Column, synonyms: Mapping[str, Sequence[str]], most: int = 3, keep: bool = True) -> Column:
    """Up to ``most`` synonyms of the whole words that occur, which aren't there yet, appended in order."""
    low = fold(c)
    lists = [F.when(low.rlike(rf"(?U)\b{word}\b"), F.array(*map(F.lit, others))).otherwise(F.array().cast("array<string>")) for word, others in synonyms.items()]
    new = F.slice(F.filter(F.array_distinct(F.concat(*lists)), lambda w: ~F.contains(low, w)), 1, most)
    return F.concat_ws(" ", *([c] if keep else []), F.array_join(new, " "))


def clean_table_line(c: Column) -> Column:
    """Without dot leaders and repeated white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\.{3,}", ""), r"\s{2,}", " "))


def is_separator(c: Column) -> Column:
    """The line between the header and the rows of a table."""
    return c.rlike(r"^\s*\|?[\s:|-]*-[\s:|-]*$")


def pipe_cells(c: Column) -> Column:
    """The trimmed cells of a table line, without what stands outside the outer bars."""
    parts = F.split(F.trim(c), r"\|")
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: F.trim(x))


def rename(c: Column, names: Mapping[str, str]) -> Column:
    """The canonical name where there is one; looked up in lower case."""
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(c))), F.trim(c))


def with_unit(value: Column, column: Column, units: Mapping[str, str]) -> Column:
    """The unit of the column after values that start like a number."""
    table = F.create_map(*(F.lit(x) for kv in units.items() for x in kv))
    unit = F.try_element_at(table, F.lower(F.trim(column)))
    bare = F.trim(value)
    return F.when(bare.rlike(r"^[0-9-]") & unit.isNotNull() & ~F.endswith(bare, unit), F.concat_ws(" ", bare, unit)).otherwise(value)


def title_before_colon(c: Column, most: int = 80) -> Column:
    """What stands before the first colon if that is short, else the text up to the last blank within ``most``."""
    at = F.instr(c, ":")
    head = F.regexp_extract(F.substring(c, 1, most), r"^(.*)\s", 1)
    return F.when(F.coalesce(c, F.lit("")) == "", "Tableau").when((at > 1) & (at <= most + 1), F.trim(F.substring(c, F.lit(1), at - 1))).when(F.length(c) <= most, F.trim(c)).otherwise(F.trim(F.when(head == "", F.substring(c, 1, most)).otherwise(head)))


def sentences(c: Column, more_than: int = 20) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+|\n+"), strip), lambda s: F.length(s) > more_than)


def paragraphs(c: Column, more_than: int = 40) -> Column:
    return F.filter(F.transform(F.split(c, r"\n{2,}"), strip), lambda s: F.length(s) > more_than)


def truncate_words(c: Column, most: int) -> Column:
    """The first words, with `` [...]`` if there are more."""
    parts = F.split(strip(c), r"\s+")
    return F.when(F.size(parts) > most, F.concat(F.array_join(F.slice(parts, 1, most), " "), F.lit(" [...]"))).otherwise(c)


#: Marks around a quote, then the kinds of quotation marks that are tried in turn.
QUOTE_MARKS = r"(?s)##begin_quote##(.+?)##end_quote##"
QUOTE_PATTERNS = ['"([^"]{10,})"', "“([^”]{10,})”", "«([^»]{10,})»", "'([^']{10,})'"]


def quote(c: Column) -> Column:
    """The quoted passage of at least ten characters; null without one."""
    marked = F.regexp_replace(F.trim(F.regexp_extract(c, QUOTE_MARKS, 1)), "^[\"'“”«»]+|[\"'“”«»]+$", "")
    found = [F.when(F.length(marked) >= 10, marked), *(F.nullif(F.trim(F.regexp_extract(c, p, 1)), F.lit("")) for p in QUOTE_PATTERNS)]
    return F.coalesce(*found)


def strip_quote_marks(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("##begin_quote##"), F.lit("")), F.lit("##end_quote##"), F.lit(""))


def quote_holds(q: Column, text: Column) -> Column:
    """The first 80 % of the quote, in lower case with white space collapsed, stand in the text; false without a quote."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    head = F.substring(flat(q), F.lit(1), F.greatest(F.lit(10), F.floor(F.length(flat(q)) * 0.8).cast("int")))
    return F.coalesce((F.length(q) >= 10) & F.contains(flat(text), head), F.lit(False))


def quotes_hold(quotes: Column, text: Column, share: float = 0.8) -> Column:
    """Every quote stands in the text, or this share of its words does."""
    known = tokens(text)
    low = match_key(text)
    return F.forall(quotes, lambda q: F.contains(low, match_key(q)) | (F.coalesce(shared(tokens(q), known), F.lit(0.0)) >= share))


def questions(c: Column, least: int = 15) -> Column:
    """Lines that are questions, without numbering and bullets."""
    lines = F.transform(F.split(c, r"\n"), lambda s: F.trim(F.regexp_replace(F.trim(s), r"^(?:\d+[.)]|[-*•])\s*", "")))
    return F.filter(lines, lambda s: s.endswith("?") & (F.length(s) >= least))


def answer_letter(c: Column) -> Column:
    """The letter of a multiple-choice answer: alone, after 'réponse', in brackets, or the first free-standing one."""
    rules = [r"^\s*([A-F])\s*[.):]?\s*$", r"(?i)\br[ée]ponse\s*:?\s*\(?([A-F])\b", r"\(([A-F])\)", r"\b([A-F])\b"]
    return F.upper(F.coalesce(*(F.nullif(F.regexp_extract(c, r, 1), F.lit("")) for r in rules)))


def yes_no(c: Column) -> Column:
    """True for [[Yes]], false for [[No]], else null."""
    return F.when(c.rlike(r"(?i)\[\[\s*yes\s*\]\]"), True).when(c.rlike(r"(?i)\[\[\s*no\s*\]\]"), False)


def score(c: Column) -> Column:
    """A score in JSON, after 'score', or the first number; kept within 0 and 1."""
    found = F.coalesce(F.try_to_number(F.nullif(F.get_json_object(c, "$.score"), F.lit("")), F.lit("9D999999")).cast("double"), F.regexp_extract(c, r"(?i)score\D{0,5}(\d+(?:\.\d+)?)", 1).try_cast("double"), F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1).try_cast("double"))
    return F.when(found.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), found)))


def cites(c: Column, documents: Column, pages: Column) -> Column:
    """One of the documents (by name without ending) or pages is cited."""
    low = F.lower(c)
    doc = F.exists(documents, lambda d: F.contains(low, F.lower(F.regexp_replace(d, r"\.\w+$", ""))))
    page = F.exists(pages, lambda p: F.regexp(low, F.concat(F.lit(r"\bp(?:age|\.)?\s*"), p.cast("string"), F.lit(r"\b"))))
    return F.coalesce(doc, F.lit(False)) | F.coalesce(page, F.lit(False))


#: Wording of an answer that finds nothing.
ABSTENTIONS = [r"non trouv[eé]", r"pas trouv[eé]", r"pas dans (le|les) (contexte|extrait)", r"information.*non.*disponible", r"ne (se |)trouve pas", r"ne figure pas", r"pas mentionn[eé]", r"aucune information"]


def abstains(c: Column) -> Column:
    return F.lower(c).rlike("|".join(ABSTENTIONS))


def response_check(c: Column, forbidden: Column, expected: Column, behaviour_holds: Column) -> Column:
    """'forbidden' if a forbidden phrase occurs, 'missing' if none of the expected does, else by the behaviour."""
    low = F.lower(c)
    some = lambda phrases: F.exists(phrases, lambda p: F.contains(low, F.lower(p)))
    return F.when(F.coalesce(some(forbidden), F.lit(False)), "forbidden").when((F.size(expected) > 0) & ~some(expected), "missing").when(~behaviour_holds, "behaviour").otherwise("pass")


def article_numbers(c: Column) -> Column:
    """Numbers of articles, annexes and chapters and dotted numbers, each once, in order of the patterns."""
    patterns = [r"(?i)article\s+(\d+(?:\.\d+)*)", r"(?i)art\.\s*(\d+(?:\.\d+)*)", r"(?i)annexe\s+(\d+(?:\.\d+)*)", r"\b(\d+\.\d+(?:\.\d+)*)\b"]
    return F.array_distinct(F.concat(*(F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in patterns)))


def leading_article(c: Column) -> Column:
    """The number that a text starts with, without its last dot; null without one."""
    return F.nullif(F.regexp_replace(F.regexp_extract(c, r"^(\d+(?:\.\d+)*\.?)\s", 1), r"\.$", ""), F.lit(""))


def session_id(c: Column, months: Sequence[tuple[str, str]]) -> Column:
    """YYYYMM from a name: digits, else a month's name (longest first) and a year; null without one."""
    digits = F.regexp_extract(c, r"(20\d{2})[-_ ]?(0[1-9]|1[0-2])", 0)
    year = F.regexp_extract(c, r"(20\d{2})", 1)
    low = fold(c)
    month = F.coalesce(*(F.when(F.contains(low, F.lit(name)), F.lit(number)) for name, number in sorted(months, key=lambda m: -len(m[0]))))
    return F.coalesce(F.when(digits != "", F.regexp_replace(digits, r"[-_ ]", "")), F.when(year != "", F.concat(year, month)))


def choices(c: Column) -> Column:
    """Map of letter -> text of the choices in a block, the first of each letter."""
    found = F.regexp_extract_all(c, F.lit(r"(?m)^\s*[-*]?\s*([A-F]\s*[-.):]\s*\S[^\n]*)"), F.lit(1))
    pairs = F.transform(found, lambda x: F.struct(F.substring(x, 1, 1).alias("k"), F.trim(F.regexp_replace(x, r"^[A-F]\s*[-.):]\s*", "")).alias("v")))
    letters = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(letters, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), 1)))


def answer_text(letters: Column, options: Column) -> Column:
    """The texts of the chosen letters, joined by `` | ``."""
    return F.array_join(F.filter(F.transform(F.split(F.upper(F.regexp_replace(letters, r"[^A-Za-z]", "")), ""), lambda k: F.try_element_at(options, k)), lambda x: x.isNotNull()), " | ")


def answer_quality(c: Column) -> Column:
    """0 without an answer, 0.3 under five characters, 0.5 under twenty, else 1."""
    n = F.length(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(n == 0, 0.0).when(n < 5, 0.3).when(n < 20, 0.5).otherwise(1.0)


def short_id(prefix: str, *parts: Column) -> Column:
    """The prefix and the first eight digits of the parts' MD5."""
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws("", *parts)), 1, 8))


def id_segment(c: Column, n: int = 3, least: int = 4, default: str | None = None) -> Column:
    """The n-th part of an id with at least so many parts."""
    parts = F.split(c, ":")
    return F.when(F.size(parts) >= least, F.element_at(parts, n)).otherwise(F.lit(default))


def token_count(c: Column) -> Column:
    """Words and single other characters: a stand-in for a tokenizer's count, 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")), F.lit(0))


def table_text(header: Column, rows: Column, markdown: bool = True) -> Column:
    """A table as Markdown or as plain lines; short rows are padded."""
    pad = lambda r: F.transform(F.sequence(F.lit(1), F.size(header)), lambda k: F.coalesce(F.try_element_at(r, k), F.lit("")))
    if not markdown:
        return F.array_join(F.concat(F.array(F.array_join(header, " ")), F.transform(rows, lambda r: F.array_join(r, " "))), "\n")
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(header)))
    return F.array_join(F.concat(F.array(line(header), rule), F.transform(rows, lambda r: line(pad(r)))), "\n")


def row_pairs(header: Column, cells: Column) -> Column:
    """``column est value`` for the cells that aren't empty."""
    pairs = F.filter(F.arrays_zip(header.alias("h"), cells.alias("v")), lambda p: F.trim(F.coalesce(p["v"], F.lit(""))) != "")
    return F.transform(pairs, lambda p: F.concat_ws(" est ", p["h"], F.trim(p["v"])))


def title_path(title: Column, section: Column, source: Column) -> Column:
    """``title > section``, with the source where there is no title."""
    return F.concat_ws(" > ", F.coalesce(F.nullif(title, F.lit("")), source), F.nullif(section, F.lit("")))


def prompt(question: Column, context: Column) -> Column:
    """A chat of a context and a question, as an array of role and content."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(message("system", F.lit("Réponds à partir du contexte et cite ta source.")), message("user", F.concat(F.lit("Contexte :\n"), context, F.lit("\n\nQuestion : "), question)))


def numbered_passages(passages: Column) -> Column:
    """``[k] source (p.N):`` and the text of each passage (structs of source, page, text)."""
    each = F.transform(passages, lambda p, k: F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] "), p["source"], F.lit(" (p."), F.coalesce(p["page"].cast("string"), F.lit("?")), F.lit("):\n"), p["text"]))
    return F.array_join(each, "\n\n")


def cited_answer(answer: Column, source: Column, page: Column, q: Column) -> Column:
    return F.format_string('D\'apres %s (p.%s): "%s". %s', source, page.cast("string"), q, answer)


def location_sentence(title: Column, section: Column, text: Column, words: int = 12) -> Column:
    """Where a passage stands and the first words of its first long line."""
    line = F.get(F.filter(F.split(text, r"\n"), lambda s: F.length(F.trim(s)) > 20), 0)
    lead = F.array_join(F.slice(F.split(F.trim(line), r"\s+"), 1, words), " ")
    return F.concat_ws(" ", F.concat(F.lit("Extrait de "), title_path(title, section, title), F.lit(".")), F.nullif(lead, F.lit("")))


#: Patterns of a weak question, and words that are none of its keywords.
VAGUE = ["que se passe-t-il", "comment faire", "qu'est-ce qui"]
COMMON = ["quelle", "quels", "quelles", "comment", "pourquoi", "combien", "joueur", "joueuse", "partie", "tournoi", "arbitre"]


def weakness(question: Column, text: Column, names: Sequence[str] = ()) -> Column:
    """Why a question may be weak: table_numeric, example_names, vague, hallucination, else ok; the first that holds."""
    q, low = F.lower(question), F.lower(text)
    lines = F.split(text, "\n")
    bars = F.size(F.filter(lines, lambda s: F.contains(s, F.lit("|"))))
    table = (bars > F.size(lines) * 0.3) & (F.length(F.regexp_replace(text, r"\D", "")) > 50)
    words = F.filter(F.split(q, r"\s+"), lambda w: (F.length(w) > 5) & ~w.isin(COMMON))
    absent = (F.size(words) >= 3) & (overlap(words, low) < 0.2)
    named = F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(low, n)) & F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(q, n)) if names else F.lit(False)
    return F.when(table, "table_numeric").when(named, "example_names").when(contains_any(question, VAGUE) & (F.length(q) < 50), "vague").when(absent, "hallucination").otherwise("ok")


def by_range(c: Column, ranges: Sequence[tuple[int, int, str]], otherwise: Column | None = None) -> Column:
    """The name of the first range (both ends included) that a number lies in, else ``otherwise``; for null too."""
    return F.coalesce(*(F.when(c.between(low, high), name) for low, high, name in ranges), F.lit(None).cast("string") if otherwise is None else otherwise)


def task_parts(c: Column) -> Column:
    """``task`` and ``rest``: a text up to its first blank line, and what follows; no rest without a blank line."""
    parts = F.split(c, "\n\n", 2)
    return F.struct(F.trim(parts[0]).alias("task"), F.trim(F.get(parts, 1)).alias("rest"))


def priority(c: Column, classes: Mapping[str, str], otherwise: str = "low") -> Column:
    """A priority by class; ``otherwise`` for other classes and null."""
    table = F.create_map(*(F.lit(x) for kv in classes.items() for x in kv))
    return F.coalesce(F.try_element_at(table, c), F.lit(otherwise))
