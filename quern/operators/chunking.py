"""Documents in Markdown cut into children, parents and tables.

Documents are independent, so this is a map over rows in Arrow batches.  A document becomes a sequence of units (text under
one heading, within the limit of tokens).  Everything after that works on places in this sequence: parents are bins of
the places that share their two upper headings, children are spans of places, pages are carried along the lines, and
tables know the unit that held them.  Null and empty documents have no parts.

Token counts are those of words and signs unless a ``count`` is passed, such as ``bpe_counter(path)``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import accumulate, dropwhile, groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHILD_TOKENS, OVERLAP, PARENT_TOKENS, SMALL_TOKENS, TABLE_LINES = 450, 50, 2048, 200, 3
SEPARATORS = ("\n\n", "\n", ".\n", " ", "")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_TABLE_LINE = re.compile(r"^\s*\|.*\|\s*$")
_HEADING = re.compile(r"^(#{1,4})\s+(.*\S)\s*$")
_ARTICLE = re.compile(r"^(\d+(?:\.\d+)*\.?)\s")
_PLACEHOLDER, _NUMBERED = re.compile(r"\s*<!-- TABLE_\d+ -->\s*"), re.compile(r"<!-- TABLE_(\d+) -->")
#: Page marks and image comments that extraction leaves behind.
_PAGE_MARK, _IMAGE = re.compile(r"\n\s*[A-Z][A-Z0-9]{1,3}-\d+/\d+\s*\n"), "<!-- image -->"


def count_tokens(text: str) -> int:
    """Words and single other characters; a tokenizer's count can be used instead."""
    return len(_TOKEN.findall(text))


def bpe_counter(path: str) -> Callable[[str], int]:
    """Counts the tokens of a public BPE tokenizer, whose file is read once by each worker."""

    def count(text: str) -> int:
        return len(_tokenizer(path).encode(text, add_special_tokens=False).ids)

    return count


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Section(NamedTuple):
    """A text and the headings h1 to h4 above it, empty where there is none."""

    text: str
    headings: tuple[str, ...] = ("",) * 4

    def path(self, depth: int = 4) -> str:
        return " > ".join(filter(None, self.headings[:depth]))


def cut_tables(markdown: str) -> tuple[str, list[str]]:
    """The text with placeholders for blocks of at least three table lines, and these blocks."""
    kept, found, block = [], [], []

    def close() -> None:
        if len(block) >= TABLE_LINES:
            kept.append(f"<!-- TABLE_{len(found)} -->")
            found.append("\n".join(block))
        else:
            kept.extend(block)
        block.clear()

    for line in _PAGE_MARK.sub("\n", markdown).replace(_IMAGE, "").split("\n"):
        if _TABLE_LINE.match(line):
            block.append(line)
        else:
            close()
            kept.append(line)
    close()
    return "\n".join(kept), found


def by_headings(text: str) -> list[Section]:
    """Sections with the headings above them; a heading stays in its section's text."""
    out, open_headings, held = [], {}, []

    def close() -> None:
        body = "\n".join(held).strip()
        if body:
            out.append(Section(body, tuple(open_headings.get(k, "") for k in range(1, 5))))
        held.clear()

    fenced = False
    for line in text.split("\n"):
        fenced ^= line.lstrip().startswith("```")
        m = None if fenced else _HEADING.match(line)
        if m:
            close()
            level = len(m.group(1))
            open_headings = {k: v for k, v in open_headings.items() if k < level} | {level: m.group(2)}
        held.append(line)
    close()
    return out


def by_separators(text: str, limit: int, overlap: int, count: Callable[[str], int], separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``limit`` tokens, cut at the first separator that occurs and at the next ones where needed.

    Consecutive pieces share up to ``overlap`` tokens of whole parts."""
    if count(text) <= limit:
        return [text.strip()] if text.strip() else []
    sep = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(sep) + 1 :] if sep else ()
    if sep == "":
        return _hard_cuts(text, limit, overlap, count)
    out, held, size = [], [], 0
    for part in text.split(sep):
        n = count(part)
        if n > limit:
            if held:
                out.append(sep.join(held).strip())
                held, size = [], 0
            out.extend(by_separators(part, limit, overlap, count, rest or ("",)))
            continue
        if size + n > limit and held:
            out.append(sep.join(held).strip())
            while held and (size > overlap or size + n > limit):
                size -= count(held.pop(0))
        held.append(part)
        size += n
    if held:
        out.append(sep.join(held).strip())
    return [x for x in out if x]


def _hard_cuts(text: str, limit: int, overlap: int, count: Callable[[str], int]) -> list[str]:
    """Pieces of words and signs, each the longest that ``count`` allows, found by bisection."""
    words = [m.span() for m in _TOKEN.finditer(text)]
    out, begin = [], 0
    while begin < len(words):
        piece = lambda stop: text[words[begin][0] : words[stop - 1][1]]  # noqa: B023, E731
        fits, over = begin + 1, min(begin + limit, len(words)) + 1
        while over - fits > 1:
            middle = (fits + over) // 2 if count(piece(over - 1)) > limit else over - 1
            fits, over = (middle, over) if count(piece(middle)) <= limit else (fits, middle)
        out.append(piece(fits))
        if fits == len(words):
            break
        begin = max(begin + 1, fits - overlap)
    return out


def has_body(text: str) -> bool:
    """Something besides headings and placeholders."""
    return bool(re.sub(r"^#{1,6}\s+.*$", "", _PLACEHOLDER.sub("", text).strip(), flags=re.M).strip())


def bins(sizes: Sequence[int], limit: int) -> np.ndarray:
    """The bin of each size: consecutive sizes share one while they add up to ``limit`` at most; a larger one is alone.

    The last place that fits is found in the running sums, so a bin costs one search."""
    upto = np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))])
    edges = [0]
    while edges[-1] < len(sizes):
        fits = int(np.searchsorted(upto, upto[edges[-1]] + limit, side="right")) - 1
        edges.append(max(fits, edges[-1] + 1))
    return np.repeat(np.arange(len(edges) - 1), np.diff(edges))


def spans(homes: Sequence[str], texts: Sequence[str], count: Callable[[str], int], small: int = SMALL_TOKENS, limit: int = CHILD_TOKENS) -> list[tuple[int, int]]:
    """Children as spans of units: a run of small units of one parent is cut wherever the span so far is no longer small."""
    sizes = [count(t) for t in texts]
    out = []
    for (_, is_small), run in groupby(range(len(texts)), key=lambda k: (homes[k], sizes[k] < small)):
        places = list(run)
        begin, end = places[0], places[-1] + 1
        while begin < end:
            stop, size = begin + 1, sizes[begin]
            while is_small and stop < end and size < small and size + sizes[stop] <= limit:
                stop += 1
                size = count("\n\n".join(texts[begin:stop]))
            out.append((begin, stop))
            begin = stop
    return out


def line_pages(markdown: str, heading_pages: dict[str, int], text_pages: Sequence[tuple[str, int]] = ()) -> dict[str, int]:
    """Page of each line, by its first 80 characters; the last line of a key wins.

    A known heading sets the page, else the next page that is known for the line's text; texts whose pages are used up,
    and unknown lines, keep the page they are on."""
    if not heading_pages:
        return {}
    bare = lambda line: line.strip().lstrip("#").strip()
    coming: dict[str, Iterator[int]] = {k: iter([page for _, page in ps]) for k, ps in groupby(sorted(((bare(t)[:80], p) for t, p in text_pages), key=lambda x: x[0]), key=lambda x: x[0])}
    lines = [line for line in map(bare, markdown.split("\n")) if line]
    known = [heading_pages[x] if x in heading_pages else next(coming.get(x[:80], iter(())), None) for x in lines]
    carried = accumulate(known, lambda at, new: at if new is None else new, initial=min(heading_pages.values()))
    next(carried)
    return dict(zip((x[:80] for x in lines), carried))


def chunk(markdown: str, source: str, heading_pages: dict[str, int] | None = None, text_pages: Sequence[tuple[str, int]] | None = None, count: Callable[[str], int] = count_tokens) -> list[dict]:
    """Rows of kind child, parent or table.

    Of several parents with one section, the last is the home of the section's tables."""
    pages_of = heading_pages or {}
    clean, blocks = cut_tables(markdown)
    sections = by_headings(clean)
    units = [Section(t, s.headings) for s in sections for t in by_separators(s.text, CHILD_TOKENS, OVERLAP, count)]
    units = [u for u in units if has_body(u.text)]

    # parents: all units of one pair of upper headings, wherever they stand, in bins
    homes, parents = [""] * len(units), []
    by_pair: dict[tuple[str, ...], list[int]] = {}
    for k, u in enumerate(units):
        by_pair.setdefault(u.headings[:2], []).append(k)
    for pair, members in by_pair.items():
        joined = count("\n\n".join(units[k].text for k in members))
        numbers = bins([count(units[k].text) for k in members], PARENT_TOKENS) if joined > PARENT_TOKENS else np.zeros(len(members), dtype=np.int64)
        for n in range(int(numbers[-1]) + 1):
            inside = [members[k] for k in np.flatnonzero(numbers == n)]
            text = "\n\n".join(units[k].text for k in inside)
            ident = f"{source}-p{len(parents):03d}"
            parents.append(_row("parent", ident, text, count(text), " > ".join(filter(None, pair)) or "root"))
            for k in inside:
                homes[k] = ident

    texts = [_PLACEHOLDER.sub("\n", u.text).strip() for u in units]
    pages = line_pages(markdown, pages_of, text_pages or ())
    first_page = min(pages_of.values(), default=1)
    children = []
    for k, (a, b) in enumerate(spans(homes, texts, count)):
        text = "\n\n".join(texts[a:b])
        names = [u.path() for u in units[a:b]]
        # once a second section is in the name, each further unit adds its own
        section = " + ".join([names[0], *filter(None, dropwhile(("", names[0]).__contains__, names))])
        numbered = _ARTICLE.match(units[a].text)
        lines = (line.strip().lstrip("#").strip()[:80] for line in texts[a].split("\n"))
        page = next((pages[x] for x in lines if x in pages), first_page)
        children.append(_row("child", f"{source}-c{k:04d}", text, count(text), section, homes[a], numbered and numbered.group(1).rstrip("."), page))

    # tables: the section whose text holds the placeholder
    holder = {int(n): s for s in reversed(sections) for n in _NUMBERED.findall(s.text)}
    by_section = {p["section"]: p["id"] for p in parents}
    tables = []
    for k, block in enumerate(blocks):
        home = holder.get(k, Section(""))
        page = next((p for h, p in pages_of.items() if h in home.path()), None)
        tables.append(_row("table", f"{source.rsplit('.', 1)[0]}-table{k}", block, count(block), home.path(), by_section.get(home.path(2), by_section.get(home.path(), "")), None, page))
    return children + parents + tables


def chunk_nested(markdown: str, source: str, count: Callable[[str], int] = count_tokens, parent: int = 1024, child: int = CHILD_TOKENS, least: int = 20) -> list[dict]:
    """Rows of kind child and parent, where children are cut inside each parent: headings, then parents of at most
    ``parent`` tokens, then children of at most ``child``; children of fewer than ``least`` tokens are dropped."""
    out: list[dict] = []
    for section in by_headings(markdown):
        for text in by_separators(section.text, parent, 0, count):
            ident = f"{source}-p{sum(r['kind'] == 'parent' for r in out):03d}"
            inside = [t for t in by_separators(text, child, OVERLAP, count) if count(t) >= least]
            out.append(_row("parent", ident, text, count(text), section.path() or "root"))
            out += [_row("child", f"{ident}-c{k:02d}", t, count(t), section.path(), ident) for k, t in enumerate(inside)]
    return out


FIELDS = ("kind", "id", "text", "parent_id", "section", "article_num", "tokens", "page")
SCHEMA = "source string, kind string, id string, text string, parent_id string, section string, article_num string, tokens int, page int"


def _row(kind: str, ident: str, text: str, tokens: int, section: str, parent_id: str | None = None, article_num: str | None = None, page: int | None = None) -> dict:
    return {"kind": kind, "id": ident, "text": text, "parent_id": parent_id, "section": section, "article_num": article_num, "tokens": tokens, "page": page}


def chunk_documents(docs: DataFrame, count: Callable[[str], int] = count_tokens, nested: bool = False) -> DataFrame:
    """All parts of all documents, by ``chunk`` or, if ``nested``, by ``chunk_nested``.

    ``docs``: source, markdown and, if known, heading_pages (map) and text_pages (array of struct of text and page); other
    columns are ignored."""
    extra = [c for c in ("heading_pages", "text_pages") if c in docs.columns]

    def parts(source: str | None, markdown: str | None, given: dict) -> list[dict]:
        if not markdown or not markdown.strip():
            return []
        name = source or "unknown"
        if nested:
            return chunk_nested(markdown, name, count)
        texts = [(t["text"] or "", t["page"]) for t in given.get("text_pages") or () if t]
        return chunk(markdown, name, dict(given.get("heading_pages") or {}), texts, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32() if c in ("tokens", "page") else pa.string() for c in FIELDS]
        for batch in batches:
            sources, markdowns, *others = (c.to_pylist() for c in batch.columns)
            found = [parts(s, m, dict(zip(extra, more))) for s, m, *more in zip(sources, markdowns, *others)]
            rows = [r for rs in found for r in rs]
            owner = pa.array(np.repeat(np.arange(len(found)), [len(rs) for rs in found]).astype(np.int64))
            columns = [pa.array([r[c] for r in rows], t) for c, t in zip(FIELDS, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), *columns], names=["source", *FIELDS])

    return docs.select(F.col("source").cast("string").alias("source"), "markdown", *extra).mapInArrow(run, SCHEMA)


def with_table_summaries(children: DataFrame, summaries: DataFrame) -> DataFrame:
    """Children and, as further children, the summaries of tables.

    ``summaries``: id, summary_text, source, page, tokens, one row for each id; null and blank summaries give none."""
    told = summaries.where(F.trim(F.coalesce("summary_text", F.lit(""))) != "")
    as_child = told.select("source", F.lit("table_summary").alias("kind"), "id", F.col("summary_text").alias("text"), F.lit(None).cast("string").alias("parent_id"), F.lit("").alias("section"), F.lit(None).cast("string").alias("article_num"), F.col("tokens").cast("int").alias("tokens"), F.col("page").cast("int").alias("page"))
    return children.select(*SCHEMA_COLUMNS).unionByName(as_child)


SCHEMA_COLUMNS = ("source", *FIELDS)


#: How many characters of a normalised text may tell its page.
SEGMENTS = (150, 100, 80, 60, 40, 30)


def heading_pages(items: DataFrame) -> DataFrame:
    """source, heading_pages: the page of each heading, the last of equal ones.  ``items``: source, pos, label, text, page."""
    last = items.where("label = 'heading' and page is not null and text is not null").groupBy("source", F.trim("text").alias("text")).agg(F.max_by("page", "pos").alias("page"))
    return last.where("text <> ''").groupBy("source").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("text", "page")))).alias("heading_pages"))


def text_pages(items: DataFrame, head: int = 80) -> DataFrame:
    """source, text_pages: the first characters and the page of all texts, in order.  ``items`` as in ``heading_pages``."""
    rows = items.where("page is not null and trim(text) <> ''").select("source", F.struct("pos", F.substring(F.trim("text"), 1, head).alias("text"), "page").alias("x"))
    return rows.groupBy("source").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x["text"].alias("text"), x["page"].alias("page"))).alias("text_pages"))


def segment_pages(items: DataFrame) -> DataFrame:
    """source, segment, page: an index of the beginnings of texts in six lengths; the last text of a beginning wins.

    Texts are compared in lower case with white space collapsed; those of fewer than 10 characters have no place."""
    plain = F.trim(F.regexp_replace(F.lower(F.regexp_replace("text", r"(?m)^#+\s*", "")), r"\s+", " "))
    known = items.where("page > 0").select("source", "pos", "page", plain.alias("plain")).where(F.length("plain") >= 10)
    cut = F.explode(F.filter(F.array(*map(F.lit, SEGMENTS)), lambda n: n <= F.length("plain")))
    each = known.select("source", "pos", "page", "plain", cut.alias("n"))
    return each.groupBy("source", F.expr("substring(plain, 1, n)").alias("segment")).agg(F.max_by("page", "pos").alias("page"))


def enrich(children: DataFrame, contexts: DataFrame, abbreviations: dict[str, str]) -> DataFrame:
    """Children with their context sentence in front and abbreviations expanded; token counts stay.  ``contexts``: id,
    context, with distinct ids."""
    from ..functions.text import expand_abbreviations

    joined = children.join(contexts.select("id", "context"), "id", "left")
    return joined.withColumn("text", expand_abbreviations(F.concat_ws("\n\n", F.nullif("context", F.lit("")), "text"), abbreviations)).drop("context")
