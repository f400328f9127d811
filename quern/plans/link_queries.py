"""Queries of links, page maps, migration steps, gates by name and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, curate, exams, gates, links, migrate, tables
from ..session import checkpoint
from ..sources import exports
from .data_queries import DRAW, HUMAN, UVO, human, uvo
from .registry import Tables, query
from .search_queries import CHILDREN, FOLD, PARENTS, QUESTIONS, SUMMARIES, asked, children, parents, summaries, words_sql

#: White space as Java's patterns see it, in SQL.
WS = "[ \\t\\n\\x0b\\f\\r]"


# -- page maps

def _items(t: Tables):
    c = children(t).select("source", F.col("id").alias("pos"), "section", "text", "page")
    headings = c.select("source", "pos", F.lit("heading").alias("label"), F.col("section").alias("text"), "page")
    return headings.unionByName(c.select("source", F.concat("pos", F.lit("t")).alias("pos"), F.lit("text").alias("label"), "text", "page"))


@query(f"with {CHILDREN} select source, trim(section) as text, arg_max(page, id) as page from ch where section is not null and trim(section) <> '' and page is not null group by source, trim(section)")
def heading_pages(t):
    """The page of each heading, the last of equal ones."""
    return chunking.heading_pages(_items(t)).select("source", F.explode("heading_pages").alias("text", "page"))


@query(f"with {CHILDREN}, a as (select source, id as pos, section as text, page from ch union all select source, id || 't', text, page from ch), f as (select source, pos, substr(trim(text), 1, 80) as text, page from a where page is not null and trim(text) <> '') select source, (row_number() over (partition by source order by pos) - 1)::int as place, text, page from f")
def text_pages(t):
    """The beginnings of all texts of a source in order, with their pages."""
    return chunking.text_pages(_items(t)).select("source", F.posexplode("text_pages").alias("place", "x")).select("source", "place", "x.text", "x.page")


@query(
    f"with {CHILDREN}, a as (select source, id as pos, section as text, page from ch union all select source, id || 't', text, page from ch), p as (select source, pos, page, trim(regexp_replace(lower(regexp_replace(text, '(?m)^#+{WS}*', '', 'g')), '{WS}+', ' ', 'g')) as plain from a where page > 0), "
    "c as (select *, unnest([150, 100, 80, 60, 40, 30]) as n from p where length(plain) >= 10) select source, substr(plain, 1, n) as segment, arg_max(page, pos) as page from c where n <= length(plain) group by source, substr(plain, 1, n)"
)
def segment_pages(t):
    """Beginnings of texts in six lengths, with the page of the last text that has them."""
    return chunking.segment_pages(_items(t))


@query(f"with {SUMMARIES}, {CHILDREN} select source, id, text, page, tokens from ch union all select source, id, summary_text, page, tokens from ts where trim(coalesce(summary_text, '')) <> ''")
def children_and_tables(t):
    """Passages and, as further ones, the summaries of tables."""
    c = children(t).select("source", F.lit("child").alias("kind"), "id", "text", "parent_id", "section", "article_num", "tokens", "page")
    return chunking.with_table_summaries(c, summaries(t)).select("source", "id", "text", "page", "tokens")


# -- links

@query(f"with {SUMMARIES}, {CHILDREN}, s as (select source, substr(text, 1, 80) as head, arg_max(section, id) filter (where section is not null) as section from ch where text is not null and source is not null group by all) select ts.id, s.section from ts left join s on s.source = ts.source and s.head = substr(ts.raw_table_text, 1, 80)")
def table_sections(t):
    """The section of each table, by source and the beginning of its text."""
    tables = children(t).select("source", F.col("text").alias("raw_text"), "section", F.col("id").alias("pos"))
    return links.table_sections(summaries(t).select("id", "source", "raw_table_text"), tables).select("id", "section")


@query(f"with {QUESTIONS}, {CHILDREN}, q as (select query_id, ch.source, unnest([page, page + 1]) as page from qs join ch on ch.id = qs.chunk_id where page is not null) select distinct query_id, ch.id as doc_id from q join ch on ch.page = q.page where contains({FOLD.format('ch.source')}, {FOLD.format('q.source')})")
def page_links(t):
    """Passages on the page of a question's passage, and the next."""
    c = children(t).select(F.col("id").alias("doc_id"), "source", "page")
    q = asked(t).join(c, F.col("chunk_id") == F.col("doc_id")).where("page is not null")
    q = q.select("query_id", F.col("source").alias("source_part"), F.array("page", F.col("page") + 1).alias("pages"))
    return links.by_pages(q, c)


_SCORED = (
    f"with {HUMAN}, {QUESTIONS}, {CHILDREN}, q as (select query_id, qs.text, list_distinct(list_filter({words_sql('qs.text')}, lambda w: length(w) >= 4)) as ws, chunk_id, ch.source, ch.page from qs join ch on ch.id = qs.chunk_id), "
    "c as (select q.*, d.id as doc_id, d.text as d_text, d.section as d_section from q join ch d on d.source = q.source and d.page = q.page where d.text is not null), "
    f"s as (select query_id, doc_id, 2 * len(list_filter(ws, lambda w: contains({FOLD.format('d_text')}, w))) + 5 * len(list_filter(list_distinct(regexp_extract_all(text, '\\b(\\d+)\\b', 1)), lambda x: contains(d_text, x))) + case when len(list_filter(ws, lambda w: contains({FOLD.format('coalesce(d_section, chr(32))')}, w))) > 0 then 3 else 0 end as score from c where not regexp_matches(text, '(?i)art|annexe|\\d\\.\\d'))"
)


@query(_SCORED + " select query_id, doc_id, score from s where score >= 1 qualify row_number() over (partition by query_id order by score desc, doc_id) = 1")
def best_passages(t):
    """The best passage of a question's page, by words, numbers and the section's name; for questions that name no
    article."""
    c = children(t)
    at = c.select(F.col("id").alias("chunk_id"), "source", "page")
    q = asked(t).where(~F.col("text").rlike(r"(?i)art|annexe|\d\.\d")).join(at, "chunk_id")
    q = q.select("query_id", F.col("text").alias("q_text"), F.array_distinct(F.filter(T.tokens(F.col("text")), lambda w: F.length(w) >= 4)).alias("ws"), "source", "page")
    met = q.join(c.select(F.col("id").alias("doc_id"), "text", "section", "source", "page"), ["source", "page"]).where("text is not null")
    scored = met.select("query_id", "doc_id", links.additive_score(F.col("ws"), F.col("q_text"), F.col("text"), F.col("section")).cast("long").alias("score"))
    return links.best_of(scored, least=1).select("query_id", "doc_id", "score")


@query(f"with {UVO}, {HUMAN} select uv.id, coalesce(uv.explanation, b.e) as explanation, coalesce(uv.source, b.s) as source, b.r as rate_of_session from uv left join (select session, min(explanation) as e, min(source) as s, max(rate) as r from uv where session is not null group by session) b using (session)")
def merged_by_session(t):
    """Missing fields from the session's other questions."""
    u = uvo(t).select("id", "session", "explanation", "source")
    other = uvo(t).where("session is not null").groupBy("session").agg(F.min("explanation").alias("explanation"), F.min("source").alias("source"), F.max("rate").alias("rate_of_session"))
    return links.merge_by_keys(u, [other], ["session"]).select("id", "explanation", "source", "rate_of_session")


ARTICLE_RULES = {r"(?i)coupe": ("RG04", 0.9), r"(?i)blitz|rapide": ("RG07", 0.8), r"(?i)\bfide\b": ("LV01", 0.5)}


@query(f"with {QUESTIONS} select query_id, case when regexp_matches(text, '(?i)coupe') then 'RG04' when regexp_matches(text, '(?i)blitz|rapide') then 'RG07' when regexp_matches(text, '(?i)\\bfide\\b') then 'LV01' end as document, case when regexp_matches(text, '(?i)coupe') then 0.9 when regexp_matches(text, '(?i)blitz|rapide') then 0.8 when regexp_matches(text, '(?i)\\bfide\\b') then 0.5 end::double as confidence from qs")
def article_documents(t):
    """The document that a question's wording points to."""
    return asked(t).withColumn("d", links.article_document(F.col("text"), ARTICLE_RULES)).select("query_id", "d.document", "d.confidence")


@query(f"with {CHILDREN}, {QUESTIONS}, g as (select distinct chunk_id from qs), w as (select source, count(*) as chunks, count(*) filter (where id not in (select chunk_id from g where chunk_id is not null)) as uncovered from ch group by source) select * from w")
def uncovered_passages(t):
    """For each source how many passages no question is about."""
    c = children(t).select("id", "source")
    covered = asked(t).select(F.col("chunk_id").alias("id")).where("id is not null").distinct().withColumn("covered", F.lit(1))
    return c.join(covered, "id", "left").groupBy("source").agg(F.count("*").alias("chunks"), F.count_if(F.col("covered").isNull()).alias("uncovered"))


# -- migration

CLASSES = [("cadence|pendule|temps", "clock"), ("coupe|blitz|rapide", "event"), ("arbitre|jury", "arbiter")]


@query(f"with {HUMAN} select id, case when regexp_matches(lower(question), 'cadence|pendule|temps') then 'clock' when regexp_matches(lower(question), 'coupe|blitz|rapide') then 'event' when regexp_matches(lower(question), 'arbitre|jury') then 'arbiter' else coalesce(source, 'none') end as class, concat_ws(' | ', nullif(notes, ''), case when retrieval_hit then 'hit' end, case when abstained then 'abstained' end) as notes from (select hu.*, notes from hu left join (select id, any_value(notes) as notes from human_eval_34q group by id) using (id))")
def classified_answers(t):
    """A class by the first pattern, and an audit trail of what is known."""
    h = t.human_eval_34q.dropDuplicates(["id"])
    name = migrate.ordered_class(F.col("question"), CLASSES, F.coalesce("source", F.lit("none")))
    return h.select("id", name.alias("class"), migrate.note(F.col("notes"), F.when(F.col("retrieval_hit"), "hit"), F.when(F.col("abstained"), "abstained")).alias("notes"))


@query(f"with {UVO}, n as (select id, session, upper(ans) as ans from uv where ans is not null and length(ans) = 1) select id, session, ans from uv where id not in (select id from n) union all select * from n")
def replaced_answers(t):
    """Rows with one letter come back in upper case, others stay."""
    u = uvo(t).select("id", "session", "ans")
    return migrate.replaced(u, u.withColumn("ans", F.upper("ans")), "id", F.coalesce(F.length("ans") == 1, F.lit(False)))[0]


@query(f"with {UVO}, {HUMAN}, c as (select session, min(source) as new from uv where source is not null group by session) select uv.id, coalesce(c.new, uv.source) as source from uv left join c using (session)")
def corrected_sources(t):
    """A column from a table of corrections by session."""
    u = uvo(t).select("id", "session", "source")
    corrections = u.where("source is not null").select("session", F.col("source").alias("new"))
    return migrate.corrected(u, corrections, "session", "source").select("id", "source")


@query(f"with {QUESTIONS}, {CHILDREN}, a as (select query_id, list_distinct(list_filter({words_sql('qs.text')}, lambda w: length(w) >= 3)) as mine, {words_sql('ch.text')} as theirs from qs join ch on ch.id = qs.chunk_id), o as (select query_id, case when len(mine) > 0 then len(list_filter(mine, lambda w: list_contains(theirs, w))) / len(mine) end as overlap from a where theirs is not null) select query_id, round(overlap, 6) as overlap, case when overlap >= 0.55 then least(0.6, 0.35) else 0.6 end::double as difficulty, case when overlap >= 0.45 then 'extractive' else 'reasoning' end as answer_type from o where overlap is not null")
def overlap_caps(t):
    """Difficulty is capped, and the answer's type told, by the words that question and passage share."""
    c = children(t).select(F.col("id").alias("chunk_id"), F.col("text").alias("passage")).where("passage is not null")
    q = asked(t).join(c, "chunk_id").withColumn("o", T.shared(F.filter(T.tokens(F.col("text")), lambda w: F.length(w) >= 3), T.tokens(F.col("passage")))).where("o is not null")
    return q.select("query_id", F.round("o", 6).alias("overlap"), migrate.capped(F.lit(0.6), F.col("o")).alias("difficulty"), migrate.answer_type(F.col("o")).alias("answer_type"))


@query("select source as key, case when source = 'RG04_Coupe_departementale.pdf' then 'new' else n::varchar end as value, case when source = 'RG04_Coupe_departementale.pdf' then n::varchar end as old from (select source, count(*) as n from parents where source is not null group by source)")
def upserted_value(t):
    """A table of keys and values with one value set."""
    pairs = t.parents.where("source is not null").groupBy(F.col("source").alias("key")).agg(F.count("*").cast("string").alias("value"))
    return migrate.upsert_value(pairs, "RG04_Coupe_departementale.pdf", "new")


@query("with n as (select id, max(indexed_at) as indexed_at, any_value(source) as source, any_value(page) as page from children group by id having count(*) > 1) select id, source, page, indexed_at from n union all select id, source, page, indexed_at from children where id not in (select id from n)")
def upserted_children(t):
    """Later deliveries in place of the first ones."""
    c = t.children.select("id", "source", "page", "indexed_at")
    first = c.groupBy("id").agg(*(F.min_by(x, "indexed_at").alias(x) for x in ("source", "page")), F.min("indexed_at").alias("indexed_at"))
    return exports.upserted(first, c, "id", F.col("indexed_at").desc())


# -- gates by name

@query(
    f"with {HUMAN}, {UVO}, g as (select 'answers_are_text' as gate_id, count(*) filter (where response is null or trim(response) = '')::double as value from hu union all select 'questions_are_asked', count(*) filter (where question is null)::double from hu union all "
    "select 'cited_of_hits', count(*) filter (where retrieval_hit and cited_auto) / nullif(count(*) filter (where retrieval_hit), 0) from hu union all select 'abstained', count(*) filter (where abstained) / count(*) from hu union all select 'models', count(distinct source)::double from hu union all "
    "select 'letters', count(*) filter (where ans is not null and regexp_matches(ans, '^[A-F]')) / nullif(count(*) filter (where ans is not null), 0) from uv union all select 'choices', count(*) filter (where choices is null or cardinality(choices) < 2)::double from uv union all "
    "select 'rates', count(*) filter (where rate < 0 or rate > 1)::double from uv union all select 'sessions', count(distinct session)::double from uv union all select 'sources_known', count(*) filter (where source is null)::double from uv) select gate_id, round(value, 6) as value from g"
)
def named_gates(t):
    """A set of checks over answers and exam items, one row for each; null values are null."""
    h, u = human(t), uvo(t)
    none = lambda c: F.coalesce(c, F.lit(False))
    found = gates.all_gates(
        gates.none_of(h, "answers_are_text", F.col("response").isNull() | (F.trim("response") == "")),
        gates.none_of(h, "questions_are_asked", F.col("question").isNull()),
        gates.ratio(h, "cited_of_hits", none(F.col("cited_auto")), 0.8, of=none(F.col("retrieval_hit"))),
        gates.ratio(h, "abstained", none(F.col("abstained")), high=0.2, strict=True, blocking=False),
        gates.diversity(h, "models", "source", 2),
        gates.ratio(u, "letters", none(F.col("ans").rlike("^[A-F]")), 0.9, of=F.col("ans").isNotNull()),
        gates.none_of(u, "choices", F.col("choices").isNull() | (F.size("choices") < 2), blocking=False),
        gates.none_of(u, "rates", none((F.col("rate") < 0) | (F.col("rate") > 1))),
        gates.diversity(u, "sessions", "session", 2),
        gates.none_of(u, "sources_known", F.col("source").isNull(), blocking=False),
    )
    return found.select("gate_id", "value")


@query(f"with {CHILDREN} select id, filter(['text', 'page', 'tokens', 'vector'], lambda x: (x = 'text' and coalesce(trim(text), '') = '') or (x = 'page' and page is null) or (x = 'tokens' and (tokens is null or tokens <= 0)) or (x = 'vector' and (embedding is null or len(embedding) <> 64))) as errors from ch where coalesce(trim(text), '') = '' or page is null or tokens is null or tokens <= 0 or embedding is null or len(embedding) <> 64")
def passage_errors(t):
    """The rules that each passage breaks."""
    holds = lambda c: F.coalesce(c, F.lit(False))
    rules = {"text": F.trim(F.coalesce("text", F.lit(""))) != "", "page": F.col("page").isNotNull(), "tokens": holds(F.col("tokens") > 0), "vector": holds(F.size("embedding") == 64)}
    return gates.row_errors(children(t), rules).where(F.size("errors") > 0).select("id", "errors")


# -- exports

@query(f"with {CHILDREN}, {QUESTIONS}, ring as (select id as doc_id, text, source, page, row_number() over (order by {DRAW.format('id')}, id) - 1 as place, count(*) over () as size from ch), q as (select query_id, qs.text, ch.text as positive, source, page, {DRAW.format('query_id')} as x from qs join ch on ch.id = qs.chunk_id), m as (select q.*, ring.text as negative, (place - x % size + size) % size as step from q, ring where ring.source is distinct from q.source or coalesce(abs(ring.page - q.page) > 2, true)), n as (select * from m qualify row_number() over (partition by query_id order by step) = 1) select text as \"Query\", positive as \"Document\", '' as \"Answer\", 1 as \"Context_Relevance_Label\" from n where positive is not null union all select text, negative, '', 0 from n where negative is not null")
def export_ares(t):
    """Two rows for each question: its passage, and one drawn by lot from other pages."""
    c = children(t).select(F.col("id").alias("doc_id"), "text", "source", "page")
    q = asked(t).withColumnRenamed("text", "anchor").join(c, F.col("chunk_id") == F.col("doc_id"))
    drawn = curate.negatives(q.select("query_id", "source", "page"), c, 1, page_gap=2, checkpoint=checkpoint)
    negative = drawn.join(c.select("doc_id", F.col("text").alias("negative")), "doc_id").select("query_id", "negative")
    return exports.ares(q.select("query_id", "anchor", F.col("text").alias("positive"), F.lit(None).cast("string").alias("answer")).join(negative, "query_id"))


@query(f"with {HUMAN} select 'user' as first, question as asked, 'assistant' as second, response as said, 'qa' as task_type, source from hu where question is not null and response is not null")
def export_chat(t):
    """Questions and answers as messages of a task."""
    h = human(t).where("question is not null and response is not null").select(F.col("question").alias("instruction"), F.col("response").alias("answer"), "source")
    m = F.col("messages")
    return exports.chat(h, "qa").select(m[0]["role"].alias("first"), m[0]["content"].alias("asked"), m[1]["role"].alias("second"), m[1]["content"].alias("said"), "task_type", "source")


@query(f"with {PARENTS}, {CHILDREN}, c as (select parent_id, count(*) as n, count(*) filter (where len(embedding) = 64) as v from ch where parent_id is not null group by parent_id) select pa.id, coalesce(n, 0) as children, coalesce(v, 0) as vectors from pa left join c on c.parent_id = pa.id")
def aligned_vectors(t):
    """For each parent its children, and how many have a usable vector."""
    c = children(t).where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("n"), F.count_if(F.size("embedding") == 64).alias("v"))
    p = parents(t).select("id").join(c, F.col("id") == F.col("parent_id"), "left")
    return p.select("id", F.coalesce("n", F.lit(0)).alias("children"), F.coalesce("v", F.lit(0)).alias("vectors"))


# -- exams

def _keys(t: Tables):
    """The exam items as one Markdown answer key for each session and paper."""
    u = uvo(t).where("q is not null and ans is not null and session is not null and uv is not null")
    rate = F.coalesce(F.concat(F.round(100 * F.col("rate")).cast("int").cast("string"), F.lit(" %")), F.lit("-"))
    line = F.concat_ws(" | ", F.lit(""), F.col("q").cast("string"), F.regexp_replace("ans", r"[|\s]+", ""), F.concat(F.lit("article "), F.col("q").cast("string")), rate, F.lit(""))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("id", F.trim(line).alias("line")))), lambda x: x["line"])
    text = F.concat(F.lit("| Question | Réponse | Articles de référence | Taux de réussite |\n|---|---|---|---|\n"), F.array_join(lines, "\n"))
    return u.groupBy(F.concat_ws("/", "session", "uv").alias("id")).agg(text.alias("raw_table_text"))


@query(f"with {UVO.replace('any_value(session) as session', 'any_value(session) as session, any_value(uv) as uv')}, k as (select session || '/' || uv as id, id as item, q as number, upper(regexp_replace(ans, '[|\\s]+', '', 'g')) as answer, 'article ' || q as reference, round(100 * rate)::int / 100 as rate from uv where q is not null and ans is not null and session is not null and uv is not null) select id, number, answer, reference, rate, round_even(1 - rate, 2) as difficulty from k qualify row_number() over (partition by id, number order by item desc) = 1")
def answer_keys(t):
    """Answer keys as tables, read again: numbers, letters, references and rates."""
    return exams.answer_key(tables.rows(_keys(t)), last_wins=True)


@query(f"with {UVO.replace('any_value(session) as session', 'any_value(session) as session, any_value(uv) as uv')}, k as (select session || '/' || uv as id, id as item, q as number, upper(trim(ans)) as letter from uv where q between 0 and 999 and session is not null and uv is not null and regexp_full_match(trim(ans), '[A-Fa-f]')) select id, number, letter from k qualify row_number() over (partition by id, number order by item) = 1")
def answer_grids(t):
    """The same as grids of two rows, numbers above letters."""
    u = uvo(t).where("q between 0 and 999 and session is not null and uv is not null").where(F.trim("ans").rlike("^[A-Fa-f]$"))
    each = F.transform(F.sort_array(F.collect_list(F.struct("id", "q", F.trim("ans").alias("ans")))), lambda x: x)
    grids = u.groupBy(F.concat_ws("/", "session", "uv").alias("id")).agg(each.alias("e"))
    text = F.concat(F.lit("| "), F.array_join(F.transform("e", lambda x: x["q"].cast("string")), " | "), F.lit(" |\n| "), F.array_join(F.transform("e", lambda x: x["ans"]), " | "), F.lit(" |"))
    return exams.answer_grid(tables.rows(grids.select("id", text.alias("raw_table_text"))))


# -- subsets and small steps

@query(f"with {CHILDREN} select id, case when source = 'LV01_Livret_arbitre_club.pdf' and page between 1 and 10 then 'first' when source = 'LV01_Livret_arbitre_club.pdf' and page between 11 and 40 then 'second' else section end as chapter from ch")
def chapters(t):
    """The chapter of a passage: by ranges of pages in one source, else its section."""
    of = T.by_range(F.when(F.col("source") == "LV01_Livret_arbitre_club.pdf", F.col("page")), [(1, 10, "first"), (11, 40, "second")], F.col("section"))
    return children(t).select("id", of.alias("chapter"))


@query(f"with {PARENTS} select id, trim(case when strpos(text, chr(10) || chr(10)) > 0 then substr(text, 1, strpos(text, chr(10) || chr(10)) - 1) else text end) as task, trim(case when strpos(text, chr(10) || chr(10)) > 0 then substr(text, strpos(text, chr(10) || chr(10)) + 2) end) as rest from pa where text is not null")
def task_parts(t):
    """Texts up to their first blank line, and what follows."""
    return parents(t).where("text is not null").select("id", T.task_parts(F.col("text")).alias("p")).select("id", "p.task", "p.rest")


@query(f"with {CHILDREN} select id as doc_id, trim(text) as query, trim(text) as passage from ch where length(trim(text)) >= 20")
def identical_pairs(t):
    c = children(t).select(F.col("id").alias("doc_id"), "text")
    return curate.require_share(curate.identical_pairs(c), c)


@query(f"with {UVO} select id, ans from uv where regexp_matches(upper(trim(ans)), '^[A-F]$') and not contains(lower(coalesce(explanation, '')), 'annul')")
def testable_questions(t):
    """Exam items with one letter whose explanation doesn't say that they were annulled."""
    return curate.testable(uvo(t), "ans", "explanation", "annul").select("id", "ans")


@query(f"with {UVO} select id, source, case source when 'pdf-text' then 'high' when 'ocr-scan' then 'medium' else 'low' end as priority from uv where source is not null or starts_with(id, 'Q1')")
def known_origins(t):
    """Questions of a known source or an id of one kind, with a priority by source."""
    return curate.by_origin(uvo(t), ["Q1"], "source").select("id", "source", T.priority(F.col("source"), {"pdf-text": "high", "ocr-scan": "medium"}).alias("priority"))
