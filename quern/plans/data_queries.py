"""Queries of gates, curation, text functions, links, tables, migration and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stem, text as T
from ..operators import chunking, curate, gates, links, metrics, migrate, retrieval, tables
from ..session import checkpoint
from ..sources import exports
from ..streaming import log
from .registry import query
from .search_queries import CELLS, CHILDREN, FOLD, PARENTS, QUESTIONS, SUMMARIES, Tables, asked, cells_of, children, parents, summaries, words_sql

UVO = "uv as (select id, any_value(session) as session, any_value(source) as source, any_value(q) as q, any_value(ans) as ans, any_value(rate) as rate, any_value(text) as text, any_value(choices) as choices, any_value(explanation) as explanation, any_value(extraction_date) as extraction_date from jun2023_uvo group by id)"
HUMAN = "hu as (select id, any_value(source) as source, any_value(question) as question, any_value(response_preview) as response, any_value(retrieval_hit) as retrieval_hit, any_value(cited_auto) as cited_auto, any_value(abstained) as abstained, any_value(score_useful) as score_useful, any_value(score_faithful) as score_faithful from human_eval_34q group by id)"


#: A draw of 60 bits in SQL, as ``curate.draw`` makes it.
DRAW = "('0x' || substr(md5('42|' || {}), 1, 15))::bigint"
#: The title of a table in SQL, as ``text.title_before_colon`` cuts it.
TITLE = "case when coalesce(summary_text, '') = '' then 'Tableau' when strpos(summary_text, ':') between 2 and 81 then trim(substr(summary_text, 1, strpos(summary_text, ':') - 1)) when length(summary_text) <= 80 then trim(summary_text) else trim(case when regexp_extract(substr(summary_text, 1, 80), '^(.*)\\s', 1) = '' then substr(summary_text, 1, 80) else regexp_extract(substr(summary_text, 1, 80), '^(.*)\\s', 1) end) end"


#: White space as built-in patterns see it, in SQL; and a text without it at both ends.
WS = "[ \\t\\n\\x0b\\f\\r]"


def stripped(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def _repaired_sql(c: str) -> str:
    for bad, good in stem.MOJIBAKE.items():
        c = f"replace({c}, '{bad}', '{good}')"
    return c


def uvo(t: Tables):
    return t.jun2023_uvo.dropDuplicates(["id"])


def human(t: Tables):
    return t.human_eval_34q.dropDuplicates(["id"]).withColumnRenamed("response_preview", "response")


# -- scans and upserts

@query(f"with {CHILDREN} select id, source, page, tokens from ch")
def latest_children(t):
    """The last delivery of each id; only four columns are read."""
    return retrieval.latest(t.children.select("id", "source", "page", "tokens", "indexed_at"), "id", F.col("indexed_at").desc()).drop("indexed_at")


@query("select id, max(indexed_at) as last_delivery, count(*) as deliveries from children group by id having count(*) > 1")
def redelivered(t):
    return t.children.groupBy("id").agg(F.max("indexed_at").alias("last_delivery"), F.count("*").alias("deliveries")).where("deliveries > 1")


@query("with t as (select source, count(distinct id) as ids from children group by source) select source, ids, row_number() over (order by ids desc, source) as place from t")
def sources_by_size(t):
    counted = t.children.groupBy("source").agg(F.count_distinct("id").alias("ids"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.col("ids").desc(), "source")))


# -- gates

@query(f"with {CHILDREN}, {PARENTS} select 'children without a parent' as what, count(*) as n from ch where parent_id is not null and parent_id not in (select id from pa) union all select 'parents without a child', count(*) from pa where length(trim(coalesce(text, ''))) > 0 and tokens > 0 and id not in (select parent_id from ch where parent_id is not null)")
def orphans(t):
    c, p = children(t), parents(t)
    lost = c.where("parent_id is not null").join(p.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").agg(F.lit("children without a parent").alias("what"), F.count("*").alias("n"))
    alone = p.where((F.length(F.trim(F.coalesce("text", F.lit("")))) > 0) & (F.col("tokens") > 0)).join(c.select(F.col("parent_id").alias("id")), "id", "left_anti").agg(F.lit("parents without a child").alias("what"), F.count("*").alias("n"))
    return lost.unionByName(alone)


@query(
    f"with {CHILDREN}, {PARENTS}, {SUMMARIES}, g as (select 'I1' as gate_id, count(*)::double as value, '= 0' as threshold from pa where length(trim(coalesce(text, ''))) > 0 and tokens > 0 and id not in (select parent_id from ch where parent_id is not null) "
    "union all select 'I2', count(*), '= 0' from ch where parent_id is not null and parent_id not in (select id from pa) union all select 'I3', count(*), '= 0' from ch where page is null union all select 'I4', count(*), '= 0' from ch where embedding is null "
    "union all select 'I5', 0, '= 0' union all select 'I6', count(*), '= 0' from pa where tokens > 2098 union all select 'I8', count(*), '= 0' from ch where contains(coalesce(text, ''), '<!-- TABLE_') union all select 'I9', count(*), '= 0' from ts where source is null or page is null) "
    "select gate_id, value = 0 as passed, true as blocking, value, threshold from g union all select 'I7', c / p >= 0.9, true, round(c / p, 6), '>= 0.9' from (select sum(tokens)::double as c from ch), (select sum(tokens)::double as p from pa)"
)
def store_gates(t):
    return gates.store_gates(parents(t), children(t), summaries(t))


@query(
    f"with {UVO}, {HUMAN}, g as (select 'answered' as gate_id, avg((ans is not null)::int) as value, '>= 0.9' as threshold, 0.9 as low, 9 as high, true as blocking from uv union all select 'question_mark', avg((regexp_matches(text, '\\?\\s*$'))::int), '>= 0.5', 0.5, 9, true from uv union all select 'abstained', avg(abstained::int), '>= 0.0 and <= 0.4', 0, 0.4, false from hu) "
    "select gate_id, value between low and high as passed, blocking, round(value, 6) as value, threshold from g union all select 'sources', count(distinct source) >= 4, true, count(distinct source), '>= 4' from hu union all select 'letters', count(distinct ans) filter (where ans in ('A', 'B', 'C')) = 3, false, 3 - count(distinct ans) filter (where ans in ('A', 'B', 'C')), '= 0' from uv"
)
def dataset_gates(t):
    u, h = uvo(t), human(t)
    return gates.all_gates(
        gates.ratio(u, "answered", F.col("ans").isNotNull(), low=0.9),
        gates.ratio(u.where("text is not null"), "question_mark", F.col("text").rlike(r"\?\s*$"), low=0.5),
        gates.ratio(h.where("abstained is not null"), "abstained", F.col("abstained"), low=0.0, high=0.4, blocking=False),
        gates.diversity(h, "sources", "source", 4),
        gates.required_values(u, "letters", "ans", ["A", "B", "C"], blocking=False),
    )


@query(f"with {HUMAN}, e as (select id, list_filter([case when not coalesce(length(question) >= 10, false) then 'question' end, case when not coalesce(length(response) >= 20, false) then 'response' end, case when not coalesce(source <> '', false) then 'source' end], lambda x: x is not null) as errors from hu) select id, array_to_string(errors, ',') as errors from e where len(errors) > 0")
def row_errors(t):
    rules = {"question": F.length("question") >= 10, "response": F.length("response") >= 20, "source": F.col("source") != ""}
    return gates.row_errors(human(t), rules).select("id", F.array_join("errors", ",").alias("errors"))


@query("with u as (select distinct * from jun2023_uvo), f as (select id, (id is not null and id <> '')::int + (session is not null and session <> '')::int + (section is not null and section <> '')::int + (uv is not null and uv <> '')::int + (source is not null and source <> '')::int + (q is not null)::int + (ans is not null and ans <> '')::int + (rate is not null)::int + (text is not null and text <> '')::int + (explanation is not null and explanation <> '')::int as n from jun2023_uvo) select id, max(n) as fields from f group by id")
def filled_fields(t):
    columns = ["id", "session", "section", "uv", "source", "q", "ans", "rate", "text", "explanation"]
    return t.jun2023_uvo.withColumn("n", gates.filled_fields(t.jun2023_uvo, columns)).groupBy("id").agg(F.max("n").alias("fields"))


@query(f"with {UVO}, l as (select 'rows' as measure, '' as value, count(*) as n from uv union all select 'keys', '', count(distinct id) from uv union all select 'session', coalesce(session, 'null'), count(*) from uv group by session union all select 'ans', coalesce(ans, 'null'), count(*) from uv group by ans) select * from l")
def snapshot(t):
    return gates.snapshot(uvo(t), "id", ["session", "ans"]).where("measure not like '%fields'")


@query("with a as (select distinct id from children where indexed_at < timestamp '2025-01-01'), b as (select distinct id from children where indexed_at >= timestamp '2025-01-01'), f as (select a.id as a, b.id as b from a full join b on a.id = b.id) select case when b is null then 'lost' when a is null then 'added' else 'kept' end as state, count(*) as n from f group by 1")
def snapshot_diff(t):
    """Ids delivered before 2025 against those delivered later."""
    c = t.children.select("id", "indexed_at")
    return gates.compare(c.where("indexed_at < timestamp '2025-01-01'"), c.where("indexed_at >= timestamp '2025-01-01'"), "id")


@query(f"with {HUMAN}, {QUESTIONS}, e as (select lower(trim(question)) as question, response, {words_sql('question')} as ws from hu where response is not null and question is not null) select count(*) filter (where contains(trim(regexp_replace({FOLD.format('response')}, '\\s+', ' ', 'g')), trim(regexp_replace({FOLD.format('question')}, '\\s+', ' ', 'g')))) as verbatim, count(*) as n from e")
def grounding(t):
    """How many responses hold their question word for word."""
    h = human(t).where("question is not null and response is not null")
    g = gates.grounding(F.col("question"), F.col("response"), T.tokens(F.col("question")))
    return h.agg(F.count_if(g == "verbatim").alias("verbatim"), F.count("*").alias("n"))


# -- duplicates, distributions, statistics

@query("with g as (select md5(text) as h, count(*) as n from documents where text is not null group by 1) select count(*) filter (where n > 1) as groups, coalesce(sum(n - 1), 0)::bigint as duplicates, round(coalesce(sum(n - 1) / sum(n), 0), 6)::double as rate from g")
def exact_duplicates(t):
    return curate.exact_duplicates(t.documents, F.col("text"))


BLANKS = r"^[ \t\r\n]+|[ \t\r\n]+$"


@query("with d as (select doc_id, lang, md5(lower(regexp_replace(text, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g'))) as h from documents where text is not null) select doc_id, h from d qualify row_number() over (partition by h order by (lang is not null) desc, doc_id) = 1")
def priority_dedup(t):
    """One document of each text, those with a language first."""
    d = t.documents.where("text is not null").select("doc_id", "lang", F.md5(F.lower(F.regexp_replace("text", BLANKS, ""))).alias("h"))
    return curate.first_by_priority(d, F.col("h"), F.col("lang").isNotNull().desc(), F.col("doc_id")).select("doc_id", "h")


SIM = "with us as (select vec_id, embedding::double[] as v from embeddings), pr as (select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.v, b.v), 6) as cosine from us a, us b where a.vec_id < b.vec_id)"


@query(SIM + " select a, b, cosine from pr where cosine >= 0.5")
def similar_pairs(t):
    return curate.similar_pairs(t.embeddings, "vec_id", "embedding", 0.4999995).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query(SIM + " select max(cosine) as most, count(*) filter (where cosine >= 0.95) as close from pr where cosine >= 0.3")
def pair_similarity_max(t):
    pairs = curate.similar_pairs(t.embeddings, "vec_id", "embedding", 0.2999995)
    return pairs.agg(F.round(F.max("cosine"), 6).alias("most"), F.count_if(F.col("cosine") >= 0.95).alias("close"))


@query("with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where len(embedding) > 0), n as (select vec_id, label, e, sqrt(list_dot_product(e, e)) as n from v), p as (select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id < b.vec_id where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.5), f as (select b, list(a) as earlier from p group by b), o as (select vec_id, coalesce(earlier, []) as earlier, row_number() over (order by vec_id) as k from embeddings left join f on f.b = vec_id), g as (select 0::bigint as k, []::bigint[] as kept union all select o.k, case when list_has_any(g.kept, o.earlier) then g.kept else list_append(g.kept, o.vec_id) end from g join o on o.k = g.k + 1), l as (select unnest(kept) as vec_id from g where k = (select max(k) from g)) select vec_id, label from l join embeddings using (vec_id)")
def semantic_dedup(t):
    """Greedy, in the order of the ids: a removed vector removes none."""
    e = t.embeddings.select("vec_id", "embedding", "label")
    return curate.greedy_unique(e, curate.similar_pairs(e, "vec_id", "embedding", 0.5), "vec_id", checkpoint).select("vec_id", "label")


@query("with c as (select lang, count(*) as c from documents group by lang), s as (select sum(c) as t from c) select count(*) as classes, round(-sum(c / t * log2(c / t)) / log2(count(*)), 6) as entropy from c, s")
def entropy(t):
    return metrics.entropy(t.documents, "lang")


@query(f"with {UVO}, d as (select session, rate, rate::decimal(18,6) as r from uv), s as (select session, count(*) as n, count(rate) as known, sum(r)::double as total, sum((r * r)::decimal(38,12))::double as squares, min(rate) as least, max(rate) as most from d group by session) select session, n, known, total, squares, total / nullif(known, 0) as mean, least, most from s")
def distribution(t):
    return metrics.spread(uvo(t), "session", "rate")


@query("with s as (select n_chars as v, row_number() over (order by n_chars) - 1 as k, count(*) over () as n from documents where n_chars is not null) select max(n) as n, min(v) as least, floor((max(case when k = (n - 1) // 2 then v end) + max(case when k = n // 2 then v end)) / 2)::bigint as median, max(v) as most, max(case when k = floor(n * 0.95) then v end) as p95, count(*) filter (where v > 1000) as over_1000, count(*) filter (where v > 10000) as over_10000 from s")
def length_stats(t):
    return metrics.length_stats(t.documents, "n_chars", (1000, 10000))


@query(f"with {HUMAN} select source, count(*) as n, count(*) filter (where retrieval_hit) as hits, count(*) filter (where cited_auto) as cited, round(count(*) filter (where cited_auto and retrieval_hit) / nullif(count(*) filter (where retrieval_hit), 0), 6) as cited_of_hits, round(avg(len(regexp_split_to_array(regexp_replace(response, '^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$', '', 'g'), '[ \\t\\n\\x0b\\f\\r]+'))) filter (where response is not null), 6) as words from hu group by source")
def answer_stats(t):
    """Hits, citations and length of answers by model."""
    h = human(t)
    share = F.try_divide(F.count_if(F.col("cited_auto") & F.col("retrieval_hit")), F.count_if("retrieval_hit"))
    return h.groupBy("source").agg(F.count("*").alias("n"), F.count_if("retrieval_hit").alias("hits"), F.count_if("cited_auto").alias("cited"), F.round(share, 6).alias("cited_of_hits"), F.round(F.avg(F.size(F.split(T.strip(F.col("response")), r"\s+"))), 6).alias("words"))


@query(f"with {HUMAN}, g as (select avg(p - l) as bias, var_samp(p - l) as v1, count(*) as n1 from (select score_useful / 2.0 as l, cited_auto::int as p from hu where score_useful is not null and cited_auto is not null)), r as (select avg(cited_auto::int) as m, var_samp(cited_auto::int) as v2, count(*) as n2 from hu where score_useful is null and cited_auto is not null) select round(greatest(0, least(1, m - bias)), 6) as theta, round(greatest(0, least(1, m - bias - 1.96 * sqrt(v1 / n1 + v2 / n2))), 6) as low, round(greatest(0, least(1, m - bias + 1.96 * sqrt(v1 / n1 + v2 / n2))), 6) as high, n1, n2 from g, r")
def prediction_powered(t):
    """Usefulness from few scores and the automatic citation flag."""
    h = human(t).where("cited_auto is not null").withColumn("predicted", F.col("cited_auto").cast("double"))
    return metrics.prediction_powered(h.where("score_useful is not null").withColumn("label", F.col("score_useful") / 2.0), h.where("score_useful is null"))


@query(f"with {HUMAN}, b as (select avg((retrieval_hit = cited_auto)::int) as po, avg(retrieval_hit::int) as pa, avg(cited_auto::int) as pb, count(*) as n from hu where retrieval_hit is not null and cited_auto is not null), x as (select *, pa * pb + (1 - pa) * (1 - pb) as pe, (pa + pb) / 2 as m from b) select n, round(po, 4) as raw, round((po - pe) / (1 - pe), 4) as kappa, round((po - 2 * m * (1 - m)) / (1 - 2 * m * (1 - m)), 4) as ac1 from x")
def agreement(t):
    return metrics.agreement(human(t), "retrieval_hit", "cited_auto")


@query("select round(exp(least(sum(value * (1 + length(props))) / sum(1 + length(props)) / 100, 20)), 6) as perplexity from events where value is not null")
def perplexity(t):
    """Weighted mean of a loss (here a hundredth of an event's value), as perplexity."""
    e = t.events.where("value is not null").select((F.col("value") / 100).alias("loss"), (1 + F.length("props")).alias("n"))
    return metrics.perplexity(e, "loss", "n")


@query(f"with {UVO} select case when rate < 0.33 then 'easy' when rate < 0.66 then 'medium' when rate is not null then 'hard' else 'unknown' end as band, count(*) as n from uv group by 1")
def difficulty_bands(t):
    return uvo(t).groupBy(metrics.difficulty_band(F.col("rate")).alias("band")).agg(F.count("*").alias("n"))


# -- ordered operators

@query(CELLS + ", x as (select id, row_idx, col_idx, col_name, case when row_idx % 3 = 1 then 'idem' else cell_value end as v from ce) select id, row_idx, col_idx, coalesce(last_value(case when lower(trim(v)) not in ('', 'id.', 'id', 'idem') then v end ignore nulls) over (partition by id, col_idx order by row_idx rows between unbounded preceding and current row), v) as filled from x")
def forward_fill(t):
    """Cells with every third row made 'idem', filled from above."""
    c = cells_of(t).withColumn("cell_value", F.when(F.col("row_idx") % 3 == 1, "idem").otherwise(F.col("cell_value")))
    return tables.forward_fill(c, ["id", "col_idx"], "row_idx").select("id", "row_idx", "col_idx", "filled")


@query(f"with {CHILDREN} select id, source, coalesce(last_value(page ignore nulls) over (partition by source order by id rows between unbounded preceding and current row), min(page) over (partition by source)) as carried from ch")
def page_carry(t):
    return tables.carry_pages(children(t).select("id", "source", "page"), "source", "id", "page").select("id", "source", "carried")


@query("with e as (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as k, event_type = 'purchase' as p from events), n as (select *, case when lag(p) over (partition by user_id order by k) then 1 else 2 end as num from e), g as (select *, sum(case when num = 1 and k > 1 then 1 else 0 end) over (partition by user_id order by k) as sequence from n) select user_id, sequence::bigint as sequence, count(*) as n from g group by all")
def sequences(t):
    """Runs of a user's events; a new one starts after each purchase."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.events.withColumn("k", F.row_number().over(w)).withColumn("num", F.when(F.lag(F.col("event_type") == "purchase").over(w), 1).otherwise(2))
    return tables.sequences(e, "k", "num", "user_id", checkpoint).groupBy("user_id", "sequence").agg(F.count("*").alias("n"))


@query(f"with {CHILDREN}, r as (select id, source, coalesce(page, -1) as page, row_number() over (partition by source, coalesce(page, -1) order by id) as turn from ch), p as (select *, row_number() over (partition by source order by turn, page) as pick from r) select source, id, pick from p where pick <= 20")
def round_robin(t):
    """Twenty passages of each source, from its pages in turn: the feature is the quota."""
    c = children(t).select("id", "source", F.coalesce("page", F.lit(-1)).alias("page"))
    return curate.round_robin(c, "source", "page", [F.col("id")], 20).select("source", "id", "pick")


@query(f"with {CHILDREN}, s as (select source as stratum, case when source like 'RG%' then 'rules' when source like 'AN%' then 'annexes' else 'other' end as class, count(*) as n from ch where source is not null group by source), p as (select *, n / sum(n) over (partition by class) as part, case class when 'rules' then 0.5 when 'annexes' then 0.3 else 0.2 end as share from s) select stratum, class, n, least(greatest(floor(500 * share * part), 5), floor(n * 0.5))::bigint as quota from p")
def quotas(t):
    name = F.when(F.col("source").like("RG%"), "rules").when(F.col("source").like("AN%"), "annexes").otherwise("other")
    strata = children(t).where("source is not null").groupBy(F.col("source").alias("stratum")).agg(F.first(name).alias("class"), F.count("*").alias("n"))
    return curate.quotas(strata, 500, {"rules": 0.5, "annexes": 0.3, "other": 0.2})


@query(f"with {HUMAN}, l as (select id, source, {DRAW.format('id')} as x, count(*) over (partition by source) as c, count(*) over () as total from hu), r as (select *, row_number() over (partition by source order by x, id) as n from l), k as (select * from r where n <= greatest(1, floor(200 * c / total))) select id, source from k order by n, x, id limit 200")
def stratified_sample(t):
    """A sample of 200 answers, each model with its share: the feature is the limit."""
    return curate.stratified(human(t), "source", "id", 200).select("id", "source")


@query("select doc_id, case when row_number() over (order by " + DRAW.format("doc_id") + ", doc_id) <= floor(count(*) over () * 0.8) then 'train' else 'val' end as part from documents")
def split_train_val(t):
    """Exact sizes, drawn by lot."""
    return curate.split(t.documents.select("doc_id"), "doc_id")


@query(f"with {HUMAN}, l as (select id, {DRAW.format('id')} / 1152921504606846976.0 as x from hu) select id, case when x < 0.8 then 'oracle' when x < 0.95 then 'abstain' else 'memorize' end as mode from l")
def answer_modes(t):
    """Each question's mode, drawn in shares of 80, 15 and 5 %."""
    return human(t).select("id", curate.modes(F.col("id"), {"oracle": 0.8, "abstain": 0.15, "memorize": 0.05}).alias("mode"))


@query(f"with {CHILDREN}, {QUESTIONS}, ring as (select id as doc_id, source, page, row_number() over (order by {DRAW.format('id')}, id) - 1 as place, count(*) over () as size from ch), q as (select query_id, source, page, {DRAW.format('query_id')} as x from qs join ch on ch.id = qs.chunk_id), m as (select query_id, doc_id, (place - x % size + size) % size as step from q, ring where ring.source is distinct from q.source or coalesce(abs(ring.page - q.page) > 2, true)) select query_id, doc_id, row_number() over (partition by query_id order by step) as draw from m qualify draw <= 2")
def random_negatives(t):
    """For each held-out question two passages off its page."""
    c = children(t).select(F.col("id").alias("doc_id"), "source", "page")
    q = asked(t).join(c, F.col("chunk_id") == F.col("doc_id")).select("query_id", "source", "page")
    return curate.negatives(q, c, 2, page_gap=2, checkpoint=checkpoint)


@query(f"with {CHILDREN}, s as (select id as doc_id, text, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?]){WS}+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: {stripped('x')}), lambda x: length(x) > 20) as s from ch where text is not null), q as (select doc_id, text, s[({DRAW.format('doc_id')} % len(s) + 1)::int] as query, {DRAW.format("doc_id || '|mask'")} / 1152921504606846976.0 as x from s where len(s) >= 2) select doc_id, query, case when x < 0.9 then trim(regexp_replace(replace(text, query, ''), '[ \\t\\x0b\\f\\r]{{2,}}', ' ', 'g')) else text end as passage from q")
def cloze_pairs(t):
    return curate.cloze_pairs(children(t).select(F.col("id").alias("doc_id"), "text"))


@query(f"with {HUMAN} select id, least((row_number() over (order by id) - 1) // 40, 4)::int as batch from hu")
def review_batches(t):
    return curate.batches(human(t).select("id"), "id")


@query("with o as (select doc_id, n_chars + 1 as n, " + DRAW.format("doc_id") + " as x from documents), p as (select doc_id, n, coalesce(sum(n) over (order by x, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as b, sum(n) over () as total from o), c as (select doc_id, n, b, total, unnest(range((b // 2048)::bigint, ((b + n - 1) // 2048)::bigint + 1)) as sequence from p) select doc_id, sequence, (greatest(b, sequence * 2048) - sequence * 2048)::bigint as at, (least(b + n, (sequence + 1) * 2048) - greatest(b, sequence * 2048))::bigint as n from c where (sequence + 1) * 2048 <= total")
def fixed_length(t):
    """Texts laid end to end and cut every 2,048 characters: all sequences are full."""
    return curate.fixed_length(t.documents, "doc_id", "n_chars", 2048)


# -- text

@query("select id, trim(regexp_replace(translate(lower(question), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '\\s+', ' ', 'g')) as key, " + _repaired_sql("trim(regexp_replace(regexp_replace(nfc_normalize(question), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '[\\s\\x{85}\\p{Z}]+', ' ', 'g'))") + " as clean from (select distinct id, question from human_eval_34q)")
def normalised(t):
    """Keys for comparison, and questions in normal form with mojibake undone."""
    q = t.human_eval_34q.select("id", "question").distinct()
    return q.select("id", T.match_key(F.col("question")).alias("key"), stem.repair(stem.normalize(F.col("question"), "NFC")).alias("clean"))


@query(f"with {CHILDREN}, w as (select id, unnest(list_filter({words_sql('text')}, lambda w: length(w) >= 5)) as word, generate_subscripts(list_filter({words_sql('text')}, lambda w: length(w) >= 5), 1) as pos from ch), c as (select id, word, count(*) as c, min(pos) as first from w group by all) select id as doc_id, word, c as count, row_number() over (partition by id order by c desc, first) as rank from c qualify rank <= 8")
def keyword_topn(t):
    return curate.keyword_counts(children(t).select(F.col("id").alias("doc_id"), "text"), [], 8, 5)


@query(f"with {QUESTIONS}, {CHILDREN}, q as (select query_id, list_distinct(list_filter({words_sql('text')}, lambda w: length(w) >= 5)) as ws from qs), e as (select query_id, len(ws) as n, unnest(ws) as word from q where len(ws) > 0), k as (select distinct id as doc_id, unnest({words_sql('text')}) as word from ch), s as (select query_id, doc_id, round(count(*) / any_value(n), 6) as score from e join k using (word) group by all having round(count(*) / any_value(n), 6) >= 0.2) select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from s qualify rank <= 5")
def keyword_overlap(t):
    q = asked(t).select("query_id", F.filter(T.tokens(F.col("text")), lambda w: F.length(w) >= 5).alias("words"))
    return links.by_words(q, children(t).select(F.col("id").alias("doc_id"), "text"))


@query(f"with s as (select doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?]){WS}+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: {stripped('x')}), lambda x: length(x) > 20) as s from documents where text is not null) select doc_id, len(s) as sentences from s")
def sentence_counts(t):
    return t.documents.where("text is not null").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("sentences"))


@query(f"select doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '\\n{{2,}}'), lambda x: {stripped('x')}), lambda x: length(x) > 40)) as paragraphs, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) as words from documents where text is not null")
def paragraph_counts(t):
    d = t.documents.where("text is not null")
    return d.select("doc_id", F.size(T.paragraphs(F.col("text"))).cast("long").alias("paragraphs"), F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")).cast("long").alias("words"))


@query(f"with {CHILDREN}, {QUESTIONS} select query_id, case when contains(ch.text, '|') and len(list_filter(string_split(ch.text, chr(10)), lambda s: contains(s, '|'))) > len(string_split(ch.text, chr(10))) * 0.3 and length(regexp_replace(ch.text, '\\D', '', 'g')) > 50 then 'table_numeric' when (contains(lower(qs.text), 'que se passe-t-il') or contains(lower(qs.text), 'comment faire') or contains(lower(qs.text), 'qu''est-ce qui')) and length(qs.text) < 50 then 'vague' when len(list_filter(regexp_split_to_array(lower(qs.text), '\\s+'), lambda w: length(w) > 5 and w not in ('quelle','quels','quelles','comment','pourquoi','combien','joueur','joueuse','partie','tournoi','arbitre'))) >= 3 and len(list_filter(regexp_split_to_array(lower(qs.text), '\\s+'), lambda w: length(w) > 5 and w not in ('quelle','quels','quelles','comment','pourquoi','combien','joueur','joueuse','partie','tournoi','arbitre') and contains(lower(ch.text), w))) / len(list_filter(regexp_split_to_array(lower(qs.text), '\\s+'), lambda w: length(w) > 5 and w not in ('quelle','quels','quelles','comment','pourquoi','combien','joueur','joueuse','partie','tournoi','arbitre'))) < 0.2 then 'hallucination' else 'ok' end as reason from qs join ch on ch.id = qs.chunk_id")
def weak_questions(t):
    c = children(t).select(F.col("id").alias("chunk_id"), F.col("text").alias("passage"))
    return asked(t).join(c, "chunk_id").select("query_id", T.weakness(F.col("text"), F.col("passage")).alias("reason"))


@query("select id, case when coalesce(summary_text, '') = '' then 'Tableau' when strpos(summary_text, ':') > 1 and strpos(summary_text, ':') <= 81 then trim(summary_text[1:strpos(summary_text, ':') - 1]) when length(summary_text) <= 80 then trim(summary_text) else trim(case when regexp_extract(summary_text[1:80], '^(.*)\\s', 1) = '' then summary_text[1:80] else regexp_extract(summary_text[1:80], '^(.*)\\s', 1) end) end as title from (select id, any_value(summary_text) as summary_text from table_summaries group by id)")
def table_titles(t):
    return summaries(t).select("id", T.title_before_colon(F.col("summary_text")).alias("title"))


@query(f"with {HUMAN} select source, count(*) filter (where regexp_matches(lower(response), 'non trouv[eé]|pas trouv[eé]|pas dans (le|les) (contexte|extrait)|information.*non.*disponible|ne (se |)trouve pas|ne figure pas|pas mentionn[eé]|aucune information')) as abstained, count(*) filter (where regexp_matches(response, '(?i)article \\d')) as articles from hu group by source")
def abstentions(t):
    return human(t).groupBy("source").agg(F.count_if(T.abstains(F.col("response"))).alias("abstained"), F.count_if(F.col("response").rlike(r"(?i)article \d")).alias("articles"))


@query(f"with {HUMAN}, w as (select id, response, regexp_split_to_array({stripped('response')}, '{WS}+') as ws from hu) select id, case when len(ws) > 12 then array_to_string(list_slice(ws, 1, 12), ' ') || ' [...]' else response end as head from w")
def truncated_words(t):
    return human(t).select("id", T.truncate_words(F.col("response"), 12).alias("head"))


@query(f"with {UVO}, l as (select id, choices, list_filter(string_split(upper(regexp_replace(coalesce(ans, ''), '[^A-Za-z]', '', 'g')), ''), lambda x: x <> '') as ls from uv where choices is not null and ans is not null) select id, array_to_string(list_filter(list_transform(ls, lambda k: choices[k]), lambda x: x is not null), ' | ') as answer from l")
def derived_answers(t):
    u = uvo(t).where("choices is not null and ans is not null")
    return u.select("id", T.answer_text(F.col("ans"), F.col("choices")).alias("answer"))


@query(f"with {HUMAN} select id, 'q:' || substr(md5(question || source), 1, 8) as short_id, case when len(string_split(id, ':')) >= 4 then string_split(id, ':')[3] end as category from hu where question is not null and source is not null")
def question_ids(t):
    h = human(t).where("question is not null and source is not null")
    return h.select("id", T.short_id("q:", F.col("question"), F.col("source")).alias("short_id"), T.id_segment(F.col("id")).alias("category"))


@query(f"with {CHILDREN} select id, coalesce(nullif(regexp_replace(source, '\\.pdf$', ''), ''), source) || case when coalesce(section, '') <> '' then ' > ' || section else '' end as path, nullif(regexp_replace(regexp_extract(text, '^(\\d+(?:\\.\\d+)*\\.?)\\s', 1), '\\.$', ''), '') as article from ch where source is not null and text is not null")
def title_paths(t):
    c = children(t).where("source is not null and text is not null")
    return c.select("id", T.title_path(F.regexp_replace("source", r"\.pdf$", ""), F.col("section"), F.col("source")).alias("path"), T.leading_article(F.col("text")).alias("article"))


@query(f"with {CHILDREN} select id, coalesce(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}} \\t\\n\\x0b\\f\\r]')), 0) as counted, tokens from ch")
def token_counts(t):
    return children(t).select("id", T.token_count(F.col("text")).cast("long").alias("counted"), "tokens")


@query()
def stems(t):
    """The French stem of each word of the questions: only distinct words go through Python."""
    words = t.human_eval_34q.select(F.explode(F.array_distinct(F.filter(F.split(F.lower("question"), T.NOT_WORD), lambda w: w != ""))).alias("word")).distinct()
    return words.select("word", stem.stem(F.col("word")).alias("stem"))


# -- links, tables, documents

@query(f"with {CHILDREN}, {HUMAN}, q as (select id as query_id, unnest(list_distinct(list_concat(list_concat(regexp_extract_all(response, '(?i)article\\s+(\\d+(?:\\.\\d+)*)', 1), regexp_extract_all(response, '(?i)art\\.\\s*(\\d+(?:\\.\\d+)*)', 1)), list_concat(regexp_extract_all(response, '(?i)annexe\\s+(\\d+(?:\\.\\d+)*)', 1), regexp_extract_all(response, '\\b(\\d+\\.\\d+(?:\\.\\d+)*)\\b', 1))))) as number from hu where response is not null), c as (select id as doc_id, regexp_replace(article_num, '\\.$', '') as article from ch where article_num is not null), m as (select query_id, doc_id, number, case when article = number then 100 when starts_with(article, number || '.') then 80 end as score from q join c on string_split(q.number, '.')[1] = string_split(c.article, '.')[1]) select query_id, doc_id, number, score from m where score is not null qualify row_number() over (partition by query_id order by score desc, length(number) desc, doc_id) = 1")
def article_links(t):
    """The passage of the article that an answer names."""
    q = human(t).where("response is not null").select(F.col("id").alias("query_id"), F.col("response").alias("text"))
    return links.by_article(q, children(t).select(F.col("id").alias("doc_id"), "article_num"))


@query()
def chunk_documents(t):
    """Children, parents and tables of all documents."""
    d = t.documents.select(F.concat(F.lit("doc"), F.col("doc_id")).alias("source"), F.col("text").alias("markdown"))
    return chunking.chunk_documents(d)


@query("with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents where text is not null), h as (select *, case when regexp_matches(line, '^#{1,6}[ \\t\\n\\x0b\\f\\r]+[^ \\t\\n\\x0b\\f\\r]') then trim(regexp_replace(line, '^#+[ \\t\\n\\x0b\\f\\r]*', '')) end as h from l), k as (select *, count(*) over (partition by doc_id, h) as n, row_number() over (partition by doc_id, h order by pos) as k from h) select doc_id, string_agg(line, chr(10) order by pos) as text from k where h is null or n < 3 or k = 1 group by doc_id")
def repeated_headings(t):
    return tables.strip_repeated_headings(t.documents.where("text is not null"), "doc_id", "text")


@query(CELLS + f", sa as (select id, row_idx, string_agg(col_name || ' est ' || cell_value, ', ' order by col_idx) as said from ce group by id, row_idx) select sa.id, row_idx, {TITLE} || ' : ' || said as text from sa join ts using (id)")
def narrated_rows(t):
    """Rows as sentences under the title of their table."""
    return tables.narrated(summaries(t))


@query(CELLS + f" select rw.id || '-r' || lpad(row_idx::varchar, 3, '0') as id, rw.id as table_id, {TITLE} || chr(10) || '| ' || array_to_string(list_transform(h[2:len(h)-1], lambda x: trim(x)), ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(string_split(r, '|')[2:len(string_split(r, '|'))-1], lambda x: trim(x)), ' | ') || ' |' as text from rw join ts using (id)")
def row_chunks(t):
    return tables.row_chunks(summaries(t))


#: French connectors by kind.
CONNECTOR_KINDS = {
    "nli_consequent": "par conséquent|en conséquence|par consequent|en consequence",
    "nli_contrast": "cependant|toutefois|néanmoins|en revanche|neanmoins",
    "causal": r"\bcar\b|parce qu|en raison de|du fait de",
    "conditional": "sous réserve|à condition qu|dans le cas où|sauf si|sous reserve|a condition qu|dans le cas ou",
    "reference": "en application de|conformément|au sens de|tel que prévu|en vertu de|conformement|tel que prevu",
    "addition": "de plus|en outre|par ailleurs",
}
#: The same in SQL, where the bounds of words are those of ASCII.
_SQL_KINDS = {k: p.replace(r"\bcar\b", r"(?:^|[^\p{L}\p{N}_])car(?:$|[^\p{L}\p{N}_])") for k, p in CONNECTOR_KINDS.items()}
_FIRST_OF_KIND = " union all ".join(f"select id, paragraph, '{k}' as kind, list_filter(s, lambda x: regexp_matches(x, '(?i){p}'))[1] as sentence from s" for k, p in _SQL_KINDS.items())


@query(f"with {CHILDREN}, p as (select id, list_filter(list_transform(regexp_split_to_array(text, '\\n{{2,}}'), lambda x: {stripped('x')}), lambda x: length(x) > 40) as ps from ch where text is not null), e as (select id, unnest(range(len(ps))) as paragraph, unnest(ps) as p from p), s as (select id, paragraph, list_filter(list_transform(regexp_split_to_array(regexp_replace(p, '([.!?]){WS}+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: {stripped('x')}), lambda x: length(x) > 20) as s from e), f as ({_FIRST_OF_KIND}) select id, paragraph, kind, sentence from f where sentence is not null")
def connector_sentences(t):
    """For each paragraph and kind of connector the first sentence with one."""
    kinds = {k: f"(?iU){p}" for k, p in CONNECTOR_KINDS.items()}
    return curate.connectors(children(t).select(F.col("id").alias("doc_id"), "text"), kinds).withColumnRenamed("doc_id", "id")


# -- migration and exports

@query(f"with {UVO}, l as (select *, list_filter(string_split(upper(regexp_replace(coalesce(ans, ''), '[^A-Za-z]', '', 'g')), ''), lambda x: x <> '') as ls from uv) select id, text as question, nullif(array_to_string(list_filter(list_transform(ls, lambda k: choices[k]), lambda x: x is not null), ' | '), '') as expected_answer, nullif(upper(regexp_extract(coalesce(ans, ''), '([A-Fa-f])', 1)), '') as correct_answer, substr(explanation, 1, 500) as answer_explanation, round_even(case when coalesce(rate, 0) = 0 then 0.5 else 1 - rate end, 2) as difficulty from l")
def nested_questions(t):
    u = uvo(t).select("id", F.col("text").alias("question"), "choices", F.col("ans").alias("letter"), "session", "uv", F.col("q").alias("number"), "rate", "explanation", "source")
    n = migrate.nest_question(u)
    return n.select("id", "content.question", "content.expected_answer", "mcq.correct_answer", "provenance.answer_explanation", F.bround("classification.difficulty", 2).alias("difficulty"))


@query(f"with {UVO} select id, coalesce(nullif(source, ''), 'unknown') as source, coalesce(nullif(ans, ''), '?') as ans, (case when source is null or source = '' then 1 else 0 end + case when ans is null or ans = '' then 1 else 0 end) as corrections from uv")
def filled_defaults(t):
    f = migrate.filled(uvo(t).select("id", "source", "ans"), {"source": F.lit("unknown"), "ans": F.lit("?")})
    return f.select("id", "source", "ans", F.size("corrections").alias("corrections"))


@query(f"with {UVO} select id, source, case when source = 'pdf-text' then 'pdf' when source = 'ocr-scan' then 'scan' else source end as new, case when source in ('pdf-text', 'ocr-scan') then source end as old from uv")
def mapped_sources(t):
    m = migrate.mapped(uvo(t).select("id", F.col("source").alias("new"), "source"), "new", {"pdf-text": "pdf", "ocr-scan": "scan"})
    return m.select("id", "source", "new", "old")


@query(f"with {UVO}, {HUMAN}, p as (select q, session, max(explanation) as e from uv where explanation is not null group by all) select u.id, case when coalesce(length(p.e), 0) > coalesce(length(u.explanation), 0) then p.e else u.explanation end as explanation from uv u left join p on p.q = u.q and p.session = u.session")
def patched_explanations(t):
    """Explanations from another delivery of the same question number, only if longer."""
    u = uvo(t).select("id", "session", "q", "explanation").withColumn("k", F.concat_ws("|", "session", "q"))
    p = u.where("explanation is not null").groupBy("k").agg(F.max("explanation").alias("explanation"))
    return migrate.patched(u, p, "k", longer=["explanation"]).select("id", "explanation")


@query(f"with {SUMMARIES}, pg as (select id, page from ts where page is not null) select ts.id, coalesce(ts.page, (select min(page) from pg where pg.id = regexp_replace(ts.id, '-summary$', ''))) as page from ts")
def filled_pages(t):
    s = summaries(t).select("id", "page")
    return migrate.fill_pages(s, s.where("page is not null"))


def _triplets(t: Tables):
    c = children(t).select(F.col("id").alias("doc_id"), F.col("text").alias("positive"), F.col("section").alias("title"))
    q = asked(t).join(c, F.col("chunk_id") == F.col("doc_id"))
    return q.select(F.col("query_id").alias("pos"), "query_id", F.col("text").alias("anchor"), "doc_id", "title", "positive")


@query(f"with {CHILDREN}, {QUESTIONS} select 'corpus' as part, ch.id, coalesce(section, '') as title, ch.text from (select distinct chunk_id from qs) x join ch on ch.id = x.chunk_id union all select 'queries', query_id, '', qs.text from qs join ch on ch.id = qs.chunk_id union all select 'qrels', query_id, ch.id, '' from qs join ch on ch.id = qs.chunk_id")
def export_beir(t):
    """Corpus, queries and judgements in one long table."""
    files = exports.beir(_triplets(t))
    corpus = files["corpus"].select(F.lit("corpus").alias("part"), F.col("_id").alias("id"), "title", "text")
    queries = files["queries"].select(F.lit("queries").alias("part"), F.col("_id").alias("id"), F.lit("").alias("title"), "text")
    qrels = files["qrels"].select(F.lit("qrels").alias("part"), F.col("query-id").alias("id"), F.col("corpus-id").alias("title"), F.lit("").alias("text"))
    return corpus.unionByName(queries).unionByName(qrels)


@query("select 'query' as side, 0::bigint as n union all select 'corpus', 0")
def export_beir_check(t):
    return exports.dangling(exports.beir(_triplets(t)))


@query(f"with {CHILDREN}, {QUESTIONS} select qs.text as question, '' as answer, ch.text as context, ch.text as ground_truth from qs join ch on ch.id = qs.chunk_id")
def export_ragas(t):
    r = exports.ragas(_triplets(t).withColumn("answer", F.lit(None).cast("string")))
    return r.select("question", "answer", F.col("contexts")[0].alias("context"), "ground_truth")


@query(f"with {HUMAN} select id, 'Contexte : ' || coalesce(source, '') as system, question from hu where question is not null")
def chat_prompts(t):
    h = human(t).where("question is not null").select("id", "question", "source")
    made = h.withColumn("m", T.prompt(F.col("question"), F.coalesce("source", F.lit(""))))
    user = F.col("m")[1]["content"]
    return made.select("id", F.regexp_replace(F.split(user, "\n\n")[0], "^Contexte :\n", "Contexte : ").alias("system"), F.regexp_replace(F.split(user, "\n\nQuestion : ")[1], "^$", "").alias("question"))


# -- streams, over the same table as a batch

@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by all")
def event_windows(t):
    return log.window_counts(t.events, "ts", "event_type", value="value")


@query("with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as f from events), s as (select user_id, ts, sum(f) over (partition by user_id order by ts rows unbounded preceding) as s from e) select user_id, min(ts) as start, max(ts) as \"end\", count(*) as n from s group by user_id, s")
def event_sessions(t):
    return log.sessions(t.events, "user_id", "ts")
