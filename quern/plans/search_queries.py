"""Queries of retrieval, fusion, contexts and metrics.

The query set of text search are all held-out questions (audit_sample_review); that of vector search every vector whose
id is divisible by 100.  Both run against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stem
from ..functions import text as T
from ..operators import context, curate, metrics, retrieval, search, tables
from .registry import Tables, query

#: Terms of questions that ask for a table (one strong, or two weak and a number), and the weight of each.
STRONG = "berger grille scheveningen appariement poussin pupille benjamin minime cadet junior bareme departage coefficient glossaire definition".split()
WEAK = "cadence age elo classement titre norme echiquier frais deplacement distance categorie".split()
INTENT = (
    {"berger": 1.0, "grille": 0.9, "scheveningen": 1.0, "bareme": 0.8, "categorie": 0.7, "cadence": 0.7, "elo": 0.8, "classement": 0.6, "titre": 0.6, "norme": 0.7, "departage": 0.7, "frais": 0.6, "deplacement": 0.5, "coefficient": 0.7, "age": 0.4}
    | dict.fromkeys(("poussin", "pupille", "benjamin", "minime", "cadet", "junior"), 0.5)
    | {"glossaire": 0.3, "definition": 0.3, "equipe": 0.6, "echiquier": 0.5, "joueur": 0.3, "nationale": 0.4}
)

FOLD = "translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"


def words_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array({FOLD.format(c)}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


CHILDREN = "ch as (select id, any_value(text) as text, any_value(embedding) as embedding, any_value(parent_id) as parent_id, any_value(source) as source, any_value(page) as page, any_value(article_num) as article_num, any_value(section) as section, any_value(tokens) as tokens from children group by id)"
PARENTS = "pa as (select id, any_value(text) as text, any_value(source) as source, any_value(section) as section, any_value(page) as page, any_value(tokens) as tokens from parents group by id)"
SUMMARIES = "ts as (select id, any_value(summary_text) as summary_text, any_value(raw_table_text) as raw_table_text, any_value(source) as source, any_value(page) as page, any_value(tokens) as tokens from table_summaries group by id)"
QUESTIONS = "qs as (select id as query_id, any_value(question) as text, any_value(chunk_id) as chunk_id from audit_sample_review group by id)"


def children(t: Tables) -> DataFrame:
    """The last delivery of each child."""
    return retrieval.latest(t.children, "id", F.col("indexed_at").desc())


def parents(t: Tables) -> DataFrame:
    return retrieval.latest(t.parents, "id", F.col("indexed_at").desc())


def summaries(t: Tables) -> DataFrame:
    return t.table_summaries.dropDuplicates(["id"])


def asked(t: Tables) -> DataFrame:
    return t.audit_sample_review.dropDuplicates(["id"]).select(F.col("id").alias("query_id"), F.col("question").alias("text"), "chunk_id")


BM25 = (
    f"with {CHILDREN}, {QUESTIONS}, dw as (select id as doc_id, {words_sql('text')} as ws from ch), "
    "st as (select count(*) as n, avg(coalesce(len(ws), 0)) as mean from dw), "
    f"qt as (select query_id, unnest(list_distinct({words_sql('text')})) as term from qs), "
    "po as (select doc_id, len(ws) as length, unnest(ws) as term from dw), "
    "tf as (select doc_id, length, term, count(*) as tf from po where term in (select term from qt) group by all), "
    "df as (select term, count(*) as df from tf group by term), "
    "wt as (select term, mean, case when n > 2 * df then ln((n - df + 0.5) / (df + 0.5)) else 1e-6 end as idf from df, st), "
    "sc as (select query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) as score from qt join wt using (term) join tf using (term) group by all), "
    "bm as (select query_id, 'bm25' as channel, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from sc qualify rank <= 20)"
)
COSINE = (
    ", us as (select id as doc_id, embedding::double[] as v from ch where len(embedding) = 64), "
    "co as (select query_id, 'cosine' as channel, us.doc_id, round(list_dot_product(a.v, us.v), 6) as score, row_number() over (partition by query_id order by round(list_dot_product(a.v, us.v), 6) desc, us.doc_id) as rank "
    "from qs join us a on a.doc_id = qs.chunk_id, us qualify rank <= 20)"
)
FUSED = (
    ", al as (select *, 0 as place, 1.0 as w from co union all select *, 1, 1.0 from bm), "
    "fu as (select query_id, doc_id, round(sum(w / (60 + rank)), 12) as score, min(place * 1000 + rank) as f from al group by all), "
    "fr as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, f, doc_id) as rank from fu)"
)
ADAPTIVE = (
    ", ins as (select *, score - lead(score) over (partition by query_id order by rank) as gap, count(*) over (partition by query_id) as n from fr where rank <= 10 and score >= 0.005), "
    "gp as (select *, max(gap) over (partition by query_id) as top from ins), "
    "cu as (select *, case when n <= 3 then n else greatest(min(case when gap = top then rank end) over (partition by query_id), 3) end as cut from gp), "
    "ad as (select query_id, doc_id, score, rank from cu where rank <= cut)"
)
CONTEXTS = (
    f", {PARENTS}, hc as (select ad.*, ch.parent_id, ch.text as c_text, ch.source as c_source, ch.page as c_page, pa.text as p_text, pa.source as p_source, pa.page as p_page, "
    "length(trim(coalesce(pa.text, ''))) > 0 as whole from ad join ch on ch.id = ad.doc_id left join pa on pa.id = ch.parent_id), "
    "cg as (select query_id, case when whole then 'parent' else 'child' end as kind, case when whole then parent_id else doc_id end as context_id, max(score) as score, min(rank) as first_rank, count(*) as matched, "
    "coalesce(any_value(p_page), arg_min(c_page, rank) filter (where c_page is not null)) as page, any_value(case when whole then p_source else c_source end) as source from hc group by all), "
    "cx as (select *, row_number() over (partition by query_id order by score desc, first_rank, context_id) as context_rank from cg)"
)


def bm25_hits(t: Tables) -> DataFrame:
    return retrieval.bm25(asked(t), children(t).select(F.col("id").alias("doc_id"), "text"), 20)


def cosine_hits(t: Tables) -> DataFrame:
    c = children(t).where("size(embedding) = 64").select(F.col("id").alias("doc_id"), "embedding")
    q = asked(t).join(c, F.col("chunk_id") == F.col("doc_id")).select("query_id", "embedding")
    return retrieval.vector_topk(q, c, 20)


def fused_hits(t: Tables) -> DataFrame:
    return retrieval.fuse(cosine_hits(t).unionByName(bm25_hits(t)))


def contexts_of(t: Tables) -> DataFrame:
    return context.parent_contexts(retrieval.adaptive_k(fused_hits(t)), children(t), parents(t))


@query(BM25 + " select * from bm")
def bm25_topk(t):
    """Lexical channel."""
    return bm25_hits(t).select("query_id", "channel", "doc_id", "score", "rank")


@query(BM25 + COSINE + " select * from co")
def cosine_topk(t):
    """Vector channel: the vector of the passage that a question refers to."""
    return cosine_hits(t).select("query_id", "channel", "doc_id", "score", "rank")


VEC = "with us as (select vec_id, label, embedding::double[] as v from embeddings), pr as (select a.vec_id as query_id, a.label as q_label, b.vec_id as doc_id, b.label as d_label, round(list_dot_product(a.v, b.v), 6) as score from us a, us b where a.vec_id % 100 = 0), vt as (select query_id, q_label, doc_id, d_label, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from pr where query_id <> doc_id qualify rank <= 20)"


def _vector_hits(t: Tables, k: int = 20) -> DataFrame:
    e = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    q = e.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    return retrieval.vector_topk(q, e, k, exclude_self=True)


@query(VEC + " select query_id, doc_id, score, rank from vt")
def vector_topk(t):
    return _vector_hits(t).select("query_id", "doc_id", "score", "rank")


@query("with us as (select vec_id, label, embedding::double[] as v from embeddings) select a.vec_id as query_id, b.vec_id as doc_id, round(list_dot_product(a.v, b.v), 6) as score, row_number() over (partition by a.vec_id order by round(list_dot_product(a.v, b.v), 6) desc, b.vec_id) as rank from us a, us b where a.vec_id % 100 = 0 and b.label in (1, 3, 5) qualify rank <= 10")
def vector_topk_filtered(t):
    """The filter on labels reaches the scan, before any product."""
    e = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    q = e.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    return retrieval.vector_topk(q, e.where("label in (1, 3, 5)"), 10).select("query_id", "doc_id", "score", "rank")


@query("with us as (select vec_id, embedding[1:32]::double[] as v from embeddings), nm as (select vec_id, v, sqrt(list_dot_product(v, v)) as n from us), s as (select a.vec_id as query_id, b.vec_id as doc_id, round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) as score from nm a, nm b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id) select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s qualify rank <= 5")
def truncated_vector_topk(t):
    """Nested vectors: the first 32 numbers, brought back to length one."""
    e = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.slice("embedding", 1, 32).alias("embedding"))
    q = e.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    return retrieval.vector_topk(q, e, 5, cosine=True, exclude_self=True).select("query_id", "doc_id", "score", "rank")


@query(VEC + ", g as (select query_id, d_label as doc_id, max(score) as score from vt group by all) select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from g qualify rank <= 5")
def max_score_per_group(t):
    groups = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("group_id"))
    return retrieval.best_per_group(_vector_hits(t), groups, 5).select("query_id", "doc_id", "score", "rank")


@query(BM25 + COSINE + FUSED + " select * from fr")
def rrf_fusion(t):
    return fused_hits(t)


@query(BM25 + COSINE + ", al as (select *, 0 as place, 0.7 as w from co union all select *, 1, 0.3 from bm), fu as (select query_id, doc_id, round(sum(w / (60 + rank)), 6) as score, min(place * 1000 + rank) as f from al group by all) select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, f, doc_id) as rank from fu qualify rank <= 5")
def rrf_weighted(t):
    """Two channels of unequal weight, five results."""
    hits = retrieval.fuse(cosine_hits(t).unionByName(bm25_hits(t)), weights={"cosine": 0.7, "bm25": 0.3}, digits=6)
    return hits.where("rank <= 5")


@query(BM25 + COSINE + FUSED + ADAPTIVE + " select * from ad")
def adaptive_k(t):
    return retrieval.adaptive_k(fused_hits(t)).select("query_id", "doc_id", "score", "rank")


@query(BM25 + COSINE + FUSED + ADAPTIVE + CONTEXTS + " select query_id, kind, context_id, score, first_rank, matched, page, source, context_rank from cx")
def hybrid_search(t):
    """From questions to contexts: both channels, fusion, adaptive cut, parents."""
    return contexts_of(t).select("query_id", "kind", "context_id", "score", "first_rank", "matched", "page", "source", "context_rank")


@query(BM25 + COSINE + ", ov as (select query_id, co.doc_id as a, bm.doc_id as b from (select * from co where rank <= 10) co full join (select * from bm where rank <= 10) bm using (query_id, doc_id)) select query_id, count(*) filter (where a is not null and b is not null) as shared, count(*) filter (where b is null) as only_cosine, count(*) filter (where a is null) as only_bm25 from ov group by query_id")
def channel_overlap(t):
    out = retrieval.channel_overlap(cosine_hits(t).unionByName(bm25_hits(t)), "cosine", "bm25")
    return out.select("query_id", *(F.col(c).cast("long").alias(c) for c in ("shared", "only_cosine", "only_bm25")))


HIT = ", ex as (select query_id, ch.source, ch.page from qs join ch on ch.id = qs.chunk_id where ch.page is not null), fp as (select query_id, min(rank) as rank from ad join ch on ch.id = ad.doc_id join ex using (query_id) where ch.source = ex.source and ch.page = ex.page group by query_id), rk as (select query_id, coalesce(fp.rank, 0) as rank from ex left join fp using (query_id))"
RECALL = "round(coalesce(avg((rank > 0 and rank <= 1)::int), 0), 6) as recall_1, round(coalesce(avg((rank > 0 and rank <= 3)::int), 0), 6) as recall_3, round(coalesce(avg((rank > 0 and rank <= 5)::int), 0), 6) as recall_5, round(coalesce(avg((rank > 0 and rank <= 10)::int), 0), 6) as recall_10, round(coalesce(avg(case when rank > 0 then 1.0 / rank else 0 end), 0), 6) as mrr, count(*) as n"


def expected(t: Tables) -> DataFrame:
    c = children(t).select(F.col("id").alias("chunk_id"), "source", "page")
    return asked(t).join(c, "chunk_id").where("page is not null").select("query_id", "source", "page")


def ranks(t: Tables) -> DataFrame:
    pages = children(t).select(F.col("id").alias("doc_id"), "source", "page")
    results = retrieval.adaptive_k(fused_hits(t)).join(pages, "doc_id")
    return metrics.first_hits(results.select("query_id", "rank", "source", "page"), expected(t))


@query(BM25 + COSINE + FUSED + ADAPTIVE + HIT + f" select {RECALL} from rk")
def recall_mrr(t):
    return metrics.recall(ranks(t))


@query(BM25 + COSINE + FUSED + ADAPTIVE + HIT + f", sg as (select rk.*, coalesce(lower(trim(category)), 'none') as category, coalesce(lower(trim(difficulty)), 'none') as difficulty from rk join (select id, any_value(category) as category, any_value(difficulty) as difficulty from audit_sample_review group by id) a on a.id = rk.query_id) select case when grouping(category) = 0 then 'category' when grouping(difficulty) = 0 then 'difficulty' else 'all' end as segment, case when grouping(category) = 0 then category when grouping(difficulty) = 0 then difficulty else 'all' end as value, {RECALL} from sg group by grouping sets ((), (category), (difficulty))")
def recall_segments(t):
    """All segments in one pass of grouping sets."""
    a = t.audit_sample_review.groupBy(F.col("id").alias("query_id")).agg(*(F.coalesce(F.lower(F.trim(F.min(c))), F.lit("none")).alias(c) for c in ("category", "difficulty")))
    return metrics.recall(ranks(t).join(a, "query_id"), ["category", "difficulty"])


@query(BM25 + COSINE + FUSED + HIT.replace(", fp as (select query_id, min(rank) as rank from ad join ch on ch.id = ad.doc_id join ex using (query_id) where ch.source = ex.source and ch.page = ex.page group by query_id), rk as (select query_id, coalesce(fp.rank, 0) as rank from ex left join fp using (query_id))", "") + ", mt as (select distinct query_id from fr join ch on ch.id = fr.doc_id join ex using (query_id) where fr.rank <= 5 and ch.source = ex.source and abs(ch.page - ex.page) <= 2) select query_id, case when mt.query_id is null then 0.0 else 1.0 end::double as recall from ex left join mt using (query_id)")
def tolerant_recall(t):
    """Pages within two of the expected one count."""
    pages = children(t).select(F.col("id").alias("doc_id"), "source", "page")
    results = fused_hits(t).join(pages, "doc_id").where("page is not null")
    return metrics.tolerant_recall(results, expected(t), 5, 2)


@query(BM25 + COSINE + ", ws as (select unnest([0.0, 0.2, 0.3, 0.5, 0.8, 1.0]) as weight), al as (select weight, c.*, 0 as place, 1.0 as w from ws, co c union all select weight, b.*, 1, weight from ws, bm b), fu as (select weight, query_id, doc_id, round(sum(w / (60 + rank)), 12) as score, min(place * 1000 + rank) as f from al group by all), fr as (select weight, query_id, doc_id, row_number() over (partition by weight, query_id order by score desc, f, doc_id) as rank from fu), ex as (select query_id, ch.source, ch.page from qs join ch on ch.id = qs.chunk_id where ch.page is not null), h as (select weight, query_id, min(rank) as r from fr join ch on ch.id = fr.doc_id join ex using (query_id) where ch.source = ex.source and ch.page = ex.page group by all) select weight::double as weight, round(avg((coalesce(r, 99) <= 5)::int), 6) as recall_5, round(avg(coalesce(1.0 / r, 0)), 6) as mrr, count(*) as n from ws cross join ex left join h using (weight, query_id) group by weight")
def weight_sweep(t):
    """Recall under several weights of a channel, in one plan: the lists are made once."""
    hits = cosine_hits(t).unionByName(bm25_hits(t))
    weights = [0.0, 0.2, 0.3, 0.5, 0.8, 1.0]
    spread = hits.withColumn("weight", F.explode(F.array(*map(F.lit, weights))))
    w = F.when(F.col("channel") == "bm25", F.col("weight")).otherwise(1.0)
    first = F.struct(F.when(F.col("channel") == "cosine", 0).otherwise(1).alias("c"), F.col("rank").alias("r"))
    fused = spread.groupBy("weight", "query_id", "doc_id").agg(F.round(F.sum(w / (60 + F.col("rank"))), 12).alias("score"), F.min(first).alias("f"))
    placed = fused.withColumn("rank", F.row_number().over(Window.partitionBy("weight", "query_id").orderBy(F.col("score").desc(), "f", "doc_id")))
    pages = children(t).select(F.col("id").alias("doc_id"), "source", "page")
    e = expected(t)
    found = placed.join(pages, "doc_id").join(e, ["query_id", "source", "page"]).groupBy("weight", "query_id").agg(F.min("rank").alias("r"))
    every = e.withColumn("weight", F.explode(F.array(*map(F.lit, weights))))
    return every.join(found, ["weight", "query_id"], "left").groupBy("weight").agg(F.round(F.avg((F.coalesce("r", F.lit(99)) <= 5).cast("int")), 6).alias("recall_5"), F.round(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 6).alias("mrr"), F.count("*").alias("n"))


@query(BM25 + f", bad as (select * from ch where page in (1, 100)) select query_id, doc_id, score, rank from bm where doc_id not in (select id from bad)")
def page_filter(t):
    """Hits without those on cover and title pages; unknown pages stay."""
    where = children(t).select(F.col("id").alias("doc_id"), "source", "page")
    pages = where.where("page in (1, 100)").select("source", "page").distinct()
    return retrieval.drop_pages(bm25_hits(t), where, pages).select("query_id", "doc_id", "score", "rank")


@query(BM25 + ", pl as (select bm.query_id, bm.doc_id, score, ch.source like 'RG%' as preferred from bm join ch on ch.id = bm.doc_id), lt as (select query_id, doc_id, round(score * case when preferred then 1.5 else 1 end, 4) as score, preferred, row_number() over (partition by query_id order by round(score * case when preferred then 1.5 else 1 end, 4) desc, doc_id) as rank from pl qualify rank <= 5), hp as (select query_id from lt group by query_id having bool_or(preferred)), rs as (select query_id, doc_id, round(score, 4) as score, preferred, row_number() over (partition by query_id order by round(score, 4) desc, doc_id) as rank from pl where query_id not in (select query_id from hp) qualify rank <= 5) select query_id, doc_id, score, rank, false as fallback from lt where query_id in (select query_id from hp) union all select query_id, doc_id, score, rank, true from rs")
def boosted_search(t):
    """Regulations weigh more; questions that find none keep their plain list."""
    sources = children(t).select(F.col("id").alias("doc_id"), "source")
    hits = bm25_hits(t).join(sources, "doc_id")
    return retrieval.boosted(hits, F.startswith(F.col("source"), F.lit("RG")), 1.5, 5).select("query_id", "doc_id", "score", "rank", "fallback")


RULES = {"coupe": "RG04_Coupe_departementale.pdf", "blitz": "RG07_Blitz_par_equipes.pdf", "scolaire": "RG10_Scolaire_ecoles.pdf"}


@query(f"with {QUESTIONS} select query_id, case when contains(lower(text), 'coupe') then 'RG04_Coupe_departementale.pdf' when contains(lower(text), 'blitz') then 'RG07_Blitz_par_equipes.pdf' when contains(lower(text), 'scolaire') then 'RG10_Scolaire_ecoles.pdf' end as source from qs")
def source_routing(t):
    return asked(t).select("query_id", retrieval.route(F.col("text"), RULES).alias("source"))


@query("select id, text from (select distinct id, text, source from parents) where contains(lower(source), 'coupe')")
def source_filter(t):
    return retrieval.source_filter(t.parents, "Coupe").select("id", "text").distinct()


WEIGHTS_SQL = "[" + ", ".join(f"{{'w': '{w}', 'x': {x}}}" for w, x in INTENT.items()) + "]"


@query(f"with hq as (select distinct id, question from human_eval_34q), iw as (select unnest({WEIGHTS_SQL}) as k), s as (select id, question, {words_sql('question')} as ws from hq) select id, round(least(coalesce((select sum(k.x) from iw where list_contains(ws, k.w)), 0) + case when regexp_matches(question, '\\b\\d{{3,4}}\\b') then 0.5 else 0 end, 3.0), 6)::double as intent, len(list_filter({STRONG}, lambda x: contains(lower(question), x))) >= 1 or (len(list_filter({WEAK}, lambda x: contains(lower(question), x))) >= 2 and regexp_matches(question, '\\b\\d{{3,4}}\\b')) as triggered from s")
def table_intent(t):
    """Whether and how much a question asks for a table."""
    q = t.human_eval_34q.select("id", "question").distinct()
    return q.select("id", F.round(T.intent(F.col("question"), INTENT), 6).alias("intent"), T.triggers(F.col("question"), STRONG, WEAK).alias("triggered"))


CELLS = (
    f"with {SUMMARIES}, li as (select id, list_filter(list_transform(regexp_split_to_array(raw_table_text, '\\r?\\n'), lambda s: trim(regexp_replace(regexp_replace(s, '\\.{{3,}}', '', 'g'), '\\s{{2,}}', ' ', 'g'))), lambda s: regexp_matches(s, '^\\|.*\\|$') and not regexp_full_match(s, '\\s*\\|?[\\s:|-]*-[\\s:|-]*')) as l from ts), "
    "rw as (select id, string_split(l[1], '|') as h, unnest(l[2:]) as r, unnest(range(0, greatest(len(l) - 1, 0)))::int as row_idx from li where len(l) > 1), "
    "sp as (select id, row_idx, list_transform(h[2:len(h)-1], lambda x: trim(x)) as h, list_transform(string_split(r, '|')[2:len(string_split(r, '|'))-1], lambda x: trim(x)) as v from rw), "
    "al as (select id, row_idx, unnest(range(0, greatest(len(h), len(v))))::int as col_idx, h, v from sp), "
    "ce as (select id, row_idx, col_idx, h[col_idx + 1] as col_name, v[col_idx + 1] as cell_value from al where h[col_idx + 1] is not null and v[col_idx + 1] <> '')"
)


def cells_of(t: Tables) -> DataFrame:
    return tables.cells(summaries(t).select("id", "raw_table_text"))


TERMS = "list_slice(list_filter(regexp_split_to_array(lower(question), '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 4), 1, 10)"


@query(CELLS + f", hq as (select distinct id as query_id, question from human_eval_34q), qt as (select distinct query_id, {FOLD.format('term')} as term from (select query_id, unnest({TERMS}) as term from hq)), cw as (select distinct id, row_idx, col_idx, unnest({words_sql('cell_value')}) as word, 1.0 as worth from ce), hw as (select distinct id, row_idx, col_idx, unnest({words_sql('col_name')}) as word, 0.5 as worth from ce), mt as (select distinct query_id, id, row_idx, col_idx, worth from (select * from cw union all select * from hw) c join qt on starts_with(c.word, qt.term)), sc as (select query_id, id as doc_id, sum(worth)::double as score from mt group by all having sum(worth) >= 2) select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from sc qualify rank <= 5")
def cell_search(t):
    """Tables by cells, for all questions of the answer review; prefix matches by an equi-join on first letters."""
    q = t.human_eval_34q.select(F.col("id").alias("query_id"), F.col("question").alias("text")).distinct()
    cells = cells_of(t).withColumnRenamed("id", "table_id")
    return retrieval.cell_search(q, cells, 5).select("query_id", "doc_id", "score", "rank")


@query(CELLS + " select * from ce")
def unpivot_cells(t):
    return cells_of(t)


@query(f"with {CHILDREN} select source, page, string_agg(text, chr(10) || chr(10) order by id) as text, count(*) as passages from ch where page is not null and text is not null group by source, page")
def page_texts(t):
    return context.page_texts(children(t))


@query(BM25 + COSINE + FUSED + ADAPTIVE + CONTEXTS + f", {SUMMARIES}, ar as (select distinct query_id, source, unnest([page - 1, page, page + 1]) as page from cx where page is not null) select distinct query_id, ts.id from ar join ts using (source, page) where page >= 1")
def neighbour_pages(t):
    """Tables beside the contexts: the band of three pages is an equi-join."""
    c = contexts_of(t).where("page is not null")
    band = c.select("query_id", "source", F.explode(F.sequence(F.greatest(F.lit(1), F.col("page") - 1), F.col("page") + 1)).alias("page")).distinct()
    return band.join(summaries(t).select("id", "source", "page"), ["source", "page"]).select("query_id", "id").distinct()


@query(
    BM25 + COSINE + FUSED + ADAPTIVE + CONTEXTS + f", {SUMMARIES}, ar as (select distinct query_id, source, unnest(range(greatest(1, page - 1), page + 2)) as page from cx where page is not null), lo as (select query_id, min(score) / 2 as score from cx group by query_id), "
    "ot as (select source, page, arg_min(id, id) as id, arg_min(raw_table_text, id) as text from ts where page is not null group by source, page), nt as (select query_id, source, page, id, len(regexp_split_to_array(trim(text), '[ \\t\\n\\x0b\\f\\r]+')) as words from ar join ot using (source, page)), "
    "og as (select query_id, list({'ids': [id], 'used': words::bigint} order by source, page, id) as found from nt group by query_id), "
    "tk as (select query_id, list_reduce(found, lambda a, x: case when a.used + x.used <= 500 then {'ids': list_concat(a.ids, x.ids), 'used': a.used + x.used} else a end, {'ids': []::varchar[], 'used': 0::bigint}).ids as ids from og) "
    "select query_id, unnest(range(len(ids)))::int as position, unnest(ids) as id, score from tk join lo using (query_id)"
)
def neighbour_tables(t):
    """The same under a budget of words for each question."""
    beside = summaries(t).select("id", F.col("raw_table_text").alias("text"), "source", "page").where("page is not null")
    return context.neighbour_tables(contexts_of(t), beside)


@query(VEC + ", hn as (select query_id, doc_id, score, score >= 0.3 as in_window, row_number() over (partition by query_id order by (score >= 0.3) desc, score desc, doc_id) as n from vt where q_label <> d_label and score <= 0.9) select query_id, doc_id, score, in_window from hn where n = 1")
def hard_negatives(t):
    """The best neighbour of another label within a window of scores."""
    label = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("source"), F.lit(1).alias("page"))
    hits = _vector_hits(t).join(label, "doc_id")
    positives = label.withColumnRenamed("doc_id", "query_id")
    return curate.hard_negatives(hits, positives, 0.3, 0.9)


# -- the whole search

#: Pages without content of their own (a parameter of the search), and the sources whose tables are targeted.
INTRO = [("RG01_Reglement_general_ligue.pdf", 1), ("LV01_Livret_arbitre_club.pdf", 1), ("LV01_Livret_arbitre_club.pdf", 100)]
TARGETED = "AN"


def collection(t: Tables) -> search.Collection:
    """Passages and tables.  Rows of tables have the vector of their table; those of annexes are targeted as well."""
    c, s = children(t), summaries(t)
    texts = (c.select(F.col("id").alias("doc_id"), "text"), s.select(F.col("id").alias("doc_id"), F.col("summary_text").alias("text")))
    usable = "size(embedding) = 64"
    vectors = c.where(usable).select(F.col("id").alias("doc_id"), "embedding").unionByName(s.where(usable).select(F.col("id").alias("doc_id"), "embedding"))
    cells = cells_of(t)
    rows = cells.select("id", "row_idx").distinct().join(s.where(usable).select("id", "embedding", "source"), "id")
    row_id = lambda mark: F.concat("id", F.lit(mark), F.lpad(F.col("row_idx").cast("string"), 3, "0")).alias("doc_id")
    targeted = rows.where(F.startswith("source", F.lit(TARGETED)))
    places = c.select(F.col("id").alias("doc_id"), "source", "page").unionByName(s.select(F.col("id").alias("doc_id"), "source", "page"))
    return search.Collection(texts, vectors, cells.withColumnRenamed("id", "table_id"), rows.select(row_id("-r"), "embedding"), targeted.select(row_id("-tr"), "embedding"), places)


def _searched(t: Tables, intent: dict[str, float], normalise=None) -> DataFrame:
    vector = children(t).where("size(embedding) = 64").select(F.col("id").alias("chunk_id"), "embedding")
    queries = asked(t).join(vector, "chunk_id", "left").select("query_id", "text", "embedding")
    intro = t.spark.createDataFrame(INTRO, "source string, page int")
    return search.search(queries, collection(t), intent, intro, normalise=normalise)


def _bm25_sql(p: str, docs: str) -> str:
    """BM25 lists of 20 as CTEs whose names begin with p; docs: doc_id, text."""
    return (
        f"{p}dw as (select doc_id, {words_sql('text')} as ws from ({docs})), {p}st as (select count(*) as n, avg(coalesce(len(ws), 0)) as mean from {p}dw), "
        f"{p}po as (select doc_id, len(ws) as length, unnest(ws) as term from {p}dw), {p}tf as (select doc_id, length, term, count(*) as tf from {p}po where term in (select term from qt) group by all), "
        f"{p}df as (select term, count(*) as df from {p}tf group by term), {p}wt as (select term, mean, case when n > 2 * df then ln((n - df + 0.5) / (df + 0.5)) else 1e-6 end as idf from {p}df, {p}st), "
        f"{p}sc as (select query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) as score from qt join {p}wt using (term) join {p}tf using (term) group by all), "
        f"{p}bm as (select query_id, doc_id, score from {p}sc qualify row_number() over (partition by query_id order by score desc, doc_id) <= 20)"
    )


def _vectors_sql(name: str, docs: str, k: int, asks: str = "qv") -> str:
    return f"{name} as (select query_id, '{name}' as channel, d.doc_id, row_number() over (partition by query_id order by round(list_dot_product(q.v, d.v), 6) desc, d.doc_id) as rank from {asks} q, {docs} d qualify rank <= {k})"


FULL = ", ".join(
    [
        CELLS,
        CHILDREN,
        QUESTIONS,
        "tv as (select id, any_value(embedding)::double[] as v, any_value(source) as source from table_summaries where len(embedding) = 64 group by id)",
        f"qt as (select query_id, unnest(list_distinct({words_sql('text')})) as term from qs)",
        _bm25_sql("c", "select id as doc_id, text from ch"),
        _bm25_sql("s", "select id as doc_id, summary_text as text from ts"),
        "bm25 as (select query_id, 'bm25' as channel, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank from (select * from cbm union all select * from sbm) qualify rank <= 20)",
        "av as (select id as doc_id, embedding::double[] as v from ch where len(embedding) = 64 union all select id, v from tv)",
        "qv as (select query_id, av.v from qs join av on av.doc_id = qs.chunk_id join ch on ch.id = qs.chunk_id)",
        f"iw as (select unnest({WEIGHTS_SQL}) as k)",
        f"qw as (select query_id, text, {words_sql('text')} as ws from qs)",
        "qi as (select query_id, round(least(coalesce((select sum(k.x) from iw where list_contains(ws, k.w)), 0) + case when regexp_matches(text, '\\b\\d{3,4}\\b') then 0.5 else 0 end, 3.0), 6)::double as intent from qw)",
        "qg as (select * from qv where query_id in (select query_id from qi where intent > 0))",
        "rv as (select distinct ce.id || '-r' || lpad(row_idx::varchar, 3, '0') as doc_id, v from ce join tv using (id))",
        f"gv as (select distinct ce.id || '-tr' || lpad(row_idx::varchar, 3, '0') as doc_id, v from ce join tv using (id) where starts_with(source, '{TARGETED}'))",
        _vectors_sql("cosine", "av", 20),
        _vectors_sql("rows", "rv", 10),
        _vectors_sql("targeted", "gv", 10, "qg"),
        f"cq as (select distinct query_id, {FOLD.format('term')} as term from (select query_id, unnest({TERMS.replace('question', 'text')}) as term from qs where query_id in (select query_id from qi where intent > 0)))",
        f"cw as (select distinct id, row_idx, col_idx, unnest({words_sql('cell_value')}) as word, 1.0 as worth from ce)",
        f"hw as (select distinct id, row_idx, col_idx, unnest({words_sql('col_name')}) as word, 0.5 as worth from ce)",
        "mt as (select distinct query_id, id, row_idx, col_idx, worth from (select * from cw union all select * from hw) c join cq on starts_with(c.word, cq.term))",
        "cs as (select query_id, id as doc_id, sum(worth)::double as score from mt group by all having sum(worth) >= 2)",
        "structured as (select query_id, 'structured' as channel, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank from cs qualify rank <= 5)",
        "ac as (select *, 0 as place, 1.0 as fixed from cosine union all select *, 1, 1.0 from bm25 union all select *, 2, null from structured union all select *, 3, 0.5 from rows union all select *, 5, null from targeted)",
        "lw as (select ac.*, coalesce(fixed, case when intent < 0.3 then 0 when channel = 'structured' then least(1.5 * intent, 1.5) else least(intent, 1.0) end)::double as w from ac join qi using (query_id))",
        "fu as (select query_id, doc_id, round(sum(w / (60 + rank)), 12) as score, min(place * 1000 + rank) as f from lw group by all)",
        "pl as (select id as doc_id, source, page from ch union all select id, source, page from ts)",
        "bad as (select doc_id from pl where " + " or ".join(f"source = '{s}' and page = {n}" for s, n in INTRO) + ")",
        "fr as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, f, doc_id) as rank from fu where doc_id not in (select doc_id from bad))",
    ]
)


@query()
def full_search(t):
    """All channels over stems, to the ids that contexts are made of."""
    return _searched(t, stem.heaviest(INTENT), stem.stem_words)


@query(FULL + ADAPTIVE + " select * from ad")
def full_search_unstemmed(t):
    """The same over words as they are, which SQL can say too."""
    return _searched(t, INTENT)


@query(FULL + " select query_id, channel, doc_id, rank, w as weight from lw")
def search_channels(t):
    """The five lists of each question, with the weights of the two that depend on it."""
    c = collection(t)
    vector = children(t).where("size(embedding) = 64").select(F.col("id").alias("chunk_id"), "embedding")
    queries = asked(t).join(vector, "chunk_id", "left").select("query_id", "text", "embedding")
    fixed = F.when(F.col("channel") == "rows", 0.5).otherwise(1.0)
    return search.channels(queries, c, search.table_weights(queries, INTENT)).withColumn("weight", F.coalesce("weight", fixed))


def _items(t: Tables) -> DataFrame:
    """Whatever a search may find, as passages; tables and their rows have no parent."""
    c, s = children(t).select("id", "parent_id", "text", "source", "section", "page"), summaries(t)
    none = F.lit(None).cast("string")
    of_table = s.select("id", none.alias("parent_id"), F.col("summary_text").alias("text"), "source", none.alias("section"), "page")
    rows = cells_of(t).select("id", "row_idx").distinct().join(s.select("id", "summary_text", "source", "page"), "id")
    mark = F.explode(F.array(F.lit("-r"), F.lit("-tr")))
    of_row = rows.select("*", mark.alias("mark")).select(F.concat("id", "mark", F.lpad(F.col("row_idx").cast("string"), 3, "0")).alias("id"), none.alias("parent_id"), F.col("summary_text").alias("text"), "source", none.alias("section"), "page")
    return c.unionByName(of_table).unionByName(of_row)


@query(
    FULL
    + ADAPTIVE
    + ", it as (select id, parent_id, text, source, page from ch union all select id, null, summary_text, source, page from ts union all select distinct ce.id || m || lpad(row_idx::varchar, 3, '0'), null, summary_text, source, page from ce join ts using (id), (select unnest(['-r', '-tr']) as m))"
    + CONTEXTS.replace("ch.", "it.").replace("join ch on", "join it on")
    + " select query_id, kind, context_id, score, first_rank, matched, page, source, context_rank from cx"
)
def full_search_contexts(t):
    """From questions through all channels to contexts: parents, and tables and rows as they are."""
    found = context.parent_contexts(_searched(t, INTENT), _items(t), parents(t))
    return found.select("query_id", "kind", "context_id", "score", "first_rank", "matched", "page", "source", "context_rank")
