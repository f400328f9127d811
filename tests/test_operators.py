"""Literal cases of the operators, with nulls, empty tables, ties and columns whose names clash."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quern.functions import stem, text as T
from quern.operators import chunking, context, curate, gates, links, metrics, migrate, retrieval, tables
from quern.session import checkpoint
from quern.sources import exports, readers
from quern.streaming import log


def column(spark, value, expression):
    return spark.createDataFrame([Row(c=value)], "c string").select(expression(F.col("c")).alias("x")).first().x


def hits(spark, scores, channel="cosine"):
    return spark.createDataFrame([("q", channel, d, s, n) for n, (d, s) in enumerate(scores, 1)], "query_id string, channel string, doc_id string, score double, rank int")


@pytest.mark.parametrize("least,buffer,expected", [(3, 0, 3), (1, 0, 2), (1, 1, 3)])
def test_adaptive_k_cuts_at_the_first_largest_gap(spark, least, buffer, expected):
    h = hits(spark, zip("abcd", (0.9, 0.85, 0.5, 0.45)))
    assert retrieval.adaptive_k(h, least=least, buffer=buffer).count() == expected


def test_adaptive_k_without_scores_or_rows(spark):
    assert retrieval.adaptive_k(hits(spark, zip("abcd", (0.001, 0.001, 0.001, 0.001)))).count() == 0
    assert retrieval.adaptive_k(hits(spark, [("a", 0.5)]).limit(0)).count() == 0
    assert retrieval.adaptive_k(hits(spark, zip("abcd", (0.9, 0.85, 0.8, 0.1)))).count() == 3


def test_fusion_adds_reciprocal_ranks_and_breaks_ties_by_channel(spark):
    both = hits(spark, [("a", 0.9), ("b", 0.8)]).unionByName(hits(spark, [("b", 3.0), ("c", 2.0)], "bm25"))
    got = [(r.doc_id, r.score) for r in retrieval.fuse(both).orderBy("rank").collect()]
    assert got == [("b", round(1 / 62 + 1 / 61, 12)), ("a", round(1 / 61, 12)), ("c", round(1 / 62, 12))]
    zero = retrieval.fuse(both, weights={"cosine": 1.0, "bm25": 0.0})
    assert zero.where("doc_id = 'c'").first().score == 0


def test_bm25_in_one_slice_and_in_several(spark):
    docs = spark.createDataFrame([("a", "le forfait du joueur"), ("b", "Forfait ! forfait sportif"), ("c", "la pendule"), ("d", None), ("e", "")], "doc_id string, text string").withColumn("score", F.lit(1))
    queries = spark.createDataFrame([("q", "forfait sportif"), ("r", None), ("s", "absent")], "query_id string, text string")
    one, two = (retrieval.bm25(queries, docs, 5, slice_pairs=n).select("query_id", "doc_id", "score", "rank").collect() for n in (100, 2))
    assert sorted(one) == sorted(two)
    assert [r.doc_id for r in sorted(one, key=lambda r: r.rank)] == ["b", "a"]
    assert retrieval.bm25(queries, docs.limit(0)).count() == 0
    assert retrieval.bm25(queries.limit(0), docs).count() == 0


def test_search_stems_words_and_weighs_channels(spark):
    from quern.operators import search

    texts = spark.createDataFrame([("a", "les chevaux du joueur"), ("b", "la tour"), ("c", "un barème de départages"), ("d", None), ("e", "titre"), ("f", "autre"), ("g", "encore")], "doc_id string, text string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "doc_id string, embedding array<double>")
    rows = spark.createDataFrame([("t-r000", [1.0, 0.0])], "doc_id string, embedding array<double>")
    cells = spark.createDataFrame([("t", "barème", "départage un"), ("t", "barème", "départage deux"), ("u", "x", "y")], "table_id string, col_name string, cell_value string")
    places = spark.createDataFrame([("a", "s", 1), ("b", "s", 2), ("t", "s", 3)], "doc_id string, source string, page int")
    c = search.Collection((texts, texts.limit(0)), vectors, cells, rows, rows.withColumn("doc_id", F.lit("t-tr000")), places)
    queries = spark.createDataFrame([("q", "cheval", [0.0, 1.0]), ("r", "quel barème de départage ?", None), ("s", None, None)], "query_id string, text string, embedding array<double>")
    weights = {"bareme": 0.8, "departage": 0.7}
    intent = {r.query_id: (r.intent, r.structured, r.targeted) for r in search.table_weights(queries, stem.heaviest(weights), stem.stem_words).collect()}
    assert intent["q"] == (0.0, 0.0, 0.0) and intent["r"] == (1.5, 1.5, 1.0)
    intro = spark.createDataFrame([("s", 2)], "source string, page int")
    hits = search.search(queries, c, stem.heaviest(weights), intro, normalise=stem.stem_words).orderBy("query_id", "rank").collect()
    found = {q: [r.doc_id for r in hits if r.query_id == q] for q in "qrs"}
    # b is the nearest, but on a page without content; "cheval" finds "chevaux" by its stem only
    assert found["q"][0] == "a" and "b" not in found["q"] and found["r"][0] == "t" and "c" in found["r"] and found["s"] == []
    plain = search.search(queries, c, weights, intro)
    assert {r.doc_id for r in plain.where("query_id = 'q' and rank = 1").collect()} == {"a"}
    listed = search.channels(queries, c, search.table_weights(queries, weights)).collect()
    assert {r.channel for r in listed if r.query_id == "q"} == {"cosine", "rows"}
    assert {r.channel for r in listed if r.query_id == "r"} == {"bm25", "structured"}


def test_stems_of_word_lists(spark):
    df = spark.createDataFrame([(["chevaux", None, "1.2"],), (None,), ([],)], "ws array<string>")
    assert [r[0] for r in df.select(stem.stem_words(F.col("ws"))).collect()] == [["cheval", None, "1.2"], None, []]
    assert stem.heaviest({"joueur": 0.3, "joueurs": 0.5}) == {stem.stem_word("joueur"): 0.5}


def test_vector_topk_with_ties_nulls_and_no_rows(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [])], "doc_id long, embedding array<float>")
    q = docs.withColumnRenamed("doc_id", "query_id")
    got = retrieval.vector_topk(q, docs, 2, block=2)
    assert [r.doc_id for r in got.where("query_id = 1").orderBy("rank").collect()] == [1, 2]
    assert retrieval.vector_topk(q, docs, 2, exclude_self=True).where("query_id = 1 and rank = 1").first().doc_id == 2
    assert retrieval.vector_topk(q, docs.limit(0), 2).count() == 0
    assert retrieval.vector_topk(q.limit(0), docs, 2).count() == 0


def test_cell_search_needs_two_points(spark):
    cells = spark.createDataFrame([("t1", "Catégorie", "poussin 50 min"), ("t1", "Cadence", "poussins"), ("t2", "Catégorie", "poussin")], "table_id string, col_name string, cell_value string")
    q = spark.createDataFrame([("q", "Quelle cadence pour un poussin ?")], "query_id string, text string")
    got = retrieval.cell_search(q, cells)
    assert [(r.doc_id, r.score) for r in got.collect()] == [("t1", 2.5)]
    assert retrieval.cell_search(q, cells, prefix=False).first().doc_id == "t1"
    assert retrieval.cell_search(q, cells.limit(0)).count() == 0


def test_page_filter_keeps_unknown_ids_and_pages(spark):
    where = spark.createDataFrame([("a", "s", 1), ("b", "s", None), ("c", "s", 2)], "doc_id string, source string, page int")
    pages = spark.createDataFrame([("s", 1)], "source string, page int")
    left = retrieval.drop_pages(hits(spark, [("a", 1.0), ("b", 0.9), ("c", 0.8), ("x", 0.7)]), where, pages)
    assert {r.doc_id for r in left.collect()} == {"b", "c", "x"}
    assert retrieval.first_of(where.limit(1), where).where("doc_id = 'a'").count() == 1


def test_contexts_fall_back_to_children_of_empty_parents(spark):
    children = spark.createDataFrame([("c1", "p1", "un", "s", "A", None), ("c2", "p1", "deux", "s", "A", 7), ("c3", "p2", "trois", "s", None, 3), ("c4", None, "quatre", "s", None, None)], "id string, parent_id string, text string, source string, section string, page int")
    parents = spark.createDataFrame([("p1", "un deux", "s", "A", None), ("p2", " ", "s", None, None)], "id string, text string, source string, section string, page int")
    got = context.parent_contexts(hits(spark, [("c3", 0.9), ("c1", 0.8), ("c2", 0.7), ("c4", 0.1)]), children, parents).orderBy("context_rank").collect()
    assert [(r.context_id, r.kind, r.page, r.matched) for r in got] == [("c3", "child", 3, 1), ("p1", "parent", 7, 2), ("c4", "child", None, 1)]


def test_neighbour_tables_skip_what_exceeds_the_budget(spark):
    contexts = spark.createDataFrame([("q", "s", 2, 0.8)], "query_id string, source string, page int, score double")
    t = spark.createDataFrame([("t1", "a " * 400, "s", 1), ("t2", "b " * 200, "s", 2), ("t3", "c " * 90, "s", 3), ("t4", "d", "s", 9)], "id string, text string, source string, page int")
    got = context.neighbour_tables(contexts, t).orderBy("position").collect()
    assert [(r.id, r.score) for r in got] == [("t1", 0.4), ("t3", 0.4)]
    assert context.neighbour_tables(contexts.limit(0), t).count() == 0


def test_recall_of_no_queries_is_zero(spark):
    ranks = spark.createDataFrame([("a", 1, "x"), ("b", 0, None), ("c", 4, "x")], "query_id string, rank int, kind string")
    r = metrics.recall(ranks).first()
    assert (r.recall_1, r.recall_5, r.n) == (0.333333, 0.666667, 3)
    assert metrics.recall(ranks.limit(0)).first().mrr == 0
    assert metrics.recall(ranks, ["kind"]).where("segment = 'kind' and value = 'null'").first().n == 1


def test_statistics_by_hand(spark):
    one = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 100)], "v int")
    r = metrics.length_stats(one, "v", (3,)).first()
    assert (r.least, r.median, r.most, r.p95, r.over_3) == (1, 3, 100, 100, 2)
    labels = spark.createDataFrame([("a",), ("a",), ("b",), ("b",)], "k string")
    assert metrics.entropy(labels, "k").first().entropy == 1.0
    assert metrics.entropy(labels.limit(0), "k").first().entropy == 0.0
    assert metrics.entropy(labels.where("k = 'a'"), "k").first().entropy == 1.0
    assert metrics.perplexity(spark.createDataFrame([(1.0, 2), (float("nan"), 5)], "l double, n int"), "l", "n").first().perplexity == 2.718282


def test_gates_fail_for_one_violation_each(spark):
    parents = spark.createDataFrame([("p1", "t", 10), ("p2", "alone", 3000)], "id string, text string, tokens int")
    children = spark.createDataFrame([("c1", "p1", "x <!-- TABLE_1 -->", 1, None, 5), ("c2", "gone", "y", None, [1.0], 1)], "id string, parent_id string, text string, page int, embedding array<float>, tokens int")
    s = spark.createDataFrame([("t", None, 1)], "id string, source string, page int")
    got = {r.gate_id: r.passed for r in gates.store_gates(parents, children, s).collect()}
    assert got == {"I1": False, "I2": False, "I3": False, "I4": False, "I5": True, "I6": False, "I7": False, "I8": False, "I9": False}
    with pytest.raises(gates.GateFailure, match="I1"):
        gates.require(gates.store_gates(parents, children, s))
    assert not gates.verdict(gates.store_gates(parents, children, s)).first().passed_all
    empty = gates.ratio(parents.limit(0), "g", F.lit(True), low=0.5, empty=True)
    assert empty.first().passed and not gates.ratio(parents.limit(0), "g", F.lit(True), low=0.5).first().passed


def test_greedy_dedup_lets_removed_rows_remove_none(spark):
    df = spark.createDataFrame([(k,) for k in range(5)], "k int")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a int, b int")
    assert {r.k for r in curate.greedy_unique(df, edges, "k", checkpoint).collect()} == {0, 2, 4}
    assert curate.greedy_unique(df, edges.limit(0), "k").count() == 5


def test_similar_pairs_over_blocks(spark):
    df = spark.createDataFrame([(k, [float(k % 3), 1.0]) for k in range(30)] + [(99, None)], "k int, v array<float>")
    one, many = (sorted((r.a, r.b) for r in curate.similar_pairs(df, "k", "v", 0.999, block).collect()) for block in (100, 7))
    assert one == many and len(one) == 3 * 45


def test_sampling_is_exact_and_repeatable(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("s"))
    parts = {r.part: r["count"] for r in curate.split(df, "k", 0.8).groupBy("part").count().collect()}
    assert parts == {"train": 800, "val": 200}
    again = curate.split(df.repartition(5), "k", 0.8)
    assert curate.split(df, "k", 0.8).where("part = 'val'").select("k").exceptAll(again.where("part = 'val'").select("k")).count() == 0
    assert curate.stratified(df, "s", "k", 70).groupBy("s").count().agg(F.min("count")).first()[0] == 9
    assert curate.split(df.limit(0), "k").count() == 0
    q = spark.createDataFrame([("q", "s", 1)], "query_id string, source string, page int")
    p = spark.range(200).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 20).cast("int").alias("page"))
    drawn = curate.negatives(q, p, 3, page_gap=2).join(p, "doc_id")
    assert drawn.count() == 3 and drawn.where("page <= 3").count() == 0


def test_fixed_length_drops_the_tail(spark):
    df = spark.createDataFrame([(1, 5), (2, 7), (3, 2)], "k int, n int")
    got = curate.fixed_length(df, "k", "n", 8)
    assert got.agg(F.sum("n")).first()[0] == 16 and got.select("sequence").distinct().count() == 2


def test_forward_fill_keeps_what_has_nothing_above(spark):
    df = spark.createDataFrame([("t", "c", k, v) for k, v in enumerate(["", "1", "", "id.", "4", None])], "id string, col_name string, row_idx int, cell_value string")
    got = [r.filled for r in tables.forward_fill(df, ["id", "col_name"], "row_idx").orderBy("row_idx").collect()]
    assert got == ["", "1", "1", "1", "4", "4"]


def test_cells_of_uneven_and_empty_tables(spark):
    df = spark.createDataFrame([("a", "| X | Y |\n|---|---|\n| 1 |  |\n| 2 | 3 | 4 |"), ("b", None), ("c", ""), ("d", "| X |\n|---|")], "id string, raw_table_text string")
    got = [(r.row_idx, r.col_name, r.cell_value) for r in tables.cells(df).orderBy("row_idx", "col_idx").collect()]
    assert got == [(0, "X", "1"), (1, "X", "2"), (1, "Y", "3")]


def test_repeated_headings_keep_the_first(spark):
    df = spark.createDataFrame([(1, "## A\nx\n## A\ny\n## A\nz\n## B")], "k int, text string")
    assert tables.strip_repeated_headings(df, "k", "text").first().text == "## A\nx\ny\nz\n## B"


def test_chunking_sections_tables_and_small_neighbours(spark):
    md = "# Titre\n\nIntro.\n\n## Un\n\n1.2 Règle une.\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n## Deux\n\n" + "mot " * 1000
    rows = chunking.chunk(md, "doc.pdf", {"Titre": 1, "Un": 2, "Deux": 3})
    kinds = [r["kind"] for r in rows]
    assert kinds.count("table") == 1 and kinds.count("child") >= 4
    assert all(r["tokens"] <= 450 for r in rows if r["kind"] == "child")
    parents = {r["id"] for r in rows if r["kind"] == "parent"}
    assert {r["parent_id"] for r in rows if r["kind"] == "child"} <= parents
    two = chunking.cut_tables("| a |\n|---|\ntext")
    assert two == ("| a |\n|---|\ntext", [])
    docs = spark.createDataFrame([("a", None), ("b", ""), (None, md)], "source string, markdown string")
    assert {r.source for r in chunking.chunk_documents(docs).collect()} == {None}


def test_negatives_find_as_many_as_qualify(spark):
    # a page holds nearly all passages: questions on it look on until they have theirs, or there are no more
    p = spark.createDataFrame([(f"d{n:03d}", "s", 1) for n in range(200)] + [("x", "s", 9), ("y", None, None), ("z", "t", None)], "doc_id string, source string, page int")
    q = spark.createDataFrame([("a", "s", 1), ("b", "t", 5), ("c", None, None)], "query_id string, source string, page int")
    got = {}
    for r in curate.negatives(q, p, 5, checkpoint=checkpoint).collect():
        got.setdefault(r.query_id, set()).add(r.doc_id)
    # an unknown page of the same source may be another one
    assert got["a"] == {"x", "y", "z"} and len(got["b"]) == 5 and len(got["c"]) == 5
    assert sorted(map(tuple, curate.negatives(q, p, 2).collect())) == sorted(map(tuple, curate.negatives(q, p.repartition(7), 2).collect()))
    assert curate.negatives(q, p.limit(0), 2).count() == 0 and curate.negatives(q.limit(0), p, 2).count() == 0


def test_pages_and_sequences_over_chunks_of_one_group(spark):
    rows = [("s" if n % 3 else None, n, n // 10 if n % 10 == 0 else None, 1 if n % 7 == 0 else n % 7 + 1) for n in range(900)]
    df = spark.createDataFrame(rows, "source string, pos int, page int, number int").repartition(6)
    got = {(r.source, r.pos): r.carried for r in tables.carry_pages(df, "source", "pos", "page", checkpoint).collect()}
    for source in ("s", None):
        own = [r for r in rows if r[0] == source]
        least, at = min(r[2] for r in own if r[2] is not None), None
        for r in own:
            at = at if r[2] is None else r[2]
            assert got[source, r[1]] == (least if at is None else at)
    got = {r.pos: r.sequence for r in tables.sequences(df, "pos", "number", checkpoint=checkpoint).collect()}
    assert [got[n] for n in range(900)] == [n // 7 for n in range(900)]
    assert tables.sequences(df.limit(0), "pos", "number", checkpoint=checkpoint).count() == 0


def test_only_known_tables_are_read(spark):
    from quern.plans.registry import Tables

    with pytest.raises(AttributeError):
        Tables(spark, "/nowhere").secrets


def test_spans_of_small_neighbours():
    sizes = {"a": 100, "b": 99, "c": 10, "d": 300, "e": 150, "f": 60}
    count = lambda text: sum(sizes[x] for x in text.split("\n\n"))
    assert chunking.spans(["p", "p", "q", "q"], list("abcd"), count) == [(0, 2), (2, 3), (3, 4)]
    # a span that is no longer small takes no more
    assert chunking.spans(["p"] * 4, list("aefc"), count) == [(0, 2), (2, 4)]
    assert chunking.spans([], [], count) == []


def test_bins_are_greedy():
    assert chunking.bins([5, 5, 5, 20, 1, 9], 10).tolist() == [0, 0, 1, 2, 3, 3]
    assert chunking.bins([], 10).tolist() == []
    assert chunking.bins([0, 0, 30, 0], 10).tolist() == [0, 0, 1, 2]


def test_pages_are_carried_and_used_up():
    md = "# H1\na\nhead\n# H9\nx\nhead\ny\nhead\nz"
    pages = chunking.line_pages(md, {"H1": 1, "H9": 9}, [("# head", 1), ("head", 2)])
    # the third "head" has no page left and keeps the one it is on
    assert pages == {"H1": 1, "a": 1, "head": 2, "H9": 9, "x": 9, "y": 2, "z": 2}
    pages = chunking.line_pages("# H1\nhead\n# H9\nhead\nz", {"H1": 1, "H9": 9}, [("head", 1)])
    assert (pages["head"], pages["z"]) == (9, 9)
    assert chunking.line_pages(md, {}, [("a", 3)]) == {}


def test_parents_are_grouped_by_the_two_upper_headings():
    md = "# A\n\n## B\n\nun deux\n\n# C\n\ntrois\n\n# A\n\n## B\n\n### D\n\nquatre"
    rows = chunking.chunk(md, "s")
    parents = {r["section"]: r for r in rows if r["kind"] == "parent"}
    assert set(parents) == {"A > B", "C"} and "un deux" in parents["A > B"]["text"] and "quatre" in parents["A > B"]["text"]
    assert [r["section"] for r in rows if r["kind"] == "child"] == ["A > B", "C", "A > B > D"]
    nested = chunking.chunk_nested("# A\n\n" + "mot " * 1500 + "\n\n# B\n\nmot", "s")
    sizes = [r["tokens"] for r in nested if r["kind"] == "parent"]
    assert max(sizes) <= 1024 and len(sizes) == 4 and {r["parent_id"] for r in nested if r["kind"] == "child"} <= {r["id"] for r in nested}


def test_chunks_by_the_tokens_of_a_tokenizer(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    count = chunking.bpe_counter(tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([("a", "# T\n\n" + "échiquier" * 900, 1)], "source string, markdown string, other int")
    got = chunking.chunk_documents(docs, count).where("kind = 'child'").collect()
    assert got and all(r.tokens == count(r.text) for r in got)
    long = "Le joueur déplace sa pièce. " * 300
    got = chunking.chunk_documents(spark.createDataFrame([("a", long)], "source string, markdown string"), count).where("kind = 'child'").collect()
    assert len(got) > 3 and all(r.tokens <= 450 for r in got)


def test_page_maps(spark):
    items = spark.createDataFrame([("s", 1, "heading", "Titre", 1), ("s", 2, "text", "# Un   texte qui est assez long pour compter ici", 2), ("s", 3, "heading", "Titre", 3), ("s", 4, "text", None, 3), ("s", 5, "text", "court", None)], "source string, pos int, label string, text string, page int")
    assert chunking.heading_pages(items).first().heading_pages == {"Titre": 3}
    assert [(x.text[:5], x.page) for x in chunking.text_pages(items).first().text_pages] == [("Titre", 1), ("# Un ", 2), ("Titre", 3)]
    got = {(r.segment, r.page) for r in chunking.segment_pages(items).collect()}
    assert got == {("un texte qui est assez long po", 2), ("un texte qui est assez long pour compter", 2)}
    told = spark.createDataFrame([("t1", "résumé", "s", 2, 1), ("t2", None, "s", 2, 1)], "id string, summary_text string, source string, page int, tokens int")
    parts = chunking.with_table_summaries(chunking.chunk_documents(spark.createDataFrame([("s", "texte")], "source string, markdown string")), told)
    assert sorted(r.kind for r in parts.collect()) == ["child", "parent", "table_summary"]


@pytest.mark.parametrize("word,expected", [("continuellement", "continuel"), ("majorité", "major"), ("chevaux", "cheval"), ("forfaits", "forfait"), ("1.2", "1.2"), ("", ""), ("réclamations", "réclam")])
def test_french_stems(word, expected):
    assert stem.stem_word(word) == expected


def test_text_functions(spark):
    assert column(spark, "L'équipe d'Évry", T.tokens) == ["l", "equipe", "d", "evry"]
    assert column(spark, 'Il dit "une phrase assez longue" ici', T.quote) == "une phrase assez longue"
    assert column(spark, "##begin_quote## un passage marqué ##end_quote##", T.quote) == "un passage marqué"
    assert column(spark, "1. Quelle est la règle ?\n- Trop court ?\nfin", T.questions) == ["Quelle est la règle ?"]
    assert column(spark, "La réponse : B", T.answer_letter) == "B"
    assert column(spark, "[[No]]", T.yes_no) is False
    assert column(spark, '{"score": 1.5}', T.score) == 1.0
    assert column(spark, "Titre : suite", T.title_before_colon) == "Titre"
    assert column(spark, None, T.title_before_colon) == "Tableau"
    assert column(spark, "DNA et DNA (x)", lambda c: T.expand_abbreviations(c, {"DNA": "Direction"})) == "DNA (Direction) et DNA (x)"
    assert column(spark, "article 3.2, art. 4, annexe 1 et 3.2", T.article_numbers) == ["3.2", "4", "1"]
    assert column(spark, "A. oui\nB) non\nA - encore", T.choices) == {"A": "oui", "B": "non"}
    assert column(spark, "Annales-juin-2023.pdf", lambda c: T.session_id(c, [("juin", "06"), ("jun", "06")])) == "202306"
    assert column(spark, None, T.token_count) == 0
    assert column(spark, "l'art", T.token_count) == 3
    assert column(spark, "un deux trois", lambda c: T.truncate_words(c, 2)) == "un deux [...]"
    for f in (T.tokens, T.quote, T.questions, T.answer_letter, T.score, T.article_numbers, T.sentences, T.paragraphs, T.leading_article):
        assert column(spark, None, f) in (None, [])
        column(spark, "", f)


def test_units_and_names(spark):
    df = spark.createDataFrame([("elo", "1500"), ("elo", "1500 points"), ("nom", "3"), ("elo", "x"), (None, None)], "c string, v string")
    got = [r.x for r in df.select(T.with_unit(F.col("v"), F.col("c"), {"elo": "points"}).alias("x")).collect()]
    assert got == ["1500 points", "1500 points", "3", "x", None]
    assert column(spark, " NB. ", lambda c: T.rename(c, {"nb.": "Nombre"})) == "Nombre"


def test_triggers_need_one_strong_or_two_weak_and_a_number(spark):
    f = lambda q: column(spark, q, lambda c: T.triggers(c, ["bareme"], ["cadence", "elo"]))
    assert f("le bareme") and f("cadence elo 1500") and not f("cadence elo") and not f("1500")


def test_links_by_article_and_phases(spark):
    q = spark.createDataFrame([("q", "Selon l'article 3.2 et l'article 4")], "query_id string, text string")
    c = spark.createDataFrame([("a", "3.2.1"), ("b", "3.2"), ("c", None)], "doc_id string, article_num string")
    assert links.by_article(q, c).first().doc_id == "b"
    s = lambda rows: spark.createDataFrame(rows, "query_id string, doc_id string, score double")
    best = {r.query_id: (r.doc_id, r.phase) for r in links.in_phases(s([("q", "sib", 0.6)]), s([("q", "doc", 0.6), ("r", "doc", 0.9)]), s([("q", "any", 0.75), ("r", "any", 0.95)])).collect()}
    assert best == {"q": ("any", 2), "r": ("doc", 1)}


def test_migration_changes_and_their_log(spark):
    base = spark.createDataFrame([("a", "court", ["x"], None), ("b", None, None, "B")], "id string, text string, opts array<string>, ans string")
    patch = spark.createDataFrame([("a", "plus long", ["x", "y"], "A")], "id string, text string, opts array<string>, ans string")
    got = {r.id: (r.text, r.opts, r.ans, r.changed) for r in migrate.patched(base, patch, "id", ["text"], ["ans"], ["opts"]).collect()}
    assert got == {"a": ("plus long", ["x", "y"], "A", ["text", "ans", "opts"]), "b": (None, None, "B", [])}
    f = migrate.filled(base, {"ans": F.lit("?")}).where("id = 'a'").first()
    assert f.ans == "?" and [tuple(x) for x in f.corrections] == [("ans", None, "?")]
    assert migrate.upsert_value(spark.createDataFrame([("k", "1")], "key string, value string"), "k", "2").first() == Row(key="k", value="2", old="1")


def test_exports_and_resumption(spark, tmp_path):
    t = spark.createDataFrame([(1, "q", "anchor 1", "d", None, "first", "neg", "ans"), (2, "q", "anchor 2", "d", "T", "second", None, None)], "pos int, query_id string, anchor string, doc_id string, title string, positive string, negative string, answer string")
    files = exports.beir(t)
    assert files["corpus"].first().text == "first" and files["queries"].first().text == "anchor 2" and files["qrels"].count() == 1
    assert exports.dangling(files).agg(F.sum("n")).first()[0] == 0
    assert exports.ares(t).count() == 3
    exports.write(exports.ares(t), str(tmp_path / "x.tsv"), "tsv")
    back = readers.tab_separated(spark, str(tmp_path / "x.tsv"), "Query string, Document string, Answer string, Context_Relevance_Label int", "Context_Relevance_Label")
    assert back.count() == 3
    assert exports.resume(t, t.where("pos = 1"), "pos").count() == 1
    exports.report(exports.ares(t), str(tmp_path / "r.json"))
    assert "rows: 3" in exports.markdown(exports.ares(t), "T", key="Context_Relevance_Label")


def test_readers_keep_bad_files_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"source": "a", "markdown": "x", "heading_pages": {"A": 1}}')
    (tmp_path / "b.json").write_text('{"source": ')
    rows = {r.file: r for r in readers.json_documents(spark, str(tmp_path / "*.json")).collect()}
    assert rows["a.json"].markdown == "x" and rows["b.json"]["_error"] is not None
    (tmp_path / "m.json").write_text('{"contexts": {}}')
    with pytest.raises(ValueError):
        readers.json_map(spark, str(tmp_path / "m.json"), "contexts")


def test_streams_equal_batches(spark, tmp_path):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    rows = [(k, base + dt.timedelta(minutes=m), u, 1.0) for k, (m, u) in enumerate([(0, "a"), (5, "a"), (70, "a"), (3, "b"), (600, "b")])]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp, user string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    seen = []
    log.maintain(stream, lambda batch, n: seen.append(batch.count()), str(tmp_path / "cp")).awaitTermination(120)
    assert sum(seen) == 5
    log.append(log.once(stream, "event_id", "ts"), str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).count() == 5
    q = log.window_counts(stream, "ts", "user").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("w").collect()} == {tuple(r) for r in log.window_counts(df, "ts", "user").collect()}
    assert log.sessions(df, "user", "ts").count() == 4
    q = log.sessions(stream, "user", "ts").writeStream.format("memory").queryName("s").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    closed = {(r.user, r.n) for r in spark.table("s").collect()}
    assert ("a", 2) in closed and ("b", 1) in closed


def test_connector_sentences_of_each_paragraph_and_kind(spark, tmp_path):
    from quern.plans import registry

    first = "Le capitaine signe la feuille de match. Cependant, l'arbitre la garde chez lui. Toutefois il la rend car elle est due."
    second = "EN OUTRE, le club paie les frais. Par conséquent, la ligue les rembourse à condition que tout soit signé."
    rows = [("a", f"{first}\n\n{second}", 1), ("a", "old delivery: cependant, il est remplacé par la suite.", 0), ("b", "Le joueur est à l'écart de la salle de jeu toute la ronde.", 1), ("c", None, 1), ("d", "car court", 1)]
    spark.createDataFrame(rows, "id string, text string, indexed_at long").write.parquet(f"{tmp_path}/children.parquet")
    got = {tuple(r) for r in registry.QUERIES["connector_sentences"](spark, str(tmp_path)).select("id", "paragraph", "kind", "sentence").collect()}
    assert got == {
        ("a", 0, "nli_contrast", "Cependant, l'arbitre la garde chez lui."),
        ("a", 0, "causal", "Toutefois il la rend car elle est due."),
        ("a", 1, "addition", "EN OUTRE, le club paie les frais."),
        ("a", 1, "nli_consequent", "Par conséquent, la ligue les rembourse à condition que tout soit signé."),
        ("a", 1, "conditional", "Par conséquent, la ligue les rembourse à condition que tout soit signé."),
    }
