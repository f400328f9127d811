from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators import review


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0, 0.0], [0.0, 0.0, 0.0]), ([1.0, 0.0, 0.0], [1.0, 1.0, 0.0]), (None, [1.0, 1.0, 1.0])], "a array<float>, b array<float>")
    got = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.truncated(F.col("a"), 2).alias("t"), V.from_blob(V.to_blob(F.col("a"))).alias("r"), "a").collect()
    assert got[0].c == 0.0 and abs(got[1].c - 0.5**0.5) < 1e-9 and got[2].c is None
    assert [round(x, 6) for x in got[0].t] == [0.6, 0.8] and got[0].r == got[0].a and got[2].r is None


def test_expansion_in_both_directions(spark):
    pairs = spark.createDataFrame([(1, "zeitnot", ["crise de temps", "pendule"]), (2, "roque", [])], "pos int, term string, synonyms array<string>")
    q = spark.createDataFrame([("a", "Le zeitnot"), ("b", "La pendule"), ("c", None)], "query_id string, text string")
    got = {r.query_id: r.expanded for r in review.expand_queries(q, pairs).collect()}
    assert got["a"] == "Le zeitnot crise de temps pendule" and got["b"] == "La pendule zeitnot" and got["c"] == ""
    assert review.reverse_synonyms(pairs).where("word = 'pendule'").first().terms == ["zeitnot"]


def test_coverage_and_consolidation(spark):
    p = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "t"), ("d", None)], "doc_id string, source string")
    r = review.coverage(p, spark.createDataFrame([("a",), ("a",), ("x",)], "doc_id string"), "source").first()
    assert (r.covered, r.covered_groups, r.share, r.group_share) == (1, 1, 0.25, 0.5)
    assert review.coverage(p.limit(0), p, "source").first().share == 0.0
    b = spark.createDataFrame([(38, 1, 1, [("q", "FIX")]), (40, 0, 0, None)], "keep int, wrong int, partial int, results array<struct<id:string,action:string>>")
    r = review.consolidated(b).first()
    assert (r.rate, r.passed, r.open) == (97.5, True, 1)


def test_sections_of_empty_headings_take_the_deeper_ones(spark):
    d = spark.createDataFrame([(1, "# A\n## B\nun\n## C\ndeux\n# D\ntrois"), (2, None), (3, "sans titre")], "doc_id int, text string")
    got = [(r.heading, r.body) for r in review.sections(d).orderBy("pos").collect()]
    assert got == [("A", "un\ndeux"), ("B", "un"), ("C", "deux"), ("D", "trois")]


def test_drift_picks_and_windows(spark):
    h = spark.createDataFrame([("q", "a", 0.9, 1), ("q", "b", 0.5, 6)], "query_id string, doc_id string, score double, rank int")
    c = spark.createDataFrame([("q", "b"), ("r", "z")], "query_id string, doc_id string")
    assert {r.query_id: (r.best, r.moved) for r in review.drift(h, c).collect()} == {"q": ("a", True), "r": (None, True)}
    k = spark.createDataFrame([("1", "d", "x", 0.5), ("2", "d", "y", 0.9), ("3", "e", "y", 0.1)], "id string, doc_id string, profile string, score double")
    assert {r.id for r in review.pick_per_profile(k, ["x", "y"], 1).collect()} == {"1", "3"}
    t = spark.createDataFrame([("Le joueur doit signer", "Tout joueur doit signer ici"), (None, "x"), ("x", None)], "a string, t string")
    assert [r.m for r in t.select(review.window_match(F.col("a"), F.col("t"), 3).alias("m")).collect()] == [True, False, False]


def test_tables_with_two_vectors(spark):
    t = spark.createDataFrame([("t", ["A", "B"], [["1"]], "s", 1), ("u", ["A", " "], [["1"]], "s", 1), ("v", ["A", "B"], [], "s", 1)], "id string, headers array<string>, rows array<array<string>>, source string, page int")
    s = spark.createDataFrame([("t", "Résumé"), ("u", "Résumé")], "id string, summary_text string")
    parents, kids = review.multivector_tables(t, s)
    assert [r.text for r in parents.collect()] == ["| A | B |\n|---|---|\n| 1 |  |"] and kids.first().parent_id == "t"
    assert review.substantive(spark.createDataFrame([("## T", 60), ("Texte", 60), ("Texte", None), ("Chap ..... 3", 60)], "text string, tokens int")).count() == 1


def test_answer_keys_grids_and_explanations(spark):
    from quern.operators import exams, tables

    key = "| UV1 | | | |\n|---|---|---|---|\n| Question | Réponse | Article | Taux |\n| 1 Roque | a | 3.8 | 84 % |\n| 2 | B | | - |\n| x | C | | 5 % |\n| 2 | D | 4.1 | 10 % |"
    other = "| N | Corrigé |\n|---|---|\n| 1 | b |\n| 2 | |"
    df = spark.createDataFrame([("k", key), ("o", other), ("n", None), ("e", "")], "id string, raw_table_text string")
    rows = tables.rows(df)
    got = sorted(tuple(r) for r in exams.answer_key(rows).where("id = 'k'").collect())
    assert got == [("k", 1, "A", "3.8", 0.84, 0.16), ("k", 2, "B", "", None, None), ("k", 2, "D", "4.1", 0.1, 0.9)]
    assert {r.answer for r in exams.answer_key(rows, last_wins=True).where("id = 'k' and number = 2").collect()} == {"D"}
    assert [(r.number, r.answer) for r in exams.answer_key(rows, default_first=True).where("id = 'o'").collect()] == [(1, "B")]
    grids = spark.createDataFrame([("pairs", "| 1 | A | 2 | b |\n|---|---|---|---|\n| 3 | C | 4 | Z |\n| 4 | D | 5 | |"), ("joined", "| 1 - A | 2) C |\n|---|---|\n| 3B | x |"), ("below", "| 1 | 2 |\n|---|---|\n| A | F |")], "id string, raw_table_text string")
    found = {(r.id, r.number): r.letter for r in exams.answer_grid(tables.rows(grids)).collect()}
    assert found == {("pairs", 1): "A", ("pairs", 2): "B", ("pairs", 3): "C", ("pairs", 4): "D", ("joined", 1): "A", ("joined", 2): "C", ("joined", 3): "B", ("below", 1): "A", ("below", 2): "F"}
    text = "Question ?\nA - Oui\nB - Non\nLivre, article 3.8\nLe roi se déplace de deux cases vers la tour."
    texts = spark.createDataFrame([(text,), ("A - Oui\narticle 1\n12 34",), ("A - Oui\nsans renvoi du tout, donc rien",), (None,), ("",)], "t string")
    assert [r[0] for r in texts.select(exams.explanation(F.col("t"))).collect()] == ["Le roi se déplace de deux cases vers la tour.", None, None, None, None]
