"""The operators for training data against brute force, round trips and literal cases."""

import os
import random
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import languages, leaks, learned, packing, pairs, pieces, queries, spam, tokens, truncation, vectors, words
from quern.session import checkpoint

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")
TOKEN = regex.compile(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")
LETTERS = st.text(alphabet="aAéÉé \n\t -.,!?3½ßﬁİ한😀_'’​\r", max_size=60)


@needs_data
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_over_the_smallest_tables(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    assert df.count() == df.distinct().count()


# -- words

@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), LETTERS), max_size=6))
def test_bulk_hashes_agree_with_words(texts):
    hashes, starts = words.word_hashes(texts, chunk=20)
    own = [words.words(t) for t in texts]
    assert np.diff(starts).tolist() == [len(w) for w in own]
    seen = {}
    for w, h in zip((w for ws in own for w in ws), hashes.tolist()):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_hyphens_at_line_ends_join_words():
    assert words.words("ren-\nverse trois-\r\n pièces, bien-être -\nfin") == ["renverse", "troispieces", "bien", "etre", "fin"]
    assert words.words("prenez-\n\nLe") == ["prenez", "le"]
    assert words.words(None) == words.words("") == []


# -- 1: truncation

SENTENCES = ["Le club organisateur peut afficher la grille américaine au tableau noir.", "Chaque capitaine doit signer la feuille de match avec prudence.", "La direction de groupe peut reporter la rencontre."]


def p1_rows(spark, extra):
    rows = [(f"k{n}", "R", "a", SENTENCES[n % 3]) for n in range(60)] + [(f"x{n}", "R", "a", t) for n, t in enumerate(extra)]
    return spark.createDataFrame(rows, "key string, kind string, source string, text string")


def test_cut_values_by_words_contexts_and_marks(spark):
    cut = ["Le club organisateur peut afficher la grille améri", "Chaque capitaine doit signer la feuille de", "La direction de groupe peut reporter la ren…", "Chaque capitaine doit signer la feuille de mat�", "Le club organisateur peut afficher la grille,"]
    whole = ["Chaque capitaine doit signer la feuille de match avec prudence", "La direction de groupe peut reporter la rencontre...", "Non", "", None, "   ", "**", "Le club organisateur peut afficher la grille américaine au tableau noir ?"]
    df = p1_rows(spark, cut + whole)
    got = {r.key for r in truncation.cut_values(df, df.select("kind", "text"), checkpoint).collect()}
    assert got == {f"x{n}" for n in range(len(cut))}


def test_a_mark_at_the_cut_makes_no_value_complete(spark):
    cut = ["Le club organisateur peut afficher la grille améri.", "La direction de groupe peut reporter la ren [coupé]"]
    whole = ["Chaque capitaine doit signer la feuille de match avec prudence !", "La direction de groupe peut reporter la rencontre (dimanche)."]
    df = p1_rows(spark, cut + whole)
    assert {r.key for r in truncation.cut_values(df, df.select("kind", "text"), checkpoint).collect()} == {"x0", "x1"}


def test_short_values_are_judged_by_their_last_word_and_mark(spark):
    cut = ["Chaque cap", "La dire…", "Le club,"]
    whole = ["Chaque club", "Non", "Le tableau.", "Oui", "Le blâme"]
    df = p1_rows(spark, cut + whole)
    assert {r.key for r in truncation.cut_values(df, df.select("kind", "text"), checkpoint).collect()} == {"x0", "x1", "x2"}


def test_length_limits_tell_word_ends_from_cuts(spark):
    long = "Chaque capitaine doit signer la feuille de match avec prudence"
    df = p1_rows(spark, [f"{long} ou " for _ in range(30)])
    got = {r.key: r.at_limit for r in truncation.cut_values(df, df.select("kind", "text")).collect()}
    assert len(got) == 30 and all(got.values())
    assert truncation.cut_values(df.limit(0), df.limit(0).select("kind", "text")).count() == 0


# -- 2: pieces

@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n,;'!é3", max_size=400), st.integers(2, 20), st.data())
def test_pieces_keep_limits_overlaps_and_text(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    cps, _ = words.code_points([text])
    starts = np.flatnonzero(words.token_starts(cps))
    full = TOKEN.findall(text)
    assert len(starts) == len(full)
    out = pieces.split_text(text, starts, limit, overlap)
    assert [len(TOKEN.findall(text[a:b])) for a, b, _, _ in out] == [n for *_, n in out]
    assert all(n <= limit for *_, n in out)
    for (_, end, first, n), (begin, _, first2, _) in zip(out, out[1:]):
        assert first2 == first + n - overlap and begin <= end
    if out:
        assert "".join([text[out[0][0] : out[0][1]], *(text[p[1] : q[1]] for p, q in zip(out, out[1:]))]) == text


def test_pieces_end_at_sentences_and_cut_hard_without_any(spark):
    df = spark.createDataFrame([("a", "Un deux trois. Quatre cinq. Six sept huit neuf dix."), ("b", "x" * 5), ("c", None), ("d", ""), ("e", ".".join("abcdefghij"))], "id string, text string").withColumn("key", F.lit(1))
    got = {}
    for r in pieces.split(df, "id", "text", 8, 2).orderBy("id", "piece").collect():
        got.setdefault(r.id, []).append(r.text)
    assert got["a"][:2] == ["Un deux trois. Quatre cinq. ", "cinq. Six sept huit neuf dix."]
    assert got["b"] == ["xxxxx"] and "c" not in got and "d" not in got and len(got["e"]) > 1
    assert {r.id for r in pieces.split(df, "id", "text", 8, 2, oversized=True, texts=False).collect()} == {"a", "e"}
    assert pieces.split(df.limit(0), "id", "text", 8, 2).count() == 0
    with pytest.raises(ValueError):
        pieces.split(df, "id", "text", 8, 8)


# -- 3: pairs

@pytest.mark.parametrize(
    "question,response,expected",
    [
        ("Qui peut signer ?", None, "empty"),
        ("Qui peut signer ?", "  ​", "empty"),
        ("Qui peut signer ?", "<p>&nbsp;</p>", "empty"),
        ("Qui peut signer ?", "N/A", "empty"),
        ("Qui peut signer ?", "Réponse :", "empty"),
        ("Qui peut signer ?", "Non.", None),
        ("Qui peut signer la feuille de match ?", "Désolé, je ne peux pas me prononcer. Merci de votre compréhension.", "refusal"),
        ("Qui peut signer la feuille de match ?", "L'arbitre ne peut pas répondre à la place du capitaine et refuse la demande.", None),
        ("Qui peut signer la feuille de match ?", "Le joueur qui s'excuse (« désolé, je ne peux pas ») n'est pas sanctionné.", None),
        ("Who may sign the match sheet?", "I would rather not settle this case.", "refusal"),
        ("Qui peut signer la feuille de match ?", "QUI PEUT SIGNER LA FEUILLE DE MATCH ?", "copied_question"),
        ("Qui peut signer la feuille de match ?", "La question posée est la suivante : qui peut signer la feuille de match.", "copied_question"),
        ("Qui peut signer la feuille de match ?", "À la question « Qui peut signer… », la réponse est claire : le capitaine de l'équipe visiteuse.", None),
        ("Qui peut signer la feuille de match ?", "The deputy arbiter may sign the match sheet at the end of the round.", "other_language"),
        ("Qui peut signer la feuille de match ?", "El árbitro debe firmar el acta al final de la ronda.", "other_language"),
        ("Qui peut signer la feuille de match ?", "Le capitaine signe la feuille. Le terme anglais « touch move » désigne cette règle.", None),
        ("Qui peut signer la feuille de match ?", "Je suis désolé, mais cette question dépasse le cadre de mes connaissances.", "refusal"),
        ("Qui peut signer la feuille de match ?", "Sorry, that is something I must pass on.", "refusal"),
        ("Qui peut signer la feuille de match ?", "Merci pour votre question sur le roque. Je ne peux pas répondre.", "refusal"),
        ("Wer darf unterschreiben?", "Das kann ich leider nicht beantworten, ich kann dazu nichts sagen.", "refusal"),
        ("¿Quién firma el acta?", "Lo siento, no dispongo de esa información.", "refusal"),
        ("Qui peut signer la feuille de match ?", "Le joueur ne peut pas roquer. Le capitaine signe la feuille et l'arbitre la transmet à la ligue avant la fin de la ronde suivante.", None),
        ("Qui peut signer la feuille de match ?", "Капитан команды подписывает протокол матча после последней партии.", "other_language"),
        ("Qui peut signer la feuille de match ?", "比赛结束后，队长必须在记录表上签字。", "other_language"),
        ("Qui peut signer la feuille de match ?", "Kapitan drużyny podpisuje protokół meczu zaraz po zakończeniu ostatniej partii.", "other_language"),
        ("Who may sign the match sheet?", "Lagledaren får skriva på matchprotokollet när sista partiet är över.", "other_language"),
        ("Кто подписывает протокол?", "The captain signs the match sheet.", "other_language"),
        ("Qui peut signer la feuille de match ?", "Le terme russe « шахматы » désigne les échecs : шах.", None),
        (None, "Le capitaine.", None),
        ("", "The deputy arbiter may sign the match sheet.", None),
    ],
)
def test_defects(question, response, expected):
    assert pairs.defect(question, response) == expected


def test_defects_join_with_truncated_responses(spark):
    values = p1_rows(spark, ["Chaque capitaine doit signer la feuille de"]).withColumn("source", F.lit("a"))
    df = values.select(F.col("key").alias("id"), F.lit("Qui peut signer ?").alias("question"), F.when(F.col("key") == "k0", "").otherwise(F.col("text")).alias("response"))
    got = {r.id: r.defect for r in pairs.defects(df, values, values.select("kind", "text")).collect()}
    assert got == {"k0": "empty", "x0": "truncated"}


def test_languages_of_pairs_are_learned_from_all_of_them(spark):
    # answers without function words, each told by the words of one other pair
    pairs_of = lambda n: (f"What is the use of {n}?", f"The player may not use {n} and has to wait for it.")
    made = lambda n: [f"{x}{chr(97 + n // 26)}{chr(97 + n % 26)}" for x in ("castle", "pawn", "bishop")]
    rows = [(f"known{n}", *pairs_of(" ".join(made(n)))) for n in range(40)]
    rows += [(f"asked{n}", "Qui peut signer la feuille de match ?", " ".join(made(n)).capitalize() + ".") for n in range(40)]
    rows += [(f"fr{n}", "Qui peut signer la feuille de match ?", "Le capitaine de chaque équipe signe la feuille avant la fin de la ronde.") for n in range(20)]
    rows += [(f"more{n}", None, "Oui.") for n in range(20_000)]
    df = spark.createDataFrame(rows, "id string, question string, response string")
    values = df.limit(0).select(F.col("id").alias("key"), F.lit("text").alias("kind"), F.lit("a").alias("source"), F.lit("").alias("text"))
    got = {r.id: r.defect for r in pairs.defects(df, values).collect()}
    assert got == {f"asked{n}": "other_language" for n in range(40)}


def test_what_is_known_of_a_language_is_no_matter_of_size():
    french = {x: 10**6 for x in map("".join, zip("abcdefgh" * 4, "bcdefgha" * 4, "cdefghab" * 4))}
    assert "zzz" in languages.Letters({"fr": Counter({**dict.fromkeys(french, 10**4), "zzz": 2})}).all
    assert "zzz" not in languages.Letters({"fr": Counter({**french, "zzz": 2})}).all


def test_counts_of_words_are_those_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(learned, "HELD", 10)
    texts = [f"Le joueur et la pendule du club n{chr(97 + n % 26)} de la ville {n}" for n in range(300)] + [None, "", "Roque", "the a an of to in le la les du"]
    found, letters = learned.learn(spark.createDataFrame([(t, t) for t in texts], "a string, b string"), learned.WORD, learned.TRIGRAM)
    tally = languages.Tally()
    for t in texts * 2:
        tally.add(words.words(t))
    assert found == tally.words() and letters == tally.trigrams()
    assert found["fr"]["joueur"] == 600 and letters["fr"][" jo"] == 600 and "12" not in found["fr"]
    assert learned.learn(spark.createDataFrame([], "a string"), learned.WORD) == [{}]


def test_languages():
    assert languages.language("le joueur doit signer la feuille".split()) == "fr"
    assert languages.language("the arbiter must sign the sheet".split()) == "en"
    assert languages.language([]) is None


# -- 4: vectors

def brute(rows, k, least):
    good = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if v is not None and len(v) == 8 and None not in v and np.any(v) and np.isfinite(v).all()}
    ids = sorted(good)
    x = np.array([good[i] / np.linalg.norm(good[i]) for i in ids]).reshape(len(ids), 8)
    s = np.round(x @ x.T, 9)
    out = {}
    for n, i in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != n and s[n, j] >= least), key=lambda j: (-s[n, j], ids[j]))
        out[i] = [ids[j] for j in order[:k]]
    return out


def vector_rows(copies):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 8))
    rows = [(f"v{n:04d}", (base[n % 60] * rng.uniform(0.5, 3) + rng.normal(size=8) * 0.08).tolist()) for n in range(600)]
    rows += [(f"c{n:03d}", [float(x) for x in range(1, 9)]) for n in range(copies)]
    return rows + [("null", None), ("zero", [0.0] * 8), ("short", [1.0] * 7), ("hole", [1.0, None, *[2.0] * 6]), ("nan", [float("nan")] * 8), ("v0000", rows[0][1])]


@pytest.mark.parametrize("copies", [3, 200])
def test_neighbours_equal_brute_force(spark, copies):
    rows = vector_rows(copies)
    df = spark.createDataFrame(rows, "id string, embedding array<float>").withColumn("h", F.lit("x")).repartition(5)
    got = {}
    for r in vectors.neighbours(df, 5, 0.9, dim=8, list_size=100, sigmas=6).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.other)
    want = {i: o for i, o in brute(rows, 5, 0.9).items() if o}
    assert got == want


@pytest.mark.parametrize("times", [3, 30])
def test_an_id_delivered_again_takes_no_other_place(spark, times):
    rng = np.random.default_rng(6)
    rows = [(f"n{n:02d}", (1 + rng.normal(size=8) * 0.05).tolist()) for n in range(40)]
    again = rows + [rows[n] for n in (range(40) if times == 3 else (7,)) for _ in range(times - 1)]
    df = spark.createDataFrame(again, "id string, embedding array<float>")
    got = {}
    for r in vectors.neighbours(df, 10, 0.9, dim=8).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.other)
    assert got == {i: o for i, o in brute(rows, 10, 0.9).items() if o}


def test_neighbours_without_a_threshold_reach_the_recall(spark):
    rows = vector_rows(3)
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    got = {}
    for r in vectors.neighbours(df, 5, dim=8, list_size=150).collect():
        got.setdefault(r.id, set()).add(r.other)
    want = brute(rows, 5, -2)
    assert np.mean([len(got.get(i, set()) & set(o)) / len(o) for i, o in want.items()]) >= 0.95


def test_a_dense_third_of_all_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(f"a{n:04d}", rng.normal(size=8).tolist()) for n in range(1200)] + [(f"d{n:04d}", (1 + rng.normal(size=8) * 0.01).tolist()) for n in range(600)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    got = {}
    for r in vectors.neighbours(df, 5, 0.92, dim=8, list_size=150, sigmas=4).collect():
        got.setdefault(r.id, set()).add(r.other)
    want = {i: o for i, o in brute(rows, 5, 0.92).items() if o}
    assert np.mean([len(got.get(i, set()) & set(o)) / len(o) for i, o in want.items()]) >= 0.98


def test_copies_of_one_direction_share_their_neighbours(spark):
    """Ties go to the smaller id, whatever the lengths of the vectors and however many copies there are."""
    v = [float(x) for x in range(1, 9)]
    rows = [(f"b{n:03d}", v) for n in range(80)] + [(f"a{n:03d}", [2 * x for x in v]) for n in range(80)] + [(f"c{n:03d}", [3 * x for x in v]) for n in range(5)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    for asked in (None, F.col("id").isin("b003", "b050", "a004", "c001")):
        got = {}
        for r in vectors.neighbours(df, 10, 0.92 if asked is None else None, dim=8, queries=asked).orderBy("id", "rank").collect():
            got.setdefault(r.id, []).append(r.other)
        first = [f"a{n:03d}" for n in range(10)]
        assert got["b003"] == got["b050"] == got["c001"] == first and got["a004"] == [f"a{n:03d}" for n in range(11) if n != 4]
        assert len(got) == (165 if asked is None else 4)


def test_neighbours_of_some_ids_against_all(spark):
    rows = vector_rows(200)
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    got = {}
    for r in vectors.neighbours(df, 5, dim=8, list_size=100, queries=F.col("id").endswith("00")).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.other)
    want = {i: o for i, o in brute(rows, 5, -2).items() if i.endswith("00")}
    assert set(got) == set(want)
    assert np.mean([len(set(got[i]) & set(o)) / 5 for i, o in want.items()]) >= 0.95


def test_no_vectors_no_neighbours(spark):
    df = spark.createDataFrame([("a", None)], "id string, embedding array<float>")
    assert vectors.neighbours(df, 5, 0.9, dim=8).count() == 0
    assert vectors.neighbours(df.limit(0), 5, dim=8).count() == 0


# -- 5: leaks

def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"mot{n}" for n in range(40)]
    items = [(f"i{n}", " ".join(rng.choices(vocabulary, k=rng.choice([5, 12, 13, 20, 40])))) for n in range(80)] + [("null", None), ("empty", "")]
    docs = []
    for n in range(150):
        w = rng.choices(vocabulary, k=rng.randint(0, 60))
        source = words.words(rng.choice(items[:80])[1])
        at, size = rng.randint(0, max(0, len(source) - 10)), rng.randint(8, 30)
        k = rng.randint(0, len(w))
        w = w[:k] + [x.upper() + rng.choice(["", ",", "**", "\n>"]) for x in source[at : at + size]] + w[k:]
        docs.append((n, " ".join(w)))
    docs += [(900, None), (901, "")]
    sets = {i: {tuple(w[k : k + 13]) for k in range(len(w) - 12)} for i, t in items for w in [words.words(t)]}
    want = {(d, i) for d, t in docs for w in [words.words(t)] for k in range(len(w) - 12) for i, s in sets.items() if tuple(w[k : k + 13]) in s}
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("passage", F.lit(1))
    i = spark.createDataFrame(items, "item_id string, text string")
    got = {tuple(r) for r in leaks.leaks(d, i).collect()}
    assert got == want and len(want) > 20
    # several ranges of hashes, and passages spread over several keys
    assert {tuple(r) for r in leaks.leaks(d, i, most=200, hot=3).collect()} == want
    assert leaks.leaks(d.limit(0), i).count() == 0 and leaks.leaks(d, i.limit(0)).count() == 0


@pytest.mark.parametrize("count", [1000, 200_000])
def test_bit_tables_filter_alike_at_any_size(spark, count):
    rng = np.random.default_rng(5)
    inside = rng.integers(-(2**63), 2**63, count)
    table = leaks.table(spark.createDataFrame([(int(x),) for x in inside[:5000]], "h long") if count < 5000 else spark.range(count).select(F.xxhash64("id").alias("h")), "h", count)
    known = inside.view(np.uint64) if count < 5000 else np.array([r.h for r in spark.range(2000).select(F.xxhash64("id").alias("h")).collect()]).view(np.uint64)
    assert table.has(known).all()
    assert table.has(rng.integers(0, 2**63, 100_000).view(np.uint64) * np.uint64(2) + np.uint64(1)).mean() < 0.02


# -- 6: tokens

ODD = ["a  b", "a   b \n c", "  lead", "trail  ", "<|endoftext|> a", "a　 b", "\t x y", "don't 's  's", "", None, "   ", "👩‍👩‍👧 a", "a \u0085b \x1c c", "_ _ __  _", "é é", "x" * 5000, " " * 300 + "y"]


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), LETTERS, st.text(max_size=40).filter(lambda s: s.isprintable())), max_size=8))
def test_piecewise_ids_equal_those_of_whole_texts(texts):
    enc = tokens.encoder(tokens.tokenizer_path())
    ids = enc.encode(pa.array(texts, pa.string()))
    assert ids.to_pylist() == reference_ids(texts)
    assert enc.count(pa.array(texts, pa.string())).tolist() == [len(x) for x in ids.to_pylist()]
    assert tokens.decode_batch(ids, tokens.tokenizer_path()).to_pylist() == [t or "" for t in texts]


def test_ids_of_odd_texts(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in tokens.encode(df, "doc_id", "text").collect()}
    assert [got[n] for n in range(len(ODD))] == reference_ids(ODD)
    starts = {r.doc_id: r.starts for r in tokens.encode(df, "doc_id", "text", offsets=True).collect()}
    assert all(len(starts[n]) == len(got[n]) and starts[n] == sorted(starts[n]) for n in got)
    assert starts[0][0] == 0
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert [back[n] for n in range(len(ODD))] == [t or "" for t in ODD]
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


# -- 7: packing

@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=12), st.integers(1, 100))
def test_best_fill_is_a_best_subset(sizes, space):
    chosen = packing.best_fill(sizes, space)
    best = {0}
    for s in sizes:
        best |= {b + s for b in best if b + s <= space}
    assert len(set(chosen)) == len(chosen) and sum(sizes[k] for k in chosen) == max(best)


def test_containers_hold_all_tokens_once(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["partie", "roque", "pendule", "forfait", "club"], k=rng.randint(1, 120))) for _ in range(400)] + ["long " * 700, None, "", " ", "partie " * 128]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("shard", F.lit(9))
    got = packing.pack(df, "doc_id", "text", capacity=128, shard_items=150).collect()
    counts = [len(x) for x in reference_ids(texts)]
    by_doc, by_box = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append((r.part, r.first_token, r.n_tokens))
        by_box[r.container] = by_box.get(r.container, 0) + r.n_tokens
    assert max(by_box.values()) <= 128
    assert set(by_doc) == {n for n, c in enumerate(counts) if c}
    for n, parts in by_doc.items():
        parts.sort()
        assert sum(p[2] for p in parts) == counts[n]
        assert len(parts) == 1 if counts[n] <= 128 else all(p[2] == 128 for p in parts[:-1])
        assert [p[1] for p in parts] == [128 * p[0] for p in parts]
    assert sum(counts) / (128 * len(by_box)) > 0.97
    assert packing.pack(df.limit(0), "doc_id", "text").count() == 0


# -- 8: spam

PROSE = "Le directeur du tournoi peut reporter la ronde si la salle est fermée et que les joueurs sont prévenus par le club. "
KEYWORDS = "échiquier pliant pas cher, pendule digitale promo, échiquier pliant soldes, mallette bois, pendule digitale neuf, échiquier pliant promo, "
LINKS = "\n".join(f"http://club{n}-shop.example/cat?id={n}" for n in range(20))
PRODUCTS = "\n".join(f"Pendule digitale Z-{n} | {n},99 € – promo" for n in range(20))


@pytest.mark.parametrize(
    "text,expected",
    [
        (KEYWORDS * 6, True), (LINKS, True), (PRODUCTS, True), ("Tags : " + KEYWORDS * 3, True), ("#Pendule #Échiquier #Roque " * 12, True), (PROSE + "\n\n" + KEYWORDS * 9, True),
        (PROSE * 8, False), (PROSE * 8 + "\n" + KEYWORDS + "\n" + LINKS[:200], False), ("| Ronde | Blancs | Noirs |\n|---|---|---|\n" + "| 1 | 1-0 | 0-1 |\n" * 30, False),
        ("1.e4 e5 2.Cf3 Cc6 3.Fb5 a6 4.Fa4 Cf6 " * 8, False), ("\n".join(f"{n}. Chapitre ............ {n * 3}" for n in range(20)), False), (None, False), ("", False), ("   \n", False), ("Roque", False),
    ],
)
def test_spam_pages(spark, text, expected):
    rows = [(n, PROSE * 5) for n in range(3)] + [(9, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("zz"))
    got = {r.doc_id for r in spam.spam_pages(df, "doc_id", "text", checkpoint).collect()}
    assert got == ({9} if expected else set())


def test_all_words_of_a_page_vote_on_its_language():
    late = "pendule mallette échiquier " * 10 + "le directeur peut reporter la ronde si la salle est fermée"
    assert spam.segments(late)[0] == "fr"
    between = "\n".join(x for n in range(8) for x in (f"pendule mallette {n}", "le joueur et la pendule"))
    assert spam.segments(between)[0] == "fr"
    accents = "échecs, départage, échiquier, " * 20 + "le joueur et la pendule du club"
    assert spam.segments(unicodedata.normalize("NFD", accents)) == spam.segments(accents)


#: Sentences in languages without a word list; each is used many times over, so their words are repeated.
FOREIGN = {
    "pl": ["Zawodnik przesuwa figurę na szachownicy i nie może cofnąć ruchu do końca partii.", "Jeśli arbiter zapisuje wynik, to kapitan musi go potwierdzić w ciągu minuty.", "W każdej rundzie drużyna gra z innym przeciwnikiem na trzech deskach."],
    "ru": ["Игрок передвигает фигуру на доске и не может вернуть ход до конца партии.", "Если судья записывает результат, то капитан должен подтвердить его в течение минуты.", "В каждом туре команда играет с новым соперником на трёх досках."],
    "zh": ["棋手在棋盘上移动棋子，不能再更改这一步棋。", "如果裁判记录比赛结果，队长必须在一分钟内确认。", "每一轮比赛中，队伍都要和不同的对手在三张棋盘上对弈。"],
    "sv": ["Spelaren flyttar pjäsen på brädet och får inte ta tillbaka draget före partiets slut.", "Om domaren antecknar resultatet måste lagledaren bekräfta det inom en minut."],
}


@pytest.mark.parametrize("lang", FOREIGN)
@pytest.mark.parametrize("learned", [False, True])
def test_prose_of_languages_without_a_list_is_no_spam(spark, lang, learned):
    prose = " ".join(FOREIGN[lang] * 14)
    tags = "\n".join(["szachy tanio", "zegar promocja", "plansza sklep", "szachy promocja", "zegar tanio", "plansza promocja"] * 8)
    rows = [(n, PROSE * (400 if learned else 2)) for n in range(2)] + [(8, prose), (9, tags)]
    assert {r.doc_id for r in spam.spam_pages(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()} == {9}


def test_letters_are_learned_from_all_pages(spark):
    # one page tells what Dutch looks like, and it is one that every second page leaves out
    dutch = "De speler moet de stelling op het bord zetten en mag niet terug naar de schaakklok voor het einde van de partij. " * 250
    spread = spark.range(9_000, 9_100).where(F.pmod(F.xxhash64("id"), F.lit(2)) == 1).first().id
    rows = [(n, PROSE) for n in range(8_000)] + [(spread, dutch), (9_200, "Stelling schaakklok bord partij einde speler. " * 30)]
    assert {r.doc_id for r in spam.spam_pages(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()} == {9_200}


def test_links_need_no_known_host():
    for ending in ("it", "co.uk", "museum", "pl"):
        kinds = {k for k, *_ in spam.segments("\n".join(f"Scacchi club-{n}.{ending}" for n in range(40)))[1]}
        assert kinds == {spam.LINKS}
    assert spam.LINKS not in {k for k, *_ in spam.segments("Le joueur a fini sa partie.Le capitaine signe la feuille.\n12.Cf3 Cc6 13.Fb5 a6\nVoir l'article 3.2.1 du chapitre.")[1]}


def test_no_pages_no_spam(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spam.spam_pages(df, "doc_id", "text").count() == 0


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    import duckdb
    import parity

    con = duckdb.connect()
    parity.tables(con, FOLDER)
    assert parity.compare(spark, con, queries.QUERIES[name], queries.ORACLES[name], FOLDER) is None
