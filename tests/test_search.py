import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import evaluate, matchquery, search, textindex

TITLES = ["Isaac Newton", "Newton", "Knewton news", "Enewton", "Café de Flore", "O'Brien UK", "newtonewton twice", "AI in UK", "the mercury planet", "Newton Newton a"]


def index(spark, rows, kind):
    return textindex.build(spark.createDataFrame(list(enumerate(rows, 1)), "doc_id long, body string"), kind)


def scores(spark, made, terms, mode):
    table = spark.createDataFrame([("q", t) for t in terms], "key string, term string")
    return {r["doc_id"]: r["bm25"] for r in textindex.bm25(made, table, mode).collect()}


def fts(rows, kind, match):
    db = sqlite3.connect(":memory:")
    how = {"unicode": "unicode61 remove_diacritics 2", "trigram": "trigram"}[kind]
    db.execute(f"create virtual table t using fts5(body, tokenize='{how}')")
    db.executemany("insert into t(rowid, body) values (?, ?)", list(enumerate(rows, 1)))
    return dict(db.execute("select rowid, bm25(t) from t where t match ?", (match,)).fetchall())


@pytest.mark.parametrize("kind", ["unicode", "trigram"])
@pytest.mark.parametrize("terms,mode", [(["newton"], "and"), (["uk"], "and"), (["newton", "uk"], "and"), (["newton", "uk"], "or"), (["cafe"], "and"), (["CAFÉ"], "and"), (["o'brien"], "and"), (["newton", "!!"], "and")])
def test_bm25_is_that_of_fts5(spark, kind, terms, mode):
    want = fts(TITLES, kind, f" {mode.upper()} ".join(f'"{t}"' for t in terms))
    got = scores(spark, index(spark, TITLES, kind), terms, mode)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in want)


def test_bare_words_drop_short_terms(spark):
    made = index(spark, TITLES, "trigram")
    assert scores(spark, made, ["uk", "newton"], "bare") == scores(spark, made, ["newton"], "and")


@pytest.mark.parametrize("kind", ["unicode", "trigram"])
def test_random_texts(spark, kind):
    rng = random.Random(5)
    rows = [" ".join(rng.choice(["a a", "ab", "aba", "Éa", "b-a", "x"]) for _ in range(rng.randint(1, 9))) for _ in range(40)]
    made = index(spark, rows, kind)
    for terms in (["a a"], ["aba"], ["ab", "b-a"]):
        want = fts(rows, kind, " OR ".join(f'"{t}"' for t in terms))
        got = scores(spark, made, terms, "or")
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_tokenisers(spark):
    row = spark.sql("select 'Ça_va ñandú-½ ΣΑΣ Йё' as s").select(text.unicode_tokens(F.col("s")).alias("u"), text.trigrams(F.lit("aÉbc")).alias("t"), text.trigrams(F.lit("ab")).alias("n")).first()
    assert row["u"] == ["ca", "va", "nandu", "½", "σασ", "йё"]
    assert row["t"] == ["aéb", "ébc"] and row["n"] == []


def test_kept_terms(spark):
    rows = spark.createDataFrame([("a", "x", 2.0), ("a", "y", 1.0), ("b", "z", 0.5), ("b", "w", 0.7)], "key string, term string, idf double")
    assert sorted((r["key"], r["term"]) for r in search.kept_terms(rows).collect()) == [("a", "x"), ("b", "w")]


#: Published example rankings: bm25 and rank in order of the fused score.
GOLDEN = {
    "newton": [(-20.69, 1.37e-5, -0.8529), (-25.35, 2.43e-8, -0.8004), (-24.64, 5.82e-8, -0.7784), (-24.64, 4.56e-8, -0.7783), (-23.96, 2.87e-8, -0.7566)],
    "mercury": [(-22.37, 1.23e-5, -0.8663), (-26.86, 2.43e-8, -0.8004), (-26.12, 4.15e-8, -0.7786), (-22.37, 6.39e-6, -0.7702), (-25.42, 2.78e-8, -0.7576)],
}


@pytest.mark.parametrize("name", GOLDEN)
def test_fusion_goldens(spark, name):
    rows = GOLDEN[name]
    low, high = min(r[0] for r in rows), max(r[1] for r in rows)
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, b double, r double, want double")
    got = table.select("i", "want", search.fused(F.col("b"), F.lit(low), F.col("r"), F.lit(high)).alias("s")).orderBy("i").collect()
    assert all(abs(r["s"] - r["want"]) < 1e-4 for r in got)


def small_model(spark):
    pages = spark.createDataFrame(
        [(i, 0 if i != 8 else 14, t, i if i != 2 else None, 1.0 / i, None) for i, t in enumerate(TITLES, 1)],
        "id long, ns int, title string, text_id long, rank1 double, authority double",
    )
    return search.build(pages, spark.createDataFrame([(i, f"text of {t}") for i, t in enumerate(TITLES, 1)], "id long, text string"))


def test_search_returns_articles_with_a_text_once(spark):
    rows = search.search_query(small_model(spark), "newton").collect()
    assert {r["page_id"] for r in rows} == {1, 3, 4, 7, 10}
    assert search.search_query(small_model(spark), "  ").count() == 0
    assert search.search_query(small_model(spark), "uk").count() == 1
    assert search.search_query(small_model(spark), "newton unknownword").count() == 0


def test_batch_search_reads_operators(spark):
    made = small_model(spark)
    asked = spark.createDataFrame([("a", "newton NOT news"), ("b", 'say OR "newton"'), ("c", "uk newton")], "key string, query string")
    found = {}
    for r in search._raw(made.title_trigram, asked).collect():
        found.setdefault(r["key"], set()).add(r["doc_id"])
    every = {1, 2, 3, 4, 7, 10}
    assert found == {"a": every - {3}, "b": every, "c": every}
    assert {r["page_id"] for r in search.search_query(made, '"isaac new" OR enewton', interactive=False).collect()} >= {1, 4}
    for query in ("o'brien", "a AND", "enewton-x", 'say "x', "(x"):
        with pytest.raises(ValueError):
            search.search_query(made, query, interactive=False)


def test_ndcg(spark):
    results = spark.createDataFrame([("a", 1, "x"), ("a", 2, "u"), ("a", 3, "y"), ("b", 1, "x")], "key string, position int, title string")
    qrels = spark.createDataFrame([("a", "x", 1, True), ("a", "y", 2, True), ("a", "gone", 3, False), ("b", "x", 0, True), ("c", "z", 1, True)], "key string, title string, rel int, found boolean")
    rows = {r["key"]: r for r in evaluate.ndcg(results, qrels, 10).collect()}
    ideal = 2 / math.log2(2) + 1 / math.log2(3)
    assert set(rows) == {"a", "c"}
    assert math.isclose(rows["a"]["ndcg_pessimistic"], (1 + 2 / math.log2(4)) / ideal)
    assert math.isclose(rows["a"]["ndcg_optimistic"], (1 + 2 / math.log2(3)) / ideal)
    assert rows["c"]["ndcg_pessimistic"] == 0
    assert evaluate.means(evaluate.ndcg(results.limit(0), qrels.limit(0))).first()["ndcg_pessimistic"] is None


def test_grid_search_agrees_with_single_runs(spark):
    made = small_model(spark)
    queries = spark.createDataFrame([("q1", "newton"), ("q2", "uk")], "key string, query string")
    qrels = spark.createDataFrame([("q1", "Newton Newton a", 2, True), ("q2", "O'Brien UK", 1, True)], "key string, title string, rel int, found boolean")
    settings = evaluate.grid(k1=(50,), title=(1.0, 3.0), text=(1.0,), alpha=(0.7, 0.9))
    rows = {(r["title_weight"], r["alpha"]): r["ndcg_pessimistic"] for r in evaluate.grid_search(made, queries, qrels, settings).collect()}
    for s in settings:
        one = search.search(made, queries, False, s).select("key", "position", "title")
        want = evaluate.means(evaluate.ndcg(one, qrels)).first()["ndcg_pessimistic"]
        assert math.isclose(rows[s.title_unicode, s.alpha], want)


def test_best_pages_of_many_keys_are_those_of_bm25(spark):
    """Ties by id, terms without tokens and terms that nothing holds, each key's best pages at most ``k``."""
    rng = random.Random(3)
    words = ["ab", "abc", "bcd", "x", "newton", "é", "a"]
    rows = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(60)]
    asked = [(f"k{i}", t) for i in range(25) for t in {rng.choice([*words, "!!", "qqz"]) for _ in range(rng.randint(1, 3))}]
    terms = spark.createDataFrame(asked, "key string, term string")
    pages = spark.createDataFrame([(i, 100 - i) for i in range(1, 61) if i % 7], "doc_id long, id long")
    for kind in ("unicode", "trigram"):
        made = index(spark, rows, kind)
        for mode in ("and", "or", "bare"):
            want = {}
            for r in textindex.bm25(made, terms, mode).join(pages, "doc_id").collect():
                want.setdefault(r["key"], []).append((round(r["bm25"], 12), r["id"]))
            got = {}
            for r in textindex.best(made, terms, mode, 5, pages).collect():
                got.setdefault(r["key"], []).append((round(r["bm25"], 12), r["id"]))
            assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:5] for k, v in want.items()}


@pytest.mark.parametrize("kind", ["unicode", "trigram"])
def test_narrowed_index_has_all_postings_of_its_tokens_and_the_whole_statistics(spark, kind):
    rows = [*TITLES, "", None, "ab", "Newto", "n newtο"]
    made = index(spark, rows, kind)
    tokens = ["newton", "new"] if kind == "unicode" else ["new", "wto", "qqq"]
    starts = None if kind == "trigram" else spark.createDataFrame([("kn",)], "token string")
    narrow = textindex.narrowed(made, spark.createDataFrame([(t,) for t in tokens], "token string"), starts)
    rule = F.col("term").isin(tokens) | (F.lit(kind == "unicode") & F.col("term").startswith("kn"))
    rows = lambda x: sorted((r["term"], r["doc_id"], r["size"], r["n"], tuple(r["places"])) for r in x.collect())
    assert rows(narrow.postings) == rows(made.postings.where(rule)) != []
    assert (narrow.n, narrow.total) == (made.n, made.total)


def test_operators_read_texts_without_shuffling_an_index(spark, monkeypatch):
    """Postings are made of the tokens that are asked, not of every token."""
    made, seen = index(spark, TITLES, "unicode"), []
    whole = textindex.postings
    monkeypatch.setattr(textindex, "postings", lambda texts, kind, tokens=None, beginnings=(): seen.append((tokens, beginnings)) or whole(texts, kind, tokens, beginnings))
    asked = spark.createDataFrame([("a", "newton NOT kn*")], "key string, query string")
    assert {r["doc_id"] for r in matchquery.answered(made, asked).collect()} == {1, 2, 10}
    assert seen == [(["newton"], ["kn"])]


@pytest.mark.parametrize("kind", ["unicode", "trigram"])
@pytest.mark.parametrize("stored", [False, True])
def test_terms_looked_up_in_texts_are_those_of_bm25(spark, tmp_path, kind, stored):
    """Phrases of several tokens, with spaces, that overlap themselves or lie in each other; empty texts count for the mean. No places are kept."""
    rng = random.Random(7)
    words = ["eriner", "erineriner", "o'brien", "brien", "o", "aaaa", "aa", "x\ty", "É", "thanea"]
    rows = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 8))) for _ in range(80)] + ["", None]
    asked = ["eriner", "iner", "o'brien", "aaa", "aa", "riner eri", "x\ty", "é", "!!", "nowhere"]
    terms = spark.createDataFrame([(t, t) for t in asked], "key string, term string")
    pages = spark.createDataFrame([(i, i) for i in range(1, len(rows) + 1)], "doc_id long, id long")
    made = index(spark, rows, kind)
    made = made.stored(f"file://{tmp_path}/i") if stored else made
    seen = textindex.looked(made, terms)
    assert isinstance(seen, textindex.Looked) and "places" not in str(seen.rows.schema)
    want = {(r["key"], r["doc_id"]): r["bm25"] for r in textindex.bm25(made, terms, "and").collect()}
    got = {(r["key"], r["id"]): r["bm25"] for r in textindex.best(seen, terms, "and", 100, pages).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    if kind == "trigram":
        once = fts([r or "" for r in rows], kind, '"eriner"')
        assert {i: got["eriner", i] for i in once} == pytest.approx(once)


def test_titles_that_start_alike_are_judged_without_a_row_each(spark):
    """A search's nDCGs are those of judgements written out, which are as many as the square of the pages."""
    from lodestone.plans import registry

    rows = [(i, 0 if i % 11 else 14, f"{'the' if i % 3 else 'of'} x{i} [{i}]", i if i % 7 else None) for i in range(400)]
    pages = spark.createDataFrame(rows, "id long, ns int, title string, text_id long")
    queries, judged, alike = registry.judgements(pages)
    asked = [r for r in rows if r[1] == 0 and r[3] is not None and r[0] % 50 == 0]
    assert judged.count() == 2 * len(asked) and alike.count() == len(asked) == queries.count()
    near = [r[2] for r in rows if r[1] == 0 and r[3] is not None]
    every = [(f"syn-{r[0]}", t, 2 if t == r[2] else 1, True) for r in asked for t in near if t[:2] == r[2][:2]]
    every = spark.createDataFrame(every, "key string, title string, rel int, found boolean")
    found = [(f"syn-{r[0]}", p, t) for r in asked for p, t in enumerate(random.Random(r[0]).sample([*near, r[2]], 10), 1)]
    found = spark.createDataFrame(found, "key string, position int, title string")
    ordered = lambda x: [tuple(r) for r in x.orderBy("key").collect()]
    got, want = ordered(evaluate.ndcg(found, judged, alike=alike)), ordered(evaluate.ndcg(found, every))
    assert [g[0] for g in got] == [w[0] for w in want] and all(math.isclose(a, b) for g, w in zip(got, want, strict=True) for a, b in zip(g[1:], w[1:], strict=True))
