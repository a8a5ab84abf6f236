import math
import random
import re
import sqlite3

import pytest

from lodestone.operators import matchquery, textindex

WORDS = ["red", "reds", "blue", "Café", "green", "o'brien", "a", "b-c"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    return [" ".join(rng.choices(WORDS, k=rng.randint(0, 12))) for _ in range(80)]


def fts(rows, kind, match):
    db = sqlite3.connect(":memory:")
    how = {"unicode": "unicode61 remove_diacritics 2", "trigram": "trigram"}[kind]
    db.execute(f"create virtual table t using fts5(body, tokenize='{how}')")
    db.executemany("insert into t(rowid, body) values (?, ?)", list(enumerate(rows, 1)))
    return dict(db.execute("select rowid, bm25(t) from t where t match ?", (match,)).fetchall())


QUERIES = [
    "red", "red blue", "red AND blue", "red OR blue", "red NOT blue", "red blue NOT green", "red OR blue AND green", "(red OR blue) AND green", "red NOT (blue OR green)",
    '"red blue"', '"red blue" OR green', "red + blue", "re*", "red re*", '"blue re" *', "^red", "^red OR ^blue", "caf*", "cafe NOT re*", "(red)", "red AND (blue OR (green NOT a))",
    '"o\'brien" blue', "a NOT a", "red NOT blue NOT green", '"b c" AND red', "zzz", "zzz OR red", '"!!"', '"!!" OR red', "red \"!!\"", "NEAR", "a AND b AND c",
]


@pytest.mark.parametrize("kind", ["unicode", "trigram"])
def test_queries_match_and_score_as_fts5(spark, rows, kind):
    index = textindex.build(spark.createDataFrame(list(enumerate(rows, 1)), "doc_id long, body string"), kind)
    asked = [q for q in QUERIES if not (kind == "trigram" and re.search(r"[*^+]", q))]  # words joined by + are a phrase with spaces here
    got = {q: {} for q in asked}
    for r in matchquery.answered(index, spark.createDataFrame([(q, q) for q in asked], "key string, query string")).collect():
        got[r["key"]][r["doc_id"]] = r["bm25"]
    for q in asked:
        want = fts(rows, kind, q)
        assert got[q].keys() == want.keys(), q
        assert all(math.isclose(got[q][k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in want), q
    assert sum(map(len, got.values())) > 300


def test_near_matches_as_fts5(spark, rows):
    index = textindex.build(spark.createDataFrame(list(enumerate(rows, 1)), "doc_id long, body string"), "unicode")
    asked = ["NEAR(red blue)", "NEAR(red blue, 0)", "NEAR(red blue green, 2)", 'NEAR("red blue" green, 1) NOT a', "NEAR(red red, 1)", "NEAR(re* blue, 1) OR reds"]
    got = {q: set() for q in asked}
    for r in matchquery.answered(index, spark.createDataFrame([(q, q) for q in asked], "key string, query string")).collect():
        got[r["key"]].add(r["doc_id"])
    assert got == {q: set(fts(rows, "unicode", q)) for q in asked}


@pytest.mark.parametrize("query", ["o'brien", "enewton-x", "AND", "a AND", "(a", "a)", "a OR OR b", "*", "NEAR(a b, c)", "a (b)", 'say "x', "NOT a", "^"])
def test_what_is_no_query_is_refused(query):
    with pytest.raises(ValueError):
        matchquery.parse(query)
    with pytest.raises(sqlite3.OperationalError):
        fts(["x"], "unicode", query)


def test_too_many_ways_are_refused(spark):
    index = textindex.build(spark.createDataFrame([(1, "x")], "doc_id long, body string"), "unicode")
    query = " AND ".join(f"(a{i} OR b{i})" for i in range(12))
    with pytest.raises(ValueError, match="ways"):
        matchquery.answered(index, spark.createDataFrame([("q", query)], "key string, query string"))
    assert matchquery.answered(index, spark.createDataFrame([("q", "  "), ("r", None), ("s", "x")], "key string, query string")).count() == 1
