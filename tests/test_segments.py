import math
import random

import pytest

from lodestone.operators import segments, textindex
from lodestone.operators.segments import SegmentedIndex

SCHEMA = "doc_id long, body string, version long"
WORDS = ["abc", "abcd", "bcd cab", "Éabc", "x", "zz abc"]


def scores(spark, index, mode="or"):
    terms = spark.createDataFrame([("a", "abc"), ("a", "bcd"), ("b", "bcd cab"), ("c", "zz")], "key string, term string")
    return {(r["key"], r["doc_id"]): r["bm25"] for r in textindex.bm25(index, terms, mode).collect()}


def same(a, b):
    return a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)


@pytest.mark.parametrize("kind", ["unicode", "trigram"])
def test_any_changes_equal_a_rebuilt_index(spark, tmp_path, kind):
    rng, state, versions = random.Random(kind), {}, {}
    made = SegmentedIndex(spark, f"file://{tmp_path}/i", kind)
    merged = 0
    for number in range(6):
        rows = []
        for _ in range(30 if number == 0 else rng.randint(1, 9)):
            doc, version = rng.randint(1, 40), number * 10 + rng.randint(0, 15)
            body = None if rng.random() < 0.25 else " ".join(rng.choices(WORDS, k=rng.randint(0, 6)))
            if any(r[0] == doc for r in rows):
                continue
            rows.append((doc, body, version))
            if version > versions.get(doc, -1):
                versions[doc], state[doc] = version, body
        made.apply(spark.createDataFrame(rows, SCHEMA), number)
        merged += made.compact(3)
        made.apply(spark.createDataFrame([(1, "abc " * 50, 10_000)], SCHEMA), number)  # the batch again
    live = [(d, b) for d, b in state.items() if b is not None]
    index, rebuilt = made.read(), textindex.build(spark.createDataFrame(live, "doc_id long, body string"), kind)
    assert (index.n, index.total) == (rebuilt.n, rebuilt.total) and merged > 0
    assert len(made.manifest()["segments"]) < 6
    assert same(scores(spark, index), scores(spark, rebuilt))
    assert sorted(map(tuple, index.vocabulary().collect())) == sorted(map(tuple, rebuilt.vocabulary().collect()))


def test_a_failed_batch_leaves_the_index_as_it_was(spark, tmp_path):
    made = SegmentedIndex(spark, f"file://{tmp_path}/i")
    assert made.read().vocabulary().count() == 0 and made.read().n == 0
    made.apply(spark.createDataFrame([(1, "abc", 1)], SCHEMA), 0)
    broken = spark.createDataFrame([(2, "bcd", 1)], SCHEMA).selectExpr("doc_id", "raise_error('no') AS body", "version")
    with pytest.raises(Exception, match="no"):
        made.apply(broken, 1)
    assert made.manifest()["version"] == 1 and scores(spark, made.read()).keys() == {("a", 1)}
    made.apply(spark.createDataFrame([(2, "bcd", 1)], SCHEMA), 1)
    assert made.manifest()["batch"] == 1 and made.read().n == 2


def test_deleted_texts_stay_deleted_after_merges(spark, tmp_path):
    made = SegmentedIndex(spark, f"file://{tmp_path}/i")
    for number, rows in enumerate([[(1, "abc", 1), (2, "abc", 1)], [(1, None, 5)], [(3, None, 1)], [(1, "abc late", 3)]]):
        made.apply(spark.createDataFrame(rows, SCHEMA), number)
    assert made.compact(2) >= 1
    made.apply(spark.createDataFrame([(1, "abc later", 4)], SCHEMA))
    assert scores(spark, made.read()).keys() == {("a", 2)} and made.read().n == 1
    made.apply(spark.createDataFrame([(1, "abc again", 6)], SCHEMA))
    assert scores(spark, made.read()).keys() == {("a", 1), ("a", 2)}
    assert [r["added"] for r in made.history().orderBy("version").collect()][:2] == [2, -1]


@pytest.mark.parametrize("sizes,want", [([], None), ([100, 1, 1], None), ([100, 1, 1, 1], (1, 4)), ([100, 9, 1, 1, 1], (2, 5)), ([9, 9, 9, 1], (0, 4)), ([9, 9, 9, 1, 1], (0, 5)), ([1, 1, 1, 100], (0, 3))])
def test_runs_of_a_tier(sizes, want):
    assert segments._run(sizes, 3) == want
