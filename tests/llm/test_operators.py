"""Operators without a contract: lines, near-copies, classifier, language models, quotes, wavelets, components, and the pipeline."""

import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import classifier, lines, lm, neartext, simhash, threads
from lodestone.llm.shared import connected
from lodestone.llm.wavelet import Wavelet, build

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = np.random.default_rng(0)
    pairs = {
        "chain": [(i, i + 1) for i in range(120)],
        "star": [(0, i) for i in range(1, 120)],
        "random": [tuple(map(int, p)) for p in rng.integers(0, 150, (90, 2))],
        "none": [],
    }[shape]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame([*pairs, (3, 3), (None, 4)], "a long, b long")).collect()}
    nodes = {x for p in pairs for x in p if p[0] != p[1]}
    assert set(got) == nodes
    want = roots([p for p in pairs if p[0] != p[1]], nodes)
    assert len({(want[n], got[n]) for n in nodes}) == len(set(want.values())) == len(set(got.values()))


def test_wavelet():
    rng = np.random.default_rng(0)
    for n in (0, 1, 70_000):
        ids = rng.zipf(1.4, n) % 3000
        w = Wavelet(build(ids, np.array([n])))
        assert (w.tokens() == ids).all() and w.lengths.tolist() == [n]
        for i in rng.integers(0, max(n, 1), 10 if n else 0).tolist():
            token = int(ids[i])
            places = np.nonzero(ids == token)[0]
            assert w.access(i) == token and w.count(token) == len(places) and w.count(token, 0, i) == (places < i).sum()
            k = int(rng.integers(0, len(places)))
            assert w.find(token, k) == places[k] and w.find(token, len(places)) is None
        assert w.count(2999_999) == 0 and w.find(2999_999, 0) is None


def normal(line):
    return " ".join(re.findall(r"[^\W_]+", line.lower()))


def test_lines_keep_one_of_each_group(spark):
    base = " ".join(f"word{i}" for i in range(60))
    near = base.replace("word30", "word3x")
    texts = [f"{base}\nother line here", f"A\n{near}!", base.upper() + "\n\nA", None, "", "other  LINE, here\nother line here", " ".join(f"q{i}" for i in range(50))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1, texts[1])], "doc_id long, text string")
    rows = {(r["doc_id"], r["line_no"]): r for r in lines.groups(docs).collect()}
    assert lines.groups(docs).count() == sum(len(t.split("\n")) for t in texts if t is not None) + 2
    assert rows[0, 0]["kept"] and not rows[2, 0]["kept"] and rows[2, 0]["first_doc"] == 0
    assert not rows[1, 1]["kept"] and rows[1, 1]["first_doc"] == 0
    assert rows[1, 0]["kept"] and not rows[2, 2]["kept"] and rows[2, 1]["kept"]
    assert not rows[5, 0]["kept"] and not rows[5, 1]["kept"]
    cleaned = {r["doc_id"]: r["text"] for r in lines.cleaned(docs).collect()}
    assert cleaned[5] == "" and cleaned[3] is None and cleaned[6] == texts[6]


@here
def test_exact_lines_and_edit_limits(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"].split("\n") for r in docs.collect()}
    seen = {}
    for r in lines.groups(docs).orderBy("doc_id", "line_no").collect():
        line, first = normal(text[r["doc_id"]][r["line_no"]]), normal(text[r["first_doc"]][r["first_line"]])
        if not line:
            assert r["kept"]
            continue
        if line in seen:
            assert not r["kept"]
        seen.setdefault(line, r)
        assert r["kept"] == ((r["doc_id"], r["line_no"]) == (r["first_doc"], r["first_line"]))


def edits(s, t):
    row = list(range(len(t) + 1))
    for i, x in enumerate(s, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(t, 1):
            left, row[j] = row[j], min(left + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


@pytest.mark.parametrize("n", [3, 9, 10, 11, 12, 30])
def test_lines_that_edits_hold_alike_meet(spark, n):
    # Each line has a copy with one word exchanged; of those within the edit limit nine in ten or more are found, and nothing else is.
    rng = np.random.default_rng(n)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(6, 9))))
    rows, near = [], []
    for i in range(60):
        w = [word() for _ in range(n)]
        other = list(w)
        at = int(rng.integers(0, n))
        other[at] = word() if n > 9 else other[at][:-1] + "z"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
        near.append(edits(rows[-2][1], rows[-1][1]) <= int(0.15 * max(len(rows[-2][1]), len(rows[-1][1]))))
    got = {r["doc_id"]: r["first_doc"] for r in lines.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [got[2 * i + 1] == 2 * i for i in range(60)]
    assert all(got[2 * i] == 2 * i and (found[i] or got[2 * i + 1] == 2 * i + 1) and (near[i] or not found[i]) for i in range(60))
    assert sum(found) >= 0.9 * sum(near) > 0


def test_large_buckets_lose_no_link(spark):
    rng = np.random.default_rng(4)
    words = [f"v{i:03d}" for i in range(100)]
    rows = []
    for i in range(24):  # all in the same buckets, and each pair about as far apart as the limit
        w = list(words)
        for at in rng.choice(40, 20, replace=False).tolist():
            w[at] = f"{i:04d}"
        rows.append((i, " ".join(w)))
    linked = [(i, j) for i in range(24) for j in range(i) if edits(rows[i][1], rows[j][1]) <= int(0.15 * len(rows[i][1]))]
    want = roots(linked, range(24))
    got = {r["doc_id"]: r["first_doc"] for r in lines.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_crowded_buckets_store_no_pairs_that_stay_apart(spark, monkeypatch):
    rng = np.random.default_rng(6)
    stored, cut = [], lines.cut

    def counted(df):
        out = cut(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(lines, "cut", counted)
    monkeypatch.setattr(lines, "PART", 7, raising=False)
    own = lambda: ["".join(rng.choice(list("klmnopqrst"), 9)) for _ in range(20)]
    rows = [(i, " ".join([f"v{j:03d}" for j in range(60)] + own())) for i in range(150)]
    rows.append((150, rows[77][1].replace("v030", "w030")))
    got = {r["doc_id"]: r["first_doc"] for r in lines.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(150)} | {150: 77}
    assert max(stored) <= 20 * len(rows)


def test_pairs_are_decided_once(spark, monkeypatch):
    # What a bucket's first is far from is not met again, and of pairs of a bucket only those with an order and two roots cost edit distances.
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("klmnopqrst"), 9))
    rows, later, met = [], [], lines._met
    for i in range(20):  # two lines each that share windows and little else
        same = [word() for _ in range(8)]
        rows += [(2 * i + j, " ".join([*same, *[word() for _ in range(30)]])) for j in range(2)]

    def held(members, texts):
        later.append(members.count())
        return met(members, texts)

    monkeypatch.setattr(lines, "_met", held)
    got = {r["doc_id"]: r["first_doc"] for r in lines.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(40)} and later == [0]
    monkeypatch.setattr(lines, "cut", lambda df: df)
    members = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "key long, id long, root long")
    texts = lines._coded(spark.createDataFrame([(1, rows[0][1]), (2, rows[1][1])], "id long, words string"))
    plan = met(members, texts)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("id_a#") and max(plan.index(x) for x in ("(id_a#", "NOT (root_a#", "array_intersect(")) < plan.index("levenshtein(")


def test_near_is_the_edit_limit(spark):
    # Lines with words exchanged, letters changed and parts moved, short and long, within the limit, about it and far from it.
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdeé"), int(rng.integers(1, 9))))
    pairs = []
    for i in range(120):
        a = [word() for _ in range(int(rng.choice([4, 30, 70, 110])))]
        b = list(a)
        for at in rng.choice(len(a), int(len(a) * rng.uniform(0, 0.5)), replace=False).tolist() if i % 4 else []:
            b[at] = word()
        if i % 3 == 0:
            at = int(rng.integers(0, len(b)))
            b = b[at:] + b[:at] if i % 2 else b[at // 4 :]
        text = list(" ".join(b))
        for at in rng.choice(len(text), int(len(text) * rng.uniform(0, 0.2)), replace=False).tolist() if i % 4 == 0 else []:
            text[at] = rng.choice(list("abxyz"))
        pairs.append((" ".join(a), " ".join("".join(text).split())))
    pairs += [(b, a) for a, b in pairs]
    coded = lines._coded(spark.createDataFrame([(2 * i + j, x) for i, p in enumerate(pairs) for j, x in enumerate(p)], "id long, words string"))
    ids = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(len(pairs))], "a long, b long")
    got = {r["a"] // 2 for r in lines._verified(ids, coded).collect()}
    half = [edits(a, b) <= int(0.15 * max(len(a), len(b))) for a, b in pairs[:120]]
    assert got == {i for i, near in enumerate(half * 2) if near} and 20 < sum(half) < 100


def test_very_long_lines(spark):
    long = " ".join(f"word{i}" for i in range(6000))
    rows = [(1, long), (2, long.replace("word3000", "other").replace("word50 ", "x ")), (3, "a\n" + "b " * 9000)]
    got = {(r["doc_id"], r["line_no"]): r for r in lines.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2, 0]["first_doc"] == 1 and not got[2, 0]["kept"] and got[3, 0]["kept"] and got[3, 1]["kept"]


def test_lines_of_the_same_words_all_meet(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(3):  # three orders of the same words, each twice with two words swapped: one set, one fingerprint
        w = [f"word{j}" for j in rng.permutation(40).tolist()]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([w[1], w[0], *w[2:]]))]
    got = {r["doc_id"]: r["first_doc"] for r in lines.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


def test_the_edit_limit_is_a_share_of_any_length(spark):
    long = [f"{i:05d}" for i in range(1000)]  # 5,999 characters
    far = ["xxxxx" if i % 40 == 0 else w for i, w in enumerate(long)]
    short = "ab" * 50
    texts = [(1, " ".join(long)), (2, " ".join(far)), (3, short), (4, "z" * 15 + short[15:]), (5, "z" * 16 + short[16:])]
    pairs = spark.createDataFrame([(1, 2), (3, 4), (3, 5)], "a long, b long")
    got = lines._verified(pairs, lines._coded(spark.createDataFrame(texts, "id long, words string"))).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(1, 2), (3, 4)]


@here
@pytest.mark.parametrize("part", [2, 2048])
def test_near_copies(spark, monkeypatch, part):
    monkeypatch.setattr(neartext, "PART", part)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {r["doc_id"]: set(simhash.shingle_hashes(simhash.words_of(r["text"]), 5).tolist()) for r in docs.collect()}
    linked = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = roots(linked, sets)
    got = {r["doc_id"]: r["component_id"] for r in neartext.groups(docs).collect()}
    assert got == want
    kept = {r["doc_id"] for r in neartext.kept(docs).collect()}
    assert kept == {d for d in got if got[d] == d}


@pytest.mark.parametrize("part", [8, 2048])
def test_near_copies_of_a_dense_template(spark, monkeypatch, part):
    # Texts about 0.76 to 0.84 alike: estimates rank many partners below the bound above the few that hold.
    monkeypatch.setattr(neartext, "PART", part)
    rng = np.random.default_rng(11)
    rows = []
    for i in range(60):
        w = [f"t{j}" for j in range(300)]
        for at in rng.choice(60, 4, replace=False).tolist():
            w[5 * at] = f"n{i}x{at}"
        rows.append((i, " ".join(w)))
    sets = [set(simhash.shingle_hashes(simhash.words_of(t), 5).tolist()) for _, t in rows]
    linked = [(a, b) for b in range(60) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = roots(linked, range(60))
    assert 2 < len(set(want.values())) < 30
    got = {r["doc_id"]: r["component_id"] for r in neartext.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_a_crowd_below_the_bound_puts_out_no_pairs(spark, monkeypatch):
    made, written = {}, neartext.written

    def counted(df, name, **options):
        out = written(df, name, **options)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(neartext, "written", counted)
    rng = np.random.default_rng(12)
    rows = []
    for i in range(60):  # about 0.71 alike, so that estimates pass and sets do not
        w = [f"t{j}" for j in range(300)]
        for at in rng.choice(60, 5, replace=False).tolist():
            w[5 * at] = f"n{i}x{at}"
        rows.append((i, " ".join(w)))
    rows.append((60, rows[7][1] + " more"))
    got = {r["doc_id"]: r["component_id"] for r in neartext.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(60)} | {60: 7}
    assert sum(n for name, n in made.items() if name not in ("prints", "contents")) <= len(rows)


def test_near_copies_of_odd_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "A  b c"), (3, None), (4, ""), (None, "x y"), (None, "x y"), (5, "a b d"), (1, "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter((r["doc_id"], (r["text"] or "").lower()) for r in neartext.kept(docs).collect())
    assert kept[5, "a b d"] == 1 and (2, "a  b c") not in kept and kept[3, ""] == 1 and (4, "") not in kept
    # Unrelated texts of one id both stay; a row given twice stays once, with or without an id.
    assert kept[1, "a b c"] == 1 and kept[1, "zz"] == 1 and kept[None, "x y"] == 1 and sum(kept.values()) == 5


def test_a_repeated_row_changes_no_row_without_id(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "k l"), (None, "x y"), (None, "p q"), (None, "x y")]
    kept = neartext.kept(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == {(1, "a b c"): 1, (2, "k l"): 1, (None, "x y"): 1, (None, "p q"): 1}


def test_of_a_repeated_row_one_stays_whatever_its_other_columns(spark):
    rows = [(1, "a b c", k) for k in range(5)] + [(2, "a b c", 9), (3, "d", 1)]
    kept = neartext.kept(spark.createDataFrame(rows, "doc_id long, text string, k int")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, "a b c"), (3, "d")]


def losses(corpus, chosen, texts):
    """Brute-force losses ``(target, background)`` of texts; ``chosen`` says of each corpus text whether the target counts it."""
    models = []
    for only in (True, False):
        held = [lm.words_of(t) for t, c in zip(corpus, chosen, strict=True) if c or not only]
        pairs = Counter(p for w in held for p in zip([None, *w], w, strict=False))
        models.append((Counter(w for h in held for w in h), pairs, Counter(p for h in held if h for p in [None, *h[:-1]])))
    base = models[1][0]
    out = []
    for words in map(lm.words_of, texts):
        row = []
        for single, pairs, contexts in models:
            total, loss = sum(single.values()), 0.0
            for v, w in zip([None, *words], words, strict=False):
                own = (single[w] + lm.BASE * max(base[w], 1) / (sum(base.values()) + 1)) / (total + lm.BASE)
                loss -= np.log((pairs[v, w] + lm.PRIOR * own) / (contexts[v] + lm.PRIOR))
            row.append(loss / len(words) if words else None)
        out.append(tuple(row))
    return out


@pytest.mark.parametrize("chunk,ranges", [(lm.CHUNK, lm.RANGES), (97, 5), (300, 60)])
def test_language_models_equal_brute_force(spark, monkeypatch, chunk, ranges):
    monkeypatch.setattr(lm, "CHUNK", chunk)
    monkeypatch.setattr(lm, "RANGES", ranges)
    monkeypatch.setattr(lm, "RANGE_BYTES", 1 << 40)
    rng = np.random.default_rng(0)
    common = [f"w{i}" for i in range(200)] + ["the"] * 120
    texts = [" ".join(rng.choice(common, rng.integers(1, 60))) + (" Special token HERE" * 3 if i % 2 else "") for i in range(120)]
    texts += ["the the the the the", "ONE", "", None, "the w1", "the w1", "é \u00a0x y", "long " * 3000]
    ids = [*range(len(texts) - 3), None, 5, 6]
    rows = spark.createDataFrame(list(zip(ids, texts, range(len(ids)), strict=True)), "doc_id long, text string, `n_words.` int").repartition(6)
    picked = spark.createDataFrame([(i,) for i in range(1, 20, 2)] + [(None,), (1,)], "doc_id long")
    found = lm.scored(rows, picked, carry=["n_words.", "doc_id"]).select("`n_words.`", "__lm.*").collect()
    want = losses(texts, [i is not None and i % 2 and i < 20 for i in ids], texts)
    assert len(found) == len(texts)
    for r in found:
        target, base = want[r["n_words."]]
        assert r["n_words"] == len(lm.words_of(texts[r["n_words."]]))
        if target is None:
            assert (r["loss_target"], r["loss_background"], r["score"]) == (None, None, None)
        else:
            assert np.allclose([r["loss_target"], r["loss_background"], r["score"]], [target, base, target - base], rtol=1e-5, atol=1e-5)


def test_language_models_of_another_corpus_and_of_none(spark):
    corpus = ["a b a b c", "b c d", "a b"]
    counted = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string")
    asked = spark.createDataFrame([(0, "a b z", "x"), (7, "z z", "y"), (None, None, None)], "doc_id long, text string, __lm string").drop("__lm")
    picked = counted.where("doc_id = 1").select("doc_id")
    found = lm.scored(asked, picked, corpus=counted).select("doc_id", "__lm.*").orderBy("doc_id").collect()
    assert [r["n_words"] for r in found] == [0, 3, 2] and found[0]["score"] is None
    for r, (target, base) in zip(found[1:], losses(corpus, [False, True, False], ["a b z", "z z"]), strict=True):
        assert np.allclose([r["loss_target"], r["loss_background"]], [target, base], rtol=1e-5)
    assert lm.scored(asked.limit(0), picked).count() == 0
    assert lm.scored(asked, picked, corpus=counted.limit(0)).count() == 3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = classifier.trained(docs, labels, sample=2500)
    used = labels.orderBy(F.xxhash64(F.lit(classifier.SEED), "doc_id"), "doc_id").limit(2500)
    held = labels.join(used, "doc_id", "left_anti")
    rows = classifier.judged(docs, model, F.col("source"), F.col("lang"), carry=["doc_id"]).join(held, "doc_id").toPandas()
    good = rows[(rows.quality == 1) & (rows.toxic == 0)]
    assert good.kept.mean() > 0.97 and rows[rows.toxic == 1].kept.mean() < 0.15 and rows[rows.quality == 0].kept.mean() < 0.1


def test_the_sample_is_of_the_least_hashes(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    small, order = classifier.trained(docs, labels, sample=50), F.xxhash64(F.lit(classifier.SEED), "doc_id")
    same = classifier.trained(docs, labels.orderBy(order, "doc_id").limit(50), sample=50)
    assert (small.share == same.share).all() and (small.weights == same.weights).all()


def test_sparse_sites_shrink_towards_their_host(spark):
    rows = [(i, "bad text" if i < 60 else "good text", "h1" if i < 60 else "h2", "p") for i in range(120)] + [(200, "unknown", "h1", "q"), (201, "unknown", "h2", "q"), (202, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(i, int(i >= 60), 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in classifier.judged(docs, classifier.trained(docs, labels), F.col("host"), F.col("path")).collect()}
    assert out[200]["p_quality"] < out[201]["p_quality"] and 0 <= out[202]["p_quality"] <= 1


def test_quotes(spark):
    rows = [
        (1, 0, "a", "Hello there.\nHow are you?"), (1, 1, "b", "> Hello there.\n> How are you?\nI am fine.\n\nThanks"),
        (1, 2, "a", "> > hello THERE\n>> How are you\n> I am fine.\n>\n> Thanks\nGood."), (1, 3, "b", ">Good.\nYes"), (1, 4, "c", "plain"),
        (2, 0, "a", None), (None, 0, "a", "x"), (None, 1, "b", "> x\ny"), (1, None, "z", "> plain\nw"), (3, 0, "a", "> later\nq"), (3, 1, "a", "later"),
    ]
    out = {(r["conv_id"], r["turn"]): r for r in threads.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [out[1, t]["reply_to"] for t in range(5)] == [None, 0, 1, 2, None]
    assert [out[1, t]["reply_depth"] for t in range(5)] == [0, 1, 2, 3, 0] and {out[1, t]["reply_root"] for t in range(4)} == {0}
    assert out[1, 1]["text"] == "I am fine.\n\nThanks" and out[1, 2]["text"] == "Good." and out[2, 0]["text"] is None
    assert out[1, 2]["n_quotes"] == 2 and out[1, 2]["n_linked"] == 2
    assert out[None, 1]["reply_to"] == 0 and out[1, None]["reply_to"] is None and out[3, 0]["reply_to"] is None


def test_trimmed_and_interleaved_quotes(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for c in range(30):
        own = []
        for t in range(6):
            lines_ = [f"turn {t} of {c} says {' '.join(map(str, rng.integers(0, 99, 4)))}" for _ in range(4)]
            text = list(lines_)
            if t:
                at = int(rng.integers(0, t))
                want[c, t] = at
                some = [own[at][i] for i in sorted(rng.choice(4, int(rng.integers(1, 4)), replace=False).tolist())]
                text = [x for q, a in zip(some, lines_, strict=False) for x in ("> " + q, a)] + lines_[len(some) :]
            own.append(lines_)
            rows.append((c, t, "a", "\n".join(text)))
    out = threads.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r["conv_id"], r["turn"]): r["reply_to"] for r in out if r["turn"]} == want
    # Two lines of one turn weigh more than one of a later one; a short line links by no part of it.
    rows = [(1, 0, "a", "one two three\nfour five six\nyes"), (1, 1, "b", "seven eight nine\nyes"), (1, 2, "c", "> one two three\nx\n> four five six\ny\n> seven eight nine"), (1, 3, "d", "> yes")]
    out = {r["turn"]: r for r in threads.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert out[2]["reply_to"] == 0 and out[2]["n_linked"] == 3 and out[2]["n_quotes"] == 3 and out[3]["reply_to"] is None


def test_a_document_does_not_count_as_its_own_site(spark):
    docs = spark.createDataFrame([(i, f"w{i % 3}", "h", "p") for i in range(9)] + [(50, "w0", "alone", "p")], "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(9)], "doc_id long, quality int, toxic int")
    model = classifier.trained(docs, labels)
    out = {r["doc_id"]: r for r in classifier.judged(docs, model, F.col("host"), F.col("path")).collect()}
    # Brute force: soft counts, moments, then each level without the document itself.
    odds = {r["doc_id"]: model.evidence([classifier.features(r["text"])])[0][0] for r in docs.collect()}
    logit, prob = lambda q: float(np.log(q / (1 - q))), lambda o: float(1 / (1 + np.exp(-o)))
    base = float(model.share[0])
    soft = {d: prob(o + logit(base)) for d, o in odds.items()}
    site = {d: "h" if d < 9 else "alone" for d in odds}
    n, k = Counter(site.values()), Counter()
    for d, v in soft.items():
        k[site[d]] += v
    mean = sum(k.values()) / sum(n.values())

    def strength(means):
        spread = sum(n[g] * ((k[g] / n[g] - means[g]) ** 2 - means[g] * (1 - means[g]) / n[g]) for g in n) / sum(n.values())
        whole = sum(n[g] * means[g] * (1 - means[g]) for g in n) / sum(n.values())
        return min(classifier.STRONGEST, max(classifier.WEAKEST, whole / spread - 1)) if spread > 0 else classifier.STRONGEST

    a = strength(dict.fromkeys(n, mean))
    b = strength({g: (k[g] + a * mean) / (n[g] + a) for g in n})
    for d, o in odds.items():
        g = site[d]
        host = (k[g] - soft[d] + a * mean) / (n[g] - 1 + a)
        assert np.isclose(out[d]["p_quality"], prob(o + logit((k[g] - soft[d] + b * host) / (n[g] - 1 + b)))), d


def test_long_reply_chains(spark):
    rows = [(1, i, "a", f"> body {i - 1}\nbody {i}" if i else "body 0") for i in range(70)]
    out = threads.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(r["reply_depth"] == r["turn"] and r["reply_root"] == 0 for r in out)


@here
def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{k}")
        last, docs = docs, spark.read.parquet(f"file://{tmp_path}/{k}")
        assert 0 < docs.count()
    assert docs.count() == last.count()
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))
