"""Each operator against a brute-force version, over small texts that hold every awkward case."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, licenses, mixing, quality, queries, simhash, tokens

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 700}" for i in range(30_000))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("a", "É", "o,", "ß", "#x")]
    text = lambda n: " ".join(rng.choice(words, n))
    base = [text(int(n)) for n in rng.integers(1, 120, 60)]
    item = " ".join(f"item{i}" for i in range(12))
    texts = [
        *base, base[5], base[5], base[7] + " x", None, "", " \t\n", "one", LONG, LONG + " end",
        "a b c d e f g h\na b c d e f g h\nz", "\n".join(["same line here"] * 9), f"Before {item.upper()} after", f"{item}. short ITEM, 2 {text(9)}",
        "Released under the MIT License. CC BY-NC 4.0", "mit license mit license gnu gnu general public license by cc by", "a\x1cb  c d <|endoftext|> e",
    ]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", "é", None][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], (None, "no id", "en", "s1", 5)]
    top = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{top}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "short item 2"), (2, "short item 2"), (3, None), (4, "---"), (10, item + " more")], "item_id long, text string").write.parquet(f"file://{top}/benchmark.parquet")
    labels = [(i, int(i % 5 > 0), int(i % 7 == 0)) for i in range(0, 60, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{top}/labels.parquet")
    return f"file://{top}", rows


def result(spark, folder, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, folder[0]).collect()]


def test_simhash(spark, folder):
    def fingerprint(text):
        words = SPACE.findall(lower(text))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rows = folder[1]
    prints = [fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    least = {}
    for g, r in zip(group, rows):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = Counter((r[0], f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, group))
    got = result(spark, folder, "op2_simhash")
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want


def test_anchors_cover():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 64, 500, dtype=np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    home, reach = [set() for _ in x], [set() for _ in x]
    for out, fps, kinds in ((home, x, (False,)), (reach, y, (False, True))):
        for kind in kinds:
            for a, i in zip(*simhash.anchors(fps, kind)):
                out[i].add(int(a))
    assert all(a & b for a, b in zip(home, reach)) and all(len(a) == 3 for a in home)


@pytest.mark.parametrize("homes", [2, 4096])
def test_crowded_anchors_and_dense_groups(spark, monkeypatch, homes):
    monkeypatch.setattr(simhash, "HOMES", homes)
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 64, 3, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for c in centre] + [rng.integers(0, 1 << 64, 50, dtype=np.uint64)]))
    rows = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    from lodestone.llm.shared import connected

    roots = {r["node"]: r["root"] for r in connected(simhash.links(rows)).collect()}
    label = {int(v): i for i, v in enumerate(fps.view(np.int64))}
    for _ in range(4):
        for v in label:
            near = [w for w in label if ((v ^ w) & (2**64 - 1)).bit_count() <= 4]
            low = min(label[w] for w in near)
            for w in near:
                label[w] = low
    byroot, bylabel = {}, {}
    for v in label:
        byroot.setdefault(roots.get(v, v), set()).add(v)
        bylabel.setdefault(label[v], set()).add(v)
    assert sorted(map(sorted, byroot.values())) == sorted(map(sorted, bylabel.values()))


def test_tokens(spark, folder):
    encoder = tokens.Encoder()
    order = sorted(folder[1], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for r in order:
        ids = [*encoder.tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in result(spark, folder, "op4_tokens")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_small_shards_hold_the_same(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    table = tokens.shards(docs, shard_tokens=50)
    assert table.count() > 10
    rows = lambda t: sorted(map(str, tokens.documents(t).collect()))
    assert rows(table) == rows(tokens.shards(docs))


def test_decontamination(spark, folder):
    items = [("1", " ".join(f"item{i}" for i in range(12))), ("2", "short item 2"), ("10", " ".join(f"item{i}" for i in range(12)) + " more")]
    windows = {}
    for key, text in items:
        w = ALNUM.findall(lower(text))
        for i in range(max(1, len(w) - 7)):
            windows.setdefault(tuple(w[i : i + 8]), set()).add(key)
    want = []
    for doc_id, text, *_ in folder[1]:
        w = ALNUM.findall(lower(text))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    found |= windows[tuple(w[i : i + n])]
                    hit.update(range(i, i + n))
        want.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    got = [tuple(r.values()) for r in result(spark, folder, "op5_decontamination")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(r[5] for r in want)


def test_parts_of_a_large_benchmark_and_offsets(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{folder[0]}/benchmark.parquet")
    one = decontaminate.scanned(docs, bench).select("doc_id", "__scan.*").collect()
    monkeypatch.setattr(decontaminate, "MAX_WINDOWS", 10)
    parts = decontaminate.scanned(docs, bench).select("doc_id", "__scan.n_words", "__scan.n_hit", "__scan.items", "__scan.spans").collect()
    key = lambda r: (str(r["doc_id"]), r["n_words"], r["items"], r["n_hit"])
    assert sorted(map(key, one)) == sorted(map(key, parts))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    cut = [text[r["doc_id"]][s["start"] : s["stop"]] for r in one for s in r["spans"]]
    assert "ITEM0 ITEM1 ITEM2 ITEM3 ITEM4 ITEM5 ITEM6 ITEM7 ITEM8 ITEM9 ITEM10 ITEM11" in cut and any(c.endswith("short ITEM, 2") for c in cut)


def test_licenses(spark, folder):
    want = []
    for doc_id, text, *_ in folder[1]:
        w = ALNUM.findall(lower(text))
        base = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in base]
        want.append((doc_id, len(w), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base}))))
    rows = result(spark, folder, "op8_licenses")
    got = [tuple(r[k] for k in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in rows)


def test_matching_statistics():
    made = licenses.Automaton()
    sequences = [[0, 1, 2, 1, 0], [2, 2, 1, 0, 3]]
    for i, s in enumerate(sequences):
        made.add(i, s)
    made.finish()
    rng = np.random.default_rng(0)
    text = rng.integers(0, 4, 300).tolist()
    runs = {tuple(s[i:j]) for s in sequences for i in range(5) for j in range(i + 1, 6)}
    for i, (_, n) in enumerate(made.statistics(text)):
        assert n == max((k for k in range(1, 6) if k <= i + 1 and tuple(text[i + 1 - k : i + 1]) in runs), default=0)


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under CC BY 4.0", {"cc-by"}),
        ("Licensed under the GNU Lesser General Public License, version 3", {"lgpl"}),
        ("Released under the BSD License.", {"bsd"}),
        ("Licensed under the Apache Software License", {"apache-software"}),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", {"cc-by-nc", "cc-by-nc-notice"}),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", {"cc-by-notice"}),
        (licenses.TEMPLATES["gpl-notice"].replace("GNU  General", "GNU Lesser General"), {"lgpl", "lgpl-notice"}),
        (licenses.TEMPLATES["lgpl-notice"].replace("Lesser ", ""), {"gpl", "gpl-notice"}),
        ("CC BY-NC-SA 4.0", {"cc-by", "cc-by-nc-sa"}),
        ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0", {"cc-by-nc-sa"}),
        ("Creative Commons Attribution Non-Commercial No Derivatives", {"cc-by-nc-nd"}),
        ("https://creativecommons.org/licenses/by-sa/4.0/", {"cc-by-sa"}),
        ("BSD 2-Clause License", {"bsd-2-clause"}),
        ("GNU GPL v2", {"gpl"}),
        ("SPDX-License-Identifier: MIT", {"mit"}),
        ("SPDX-License-Identifier: Apache-2.0", {"apache"}),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", {"mit", "apache"}),
        ("SPDX-License-Identifier: LGPL-2.1-or-later", {"lgpl"}),
        ("CC0 1.0 Universal", {"cc0"}),
        ("released under the Unlicense", {"unlicense"}),
        ("MIT License. BSD License.", {"mit", "bsd"}),
        ("MIT students got a license to fly an Apache 2 miles", set()),
        ("gnu bsd isc mpl zlib by mit", set()),
        *[(text, {label}) for label, some in licenses.CLAUSES.items() for text in some if label not in ("gpl-clause", "unlicense-clause")],
        (licenses.CLAUSES["gpl-clause"][1], {"gpl", "gpl-clause"}),
        (" ".join(licenses.CLAUSES["unlicense-clause"]), {"unlicense-clause"}),
        (licenses.TEMPLATES["bsd-text"], {"bsd-text"}),
        (licenses.TEMPLATES["bsd-3-text"], {"bsd-3-text"}),
        (licenses.TEMPLATES["mit-text"], {"mit-text"}),
        ("Permission to use the software is granted by the license of the house", set()),
        ("", set()),
    ],
)
def test_licence_labels(text, labels):
    scanner = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES, licenses.NAMES, clauses=licenses.CLAUSES)
    assert set(scanner.scan(text)["labels"]) == labels


def test_licence_labels_of_generated_texts():
    # Names, texts and clauses with some words changed, in filler that holds their words, too: precision and recall of the labels.
    scanner = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES, licenses.NAMES, clauses=licenses.CLAUSES)
    rng = np.random.default_rng(4)
    known = sorted({w.decode() for t in licenses.TEMPLATES.values() for w in licenses.words_of(t)})
    filler = lambda n: [known[i] if i < len(known) and rng.random() < 0.5 else f"x{i}" for i in rng.integers(0, len(known), n)]
    kinds = [(text, label) for label, text in licenses.TEMPLATES.items()] + [(text, label) for label, some in licenses.CLAUSES.items() for text in some]
    kinds += [(text, label) for text, label in licenses.NAMES.items()]
    hit = wanted = made = 0
    for number in range(1200):
        text, label = kinds[int(rng.integers(0, len(kinds)))] if number % 3 else kinds[number // 3 % 32]
        words = text.split()
        if len(words) > 30:
            for i in rng.choice(len(words), len(words) // 20, replace=False):
                if not scanner.telling & set(licenses.words_of(words[i])):
                    words[i] = "zzz"
        got = set(scanner.scan(" ".join([*filler(40), "zzx", *words, "zzy", *filler(40)]))["labels"])
        # What the unchanged text alone is labelled with is right as well (the GPL's notice names the GPL).
        right = set(scanner.scan(text)["labels"]) | {label}
        hit, wanted, made = hit + (label in got), wanted + 1, made + len(got - right)
    assert hit >= 0.97 * wanted and made <= 0.02 * wanted, (hit, wanted, made)
    assert sum(bool(scanner.scan(" ".join(filler(200)))["labels"]) for _ in range(200)) <= 2


def test_licence_coverage_against_longest_common_runs():
    # Single cuts of templates in words that no template has: the coverage is the longest common run (by dynamic programming) of the template.
    scanner = licenses.Scanner({}, licenses.TEMPLATES)
    rng = np.random.default_rng(2)
    for label in ("mit-text", "bsd-text", "isc-text", "apache-notice", "mpl-notice", "gpl-notice"):
        t = licenses.words_of(licenses.TEMPLATES[label])
        for _ in range(5):
            a = int(rng.integers(0, len(t) // 2))
            w = [b"zzx", *t[a : a + int(rng.integers(3, len(t) - a + 1))], b"zzy"]
            got = scanner.scan(b" ".join(w).decode())
            row, best = [0] * (len(t) + 1), 0
            for x in w:
                row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(t)]
                best = max(best, *row)
            best /= len(t)
            assert got["score"] >= best - 1e-9 and (label in got["labels"]) == ((len(w) - 2) / len(t) >= licenses.MIN_COVERAGE)


def test_template_spans():
    scanner = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES)
    body = licenses.TEMPLATES["mit-text"].replace("sublicense", "resell").replace("without restriction", "without any restriction")
    span = next(s for s in scanner.scan("x y " + body + " z")["spans"] if s["label"] == "mit-text")
    assert span["start"] == 2 and span["coverage"] > 0.9


def test_quality_counts(spark, folder):
    want = []
    for doc_id, text, *_ in folder[1]:
        w = SPACE.findall(text or "")
        seen, hit = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
        for i in range(len(w) - 7):
            if seen[tuple(w[i : i + 8])] > 1:
                hit.update(range(i, i + 8))
        lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        want.append((doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed))
    rows = result(spark, folder, "op10_quality_rules")
    got = [tuple(r.values())[:-1] for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_sketch_quantiles_and_merging(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate((rng.lognormal(0, 2, 4000), np.zeros(900)))
    rows = spark.createDataFrame([("ab"[i % 2], float(v)) for i, v in enumerate(values)], "g string, x double")
    fine = quality.sketches(rows, ["g"], ["x"])
    row = quality.quartiles(quality.merged(fine, []), []).first()
    for q, name in ((0.25, "q25"), (0.75, "q75")):
        exact = np.sort(values)[int(np.ceil(q * len(values))) - 1]
        assert abs(row[name] - exact) <= 1.01 * quality.RELATIVE_ERROR * exact


def test_mixing(spark, folder):
    rows = result(spark, folder, "op9_mixing")
    sizes = Counter()
    for r in folder[1]:
        sizes[r[3]] += len(SPACE.findall(r[1] or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = dict(zip(order, [5, 2, 1] * 2))
    target, left, pool = {}, 1.5 * sum(sizes.values()), list(order)
    while True:
        share = {s: left * weight[s] / sum(weight[p] for p in pool) for s in pool}
        over = [s for s in pool if share[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            pool.remove(s)
    target |= share
    taken = Counter()
    source = {r[0]: r[3] for r in folder[1]}
    for r in rows:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    again = result(spark, folder, "op9_mixing")
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mixed_texts_hold_the_words_taken(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    count = lambda t: sum(len(SPACE.findall(r["text"] or "")) for r in t.collect())
    out = mixing.taken(docs, block=7)
    assert out.columns == docs.columns
    assert count(out) == sum(r["__taken"] for r in mixing.mixed(docs, block=7).collect())


@pytest.mark.parametrize("seed", range(4))
def test_highest_quotients(spark, seed):
    rng = np.random.default_rng(seed)
    weights, seats = rng.integers(0, 60, 9).tolist(), int(rng.integers(0, 40))
    if not sum(weights):
        weights[0] = 1
    rows = spark.createDataFrame([(0, f"{i}", float(w), seats) for i, w in enumerate(weights)], "by int, key string, w double, seats long")
    got = {r["key"]: r["won"] for r in mixing.apportioned(rows, ["by"], "key", "w", "seats").collect()}
    quotients = sorted((-(w / (2 * k + 1)), f"{i}") for i, w in enumerate(weights) if w for k in range(seats))[:seats]
    assert sum(got.values()) == seats
    limit = -quotients[-1][0] if quotients else 0
    want = Counter(i for _, i in quotients)
    assert all(got[k] == want.get(k, 0) or any(abs(weights[int(k)] / (2 * j + 1) - limit) < 1e-9 for j in range(seats)) for k in got)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, folder, tmp_path, name):
    for table in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder[0]}/{table}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{table}.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    assert queries.QUERIES[name](spark, f"file://{tmp_path}").collect() == []


def test_clashing_columns_pass(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    extra = docs.select("*", F.lit("x").alias("size"), F.lit(1).alias("n_words"), F.lit(2).alias("fp"), F.lit(3).alias("content"), F.lit(4).alias("ratio"), F.lit(5).alias("kept"))
    from lodestone.llm import lines, neartext

    for out in (quality.kept(extra), mixing.taken(extra), neartext.kept(extra), lines.cleaned(extra), decontaminate.scanned(extra, docs.select(F.col("doc_id").alias("item_id"), "text").limit(2)), licenses.scanned(extra)):
        assert [c for c in out.columns if not c.startswith("__")] == extra.columns
        out.collect()
