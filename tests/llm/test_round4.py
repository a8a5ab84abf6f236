"""ZIP-packaged archives, annulus search and the prefix trie against brute force and their SQL, over tables with every awkward case."""

import base64
import gzip
import hashlib
import io
import json
import math
import random
import zipfile
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import annulus, queries, tries, warczip

PAGES = "page_id long, url string, html string, key string"
VECTORS = "vec_id long, embedding array<float>, label int, v string"
TURNS = "conv_id long, turn long, role string, text string, conv string, depth int"


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def by_sql(folder, name, table):
    db = duckdb.connect()
    db.execute(f"create view {table} as select * from '{folder.removeprefix('file://')}/{table}.parquet/*.parquet'")
    got = db.execute(queries.ORACLE_SQL[name])
    return [d[0] for d in got.description], Counter(got.fetchall())


# Archives


def pages_rows():
    rows = [(i, f"http://a.example/{i}", f"<p>page {i % 7} é\r\n\r\n</p>", "x") for i in range(40)]
    rows += [(100, "http://b.example/", None, None), (101, "", "", None), (102, None, "\r\n\r\nWARC/1.1\r\n", None), (103, "http://c.example/ü b?q=%41#x", "z" * 300_000, None)]
    return [*rows, rows[3], rows[3], (None, "http://n.example/", "only here", None), (None, "http://n.example/2", "<p>page 1 é\r\n\r\n</p>", None), (5, "http://other.example/", "<p>page 5 é\r\n\r\n</p>", None)]


def brute_pages(rows):
    most, seen, out = {}, Counter(), []
    for i, _, html, _ in rows:
        p = (html or "").encode()
        most[p] = max([x for x in (most.get(p), i) if x is not None], default=None)
    for i, url, html, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True):
        p = (html or "").encode()
        kind = "revisit" if seen[p] else "response"
        seen[p] += 1
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), kind, most[p] if kind == "revisit" else None))
    return Counter(out)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(pages_rows(), PAGES).repartition(3).write.parquet(f"{top}/pages.parquet")
    spark.createDataFrame(vector_rows(), VECTORS).repartition(3).write.parquet(f"{top}/embeddings.parquet")
    spark.createDataFrame(turn_rows(), TURNS).repartition(3).write.parquet(f"{top}/conversations.parquet")
    return top


def test_warc(spark, tables):
    got = queries.op11_warc(spark, tables)
    assert rows_of(got) == brute_pages(pages_rows())
    columns, want = by_sql(tables, "op11_warc", "pages")
    assert columns == got.columns and want == rows_of(got)


def test_packages_are_plain_zips_and_return_whole_payloads(spark, tables):
    pages = spark.read.parquet(f"{tables}/pages.parquet")
    made = warczip.packages(pages, package_bytes=600)
    paths = [r["path"] for r in made.collect()]
    assert len(paths) > 3 and sum(r["n_records"] for r in made.collect()) == len(pages_rows())
    for path in paths:
        with zipfile.ZipFile(path.removeprefix("file://")) as z:
            assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
            assert gzip.decompress(z.read(warczip.ARCHIVE)).startswith(b"WARC/1.1\r\n")
            described = json.loads(z.read("datapackage.json"))["resources"]
            assert [hashlib.sha256(z.read(r["path"])).hexdigest() for r in described] == [r["hash"].removeprefix("sha256:") for r in described]
            lines = z.read(warczip.INDEX).decode().splitlines()
            assert lines == sorted(lines)
    read = warczip.records(warczip.ranges(made)).where("record_type = 'response'").collect()
    assert sorted(r["payload"].decode() for r in read) == sorted({r[2] or "" for r in pages_rows()})
    assert {r["target_uri"] for r in read} >= {"http://c.example/%C3%BC%20b?q=%41#x"}


def test_small_payloads_do_not_revisit(spark, tables):
    rows = warczip.records(warczip.ranges(warczip.packages(spark.read.parquet(f"{tables}/pages.parquet"), least_bytes=1000)), payloads=False)
    assert rows.count() == len(pages_rows()) and rows.where("record_type = 'revisit'").count() == 0


def test_no_pages(spark):
    assert warczip.records(warczip.ranges(warczip.packages(spark.createDataFrame([], PAGES)))).count() == 0


def opened(data):
    return warczip.directory(pa.BufferReader(data), len(data))


def test_directories_with_comments_and_zip64(monkeypatch):
    def made():
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.comment = b"PK\x05\x06 a comment that looks like an end" * 3
            for i in range(5):
                z.writestr(f"archive/ü{i}.warc", b"x" * (i + 400))
        return out.getvalue()

    plain = made()
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 300)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    wide = made()
    assert b"PK\x06\x06" in wide and b"PK\x06\x06" not in plain
    for data in (plain, wide):
        found = opened(data)
        assert {n: (data[a : a + k], m) for n, (a, k, m) in found.items()} == {f"archive/ü{i}.warc": (b"x" * (i + 400), 0) for i in range(5)}
    for broken in (b"", b"not a zip", plain[:-200], plain.replace(b"PK\x01\x02", b"PK\x01\x03")):
        with pytest.raises(ValueError):
            opened(broken)


def test_archives_without_an_index_are_walked_and_compressed_ones_refused(spark, tmp_path):
    record = lambda i: warczip._record("response", str(i), "http://x/", hashlib.sha1(b"p%d" % i).digest(), 2, None, b"p%d" % i)
    data = b"".join(gzip.compress(record(i)) for i in range(6))
    for name, how in (("a", zipfile.ZIP_STORED), ("b", zipfile.ZIP_DEFLATED)):
        with zipfile.ZipFile(tmp_path / f"{name}.wacz", "w", how) as z:
            z.writestr(warczip.ARCHIVE, data)
    at = lambda name: spark.createDataFrame([(f"file://{tmp_path}/{name}.wacz",)], "path string")
    assert sorted(bytes(r["payload"]) for r in warczip.records(warczip.ranges(at("a"))).collect()) == [b"p%d" % i for i in range(6)]
    with pytest.raises(Exception, match="compressed inside the package"):
        warczip.ranges(at("b")).collect()


def test_a_payload_that_is_not_its_digest_is_refused(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.wacz", "w") as z:
        z.writestr(warczip.ARCHIVE, gzip.compress(warczip._record("response", "1", "http://x/", hashlib.sha1(b"other").digest(), 1, None, b"p")))
    with pytest.raises(Exception, match="not the one that its digest names"):
        warczip.records(warczip.ranges(spark.createDataFrame([(f"file://{tmp_path}/a.wacz",)], "path string"))).collect()


# Clusters


def vector_rows():
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 64).astype("f4")], 1, "x") for i in range(120)]
    rows += [rows[4], rows[4], (None, rows[5][1], None, None), (200, None, 1, None), (201, [], 1, None), (202, [0.1] * 63, 1, None), (203, [0.1] * 63 + [None], 1, None)]
    return [*rows, (204, [float("nan")] * 64, 1, None), (205, [float("inf")] + [0.0] * 63, 1, None), (206, [0.0] * 64, 1, None), *[(300 + i, [0.25] * 64, 0, "same") for i in range(60)]]


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[j]) for x in zip(*members[j], strict=True)] if j in members else c for j, c in enumerate(centroids)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    return Counter((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in found)


def test_clusters(spark, tables):
    got = queries.op12_centroids(spark, tables)
    assert rows_of(got) == brute_clusters(vector_rows())
    columns, want = by_sql(tables, "op12_centroids", "embeddings")
    assert columns == got.columns and want == rows_of(got)


@pytest.mark.parametrize("k", [1, 2, 40])
def test_nearest_is_exact_with_ties(k):
    rng = np.random.default_rng(k)
    x = rng.integers(-4, 5, (500, 3))
    centroids = np.concatenate([rng.integers(-4, 5, (k, 3)), rng.integers(-4, 5, (k, 3)) * 0 + 1])
    label, best = annulus.nearest(x, centroids)
    every = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (label == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()


def test_few_or_no_vectors(spark):
    rows = spark.createDataFrame(vector_rows()[:3], VECTORS)
    got, centroids = annulus.clustered(rows)
    assert len(centroids) == 3 and {r["distance"] for r in got.collect()} == {0}
    empty, none = annulus.clustered(rows.limit(0))
    assert empty.count() == 0 and none.shape == (0, 64) and empty.columns == got.columns


def test_components_that_no_long_can_square(spark):
    rows = spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)], "vec_id long, embedding array<float>")
    got, _ = annulus.clustered(rows, k=1, rounds=0)
    assert sorted(r["distance"] for r in got.collect())[0] == 0 and all(0 <= r["distance"] <= 64 * (2 * annulus.LARGEST) ** 2 for r in got.collect())


# Trie


def turn_rows():
    rng = random.Random(6)
    rows = []
    for c in range(60):
        rows += [(c, t, rng.choice(["user", "bot"]), rng.choice(["hi", "hé", "yes", ""]), "x", 1) for t in range(rng.randint(0, 6))]
    rows += [(c, t, "user", f"same {t}", None, None) for c in range(100, 130) for t in range(3)]
    rows += [(70, None, None, "no turn", None, 0), (70, None, "a", None, None, 0), (70, 1, "user", "x", None, 0), (70, 1, "user", "x", None, 0), (70, 1, "bot", "y", None, 0)]
    rows += [(None, 1, "user", "nowhere", None, None), (-7, 1, "user", "below zero", None, None), (-5, 3, "user", "z" * 50_000, None, None)]
    return [*rows, *[(500, i, "user", f"turn {i}", None, None) for i in range(40)], *[(501, i, "user", f"turn {i}", None, None) for i in range(25)]]


def in_order(rows):
    turns = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            turns.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    return {c: [(role, text) for _, role, text in sorted(v)] for c, v in turns.items()}


def brute_trie(paths):
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), set()).add(c)
    leaves, saved, children = Counter(), Counter(), Counter(p[:-1] for p in members if p)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    sha = lambda p, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p)).encode()).hexdigest()
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(p, m)) for p, m in members.items())


def rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = [*turns.get(c - int(math.fmod(c, 5)), [])[:h], *own[h:]]
    return out


@pytest.mark.parametrize("block", [4096, 3])
def test_trie(spark, tables, monkeypatch, block):
    monkeypatch.setattr(tries, "BLOCK", block)
    monkeypatch.setattr(tries, "_PACKED", block)
    got = queries.op13_prefix_trie(spark, tables)
    assert rows_of(got) == brute_trie(rebuilt(in_order(turn_rows())))
    if block == 4096:
        columns, want = by_sql(tables, "op13_prefix_trie", "conversations")
        assert columns == got.columns and want == rows_of(got)


def test_trie_of_conversations_as_they_stand(spark, tables):
    rows = spark.read.parquet(f"{tables}/conversations.parquet")
    assert rows_of(tries.trie(rows)) == brute_trie(in_order(turn_rows()))
    assert tries.trie(rows.limit(0)).count() == 0


def test_heavy_parents_are_broadcast_and_others_joined(spark):
    from lodestone.llm.shared import looked_up

    rows = spark.createDataFrame([(i % 7 if i % 2 else 1, i) for i in range(200)], "k long, v long")
    table = rows.groupBy("k").count().where("k <> 3").selectExpr("k", "k * 10 AS got", "count AS n")
    for shares in (1, 3, 1000):
        met = looked_up(rows, table, ["k"], "n", 200, shares)
        assert Counter((r["v"], r["got"]) for r in met.collect()) == Counter((r["v"], None if r["k"] == 3 else r["k"] * 10) for r in rows.collect())


# Lines


def test_words_of_equal_codes_are_not_equal_words(spark):
    from lodestone.llm import lines

    head = "ab cd ef gh ij kl mn op qr st uv wx "
    docs = spark.createDataFrame([(1, head + "flyyibnmmzumdk"), (2, head + "tbwxoljbrpfijn"), (3, head + "tbwxoljbrpfijx")], "doc_id long, text string")
    kept = {r["doc_id"]: (r["first_doc"], r["kept"]) for r in lines.groups(docs).collect()}
    assert kept == {1: (1, True), 2: (2, True), 3: (2, False)}


def test_a_changed_word_is_found_wherever_it_is(spark):
    from lodestone.llm import lines

    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrst", k=6))
    rows = []
    for n in range(12, 80, 2):
        words = [word() for _ in range(n)]
        changed = list(words)
        changed[rng.randrange(n)] = word()
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(changed))]
    found = {r["doc_id"]: r["first_doc"] for r in lines.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {d: d - d % 2 for d, _ in rows}


def test_counts_never_part_lines_within_the_limit(spark):
    """The bits in which counts differ are at most twice the edits, also where counts pass sixteen."""
    from pyspark.sql import functions as F

    from lodestone.llm import lines

    rng = random.Random(3)
    rows = [("a" * rng.randint(1, 60) + "".join(rng.choices("ab e", k=40)), "a" * rng.randint(1, 60) + "".join(rng.choices("abe ", k=40))) for _ in range(300)]
    table = spark.createDataFrame(rows, "a string, b string")
    side = lambda c: table.select("a", "b", F.col(c).alias("words")).select("a", "b", *[x.alias(f"{c}{i}") for i, x in enumerate(lines._counts())])
    met = side("a").join(side("b"), ["a", "b"])
    differ = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(len(lines.COUNTED) // 8 + (len(lines.COUNTED) % 8 > 0))), F.lit(0))
    assert met.where(differ + F.abs(F.length("a") - F.length("b")) > 2 * F.levenshtein("a", "b")).count() == 0


def test_long_lines_are_decided_as_by_their_edits(spark):
    """Lines of 600 to 3,000 characters, also of one phrase again and again, with words put in, left out, moved and exchanged, near the limit and over it."""
    import numpy as np
    from pyspark.sql import functions as F

    from lodestone.llm import lines

    rng = np.random.default_rng(5)
    rows = []
    for number in range(60):
        vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(2, 10)))) for _ in range(8 if number % 3 == 0 else 200)]
        size = int(rng.integers(110, 400))
        a = [vocabulary[i % 8] for i in range(size)] if number % 3 == 0 else [vocabulary[i] for i in rng.integers(0, len(vocabulary), size)]
        b = list(a)
        if number % 3 == 0:
            b = [w if i % 8 != 3 else "xy" for i, w in enumerate(b)][number % 9 :]
        for _ in range(int(rng.integers(0, size // 4))):
            i, kind = int(rng.integers(0, len(b))), int(rng.integers(0, 3))
            b[i : i + (kind != 0)] = [] if kind == 1 else ["new"]
        if number % 5 == 0:
            b[40:40] = a[:20]
        rows.append((number, " ".join(a), " ".join(b)))
    texts = spark.createDataFrame([r for n, a, b in rows for r in ((2 * n, a), (2 * n + 1, b))], "id long, words string")
    coded = lines._coded(texts)
    pairs = lines._as(coded.where("id % 2 = 0"), "a").join(lines._as(coded.where("id % 2 = 1"), "b"), F.col("id_b") == F.col("id_a") + 1)
    most = lines._limit("n_a", "n_b")
    out = pairs.select(lines._near().alias("near"), F.expr(lines._enough(most)).alias("e"), F.expr(most).alias("most"), F.expr("levenshtein(words_a, words_b)").alias("d")).collect()
    assert len(out) == 60 and 10 < sum(r["near"] for r in out) < 55
    assert all(r["near"] == (r["d"] <= r["most"]) and r["e"] >= min(r["d"], r["most"] + 1) for r in out)
