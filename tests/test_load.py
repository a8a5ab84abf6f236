import bz2
import time

import pytest
from pyspark.sql import functions as F

from lodestone import storage
from lodestone.functions import urls, wikitext
from lodestone.operators import authority, explore, load
from lodestone.sources import dump

PAGE = "<page><title>{t}</title><ns>{ns}</ns><id>{i}</id>{r}<revision><text>{x}</text></revision></page>"
PAGES = [
    PAGE.format(t="Alpha", ns=0, i=1, r="", x="'''Alpha''' is [[Beta|the second]].&lt;ref&gt;x&lt;/ref&gt; See [http://www.example.co.uk/a page].\n== More ==\n[[:Category:Things]] [[Nowhere]]"),
    PAGE.format(t="Beta", ns=0, i=2, r="", x="{{Infobox|a={{b}}}}[[File:x.png|thumb|cap [[Alpha]]]]Beta text.\n==L==\n[[Category:Things]] https://blog.example.org/p."),
    PAGE.format(t="Gamma", ns=0, i=3, r='<redirect title="Alpha" />', x="#REDIRECT [[Alpha]]"),
    PAGE.format(t="Category:Things", ns=14, i=4, r="", x="{{Commons category|Stuff}} [[Alpha]]"),
    PAGE.format(t="User:Me", ns=2, i=5, r="", x="[[Alpha]]"),
    PAGE.format(t="Delta", ns=0, i=6, r="", x="{{Infobox}}Beta text."),
]


def parsed(spark, tmp_path):
    path = tmp_path / "dump.xml.bz2"
    path.write_bytes(b"".join(bz2.compress(x.encode()) for x in ["<mediawiki>", *PAGES, "</mediawiki>"]))
    return dump.pages(spark, f"file://{path}")


def test_dump_to_tables(spark, tmp_path):
    made = load.tables(parsed(spark, tmp_path))
    pages = {r["id"]: r for r in made["internal_pages"].collect()}
    assert set(pages) == {1, 2, 3, 4, 6} and pages[3]["text_id"] is None and pages[6]["text_id"] == 2
    assert sorted(r["text"] for r in made["internal_texts"].collect()) == ["Alpha is the second. See page.", "Beta text."]
    assert sorted(map(tuple, made["internal_links"].collect())) == [(1, 2), (2, 1), (2, 4), (4, 1)]
    assert [tuple(r) for r in made["redirects"].collect()] == [(3, 1)]
    assert sorted((r["name"], r["tld"]) for r in made["external_domains"].collect()) == [("example.co.uk", "co.uk"), ("example.org", "org")]
    assert made["external_links"].count() == 2
    filled = load.tables(parsed(spark, tmp_path), resolve_redirects=True)["internal_pages"]
    assert filled.where("id = 3").first()["text_id"] == 1
    assert load.tables(parsed(spark, tmp_path), dedup=False)["internal_texts"].count() == 3


def test_wikitext():
    assert wikitext.lead("<!-- no -->A <nowiki>[[b]] 7</nowiki> {| t\n|x\n|} [[c]]s '''d'''") == "A [[b]] 7  cs d"
    assert wikitext.links("[[a|b]] [[a]] {{Commonscat}} {{commons-cat|X}} [[open", 0, "T") == ["a", "Category:T", "Category:X"]
    assert wikitext.links("{{Commonscat}}", 14, "T") == [] and wikitext.links(None, 0, "T") == []
    assert wikitext.external_links("[//a.b/c d] (http://x.y/z).") == ["//a.b/c", "http://x.y/z"]


@pytest.mark.parametrize("text", ["{{" * 250_000 + "x" + "]]" * 250_000, "[[a|" * 200_000 + "b" + "]]" * 200_000, "[[" * 250_000 + "}}" * 250_000, "{{a|[[b" * 120_000, "[[a" * 150_000 + "]]" * 150_000])
def test_nested_text_takes_time_by_its_length(text):
    began = time.time()
    wikitext.read(text, 0, "T")
    assert time.time() - began < 20


def test_reading_text():
    assert wikitext.lead("[[a|b [[c|d]] e]] {{x|[[y]]}} {| t || {{u}} |} [[:File:z]] [[File:q|thumb|no]] {{open [[c]]") == "b d e   File:z  {{open c"
    assert wikitext.lead("a | b |} c }} ]] [[x") == "a | b |} c }} ]] [[x"
    assert wikitext.external_links("http://a.b/C_(d), (http://a.b/e) http://a.b/f).") == ["http://a.b/C_(d)", "http://a.b/e", "http://a.b/f"]
    assert wikitext.read("x [[a]]\n== H ==\n[[b]] http://u.v/", 0, "T") == ("x a", ["a", "b"], ["http://u.v/"])


def test_namespaces(spark):
    rows = spark.createDataFrame([(x,) for x in ("Category:A:b", ":Category:A", "category:A", "User talk:x", "plain", "No:such")], "l string")
    got = [tuple(r["x"]) for r in rows.select(wikitext.namespace_title(F.col("l")).alias("x")).collect()]
    assert got == [(14, "Category:A:b"), (0, "Category:A"), (0, "category:A"), (3, "User talk:x"), (0, "plain"), (0, "No:such")]


def test_domains(spark):
    rows = spark.createDataFrame([("http://a.b.example.co.uk/x",), ("https://Example.COM:8080",), ("http://127.0.0.1/",), ("http://localhost/x",), ("not a url",), ("//x.org/y",)], "url string")
    got = [(r["name"], r["tld"]) for r in urls.with_domain(rows).collect()]
    assert got == [("example.co.uk", "co.uk"), ("example.com", "com"), ("127.0.0.1.", ""), ("localhost.", ""), (None, None), ("x.org", "org")]


RULES = ["com", "jp", "ac.jp", "kyoto.jp", "ide.kyoto.jp", "*.kobe.jp", "!city.kobe.jp", "*.ck", "!www.ck", "us", "ak.us", "k12.ak.us"]
#: Hosts and their registered domains by the published test of the algorithm (none: the host is a suffix).
REGISTERED = {
    "com": None, "example.com": "example.com", "b.example.com": "example.com", "a.b.example.com": "example.com", "jp": None, "test.jp": "test.jp", "www.test.jp": "test.jp",
    "ac.jp": None, "test.ac.jp": "test.ac.jp", "www.test.ac.jp": "test.ac.jp", "kyoto.jp": None, "test.kyoto.jp": "test.kyoto.jp", "ide.kyoto.jp": None, "b.ide.kyoto.jp": "b.ide.kyoto.jp",
    "a.b.ide.kyoto.jp": "b.ide.kyoto.jp", "c.kobe.jp": None, "b.c.kobe.jp": "b.c.kobe.jp", "a.b.c.kobe.jp": "b.c.kobe.jp", "city.kobe.jp": "city.kobe.jp", "www.city.kobe.jp": "city.kobe.jp",
    "test.ck": None, "b.test.ck": "b.test.ck", "a.b.test.ck": "b.test.ck", "www.ck": "www.ck", "www.www.ck": "www.ck", "us": None, "test.us": "test.us", "ak.us": None, "test.ak.us": "test.ak.us",
    "k12.ak.us": None, "test.k12.ak.us": "test.k12.ak.us", "www.test.k12.ak.us": "test.k12.ak.us",
}


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_public_suffix_rules(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(urls, "BROADCAST_RULES", broadcast)
    (tmp_path / "list.dat").write_text("// a comment\n\n" + "\n".join(f"{r} // why" for r in RULES))
    rules = urls.read_rules(spark, f"file://{tmp_path}/list.dat")
    hosts = spark.createDataFrame([(h,) for h in REGISTERED] + [("127.0.0.1",), ("localhost",), (None,)], "host string")
    got = {r["host"]: (r["name"], r["tld"]) for r in urls.split_hosts(hosts, rules).collect()}
    assert {h: None if n.startswith(".") else n for h, (n, t) in got.items() if t} == REGISTERED
    assert got["127.0.0.1"] == ("127.0.0.1.", "") and got["localhost"] == ("localhost.", "") and len(got) == len(REGISTERED) + 2
    rows = spark.createDataFrame([("http://a.b.test.ck/x",), ("nothing",)], "url string")
    assert [(r["name"], r["tld"]) for r in urls.with_rules(rows, rules).orderBy("url").collect()] == [("b.test.ck", "test.ck"), (None, None)]


def test_the_least_page_of_an_id_and_of_a_title(spark):
    rows = [(1, 0, "b", None, "x"), (1, 0, "a", None, "y"), (2, 0, "a", None, "z"), (3, 0, "c", "a", ""), (3, 0, "c", None, "w")]
    table = spark.createDataFrame(rows, "id long, ns int, title string, redirect string, text string")
    assert sorted(map(tuple, load.first_pages(table).collect())) == [(1, 0, "a", None, "y"), (3, 0, "c", None, "w")]


def test_tables_loaded_again(spark, tmp_path):
    made = load.tables(parsed(spark, tmp_path))
    stored = storage.Tables(spark, f"file://{tmp_path}/tables")
    rows = lambda: {n: sorted(map(str, stored.read(n).collect())) for n in stored.names()}
    assert stored.names() == []
    counts = stored.insert(made, load.KEYS)
    once = rows()
    assert counts["internal_pages"] == 5 and set(once) == set(made) and once["internal_links"]
    assert set(stored.insert(made, load.KEYS).values()) == {0} and rows() == once
    broken = made["internal_pages"].withColumn("title", F.expr("raise_error('no')"))
    with pytest.raises(Exception, match="no"):
        stored.insert({"internal_links": made["internal_links"], "internal_pages": broken}, load.KEYS)
    with pytest.raises(Exception, match="no"):
        stored.replace({"internal_texts": made["internal_texts"].limit(0), "internal_pages": broken})
    assert rows() == once
    more = spark.createDataFrame([(1, 0, "Other"), (9, 0, "Beta"), (7, 0, "New"), (8, 0, "New")], "id long, ns int, title string")
    more = more.selectExpr("id", "ns", "title", *[f"CAST(NULL AS {t}) AS {n}" for n, t in [(f.name, f.dataType.simpleString()) for f in made["internal_pages"].schema.fields[3:]]])
    assert stored.insert({"internal_pages": more}, load.KEYS)["internal_pages"] == 1
    assert {r["id"] for r in stored.read("internal_pages").collect()} == {1, 2, 3, 4, 6, 7}
    stored.clear("redirects")
    assert stored.read("redirects").count() == 0 and stored.read("internal_pages").count() == 6
    stored.clear()
    assert all(stored.read(n).count() == 0 for n in stored.names())
    stored.replace({"redirects": made["redirects"]})
    assert stored.read("redirects").count() == 1


def test_index_qrels_queries_and_ranks(spark, tmp_path):
    (tmp_path / "i.txt.bz2").write_bytes(bz2.compress(b"10:1:A:b\n10:2:C\n20:3:D\n"))
    rows = dump.index(spark, f"file://{tmp_path}/i.txt.bz2")
    assert sorted(map(tuple, rows.collect())) == [(10, 1, "A:b"), (10, 2, "C"), (20, 3, "D")]
    assert sorted((r["offset"], len(r["pages"])) for r in dump.blocks(rows).collect()) == [(10, 2), (20, 1)]
    (tmp_path / "q.txt").write_text("S-1\tx\t<dbpedia:A_b>\t2\nT-1 x <dbpedia:C> 1\n")
    assert [tuple(r) for r in dump.qrels(spark, f"file://{tmp_path}/q.txt", "S").collect()] == [("S-1", "A b", 2)]
    (tmp_path / "k.txt").write_text("S-1 two words\nT-1 x\n")
    assert [tuple(r) for r in dump.queries(spark, f"file://{tmp_path}/k.txt", "S").collect()] == [("S-1", "two words")]
    table = spark.createDataFrame([(1, 0.5, 0.25, None)], "id long, rank1 double, rank2 double, authority double")
    dump.write_ranks(table, f"file://{tmp_path}/ranks")
    assert [tuple(r) for r in dump.ranks(spark, f"file://{tmp_path}/ranks").collect()] == [(1, 0.5, 0.25, None)]


def test_authority_counts_links_not_pages_and_leaves_archives_out(spark):
    pages = spark.createDataFrame([(1, 0, "a", 1.0), (2, 0, "b", 3.0), (3, 14, "c", 9.0)], "id long, ns int, title string, rank1 double")
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 12), (3, 10)], "source_id long, target_id long")
    ext = spark.createDataFrame([(10, "u", 100), (11, "v", 100), (12, "w", 101)], "id long, url string, domain_id long")
    domains = spark.createDataFrame([(100, "x.com", "com"), (101, "archive.org", "org")], "id long, name string, tld string")
    by = authority.domain_authority(pages, links, ext, domains)
    assert [tuple(r) for r in by.collect()] == [(100, "x.com", "com", 2, 5.0 / 3, 5.0)]
    assert {r["page_id"]: tuple(r)[1:] for r in authority.page_authority(links, ext, by).collect()} == {1: (1, 10.0), 2: (1, 5.0), 3: (1, 5.0)}
    profile = authority.page_profile(pages, links, ext, domains)
    assert sorted(r["domain_citation_count"] for r in profile.collect()) == [1, 1, 1, 2, 2]
    assert authority.page_sources(profile, "a", 2).count() == 2


def test_degree_buckets(spark):
    degrees = [0, 1, 4, 5, 9, 10, 49, 50, 99, 100, 499, 500, None]
    pages = spark.createDataFrame([(i, 0, d, 0) for i, d in enumerate(degrees)], "id long, ns int, in_degree long, out_degree long")
    rows = explore.degree_distribution(pages).where("degree_type = 'in_degree'").collect()
    assert {r["bucket"]: r["pages"] for r in rows} == {"0": 1, "1-4": 2, "5-9": 2, "10-49": 2, "50-99": 2, "100-499": 2, "500+": 2}


def test_stream_keeps_the_latest_version(spark, tmp_path):
    from lodestone.operators.segments import SegmentedIndex
    from lodestone.streaming import updates

    schema = "doc_id long, body string, version long"
    for rows in [[(1, "old words", 1), (2, "stays", 1)], [(1, "new", 2), (3, "gone", 1)], [(3, None, 2)]]:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
        updates.follow(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()
    index = SegmentedIndex(spark, f"file://{tmp_path}/out").read()
    assert sorted((r["term"], r["doc_id"]) for r in index.postings.collect()) == [("new", 1), ("stays", 2)] and (index.n, index.total) == (2, 2)
