from lodestone.api import Engine
from lodestone.operators import evaluate


def test_engine(spark, tmp_path):
    pages = [(1, 0, "Alpha", 1), (2, 0, "Beta", 2), (3, 14, "Category:C", None), (4, 0, "Gamma", None)]
    tables = {
        "internal_pages": spark.createDataFrame([(*p, None, None, None, None, None) for p in pages], "id long, ns int, title string, text_id long, in_degree long, out_degree long, rank1 double, rank2 double, authority double"),
        "internal_texts": spark.createDataFrame([(1, "h", "alpha " * 70), (2, "i", "beta")], "id long, hash string, text string"),
        "internal_links": spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "source_id long, target_id long"),
        "external_domains": spark.createDataFrame([(7, "x.com", "com")], "id long, name string, tld string"),
        "external_pages": spark.createDataFrame([(5, "http://x.com/", 7)], "id long, url string, domain_id long"),
        "external_links": spark.createDataFrame([(1, 5)], "source_id long, target_id long"),
        "redirects": spark.createDataFrame([(4, 1)], "source_id long, target_id long"),
    }
    engine = Engine(tables)
    found = engine.search("alpha").first()
    assert found["title"] == "Alpha" and found["snippet"].endswith(" ...") and len(found["snippet"].split()) == 65
    assert engine.path("Alpha", "Beta").first()["hops"] == 1
    assert {r["bucket"]: r["pages"] for r in engine.degrees().where("degree_type = 'in_degree'").collect()} == {"0": 1, "1-4": 2}
    assert engine.redirects().first()["content"] == 2
    assert [r["title"] for r in engine.pagerank(limit=1).collect()] == ["Alpha"]
    assert engine.sources().count() == 0 and engine.sources(1).first()["name"] == "x.com"
    assert engine.page_sources("Alpha").first()["url"] == "http://x.com/"
    assert engine.tlds(1).first()["tld"] == "com"
    assert engine.pages.where("authority is not null").count() == 1
    assert evaluate.has_title(engine.pages, "<dbpedia:Alpha>") and not evaluate.has_title(engine.pages, "<dbpedia:Category:C>")
    evaluate.save_report(engine.search("alpha"), engine.redirects(), f"file://{tmp_path}")
    assert spark.read.json(f"file://{tmp_path}/results").count() == 1
