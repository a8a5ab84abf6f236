"""The link model over the star-schema tables: one mapping, in Spark SQL and, for the oracle, in DuckDB's dialect."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "pages", "lineitem", "orders", "customer")
SUFFIXES = ("example.com", "example.net", "example.org")

#: The model's tables in order; ``{div}`` is the dialect's integer division, ``{line}`` its first line of a text.
MODEL = {
    "texts_by_hash": "SELECT md5(text) AS hash, min(text) AS text, min(doc_id) AS id FROM documents GROUP BY md5(text)",
    "internal_texts": "SELECT id, hash, text FROM texts_by_hash",
    "typed_docs": "SELECT doc_id AS id, CASE WHEN lang = 'de' THEN 14 ELSE 0 END AS ns, md5(text) AS hash, "
    "concat(substr({line}, 1, 60), ' [', CAST(doc_id AS {string}), ']') AS title FROM documents",
    "first_docs": "SELECT hash, ns, min(id) AS target_id FROM typed_docs GROUP BY hash, ns",
    "redirects": "SELECT d.id AS source_id, f.target_id FROM typed_docs d JOIN first_docs f ON d.hash = f.hash AND d.ns = f.ns WHERE d.id <> f.target_id",
    "internal_pages": "SELECT d.id, CAST(d.ns AS INT) AS ns, d.title, CASE WHEN r.source_id IS NULL THEN t.id END AS text_id "
    "FROM typed_docs d JOIN texts_by_hash t ON d.hash = t.hash LEFT JOIN redirects r ON d.id = r.source_id",
    "doc_count": "SELECT count(*) AS n FROM documents",
    "page_count": "SELECT count(*) AS m FROM pages",
    "raw_links": "SELECT DISTINCT l_orderkey % n AS source_id, ((l_partkey % n) * (l_partkey % n)) {div} n AS target_id FROM lineitem CROSS JOIN doc_count WHERE l_quantity <= 5",
    "internal_links": "SELECT l.source_id, l.target_id FROM raw_links l LEFT JOIN redirects r ON l.source_id = r.source_id WHERE r.source_id IS NULL AND l.source_id % 7 <> 0",
    "hosts": "SELECT page_id, url, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages",
    "named_hosts": "SELECT page_id, url, regexp_extract(host, '([^.]+[.])?(example[.](com|net|org))$', 0) AS name, "
    "regexp_extract(host, '(example[.](com|net|org))$', 1) AS tld FROM hosts",
    "external_domains": "SELECT row_number() OVER (ORDER BY name) AS id, name, tld FROM (SELECT DISTINCT name, tld FROM named_hosts) x",
    "external_pages": "SELECT h.page_id AS id, h.url, CAST(d.id AS BIGINT) AS domain_id FROM named_hosts h JOIN external_domains d ON h.name = d.name",
    "external_links": "SELECT DISTINCT l_orderkey % n AS source_id, (l_suppkey * 31 + l_linenumber) % m AS target_id FROM lineitem CROSS JOIN doc_count CROSS JOIN page_count WHERE l_quantity >= 48",
}

_SPARK = {"div": "div", "line": "substring_index(text, '\\n', 1)", "string": "STRING"}
_DUCK = {"div": "//", "line": "split_part(text, chr(10), 1)", "string": "VARCHAR"}


def model(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The model's tables over the Parquet tables in a folder, as lazy DataFrames."""
    made = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES}
    for name, sql in MODEL.items():
        text = sql.format(**_SPARK)
        used = set(re.findall(r"\b(?:FROM|JOIN) (\w+)", text))
        made[name] = spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)", r"\1 {\2}", text), **{t: made[t] for t in used})
    return made


def oracle(body: str, extra: dict[str, str] | None = None) -> str:
    """A DuckDB query whose ``body`` may name the model's tables, and those of ``extra``."""
    parts = {**{k: v.format(**_DUCK) for k, v in MODEL.items()}, **(extra or {})}
    return "WITH " + ",\n".join(f"{k} AS MATERIALIZED ({v})" for k, v in parts.items()) + "\n" + body
