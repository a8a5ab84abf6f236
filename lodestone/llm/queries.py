"""The queries opN_<name>: thin digests of the operators' results over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import annulus, classifier, decontaminate, licenses, lines, lm, mixing, quality, simhash, sql, threads, tokens, tries, warczip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, the base rules' verdict and the final one (see ``quality.judged``)."""
    rows = quality.judged(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(
        "doc_id", *[F.col(f"__m.{c}").alias(c) for c in counts], F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept")
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document (see ``mixing.mixed``)."""
    rows = mixing.mixed(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return rows.select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken")
    )


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every line of every document, the first occurrence of its group and whether it is that (see ``lines.groups``)."""
    return lines.groups(_table(spark, sf_dir, "documents")).select("doc_id", "line_no", "first_doc", "first_line", "kept")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document (see ``simhash.components``)."""
    rows = simhash.components(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality and toxicity of every document (see ``classifier``); hosts are sources, paths are a source's languages."""
    docs = _table(spark, sf_dir, "documents")
    model = classifier.trained(docs, _table(spark, sf_dir, "labels"))
    return classifier.judged(docs, model, F.col("source"), F.col("lang"), carry=["doc_id"])


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the shards (see ``tokens``)."""
    return tokens.documents(tokens.shards(_table(spark, sf_dir, "documents")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the benchmark each document holds (see ``decontaminate.scanned``)."""
    rows = decontaminate.scanned(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id",
        "__scan.n_words",
        "__scan.n_hit",
        F.size("__scan.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__scan.items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document (see ``lm``); the target is the documents labelled good and not toxic."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    chosen = _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return lm.scored(docs, chosen).select("doc_id", "__lm.n_words", "__lm.loss_target", "__lm.loss_background", "__lm.score")


def op7_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without its quotes, what it replies to and its place in reply order (see ``threads.linked``)."""
    return threads.linked(_table(spark, sf_dir, "conversations"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and template spans of every document (see ``licenses.scanned``)."""
    rows = licenses.scanned(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda c: F.array_join(f"__licence.{c}", ",").alias(c)
    return rows.select(
        "doc_id", "__licence.n_words", "__licence.n_base", "__licence.first_word", "__licence.last_word",
        joined("base_labels"), joined("labels"), "__licence.score",
    )


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back by ranges from the ZIP packages it was written to (see ``warczip``)."""
    made = warczip.packages(_table(spark, sf_dir, "pages"))
    rows = warczip.records(warczip.ranges(made), payloads=False)
    number = lambda c: F.col(c).cast("long")
    return rows.select(number("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after the rounds, its distance and its centroid's digest (see ``annulus``)."""
    rows, centroids = annulus.clustered(_table(spark, sf_dir, "embeddings"))
    return rows.select("*", annulus.named(centroids, F.col("cluster")).alias("centroid_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations (see ``tries``): conversation c has the first h = crc32(c) % 9 turns of
    conversation c - c % 5, then its own from the next after its first h."""
    turns = tries.ordered(_table(spark, sf_dir, "conversations"))
    h = F.crc32(F.col("conv").cast("string")) % 9
    sizes = turns.groupBy("conv").agg(F.max("pos").alias("n_own"))
    wanted = sizes.select("conv", (F.col("conv") - F.col("conv") % 5).alias("base"), h.alias("h"), "n_own")
    heads = turns.where("pos <= 8").withColumnRenamed("conv", "base")
    begun = wanted.join(heads, "base").where("pos <= h").select("conv", F.col("pos").alias("depth"), "t1", "t2", "n_bytes")
    lengths = sizes.select(F.col("conv").alias("base"), F.col("n_own").alias("n_base"))
    shift = F.col("h") - F.least("h", F.coalesce("n_base", F.lit(0)))
    moved = wanted.join(lengths, "base", "left").withColumn("shift", shift).where("shift > 0 and n_own > h")
    moved = moved.select("conv", "shift", F.explode(F.sequence(F.lit(0).cast("long"), tries.block(F.col("n_own")))).alias("block"))
    own = turns.where(F.col("pos") > h).withColumn("block", tries.block(F.col("pos"))).join(moved, ["conv", "block"], "left")
    own = own.select("conv", (F.col("pos") - F.coalesce("shift", F.lit(0))).alias("depth"), "t1", "t2", "n_bytes")
    return tries.nodes(begun.unionByName(own), sizes)


QUERIES = {
    "op1_lines": op1_lines,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_tokens": op4_tokens,
    "op5_decontamination": op5_decontamination,
    "op6_lm_scores": op6_lm_scores,
    "op7_threads": op7_threads,
    "op8_licenses": op8_licenses,
    "op9_mixing": op9_mixing,
    "op10_quality_rules": op10_quality_rules,
    "op11_warc": op11_warc,
    "op12_centroids": op12_centroids,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL: dict[str, str] = {"op11_warc": sql.WARC, "op12_centroids": sql.CLUSTERS, "op13_prefix_trie": sql.TRIE}
