"""Registered domains of URLs, by the longest public suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Common public suffixes; pass a full list as a parameter where it matters.
SUFFIXES = (
    "com", "org", "net", "edu", "gov", "int", "mil", "info", "biz", "io", "ai", "app", "dev", "eu", "de", "fr", "es", "it", "nl", "be", "ch", "at",
    "pl", "se", "no", "fi", "dk", "ie", "pt", "gr", "cz", "ru", "ua", "us", "ca", "mx", "br", "com.br", "ar", "com.ar", "au", "com.au", "org.au",
    "gov.au", "nz", "co.nz", "jp", "co.jp", "ac.jp", "or.jp", "kr", "co.kr", "cn", "com.cn", "in", "co.in", "za", "co.za", "uk", "co.uk", "org.uk",
    "ac.uk", "gov.uk", "tv", "me", "cc", "museum",
)


#: Rules that are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 200_000


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """``rule`` of each line of a public suffix list (its format: a rule first in a line, ``//`` before comments)."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s")[0].alias("rule"))
    return rows.where("rule <> '' AND rule NOT LIKE '//%'")


def split_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, name, tld`` of each distinct ``host``, its public suffix and the label before that, by ``rules(rule)``.

    A rule matches the labels that a host ends with, ``*`` any one label. An exception (``!``) wins and makes what follows its first
    label the suffix; else the rule of the most labels does. Nothing matches an address. A host without a suffix has an empty one
    and is named with a dot after it; one that is a suffix itself is named with a dot before. Rules and hosts are compared as
    they are written, in lower case; both have to be in the same form of international names.
    """
    known = rules.select(F.lower(F.trim(F.regexp_replace("rule", r"\.$", ""))).alias("rule")).where("rule <> ''").distinct()
    if known.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        known = F.broadcast(known)
    rows = hosts.select("host").where("host IS NOT NULL").distinct().withColumn("labels", F.split("host", r"\."))
    n = F.size("labels")
    tail = lambda k: F.array_join(F.slice("labels", n - k + 1, k), ".")
    named = rows.where(~F.col("host").rlike(r"^\d+(\.\d+){3}$|[:\[\]]")).select("host", "labels", F.explode(F.sequence(F.lit(1), n)).alias("k"))
    ways = F.array(tail(F.col("k")), F.concat(F.lit("!"), tail(F.col("k"))), F.when(F.col("k") == 1, "*").otherwise(F.concat(F.lit("*."), tail(F.col("k") - 1))))
    met = named.select("host", "k", F.explode(ways).alias("rule")).join(known, "rule")
    best = met.groupBy("host").agg(F.max(F.when(F.col("rule").startswith("!"), F.col("k") - 1)).alias("but"), F.max("k").alias("most"))
    rows = rows.join(best, "host", "left").withColumn("k", F.coalesce("but", "most", F.lit(0)))
    before = F.coalesce(F.get("labels", n - F.col("k") - 1), F.lit(""))
    name = F.when(F.col("k") == 0, F.concat("host", F.lit("."))).otherwise(F.concat(before, F.lit("."), tail(F.col("k"))))
    return rows.select("host", name.alias("name"), F.when(F.col("k") > 0, tail(F.col("k"))).otherwise("").alias("tld"))


def with_rules(rows: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``rows`` plus ``name`` and ``tld`` by public suffix rules (see ``split_hosts``); null where an address has no host."""
    rows = rows.withColumn("__host", host(F.col(url)))
    found = split_hosts(rows.select(F.col("__host").alias("host")), rules).withColumnRenamed("host", "__host")
    return rows.join(found, "__host", "left").drop("__host")


def host(url: Column) -> Column:
    """The lower-case host of a URL (one without a scheme may start with ``//``); null where there is none."""
    full = F.when(url.startswith("//"), F.concat(F.lit("http:"), url)).otherwise(url)
    return F.lower(F.try_parse_url(full, F.lit("HOST")))


def with_domain(rows: DataFrame, url: str = "url", suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``rows`` plus ``name`` and ``tld``: the label before the longest suffix with it, and the suffix.

    A host without a known suffix (an address, ``localhost``) has an empty suffix, and its name is the host and a dot. Where the host is
    a suffix itself, the name is a dot and the suffix. Native: at most five endings of a host are looked up in a literal set.
    """
    known = F.create_map(*[x for s in suffixes for x in (F.lit(s), F.lit(True))])
    labels = F.split("__host", r"\.")
    ending = lambda k: F.array_join(F.slice("__labels", F.greatest(F.size("__labels") - k + 1, F.lit(1)), k), ".")
    out = rows.withColumn("__host", host(F.col(url))).withColumn("__labels", labels)
    size = None
    for k in range(4, 0, -1):
        hit = (F.size("__labels") >= k) & F.coalesce(F.try_element_at(known, ending(k)), F.lit(False))
        size = F.when(hit, k) if size is None else size.when(hit, k)
    out = out.withColumn("__k", size.otherwise(0))
    tld = F.when(F.col("__k") > 0, F.array_join(F.slice("__labels", F.size("__labels") - F.col("__k") + 1, F.col("__k")), ".")).otherwise("")
    before = F.when(F.size("__labels") > F.col("__k"), F.element_at("__labels", F.greatest(F.size("__labels") - F.col("__k"), F.lit(1)))).otherwise("")
    name = F.when(F.col("__k") == 0, F.concat("__host", F.lit("."))).otherwise(F.concat(before, F.lit("."), tld))
    return out.withColumn("name", name).withColumn("tld", F.when(F.col("__host").isNotNull(), tld)).drop("__host", "__labels", "__k")
