"""Landed answers of the public sources as rows: one JSON document per line or file, parsed with a schema, junk tolerated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import epoch_ms
from ..functions.text import comment_title, strip_tags
from ..functions.url import first_company_url

HIT = ("engine", "title", "url", "author", "published_at", "snippet")


def raw(spark: SparkSession, path: str) -> DataFrame:
    """Landed bodies, a row per file."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "body")


def _hits(rows: DataFrame, schema: str, items: Column | str, engine: str, **cols: Column) -> DataFrame:
    j = rows.select(F.from_json("body", schema).alias("j")).select(F.explode(items).alias("h"))
    return j.select(F.lit(engine).alias("engine"), *[c.alias(n) for n, c in cols.items()])


def stories(rows: DataFrame) -> DataFrame:
    h = F.col
    return _hits(rows, "hits array<struct<title:string,url:string,author:string,created_at_i:bigint,story_text:string>>", "j.hits", "stories",
                 title=h("h.title"), url=h("h.url"), author=h("h.author"), published_at=F.timestamp_seconds("h.created_at_i"),
                     snippet=strip_tags(F.coalesce("h.story_text", F.lit(""))))


def thread_comments(rows: DataFrame, limit: int = 40) -> DataFrame:
    """Comments of a thread with a company's URL; ``limit`` a thread is the feature."""
    j = rows.select(F.from_json("body", "hits array<struct<comment_text:string,author:string,created_at_i:bigint>>").alias("j"))
    text = lambda x: x["comment_text"]
    kept = F.slice(F.filter("j.hits", lambda x: first_company_url(text(x)).isNotNull()), 1, limit)
    c = j.select(F.explode(kept).alias("h"))
    return c.select(F.lit("comments").alias("engine"), comment_title(strip_tags(F.col("h.comment_text"))).alias("title"),
        first_company_url(F.col("h.comment_text")).alias("url"),
                    F.col("h.author").alias("author"), F.timestamp_seconds("h.created_at_i").alias("published_at"),
                        strip_tags(F.col("h.comment_text")).alias("snippet"))


def repositories(rows: DataFrame, organizations_only: bool = True) -> DataFrame:
    h = F.col
    out = _hits(rows, "items array<struct<full_name:string,html_url:string,homepage:string,description:string,pushed_at:string,owner:struct<login:string,type:string>>>",
        "j.items", "repositories",
                title=h("h.full_name"), url=h("h.html_url"), homepage=h("h.homepage"), author=h("h.owner.login"), published_at=F.try_to_timestamp("h.pushed_at"),
                    snippet=h("h.description"), owner_type=h("h.owner.type"))
    return (out.where("owner_type = 'Organization'") if organizations_only else out).drop("owner_type")


def web_results(rows: DataFrame) -> DataFrame:
    """Organic and news results; an answer that carries an error gives none."""
    one = "array<struct<title:string,link:string,snippet:string>>"
    ok = rows.select(F.from_json("body", f"error string, organic_results {one}, news_results {one}").alias("j")).where("j.error IS NULL")
    none = F.array().cast(one)
    h = ok.select(F.explode(F.concat(F.coalesce("j.organic_results", none), F.coalesce("j.news_results", none))).alias("h"))
    return h.select(F.lit("web").alias("engine"), F.col("h.title").alias("title"), F.col("h.link").alias("url"), F.col("h.snippet").alias("snippet"))


def greenhouse(rows: DataFrame) -> DataFrame:
    j = rows.select("board", F.explode(F.from_json("body", "jobs array<struct<title:string,absolute_url:string,updated_at:string,content:string>>")["jobs"]).alias("h"))
    return j.select("board", F.col("h.title").alias("title"), F.col("h.absolute_url").alias("url"), F.try_to_timestamp("h.updated_at").alias("published_at"),
        F.substring(strip_tags(F.coalesce("h.content", F.lit(""))), 1, 2000).alias("content"))


def lever(rows: DataFrame) -> DataFrame:
    j = rows.select("board", F.explode(F.from_json("body", "array<struct<text:string,hostedUrl:string,createdAt:string,descriptionPlain:string>>")).alias("h"))
    return j.select("board", F.col("h.text").alias("title"), F.col("h.hostedUrl").alias("url"), epoch_ms(F.col("h.createdAt")).alias("published_at"),
        F.substring(F.coalesce("h.descriptionPlain", F.lit("")), 1, 2000).alias("content"))


def ashby(rows: DataFrame) -> DataFrame:
    j = rows.select("board", F.explode(F.from_json("body",
        "jobs array<struct<title:string,jobUrl:string,publishedAt:string,descriptionPlain:string>>")["jobs"]).alias("h"))
    return j.select("board", F.col("h.title").alias("title"), F.col("h.jobUrl").alias("url"), F.try_to_timestamp("h.publishedAt").alias("published_at"),
        F.substring(F.coalesce("h.descriptionPlain", F.lit("")), 1, 2000).alias("content"))


def certificate_names(rows: DataFrame) -> DataFrame:
    """Distinct host names per domain with their first issue: rows (domain, body)."""
    j = rows.select("domain", F.explode(F.from_json("body", "array<struct<name_value:string,not_before:string>>")).alias("h"))
    n = j.select("domain", F.try_to_timestamp("h.not_before").alias("issued"), F.explode(F.split("h.name_value", "\n")).alias("name"))
    n = n.withColumn("name", F.regexp_replace(F.lower(F.trim("name")), r"^\*\.", "")).where(F.endswith("name",
        F.concat(F.lit("."), F.col("domain"))) | (F.col("name") == F.col("domain")))
    return n.groupBy("domain", "name").agg(F.min("issued").alias("first_issued"), F.max("issued").alias("last_issued"))


def certificate_growth(names: DataFrame, since: Column) -> DataFrame:
    return names.groupBy("domain").agg(F.count("*").alias("subdomains"), F.count_if(F.col("last_issued") >= since).alias("growth"))


def registration(rows: DataFrame, as_of: Column) -> DataFrame:
    """The last registration event, the age in days and the registrar of each domain: rows (domain, body)."""
    j = rows.select("domain", F.from_json("body",
        "events array<struct<eventAction:string,eventDate:string>>, entities array<struct<roles:array<string>,handle:string,vcardArray:array<string>>>").alias("j"))
    at = F.try_to_timestamp(F.try_element_at(F.filter("j.events", lambda e: e["eventAction"] == "registration"), F.lit(-1))["eventDate"])
    # a card is ["vcard", [[name, parameters, type, value], ...]]; the name of the first registrar that has one
    lines = lambda e: F.coalesce(F.from_json(F.try_element_at(e["vcardArray"], F.lit(2)), "array<array<string>>"), F.array().cast("array<array<string>>"))
    registrars = F.filter("j.entities", lambda e: F.array_contains(e["roles"], "registrar"))
    named = F.filter(F.flatten(F.transform(registrars, lines)), lambda x: F.try_element_at(x, F.lit(1)) == "fn")
    registrar = F.coalesce(F.try_element_at(F.try_element_at(named, F.lit(1)), F.lit(4)), F.try_element_at(registrars, F.lit(1))["handle"])
    return j.select("domain", at.alias("registered_at"), F.datediff(as_of, at).alias("age_days"), registrar.alias("registrar"))


def dns_records(records: DataFrame) -> DataFrame:
    """(domain, kind, value) records to one hygiene struct per domain; what no lookup answered stays null."""
    of = lambda k: F.col("kind") == k
    g = records.groupBy("domain").agg(
        F.bool_or(of("MX") & F.col("value").isNotNull()).alias("mx"), F.max(F.when(of("TXT") & F.col("value").startswith("v=spf1"), F.col("value"))).alias("spf"),
        F.max(F.when(of("DMARC"), F.nullif(F.regexp_extract("value", r"p=(\w+)", 1), F.lit("")))).alias("dmarc"),
            F.bool_or(F.when(of("DNSKEY"), F.col("value").isNotNull())).alias("dnssec"),
        F.bool_or(F.when(of("SECURITY_TXT"), F.col("value").isNotNull())).alias("security_txt"),
    )
    return g.select("domain", F.struct("mx", "spf", "dmarc", "dnssec", "security_txt").alias("hygiene"))
