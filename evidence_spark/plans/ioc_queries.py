"""Queries of indicator matching and heuristics."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark.operators import heuristics as H
from evidence_spark.operators import ioc as I
from evidence_spark.plans.registry import query, table

IOCS = [
    ("domain", "therin.example.net"), ("domain", "example.org"), ("domain", "blog.ththan.example.net"), ("domain", "nowhere.test"), ("email", "that.92@mail2.example.com"),
    ("process", "Customer#00000000"), ("process", "red widget"), ("process", "MACHINERY"), ("file", "blue ring"), ("file_path", "/Brand#1/"), ("file_path", "/Brand#2/small"), ("sha256", "none"), ("app", "ECONOMY"), ("app", "PROMO"),
]
HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))"
REG = f"regexp_extract({HOST}, '([^.]+\\.[^.]+)$', 1)"
DOMAIN = f"SELECT page_id, ioc FROM pages, (VALUES ('therin.example.net'), ('example.org'), ('blog.ththan.example.net'), ('nowhere.test')) v(ioc) WHERE {HOST} = ioc OR {REG} = ioc"


def iocs(spark):
    return spark.createDataFrame(IOCS, "kind string, value string")


@query("i1_domain", DOMAIN)
def _(s, d):
    return I.match_domain(table(s, d, "pages"), "url", iocs(s)).select("page_id", "ioc")


@query("i2_any_domain", DOMAIN)
def _(s, d):
    p = table(s, d, "pages").select("page_id", F.array(F.col("url"), F.lit("https://else.test/"), F.col("url")).alias("urls"))
    return I.match_any_domain(p, "urls", iocs(s)).select("page_id", "ioc")


@query("i3_domain_substring", "SELECT page_id, ioc FROM pages, (VALUES ('therin.example.net'), ('example.org'), ('blog.ththan.example.net'), ('nowhere.test')) v(ioc) WHERE contains(lower(url), ioc)")
def _(s, d):
    p = table(s, d, "pages").withColumn("odd", F.regexp_replace("url", "://", ":"))
    return I.match_domain_substring(p, "odd", iocs(s)).select("page_id", "ioc")


@query("i4_process", "SELECT p_partkey, p_name AS ioc FROM part WHERE p_name = 'red widget'")
def _(s, d):
    p = table(s, d, "part").withColumn("proc", F.concat(F.lit("/usr/bin/"), "p_name"))
    return I.match_process(p, "proc", iocs(s)).select("p_partkey", "ioc")


@query("i4_process_cut", "SELECT c_custkey, 'Customer#00000000' AS ioc FROM customer WHERE c_name LIKE 'Customer#0000000%' ")
def _(s, d):
    c = table(s, d, "customer").withColumn("proc", F.concat(F.lit("/bin/"), F.substring("c_name", 1, 16)))
    return I.match_process(c, "proc", iocs(s)).select("c_custkey", "ioc")


@query("i5_email", "SELECT doc_id, 'that.92@mail2.example.com' AS ioc FROM documents WHERE regexp_extract(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]*[A-Za-z0-9])', 1) = 'that.92@mail2.example.com'")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id", F.concat(F.lit("MailTo:"), F.upper(F.regexp_extract("text", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]*[A-Za-z0-9])", 1))).alias("m"))
    return I.match_email(docs, "m", iocs(s)).select("doc_id", "ioc")


@query("i6_file_name", "SELECT p_partkey, p_name AS ioc FROM part WHERE p_name = 'blue ring'")
def _(s, d):
    return I.match_file_name(table(s, d, "part").withColumn("f", F.concat(F.lit("/a/b/"), "p_name")), "f", iocs(s)).select("p_partkey", "ioc")


@query("i7_path_prefix", "SELECT p_partkey, ioc FROM (SELECT p_partkey, '/' || p_brand || '/' || p_name AS f FROM part), (VALUES ('/Brand#1'), ('/Brand#2/small')) v(ioc) WHERE starts_with(f, ioc)")
def _(s, d):
    return I.match_path_prefix(table(s, d, "part").withColumn("f", F.concat_ws("/", F.lit(""), "p_brand", "p_name")), "f", iocs(s)).select("p_partkey", "ioc")


@query("i8_path_part", "SELECT c_custkey, 'MACHINERY' AS ioc FROM customer WHERE c_mktsegment = 'MACHINERY'")
def _(s, d):
    return I.match_path_part(table(s, d, "customer").withColumn("f", F.concat_ws("/", F.lit(""), "c_name", "c_mktsegment", F.lit("x"))), "f", iocs(s)).select("c_custkey", "ioc")


@query("i9_path_mention", "SELECT page_id, ioc FROM pages, (VALUES ('therin.example.net'), ('example.org'), ('blog.ththan.example.net'), ('nowhere.test')) v(ioc) WHERE contains(lower(url), ioc)")
def _(s, d):
    return I.match_path_mention(table(s, d, "pages").withColumn("f", F.concat(F.lit("Library/"), "url")), "f", iocs(s)).select("page_id", "ioc")


@query("i9_many_mentions", "SELECT ioc, count(*) AS n FROM documents JOIN (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS ioc FROM benchmark) ON contains(lower(text), ioc) GROUP BY 1")
def _(s, d):
    words = table(s, d, "benchmark").select(F.lit("domain").alias("kind"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), 0)).alias("value"))
    return I.match_path_mention(table(s, d, "documents").select("text"), "text", words).groupBy("ioc").agg(F.count("*").alias("n"))


@query("i10_exact", "SELECT p_partkey, p_type AS ioc FROM part WHERE p_type IN ('ECONOMY', 'PROMO')")
def _(s, d):
    return I.match_exact(table(s, d, "part"), "p_type", iocs(s), "app").select("p_partkey", "ioc")


@query("i11_any_field", f"SELECT DISTINCT page_id AS record_id, ioc, 'domain' AS kind FROM pages, (VALUES ('therin.example.net'), ('example.org'), ('blog.ththan.example.net'), ('nowhere.test')) v(ioc) WHERE contains(lower(url), ioc) UNION ALL SELECT p_partkey + 1000000, 'red widget', 'process' FROM part WHERE p_name = 'red widget'")
def _(s, d):
    leaves = table(s, d, "pages").select(F.col("page_id").alias("record_id"), F.col("url").alias("value"))
    leaves = leaves.unionByName(table(s, d, "part").select((F.col("p_partkey") + 1_000_000).alias("record_id"), F.col("p_name").alias("value")))
    return I.match_any_field(leaves, iocs(s))


@query("i12_redirect_chain", f"SELECT page_id, ioc, 'a.test -> ' || {HOST} || ' -> b.test' AS chain FROM pages, (VALUES ('therin.example.net'), ('example.org'), ('blog.ththan.example.net')) v(ioc) WHERE {HOST} = ioc OR {REG} = ioc")
def _(s, d):
    from evidence_spark.functions.convert import url_host

    p = table(s, d, "pages").select("page_id", url_host("url").alias("origin"), F.array(F.lit("a.test")).alias("sources"), F.array(F.lit("b.test")).alias("destinations"))
    return I.match_redirect_chain(p, iocs(s)).select("page_id", "ioc", "chain")


@query("i13_detected", f"SELECT page_id, string_agg(ioc, ',' ORDER BY ioc) AS iocs FROM ({DOMAIN}) GROUP BY 1")
def _(s, d):
    p = table(s, d, "pages")
    return I.detected(p.select("page_id", "url"), I.match_domain(p, "url", iocs(s)).select("page_id", "ioc"), "page_id").select("page_id", F.array_join("iocs", ",").alias("iocs"))


@query("i14_detected_by_source", f"SELECT source, string_agg(DISTINCT ioc, ',' ORDER BY ioc) AS iocs, count(*) AS n FROM (SELECT page_id % 7 AS source, ioc FROM ({DOMAIN})) GROUP BY 1")
def _(s, d):
    hits = I.match_domain(table(s, d, "pages"), "url", iocs(s)).select((F.col("page_id") % 7).alias("source"), "ioc")
    return I.detected_by_source(hits, "source").select("source", F.array_join("iocs", ",").alias("iocs"), "n")


# -- heuristics --------------------------------------------------------------------------


@query("h1_redirect_injection", "SELECT a.event_id AS visit_id, (b.event_id - a.event_id) * 300 AS gap_ms FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id BETWEEN a.event_id + 1 AND a.event_id + 3 AND a.event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY b.event_id) = 1")
def _(s, d):
    from pyspark.sql import Window as W

    e = table(s, d, "events").withColumn("nxt", F.lead("event_id").over(W.partitionBy("user_id").orderBy("event_id")))
    host = F.concat(F.lit("http://h"), F.col("event_id").cast("string"), F.lit(".test/"))
    url = F.when(F.col("event_id") % 3 == 0, host).otherwise(F.replace(host, F.lit("http:"), F.lit("https:")))
    visits = e.select(F.col("user_id").alias("machine"), F.col("event_id").alias("visit_id"), url.alias("url"), F.timestamp_micros(F.col("event_id") * 300_000).alias("ts"), F.col("nxt").alias("redirect_destination"))
    return H.redirect_injection(visits).select("visit_id", "gap_ms")


@query("h2_manipulated_processes", "SELECT o_custkey, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS first_ts FROM orders WHERE o_custkey % 9 = 0 GROUP BY 1")
def _(s, d):
    usage = table(s, d, "orders").select(F.lit("M").alias("machine"), "o_custkey", F.col("o_orderdate").alias("ts"))
    procs = table(s, d, "customer").where("c_custkey % 9 <> 0").select(F.lit("M").alias("machine"), F.col("c_custkey").alias("o_custkey"))
    return H.manipulated_processes(usage, procs, "o_custkey").select("o_custkey", "n", F.date_format("first_ts", "yyyy-MM-dd").alias("first_ts"))


@query("h3_missing_ids", "SELECT machine, unnest(range(p + 1, e)) AS missing_id, p AS previous_id FROM (SELECT user_id % 20 AS machine, event_id AS e, lag(event_id) OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS p FROM events) WHERE e > p + 1")
def _(s, d):
    e = table(s, d, "events").select((F.col("user_id") % 20).alias("machine"), "event_id")
    return H.missing_ids(e, ["machine"], "event_id").select("machine", "missing_id", "previous_id")


@query("h4_suid_files", "SELECT p_partkey, (p_size % 8) & 4 <> 0 AS is_suid, (p_size % 8) & 2 <> 0 AS is_sgid FROM part WHERE (p_size % 8) & 6 <> 0")
def _(s, d):
    p = table(s, d, "part").withColumn("mode", F.concat((F.col("p_size") % 8).cast("string"), F.lit("755")))
    return H.suid_files(p).select("p_partkey", "is_suid", "is_sgid")


@query("h5_occurrences", "SELECT event_id, count(*) OVER (PARTITION BY nullif(user_id % 9, 4)) AS occurrences FROM events")
def _(s, d):
    return H.with_occurrences(table(s, d, "events").withColumn("user", F.nullif(F.col("user_id") % 9, F.lit(4))), "user").select("event_id", "occurrences")


@query("h6_root_packages", "SELECT p_partkey FROM part WHERE p_name IN ('red widget', 'small ring')")
def _(s, d):
    return H.root_packages(table(s, d, "part"), ["red widget", "small ring"], "p_name").select("p_partkey")


@query("h7_suspicious_pairs", "SELECT p_partkey FROM part WHERE (p_brand = 'Brand#2' AND p_type = 'ECONOMY') OR (p_brand = 'Brand#7' AND p_type = 'PROMO')")
def _(s, d):
    return H.suspicious_pairs(table(s, d, "part"), [("Brand#2", "ECONOMY"), ("Brand#7", "PROMO")], "p_brand", "p_type").select("p_partkey")


@query("h8_processes_without_binary", "SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 = 0)")
def _(s, d):
    procs = table(s, d, "customer").select(F.lit("M").alias("machine"), "c_custkey", F.col("c_custkey").cast("string").alias("name"), F.when(F.col("c_custkey") % 2 == 1, F.lit("b")).alias("bundle"))
    files = table(s, d, "orders").where("o_custkey % 3 = 0").select(F.lit("M").alias("machine"), F.concat(F.lit("/bin/"), F.col("o_custkey").cast("string")).alias("path"))
    return H.processes_without_binary(procs, files, "name", "path").select("c_custkey")


@query("h9_messages_of_interest", "SELECT conv_id, turn, CASE WHEN turn = 0 THEN 1 ELSE 2 END AS n FROM conversations WHERE turn IN (0, 3)")
def _(s, d):
    c = table(s, d, "conversations").withColumn("text", F.when(F.col("turn") == 0, F.concat("text", F.lit(" see http://a.test/x"))).when(F.col("turn") == 3, F.lit("HTTPS://b.test http://c.test")).otherwise(F.regexp_replace("text", "http", "")))
    return H.messages_of_interest(c, "text").select("conv_id", "turn", F.size("links").cast("long").alias("n"))
