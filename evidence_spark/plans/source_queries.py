"""Queries of log parsers, sinks' formats, streams and user parsers.

The lines that parsers read are derived from the tables: one line per row, one file per
kind of row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark.functions.records import records_of_events
from evidence_spark.operators import reconstruct as J
from evidence_spark.operators import registry as U
from evidence_spark.operators import rules as D
from evidence_spark.plans.registry import query, table
from evidence_spark.plans.rule_queries import ALERTS, RULES
from evidence_spark.sources import readers as S
from evidence_spark.sources import writers as K
from evidence_spark.streaming import ingest as W


def lines(s, d, line: Column) -> DataFrame:
    """A line per event, in a file per kind of event."""
    e = table(s, d, "events")
    return e.select(F.concat(F.lit("/logs/"), "event_type").alias("path"), F.col("event_id").alias("pos"), line.alias("line"))


def text(c: str) -> Column:
    return F.col(c).cast("string")


@query("s1_route_files", "SELECT path, p AS parser_name FROM (SELECT '/c/' || p_brand || '/' || replace(p_name, ' ', '_') || '.evt' AS path, replace(p_name, ' ', '_') || '.evt' AS base, p_type FROM part), (VALUES ('ext'), ('start'), ('rex'), ('name'), ('magic')) v(p) WHERE p = 'ext' OR (p = 'start' AND (starts_with(base, 'red') OR starts_with(base, 'blue'))) OR (p = 'rex' AND regexp_full_match(base, '[a-z]+_ring.evt')) OR (p = 'name' AND base = 'small_ring.evt') OR (p = 'magic' AND starts_with(p_type, 'EC')) GROUP BY ALL")
def _(s, d):
    files = table(s, d, "part").select(F.concat(F.lit("/c/"), "p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".evt")).alias("path"), F.encode("p_type", "UTF-8").alias("content"))
    parsers = s.createDataFrame([("ext", "extension", ".evtx, .evt"), ("start", "startswith", "red,blue"), ("rex", "regex", "[a-z]+_ring.evt"), ("name", "file_name", "small_ring.evt"), ("magic", "magic_number", "45 43")], "parser_name string, categorization_type string, categorization_values string")
    return S.route_files(files, parsers)





@query("s5_w3c_log", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS \"when\", CAST(user_id AS VARCHAR) AS who, CASE WHEN event_id % 5 = 0 THEN 'more' END AS extra FROM events e WHERE event_id % 100 <> 0")
def _(s, d):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    line = F.when(F.col("event_id") % 100 == 0, F.lit("# a comment")).otherwise(F.concat_ws(" ", stamp, text("user_id"), text("event_id"), F.when(F.col("event_id") % 5 == 0, F.lit("more"))))
    body = lines(s, d, line)
    head = body.select("path").distinct().select("path", F.lit(-1).cast("long").alias("pos"), F.lit("#Fields: date time cs(User-Agent) s-id").alias("line"))
    out = S.parse_w3c(body.unionByName(head))
    get = lambda k: F.try_element_at("fields", F.lit(k))
    return out.select(get("s_id").cast("long").alias("event_id"), F.col("@timestamp").alias("when"), get("cs_user_agent").alias("who"), get("field4").alias("extra"))


@query("s6_exchange_log", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS \"when\", event_type || ', \"' || CAST(user_id AS VARCHAR) || '\"' || CASE WHEN event_id % 50 = 1 THEN repeat('x, ', 1500) ELSE '' END AS note FROM events WHERE event_id % 10 <> 0")
def _(s, d):
    stamp = F.when(F.col("event_id") % 10 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.lit(""))
    line = F.concat(stamp, F.lit(","), text("event_id"), F.lit(',"'), "event_type", F.lit(', ""'), text("user_id"), F.lit('""'), F.when(F.col("event_id") % 50 == 1, F.repeat(F.lit("x, "), 1500)).otherwise(""), F.lit('"'))
    body = lines(s, d, line)
    head = body.select("path").distinct().select("path", F.lit(-1).cast("long").alias("pos"), F.lit(S.BOM + "#Fields: DateTime,id,note").alias("line"))
    out = S.parse_exchange(body.unionByName(head))
    return out.select(F.col("fields")["id"].cast("long").alias("event_id"), F.col("@timestamp").alias("when"), F.col("fields")["note"].alias("note"))


@query("s7_trace_log", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS level, CASE WHEN event_id % 4 = 0 THEN '1700-01-01T00:00:00' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS \"when\", CASE WHEN event_id % 4 = 0 THEN 'more ' ELSE 'user ' END || CAST(user_id AS VARCHAR) AS message FROM events")
def _(s, d):
    good = F.concat(F.lit("  "), "event_type", F.lit(" "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("   user "), text("user_id"))
    out = S.parse_trace_log(lines(s, d, F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("more "), text("user_id"))).otherwise(good)))
    return out.select(F.col("pos").alias("event_id"), "level", F.col("@timestamp").alias("when"), "message")


@query("s8_sccm_log", "SELECT event_id, 'user ' || CAST(user_id AS VARCHAR) AS message, event_type AS component, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000' AS \"when\" FROM events")
def _(s, d):
    line = F.concat(F.lit("<![LOG[user "), text("user_id"), F.lit(']LOG]!><time="'), F.date_format("ts", "HH:mm:ss"), F.lit('.000-180" date="'), F.date_format("ts", "MM-dd-yyyy"), F.lit('" component="'), "event_type", F.lit('">'))
    return S.parse_sccm_log(lines(s, d, line)).select(F.col("pos").alias("event_id"), "message", F.col("fields")["component"].alias("component"), F.col("@timestamp").alias("when"))


@query("s9_netlogon", "SELECT event_id, 'u' || CAST(user_id AS VARCHAR) AS \"user\", event_type = 'view' AS is_request, CASE WHEN event_type = 'click' THEN 'The specified user does not exist' END AS message FROM events WHERE event_type IN ('view', 'click')")
def _(s, d):
    tail = F.when(F.col("event_type") == "view", F.lit("Entered")).when(F.col("event_type") == "click", F.lit("Returns 0xC0000064")).otherwise(F.lit("Lost"))
    line = F.concat(F.date_format("ts", "MM/dd HH:mm:ss"), F.lit(" [LOGON] [12] D: SamLogon: Transitive Network logon of D\\u"), text("user_id"), F.lit(" from SRC (via DST) "), tail)
    return S.parse_netlogon(lines(s, d, line)).select(F.col("pos").alias("event_id"), "user", "is_request", "message")


@query("s13_mft", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created, '\\' || event_type || ',x' AS full FROM events WHERE event_id % 3 <> 0")
def _(s, d):
    good = F.concat_ws(",", text("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.concat(F.lit("/"), "event_type"), F.lit("x"))
    df = lines(s, d, F.when(F.col("event_id") % 3 == 0, text("event_id")).otherwise(good))
    out = S.normalize_mft(df, ["Rec", "FileNameCreated", "FullPath"])
    return out.select(F.col("pos").alias("event_id"), F.col("@timestamp").alias("created"), F.col("FullPath").alias("full"))


@query("s14_flows", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '.000' ELSE strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '.250' END AS \"when\" FROM events")
def _(s, d):
    sec = F.unix_seconds(F.col("ts").cast("timestamp"))
    df = table(s, d, "events").select("event_id", sec.alias("first_seen"), sec.alias("last_seen"), F.when(F.col("event_id") % 2 == 1, sec * 1000 + 250).alias("first_seen_ms"), F.lit(None).cast("long").alias("last_seen_ms"))
    return S.normalize_flows(df).select("event_id", F.col("@timestamp").alias("when"))


@query("s15_shutdown_log", "SELECT event_id, nxt AS term FROM (SELECT event_id, event_type, user_id, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM events) WHERE event_type <> 'error' AND nxt IS NOT NULL")
def _(s, d):
    e = table(s, d, "events")
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("SIGTERM: ["), text("event_id"), F.lit("]"))).otherwise(F.concat(F.lit("remaining client pid: "), text("event_id"), F.lit(" (/bin/x)")))
    df = e.select(text("user_id").alias("path"), F.col("event_id").alias("pos"), line.alias("line"))
    return S.parse_shutdown_log(df).select(F.col("pid").cast("long").alias("event_id"), F.unix_seconds("ts").alias("term"))


@query("s16_receivers", "SELECT event_id, 'com.' || event_type || '/.R' AS receiver FROM (SELECT event_id, event_type, user_id, last_value(CASE WHEN event_type IN ('error', 'signup') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS head FROM events) WHERE head = 'error' AND event_type IN ('view', 'click')")
def _(s, d):
    e = table(s, d, "events")
    line = F.when(F.col("event_type").isin("error", "signup"), F.concat(F.lit("    "), "event_type", F.lit(":"))).otherwise(F.concat(F.lit("        "), text("event_id"), F.lit(" com."), "event_type", F.lit("/.R")))
    df = e.select(text("user_id").alias("path"), F.col("event_id").alias("pos"), line.alias("line"))
    return S.parse_receivers(df, "error", ["com.purchase"]).select(F.col("id").cast("long").alias("event_id"), "receiver")


@query("s18_render_items", "SELECT '[' || coalesce(CASE WHEN l_partkey % 2 = 0 THEN CAST(l_partkey AS VARCHAR) END, CAST(l_suppkey AS VARCHAR)) || '] of ' || CAST(l_orderkey AS VARCHAR) AS message, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS \"when\" FROM lineitem")
def _(s, d):
    li = table(s, d, "lineitem")
    item = F.struct(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("t"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey")).alias("a"), F.col("l_suppkey").alias("b"), F.col("l_orderkey").alias("c"))
    df = li.groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))
    return S.render_items(df, [{"items": "items", "type": "x", "timestamp": "t", "format": "yyyy-MM-dd HH:mm:ss", "message": "[{a|b}] of {c}"}]).select("message", F.col("@timestamp").alias("when"))


@query("s20_kv_report", "SELECT p_partkey, sha1(p_name) AS digest, p_brand AS brand FROM part")
def _(s, d):
    report = F.concat(F.lit("Brand="), "p_brand", F.lit("\r\nTargetAppId=W:x!0000"), F.sha1("p_name"), F.lit("!y\r\nno pair\r\nBrand=later"))
    return S.parse_kv_report(table(s, d, "part").select("p_partkey", report.alias("text"))).select("p_partkey", F.col("sha1").alias("digest"), F.col("fields")["Brand"].alias("brand"))


@query("s21_memory_table", "SELECT event_id, '0x' || lower(to_hex(event_id * 4096)) AS off, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS \"when\" FROM events WHERE event_type <> 'error'")
def _(s, d):
    df = table(s, d, "events").select("event_id", (F.col("event_id") * 4096).alias("off"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("CreateTime"), F.when(F.col("event_type") != "error", F.lit(1)).alias("Handle"), F.lit("x").alias("__children"))
    return S.normalize_memory_table(df, "CreateTime", ["off"], ["Handle"]).select("event_id", "off", F.col("@timestamp").alias("when"))


@query("s22_ps", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'w' ELSE '' END AS wchan, event_type AS name FROM events")
def _(s, d):
    line = F.concat_ws(" ", F.lit("root "), text("event_id"), F.lit("1  10 20"), F.when(F.col("event_id") % 2 == 0, F.lit("w")), F.lit("0 S"), F.col("event_type"))
    return S.parse_ps(lines(s, d, line)).select(F.col("pid").cast("long").alias("event_id"), "wchan", "name")


@query("k5_body_lines", "SELECT '|order ' || CAST(o_orderkey AS VARCHAR) || '_x||||||0|0|0|' || CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) AS line FROM orders")
def _(s, d):
    none = F.lit(None).cast("timestamp")
    return table(s, d, "orders").select(K.body_line(F.concat(F.lit("order "), text("o_orderkey"), F.lit("|x")), none, none, none, F.col("o_orderdate").cast("timestamp")).alias("line"))


@query("j19_version_diff", "SELECT user_id, event_id, line, change FROM (SELECT user_id, event_id, event_type AS n, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS o FROM events), LATERAL (VALUES (n, 'added'), (o, 'removed')) v(line, change) WHERE o <> n")
def _(s, d):
    df = table(s, d, "events").select("user_id", "event_id", F.concat(F.lit("same\n"), "event_type", F.lit("\nend")).alias("text"))
    return J.version_diff(df, ["user_id"], "event_id").drop("at")


@query("j19_moved_lines", """
WITH e AS (SELECT user_id, event_id, event_type AS n, event_id % 2 AS pn, lag(event_type) OVER w AS o, lag(event_id % 2) OVER w AS po FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
c AS (SELECT user_id, event_id, CASE WHEN o <> n THEN n WHEN po = 0 THEN n ELSE 'same' END AS a, CASE WHEN o <> n THEN o WHEN po = 0 THEN n ELSE 'same' END AS r FROM e WHERE o <> n OR po <> pn)
SELECT user_id, event_id, a AS line, 'added' AS change FROM c UNION ALL SELECT user_id, event_id, r, 'removed' FROM c""")
def _(s, d):
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("same\n"), "event_type")).otherwise(F.concat("event_type", F.lit("\nsame\n")))
    return J.version_diff(table(s, d, "events").select("user_id", "event_id", text.alias("text")), ["user_id"], "event_id").drop("at")


def event_stream(s, d) -> DataFrame:
    """The events table as a stream of records."""
    e = table(s, d, "events")
    return records_of_events(s.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(d))


@query("w2_stream_scan", f"SELECT rule_name, machine, count(*) AS n FROM {ALERTS} GROUP BY 1, 2")
def _(s, d):
    return W.drain(W.stream_scan(event_stream(s, d), RULES)).groupBy("rule_name", "machine").agg(F.count("*").alias("n"))


@query("w3_stream_correlate", "SELECT a.machine, a.record_id AS id_a, b.record_id AS id_b FROM {REC} a JOIN {REC} b ON a.machine = b.machine AND a.data_type = 'signup' AND b.data_type = 'error' AND abs(epoch_ms(a.ts) - epoch_ms(b.ts)) < 600000")
def _(s, d):
    a, b = (W.rule_stream(event_stream(s, d), D.Rule(k, include={"event_type": k})) for k in ("signup", "error"))
    return W.drain(W.stream_correlate(a, b, 600_000)).select("machine", "id_a", "id_b")


@query("w3_stream_rules", "SELECT a.machine, a.record_id AS s, b.record_id AS e, c.record_id AS v, '{\"props_k\":\"' || CAST(a.k AS VARCHAR) || '\"}' AS of_s, 'three in a row' AS description FROM {REC} a JOIN {REC} b ON a.machine = b.machine AND a.data_type = 'signup' AND b.data_type = 'error' JOIN {REC} c ON c.machine = a.machine AND c.data_type = 'view' WHERE epoch_ms(greatest(a.ts, b.ts, c.ts)) - epoch_ms(least(a.ts, b.ts, c.ts)) < 900000")
def _(s, d):
    rule = D.Rule("Triple", calls=["S", "E", "V"], within=900_000, description="three in a row")
    private = {k: D.Rule(k, False, channel=t, include={"event_type": t}, returns=["props.k"]) for k, t in (("S", "signup"), ("E", "error"), ("V", "view"))}
    blocks = W.drain(W.stream_blocks(event_stream(s, d), rule, private))
    out = W.block_alerts(blocks.repartition(4 * s.sparkContext.defaultParallelism), rule)  # small files of many sets
    return out.select("machine", *[F.col("record_ids")[i].alias(c) for i, c in enumerate("sev")], F.col("returned")["S"].alias("of_s"), "description")


@query("u1_user_parser", "SELECT doc_id, length(text) AS n FROM documents")
def _(s, d):
    U.register_parser("length", _length)
    files = table(s, d, "documents").select(text("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    out = U.run_parser(files, "length")
    return out.select(F.col("path").cast("long").alias("doc_id"), F.get_json_object("data", "$.n").cast("long").alias("n"))


def _length(path, content):
    yield {"n": len(content.decode())}


@query("u2_user_module", "SELECT page_id, 'visit' AS event FROM pages WHERE contains(url, 'example.org')")
def _(s, d):
    hit = lambda r, iocs: r.join(iocs, F.contains("url", "value"), "left_semi")
    U.register_module("visits", lambda t: t.select("page_id", "url"), hit, lambda r: r.select("page_id", F.lit("visit").alias("event")))
    iocs = s.createDataFrame([("example.org",)], "value string")
    out = U.run_module("visits", F.broadcast(iocs), table(s, d, "pages"))
    return U.MODULES["visits"].serialize(out["detected"])
