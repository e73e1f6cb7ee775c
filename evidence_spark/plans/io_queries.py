"""Queries of file readers, sinks, rule and view text, and incremental ingest.

Each writes files that it derives from the tables to the shared folder, through Spark, and
reads them with the reader (or writes them with the sink) that it is about.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark.functions import jsonfix as JF
from evidence_spark.functions.records import event_records, get_path, variant
from evidence_spark.functions.storage import shared_dir
from evidence_spark.operators import ioc as I
from evidence_spark.operators import rules as D
from evidence_spark.operators import search as Q
from evidence_spark.operators import timeline as T
from evidence_spark.plans.registry import query, table
from evidence_spark.plans.rule_queries import ALERTS, RULES
from evidence_spark.sources import readers as S
from evidence_spark.sources import store as B
from evidence_spark.sources import writers as K
from evidence_spark.streaming import ingest as W


def place(s, name: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_dir(s)}/files/{uuid.uuid4().hex}/{name}"


def text_files(s, lines: DataFrame, line: Column, name: str) -> str:
    path = place(s, name)
    lines.select(line.alias("value")).write.text(path)
    return path


def text(c: str) -> Column:
    return F.col(c).cast("string")


def envelope(r: DataFrame) -> Column:
    """A record as a line of a kjson file."""
    return F.to_json(F.struct(F.from_json("data", "`@timestamp` string, event_type string, user_id long").alias("Data"), "data_source", "data_type", "data_path", "machine"))


@query("s2_read_kjson", """SELECT bad, count(*) AS n, sum(u) AS users, count(reject) AS rejects, string_agg(DISTINCT machine, ',' ORDER BY machine) AS machines
FROM (SELECT event_id % 10 = 3 AS bad, CASE WHEN event_id % 10 <> 3 THEN user_id END AS u, CASE WHEN event_id % 10 = 3 THEN 'x' END AS reject, CASE WHEN event_id % 10 <> 3 THEN machine END AS machine FROM {REC}) GROUP BY 1""")
def _(s, d):
    r = event_records(s, d)
    broken = F.concat(F.lit('{"Data": '), "record_id")
    path = text_files(s, r, F.when(F.col("record_id").cast("long") % 10 == 3, broken).otherwise(envelope(r)), "kjson")
    got = S.read_kjson(s, path).withColumn("u", F.get_json_object("data", "$.user_id").cast("long"))
    machines = F.array_join(F.array_sort(F.collect_set("machine")), ",")
    return got.groupBy("bad").agg(F.count("*").alias("n"), F.sum("u").alias("users"), F.count("reject").alias("rejects"), F.nullif(machines, F.lit("")).alias("machines"))


@query("s3_read_jsonl", "SELECT CASE WHEN event_id % 7 <> 0 THEN event_id END AS event_id, event_id % 7 = 0 AS bad, true AS is_path FROM events")
def _(s, d):
    e = table(s, d, "events")
    line = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("[1, "), text("event_id"))).otherwise(F.to_json(F.struct("event_id", "event_type")))
    got = S.read_jsonl(s, text_files(s, e, line, "lines.jsonl"))
    return got.select(F.get_json_object("data", "$.event_id").cast("long").alias("event_id"), "bad", F.contains("data_type", F.lit("lines.jsonl")).alias("is_path"))


@query("s4_read_csv", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name || ', \"x\"' AS note, CASE WHEN p_size > 20 THEN p_type ELSE '' END AS p_type FROM part")
def _(s, d):
    p = table(s, d, "part").select("p_partkey", F.concat("p_name", F.lit(', "x"')).alias("note"), F.when(F.col("p_size") > 20, F.col("p_type")).alias("p_type"))
    path = place(s, "csv")
    p.write.csv(path, header=True, escape='"')
    return S.read_csv_records(s, path)


@query("s10_line_records", "SELECT 'run ' || CAST(event_id AS VARCHAR) || ' ' || event_type AS command FROM events WHERE event_id % 7 <> 0")
def _(s, d):
    line = F.when(F.col("event_id") % 7 == 0, F.lit("   ")).otherwise(F.concat(F.lit("  run "), text("event_id"), F.lit(" "), "event_type", F.lit("  ")))
    return S.read_line_records(s, text_files(s, table(s, d, "events"), line, "history")).select("command")


def logged_events(s, d) -> DataFrame:
    """Events as records of an event log."""
    none = F.lit(None).cast("string")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    system = F.struct(F.col("user_id").alias("EventID"), F.struct(F.struct(stamp.alias("SystemTime")).alias("#attributes")).alias("TimeCreated"), none.alias("Correlation"), F.struct(F.array("event_type", F.lit("b")).alias("#text")).alias("Note.x"))
    event = F.struct(system.alias("System"), F.struct(F.concat(F.lit("e"), text("event_id")).alias("Data"), none.alias("Gone")).alias("EventData"))
    return table(s, d, "events").select("event_id", F.to_json(F.struct(event.alias("Event")), {"ignoreNullFields": "false"}).alias("data"))


@query("s11_normalize_evtx_json", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS \"when\", CAST(user_id AS VARCHAR) AS event_code, 'e' || CAST(event_id AS VARCHAR) AS data_text, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS system_time, event_type || chr(10) || 'b' AS note, false AS has_gone FROM events")
def _(s, d):
    out = logged_events(s, d).select("event_id", variant(JF.normalize_evtx_json(F.col("data"))).alias("v"))
    get = lambda p: get_path("v", p)
    return out.select(
        "event_id", get("@timestamp").alias("when"), get("Event.System.EventID.#text").alias("event_code"), get("Event.EventData.DataText").alias("data_text"),
        get("Event.System.TimeCreated.@SystemTime").alias("system_time"), get("Event.System.Note_x.#text").alias("note"),
        (F.contains(F.to_json("v"), F.lit("Gone")) | F.contains(F.to_json("v"), F.lit("Correlation"))).alias("has_gone"),
    )


@query("s12_flatten_event", "SELECT event_id, CAST(user_id AS VARCHAR) AS event_code, 'e' || CAST(event_id AS VARCHAR) AS data, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS system_time, event_type AS note0, 'b' AS note1 FROM events")
def _(s, d):
    out = logged_events(s, d).select("event_id", JF.flatten_event_map(F.col("data")).alias("m"))
    get = lambda k, n: F.try_element_at("m", F.lit(k)).alias(n)
    return out.select("event_id", get("EventID", "event_code"), get("Data.Data", "data"), get("TimeCreated.SystemTime", "system_time"), get("Note.x0", "note0"), get("Note.x1", "note1"))


@query("s17_iis_config", "SELECT s_name AS site, CAST(s_suppkey AS VARCHAR) AS site_id, 'pool' || CAST(s_nationkey AS VARCHAR) AS pool, v AS virtual_path, 'C:\\' || CAST(s_suppkey AS VARCHAR) AS physical_path FROM supplier, (VALUES ('/'), ('/app/img')) x(v)")
def _(s, d):
    n, pool, disk = text("s_suppkey"), F.concat(F.lit('" applicationPool="pool'), text("s_nationkey"), F.lit('">')), F.concat(F.lit(' physicalPath="C:\\'), text("s_suppkey"), F.lit('"/></application>'))
    line = F.concat(
        F.lit('<site name="'), "s_name", F.lit('" id="'), n, F.lit('"><application path="/'), pool, F.lit('<virtualDirectory path="/"'), disk,
        F.lit('<application path="/app'), pool, F.lit('<virtualDirectory path="/img"'), disk, F.lit("</site>"),
    )
    # a configuration of a whole file for each nation
    sites = table(s, d, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(line), "").alias("sites"))
    path = place(s, "config")
    sites.select("s_nationkey", F.concat(F.lit("<configuration><sites>"), "sites", F.lit("</sites></configuration>")).alias("value")).write.partitionBy("s_nationkey").text(path)
    return S.read_iis_config(s, f"{path}/*/*.txt")


@query("s19_load_indicators", """SELECT DISTINCT kind, value FROM (SELECT 'domain' AS kind, lower(c_mktsegment) || '.example' AS value FROM customer
UNION ALL SELECT 'email', lower(c_name) || '@x.example' FROM customer UNION ALL SELECT 'file_path', '/data/' || c_name FROM customer)""")
def _(s, d):
    def one(kind: str, value: Column) -> Column:
        return F.struct(F.lit("indicator").alias("type"), F.concat(F.lit(f"[{kind} = '"), value, F.lit("']")).alias("pattern"))

    c = table(s, d, "customer")
    objects = F.array(one("domain-name:value", F.concat("c_mktsegment", F.lit(".Example"))), one("email-addr:value", F.concat("c_name", F.lit("@X.example"))), one("file:path", F.concat(F.lit("/data/"), "c_name")), one("other:thing", F.col("c_name")))
    # a bundle of a whole file for each nation
    bundles = c.groupBy("c_nationkey").agg(F.flatten(F.collect_list(objects)).alias("objects")).select("c_nationkey", F.to_json(F.struct("objects")).alias("value"))
    path = place(s, "stix")
    bundles.write.partitionBy("c_nationkey").text(path)
    return I.load_indicators(s, f"{path}/*/*.txt")


@query("k1_write_records", "SELECT data_type, count(*) AS n, (SELECT count(*) FROM events WHERE event_id % 50 <> 0) AS pushed, (SELECT count(*) FROM events WHERE event_id % 50 = 0) AS failed FROM {REC} WHERE event_id % 50 <> 0 GROUP BY 1")
def _(s, d):
    r = event_records(s, d)
    path = place(s, "case")
    # records without data fail
    seen = K.write_records(r.withColumn("data", F.when(F.col("record_id").cast("long") % 50 != 0, F.col("data"))), path)
    return s.read.parquet(path).groupBy("data_type").agg(F.count("*").alias("n")).withColumns({k: F.lit(seen[k]).cast("long") for k in ("pushed", "failed")})


@query("q16_delete_in_store", "SELECT data_type, count(*) AS n, CAST(1 AS BIGINT) AS written FROM {REC} WHERE NOT (data_type = 'error' AND machine = 'M3') GROUP BY 1")
def _(s, d):
    path = place(s, "case")
    K.write_records(event_records(s, d), path)
    written = B.delete_in_store(s, path, (F.col("machine") == "M3") & (F.col("data_type") == "error"))
    return B.read_store(s, path).groupBy("data_type").agg(F.count("*").alias("n")).withColumn("written", F.lit(written).cast("long"))


@query("q17_update_in_store", "SELECT record_id, CASE WHEN event_id % 500 = 7 THEN 'moved' ELSE machine END AS machine FROM {REC}")
def _(s, d):
    path = place(s, "case")
    K.write_records(event_records(s, d), path)
    new = table(s, d, "events").where("event_id % 500 = 7").select(text("event_id").alias("record_id"), F.lit("moved").alias("value"))
    B.update_in_store(s, path, new, "machine")
    return B.read_store(s, path).select("record_id", "machine")


@query("k2_write_jsonl", "SELECT record_id, machine, k FROM {REC}")
def _(s, d):
    path = place(s, "jsonl")
    K.write_jsonl(event_records(s, d).select("record_id", "machine", F.get_json_object("data", "$.props.k").cast("long").alias("k")), path)
    return s.read.schema("record_id string, machine string, k long").json(path)


@query("k3_write_alerts_csv", f"SELECT rule_name, record_id, score, CASE WHEN rule_name = 'ErrorBurst' THEN CAST(k AS VARCHAR) ELSE 'signup' END AS matched FROM {ALERTS}")
def _(s, d):
    path = place(s, "alerts")
    K.write_alerts_csv(D.scan(event_records(s, d), RULES), path)
    got = s.read.csv(path, header=True, escape='"', multiLine=True)
    return got.select("rule_name", "record_id", F.col("score").cast("int").alias("score"), "matched")


@query("k4_export_columns", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name FROM part")
def _(s, d):
    path = place(s, "export")
    K.export_columns(table(s, d, "part"), ["p_partkey", "p_name"], path)
    return s.read.csv(path, header=True, escape='"')


@query("q12_export_all", "SELECT record_id, data_type FROM {REC} WHERE data_type = 'click' OR k = 12")
def _(s, d):
    path = place(s, "result")
    Q.export_all(Q.search(event_records(s, d), Q.field_eq("data_type", "click") | Q.field_eq("Data.props.k", "12")), path)
    return s.read.parquet(path).select("record_id", "data_type")


RULE_TEXT = """
# rules of the events
public ErrorBurst
{
    metadata:
      description: "errors of low keys"
      score: 70
    Channel: "err*"
    include:
      props.k:
        - "1*"
        - "2*"
}
public QuietSignup
{
    metadata:
      description: "sign-ups"
      score: 40
    Channel: signup
    include:
      event_type: "sign*"
    exclude:
      props.k:
        - "5*"
        - "6*"
    modifiers:
      - "event_type $rex sign.p"
}
"""
VIEW_TEXT = """
- name: errors
  sheet: Errors
  condition:
    query: 'data_type:"error" AND Data.props.k:"1*"'
  fields:
    what: "key ${Data.props.k} on ${machine}"
- name: other
  condition: {default: true}
  fields:
    what: "${data_type}"
"""


@query("d14_load_rules", f"SELECT rule_name, record_id, score FROM {ALERTS}")
def _(s, d):
    return D.scan(event_records(s, d), D.load_rules(RULE_TEXT)).select("rule_name", "record_id", "score")


@query("u3_rules_and_views", f"SELECT record_id, rule_name, CASE WHEN rule_name = 'ErrorBurst' AND CAST(k AS VARCHAR) LIKE '1%' THEN 'key ' || CAST(k AS VARCHAR) || ' on ' || machine WHEN rule_name = 'ErrorBurst' THEN 'error' ELSE 'signup' END AS what FROM {ALERTS}")
def _(s, d):
    views = T.load_views(VIEW_TEXT)
    hit = T.select_views(D.matches(event_records(s, d), D.load_rules(RULE_TEXT)).withColumn("rule_name", F.explode("matches.rule_name")), views)
    what = F.coalesce(*[F.when(F.col("view") == v["name"], T.render_template(v["fields"]["what"], Q.field)) for v in views])
    return hit.select("record_id", "rule_name", what.alias("what"))


@query("w1_stream_ingest", "SELECT data_type, count(*) AS n, count(DISTINCT machine) AS machines, true AS chunks_are_bounded FROM {REC} GROUP BY 1")
def _(s, d):
    """Two runs over a growing folder: each file's records are stored once, in bounded chunks."""
    r = event_records(s, d)
    src, dst, state = place(s, "incoming"), place(s, "store"), place(s, "state")
    for k in range(2):
        r.where(F.col("record_id").cast("long") % 2 == k).select(envelope(r).alias("value")).write.mode("append").text(src)
        W.stream_ingest(s, src, dst, state, "case1", chunk=500).awaitTermination()
    got = s.read.parquet(dst)
    size = got.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows")).agg((F.max("rows") <= 500).alias("ok")).first()["ok"]
    return got.groupBy("data_type").agg(F.count("*").alias("n"), F.count_distinct("machine").alias("machines")).withColumn("chunks_are_bounded", F.lit(size))
