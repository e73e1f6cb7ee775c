"""Queries of the search family and of normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark.functions import records as R
from evidence_spark.operators import search as S
from evidence_spark.plans.registry import query, table


def rec(spark, d):
    return R.event_records(spark, d)


@query("q1_field_eq", "SELECT record_id, machine FROM {REC} WHERE k = 69")
def _(s, d):
    return S.search(rec(s, d), S.field_eq("Data.props.k", "69")).select("record_id", "machine")


@query("q2_wildcard", "SELECT record_id, data_type FROM {REC} WHERE lower(data_type) LIKE '%i_w' OR lower(data_type) LIKE 'sign%'")
def _(s, d):
    return S.search(rec(s, d), S.field_like("data_type", "*I?w") | S.field_like("data_type", "sign*")).select("record_id", "data_type")


@query("q2_regex", "SELECT record_id, machine FROM {REC} WHERE regexp_full_match(machine, 'M1[0-3]|M7')")
def _(s, d):
    return S.search(rec(s, d), S.field_regex("machine", "m1[0-3]|m7")).select("record_id", "machine")


@query("q3_any_field", "SELECT record_id FROM {REC} WHERE lower(data_type) = 'm4' OR lower(machine) = 'm4' OR CAST(user_id AS VARCHAR) = 'm4' OR lower(data_type) = 'click'")
def _(s, d):
    where = dict(columns=("data_type", "machine"), paths=("Data.user_id",))
    return S.search(rec(s, d), S.any_field("M4", **where) | S.any_field("CLICK", **where)).select("record_id")


@query("q3_catch_all", "SELECT data_type, count(*) AS n FROM {REC} WHERE CAST(k AS VARCHAR) = '12' OR CAST(user_id AS VARCHAR) = '12' GROUP BY 1")
def _(s, d):
    from evidence_spark.functions.leaves import with_catch_all

    return S.search(with_catch_all(rec(s, d)), S.any_field("12")).groupBy("data_type").agg(F.count("*").alias("n"))


@query("q4_boolean", "SELECT record_id FROM {REC} WHERE (data_type = 'click' OR data_type = 'view') AND NOT (k = 5)")
def _(s, d):
    return S.search(rec(s, d), (S.field_eq("data_type", "click") | S.field_eq("data_type", "View")) & ~S.field_eq("Data.props.k", "5")).select("record_id")


@query("q5_query_string", "SELECT record_id FROM {REC} WHERE data_type = 'click' AND (CAST(k AS VARCHAR) LIKE '1%' OR machine = 'M3') AND NOT user_id = 7")
def _(s, d):
    return S.search(rec(s, d), S.compile_query('data_type:"click" AND (Data.props.k:"1*" OR machine:"M3") AND NOT Data.user_id:"7"')).select("record_id")


@query("q6_project", "SELECT record_id, CAST(k AS VARCHAR) AS k, t AS \"when\" FROM {REC}")
def _(s, d):
    return S.project(rec(s, d), {"record_id": "record_id", "k": "Data.props.k", "when": "Data.@timestamp"})


def places(sorted_records):
    """The place of every record of a sorted table.

    Places are counted within the range partitions of the sort, then shifted by the rows before.
    """
    from pyspark.sql import Window as W

    from evidence_spark.functions.storage import cut

    n = F.monotonically_increasing_id()
    part = cut(sorted_records.select("record_id", F.shiftright(n, 33).alias("part"), n.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    size = part.groupBy("part").agg(F.count("*").alias("rows"))
    before = size.select("part", (F.sum("rows").over(W.orderBy("part")) - F.col("rows")).alias("before"))
    return part.join(F.broadcast(before), "part").select("record_id", (F.col("before") + F.col("at") + 1).alias("place"))


@query("q7_sort", "SELECT record_id, rank() OVER (ORDER BY CAST(k AS VARCHAR) DESC, record_id) AS place FROM {REC}")
def _(s, d):
    return places(S.sort_records(rec(s, d), "Data.props.k", desc=True))


@query("q7_sort_all", "SELECT record_id, rank() OVER (ORDER BY t, record_id) AS place FROM {REC}")
def _(s, d):
    return places(S.sort_records(rec(s, d)))


@query("q8_page", "SELECT record_id, t FROM {REC} ORDER BY t, record_id LIMIT 50 OFFSET 150")
def _(s, d):
    return S.page(rec(s, d), 3, 50).select("record_id", R.get_path("v", "@timestamp").alias("t"))


@query("q8_page_after", "SELECT record_id, t FROM {REC} WHERE t > '2024-01-15T00:00:00.000000' ORDER BY t, record_id LIMIT 50")
def _(s, d):
    return S.page_after(rec(s, d), "2024-01-15T00:00:00.000000", "~", 50).select("record_id", R.get_path("v", "@timestamp").alias("t"))


@query("q8_page_after_nulls", "SELECT record_id FROM (SELECT CAST(event_id AS VARCHAR) AS record_id, CASE WHEN event_id % 2 = 0 THEN t END AS key FROM {REC}) WHERE key IS NULL AND record_id > '5' ORDER BY record_id LIMIT 40")
def _(s, d):
    half = rec(s, d).withColumn("data", F.when(F.col("record_id").cast("long") % 2 == 0, F.col("data")).otherwise(F.lit("{}")))
    return S.page_after(half, None, "5", 40).select("record_id")


@query("q9_top_k", "SELECT record_id, t FROM {REC} ORDER BY t DESC, record_id LIMIT 25")
def _(s, d):
    return S.top_k(rec(s, d), "Data.@timestamp", 25).select("record_id", R.get_path("v", "@timestamp").alias("t"))


@query("q10_page_with_total", "SELECT record_id, (SELECT count(*) FROM events WHERE event_type = 'error') AS total FROM {REC} WHERE data_type = 'error' ORDER BY t, record_id LIMIT 20 OFFSET 20")
def _(s, d):
    return S.page_with_total(S.search(rec(s, d), S.field_eq("data_type", "error")), 1, 20).select("record_id", "total")


@query("q11_multi_search", "SELECT q AS query, count(*) AS n, min(record_id) AS least FROM (SELECT 'low' AS q, record_id FROM {REC} WHERE k = 3 UNION ALL SELECT 'error', record_id FROM {REC} WHERE data_type = 'error' UNION ALL SELECT 'm', record_id FROM {REC} WHERE machine LIKE 'M1%') GROUP BY 1")
def _(s, d):
    preds = {"low": S.field_eq("Data.props.k", "3"), "error": S.field_eq("data_type", "error"), "m": S.field_like("machine", "M1*")}
    return S.multi_search(rec(s, d), preds).groupBy("query").agg(F.count("*").alias("n"), F.min("record_id").alias("least"))


@query("q13_group_count", "SELECT CAST(k AS VARCHAR) AS value, count(*) AS n FROM {REC} GROUP BY 1")
def _(s, d):
    return S.group_count(rec(s, d), "Data.props.k")


def machines(s, d):
    m = rec(s, d).groupBy("machine", "case_id").agg(F.min(F.get_json_object("data", "$['@timestamp']")).alias("creation_time"))
    n = F.substring("machine", 2, 9).cast("int")
    return m.withColumn("groups", F.when(n % 3 == 0, F.array(F.lit("servers"))).otherwise(F.array(F.lit("desks"))))


@query("q14_filter_machines", "SELECT machine, count(*) AS n FROM {REC} WHERE user_id % 20 % 3 = 0 AND machine IN ('M0', 'M1', 'M3', 'M9') GROUP BY 1")
def _(s, d):
    return S.filter_machines(rec(s, d), ["M0", "M1", "M3", "M9"], machines(s, d), "servers").groupBy("machine").agg(F.count("*").alias("n"))


@query("q15_by_id", "SELECT record_id, machine, data_type FROM {REC} WHERE record_id = '42'")
def _(s, d):
    return S.by_id(rec(s, d), "42").select("record_id", "machine", "data_type")


@query("q16_delete_where", "SELECT data_type, count(*) AS n FROM {REC} WHERE NOT (machine = 'M2' OR k < 10) GROUP BY 1")
def _(s, d):
    return S.delete_where(rec(s, d), S.field_eq("machine", "M2") | (S.field("Data.props.k").cast("int") < 10)).groupBy("data_type").agg(F.count("*").alias("n"))


@query("q17_update_field", "SELECT CASE WHEN k = 50 THEN 'changed' ELSE data_type END AS data_type, count(*) AS n FROM {REC} GROUP BY 1")
def _(s, d):
    r = rec(s, d)
    updates = S.parsed(r).where(S.field("Data.props.k") == "50").select("record_id", F.lit("changed").alias("value"))
    return S.update_field(r, updates, "data_type").groupBy("data_type").agg(F.count("*").alias("n"))


@query("q18_add_tags", "SELECT record_id, max_by(tag_type, t) AS tag_type FROM (SELECT record_id, CASE WHEN k % 2 = 0 THEN 'suspicious' ELSE 'legit' END AS tag_type, '2024-01-01' AS t FROM {REC} WHERE data_type = 'error' UNION ALL SELECT record_id, 'malicious', '2024-01-02' FROM {REC} WHERE k = 8) GROUP BY 1")
def _(s, d):
    v = S.parsed(rec(s, d)).select("record_id", "data_type", S.field("Data.props.k").cast("int").alias("k"))
    none = F.lit("").alias("message")
    old = v.where("data_type = 'error'").select("record_id", F.when(F.col("k") % 2 == 0, "suspicious").otherwise("legit").alias("tag_type"), F.lit("2024-01-01").alias("time"), none)
    new = v.where("k = 8").select("record_id", F.lit("malicious").alias("tag_type"), F.lit("2024-01-02").alias("time"), none)
    return S.add_tags(old, new).select("record_id", "tag_type")


@query("q19_case_stats", "SELECT case_id, count(*) AS n FROM (SELECT machine AS case_id FROM {REC}) GROUP BY ROLLUP (case_id)")
def _(s, d):
    return S.case_stats(rec(s, d).withColumn("case_id", F.col("machine")))


SAVED = [("errors", "high", 'data_type:"error"'), ("k7", "low", 'Data.props.k:"7"'), ("both", "medium", 'data_type:"signup" AND Data.props.k:"1*"')]


@query("q20_rule_alerts", "SELECT rule, severity, machine, count(*) AS n FROM (SELECT 'errors' AS rule, 'high' AS severity, machine FROM {REC} WHERE data_type = 'error' UNION ALL SELECT 'k7', 'low', machine FROM {REC} WHERE k = 7 UNION ALL SELECT 'both', 'medium', machine FROM {REC} WHERE data_type = 'signup' AND CAST(k AS VARCHAR) LIKE '1%') GROUP BY 1, 2, 3")
def _(s, d):
    return S.rule_alerts(rec(s, d), SAVED)


@query("q21_assign_group", "SELECT machine, CASE WHEN machine IN ('M1', 'M3') THEN (CASE WHEN user_id % 20 % 3 = 0 THEN 'servers' ELSE 'desks' END) || ',lab' ELSE (CASE WHEN user_id % 20 % 3 = 0 THEN 'servers' ELSE 'desks' END) END AS groups FROM {REC} GROUP BY ALL")
def _(s, d):
    once = S.assign_group(machines(s, d), ["M1", "M3"], "lab")
    return S.assign_group(once, ["M1"], "lab").select("machine", F.array_join("groups", ",").alias("groups"))


@query("q22_list_machines", "SELECT machine, min(t) AS creation_time FROM {REC} GROUP BY 1")
def _(s, d):
    return S.list_machines(machines(s, d), "case1").select("machine", "creation_time")


@query("q23_important_fields", "SELECT CAST(k AS VARCHAR) AS \"Key\", data_type AS \"Kind\", count(*) AS n FROM {REC} GROUP BY 1, 2")
def _(s, d):
    return S.important_fields(rec(s, d), [{"name": "Key", "path": "props.k"}, {"name": "Kind", "path": "event_type"}]).groupBy("Key", "Kind").agg(F.count("*").alias("n"))


@query("q24_manifest_lookup", "SELECT p_partkey, md5(CAST(p_partkey AS VARCHAR))[1:2] || '/' || md5(CAST(p_partkey AS VARCHAR)) AS physical_path FROM part WHERE p_type = 'ECONOMY' AND p_brand = 'Brand#2'")
def _(s, d):
    files = table(s, d, "part").select("p_partkey", F.md5(F.col("p_partkey").cast("string")).alias("file_id"), F.col("p_brand").alias("relative_path"), F.col("p_type").alias("domain"))
    return S.manifest_lookup(files, "Brand#2", "ECONOMY").select("p_partkey", "physical_path")


# -- normalisation -----------------------------------------------------------------------


@query("n1_to_records", "SELECT 'M' || CAST(o_custkey % 7 AS VARCHAR) AS machine, o_orderstatus AS data_type, count(*) AS n, count(DISTINCT o_orderkey) AS ids FROM orders GROUP BY 1, 2")
def _(s, d):
    o = table(s, d, "orders")
    r = R.to_records(o, "c", F.concat(F.lit("M"), (F.col("o_custkey") % 7).cast("string")), "orders", F.col("o_orderstatus"), F.lit("/db"))
    return r.groupBy("machine", "data_type").agg(F.count("*").alias("n"), F.count_distinct("record_id").alias("ids"))


@query("n2_n4_normalize_json", "SELECT record_id, CAST(k AS VARCHAR) AS k, CAST(user_id AS VARCHAR) AS user_id FROM {REC}")
def _(s, d):
    from evidence_spark.functions.jsonfix import normalize_json

    r = rec(s, d).withColumn("data", normalize_json("data"))
    return S.parsed(r).select("record_id", S.field("Data.props.k").alias("k"), S.field("Data.user_id").alias("user_id"))


@query("n5_fix_timestamp", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN replace(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' ', 'T') WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' ELSE '1700-01-01T00:00:00' END AS t FROM events")
def _(s, d):
    e = table(s, d, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    return e.select("event_id", R.fix_timestamp(raw).alias("t"))


@query("n6_split_rejects", "SELECT (event_id % 5 <> 0) AS ok, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    e = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("ts"))
    good, bad = R.split_rejects(e)
    return good.select(F.lit(True).alias("ok")).unionByName(bad.select(F.lit(False).alias("ok"))).groupBy("ok").agg(F.count("*").alias("n"))


@query("n7_repair_conflicts", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props ELSE '{\"value\":\"x\"}' END AS props_obj, CASE WHEN event_id % 2 = 0 THEN 'k=' || CAST(k AS VARCHAR) ELSE 'x' END AS props_text FROM (SELECT event_id, replace(props, ' ', '') AS props, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def _(s, d):
    e = table(s, d, "events")
    data = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"p":'), "props", F.lit("}"))).otherwise(F.lit('{"p":"x"}'))
    e = e.select("event_id", data.alias("data"))
    a = R.repair_conflicts(e, {"p": "object"}).withColumnRenamed("p", "props_obj")
    return R.repair_conflicts(a, {"p": "text"}).select("event_id", "props_obj", F.col("p").alias("props_text"))


@query("n8_get_path", "SELECT record_id, CAST(k AS VARCHAR) AS k, CAST(NULL AS VARCHAR) AS missing, t FROM {REC}")
def _(s, d):
    return S.parsed(rec(s, d)).select("record_id", R.get_path("v", "props.k").alias("k"), R.get_path("v", "props.none.x").alias("missing"), R.get_path("v", "@timestamp").alias("t"))


@query("n9_set_path", "SELECT record_id, machine AS m FROM {REC}")
def _(s, d):
    from evidence_spark.functions.jsonfix import set_path

    r = rec(s, d).withColumn("data", set_path(F.col("data"), "host.name", F.col("machine")))
    return S.parsed(r).select("record_id", R.get_path("v", "host.name").alias("m"))


@query("n10_flatten_leaves", "SELECT path, count(*) AS n, count(DISTINCT value) AS values FROM (SELECT '@timestamp' AS path, t AS value FROM {REC} UNION ALL SELECT 'props.k', CAST(k AS VARCHAR) FROM {REC} UNION ALL SELECT 'value', CAST(value AS VARCHAR) FROM {REC} UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR) FROM {REC} UNION ALL SELECT 'event_type', data_type FROM {REC}) GROUP BY 1")
def _(s, d):
    from evidence_spark.functions.leaves import flatten_leaves

    return flatten_leaves(rec(s, d).select("record_id", "data")).groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("value").alias("values"))


@query("n12_keyword", "SELECT doc_id, CASE WHEN length(text) <= 256 THEN text END AS keyword FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", R.keyword("text").alias("keyword"))


@query("n13_field_catalog", "SELECT * FROM (VALUES ('@timestamp', 'string', true), ('props.k', 'number', false), ('value', 'number', false), ('user_id', 'number', false), ('event_type', 'string', true)) v(path, kind, has_keyword), (SELECT count(*) AS n FROM events)")
def _(s, d):
    from evidence_spark.functions.leaves import field_catalog

    return field_catalog(rec(s, d))


@query("n14_sanitize_case", "SELECT c_custkey, regexp_replace(regexp_replace(lower('__' || c_name || ' ' || c_mktsegment), '[^a-z0-9_]', '', 'g'), '^_+', '') AS name FROM customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", R.sanitize_case(F.concat(F.lit("__"), "c_name", F.lit(" "), "c_mktsegment")).alias("name"))


@query("n15_nulls_to_none", "SELECT doc_id, coalesce(toxic, 'None') AS toxic FROM (SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, CAST(l.toxic AS VARCHAR) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id))")
def _(s, d):
    return R.nulls_to_none(table(s, d, "documents").select("doc_id").join(table(s, d, "labels").select("doc_id", "toxic"), "doc_id", "left"))


@query("n16_split_path", "SELECT p_partkey, 'C:\\' || p_brand AS folder, p_name AS name FROM part")
def _(s, d):
    p = table(s, d, "part").withColumn("path", F.concat(F.lit("C:\\"), "p_brand", F.lit("\\"), "p_name"))
    folder, name = R.split_path("path")
    return p.select("p_partkey", folder.alias("folder"), name.alias("name"))
