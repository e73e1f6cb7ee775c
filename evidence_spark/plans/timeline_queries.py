"""Queries of timelines and of file status."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark.functions.records import event_records
from evidence_spark.operators import status as P
from evidence_spark.operators import timeline as T
from evidence_spark.plans.registry import query, table

DAY = "yyyy-MM-dd"
SQLDAY = "'%Y-%m-%d'"


def modules(s, d):
    o, li, e = table(s, d, "orders"), table(s, d, "lineitem"), table(s, d, "events")
    return [
        T.entries(o, "orders", F.date_format("o_orderdate", DAY), "order", F.format_string("status %s", "o_orderstatus")),
        T.entries(li, "lineitem", F.date_format("l_shipdate", DAY), "ship", F.format_string("flag %s", "l_returnflag")),
        T.entries(e, "events", F.date_format("ts", DAY), F.col("event_type"), F.format_string("user %d", F.col("user_id") % 10)),
    ]


TL = (
    f"(SELECT strftime(o_orderdate, {SQLDAY}) AS timestamp, 'orders' AS module, 'order' AS event, 'status ' || o_orderstatus AS data FROM orders UNION ALL SELECT strftime(l_shipdate, {SQLDAY}), 'lineitem', 'ship', 'flag ' || l_returnflag FROM lineitem "
    f"UNION ALL SELECT strftime(ts, {SQLDAY}), 'events', event_type, 'user ' || CAST(user_id % 10 AS VARCHAR) FROM events)"
)


@query("t1_to_timeline", f"SELECT module, event, count(*) AS n, min(timestamp) AS lo, max(timestamp) AS hi FROM {TL} GROUP BY 1, 2")
def _(s, d):
    return T.to_timeline(modules(s, d)).groupBy("module", "event").agg(F.count("*").alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))


@query("t2_dedup_timeline", f"SELECT DISTINCT * FROM {TL}")
def _(s, d):
    return T.dedup_timeline(T.to_timeline(modules(s, d)))


def shipments(s, d):
    """Up to three times of an order."""
    li = table(s, d, "lineitem")
    g = li.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))
    o = table(s, d, "orders").join(g, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return o.select("o_orderkey", *[F.date_format(c, DAY).alias(k) for c, k in (("o_orderdate", "made"), ("lo", "first"), ("hi", "last"))])


SHIP = f"(SELECT o_orderkey, strftime(o_orderdate, {SQLDAY}) AS made, strftime(lo, {SQLDAY}) AS first, strftime(hi, {SQLDAY}) AS last FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"


@query("t3_multi_time", f"SELECT o_orderkey, made AS ts, 'ordered' AS event FROM {SHIP} WHERE made IS NOT NULL UNION ALL SELECT o_orderkey, first, 'first shipment' FROM {SHIP} WHERE first IS NOT NULL UNION ALL SELECT o_orderkey, last, 'last shipment' FROM {SHIP} WHERE last IS NOT NULL")
def _(s, d):
    return T.multi_time(shipments(s, d), {"made": "ordered", "first": "first shipment", "last": "last shipment"}, ["o_orderkey"])


@query("t4_macb", f"SELECT o_orderkey, ts, (CASE WHEN first = ts THEN 'M' ELSE '-' END) || '-' || (CASE WHEN last = ts THEN 'C' ELSE '-' END) || (CASE WHEN made = ts THEN 'B' ELSE '-' END) AS macb FROM (SELECT DISTINCT o_orderkey, unnest([made, first, last]) AS ts, made, first, last FROM {SHIP}) WHERE ts IS NOT NULL")
def _(s, d):
    return T.macb(shipments(s, d), ["o_orderkey"], "first", None, "last", "made")


@query("t5_distinct_times", f"SELECT o_orderkey, ts, CASE WHEN made = ts THEN 'made' WHEN first = ts THEN 'first' ELSE 'last' END AS field FROM (SELECT DISTINCT o_orderkey, unnest([made, first, last]) AS ts, made, first, last FROM {SHIP}) WHERE ts IS NOT NULL")
def _(s, d):
    return T.distinct_times(shipments(s, d), ["made", "first", "last"], ["o_orderkey"])


@query("t6_wide_timeline", "SELECT user_id AS plugin, k AS item, " + ", ".join(f"max_by(ts, event_id) FILTER (WHERE event_type = '{e}') AS {k}" for e, k in (("signup", "created"), ("purchase", "modified"), ("view", "accessed"), ("click", "changed"))) + " FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS k, strftime(ts, '%Y-%m-%d') AS ts, event_id, event_type FROM events) GROUP BY 1, 2")
def _(s, d):
    kinds = {"signup": "created", "purchase": "modified", "view": "accessed", "click": "changed"}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    e = table(s, d, "events").select(F.col("user_id").alias("plugin"), (F.get_json_object("props", "$.k").cast("long") % 5).alias("item"), F.try_element_at(kind, F.col("event_type")).alias("type"), F.date_format("ts", DAY).alias("ts"), F.col("event_id").alias("seq"))
    return T.wide_timeline(e)


@query("t7_first_last_run", "SELECT user_id, min(t) FILTER (WHERE t <> '1700-01-01T00:00:00') AS first_run, max(t) FILTER (WHERE t <> '1700-01-01T00:00:00') AS last_run FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN '1700-01-01T00:00:00' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS t FROM events) GROUP BY 1")
def _(s, d):
    e = table(s, d, "events")
    t = F.when(F.col("event_type") == "error", F.lit("1700-01-01T00:00:00")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    runs = e.groupBy("user_id").agg(F.collect_list(t).alias("runs"))
    return T.first_last_run(runs, "runs").select("user_id", "first_run", "last_run")


VIEWS = [
    {"name": "errors", "condition": {"query": 'data_type:"error" AND Data.props.k:"1*"'}, "sheet": "Errors", "fields": {"what": "key ${Data.props.k} on ${machine}", "more": "${Data.none}!"}},
    {"name": "signups", "condition": {"query": 'data_type:"signup"'}, "sheet": "Users", "fields": {"what": "user ${Data.user_id}", "more": "-"}},
    {"name": "other", "condition": {"default": True}, "sheet": "Other", "fields": {"what": "${data_type}", "more": ""}},
]


@query("t8_render_view", "SELECT record_id, 'key ' || CAST(k AS VARCHAR) || ' on ' || machine AS what, '!' AS more, 'Errors' AS sheet, 'errors' AS \"view\" FROM {REC} WHERE data_type = 'error'")
def _(s, d):
    return T.render_view(event_records(s, d).where("data_type = 'error'"), VIEWS[0])


@query("t9_select_views", "SELECT record_id, CASE WHEN data_type = 'error' AND CAST(k AS VARCHAR) LIKE '1%' THEN 'errors' WHEN data_type = 'signup' THEN 'signups' ELSE 'other' END AS \"view\" FROM {REC}")
def _(s, d):
    return T.select_views(event_records(s, d), VIEWS).select("record_id", "view")


@query("t10_tagged_timeline", "SELECT record_id, t AS ts, CASE WHEN k % 2 = 0 THEN 'malicious' ELSE 'legit' END AS tag_type, CASE WHEN data_type = 'error' AND CAST(k AS VARCHAR) LIKE '1%' THEN 'Errors' WHEN data_type = 'signup' THEN 'Users' ELSE 'Other' END AS sheet FROM {REC} WHERE k IN (10, 11, 55) AND record_id <> '0' UNION ALL SELECT NULL, '2024-01-10T00:00:00', 'suspicious', NULL")
def _(s, d):
    r = event_records(s, d)
    k = F.get_json_object("data", "$.props.k").cast("int")
    none = F.lit(None).cast("string")
    tags = r.where(k.isin(10, 11, 55)).select("record_id", F.when(k % 2 == 0, "malicious").otherwise("legit").alias("tag_type"), none.alias("time"), none.alias("message"))
    tags = tags.unionByName(s.range(1).select(none.alias("record_id"), F.lit("suspicious").alias("tag_type"), F.lit("2024-01-10T00:00:00").alias("time"), F.lit("analyst's note").alias("message")))
    return T.tagged_timeline(r, tags, VIEWS, ["0"]).select("record_id", "ts", "tag_type", "sheet")


@query("t11_label_value", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#2' THEN 'two' WHEN p_brand LIKE 'Brand#1%' THEN 'ones' ELSE 'Brand' END AS label FROM part")
def _(s, d):
    rules = [{"equal": "Brand#2", "label": "two"}, {"startswith": "Brand#1", "label": "ones"}]
    return table(s, d, "part").select("p_partkey", T.label_value(F.col("p_brand"), rules, "[A-Za-z]+").alias("label"))


# -- file status -------------------------------------------------------------------------

STATUS = (
    "(SELECT 'M' || CAST(o_custkey % 20 AS VARCHAR) AS machine, '/f/' || CAST(o_orderkey // 2 AS VARCHAR) AS file_path, o_orderpriority AS parser_name, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'done' ELSE 'error' END AS status, "
    "strftime(o_orderdate, '%Y-%m-%d') || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS start_time, 't' || CAST(o_custkey % 50 AS VARCHAR) AS task_id, '' AS message, o_orderkey % 97 = 0 AS disabled, o_orderkey FROM orders)"
)


def status(s, d):
    o = table(s, d, "orders")
    text = lambda c: F.col(c).cast("string")
    return o.select(
        F.concat(F.lit("M"), (F.col("o_custkey") % 20).cast("string")).alias("machine"), F.concat(F.lit("/f/"), F.floor(F.col("o_orderkey") / 2).cast("string")).alias("file_path"), F.col("o_orderpriority").alias("parser_name"),
        F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "done").otherwise("error").alias("status"),
        F.concat(F.date_format("o_orderdate", DAY), F.lpad(text("o_orderkey"), 9, "0")).alias("start_time"), F.concat(F.lit("t"), (F.col("o_custkey") % 50).cast("string")).alias("task_id"),
        F.lit("").alias("message"), (F.col("o_orderkey") % 97 == 0).alias("disabled"), "o_orderkey",
    )


@query("f1_pending_files", f"SELECT r.machine, r.file_path, r.parser_name FROM (SELECT DISTINCT machine, file_path, parser_name FROM {STATUS}) r WHERE NOT EXISTS (SELECT 1 FROM {STATUS} s WHERE s.machine = r.machine AND s.file_path = r.file_path AND s.parser_name = r.parser_name AND (s.status IN ('queued', 'done', 'parsing') OR s.disabled))")
def _(s, d):
    st = status(s, d)
    return P.pending_files(st.select(*P.KEY).distinct(), st)


@query("f2_upsert_status", f"SELECT machine, file_path, parser_name, arg_max(status, start_time) AS status FROM {STATUS} GROUP BY 1, 2, 3")
def _(s, d):
    st = status(s, d)
    return P.upsert_status(st.where("o_orderkey % 2 = 0"), st.where("o_orderkey % 2 = 1")).select(*P.KEY, "status")


@query("f2_upsert_in_store", f"SELECT machine, file_path, parser_name, arg_max(status, start_time) AS status FROM {STATUS} GROUP BY 1, 2, 3")
def _(s, d):
    from evidence_spark.plans.io_queries import place
    from evidence_spark.sources import store

    st, path = status(s, d), place(s, "status")
    store.create_status_store(P.upsert_status(st.where("o_orderkey % 2 = 0"), st.where("false")), path)
    store.upsert_in_store(s, path, P.upsert_status(st.where("o_orderkey % 2 = 1"), st.where("false")))
    return store.read_store(s, path, store.STATUS_KEYS).select(*P.KEY, "status")


@query("f3_files_by_status", f"SELECT machine, file_path, parser_name, task_id FROM {STATUS} WHERE status = 'error'")
def _(s, d):
    st = status(s, d).withColumn("file_size", F.lit(1).cast("long"))
    files = st.groupBy("machine", "file_path", "file_size").agg(F.collect_list(F.struct("parser_name", "start_time", "status", "message", "task_id", "disabled")).alias("parsers"))
    nested = files.groupBy("machine").agg(F.collect_list(F.struct("file_path", "file_size", "parsers")).alias("files"))
    return P.files_by_status(nested, ["error"]).select("machine", "file_path", "parser_name", "task_id")


@query("f4_parsing_progress", f"SELECT parser_name, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'parsing') AS parsing, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'error') AS error, count(*) AS total, round(count(*) FILTER (WHERE status IN ('done', 'error')) / count(*), 4) AS progress FROM {STATUS} GROUP BY 1")
def _(s, d):
    return P.parsing_progress(status(s, d))


@query("f5_fail_task", f"SELECT status, message, count(*) AS n FROM (SELECT CASE WHEN task_id = 't7' AND status = 'queued' THEN 'error' ELSE status END AS status, CASE WHEN task_id = 't7' AND status = 'queued' THEN 'lost' ELSE message END AS message FROM {STATUS}) GROUP BY 1, 2")
def _(s, d):
    return P.fail_task(status(s, d), "t7", "lost").groupBy("status", "message").agg(F.count("*").alias("n"))


@query("f6_push_counts", "SELECT machine, data_path, count(*) FILTER (WHERE k > 20) AS pushed, count(*) FILTER (WHERE k <= 20) AS failed FROM {REC} GROUP BY 1, 2")
def _(s, d):
    r = event_records(s, d).withColumn("pushed", F.get_json_object("data", "$.props.k").cast("int") > 20)
    return P.push_counts(r)


@query("f7_set_disabled", f"SELECT disabled, count(*) AS n FROM (SELECT CASE WHEN file_path = '/f/3' AND parser_name = '5-LOW' THEN true ELSE disabled END AS disabled FROM {STATUS}) GROUP BY 1")
def _(s, d):
    return P.set_disabled(status(s, d), "/f/3", "5-LOW", True).groupBy("disabled").agg(F.count("*").alias("n"))
