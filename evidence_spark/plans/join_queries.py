"""Queries of relational reconstruction over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark.operators import reconstruct as J
from evidence_spark.plans.registry import query, table


def items(s, d):
    return table(s, d, "lineitem")


def orders(s, d):
    return table(s, d, "orders")


@query("j1_visit_history", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(s, d):
    visits = items(s, d).select(F.col("l_orderkey").alias("url_id"), "l_linenumber")
    urls = orders(s, d).select(F.col("o_orderkey").alias("id"), "o_custkey")
    return J.visit_history(visits, urls, keys=()).withColumnRenamed("url_id", "l_orderkey")


@query("j2_visit_annotations", "SELECT l.l_orderkey, l.l_linenumber, c.c_name AS host, a.annotations FROM lineitem l LEFT JOIN orders o ON l_orderkey = o_orderkey LEFT JOIN customer c ON o_custkey = c_custkey LEFT JOIN (SELECT o_orderkey, n_name || '=' || o_orderpriority AS annotations FROM orders JOIN nation ON o_custkey % 25 = n_nationkey) a ON a.o_orderkey = l_orderkey")
def _(s, d):
    visits = items(s, d).select(F.col("l_orderkey").alias("place_id"), "l_linenumber")
    places = orders(s, d).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("origin_id"))
    origins = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("host"))
    annos = orders(s, d).select(F.col("o_orderkey").alias("place_id"), (F.col("o_custkey") % 25).cast("int").alias("anno_attribute_id"), F.col("o_orderpriority").alias("content"))
    names = table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    out = J.visit_annotations(visits, places, origins, annos, names, keys=())
    return out.select(F.col("place_id").alias("l_orderkey"), "l_linenumber", "host", F.array_join(F.transform("annotations", lambda a: F.concat_ws("=", a["name"], a["content"])), ",").alias("annotations"))


@query("j3_download_chains", "SELECT o_orderkey, (SELECT string_agg(CAST(l_partkey AS VARCHAR), '>' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) FROM lineitem WHERE l_orderkey = o_orderkey) AS chain FROM orders")
def _(s, d):
    downloads = orders(s, d).select(F.col("o_orderkey").alias("id"))
    chains = items(s, d).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("chain_index"), F.col("l_partkey").cast("string").alias("url"))
    return J.download_chains(downloads, chains, keys=()).select(F.col("id").alias("o_orderkey"), F.array_join("urls", ">").alias("chain"))


@query("j4_visit_terms", "SELECT e.event_id, p.terms, g.segments FROM events e LEFT JOIN (SELECT p_partkey % 100 AS u, string_agg(p_name, ',' ORDER BY p_name) AS terms FROM part WHERE p_partkey % 100 < 50 GROUP BY 1) p ON p.u = e.user_id LEFT JOIN (SELECT s_suppkey AS u, string_agg(s_name, ',' ORDER BY s_name) AS segments FROM supplier GROUP BY 1) g ON g.u = e.user_id")
def _(s, d):
    visits = table(s, d, "events").select("event_id", F.col("user_id").alias("url_id"))
    terms = table(s, d, "part").where("p_partkey % 100 < 50").select((F.col("p_partkey") % 100).alias("url_id"), F.col("p_name").alias("term"))
    segments = table(s, d, "supplier").select(F.col("s_suppkey").alias("url_id"), F.col("s_name").alias("name"))
    return J.visit_terms(visits, terms, segments, keys=()).select("event_id", F.array_join("terms", ",").alias("terms"), F.array_join("segments", ",").alias("segments"))


@query("j5_classify_visits", "SELECT CASE WHEN l_linenumber = 7 THEN 'download' ELSE 'visit' END AS kind, count(*) AS n FROM lineitem GROUP BY 1")
def _(s, d):
    return J.classify_visits(items(s, d), "l_linenumber").groupBy("kind").agg(F.count("*").alias("n"))


@query("j6_messages_with_handle", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(s, d):
    m = orders(s, d).select("o_orderkey", F.col("o_custkey").alias("handle_id"))
    h = table(s, d, "customer").select(F.col("c_custkey").alias("handle_id"), "c_name")
    return J.messages_with_handle(m, h, keys=()).select("o_orderkey", "c_name")


@query("j7_attachments_full", "SELECT p_partkey, l_orderkey, o_orderstatus, c_name FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_linenumber = 7 LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 2 = 0")
def _(s, d):
    a = table(s, d, "part").select(F.col("p_partkey").alias("attachment_id"))
    b = items(s, d).where("l_linenumber = 7").select(F.col("l_partkey").alias("attachment_id"), F.col("l_orderkey").alias("message_id"))
    m = orders(s, d).select(F.col("o_orderkey").alias("message_id"), "o_orderstatus", F.col("o_custkey").alias("handle_id"))
    h = table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("handle_id"), "c_name")
    return J.attachments_full(a, b, m, h, keys=()).select(F.col("attachment_id").alias("p_partkey"), F.col("message_id").alias("l_orderkey"), "o_orderstatus", "c_name")


@query("j8_messages_with_media", "SELECT o_orderkey, l_partkey, event_type FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 1 LEFT JOIN events ON event_id = o_orderkey")
def _(s, d):
    m = orders(s, d).select(F.col("o_orderkey").alias("message_id"))
    media = items(s, d).where("l_linenumber = 1").select(F.col("l_orderkey").alias("message_id"), "l_partkey")
    data = table(s, d, "events").select(F.col("event_id").alias("message_id"), "event_type")
    return J.messages_with_media(m, media, data, keys=()).withColumnRenamed("message_id", "o_orderkey")


@query("j9_interactions_full", "SELECT o_orderkey, a.c_name AS sender_name, p_name, b.c_name AS recipient_name FROM orders LEFT JOIN customer a ON o_custkey = a.c_custkey LEFT JOIN lineitem l ON l.l_orderkey = o_orderkey AND l.l_linenumber = 1 LEFT JOIN part ON l.l_partkey = p_partkey LEFT JOIN lineitem r ON r.l_orderkey = o_orderkey AND r.l_linenumber = 2 LEFT JOIN customer b ON r.l_suppkey = b.c_custkey")
def _(s, d):
    i = orders(s, d).select(F.col("o_orderkey").alias("interaction_id"), F.col("o_custkey").alias("sender_id"))
    c = table(s, d, "customer").select(F.col("c_custkey").alias("contact_id"), F.col("c_name").alias("name"))
    ab = items(s, d).where("l_linenumber = 1").select(F.col("l_orderkey").alias("interaction_id"), F.col("l_partkey").alias("attachment_id"))
    att = table(s, d, "part").select(F.col("p_partkey").alias("attachment_id"), "p_name")
    rb = items(s, d).where("l_linenumber = 2").select(F.col("l_orderkey").alias("interaction_id"), F.col("l_suppkey").alias("recipient_id"))
    return J.interactions_full(i, c, ab, att, rb, keys=()).select(F.col("interaction_id").alias("o_orderkey"), "sender_name", "p_name", "recipient_name")


@query("j10_conversation_messages", "SELECT l_orderkey, l_linenumber, p_name, s_name, CASE WHEN s_suppkey % 10 = 0 THEN 2 ELSE 1 END AS incoming, n AS n_members FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) ON k = l_orderkey")
def _(s, d):
    m = items(s, d).select(F.col("l_orderkey").alias("conversation_id"), "l_linenumber", F.col("l_partkey").alias("message_id"), F.col("l_suppkey").alias("sender_id"))
    c = orders(s, d).select(F.col("o_orderkey").alias("conversation_id"))
    p = table(s, d, "part").select(F.col("p_partkey").alias("message_id"), "p_name")
    who = table(s, d, "supplier").select(F.col("s_suppkey").alias("participant_id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 10 == 0, -1).otherwise(F.col("s_suppkey")).alias("contact_id"))
    members = items(s, d).select(F.col("l_orderkey").alias("conversation_id"))
    out = J.conversation_messages(m, c, p, who, members, keys=())
    return out.select(F.col("conversation_id").alias("l_orderkey"), "l_linenumber", "p_name", F.col("sender_name").alias("s_name"), "incoming", "n_members")


@query("j11_usage_with_process", "SELECT DISTINCT o_custkey AS k, o_orderstatus, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 <> 0 UNION SELECT c_custkey, NULL, c_name FROM customer WHERE c_custkey % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(s, d):
    usage = orders(s, d).select(F.col("o_custkey").alias("k"), "o_orderstatus")
    procs = table(s, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), "c_name")
    return J.usage_with_process(usage, procs, "k", keys=())


@query("j12_usage_enriched", "SELECT l_orderkey, l_linenumber, a.p_name AS app_name, u.p_name AS user_name FROM lineitem JOIN part a ON l_partkey = a.p_partkey AND a.p_size < 25 LEFT JOIN part u ON l_suppkey = u.p_partkey AND u.p_size < 25")
def _(s, d):
    usage = items(s, d).select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("app_id"), F.col("l_suppkey").alias("user_id"))
    ids = table(s, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("id_index"), F.col("p_name").alias("id_name"))
    return J.usage_enriched(usage, ids).select("l_orderkey", "l_linenumber", "app_name", "user_name")


@query("j13_client_access", "SELECT o_orderkey, coalesce(h, 'No Match') AS hosts, coalesce(n_name, 'No Match') AS role_name FROM orders LEFT JOIN (SELECT c_nationkey * 61 AS a, string_agg(DISTINCT c_name, ',' ORDER BY c_name) AS h FROM customer GROUP BY 1) ON a = o_custkey LEFT JOIN nation ON n_nationkey = o_custkey % 40")
def _(s, d):
    clients = orders(s, d).select("o_orderkey", F.col("o_custkey").alias("address"), (F.col("o_custkey") % 40).cast("int").alias("role_guid"))
    dns = table(s, d, "customer").select((F.col("c_nationkey") * 61).cast("long").alias("address"), F.col("c_name").alias("hostname"))
    roles = table(s, d, "nation").select(F.col("n_nationkey").alias("role_guid"), F.col("n_name").alias("role_name"))
    return J.client_access(clients, dns, roles).select("o_orderkey", F.array_join("hostnames", ",").alias("hosts"), "role_name")


@query("j14_daily_counts", "SELECT p_partkey, 'Day' || CAST(n AS VARCHAR) AS \"day\", v AS n, strftime(make_date(2023, 1, 1) + CAST(n - 1 AS INTEGER), '%Y-%m-%d') AS date FROM (SELECT p_partkey, 1 AS n, p_size % 3 AS v FROM part UNION ALL SELECT p_partkey, 32, p_size % 5 FROM part UNION ALL SELECT p_partkey, 200, p_size % 7 FROM part) WHERE v > 0")
def _(s, d):
    p = table(s, d, "part").select("p_partkey", F.lit(2023).alias("year"), (F.col("p_size") % 3).alias("Day1"), (F.col("p_size") % 5).alias("Day32"), (F.col("p_size") % 7).alias("Day200"))
    return J.daily_counts(p, ["p_partkey"], ["Day1", "Day32", "Day200"], "year").select("p_partkey", "day", "n", F.col("date").cast("string").alias("date"))


@query("j15_persistence", "SELECT DISTINCT l_partkey AS consumer_name, l_suppkey AS filter_name, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def _(s, d):
    b = items(s, d).select(F.col("l_partkey").alias("consumer_name"), F.col("l_suppkey").alias("filter_name"))
    return J.persistence_bindings(b, table(s, d, "part").select(F.col("p_partkey").alias("consumer_name"), "p_name"), table(s, d, "supplier").select(F.col("s_suppkey").alias("filter_name"), "s_name"))


TREE = "WITH RECURSIVE t(n, depth, path) AS (SELECT p_partkey, 0, {0} FROM part WHERE p_partkey = 0 UNION ALL SELECT p_partkey, depth + 1, path || {2} || {1} FROM part, t WHERE p_partkey // 2 = n AND p_partkey <> 0) SELECT n AS p_partkey, depth, path FROM t"


@query("j16_process_tree", TREE.format("lpad(CAST(p_partkey AS VARCHAR), 12, '0')", "lpad(CAST(p_partkey AS VARCHAR), 12, '0')", "'/'"))
def _(s, d):
    p = table(s, d, "part").select("p_partkey", F.floor(F.col("p_partkey") / 2).alias("up"))
    return J.process_tree(p, "p_partkey", "up", keys=())


@query("j17_folder_paths", TREE.format("p_name", "p_name", "'\\'"))
def _(s, d):
    p = table(s, d, "part").select("p_partkey", F.floor(F.col("p_partkey") / 2).alias("up"), "p_name")
    return J.folder_paths(p, "p_partkey", "up", "p_name", keys=())


@query("j18_pair_requests", """
WITH e AS (SELECT user_id, event_id, event_type = 'view' AS rq, sum(CASE WHEN event_type = 'view' THEN 1 ELSE -1 END) OVER w AS b FROM events WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT r.event_id AS response, max(q.event_id) AS request FROM e r JOIN e q ON q.user_id = r.user_id AND q.rq AND q.event_id < r.event_id AND q.b = r.b + 1 WHERE NOT r.rq
AND NOT EXISTS (SELECT 1 FROM e m WHERE m.user_id = r.user_id AND m.event_id > q.event_id AND m.event_id < r.event_id AND m.b <= r.b) GROUP BY 1""")
def _(s, d):
    e = table(s, d, "events").where("event_type in ('view', 'click')").select("user_id", "event_id", (F.col("event_type") == "view").alias("is_request"))
    out = J.pair_requests(e, ["user_id"], ["event_id"])
    return out.select(F.col("event_id").alias("response"), F.col("request_event_id").alias("request"))


@query("j20_icon_joins", "SELECT l_orderkey, l_linenumber, p_name, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
def _(s, d):
    m = items(s, d).select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("icon_id"))
    p = table(s, d, "part")
    return J.icon_joins(m, p.select(F.col("p_partkey").alias("icon_id"), "p_name"), p.select(F.col("p_partkey").alias("icon_id"), "p_brand"), keys=()).drop("icon_id")


@query("j21_union_events", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS ts, 'order' AS kind FROM orders UNION SELECT DISTINCT strftime(l_shipdate, '%Y-%m-%d'), 'ship' FROM lineitem")
def _(s, d):
    a = orders(s, d).select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("ts"), F.lit("order").alias("kind"))
    b = items(s, d).select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("ts"), F.lit("ship").alias("kind"))
    return J.union_events(a, b)


@query("j22_parallel_lists", "SELECT o_orderkey, o_custkey AS a, o_orderstatus AS b FROM orders UNION ALL SELECT o_orderkey, 7, o_orderpriority FROM orders")
def _(s, d):
    o = orders(s, d).select("o_orderkey", F.array(F.col("o_custkey"), F.lit(7).cast("long")).alias("a"), F.array("o_orderstatus", "o_orderpriority").alias("b"))
    return J.split_parallel_lists(o, "a", "b")


@query("j23_person_values", "SELECT c_custkey, o_orderpriority AS value FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'")
def _(s, d):
    v = orders(s, d).select(F.col("o_custkey").alias("person_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("value"))
    return J.person_values(table(s, d, "customer").select(F.col("c_custkey").alias("person_id")), v, keys=()).withColumnRenamed("person_id", "c_custkey")


@query("j24_pivot_variables", "SELECT user_id, max(CASE WHEN event_type = 'click' THEN event_id END) AS click, max(CASE WHEN event_type = 'view' THEN event_id END) AS \"view\" FROM events GROUP BY 1")
def _(s, d):
    e = table(s, d, "events").select("user_id", F.col("event_type").alias("variable"), F.col("event_id").alias("value"))
    return J.pivot_variables(e, ["click", "view"], keys=["user_id"])


@query("j25_promote_children", "SELECT l_orderkey, l_partkey FROM lineitem")
def _(s, d):
    o = items(s, d).groupBy("l_orderkey").agg(F.collect_list(F.struct("l_orderkey", "l_partkey")).alias("children"))
    return J.promote_children(o, "children")
