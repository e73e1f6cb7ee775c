"""Queries of detection rules."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from evidence_spark.functions.records import event_records, get_path, variant
from evidence_spark.operators import rules as D
from evidence_spark.plans.registry import query, table


def parts(s, d):
    """The part table as records."""
    p = table(s, d, "part")
    data = F.to_json(F.struct(F.lit("2024-01-01T00:00:00").alias("@timestamp"), F.struct("p_name", "p_type", "p_brand", "p_size").alias("Part")))
    return p.select(F.col("p_partkey").cast("string").alias("record_id"), F.lit("c").alias("case_id"), F.concat(F.lit("M"), (F.col("p_partkey") % 5).cast("string")).alias("machine"), F.lit("Parts").alias("data_type"), data.alias("data")).withColumn("v", variant("data"))


RULES = [
    D.Rule("ErrorBurst", channel="err*", include={"props.k": ["1*", "2*"]}, score=70, description="errors of low keys"),
    D.Rule("QuietSignup", channel="signup", include={"event_type": "sign*"}, exclude={"props.k": ["5*", "6*"]}, score=40, description="sign-ups"),
    D.Rule("Lost", include={"missing.path": "*"}, description="never"),
]
#: The rules above as conditions over the events' SQL records.
SQL = {
    "ErrorBurst": "data_type LIKE 'err%' AND (CAST(k AS VARCHAR) LIKE '1%' OR CAST(k AS VARCHAR) LIKE '2%')",
    "QuietSignup": "data_type = 'signup' AND NOT (CAST(k AS VARCHAR) LIKE '5%' OR CAST(k AS VARCHAR) LIKE '6%')",
}
ALERTS = f"(SELECT 'ErrorBurst' AS rule_name, 70 AS score, machine, record_id, k FROM {{REC}} WHERE {SQL['ErrorBurst']} UNION ALL SELECT 'QuietSignup', 40, machine, record_id, k FROM {{REC}} WHERE {SQL['QuietSignup']})"


def flagship(spark, sf_dir):
    """Alerts per rule and machine."""
    return D.scan(event_records(spark, sf_dir), RULES).groupBy("rule_name", "machine").agg(F.count("*").alias("n"), F.max("score").alias("score"))


query("flagship_alert_counts", f"SELECT rule_name, machine, count(*) AS n, max(score) AS score FROM {ALERTS} GROUP BY 1, 2")(flagship)


@query("d1_glob", "SELECT p_partkey FROM (SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, lower(p_name) AS n FROM part) WHERE regexp_full_match(n, '.*r[aei]d.*') OR n LIKE 'small%' OR n LIKE '%t' OR n LIKE '_lue%'")
def _(s, d):
    n = get_path("v", "Part.p_name")
    hit = D.glob_match(n, "*R[aei]d*") | D.glob_match(n, "small*") | D.glob_match(n, "*T") | D.glob_match(n, "?lue*")
    return parts(s, d).where(hit).select(F.col("record_id").alias("p_partkey"))


@query("d2_include", "SELECT CAST(p_partkey AS VARCHAR) AS record_id FROM part WHERE lower(p_type) = 'economy' AND (lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE 'red%')")
def _(s, d):
    return parts(s, d).where(D.include_clause(D.Rule("r", include={"Part.p_type": "Economy", "Part.p_name": ["*ring*", "red*"]}))).select("record_id")


@query("d3_exclude", "SELECT CAST(p_partkey AS VARCHAR) AS record_id FROM part WHERE p_brand <> 'Brand#2' AND NOT (lower(p_type) LIKE 'eco%' OR lower(p_type) LIKE 'sta%')")
def _(s, d):
    return parts(s, d).where(D.exclude_clause(D.Rule("r", exclude={"Part.p_brand": "brand#2", "Part.none": "x", "Part.p_type": ["eco*", "sta*"]}))).select("record_id")


@query("d3_exclude_list_missing", "SELECT count(*) AS n FROM part WHERE false")
def _(s, d):
    return parts(s, d).where(D.exclude_clause(D.Rule("r", exclude={"Part.none": ["x", "y"]}))).agg(F.count("*").alias("n"))


@query("d4_length", "SELECT CAST(p_partkey AS VARCHAR) AS record_id FROM part WHERE length(p_name) > 9 AND length(p_brand) <= 7")
def _(s, d):
    return parts(s, d).where(D.modifier_clause(D.Rule("r", modifiers=["Part.p_name > 9", "Part.p_brand <= 7"]))).select("record_id")


@query("d5_regex", "SELECT CAST(p_partkey AS VARCHAR) AS record_id FROM part WHERE regexp_full_match(p_name, '[a-z]+ (ring|widget)')")
def _(s, d):
    return parts(s, d).where(D.regex_check(get_path("v", "Part.p_name"), "[a-z]+ (ring|widget)")).select("record_id")


@query("d6_record_search", "SELECT CAST(p_partkey AS VARCHAR) AS record_id FROM part WHERE regexp_matches(p_name, 'red|ring') AND lower(p_brand) = 'brand#17'")
def _(s, d):
    return parts(s, d).where(D.record_search("$rex", "red|ring") & D.record_search("$str", '*brand#17"*')).select("record_id")


@query("d6_search_anchored", "SELECT CAST(p_partkey AS VARCHAR) AS record_id FROM part WHERE p_size = 7 OR lower(p_brand) = 'brand#3'")
def _(s, d):
    # without stars a pattern must be the whole text: the second alone finds nothing
    hit = D.record_search("$str", '*"p_size":7}}') | D.record_search("$str", 'brand#17"') | D.record_search("$str", "$WHICH", variables={"WHICH": 'BRAND#3"'})
    return parts(s, d).where(hit).select("record_id")


@query("d7_variables", "SELECT CAST(p_partkey AS VARCHAR) AS record_id FROM part WHERE p_brand IN ('Brand#2', 'Brand#9') OR lower(p_type) LIKE '%rom%' OR lower(p_name) LIKE '%d r_ng%'")
def _(s, d):
    known = {"BRANDS": ["brand#2", "BRAND#9"], "KIND": "Rom", "NAME": "d r?ng"}  # one value is contained, a list has the whole value
    hit = D.variable_match(get_path("v", "Part.p_brand"), "BRANDS", known) | D.variable_match(get_path("v", "Part.p_type"), "KIND", known) | D.variable_match(get_path("v", "Part.p_name"), "NAME", known)
    return parts(s, d).where(hit).select("record_id")


@query("d7_field_reference", "SELECT CAST(p_partkey AS VARCHAR) AS record_id FROM part WHERE contains('x' || CAST(p_size AS VARCHAR) || p_brand, CAST(p_size AS VARCHAR))")
def _(s, d):
    whole = F.concat(F.lit("x"), get_path("v", "Part.p_size"), get_path("v", "Part.p_brand"))
    return parts(s, d).where(D.variable_match(whole, "Part.p_size", {})).select("record_id")


@query("d8_channel", "SELECT record_id FROM {REC} WHERE data_type LIKE '%i%'")
def _(s, d):
    return event_records(s, d).where(D.channel_clause(D.Rule("r", channel="*I*"))).select("record_id")


@query("d9_scan", f"SELECT rule_name, record_id, machine, score, CASE WHEN rule_name = 'ErrorBurst' THEN CAST(k AS VARCHAR) ELSE 'signup' END AS matched FROM {ALERTS}")
def _(s, d):
    return D.scan(event_records(s, d), RULES).select("rule_name", "record_id", "machine", "score", F.array_join("matched", ",").alias("matched"))


@query("d10_annotate", f"SELECT record_id, CASE WHEN {SQL['QuietSignup']} THEN 'QuietSignup' WHEN {SQL['ErrorBurst']} THEN 'ErrorBurst' END AS rule_name FROM {{REC}}")
def _(s, d):
    return D.annotate(event_records(s, d), RULES).select("record_id", F.col("rule_match.rule_name").alias("rule_name"))


@query("d11_returns", f"SELECT record_id, '{{\"props_k\":\"' || CAST(k AS VARCHAR) || '\"}}' AS returned FROM {ALERTS} WHERE rule_name = 'ErrorBurst'")
def _(s, d):
    rule = D.Rule(**{**RULES[0].__dict__, "returns": ["props.k"]})
    return D.scan(event_records(s, d), [rule]).select("record_id", "returned")


PAIR = D.Rule("SignupThenError", calls=["S", "E"], within=60_000, score=90, description="a sign-up next to an error")
PRIVATE = {"S": D.Rule("S", False, channel="signup", include={"event_type": "signup"}), "E": D.Rule("E", False, channel="error", include={"event_type": "error"})}


@query("d12_correlate", "SELECT a.record_id AS s, b.record_id AS e FROM {REC} a JOIN {REC} b ON a.data_type = 'signup' AND b.data_type = 'error' AND abs(epoch_ms(a.ts) - epoch_ms(b.ts)) < 60000")
def _(s, d):
    return D.correlate(event_records(s, d), PAIR, PRIVATE).select(F.col("record_ids")[0].alias("s"), F.col("record_ids")[1].alias("e"))


@query("d12_correlate_keyed", "SELECT a.machine, a.record_id AS s, b.record_id AS e FROM {REC} a JOIN {REC} b ON a.machine = b.machine AND a.data_type = 'signup' AND b.data_type = 'error' AND abs(epoch_ms(a.ts) - epoch_ms(b.ts)) < 600000")
def _(s, d):
    return D.correlate(event_records(s, d), PAIR, PRIVATE, 600_000, ["machine"]).select("machine", F.col("record_ids")[0].alias("s"), F.col("record_ids")[1].alias("e"))


@query("d12_alert_content", "SELECT a.machine, a.record_id AS s, b.record_id AS e, c.record_id AS v, 'three in a row' AS description, 'ref:1' AS reference, '{\"props_k\":\"' || CAST(a.k AS VARCHAR) || '\"}' AS of_s, '{\"user_id\":\"' || CAST(b.user_id AS VARCHAR) || '\"}' AS of_e, strftime(least(a.ts, b.ts, c.ts), '%Y-%m-%d %H:%M:%S') AS first FROM {REC} a JOIN {REC} b ON a.machine = b.machine AND a.data_type = 'signup' AND b.data_type = 'error' JOIN {REC} c ON c.machine = a.machine AND c.data_type = 'view' WHERE epoch_ms(greatest(a.ts, b.ts, c.ts)) - epoch_ms(least(a.ts, b.ts, c.ts)) < 900000")
def _(s, d):
    triple = D.Rule("Triple", calls=["S", "E", "V"], within=900_000, description="three in a row", reference="ref:1")
    private = {"S": replace(PRIVATE["S"], returns=["props.k"]), "E": replace(PRIVATE["E"], returns=["user_id"]), "V": D.Rule("V", False, channel="view", include={"event_type": "view"})}
    out = D.correlate(event_records(s, d), triple, private, keys=["machine"], time_format="yyyy-MM-dd HH:mm:ss")
    ids = [F.col("record_ids")[i].alias(c) for i, c in enumerate("sev")]
    return out.select("machine", *ids, "description", "reference", F.col("returned")["S"].alias("of_s"), F.col("returned")["E"].alias("of_e"), F.col("ts_text").alias("first"))


@query("d13_calls_private", "SELECT record_id FROM {REC} WHERE data_type = 'error' AND k = 4")
def _(s, d):
    four = D.Rule("Four", False, include={"props.k": "4"})
    both = D.Rule("Both", calls=["E", "Four"], include={"event_type": "*"}, description="x")
    return D.scan(event_records(s, d), [PRIVATE["E"], four, both]).select("record_id")


@query("d15_alert_summary", f"SELECT rule_name, machine, count(*) AS n, max(score) AS score, CAST(grouping_id(rule_name, machine) AS BIGINT) AS level FROM {ALERTS} GROUP BY CUBE (rule_name, machine)")
def _(s, d):
    return D.alert_summary(D.scan(event_records(s, d), RULES))
