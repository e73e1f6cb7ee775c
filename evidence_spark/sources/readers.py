"""Readers and parsers of log and artifact text.

Readers return a row per record with ``path`` (the file) where it matters. Text is read in
splits: a line's place in its file is the start of its split and its number there, so the
order of lines is known without holding a file in one task.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from evidence_spark.functions.convert import LOGON_CODES, code_label, filetime_to_ts
from evidence_spark.functions.records import SENTINEL

BOM = "﻿"
#: Lines that are looked through at once where their place is a number.
BLOCK_LINES = 100_000
#: Quotes of a line beyond which a helper splits it.
QUOTES = 256
_RUNS = re.compile(r'"+|,|[^",]+')
#: Routing rules that may be broadcast.
BROADCAST_RULES = 10_000


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines with file ``path`` and ``pos`` (sortable within a file)."""
    raw = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_b"))
    return raw.select("path", F.struct(F.col("_b").alias("block"), F.monotonically_increasing_id().alias("row")).alias("pos"), "line")


def route_files(files: DataFrame, parsers: DataFrame) -> DataFrame:
    """File and parser pairs by the parsers' routing rules.

    ``files`` has path and content (its first bytes); ``parsers`` has parser_name,
    categorization_type (extension, regex, file_name, startswith, magic_number) and
    categorization_values (separated by commas). Names, extensions, starts and magic numbers
    are joined by equality: a file has a key for each length that such rules have. Only
    regular expressions are tried one by one.
    """
    base = F.substring_index(F.regexp_replace("path", r"\\", "/"), "/", -1)
    rules = parsers.select("parser_name", F.col("categorization_type").alias("_kind"), F.explode(F.transform(F.split("categorization_values", ","), lambda x: F.trim(x))).alias("_v")).where("_v <> ''")
    magic = F.lower(F.replace("_v", F.lit(" "), F.lit("")))
    keyed = rules.where("_kind in ('extension', 'file_name', 'startswith', 'magic_number')").withColumn("_v", F.when(F.col("_kind") == "magic_number", magic).otherwise(F.col("_v")))
    lengths = {r[0]: sorted(r[1]) for r in keyed.groupBy("_kind").agg(F.collect_set(F.length("_v"))).collect()}  # as many as the longest value has characters
    hexed = F.lower(F.hex(F.substring("content", 1, (max(lengths.get("magic_number", [0])) + 1) // 2)))

    def keys(kind: str) -> Column:
        text = hexed if kind == "magic_number" else base
        part = (lambda n: F.substring(text, F.length(text) - n + 1, n)) if kind == "extension" else (lambda n: F.substring(text, F.lit(1), n))
        each = F.array(base) if kind == "file_name" else F.transform(F.filter(F.array(*[F.lit(n) for n in lengths[kind]]), lambda n: n <= F.length(text)), part)
        return F.transform(each, lambda k: F.struct(F.lit(kind).alias("_kind"), k.alias("_v")))

    few = lambda df: F.broadcast(df) if df.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else df
    out = []
    if lengths:
        every = F.concat(*[F.coalesce(keys(k), F.array().cast("array<struct<_kind:string,_v:string>>")) for k in sorted(lengths)])
        out.append(files.select("path", F.explode(every).alias("_k")).select("path", "_k.*").join(few(keyed), ["_kind", "_v"]))
    regex = rules.where("_kind = 'regex'")
    if not regex.isEmpty():
        out.append(files.select("path").join(few(regex), F.regexp(base, F.concat(F.lit("^"), F.col("_v"), F.lit("$")))))
    if not out:
        return files.select("path", F.lit("").alias("parser_name")).where("false")
    return reduce(DataFrame.unionByName, [x.select("path", "parser_name") for x in out]).distinct()


def read_kjson(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes, one to a line; ``bad`` marks lines that are none."""
    schema = "Data string, data_source string, data_type string, data_path string, machine string"
    lines = read_lines(spark, path).where("trim(line) <> ''")
    ok = F.try_parse_json("line")
    got = F.from_json("line", schema)
    out = lines.select("path", "line", got.alias("r"), (ok.isNull() | F.schema_of_variant(ok).startswith("OBJECT").__invert__()).alias("bad"))
    return out.select("path", F.when(~F.col("bad"), F.col("r.Data")).alias("data"), "r.data_source", "r.data_type", "r.data_path", "r.machine", F.coalesce("bad", F.lit(True)).alias("bad"), F.when(F.col("bad"), F.col("line")).alias("reject"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Plain JSON lines; the channel is the file's path (S3)."""
    lines = read_lines(spark, path).where("trim(line) <> ''")
    bad = F.try_parse_json("line").isNull()
    return lines.select("path", F.col("path").alias("data_type"), F.when(~bad, F.col("line")).alias("data"), bad.alias("bad"))


def read_csv_records(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header; missing cells of short rows are empty."""
    df = spark.read.csv(path, header=True, mode="PERMISSIVE", quote='"', escape='"')
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def _with_header(lines: DataFrame) -> DataFrame:
    """Lines that are no comment with the names of the last ``#Fields:`` line before them.

    Headers are few: they meet the lines of their file as a sorted array, so no file has
    to pass through one task.
    """
    head = lines.where(F.col("line").startswith("#Fields:") | F.col("line").startswith(BOM + "#Fields:"))
    per = head.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", F.trim(F.regexp_replace("line", "^﻿?#Fields:", "")).alias("names")))).alias("_h"))
    body = lines.where("line <> '' and not line like '#%' and not line like '﻿#%'").join(per, "path")
    before = F.filter("_h", lambda h: h["pos"] < F.col("pos"))
    return body.withColumn("_names", F.try_element_at(before, F.lit(-1))["names"]).where("_names is not null").drop("_h")


def _named(names: Column, values: Column) -> Column:
    """Map of names and values. Values beyond the names are ``field3``, … by their place from 0; of a name given twice the last value holds."""
    n, m = F.size(names), F.size(values)
    more = F.when(m > n, F.transform(F.sequence(n, m - 1), lambda i: F.concat(F.lit("field"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    keys = F.slice(F.concat(names, more), F.lit(1), m)
    own = F.slice(values, F.lit(1), F.size(keys))
    once = F.array_distinct(keys)
    last = F.transform(once, lambda k: F.element_at(F.reverse(own), F.array_position(F.reverse(keys), k).cast("int")))
    return F.map_from_arrays(once, F.when(F.size(once) == F.size(keys), own).otherwise(last))


def read_w3c_log(spark: SparkSession, path: str) -> DataFrame:
    """W3C log rows: path, pos, ``@timestamp`` and the map ``fields``."""
    return parse_w3c(read_lines(spark, path))


def parse_w3c(lines: DataFrame) -> DataFrame:
    """W3C log rows of lines with path and pos."""
    rows = _with_header(lines)
    clean = F.transform(F.split("_names", " +"), lambda x: F.lower(F.regexp_replace(F.regexp_replace(x, r"[-(]", "_"), r"\)", "")))
    out = rows.withColumn("fields", _named(clean, F.split(F.trim("line"), " ")))
    ts = F.concat_ws("T", F.try_element_at("fields", F.lit("date")), F.try_element_at("fields", F.lit("time")))
    return out.select("path", "pos", F.when(F.length(ts) > 0, ts).otherwise(SENTINEL).alias("@timestamp"), "fields")


def _cells(line: str) -> list[str]:
    """Cells of a line by one walk over its quotes; see :func:`split_csv`."""
    cells, elem, inside, quoted = [], [], False, False
    for run in _RUNS.findall(line):
        if run[0] == '"':
            for _ in run:
                if quoted and any(elem):
                    elem.append('"')
                    quoted = False
                else:
                    inside, quoted = not inside, True
            continue
        quoted = False
        if run == "," and not inside:
            cells.append("".join(elem))
            elem = []
        else:
            elem.append(run)
    return [*cells, "".join(elem)]


def split_csv(line: Column) -> Column:
    """Cells of a line, with quotes anywhere in a cell, as the logs' own reader splits it.

    A quote opens or closes a quoted stretch, in which commas do not split; the second of
    two quotes in a row is a quote itself where the cell has text already. Lines are taken
    apart at their quotes, with no pattern that recurses, so cells may be of any length;
    lines of more than QUOTES quotes go to a helper on Arrow batches.
    """
    parts = F.split(line, '"')
    state = F.struct(F.array().cast("array<string>").alias("cells"), F.lit("").alias("elem"), F.lit(True).alias("inside"), F.lit(False).alias("quoted"))

    def step(a: Column, part: Column) -> Column:
        # the first part follows no quote: it starts inside out, and its "quote" opens the line
        double = a["quoted"] & (F.length(a["elem"]) > 0)
        elem = F.when(double, F.concat(a["elem"], F.lit('"'))).otherwise(a["elem"])
        inside = F.when(double, a["inside"]).otherwise(~a["inside"])
        quoted = ~double & (F.length(part) == 0)
        pieces = F.split(part, ",")
        n = F.when(inside, F.lit(1)).otherwise(F.size(pieces))
        first = F.concat(elem, F.when(inside, part).otherwise(pieces[0]))
        return F.struct(
            F.when(n > 1, F.concat(a["cells"], F.array(first), F.slice(pieces, F.lit(2), F.greatest(n - 2, F.lit(0))))).otherwise(a["cells"]).alias("cells"),
            F.when(n > 1, F.element_at(pieces, F.lit(-1))).otherwise(first).alias("elem"), inside.alias("inside"), quoted.alias("quoted"),
        )

    few = F.aggregate(parts, state, step, lambda a: F.concat(a["cells"], F.array(a["elem"])))
    many = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit(""))) > QUOTES
    helper = F.arrow_udf(lambda lines: pa.array([None if t is None else _cells(t) for t in lines.to_pylist()], pa.list_(pa.string())), "array<string>")
    return F.when(many, helper(F.when(many, line))).when(F.contains(line, F.lit('"')), few).otherwise(F.split(line, ","))


def read_exchange_log(spark: SparkSession, path: str) -> DataFrame:
    """Mail server log rows (S6): timestamp of DateTime, or TimeStamp where that is given."""
    return parse_exchange(read_lines(spark, path))


def parse_exchange(lines: DataFrame) -> DataFrame:
    """Mail server log rows of lines with path and pos."""
    rows = _with_header(lines)
    names = F.transform(F.split("_names", ","), lambda x: F.trim(x))
    # an explode of one is a step that the filter is not copied through: a line is split once
    out = rows.select("path", "pos", F.explode(F.array(F.struct(names.alias("names"), split_csv(F.col("line")).alias("cells")))).alias("_x"))
    out = out.select("path", "pos", F.explode(F.array(_named(F.col("_x.names"), F.col("_x.cells")))).alias("fields"))
    none = lambda k: F.nullif(F.try_element_at("fields", F.lit(k)), F.lit(""))
    out = out.withColumn("@timestamp", F.coalesce(none("TimeStamp"), none("DateTime"), none("date-time")))
    return out.where(F.col("@timestamp").isNotNull()).select("path", "pos", "@timestamp", "fields")


def parse_trace_log(lines: DataFrame, col: str = "line") -> DataFrame:
    """``level time message`` lines (S7); others keep their text under the unknown time."""
    pattern = r"^\s*(\w+)\s+(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?)\s+(.*)$"
    part = lambda i: F.regexp_extract(col, pattern, i)
    hit = F.col(col).rlike(pattern)
    return lines.where(F.trim(col) != "").withColumns({
        "level": F.when(hit, part(1)), "@timestamp": F.when(hit, F.replace(part(2), F.lit(" "), F.lit("T"))).otherwise(SENTINEL), "message": F.when(hit, part(3)).otherwise(F.col(col)),
    })


def parse_sccm_log(texts: DataFrame, col: str = "line") -> DataFrame:
    """``<![LOG[text]LOG]!><key="value" …>`` entries of whole texts or lines."""
    entry = F.explode(F.regexp_extract_all(col, F.lit(r"(?s)(<!\[LOG\[.*?\]LOG\]!><[^>]*>)"), F.lit(1)))
    out = texts.withColumn("_e", entry)
    pairs = F.regexp_extract_all("_e", F.lit(r'(\w+="[^"]*")'), F.lit(1))
    fields = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^(\w+)=", 1), F.regexp_extract(p, r'="([^"]*)"', 1))))
    out = out.withColumns({"message": F.regexp_extract("_e", r"(?s)<!\[LOG\[(.*?)\]LOG\]!>", 1), "fields": fields})
    date = F.try_to_timestamp(F.try_element_at("fields", F.lit("date")), F.lit("MM-dd-yyyy"))
    clock = F.regexp_extract(F.coalesce(F.try_element_at("fields", F.lit("time")), F.lit("")), r"^([\d:.]+)", 1)
    ts = F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit("T"), clock)
    return out.withColumn("@timestamp", F.coalesce(ts, F.lit(SENTINEL))).drop("_e", col)


NETLOGON = r"^(\d{2}/\d{2} \d{2}:\d{2}:\d{2}) \[LOGON\](?: \[(\d+)\])? (?:\S+: )?SamLogon: Transitive Network logon of (?:([^\\\s]*)\\)?(\S+) from (\S*) (?:\(via (\S+)\) )?(Entered|Returns (0x[0-9A-Fa-f]+))\s*$"


def parse_netlogon(lines: DataFrame, col: str = "line") -> DataFrame:
    """Requests and responses of transitive network logons (S9); other lines go."""
    part = lambda i: F.regexp_extract(col, NETLOGON, i)
    code = F.nullif(part(8), F.lit(""))
    fixed = F.create_map(*[F.lit(x) for k, v in LOGON_CODES.items() for x in (k.lower(), v)])
    return lines.where(F.col(col).rlike(NETLOGON)).withColumns({
        "time": part(1), "pid": part(2), "domain": part(3), "user": part(4), "source": part(5), "target": part(6),
        "is_request": part(7) == "Entered", "code": code, "message": F.when(code.isNotNull(), F.coalesce(F.try_element_at(fixed, F.lower(code)), F.lit("Unknown"))),
    })


def read_line_records(spark: SparkSession, path: str) -> DataFrame:
    """One record per stripped line (S10); empty lines go."""
    return read_lines(spark, path).select("path", "pos", F.trim("line").alias("command")).where("command <> ''")


def normalize_mft(lines: DataFrame, columns: Sequence[str], col: str = "line") -> DataFrame:
    """Rows of a file-table CSV (S13): the last column keeps its commas, short rows go.

    The six dates of the table get ``T`` for a space, and the unknown time where they are
    empty or stand for no record; no other column is changed, but for slashes in FullPath.
    """
    n = len(columns)
    cells = F.split(F.col(col), ",", n)
    names = [c.replace("StandardInfo", "SI").replace("FileName", "FN") for c in columns]
    out = lines.where(F.size(cells) == n)
    dates = [f"{a}{b}" for a in ("SI", "FN") for b in ("LastModified", "LastAccess", "Created")]
    made = {}
    for i, c in enumerate(names):
        v = cells[i]
        if c in dates:
            v = F.when(v.isin("", "NoFNRecord"), SENTINEL).otherwise(F.replace(v, F.lit(" "), F.lit("T")))
        made[c] = F.replace(v, F.lit("/"), F.lit("\\")) if c == "FullPath" else v
    out = out.select(*[c for c in lines.columns if c != col], *[v.alias(k) for k, v in made.items()])
    return out.withColumn("@timestamp", F.col("FNCreated") if "FNCreated" in names else F.lit(SENTINEL))


def normalize_flows(df: DataFrame) -> DataFrame:
    """Flow rows with UTC times (S14): first_seen and last_seen in seconds, ``_ms`` in milliseconds."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    s, ms = (F.timestamp_seconds(F.col("first_seen")), F.timestamp_millis(F.col("first_seen_ms").cast("long")))
    out = df.withColumn("@timestamp", iso(F.coalesce(ms, s)))
    for c in ("first_seen", "last_seen"):
        out = out.withColumn(c, iso(F.timestamp_seconds(F.col(c)))).withColumn(f"{c}_ms", iso(F.timestamp_millis(F.col(f"{c}_ms").cast("long"))))
    return out


def nearest_value(lines: DataFrame, value: Column, name: str, after: bool) -> DataFrame:
    """``lines`` with ``name``: the nearest ``value`` that is not null at or after (or before) a line of its file.

    A file is looked through block by block (its splits, or runs of BLOCK_LINES where ``pos``
    is a number), and what the blocks next to it have is carried over from a row per block.
    """
    block = F.col("pos.block") if isinstance(lines.schema["pos"].dataType, StructType) else F.floor(F.col("pos") / BLOCK_LINES)
    out = lines.withColumns({"_blk": block, "_v": value})
    rows = W.partitionBy("path", "_blk").orderBy("pos")
    blocks = W.partitionBy("path").orderBy("_blk")
    at = F.when(F.col("_v").isNotNull(), F.col("pos"))
    if after:
        here = F.first_value("_v", ignoreNulls=F.lit(True)).over(rows.rowsBetween(0, W.unboundedFollowing))
        edge = F.min_by("_v", at)
        beyond = F.first_value("_e", ignoreNulls=F.lit(True)).over(blocks.rowsBetween(1, W.unboundedFollowing))
    else:
        here = F.last_value("_v", ignoreNulls=F.lit(True)).over(rows.rowsBetween(W.unboundedPreceding, 0))
        edge = F.max_by("_v", at)
        beyond = F.last_value("_e", ignoreNulls=F.lit(True)).over(blocks.rowsBetween(W.unboundedPreceding, -1))
    carried = out.groupBy("path", "_blk").agg(edge.alias("_e")).select("path", "_blk", beyond.alias("_far"))
    near = out.withColumn("_near", here).join(carried, ["path", "_blk"])
    return near.withColumn(name, F.coalesce("_near", "_far")).drop("_blk", "_v", "_near", "_far")


def parse_shutdown_log(lines: DataFrame, col: str = "line") -> DataFrame:
    """Clients that remained at a shutdown, with the time of the SIGTERM that follows."""
    client, term = r"remaining client pid: (\d+) \((.*)\)", r"SIGTERM: \[(\d+)\]"
    ts = F.when(F.col(col).rlike(term), F.regexp_extract(col, term, 1).try_cast("long"))
    out = nearest_value(lines, ts, "_t", after=True).where(F.col(col).rlike(client) & F.col("_t").isNotNull())
    return out.select("path", "pos", F.regexp_extract(col, client, 1).alias("pid"), F.regexp_extract(col, client, 2).alias("client"), F.timestamp_seconds("_t").alias("ts"))


def parse_receivers(lines: DataFrame, activities: str | Sequence[str], skip_packages: Sequence[str] = ("com.google.android.gms",), col: str = "line") -> DataFrame:
    """Receivers listed under activities (S16): path, pos, activity, id, package_name, receiver.

    A line that starts with an activity's name, whatever its indent, opens a block; the
    lines of 8 spaces that follow belong to it, and any other line, a blank one too, ends it.
    """
    names = [activities] if isinstance(activities, str) else list(activities)
    text = F.trim(col)
    head = F.lit(None).cast("string")
    for name in reversed(names):
        head = F.when(text.startswith(name), F.lit(name)).otherwise(head)
    ends = F.when(~F.col(col).startswith(" " * 8), F.lit(""))
    out = nearest_value(lines.withColumn("_head", head), F.coalesce("_head", ends), "_a", after=False)
    words = F.split(text, " ")
    out = out.where((F.col("_a") != "") & F.col("_head").isNull() & (F.size(words) > 1))
    receiver = F.element_at(words, F.lit(2))
    out = out.select("path", "pos", F.col("_a").alias("activity"), words[0].alias("id"), F.substring_index(receiver, "/", 1).alias("package_name"), receiver.alias("receiver"))
    return out.where(~F.col("package_name").isin(*skip_packages)) if skip_packages else out


def read_iis_config(spark: SparkSession, path: str) -> DataFrame:
    """Sites × applications × virtual directories of a server configuration."""
    schema = (
        "_name string, _id string, application array<struct<_path:string,_applicationPool:string,virtualDirectory:array<struct<_path:string,_physicalPath:string>>>>"
    )
    sites = spark.read.format("xml").option("rowTag", "site").schema(schema).load(path)
    apps = sites.select(F.col("_name").alias("site"), F.col("_id").alias("site_id"), F.explode("application").alias("a"))
    dirs = apps.select("site", "site_id", F.col("a._path").alias("app_path"), F.col("a._applicationPool").alias("pool"), F.explode("a.virtualDirectory").alias("d"))
    full = F.regexp_replace(F.concat_ws("/", "app_path", F.col("d._path")), "/+", "/")
    return dirs.select("site", "site_id", "pool", full.alias("virtual_path"), F.col("d._physicalPath").alias("physical_path"))


def render_items(df: DataFrame, item_specs: Sequence[Mapping]) -> DataFrame:
    """Item lists -> rows with time and message.

    A spec has ``items`` (array column), ``type``, ``timestamp`` (path), ``format`` (of the
    time) and ``message``: text with slots ``{a|b}`` that take the first path with a value.
    """
    import re

    out = None
    for spec in item_specs:
        rows = df.select(F.explode(spec["items"]).alias("i"))
        parts, at = [], 0
        text = spec["message"]
        for m in re.finditer(r"\{([^}]*)\}", text):
            parts += [F.lit(text[at : m.start()]), F.coalesce(*[F.col(f"i.{p}").cast("string") for p in m[1].split("|")], F.lit(""))]
            at = m.end()
        ts = F.try_to_timestamp(F.col(f"i.{spec['timestamp']}"), F.lit(spec["format"]))
        got = rows.select(F.lit(spec["type"]).alias("type"), F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(SENTINEL)).alias("@timestamp"), F.concat(*parts, F.lit(text[at:])).alias("message"))
        out = got if out is None else out.unionByName(got)
    return out


def parse_kv_report(files: DataFrame, col: str = "text") -> DataFrame:
    """``key=value`` reports, one row per file (S20), with time and hash of the app id."""
    lines = F.filter(F.split(F.regexp_replace(col, "^﻿", ""), r"\r?\n"), lambda x: F.contains(x, F.lit("=")))
    pairs = F.transform(lines, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(x, "^[^=]*=", "").alias("v")))
    # of a key given twice the first holds
    once = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    out = files.withColumn("fields", F.map_from_entries(once))
    app = F.try_element_at("fields", F.lit("TargetAppId"))
    digest = F.regexp_extract(app, "!0000([0-9a-fA-F]{40})", 1)
    ts = filetime_to_ts(F.try_element_at("fields", F.lit("EventTime")).try_cast("long"))
    return out.withColumns({"@timestamp": F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(SENTINEL)), "sha1": F.nullif(digest, F.lit(""))}).drop(col)


def normalize_memory_table(df: DataFrame, time: str | None = None, offsets: Sequence[str] = (), handles: Sequence[str] = (), children: str = "__children") -> DataFrame:
    """A memory table (S21): time column, offsets as hex text, rows of null handles go."""
    out = df.drop(children)
    for h in handles:
        out = out.where(F.col(h).isNotNull())
    for o in offsets:
        out = out.withColumn(o, F.concat(F.lit("0x"), F.lower(F.hex(F.col(o).cast("long")))))
    ts = F.coalesce(F.col(time).cast("string"), F.lit(SENTINEL)) if time else F.lit(SENTINEL)
    return out.withColumn("@timestamp", F.replace(ts, F.lit(" "), F.lit("T")))


PS = ("user", "pid", "ppid", "vsz", "rss", "wchan", "addr", "s", "name")


def parse_ps(lines: DataFrame, col: str = "line") -> DataFrame:
    """Process listing (S22): with 8 fields the sixth is empty; the header line goes."""
    cells = F.split(F.trim(col), r"\s+", 9)
    full = F.when(F.size(cells) == 8, F.concat(F.slice(cells, 1, 5), F.array(F.lit("")), F.slice(cells, 6, 3))).otherwise(cells)
    out = lines.withColumn("_c", full).where((F.size("_c") == 9) & (F.col("_c")[1] != "PID"))
    return out.select(*[c for c in lines.columns if c != col], *[F.col("_c")[i].alias(n) for i, n in enumerate(PS)])


def logon_message(col: Column | str) -> Column:
    return code_label(col, LOGON_CODES)
