"""Relational reconstruction of artifacts. Join keys always start with where ids are local."""

from __future__ import annotations

import difflib
import re
from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidence_spark.functions.convert import day_of_year_date
from evidence_spark.functions.storage import cut, drop_cut


_LINE_END = re.compile("\r\n|\r|\n")
_LAST_END = re.compile(r"(\r\n|\r|\n)\Z")


def _on(df: DataFrame, key: str, to: str) -> DataFrame:
    return df.withColumnRenamed(key, to) if key != to else df


def visit_history(visits: DataFrame, urls: DataFrame, url_key: str = "url_id", how: str = "inner", keys: Sequence[str] = ("machine",)) -> DataFrame:
    """Visits with their URL (J1): ``urls(id, …)``."""
    return visits.join(_on(urls, "id", url_key), [*keys, url_key], how)


def visit_annotations(visits: DataFrame, places: DataFrame, origins: DataFrame, annos: DataFrame, names: DataFrame, keys: Sequence[str] = ("machine",)) -> DataFrame:
    """Visits with place, origin and the named annotations of the place, nested."""
    k = list(keys)
    named = annos.join(_on(names, "id", "anno_attribute_id"), [*k, "anno_attribute_id"], "left").groupBy(*k, "place_id")
    nested = named.agg(F.array_sort(F.collect_list(F.struct("name", "content"))).alias("annotations"))
    return (
        visits.join(_on(places, "id", "place_id"), [*k, "place_id"], "left")
        .join(_on(origins, "id", "origin_id"), [*k, "origin_id"], "left")
        .join(nested, [*k, "place_id"], "left")
    )


def download_chains(downloads: DataFrame, chains: DataFrame, keys: Sequence[str] = ("machine",)) -> DataFrame:
    """Downloads with their URLs in order, and the first as link."""
    k = [*keys, "id"]
    urls = F.transform(F.array_sort(F.collect_list(F.struct("chain_index", "url"))), lambda x: x["url"])
    return downloads.join(chains.groupBy(*k).agg(urls.alias("urls")), k, "left").withColumn("link", F.try_element_at("urls", F.lit(1)))


def visit_terms(visits: DataFrame, terms: DataFrame, segments: DataFrame, keys: Sequence[str] = ("machine",)) -> DataFrame:
    """Visits with all search terms and segments of their URL, ordered."""
    k = [*keys, "url_id"]
    t = terms.groupBy(*k).agg(F.array_sort(F.collect_list("term")).alias("terms"))
    s = segments.groupBy(*k).agg(F.array_sort(F.collect_list("name")).alias("segments"))
    return visits.join(t, k, "left").join(s, k, "left")


def classify_visits(visits: DataFrame, col: str = "visit_type", download: int = 7) -> DataFrame:
    """Visits marked as download or visit."""
    return visits.withColumn("kind", F.when(F.col(col) == download, "download").otherwise("visit"))


def messages_with_handle(messages: DataFrame, handles: DataFrame, keys: Sequence[str] = ("machine",)) -> DataFrame:
    """Messages that have a handle, with it."""
    return messages.join(handles, [*keys, "handle_id"])


def attachments_full(attachments: DataFrame, bridge: DataFrame, messages: DataFrame, handles: DataFrame, keys: Sequence[str] = ("machine",)) -> DataFrame:
    """Attachments with message and handle where there are such."""
    k = list(keys)
    return attachments.join(bridge, [*k, "attachment_id"], "left").join(messages, [*k, "message_id"], "left").join(handles, [*k, "handle_id"], "left")


def messages_with_media(messages: DataFrame, media: DataFrame, items: DataFrame, keys: Sequence[str] = ("machine",)) -> DataFrame:
    """Messages with media and data item where there are such."""
    k = [*keys, "message_id"]
    return messages.join(media, k, "left").join(items, k, "left")


def interactions_full(interactions: DataFrame, contacts: DataFrame, att_bridge: DataFrame, attachments: DataFrame, rec_bridge: DataFrame, keys: Sequence[str] = ("machine",)) -> DataFrame:
    """Interactions with sender, attachments and recipients (J9); contacts serve twice."""
    k = list(keys)
    sender = contacts.select(*k, F.col("contact_id").alias("sender_id"), F.col("name").alias("sender_name"))
    recipient = contacts.select(*k, F.col("contact_id").alias("recipient_id"), F.col("name").alias("recipient_name"))
    return (
        interactions.join(sender, [*k, "sender_id"], "left")
        .join(att_bridge, [*k, "interaction_id"], "left")
        .join(attachments, [*k, "attachment_id"], "left")
        .join(rec_bridge, [*k, "interaction_id"], "left")
        .join(recipient, [*k, "recipient_id"], "left")
    )


def conversation_messages(messages: DataFrame, conversations: DataFrame, parts: DataFrame, participants: DataFrame, members: DataFrame, keys: Sequence[str] = ("machine",)) -> DataFrame:
    """Messages with text and conversation; ``incoming`` is 2 where the sender is this device.

    This device's participants have contact -1.
    """
    k = list(keys)
    own = participants.where("contact_id = -1").select(*k, F.col("participant_id").alias("sender_id")).distinct().withColumn("_own", F.lit(True))
    senders = participants.select(*k, F.col("participant_id").alias("sender_id"), F.col("name").alias("sender_name"))
    out = messages.join(conversations, [*k, "conversation_id"]).join(parts, [*k, "message_id"]).join(senders, [*k, "sender_id"])
    out = out.join(members.groupBy(*k, "conversation_id").agg(F.count("*").alias("n_members")), [*k, "conversation_id"])
    return out.join(own, [*k, "sender_id"], "left").withColumn("incoming", F.when(F.col("_own"), 2).otherwise(1)).drop("_own")


def usage_with_process(usage: DataFrame, procs: DataFrame, key: str, keys: Sequence[str] = ("machine",)) -> DataFrame:
    """Usage with its process, and processes never used, each row once.

    An anti join: a usage row without a process does not hide the unused processes.
    """
    k = [*keys, key]
    used = usage.join(procs, k, "left")
    never = procs.join(usage.select(*k), k, "left_anti")
    return used.unionByName(never, allowMissingColumns=True).distinct()


def usage_enriched(usage: DataFrame, idmap: DataFrame) -> DataFrame:
    """Usage of known apps, with app and user names (J12): ``idmap(id_index, id_name)``."""
    app = idmap.select(F.col("id_index").alias("app_id"), F.col("id_name").alias("app_name"))
    user = idmap.select(F.col("id_index").alias("user_id"), F.col("id_name").alias("user_name"))
    return usage.join(app, "app_id").join(user, "user_id", "left")


def client_access(clients: DataFrame, dns: DataFrame, roles: DataFrame, default: str = "No Match") -> DataFrame:
    """Clients with the host names of their address and their role's name."""
    names = dns.groupBy("address").agg(F.array_sort(F.collect_set("hostname")).alias("hostnames"))
    out = clients.join(names, "address", "left").join(roles, "role_guid", "left")
    return out.withColumns({"hostnames": F.coalesce("hostnames", F.array(F.lit(default))), "role_name": F.coalesce("role_name", F.lit(default))})


def daily_counts(df: DataFrame, keys: Sequence[str], day_cols: Sequence[str], year: str | None = None) -> DataFrame:
    """Counter columns ``Day1…`` -> a row per day with a positive count (J14), with its date."""
    out = df.unpivot([*keys, *([year] if year else [])], list(day_cols), "day", "n").where("n > 0")
    number = F.regexp_extract("day", r"(\d+)$", 1).cast("int")
    return out.withColumn("date", day_of_year_date(year, number)) if year else out


def persistence_bindings(bindings: DataFrame, consumers: DataFrame, filters: DataFrame) -> DataFrame:
    """Distinct bindings with consumer and filter."""
    return bindings.dropDuplicates(["consumer_name", "filter_name"]).join(consumers, "consumer_name").join(filters, "filter_name")


def walk_tree(df: DataFrame, node: str, parent: str, name: str, sep: str = "/", keys: Sequence[str] = (), max_depth: int | None = None) -> DataFrame:
    """Depth and path of every node from its root.

    Columns: keys, node, depth (0 at roots), path of names. Roots are nodes without a
    parent row. Nodes on a cycle, or below one, do not appear, nor do nodes deeper than
    ``max_depth`` where that is given. Each join doubles the way up that is known of every
    node, so a tree of any depth takes a logarithmic number of joins; each step is written.
    """
    k = list(keys)
    edges = df.select(*k, F.col(node).alias("_n"), F.col(parent).alias("_p"), F.col(name).cast("string").alias("path"))
    known = edges.select(*k, F.col("_n").alias("_p")).distinct().withColumn("_has", F.lit(True))
    up = F.when(F.col("_has") & (F.col("_n") != F.col("_p")), F.col("_p"))
    state = edges.join(known, [*k, "_p"], "left").select(*k, "_n", up.alias("_up"), F.when(up.isNull(), 0).otherwise(1).alias("depth"), "path")
    state = cut(state)
    most = max(1, state.count()).bit_length() + 1  # doublings after which only cycles are open
    while most and state.where("_up is not null").limit(1).count():
        above = state.select(*k, F.col("_n").alias("_up"), F.col("_up").alias("_next"), F.col("depth").alias("_more"), F.col("path").alias("_head"))
        longer = state.where("_up is not null").join(above, [*k, "_up"])
        longer = longer.select(*k, "_n", F.col("_next").alias("_up"), (F.col("depth") + F.col("_more")).alias("depth"), F.concat_ws(sep, "_head", "path").alias("path"))
        new = cut(state.where("_up is null").unionByName(longer))
        drop_cut(state)
        state, most = new, most - 1
    out = state.where("_up is null").drop("_up").withColumnRenamed("_n", node)
    return out if max_depth is None else out.where(F.col("depth") <= max_depth)


def process_tree(df: DataFrame, pid: str = "pid", ppid: str = "ppid", keys: Sequence[str] = ("machine",), max_depth: int | None = None) -> DataFrame:
    """Processes with their level and path of ids; sorting by path is pre-order."""
    padded = df.withColumn("_name", F.lpad(F.col(pid).cast("string"), 12, "0"))
    return walk_tree(padded, pid, ppid, "_name", "/", keys, max_depth)


def folder_paths(df: DataFrame, node: str, parent: str, name: str, keys: Sequence[str] = ("machine",), max_depth: int | None = None) -> DataFrame:
    """Folder paths with backslashes."""
    return walk_tree(df, node, parent, name, "\\", keys, max_depth)


def pair_requests(df: DataFrame, keys: Sequence[str], order: Sequence[str], is_request: str = "is_request", cols: Sequence[str] = ()) -> DataFrame:
    """Responses with the most recent open request of their key.

    As with brackets: a request opens a level, a response closes the latest open one.
    Responses with nothing open are dropped. Rows are sorted into blocks, so that a frequent
    key is spread over tasks: in a block, a response belongs to the last request of the
    level that it closes. What a block leaves open or unmatched is counted, a scan over the
    blocks of a key gives the levels open before each, and what is left meets by level.
    """
    k = list(keys)
    blocks = cut(df.repartitionByRange(*k, *order).withColumn("_blk", F.spark_partition_id()))
    w = W.partitionBy(*k, "_blk").orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    step = F.when(F.col(is_request), 1).otherwise(-1)
    out = blocks.withColumn("_b", F.sum(step).over(upto)).withColumn("_m", F.least(F.min("_b").over(upto), F.lit(0)))
    # with the balance counted from its minimum so far, a response closes one level more than it leaves
    out = out.withColumn("_open", F.col("_b") - F.col("_m") + F.when(F.col(is_request), 0).otherwise(1))
    # a response that finds nothing open lowers the minimum
    out = out.withColumn("_lost", ~F.col(is_request) & (F.col("_m") < F.coalesce(F.lag("_m").over(w), F.lit(0))))
    taken = [*order, *cols]
    lw = W.partitionBy(*k, "_blk", "_lost", "_open").orderBy(*order)
    out = out.withColumns({f"request_{c}": F.lag(c).over(lw) for c in taken} | {"_left": F.col("_lost") | (F.col(is_request) & F.lead(is_request).over(lw).isNull())})
    out = cut(out)
    here = out.where(~F.col(is_request) & ~F.col("_lost"))

    left = out.where("_left").drop(*[f"request_{c}" for c in taken])
    sums = left.groupBy(*k, "_blk").agg(F.count_if("_lost").alias("_c"), F.count_if(is_request).alias("_o"))
    bw = W.partitionBy(*k).orderBy("_blk")
    before = bw.rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_p", F.coalesce(F.sum(F.col("_o") - F.col("_c")).over(before), F.lit(0)))
    sums = sums.withColumn("_floor", F.least(F.lit(0), F.coalesce(F.min(F.col("_p") - F.col("_c")).over(before), F.lit(0)))).withColumn("_h", F.col("_p") - F.col("_floor"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*k, "_blk"]]
    met = left.alias("l").join(sums.alias("s"), reduce(Column.__and__, same)).select("l.*", "_c", "_h")
    # the i-th response that a block leaves closes level h - i + 1; its requests open the levels above
    level = F.when(F.col(is_request), F.greatest(F.col("_h") - F.col("_c"), F.lit(0)) + F.col("_open")).otherwise(F.col("_h") + F.col("_m") + 1)
    met = met.withColumn("_level", level).where("_level > 0")
    far = W.partitionBy(*k, "_level").orderBy("_blk", *order)
    carried = met.withColumns({f"request_{c}": F.lag(c).over(far) for c in taken} | {"_was": F.lag(is_request).over(far)}).where(~F.col(is_request) & F.col("_was"))
    names = [*df.columns, *[f"request_{c}" for c in taken]]
    return here.select(*names).unionByName(carried.select(*names))


def _line_changes(old: str | None, new: str | None) -> list[dict]:
    """Lines removed and added from one text to the next, in their order."""
    a, b = (_LINE_END.split(_LAST_END.sub("", x)) if x else [] for x in (old, new))
    out = []
    for tag, i, j, x, y in difflib.SequenceMatcher(None, a, b).get_opcodes():
        if tag != "equal":
            out += [{"line": t, "change": "removed"} for t in a[i:j]] + [{"line": t, "change": "added"} for t in b[x:y]]
    return out


def version_diff(df: DataFrame, keys: Sequence[str] = ("machine", "path"), order: str = "modified", text: str = "text") -> DataFrame:
    """Lines added and removed between consecutive versions of a file (J19), moved ones too.

    Columns: keys, order, ``at`` (place in the diff), ``line``, ``change`` (added or
    removed). A version meets the one before it by a join on their order, and a task
    compares two texts at a time with the matcher of the standard library, line ends aside.
    A null text has no lines. A version is one row.
    """
    k = list(keys)
    versions = df.select(*k, order).distinct().withColumn("_before", F.lag(order).over(W.partitionBy(*k).orderBy(order))).where("_before is not null")
    old = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(k)], F.col(order).alias("_before"), F.col(text).alias("_old"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(k)]
    near = [F.col(f"n.{c}").eqNullSafe(F.col(f"v.{c}")) for c in k]
    both = df.select(*k, order, text).alias("n").join(versions.alias("v"), reduce(Column.__and__, near, F.col(f"n.{order}") == F.col(f"v.{order}"))).select("n.*", "_before")
    both = both.join(old.withColumnRenamed("_before", "_b"), reduce(Column.__and__, same, F.col("_before") == F.col("_b")))
    kind = pa.list_(pa.struct([("line", pa.string()), ("change", pa.string())]))
    diff = F.arrow_udf(lambda x, y: pa.array([_line_changes(a, b) for a, b in zip(x.to_pylist(), y.to_pylist(), strict=True)], kind), "array<struct<line:string,change:string>>")
    return both.select(*k, order, F.posexplode(diff("_old", text)).alias("at", "_d")).select(*k, order, "at", "_d.line", "_d.change")


def icon_joins(mapping: DataFrame, bitmap: DataFrame, icon: DataFrame, keys: Sequence[str] = ("machine",)) -> DataFrame:
    """Icons with their pages and bitmaps."""
    k = [*keys, "icon_id"]
    return mapping.join(bitmap, k).join(icon, k)


def union_events(*dfs: DataFrame) -> DataFrame:
    """Rows of all tables, each once, by time."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out.distinct().orderBy("ts", *[c for c in out.columns if c != "ts"])


def split_parallel_lists(df: DataFrame, a: str, b: str) -> DataFrame:
    """A row per position of two lists."""
    return df.withColumn("_z", F.explode(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y")))).withColumns({a: F.col("_z.x"), b: F.col("_z.y")}).drop("_z")


def person_values(person: DataFrame, values: DataFrame, key: str = "person_id", keys: Sequence[str] = ("machine",)) -> DataFrame:
    """Persons with each of their values that is not null."""
    return person.join(values.where(F.col("value").isNotNull()), [*keys, key])


def pivot_variables(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ("machine",)) -> DataFrame:
    """Variable/value rows -> one record per key."""
    return df.groupBy(*keys).pivot("variable", list(names)).agg(F.max("value"))


def promote_children(df: DataFrame, col: str) -> DataFrame:
    """The elements of a list of records in place of their parent."""
    return df.select(F.explode(col).alias("_c")).select("_c.*")


def decode_map(df: DataFrame, col: str, mapping: Mapping) -> DataFrame:
    """A code column with its labels in place."""
    from evidence_spark.functions.convert import code_label

    return df.withColumn(col, code_label(col, mapping))
