"""Leaves of JSON records by built-in functions only: no Python worker reads a record.

Records become VARIANT and are exploded a level at a time in one pipeline, as many levels
as the deepest record has. Text that cannot be parsed (no JSON, a key given twice, or more
than 1,000 levels) has no leaves; :func:`unparsed` gives these records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark.functions.records import variant
from evidence_spark.functions.storage import cut

#: Levels that are exploded in one pipeline; deeper records go through a written table.
LEVELS = 8


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _plain_strings(data: Column) -> Column:
    """Escaped backslashes and quotes as control characters, which JSON never has as they are."""
    return F.replace(F.replace(data, F.lit("\\\\"), F.lit("\u0001")), F.lit('\\"'), F.lit("\u0002"))


def json_depth(data: Column | str) -> Column:
    """Levels of nested lists and objects of a JSON text."""
    marks = F.regexp_replace(F.regexp_replace(_plain_strings(_col(data)), '"[^"]*"', ""), r"[^\[\]{}]+", "")
    step = lambda a, c: F.struct(
        (a["now"] + F.when(c.isin("[", "{"), 1).when(c == "", 0).otherwise(-1)).alias("now"), F.greatest(a["most"], a["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most")
    )
    return F.aggregate(F.split(marks, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])


def float_text(x: Column) -> Column:
    """A double as text: plain digits from 1e-4 to 1e16, else with an exponent of two digits or more."""
    s = x.cast("string")
    digits = F.regexp_replace(F.replace(F.regexp_extract(s, r"^-?([0-9.]+)E", 1), F.lit("."), F.lit("")), "(?<=.)0$", "")
    exp = F.regexp_extract(s, "E(-?[0-9]+)$", 1).try_cast("int")
    sign = F.when(s.startswith("-"), "-").otherwise("")
    long_form = F.when(F.length(digits) <= exp + 1, F.concat(F.rpad(digits, exp + 1, F.lit("0")), F.lit(".0"))).otherwise(F.concat(F.substring(digits, F.lit(1), exp + 1), F.lit("."), F.substring(digits, exp + 2, F.length(digits))))
    rest = F.substring(digits, F.lit(2), F.length(digits))
    short = F.concat(F.substring(digits, 1, 1), F.when(F.length(rest) > 0, F.concat(F.lit("."), rest)).otherwise(""), F.lit("e"), F.when(exp < 0, "-").otherwise("+"), F.lpad(F.abs(exp).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exp).cast("string"))), F.lit("0")))
    number = F.when(exp == -4, F.concat(F.lit("0.000"), digits)).when((exp >= 7) & (exp < 16), long_form).otherwise(short)
    return F.when(F.contains(s, F.lit("E")), F.concat(sign, number)).otherwise(s)


def _levels(df: DataFrame, n: int) -> DataFrame:
    """``_v`` of ``df`` exploded ``n`` levels down; values without children stay as they are."""
    for _ in range(n):
        down = df.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("_v").outer()).toDF("_pos", "_key", "_value"))
        step = F.coalesce("_key", F.col("_pos").cast("string"))
        path = F.when(F.col("_pos").isNull(), F.col("_path")).when(F.col("_path") == "", step).otherwise(F.concat("_path", F.lit("."), step))
        value = F.when(F.col("_pos").isNull(), F.col("_v")).otherwise(F.col("_value"))
        df = down.withColumns({"_path": path, "_v": value}).drop("_pos", "_key", "_value")
    return df


def flatten_leaves(df: DataFrame, data: str = "data", depth: int | None = None) -> DataFrame:
    """One row per leaf: the columns of ``df`` without ``data``, then path, value, kind.

    Kinds are string, number, boolean and null; lists count as objects keyed by index, and
    empty lists and objects have no leaves. ``depth`` is the most levels of any record;
    where it is not given, a pass over the text finds it.
    """
    keep = [c for c in df.columns if c != data]
    if depth is None:
        depth = df.agg(F.max(json_depth(data))).first()[0] or 0
    at = df.select(*keep, F.lit("").alias("_path"), variant(data).alias("_v")).where(F.col("_v").isNotNull())
    out = []
    while depth > LEVELS:
        at = cut(_levels(at, LEVELS))
        deep = F.schema_of_variant("_v").rlike("^(OBJECT|ARRAY)<.")
        out.append(at.where(~deep))
        at, depth = at.where(deep), depth - LEVELS
    out.append(_levels(at, depth))
    rows = reduce(DataFrame.unionByName, out).withColumn("_what", F.schema_of_variant("_v"))
    kind = F.when(F.col("_what") == "STRING", "string").when(F.col("_what") == "VOID", "null").when(F.col("_what") == "BOOLEAN", "boolean").otherwise("number")
    text = F.try_variant_get("_v", "$", "string")
    # a decimal without a fraction is an integer beyond 64 bits, or was written with .0
    whole = F.col("_what").endswith(",0)") & (F.abs(F.try_variant_get("_v", "$", "decimal(38,0)")) >= F.lit(str(2**63)).cast("decimal(38,0)"))
    value = F.when((kind == "number") & (F.col("_what") != "BIGINT") & ~whole, float_text(F.try_variant_get("_v", "$", "double"))).otherwise(text)
    leaf = rows.where(~F.col("_what").rlike("^(OBJECT|ARRAY)<"))
    return leaf.select(*keep, F.col("_path").alias("path"), value.alias("value"), kind.alias("kind"))


_TOKENS = r'"[^"]*"\s*:|"[^"]*"|-?[0-9][-+0-9.eE]*|true|false'


def with_catch_all(df: DataFrame, data: str = "data") -> DataFrame:
    """``df`` with ``catch_all``: the lower-cased leaf values, whole (N11), in the text's order.

    The values are read off the text in place, so no record is exploded and put together.
    """
    tokens = F.filter(F.regexp_extract_all(_plain_strings(F.col(data)), F.lit(_TOKENS), 0), lambda t: ~t.endswith(":"))
    back = lambda t: F.replace(F.replace(t, F.lit("\u0001"), F.lit("\\\\")), F.lit("\u0002"), F.lit('\\"'))
    escaped = lambda t: t.contains("\\") | t.contains("\u0001") | t.contains("\u0002")

    def value(t: Column) -> Column:
        text = F.when(escaped(t), F.try_variant_get(F.try_parse_json(back(t)), "$", "string")).otherwise(F.substring(t, F.lit(2), F.length(t) - 2))
        return F.when(t.startswith('"'), text).when(t.rlike("[.eE]") & ~t.isin("true", "false"), float_text(t.try_cast("double"))).otherwise(t)

    found = F.when(variant(data).isNotNull(), F.transform(tokens, lambda t: F.lower(value(t)))).otherwise(F.array().cast("array<string>"))
    return df.withColumn("catch_all", found)


def field_catalog(df: DataFrame, data: str = "data") -> DataFrame:
    """Distinct (path, kind) with counts, and whether a keyword view exists."""
    flat = flatten_leaves(df.select(data), data)
    return flat.groupBy("path", "kind").agg(F.count("*").alias("n")).withColumn("has_keyword", F.col("kind") == "string")


def unparsed(df: DataFrame, data: str = "data") -> DataFrame:
    """The records whose text is there but cannot be parsed, and so has no leaves."""
    return df.where(F.col(data).isNotNull() & variant(data).isNull())
