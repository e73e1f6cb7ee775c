"""Matching of records against indicators: ``iocs(kind, value)``.

Every function returns the rows of ``df`` that hit, with ``ioc`` (the indicator). A list of
indicators is broadcast only after its size was checked; a longer one is joined by shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_spark.functions.convert import SUFFIXES, registrable_domain, url_domain
from evidence_spark.operators.automaton import AUTOMATON_CHARS, contained

#: Indicators that may be broadcast.
SMALL = 100_000
#: Indicators of which one alternation pattern is built for substring search.
PATTERN_MAX = 24
#: Lengths of path indicators beyond which all prefixes of a path are joined.
PREFIX_LENGTHS = 64


def load_indicators(spark: SparkSession, path: str) -> DataFrame:
    """Indicators of STIX2 bundles: kind and value, each once.

    Kinds are domain, process, email, file, app, profile and sha256; domains and e-mail
    addresses are lower-cased.
    """
    bundle = spark.read.text(path, wholetext=True)
    objects = F.explode(F.from_json("value", "struct<objects:array<struct<type:string,pattern:string>>>")["objects"])
    pattern = F.col("o.pattern")
    key = F.trim(F.regexp_extract(pattern, r"^\[\s*([^=]+?)\s*=", 1))
    # fixed values: pattern keys and the kinds they stand for
    kinds = {
        "domain-name:value": "domain", "process:name": "process", "email-addr:value": "email", "file:name": "file", "file:path": "file_path",
        "app:id": "app", "configuration-profile:id": "profile", "file:hashes.sha256": "sha256",
    }
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[key]
    value = F.regexp_extract(pattern, r"=\s*'([^']*)'", 1)
    out = bundle.select(objects.alias("o")).where("o.type = 'indicator'").select(kind.alias("kind"), value.alias("value")).where("kind is not null and value <> ''")
    return out.withColumn("value", F.when(F.col("kind").isin("domain", "email"), F.lower("value")).otherwise(F.col("value"))).distinct()


def _kind(iocs: DataFrame, kind: str, name: str = "ioc") -> DataFrame:
    out = iocs.where((F.col("kind") == kind) & (F.col("value") != "")).select(F.col("value").alias(name)).distinct()
    return F.broadcast(out) if out.limit(SMALL + 1).count() <= SMALL else out


def _by_key(df: DataFrame, key: Column, iocs: DataFrame, kind: str) -> DataFrame:
    out = df.withColumn("_k", key)
    return out.join(_kind(iocs, kind), F.col("_k") == F.col("ioc")).drop("_k")


def match_domain(df: DataFrame, col: str, iocs: DataFrame, rules: Sequence[str] = SUFFIXES) -> DataFrame:
    """URL host equal to a domain, or its registrable domain equal to one (I1); once per indicator.

    ``rules`` are those of public suffixes.
    """
    keys = F.array_distinct(F.array_compact(F.array(url_domain(col), registrable_domain(col, rules))))
    return df.withColumn("_k", F.explode(keys)).join(_kind(iocs, "domain"), F.col("_k") == F.col("ioc")).drop("_k")


def match_any_domain(df: DataFrame, col: str, iocs: DataFrame) -> DataFrame:
    """Some URL of an array hits (I2): one row per record and indicator."""
    keys = F.transform(F.filter(col, lambda u: u.isNotNull()), lambda u: F.array(url_domain(u), registrable_domain(u)))
    out = df.withColumn("_k", F.explode(F.array_distinct(F.array_compact(F.flatten(keys)))))
    return out.join(_kind(iocs, "domain"), F.col("_k") == F.col("ioc")).drop("_k")


def _substring(df: DataFrame, col: Column, iocs: DataFrame, kind: str) -> DataFrame:
    """Rows whose text contains an indicator, whatever the case; empty indicators never match.

    A few indicators are one pattern, which rules most rows out, and a check of each. More
    become an automaton that reads each text once; where they hold more characters than
    one may, they are split by hash into several, each with a pass of its own.
    """
    spark = df.sparkSession
    known = _kind(iocs, kind).select("ioc", F.lower("ioc").alias("low"))
    n, chars = known.agg(F.count("*"), F.coalesce(F.sum(F.length("low")), F.lit(0))).first()
    if not n:
        return df.withColumn("ioc", F.lit("")).where("false")
    texts = df.withColumn("_t", F.lower(col))
    if n <= PATTERN_MAX:
        values = sorted(((r["ioc"], r["low"]) for r in known.collect()), key=lambda x: (-len(x[1]), x))
        some = texts.where(F.col("_t").rlike("|".join(re.escape(low) for _, low in values)))
        each = F.array_compact(F.array(*[F.when(F.contains("_t", F.lit(low)), F.lit(v)) for v, low in values]))
        return some.withColumn("ioc", F.explode(each)).drop("_t")
    out = []
    for part in _parts(known, -(-chars // AUTOMATON_CHARS)):
        pairs = [(r["low"], r["ioc"]) for r in part.collect()]
        out.append(texts.withColumn("ioc", F.explode(contained(spark, F.col("_t"), pairs))).drop("_t"))
    return reduce(DataFrame.unionByName, out)


def _parts(known: DataFrame, parts: int):
    """``known`` by hash in parts of at most ``AUTOMATON_CHARS`` characters, or of one indicator."""
    while True:
        place = F.pmod(F.xxhash64("ioc"), F.lit(parts))
        sizes = {r[0]: r[1:] for r in known.groupBy(place).agg(F.sum(F.length("low")), F.count("*")).collect()}
        if all(chars <= AUTOMATON_CHARS or n == 1 for chars, n in sizes.values()):
            break
        parts += 1 + parts // 4
    return [known.where(place == p) for p in sorted(sizes)]


def match_domain_substring(df: DataFrame, col: str, iocs: DataFrame) -> DataFrame:
    """Text that is no URL with a host but contains a domain."""
    return _substring(df.where(F.col(col).isNotNull() & url_domain(col).isNull()), F.col(col), iocs, "domain")


def match_process(df: DataFrame, col: str, iocs: DataFrame) -> DataFrame:
    """Process base name equal to an indicator; a name of 16 characters may be a cut one (I4)."""
    name = F.substring_index(F.col(col), "/", -1)
    both = df.withColumn("_n", name)
    whole = both.join(_kind(iocs, "process"), F.col("_n") == F.col("ioc"))
    cut = both.where(F.length("_n") == 16).join(_kind(iocs, "process"), (F.substring("ioc", 1, 16) == F.col("_n")) & (F.length("ioc") > 16))
    return whole.unionByName(cut).drop("_n")


def match_email(df: DataFrame, col: str, iocs: DataFrame) -> DataFrame:
    """Address equal, whatever the case, with or without ``mailto:``."""
    return _by_key(df, F.regexp_replace(F.lower(col), "^mailto:", ""), iocs, "email")


def match_file_name(df: DataFrame, col: str, iocs: DataFrame) -> DataFrame:
    """File base name equal."""
    return _by_key(df, F.substring_index(F.col(col), "/", -1), iocs, "file")


def match_path_prefix(df: DataFrame, col: str, iocs: DataFrame) -> DataFrame:
    """File path starts with an indicator's path.

    As an indicator may end inside a path part, the prefixes of a path that are as long as
    some indicator are joined; where indicators have many lengths, all its prefixes are.
    """
    known = iocs.where("kind = 'file_path'").select(F.regexp_replace("value", "/$", "").alias("ioc")).where("ioc <> ''").distinct()
    sizes = [r["n"] for r in known.select(F.length("ioc").alias("n")).distinct().limit(PREFIX_LENGTHS + 1).collect()]
    if not sizes:
        return df.withColumn("ioc", F.lit("")).where("false")
    if len(sizes) > PREFIX_LENGTHS:
        heads = F.when(F.length(col) > 0, F.sequence(F.lit(1), F.length(col)))
    else:
        heads = F.filter(F.array(*[F.lit(n) for n in sorted(sizes)]), lambda n: n <= F.length(col))
    out = df.withColumn("_k", F.explode(F.transform(heads, lambda n: F.substring(F.col(col), F.lit(1), n))))
    return out.join(F.broadcast(known) if known.limit(SMALL + 1).count() <= SMALL else known, F.col("_k") == F.col("ioc")).drop("_k")


def match_path_part(df: DataFrame, col: str, iocs: DataFrame, kind: str = "process") -> DataFrame:
    """An indicator is a component of a path (I8)."""
    out = df.withColumn("_k", F.explode(F.array_distinct(F.split(F.col(col), "/"))))
    return out.join(_kind(iocs, kind), F.col("_k") == F.col("ioc")).drop("_k")


def match_path_mention(df: DataFrame, col: str, iocs: DataFrame) -> DataFrame:
    """A domain is mentioned inside a path."""
    return _substring(df, F.col(col), iocs, "domain")


def match_exact(df: DataFrame, col: str, iocs: DataFrame, kind: str) -> DataFrame:
    """A value equal to an indicator of a kind: hash, app or profile id."""
    return _by_key(df, F.col(col), iocs, kind)


def match_any_field(leaves: DataFrame, iocs: DataFrame, key: str = "record_id") -> DataFrame:
    """Records of which a leaf equals a process or contains a domain.

    ``leaves`` has a row per leaf with ``key`` and ``value``; the result has key, ioc, kind.
    """
    process = _by_key(leaves, F.col("value"), iocs, "process").select(key, "ioc", F.lit("process").alias("kind"))
    domain = _substring(leaves, F.col("value"), iocs, "domain").select(key, "ioc", F.lit("domain").alias("kind"))
    return process.unionByName(domain).distinct()


def match_redirect_chain(df: DataFrame, iocs: DataFrame, origin: str = "origin", sources: str = "sources", destinations: str = "destinations") -> DataFrame:
    """Records of which origin, a source or a destination domain hits, with the chain as text."""
    chain = F.array_compact(F.concat(F.coalesce(F.col(sources), F.array().cast("array<string>")), F.array(origin), F.coalesce(F.col(destinations), F.array().cast("array<string>"))))
    out = df.withColumn("chain", F.array_join(chain, " -> "))
    keys = F.flatten(F.transform(F.array_distinct(chain), lambda d: F.array(F.lower(d), registrable_domain(F.concat(F.lit("http://"), d)))))
    return out.withColumn("_k", F.explode(F.array_distinct(F.array_compact(keys)))).join(_kind(iocs, "domain"), F.col("_k") == F.col("ioc")).drop("_k")


def detected(df: DataFrame, hits: DataFrame, key: str = "record_id") -> DataFrame:
    """Records that some hit names, once each, with their indicators."""
    per = hits.groupBy(key).agg(F.array_sort(F.collect_set("ioc")).alias("iocs"))
    return df.join(per, key)


def detected_by_source(hits: DataFrame, source: str) -> DataFrame:
    """Indicators hit per source key (I14); a set of indicators, however many hits."""
    return hits.groupBy(source).agg(F.array_sort(F.collect_set("ioc")).alias("iocs"), F.count("*").alias("n"))
