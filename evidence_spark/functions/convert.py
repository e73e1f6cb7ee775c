"""Scalar conversions of artifact values: Columns in, Columns out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds from 1601-01-01 to 1970-01-01.
MICROS_1601 = 11_644_473_600_000_000
#: Seconds from 1970-01-01 to 2001-01-01.
SECONDS_2001 = 978_307_200


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _div(a: Column, n: int) -> Column:
    """Whole-number division without a detour over doubles."""
    return F.floor(a.cast("decimal(20,0)") / F.lit(n).cast("decimal(20,0)")).cast("long")


def filetime_to_ts(col: Column | str) -> Column:
    """100 ns ticks since 1601 -> timestamp; negative values are null."""
    v = _col(col).cast("long")
    return F.when(v >= 0, F.timestamp_micros(_div(v, 10) - MICROS_1601))


def webkit_to_ts(col: Column | str) -> Column:
    """Microseconds since 1601 -> timestamp."""
    return F.timestamp_micros(_col(col).cast("long") - MICROS_1601)


def mac_to_ts(col: Column | str, from_2001: bool = True) -> Column:
    """Seconds since 2001 (or 1970) -> timestamp; 18-digit whole numbers keep 9 digits, 0 is null."""
    text = _col(col).cast("decimal(38,6)").cast("string")
    whole = F.regexp_replace(text, r"\.0*$", "")
    v = F.when(whole.rlike(r"^\d{18}$"), F.substring(whole, 1, 9).cast("double")).otherwise(_col(col).cast("double"))
    v = F.when(v != 0, v)
    return F.timestamp_micros(F.round((v + (SECONDS_2001 if from_2001 else 0)) * 1_000_000).cast("long"))


def firefox_to_ts(col: Column | str) -> Column:
    """Microseconds since 1970 -> timestamp."""
    return F.timestamp_micros(_col(col).cast("long"))


def ole_to_ts(col: Column | str) -> Column:
    """Days since 1899-12-30 -> timestamp."""
    return F.timestamp_micros(F.round((_col(col).cast("double") - 25569) * 86_400_000_000).cast("long"))


def infer_year_utc(col: Column | str, ref_date: Column | str, tz: str = "Asia/Riyadh") -> Column:
    """``MM/dd HH:mm:ss`` in ``tz`` -> UTC; a month after the reference month is of last year."""
    c, ref = _col(col), _col(ref_date)
    year = F.year(ref) - (F.substring(c, 1, 2).cast("int") > F.month(ref)).cast("int")
    return F.to_utc_timestamp(F.try_to_timestamp(F.concat_ws("/", year.cast("string"), c), F.lit("yyyy/MM/dd HH:mm:ss")), tz)


def day_of_year_date(year: Column | str, n: Column | str) -> Column:
    return F.date_add(F.make_date(_col(year), F.lit(1), F.lit(1)), _col(n).cast("int") - 1)


def iso_micros(col: Column | str) -> Column:
    return F.date_format(_col(col), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def decode_flags(col: Column | str, flags: Mapping[int, str], sep: str = " ") -> Column:
    """Names of the set bits, in the order of ``flags``."""
    c = _col(col).cast("long")
    return F.concat_ws(sep, *[F.when(c.bitwiseAND(F.lit(bit).cast("long")) != 0, F.lit(name)) for bit, name in flags.items()])


#: Change reasons of a file-system journal.
USN_REASONS = {
    0x1: "DATA_OVERWRITE", 0x2: "DATA_EXTEND", 0x4: "DATA_TRUNCATION", 0x10: "NAMED_DATA_OVERWRITE",
    0x20: "NAMED_DATA_EXTEND", 0x40: "NAMED_DATA_TRUNCATION", 0x100: "FILE_CREATE", 0x200: "FILE_DELETE",
    0x400: "EA_CHANGE", 0x800: "SECURITY_CHANGE", 0x1000: "RENAME_OLD_NAME", 0x2000: "RENAME_NEW_NAME",
    0x4000: "INDEXABLE_CHANGE", 0x8000: "BASIC_INFO_CHANGE", 0x10000: "HARD_LINK_CHANGE", 0x20000: "COMPRESSION_CHANGE",
    0x40000: "ENCRYPTION_CHANGE", 0x80000: "OBJECT_ID_CHANGE", 0x100000: "REPARSE_POINT_CHANGE", 0x200000: "STREAM_CHANGE",
    0x80000000: "CLOSE",
}
#: File attributes.
FILE_ATTRIBUTES = {
    0x1: "READONLY", 0x2: "HIDDEN", 0x4: "SYSTEM", 0x10: "DIRECTORY", 0x20: "ARCHIVE", 0x40: "DEVICE", 0x80: "NORMAL",
    0x100: "TEMPORARY", 0x200: "SPARSE_FILE", 0x400: "REPARSE_POINT", 0x800: "COMPRESSED", 0x1000: "OFFLINE",
    0x2000: "NOT_CONTENT_INDEXED", 0x4000: "ENCRYPTED", 0x8000: "INTEGRITY_STREAM", 0x10000: "VIRTUAL", 0x20000: "NO_SCRUB_DATA",
}
#: Sources of a change.
USN_SOURCES = {0x1: "DATA_MANAGEMENT", 0x2: "AUXILIARY_DATA", 0x4: "REPLICATION_MANAGEMENT"}
#: Interface types by number.
INTERFACE_TYPES = {1: "IF_TYPE_OTHER", 6: "IF_TYPE_ETHERNET_CSMACD", 9: "IF_TYPE_ISO88025_TOKENRING", 23: "IF_TYPE_PPP", 24: "IF_TYPE_SOFTWARE_LOOPBACK", 37: "IF_TYPE_ATM", 71: "IF_TYPE_IEEE80211", 131: "IF_TYPE_TUNNEL", 144: "IF_TYPE_IEEE1394", 237: "IF_TYPE_IEEE80216_WMAN", 243: "IF_TYPE_WWANPP", 244: "IF_TYPE_WWANPP2"}
#: Logon response codes.
LOGON_CODES = {
    "0x0": "Successful login", "0xC0000064": "The specified user does not exist", "0xC000006A": "The value provided as the current password is not correct",
    "0xC000006C": "Password policy not met", "0xC000006D": "The attempted logon is invalid due to a bad user name", "0xC000006E": "User account restriction has prevented successful login",
    "0xC000006F": "The user account has time restrictions and may not be logged onto at this time", "0xC0000070": "The user is restricted and may not log on from the source workstation",
    "0xC0000071": "The user account's password has expired", "0xC0000072": "The user account is currently disabled", "0xC000009A": "Insufficient system resources",
    "0xC0000193": "The user's account has expired", "0xC0000224": "User must change his password before he logs on the first time", "0xC0000234": "The user account has been automatically locked",
}
#: Kinds of page visits.
VISIT_TYPES = {1: "LINK", 2: "TYPED", 3: "BOOKMARK", 4: "EMBED", 5: "REDIRECT_PERMANENT", 6: "REDIRECT_TEMPORARY", 7: "DOWNLOAD", 8: "FRAMED_LINK", 9: "RELOAD"}


def split_file_ref(col: Column | str) -> tuple[Column, Column]:
    """(sequence, entry): top 16 and low 48 bits."""
    c = _col(col).cast("long")
    return F.shiftrightunsigned(c, 48), c.bitwiseAND(F.lit((1 << 48) - 1))


def code_label(col: Column | str, mapping: Mapping, default: str | None = None) -> Column:
    """Label of a code by a fixed mapping."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, _col(col)), F.lit(default))


def interface_type(col: Column | str) -> Column:
    """Interface type name from the top 16 bits of a locally unique id."""
    return code_label(F.shiftrightunsigned(_col(col).cast("long"), 48).cast("int"), INTERFACE_TYPES)


def mode_bits(col: Column | str) -> tuple[Column, Column]:
    """(setuid, setgid) of an octal mode."""
    bits = F.conv(_col(col).cast("string"), 8, 10).cast("long")
    return bits.bitwiseAND(F.lit(0o4000)) != 0, bits.bitwiseAND(F.lit(0o2000)) != 0


def sid_to_string(col: Column | str) -> Column:
    """Binary security id -> ``S-revision-authority-sub-…`` (sub-authorities are little-endian)."""
    h = F.hex(_col(col))
    count = F.conv(F.substring(h, 3, 2), 16, 10).cast("int")

    def sub(i: Column) -> Column:
        at = lambda k: F.substring(h, 17 + 8 * i + 2 * k, F.lit(2))
        return F.conv(F.concat(at(3), at(2), at(1), at(0)), 16, 10)

    subs = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), sub))
    return F.concat_ws("-", F.lit("S"), F.conv(F.substring(h, 1, 2), 16, 10), F.conv(F.substring(h, 5, 12), 16, 10), subs)


def sid_name(col: Column | str, exact: Mapping[str, str], domain: Mapping[str, str], prefixes: Mapping[str, str]) -> Column:
    """Account name: exact id, else ``S-1-5-21-`` domain ids by their last part, else a prefix."""
    c = _col(col)
    by_tail = F.when(c.startswith("S-1-5-21-"), code_label(F.substring_index(c, "-", -1), domain)) if domain else F.lit(None)
    out = F.coalesce(code_label(c, exact) if exact else F.lit(None), by_tail)
    for start, name in prefixes.items():
        out = F.coalesce(out, F.when(c.startswith(start), F.lit(name)))
    return out


def hex_to_ipv4(col: Column | str) -> Column:
    """Address of the low 32 bits of a hex number."""
    h = F.lpad(F.right(_col(col), F.lit(8)), 8, "0")
    return F.concat_ws(".", *[F.conv(F.substring(h, k, 2), 16, 10) for k in (1, 3, 5, 7)])


def ipv6_to_mac(col: Column | str) -> Column:
    """Hardware address, in upper case, in an EUI-64 interface id given as 32 hex digits."""
    h = F.lower(_col(col))
    first = F.lpad(F.lower(F.conv(F.conv(F.substring(h, 17, 2), 16, 10).cast("long").bitwiseXOR(F.lit(2)).cast("string"), 10, 16)), 2, "0")
    parts = [first, *[F.substring(h, k, 2) for k in (19, 21, 27, 29, 31)]]
    return (
        F.when(h == "0" * 31 + "1", F.lit("Local Host ::1"))
        .when((h.startswith("fe80") | h.startswith("2001")) & (F.length(h) == 32), F.upper(F.concat_ws(":", *parts)))
        .otherwise(F.lit("Unable to convert data"))
    )


def rot13(col: Column | str) -> Column:
    a, z = "abcdefghijklmnopqrstuvwxyz", "nopqrstuvwxyzabcdefghijklm"
    return F.translate(_col(col), a + a.upper(), z + z.upper())


def extract_links(col: Column | str) -> Column:
    return F.regexp_extract_all(_col(col), F.lit(r"(?i)(https?://[^\s]+)"), F.lit(1))


def url_host(col: Column | str) -> Column:
    """Lower-cased host of a URL; null where there is none."""
    host = F.regexp_extract(_col(col), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.lower(F.when(host != "", host))


def url_domain(col: Column | str) -> Column:
    """Host without a leading ``www.``."""
    return F.regexp_replace(url_host(col), r"^www\.", "")


#: Public suffixes of two labels, where no table of rules is given. Any last label is a suffix.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "com.br", "com.cn", "co.in", "com.sa", "com.tr", "co.za")


def load_suffixes(text: str) -> list[str]:
    """Rules of a public suffix list: the first word of each line that is no ``//`` comment."""
    lines = (x.split() for x in text.splitlines() if not x.lstrip().startswith("//"))
    return [x[0].lower() for x in lines if x]


def registrable_domain(col: Column | str, rules: Sequence[str] = SUFFIXES) -> Column:
    """The public suffix of the host and the label before it (C20).

    ``rules`` are suffixes, ``*.suffix`` (any one label more is a suffix) and ``!name``
    (the name is none, in spite of a ``*`` rule). The longest rule that fits holds, an
    exception before all others. Hosts that are suffixes or addresses give null. Rules are
    looked up as hashed sets, once for each label of the host.
    """
    plain = sorted({r for r in rules if r[0] not in "*!"})
    wild = sorted({r[2:] for r in rules if r.startswith("*.")})
    names = sorted({r[1:] for r in rules if r.startswith("!")})
    host = F.regexp_replace(url_host(col), r"\.+$", "")
    labels = F.split(host, r"\.")
    n = F.size(labels)
    tail = lambda k: F.array_join(F.slice(labels, n - k + 1, k), ".")
    among = lambda k, known: tail(k).isin(known) if known else F.lit(False)
    every = F.sequence(F.lit(1), n)
    fits = F.filter(every, lambda k: among(k, plain) | ((k > 1) & among(k - 1, wild)))
    kept = F.array_max(F.filter(every, lambda k: among(k, names))) - 1
    size = F.coalesce(kept, F.array_max(fits), F.lit(1))
    return F.when(~host.rlike(r"^[0-9.]+$") & ~host.contains(":") & (n > size), tail(size + 1))


def is_shortened(col: Column | str, hosts: Sequence[str], whole_host: bool = False) -> Column:
    """Whether the host is among ``hosts``, without its leading ``www.`` unless ``whole_host``; null for null."""
    host = url_host(col) if whole_host else url_domain(col)
    return F.when(_col(col).isNotNull(), F.coalesce(host.isin(*hosts), F.lit(False)))


def clean_links(col: Column | str, skip_hosts: Sequence[str]) -> Column:
    """Links without trailing quotes and commas, without internal hosts, each once."""
    cut = F.transform(_col(col), lambda x: F.regexp_replace(x, "[',]+$", ""))
    return F.array_distinct(F.filter(cut, lambda x: ~F.coalesce(url_host(x).isin(*skip_hosts), F.lit(False))))


def folder_to_url(col: Column | str) -> Column:
    """Storage folder name -> URL; null for names that do not start with http."""
    c = _col(col)
    url = F.regexp_replace(F.regexp_replace(c, "^https_", "https://"), "^http_", "http://")
    return F.when(c.startswith("http"), F.substring_index(url, "_", 1))


def compact_time(col: Column | str) -> Column:
    """``yyyyMMddHHmmss…`` -> ISO text; null where it is no time."""
    return F.date_format(F.try_to_timestamp(F.substring(_col(col), 1, 14), F.lit("yyyyMMddHHmmss")), "yyyy-MM-dd'T'HH:mm:ss")


def offset_time_utc(col: Column | str) -> Column:
    """``yyyy-MM-dd HH:mm:ss[.SSS…] ±hhmm`` -> UTC timestamp (session zone UTC)."""
    return F.try_to_timestamp(_col(col), F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][.SS] Z"))
