"""Column expressions of the archive: identities, flags, paths, sizes, checks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "https://example.org/arc/"
ID_SIZE = 32

# Index flags (fixed values)
WARCINFO, RESOURCE, METADATA, SEGMENTED, FIRST, LAST = 0x02, 0x04, 0x08, 0x10, 0x20, 0x40


def digest(body: Column) -> Column:
    """SHA-256 as lower-case hex."""
    return F.sha2(body.cast("binary"), 256)


def digest_header(body: Column) -> Column:
    return F.concat(F.lit("sha256:"), digest(body))


def ident(body: Column, size: int = ID_SIZE) -> Column:
    """Identity of a resource, a continuation or a warcinfo record."""
    return F.substring(digest(body), 1, size)


def ref_header(ref: Column, prefix: str = PREFIX, size: int = ID_SIZE) -> Column:
    """A reference in angle brackets; a bare id gets the prefix."""
    full = F.when(F.length(ref) == size, F.concat(F.lit(prefix), ref)).otherwise(ref)
    return F.concat(F.lit("<"), full, F.lit(">"))


def ident_metadata(ref: Column, body: Column, size: int = ID_SIZE) -> Column:
    """Identity of metadata: of its reference and its payload digest together."""
    return F.substring(F.sha2(F.concat(ref_header(ref), F.lit("\n"), digest(body), F.lit("\n")).cast("binary"), 256), 1, size)


def coalesced_id(forced: Column, computed: Column) -> Column:
    return F.coalesce(F.lower(forced), computed)


def with_prefix(id_: Column, prefix: str = PREFIX) -> Column:
    return F.concat(F.lit(prefix), id_)


def bare_id(header: Column) -> Column:
    """The id in ``<prefix/id>``, any prefix; null if it isn't of that form."""
    found = F.regexp_extract(header, r"^<(?:.*/)?([0-9a-fA-F]+)>$", 1)
    return F.when(found != "", found)


def key_of(id_: Column) -> Column:
    """The index key: the first 24 digits."""
    return F.substring(F.lower(id_), 1, 24)


def type_flag(warc_type: Column) -> Column:
    return F.when(warc_type == "warcinfo", WARCINFO).when(warc_type == "resource", RESOURCE).when(warc_type == "metadata", METADATA).otherwise(0)


def segment_flags(warc_type: Column, number: Column, count: Column) -> Column:
    """Flags of segment ``number`` of ``count``."""
    first = type_flag(warc_type).bitwiseOR(F.lit(SEGMENTED | FIRST))
    return F.when(count == 1, type_flag(warc_type)).when(number == 1, first).when(number == count, SEGMENTED | LAST).otherwise(SEGMENTED).cast("int")


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def id_problem(text: Column, size: int = ID_SIZE, prefix: str = PREFIX) -> Column:
    """The first thing wrong with an id, null if nothing is."""
    bare = F.when(F.lower(F.substring(text, 1, len(prefix))) == prefix, F.substr(text, F.lit(len(prefix) + 1))).otherwise(text)
    return (
        F.when(bare.rlike("[:/]"), "wrong prefix")
        .when(~bare.rlike("^[0-9A-Fa-f]*$"), "not hexadecimal")
        .when(F.length(bare) < size, "too short")
        .when(F.length(bare) > size, "too long")
    )


def silo_path(number: Column, basename: str = "%08d.warc.gz", hold: bool = False) -> Column:
    """Path of a silo: a level folder, two digits a level, then its name."""
    number = number.cast("long")
    pairs = [F.format_string("%02d/", F.floor(number / 100**k) % 100) for k in range(9, 0, -1)]  # as many as a long has
    level = sum((F.when(number >= 100**k, 1).otherwise(0) for k in range(1, 10)), F.lit(0))
    used = F.slice(F.array(*pairs), 10 - level, level)
    folder = F.concat(level.cast("string"), F.lit("/"), F.when(level > 0, F.array_join(used, "")).otherwise(""))
    return F.concat(folder, F.format_string(re.sub(r"%(0?\d*)[ui]", r"%\1d", basename) + (".hold" if hold else ""), number))


def parse_size(text: Column, base: Column | None = None) -> tuple[Column, Column]:
    """Bytes of a size with a unit, and the error text where there is none."""
    clean = F.trim(text)
    number = F.regexp_extract(clean, r"^([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    rest = F.lower(F.trim(F.regexp_replace(clean, r"^[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?", "")))
    unit = F.regexp_extract(rest, r"^([kmgtp])?b?$", 1)
    power = F.when(unit == "k", 1).when(unit == "m", 2).when(unit == "g", 3).when(unit == "t", 4).when(unit == "p", 5).otherwise(0)
    problem = (
        F.when(clean == "", "missing number")
        .when(number == "", "invalid number")
        .when((rest == "%") & F.lit(base is None), "absolute number required")
        .when((rest != "%") & ~rest.rlike(r"^[kmgtp]?b?$"), "invalid suffix")
    )
    value = number.try_cast("double")
    scaled = value * F.pow(F.lit(1024.0), power)
    if base is not None:
        scaled = F.when(rest == "%", value * base / 100.0).otherwise(scaled)
    return F.when(problem.isNull(), F.round(scaled).cast("long")), problem


def header_number(text: Column) -> Column:
    """Decimal digits only, else -1; empty is 0."""
    return F.when(text.rlike("^[0-9]*$"), F.coalesce(text.try_cast("long"), F.lit(0))).otherwise(F.lit(-1))


def header_length(name: Column, value: Column) -> Column:
    return F.length(name) + F.length(value) + 4


def serialize_header(record_id: Column, headers: Column) -> Column:
    """Record id first, then the fields by name without case, CRLF line ends."""
    fields = F.array_sort(F.map_entries(headers), lambda a, b: F.when(F.lower(a["key"]) < F.lower(b["key"]), -1).when(F.lower(a["key"]) > F.lower(b["key"]), 1).otherwise(0))
    lines = F.transform(fields, lambda x: F.concat(x["key"], F.lit(": "), x["value"]))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Record-ID: <"), with_prefix(record_id), F.lit(">\r\n"), F.array_join(lines, "\r\n"), F.lit("\r\n\r\n"))


def predicted_place(key: Column, records: Column) -> Column:
    """Where interpolation expects a key: its 24-bit fraction of the records."""
    return F.floor(F.conv(F.substring(key, 1, 6), 16, 10).cast("long") * records / (1 << 24)).cast("long")


def bucket_bits(records: Column) -> Column:
    """Bits of the bucket directory for a number of records."""
    need = F.ceil(F.log2(F.greatest(records, F.lit(1)).cast("double"))).cast("int")
    return F.greatest(F.lit(14), need) - 12


def unvis(text: Column) -> Column:
    """Decode the octal escapes of a manifest name: bytes, then UTF-8."""
    parts = F.split(F.concat(F.lit("\\000"), text), r"\\(?=[0-7]{3})")
    parts = F.slice(parts, 2, F.size(parts) - 1)
    hexes = F.transform(parts, lambda p: F.concat(F.lpad(F.conv(F.substring(p, 1, 3), 8, 16), 2, "0"), F.hex(F.substr(p, F.lit(4)).cast("binary"))))
    return F.decode(F.unhex(F.substr(F.array_join(hexes, ""), F.lit(3))), "UTF-8")


def key_bytes(key: Column, n: int) -> Column:
    """The first ``n`` bytes of a hex key, short ones filled with zeros."""
    return F.unhex(F.rpad(F.substring(key, 1, 2 * n), 2 * n, "0"))


def warc_date(at: Column) -> Column:
    """UTC seconds as WARC writes them."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def wants_gzip(accept_encoding: Column) -> Column:
    return F.coalesce(F.contains(accept_encoding, F.lit("gzip")), F.lit(False))


def request_id(path_info: Column) -> Column:
    """A request's path without its leading slash."""
    return F.regexp_replace(path_info, "^/", "")


def silo_number(path: Column) -> Column:
    """The digits at the start of a silo's file name."""
    return F.regexp_extract(path, r"([0-9]+)[^/]*$", 1).try_cast("int")


def header_value(headers: Column, name: str) -> Column:
    """A field of a header map, names without case."""
    found = F.map_filter(headers, lambda k, _: F.lower(k) == name.lower())
    return F.element_at(F.map_values(found), 1)


def header_set(headers: Column, name: str, value: Column) -> Column:
    """The map with one field set, in place of any of that name in other case."""
    return F.map_concat(header_delete(headers, name), F.create_map(F.lit(name), value))


def header_delete(headers: Column, *names: str) -> Column:
    return F.map_filter(headers, lambda k, _: ~F.lower(k).isin([n.lower() for n in names]))


def mime_allowed(content_type: Column, allowed: list[str]) -> Column:
    """Whether an allow-list takes a type; ``*`` takes all, names without case."""
    if "*" in allowed:
        return F.lit(True)
    return F.lower(content_type).isin([x.lower() for x in allowed])
