"""The archive's configuration file and its values."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import files

_UNITS = {"": 0, "k": 1, "m": 2, "g": 3, "t": 4, "p": 5}


class ConfigError(ValueError):
    """A configuration that can't be used; nothing of it is kept."""


def parse(text: str) -> list[tuple[str, int, str, str | None]]:
    """(section, position, name, argument) of each entry.

    ``#`` begins a comment anywhere; ``name:`` at the line's start opens a
    section; indented lines are entries."""
    rows, section, seen, place = [], None, set(), 0
    for number, line in enumerate(text.splitlines(), 1):
        line = line.split("#", 1)[0].rstrip()
        if not line:
            continue
        if not line[0].isspace():
            if not line.endswith(":"):
                raise ConfigError(f"line {number}: section without a colon")
            section, place = line[:-1], 0
            if section.lower() in seen:
                raise ConfigError(f"line {number}: section {section!r} is there twice")
            seen.add(section.lower())
            continue
        if section is None:
            raise ConfigError(f"line {number}: entry before a section")
        name, _, argument = line.strip().partition(" ")
        rows.append((section, place, name, argument.strip() or None))
        place += 1
    return rows


def as_table(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse(text), "section string, pos int, name string, arg string")


def size(text: str) -> int:
    """Bytes of a size with a unit."""
    m = re.fullmatch(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*([kmgtp]?)b?\s*", text, re.IGNORECASE)
    if not m:
        raise ConfigError(f"invalid size {text!r}")
    return round(float(m[1]) * 1024 ** _UNITS[m[2].lower()])


@dataclass(frozen=True)
class ArchiveConfig:
    """Checked values of an archive."""

    prefix: str
    id_bits: int = 128
    directory: str = "./"
    basename: str = "%08u.warc.gz"
    max_size: int = 3758096384
    sort_size: int = 10 * 1024**2
    resource_types: tuple[str, ...] = ("*",)
    metadata_types: tuple[str, ...] = ("*",)
    segment_size: int | None = None  # bytes of an object's segment; a fourth of a silo if unset
    title: str = "Archive"
    warcinfo: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        if not self.prefix.endswith("/"):
            raise ConfigError("the id prefix must end with a slash")
        if not 64 <= self.id_bits <= 256 or self.id_bits % 4:
            raise ConfigError("id size must be 64 to 256 bits and a multiple of 4")
        if not self.directory.endswith("/"):
            raise ConfigError("the silo directory must end with a slash")
        if "/" in self.basename or len(re.findall(r"%0?\d*[udi]", self.basename)) != 1:
            raise ConfigError("the basename needs one number and no slash")
        if self.sort_size < 4096 or self.sort_size % 32:
            raise ConfigError("sort size must be 4k or more and a multiple of 32")

    @property
    def id_size(self) -> int:
        return self.id_bits // 4


def load(text: str) -> ArchiveConfig:
    """An archive's configuration from its file's text."""
    found: dict[str, list[tuple[str, str | None]]] = {}
    for section, _, name, argument in parse(text):
        found.setdefault(section.lower(), []).append((name, argument))

    def one(section: str, default: str | None = None) -> str | None:
        entries = found.get(section)
        if entries is None:
            return default
        if len(entries) != 1:
            raise ConfigError(f"section {section!r} needs exactly one entry")
        return entries[0][0]

    values: dict = {"prefix": one("id.prefix")}
    if values["prefix"] is None:
        raise ConfigError("no id prefix")
    if (bits := one("id.size")) is not None:
        values["id_bits"] = int(bits)
    for section, name in (("silo.directory", "directory"), ("silo.basename", "basename")):
        if (v := one(section)) is not None:
            values[name] = v
    for section, name in (("silo.max_size", "max_size"), ("index.sort_size", "sort_size")):
        if (v := one(section)) is not None:
            values[name] = size(v)
    for section, name in (("resource.mime-types", "resource_types"), ("metadata.mime-types", "metadata_types")):
        if section in found:
            values[name] = tuple(n for n, _ in found[section])
    if "warcinfo.body" in found:
        values["warcinfo"] = tuple((n, v or "") for n, v in found["warcinfo.body"])
    return ArchiveConfig(**values)


def read(path: str) -> str:
    """The text of a configuration file; bytes that no UTF-8 text holds, and
    anything but a file, are refused."""
    system, inner = files.split(path)
    if not system.get_file_info(inner).is_file:
        raise ConfigError(f"{path} is not a file")
    with system.open_input_stream(inner, compression=None) as file:
        data = file.read()
    if any(b in (0x00, 0xC0, 0xC1) or b > 0xF4 for b in data):
        raise ConfigError(f"{path} holds illegal bytes")
    return data.decode("utf-8")


def search(explicit: str | None = None, places: tuple[str, ...] | None = None) -> str:
    """The configuration to use: the one named, or the first that is there."""
    if explicit is not None:
        return explicit
    for place in places or (os.path.join(os.path.expanduser("~"), ".stratavault.conf"), "/etc/stratavault.conf", "/usr/local/etc/stratavault.conf"):
        if files.exists(place):
            return place
    raise ConfigError("no configuration found")


