"""Secret scanning by assignment-aware lexing.

Two layers look at every whole text.  The base layer finds three fixed kinds of
spans: ``assign``, ``access`` and ``hex``.  The lexing layer reads the text as
source code or configuration: it forms name-literal pairs from assignments,
mappings, keyword arguments and attributes, joins adjacent string literals,
propagates constants (a literal bound to one name and later used under another)
and scores each literal by how sensitive its target names are and how much it
looks like a key.  Literals at or over ``threshold`` become spans of kind
``lexed`` unless a base span already covers them.

Texts are screened first: a byte-level pass over the whole Arrow batch finds
texts that hold a long hexadecimal run, and substring searches over the letters
and digits alone, as names are scored, find the rest; only those run the exact
patterns, which then decide alone.

Defined results: null and empty texts have no spans; repeated rows each get
their row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .words import _LOWER, buffers, pieces

KINDS = ("assign", "access", "hex", "lexed")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_BASE_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

#: Names whose literals count as secrets, and how much.
_NAMES = (
    ("password", 1.0), ("passwd", 1.0), ("passphrase", 1.0), ("pwd", 0.9), ("secret", 1.0), ("token", 0.9), ("apikey", 1.0),
    ("accesskey", 0.9), ("privatekey", 1.0), ("credential", 0.8), ("authorization", 0.8), ("bearer", 0.8), ("signingkey", 0.9),
)
#: Letters that Unicode lowers to an ASCII letter (the Kelvin sign, dotted I), as UTF-8.
_ODD = ("\u212a".encode(), "\u0130".encode())
_DROPPED = re.compile(r"[^a-z0-9\n]+")

_TOKEN = re.compile(
    r"""(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<name>[A-Za-z_][A-Za-z0-9_.-]*)"""
    r"""|(?P<arrow>=>|:=|==|!=|<=|>=)|(?P<op>[=:+])|(?P<gap>[\x20\t]+)|(?P<other>[^\s"'A-Za-z_=:+!<>]+|.|\n)""",
    re.ASCII,
)
_BARE = re.compile(r"[A-Za-z0-9+/_.=~$@%-]+", re.ASCII)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The spans of the base layer as (start, end, kind), in no set order."""
    found = []
    low = text.lower() if text.isascii() else None
    if low is None or any(w in low for w in _BASE_WORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return found


def sensitivity(name: str) -> float:
    """How much a target name speaks for a secret (0: not at all)."""
    flat = re.sub(r"[^a-z0-9]", "", name.lower())
    return max((w for n, w in _NAMES if n in flat), default=0.0)


def may_bind(text: str) -> bool:
    """Whether some target name of the text can be sensitive: ``sensitivity``
    looks at letters and digits alone, so the text is searched without the rest.
    No name reaches over a line end."""
    flat = _DROPPED.sub("", text.lower())
    return any(n in flat for n, _ in _NAMES)


def key_likeness(literal: str) -> float:
    """0 to 1: length, character classes and entropy of a literal."""
    if len(literal) < 8 or literal.isspace() or re.search(r"\s", literal):
        return 0.0
    counts = [literal.count(c) for c in set(literal)]
    entropy = -sum(c / len(literal) * math.log2(c / len(literal)) for c in counts)
    classes = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, entropy / 4.0) * (0.55 + 0.15 * min(classes, 3))


def lex(text: str) -> list[tuple[str, str, int, int]]:
    """Name-literal pairs (name, literal, start, end of the literal's text).

    ``name = "..."``, ``name: ...``, ``"name" => ...`` and ``name=bare`` bind; a
    bare identifier on the right binds the literals known under that name."""
    tokens = [(m.lastgroup, m.start(), m.end()) for m in _TOKEN.finditer(text) if m.lastgroup != "gap"]
    pairs: list[tuple[str, str, int, int]] = []
    known: dict[str, list[tuple[str, int, int]]] = {}
    i, n = 0, len(tokens)
    while i + 2 < n:
        kind, a, b = tokens[i]
        op = text[tokens[i + 1][1] : tokens[i + 1][2]]
        if kind not in ("name", "string") or op not in ("=", ":", ":=", "=>"):
            i += 1
            continue
        name = text[a:b].strip("\"'")
        j = i + 2
        values: list[tuple[str, int, int]] = []
        if tokens[j][0] == "string":
            while j < n and tokens[j][0] == "string":  # adjacent and added literals are one value in parts
                values.append((text[tokens[j][1] + 1 : tokens[j][2] - 1], tokens[j][1] + 1, tokens[j][2] - 1))
                j += 1
                if j + 1 < n and text[tokens[j][1] : tokens[j][2]] == "+" and tokens[j + 1][0] == "string":
                    j += 1
        else:
            m = _BARE.match(text, tokens[j][1])
            if m:
                word = m.group()
                if word in known:
                    values = known[word]
                elif re.search("[0-9]", word):
                    values = [(word, m.start(), m.end())]
        if values:
            whole = "".join(v for v, _, _ in values)
            known[name] = values
            pairs += [(name, whole, s, e) for _, s, e in values if e > s]
        i = max(i + 1, j - 1 if values and tokens[j - 1][0] != "name" else i + 1)
    return pairs


def lexed_spans(text: str, threshold: float = 0.6) -> list[tuple[int, int, str]]:
    """Spans of literals whose best target name and shape score high enough."""
    best: dict[tuple[int, int], float] = {}
    for name, literal, start, end in lex(text):
        s = sensitivity(name)
        if s:
            best[start, end] = max(best.get((start, end), 0.0), s * key_likeness(literal))
    return [(s, e, "lexed") for (s, e), score in best.items() if score >= threshold]


def uncovered(spans: list[tuple[int, int, str]], by: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans that don't lie within one of ``by``."""
    starts, ends = [], []  # ends: the furthest end of what starts there or before
    for s, e, _ in sorted(by):
        starts.append(s)
        ends.append(max(e, ends[-1] if ends else 0))
    found = [bisect_right(starts, s) - 1 for s, _, _ in spans]
    return [x for x, k in zip(spans, found) if k < 0 or ends[k] < x[1]]


def find_spans(text: str | None, threshold: float = 0.6) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then kind as listed; code points, end exclusive."""
    if not text:
        return []
    base = base_spans(text)
    extra = []
    if may_bind(text):
        extra = uncovered(lexed_spans(text, threshold), base)
    return sorted(base + extra, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


_IS_HEX = np.zeros(256, bool)
_IS_HEX[[*b"0123456789abcdef"]] = True


def _long_runs(data: np.ndarray, places: np.ndarray, least: int = 24) -> np.ndarray:
    """Texts that may hold a run of ``least`` hexadecimal digits."""
    out = np.zeros(len(places) - 1, bool)
    step = least // 2
    probe = _IS_HEX[data[::step]]  # a run of 24 covers two neighbours among every twelfth byte
    at = np.flatnonzero(probe[:-1] & probe[1:]) * step
    if len(at):
        full = np.ones(len(at), bool)
        for j in range(1, step):
            full &= _IS_HEX[data[at + j]]
        out[np.searchsorted(places, at[full], side="right") - 1] = True
    return out


_FLAT = np.zeros(256, bool)
_FLAT[[*b"abcdefghijklmnopqrstuvwxyz0123456789\n"]] = True


def _marked(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Texts that hold a sensitive name, whatever stands between its letters, or
    AKIA.  Every base pattern holds such a name."""
    out = np.zeros(len(places) - 1, bool)
    low = _LOWER[data]
    keep = _FLAT[low]
    flat_places = np.r_[0, np.cumsum(keep)][places]
    flat, raw = low[keep].tobytes(), data.tobytes()
    for whole, starts, mark in [(flat, flat_places, n.encode()) for n, _ in _NAMES] + [(raw, places, m) for m in (b"AKIA", *_ODD)]:
        at = whole.find(mark)
        while at >= 0:
            row = int(np.searchsorted(starts, at, side="right")) - 1
            out[row] = True
            at = whole.find(mark, int(starts[row + 1]))  # a hit that spans two texts only adds a candidate
    return out


def spans_of(texts: pa.Array, threshold: float = 0.6) -> list[list[tuple[int, int, str]]]:
    """find_spans for a column, with the batch-level screen in front."""
    data, places = buffers(texts)
    chosen = _long_runs(data, places) | _marked(data, places)
    return [find_spans(texts[i].as_py(), threshold) if hit else [] for i, hit in enumerate(chosen.tolist())]


SPAN = "array<struct<start:int,end:int,kind:string>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def scan(docs: DataFrame, keep: list[str], threshold: float = 0.6) -> DataFrame:
    """The columns ``keep`` of ``docs`` and each row's spans."""
    inner = docs.select(*[F.col(c) for c in keep], F.col("text").alias("__text"))
    fields = inner.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(len(fields))
            for a, b in pieces(text, 1 << 21):
                spans = [[{"start": s, "end": e, "kind": k} for s, e, k in x] for x in spans_of(text.slice(a, b - a), threshold)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(fields))), pa.array(spans, _SPAN)], names=[*(f.name for f in fields), "found"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    return inner.mapInArrow(run, f"{kinds}found {SPAN}")


def redact(text: str | None, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str | None:
    """The text with every span (overlaps joined) replaced by ``mark``."""
    if not spans:
        return text
    out, at = [], 0
    end = -1
    for s, e, _ in spans:
        if s >= end:
            if end >= 0:
                out.append(mark)
                at = end
            out.append(text[at:s])
        end = max(end, e)
    out += [mark, text[end:]]
    return "".join(out)


def redact_documents(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """``docs`` with every span in ``text`` masked, and ``n_chars``, if there,
    counted anew for the rows that changed."""
    fields = docs.schema.fields
    names = [f.name for f in fields]
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(place), 1 << 21):
                part = batch.slice(a, b - a)
                text = part.column(place)
                changed = {i: redact(text[i].as_py(), found) for i, found in enumerate(spans_of(text, threshold)) if found}
                columns = list(part.columns)
                if changed:
                    columns[place] = pa.array([changed.get(i, x) for i, x in enumerate(text.to_pylist())], text.type)
                    if "n_chars" in names:
                        at = names.index("n_chars")
                        columns[at] = pa.array([len(changed[i]) if i in changed else x for i, x in enumerate(columns[at].to_pylist())], columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, with counts and a digest of the base layer."""
    found = scan(table(spark, sf_dir, "documents"), ["doc_id"])

    def of(kind: str) -> F.Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")

    def joined(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    base = F.filter("found", lambda x: x["kind"] != "lexed")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
