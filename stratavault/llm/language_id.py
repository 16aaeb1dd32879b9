"""Language identification with hyperdimensional profiles.

Each symbol (letter or word bound) has a random bipolar vector.  A trigram's
vector binds (multiplies) its three letter vectors after permuting (rotating)
them by 2, 1 and 0 places; a language's prototype bundles (sums) the trigram
vectors of its training texts, and a document is compared with the prototypes
by cosine.

The cosine's dot product is linear in the document's trigram counts, so the
trained model stores, for every trigram, its dot product with each unit
prototype (symbols**3 rows); scoring a text is then a table lookup a letter and
needs no vector of full dimension.  The document vector's length uses the
near-orthogonality of random bindings: the root of the sum of squared counts.

Symbols: word bound, a to z (either case), and ``symbols - 27`` classes that
hash all other letters of any script.  Only letters and the bounds between
letter runs count.

Training texts: labelled rows, at most about ``sample`` of each language, drawn
by a hash of doc_id; the bound is the parameter ``sample``.  The driver gets
one count table of symbols**3 integers for each language.

Defined results: null text or no letter gives ``und`` and score 0; ties go to
the smaller language value; with no labelled row everything is ``und``;
repeated rows each get a row; a null doc_id is treated as the text ''.
"""

from __future__ import annotations

import math
from functools import lru_cache
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .words import buffers, pieces

SYMBOLS = 64
UNKNOWN = "und"


@lru_cache(1)
def _symbol_table() -> np.ndarray:
    """Symbol of every code point; 0 for what isn't a letter."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[cp] = low - 96 if 97 <= low <= 122 else 27 + (low * 0x9E3779B1 >> 7) % (SYMBOLS - 27)
    return out


def _decode(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts, and where each text begins among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = (data & 0xC0) != 0x80
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=before[1:])
    return points, before[places]


def _trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Trigram code at every place that has one, and the text of each."""
    data, places = buffers(column)
    points, at = _decode(data, places)
    n = len(places) - 1
    # one bound before each text and one behind, so that no trigram spans two texts
    symbols = np.zeros(len(points) + 2 * n, np.uint8)
    rows = np.repeat(np.arange(n), np.diff(at))
    symbols[np.arange(len(points)) + 2 * rows + 1] = _symbol_table()[points]
    rows = np.repeat(np.arange(n), np.diff(at) + 2)
    # runs of bounds become one
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0) | (rows[1:] != rows[:-1])
    symbols, rows = symbols[keep].astype(np.int32), rows[keep]
    if len(symbols) < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    codes = (symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:]
    good = (rows[:-2] == rows[2:]) & (symbols[1:-1] != 0)
    return codes[good], rows[:-2][good]


def _count(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), SYMBOLS**3), np.int64)
        index = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            text, lang = batch.column("text"), batch.column("lang").to_pylist()
            for a, b in pieces(text, 1 << 21):
                codes, rows = _trigrams(text.slice(a, b - a))
                of = np.array([index[x] for x in lang[a:b]], np.int64)
                for i in np.unique(of):
                    counts[i] += np.bincount(codes[of[rows] == i], minlength=SYMBOLS**3)
        for i, row in enumerate(counts):
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([i] * len(at), pa.int32()), "code": pa.array(at.astype(np.int32)), "n": pa.array(row[at])})

    return run


class Profiles:
    """Trained prototypes: ``dots[trigram, language]``."""

    def __init__(self, languages: list[str], dots: np.ndarray):
        self.languages, self.dots = languages, dots

    @classmethod
    def build(cls, languages: list[str], counts: np.ndarray, dimensions: int = 4096, seed: int = 11) -> Profiles:
        """Bind, bundle and normalise; then one dot product for each trigram."""
        letters = np.random.Generator(np.random.PCG64(seed)).choice(np.array([-1, 1], np.float32), (SYMBOLS, dimensions))
        first, second = np.roll(letters, 2, 1), np.roll(letters, 1, 1)
        dots = np.zeros((SYMBOLS**3, len(languages)), np.float32)
        for k in range(len(languages)):
            cube = counts[k].reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float32)
            prototype = np.zeros(dimensions, np.float64)
            for a in range(SYMBOLS):
                prototype += first[a] * (second * (cube[a] @ letters)).sum(0)
            prototype /= max(float(np.linalg.norm(prototype)), 1e-12)
            unit = prototype.astype(np.float32)
            for a in range(SYMBOLS):
                dots[a * SYMBOLS**2 : (a + 1) * SYMBOLS**2, k] = ((second * (first[a] * unit)) @ letters.T).ravel()
        return cls(languages, dots / math.sqrt(dimensions))

    def score(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and cosine (0 to 1) of each text."""
        n = len(column)
        codes, rows = _trigrams(column)
        best, value = np.zeros(n, np.int64), np.zeros(n)
        some = np.zeros(n, bool)
        if len(codes) and self.languages:
            at = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            sums = np.add.reduceat(self.dots[codes], at, axis=0, dtype=np.float64)
            key = np.sort(rows.astype(np.int64) << 18 | codes)
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            times = np.diff(np.r_[begin, len(key)]).astype(np.float64)
            of = key[begin] >> 18
            norm = np.sqrt(np.bincount(of, times * times, n))[rows[at]]
            some[rows[at]] = True
            best[rows[at]] = sums.argmax(1)
            value[rows[at]] = np.clip(sums.max(1) / norm, 0, 1)
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best, some)], value


def held_out(doc_id: F.Column) -> F.Column:
    """Whether a document is kept out of training: crc32(doc_id as text) mod 4 = 2."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample: int = 6000, dimensions: int = 4096) -> Profiles:
    """Profiles from the labelled rows of ``docs`` that aren't held out, about
    ``sample`` rows of each language at most."""
    rows = docs.select(F.col("doc_id").alias("d"), F.col("text"), F.col("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("d")))
    found = sorted((r[0], r[1]) for r in rows.groupBy("lang").agg(F.count(F.lit(1))).collect())
    languages = [x for x, _ in found if x != UNKNOWN]
    counts = np.zeros((len(languages), SYMBOLS**3), np.int64)
    if languages:
        draw = F.pmod(F.xxhash64(F.lit("draw"), F.col("d")), F.lit(1 << 20))
        limit = F.lit(0)
        for x, n in found:
            limit = F.when(F.col("lang") == x, F.lit(math.ceil((1 << 20) * min(1.0, sample / n)))).otherwise(limit)
        parts = rows.where(F.col("lang").isin(languages) & (draw < limit)).select("text", "lang").mapInArrow(_count(languages), "lang int, code int, n long")
        for r in parts.groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow().to_batches():
            np.add.at(counts, (r["lang"].to_numpy(), r["code"].to_numpy()), r["n"].to_numpy())
    return Profiles.build(languages, counts, dimensions)


def predict(docs: DataFrame, profiles: Profiles, keep: list[str], names_out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of ``docs`` and, for each row, the predicted language
    and its score under the names ``names_out``, which mustn't be among ``keep``.

    The model is a broadcast variable of fixed size (symbols**3 floats a language)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(profiles)
    inner = docs.select(*[F.col(c) for c in keep], F.col("text").alias("__text"))
    names = [f.name for f in inner.schema.fields][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(len(names))
            for a, b in pieces(text, 1 << 21):
                part = text.slice(a, b - a)
                lang, score = shared.value.score(part)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(names))), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, *names_out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1])
    return inner.mapInArrow(run, f"{kinds}, `{names_out[0]}` string, `{names_out[1]}` double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    with_part = docs.withColumn("held_out", held_out(F.col("doc_id")))
    return predict(with_part, train(docs), ["doc_id", "held_out"])
