import random
import re
from collections import Counter

import pytest

pytest.importorskip("stratavault.llm.registry")
import corpus_pipeline
from stratavault.llm import source_mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def kept_rows(rows):
    """Brute force: the smallest doc_id (null last) of each class of near duplicates."""
    sets, of = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = of[a], of[b]
                of = [min(x, y) if v in (x, y) else v for v in of]
    classes = {}
    for i, c in enumerate(of):
        classes.setdefault(c, []).append(i)
    return [min(members, key=lambda i: (rows[i][0] is None, rows[i][0] or 0)) for members in classes.values()]


def test_language_drops_noise_and_keeps_languages(spark):
    rng = random.Random(1)

    def text(letters, n):
        return " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))

    kinds = {"xx": "abcdef", "yy": "mnopqr"}
    known = [(i, text(kinds[k], 40), k, "s", 0) for i in range(200) for k in [("xx", "yy")[i % 2]]]
    short = [(1000 + i, text(kinds[k], 1), None, "s", 0) for i in range(100) for k in [("xx", "yy")[i % 2]]]
    noise = [(2000 + i, text("ghijkl", rng.choice([2, 10, 60])), None, "s", 0) for i in range(300)]
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, spark.createDataFrame(known + short + noise, DOCS), "").collect()}
    assert kept == {r[0] for r in known + short}
    assert corpus_pipeline.language(spark, spark.createDataFrame(noise, DOCS), "").count() == len(noise)
    assert corpus_pipeline.language(spark, spark.createDataFrame([], DOCS), "").count() == 0


@pytest.mark.parametrize("unique", [True, False])
def test_dedup_decides_by_row(spark, unique):
    rng = random.Random(8)

    def prose():
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))

    base = [prose() for _ in range(12)]
    texts = base + [base[0], base[1], f"{base[2]} more", f"{base[3]} more", f"{base[4]} more", base[5], None, None, "", prose(), prose()]
    ids = list(range(100, 100 + len(texts)))
    if not unique:
        ids[6] = ids[7] = ids[8] = 50  # clean texts that share a doc_id
        ids[1] = ids[13] = ids[14] = ids[21] = ids[22] = ids[18] = None  # exact copies, a near copy and clean texts without one
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)]
    got = corpus_pipeline.dedup(spark, spark.createDataFrame(rows, DOCS), "")
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(rows[i][:2] for i in kept_rows(rows))
    assert corpus_pipeline.dedup(spark, spark.createDataFrame([], DOCS), "").count() == 0


def test_mix_decides_by_row(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 1000 + i]), f"t{i} " + "w " * rng.randrange(1, 60), "en", f"s{i % 3}", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    got = Counter(r["text"] for r in corpus_pipeline.mix(spark, docs, "").collect())
    targets = {r["source"]: r["target"] for r in source_mixing.mix_sources(docs).select("source", "target").distinct().collect()}
    for source, target in targets.items():
        own = [r[1] for r in rows if r[3] == source]
        assert abs(sum(got[t] * len(t.split()) for t in own) - target) <= 60
        assert max(got[t] for t in own) - min(got[t] for t in own) <= 1
    assert corpus_pipeline.mix(spark, spark.createDataFrame([], DOCS), "").count() == 0


def test_secrets_and_pack(spark):
    rows = [(1, "a token=abcdefgh12 b", "en", "s", 20), (1, "plain", "en", None, 5), (None, None, None, None, None), (None, "", "en", "s", 0)]
    masked = corpus_pipeline.secrets(spark, spark.createDataFrame(rows, DOCS), "")
    assert Counter(map(tuple, masked.collect())) == Counter([(1, "a [secret] b", "en", "s", 12), *rows[1:]])
    pieces = corpus_pipeline.pack(spark, masked, "").collect()
    assert Counter(r["doc_id"] for r in pieces) == {1: 2, None: 2}
    empty = spark.createDataFrame([], DOCS)
    assert corpus_pipeline.secrets(spark, empty, "").count() == corpus_pipeline.pack(spark, empty, "").count() == 0
