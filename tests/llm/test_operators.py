import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("stratavault.llm.registry")
from stratavault.llm import additive_quantisation, best_fit_packing, cover_tree_search, html_extraction, language_id, max_flow, minhash_dedup, secret_scan, source_mixing, substring_dedup, warc_chain, words
from stratavault.llm.common import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empties, repeats, copies, shared passages and one long text."""
    rng = random.Random(4)
    passage = prose(rng, 60, 10**6)
    texts = [None, "", " \t\n", "one", "ONE", "two  words"]
    texts += [prose(rng, rng.randrange(5, 200), 10**6) for _ in range(30)]
    texts += [f"{prose(rng, 20, 10**6)} {passage}\n{prose(rng, 15, 10**6)}" for _ in range(6)]
    base = prose(rng, 150, 10**6).split()
    for _ in range(8):
        copy = list(base)
        copy[rng.randrange(150)] = "changed"
        texts.append(" ".join(copy))
    texts += [texts[10]] * 5 + [prose(rng, 6000, 10**6)]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or ""), "e") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_words_equal_regex():
    texts = ["a b  c", "", "x", "\n yy zz\t", "é ü\x85k", None, " tail "]
    data, places = words.buffers(pa.array(texts))
    w = words.split(data, places)
    for i, t in enumerate(texts):
        got = [bytes(w.data[s:e]).decode() for s, e in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]])]
        assert got == SPLIT.findall(t or "")


def test_min_cut_against_all_cuts():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randrange(1, 7)
        s, t = ([rng.randrange(6) for _ in range(n)] for _ in "st")
        edges = [(a, b, rng.randrange(1, 5)) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(side):
            return sum(s[i] if not side[i] else t[i] for i in range(n)) + sum(w for a, b, w in edges if side[a] != side[b])

        assert cost(max_flow.min_cut(s, t, edges)) == min(cost([bits >> i & 1 for i in range(n)]) for bits in range(1 << n))


def test_html():
    page = """<html><head><title>t</title></head><body><nav><ul><li><a href=a>Home</a></ul></nav><div class="cookie-notice">We use cookies, please accept them now.</div>
    <div id="content"><h1>Big &eacute;vent</h1><p>First  paragraph, with <b>bold</b> words.<p>Short.</div><script>var t="</p>"</script>
    <aside class=sidebar><p>Other story that is long enough to look like text.</p></aside><section id="comments"><p>I think this is a great article, thanks.</p></section><footer>&copy; me</footer>"""
    assert html_extraction.extract(page) == "Big évent\nFirst paragraph, with bold words.\nShort."
    assert html_extraction.extract(None) == html_extraction.extract("") == html_extraction.extract("<nav><a href=x>y</a>") == ""


def test_language(spark, docs):
    rng = random.Random(1)
    kinds = {"xx": "abcde", "yy": "mnopq"}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(6)) for _ in range(30)), k, "s", 0, "e") for i in range(200) for k in [("xx", "yy")[i % 2]]]
    table = spark.createDataFrame(rows + [(900, None, "xx", "s", 0, "e"), (901, "12 !", "yy", "s", 0, "e")], DOCS)
    model = language_id.train(table)
    got = {r["doc_id"]: r for r in language_id.predict(table, model, ["doc_id"]).collect()}
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und"
    assert all(got[i]["lang_pred"] == k and 0 < got[i]["score"] <= 1 for i, _, k, *_ in rows)
    assert language_id.predict(table.limit(0), model, ["doc_id"]).count() == 0


def test_near_duplicates_against_brute_force(spark, docs):
    def shingles(text):
        w = SPLIT.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()

    sets = {d: shingles(t) for d, t in rows_of(docs)}
    of = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = of[a], of[b]
                of = {k: min(x, y) if v in (x, y) else v for k, v in of.items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(docs, shingle=2).collect()}
    assert got == {d: (len(s), of[d], of[d] == d) for d, s in sets.items()}
    odd = minhash_dedup.near_duplicates(spark.createDataFrame([(None, "a b c", None, None, 0, "")], DOCS)).collect()
    assert [(r["component_id"], r["kept"]) for r in odd] == [(None, True)]


def test_substring_dedup_against_brute_force(docs):
    texts = {d: SPLIT.findall(t or "") for d, t in rows_of(docs)}
    first = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - 12):
            first.setdefault(tuple(texts[d][i : i + 13]), d)
    expected = {}
    for d, w in texts.items():
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        expected[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    whole, cut = substring_dedup.remove_repeats(docs)
    got = {r["doc_id"]: (r["n_words"], 0, r["kept_sha256"]) for r in whole.collect()}
    got |= {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in cut.collect()}
    assert got == expected and any(n for _, n, _ in expected.values())


def test_packing(docs):
    rows = best_fit_packing.pack(best_fit_packing.cut_pieces(docs)).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= math.ceil(total / 1024) + 1
    from tokenizers import Tokenizer
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    for d, text in rows_of(docs):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[d], key=lambda r: r["piece"])
        assert sum(r["length"] for r in own) == len(ids) and [r["piece"] for r in own] == list(range(len(own)))
        assert all(r["length"] == 1024 for r in own[1:])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())


def test_packing_encodes_added_tokens(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mark, rng = "<|endoftext|>", random.Random(3)
    texts = [f"the tag {mark} ends a document", mark, mark * 3, f" {mark} ", f"a  {mark}\n\n{mark}b c", f"x{mark[:-1]} {mark}", f"{mark} ".join(["one two", "three  ", " four"] * 400)]
    texts += ["".join(rng.choice([mark, " ", "  ", "\n", "word", "It's", "\u3000", "é", "<|", "|>", "endoftext", "12"]) for _ in range(rng.randrange(30))) for _ in range(500)]
    rows = best_fit_packing.cut_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    own = {}
    for r in rows:
        own.setdefault(r["doc_id"], []).append(r)
    for d, text in enumerate(texts):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert sum(r["length"] for r in own[d]) == len(ids), text
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in own[d]), text


def test_warc_round_trip(spark):
    bad = "x WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.1\r\n tail"
    rows = [(1, "u", "hello"), (2, None, "hello"), (None, "v", "hello"), (5, "a\nb", bad), (6, "c", None), (8, "c", ""), (9, "z", "é" * 10)] + [(100 + i, "k", f"p{i}") for i in range(20)]
    path = new_path(spark, "test")
    warc_chain.write_archives(warc_chain.records(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)), path)
    got = warc_chain.read_archives(spark, path).collect()
    assert len(got) == len(rows) and all(r["intact"] in (True, None) for r in got)
    size = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got}
    assert size[5] == (len(bad), "response", None) and size[1] == (5, "revisit", 2) and size[None] == (5, "revisit", 2) and size[6] == (0, "revisit", 8) and size[9] == (20, "response", None)


def test_secrets():
    text = 'KEY = "abcd1234EFGH5678"\nclient_secret = KEY\npassword: hunter22x and AKIA' + "Z" * 16 + " " + "0af9" * 6
    kinds = [k for _, _, k in secret_scan.find_spans(text)]
    assert kinds == ["lexed", "assign", "access", "hex"]
    assert secret_scan.find_spans("password: token: abcdef") == [] and secret_scan.find_spans(None) == []
    assert secret_scan.spans_of(pa.array([None, "", "plain words", text])) == [[], [], [], secret_scan.find_spans(text)]
    assert secret_scan.redact("a token=abcdefgh12 b", secret_scan.find_spans("a token=abcdefgh12 b")) == "a [secret] b"


def test_secrets_under_any_sensitive_name():
    names = ["service.api.key", "access.key", "signing.key", "'private key'", "api--key", "pass_word", "pass-phrase", '"to\u212aen"', "'p w d'", "a.uthor.iz.ation", '"cred\u2014ent\u0130al"']
    texts = [f"# settings\n{name} = 'aB3dE5gH7jK9mN1p'\nport = 8080\n" for name in names]
    for text, found in zip(texts, secret_scan.spans_of(pa.array(["", *texts, None]))[1:]):
        at = text.index("aB3d")
        assert found == [(at, at + 16, "lexed")], text
    rng = random.Random(9)
    parts = ["api", "key", "pass", "word", "sec", "ret", "to", "ken", ".", "-", "_", " ", "'", '"', "\n", " = ", ": ", "'aB3dE5gH7jK9mN1p'", "K", "\u00e9"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) + rng.choice(["", " = 'aB3dE5gH7jK9mN1p'", ": x"]) for _ in range(5000)]

    def whole(text):  # both layers on every text, without a screen
        base = secret_scan.base_spans(text)
        extra = [x for x in secret_scan.lexed_spans(text) if not any(s <= x[0] and x[1] <= e for s, e, _ in base)]
        return sorted(base + extra, key=lambda x: (x[0], secret_scan.KINDS.index(x[2]), x[1]))

    got = secret_scan.spans_of(pa.array(texts))
    assert got == [whole(t) for t in texts] and sum(map(bool, got)) > 20


def test_base_spans_against_plain_patterns():
    rng = random.Random(12)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "=", ":", " ", '"', "'", "\n", "abc123", "x.y/z+", "AKIA", "Z9" * 8, "0af9" * 6, "deadbeef", "é", "K", "w "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(4000)]
    assign = r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)(?P<value>[A-Za-z0-9+/_.=-]+)"""
    plain = {"assign": (assign, 6, "value"), "access": (r"AKIA[A-Z0-9]+", 20, 0), "hex": (r"[0-9a-f]+", 24, 0)}
    seen = set()
    for text, spans in zip(texts, secret_scan.spans_of(pa.array(texts))):
        expected = {(*m.span(), kind) for kind, (p, least, part) in plain.items() for m in re.finditer(p, text, re.ASCII) if len(m[part]) >= least}
        assert {x for x in spans if x[2] != "lexed"} == expected, text
        seen |= {k for *_, k in expected}
    assert seen == set(plain)


def test_mixing(docs):
    one, two = ({(r["doc_id"], r["taken"]) for r in source_mixing.mix_sources(docs).collect()} for _ in "12")
    assert one == two
    rows = source_mixing.mix_sources(docs).collect()
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    assert source_mixing.water_fill([10, 100], [1, 1], 100, 2) == [20, 80]
    assert source_mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_makes_up_for_long_documents(spark):
    rng = random.Random(6)

    def texts(n, longest):  # sources of short documents and a long one
        return ["w " * rng.randrange(50, 180) for _ in range(n)] + ["w " * longest]

    rows = [(0, "a", t) for t in texts(700, 6000)] + [(0, "b", t) for t in texts(200, 20000)] + [(0, "c", t) for t in texts(3000, 4000)]
    table = spark.createDataFrame([(i, s, t) for i, (_, s, t) in enumerate(rows)], "doc_id long, source string, text string")
    for seed in range(3):
        got = source_mixing.mix_sources(table, weights=(80, 40, 350), share=0.45, chunk=500, seed=seed).collect()
        assert len(got) == len(rows) and len({r["doc_id"] for r in got}) == len(rows)
        for source in "abc":
            own = [r for r in got if r["source"] == source]
            assert 0 < own[0]["target"] < own[0]["source_size"]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1, (seed, source)
    out = source_mixing.landing([20000.0, *[100.0] * 100], [0.4, *[1.0, 0.0] * 50])  # more flips than a few, and no fewer than needed
    assert abs(out[0] * 20000 + sum(out[1:]) * 100 - 13000) <= 3000


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(700, None, 0), (701, [None] * 16, 0), (702, [float("nan")] * 16, 0), (703, [0.0] * 16, 0), (5, rows[5][1], 0)]
    return x.astype(np.float64), spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_cover_tree_is_exact(vectors):
    from pyspark.sql import functions as F

    x, table = vectors
    whole = np.vstack([np.floor(256 * x), np.zeros((1, 16))]).astype(np.int64)
    ids = np.r_[np.arange(600), 703]
    got = {}
    for r in cover_tree_search.search(table, F.col("vec_id") % 50 == 0, data_block=150).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(range(0, 600, 50))
    for q in got:
        s = whole @ whole[q]
        best = [(int(ids[i]), int(s[i])) for i in np.lexsort((ids, -s)) if ids[i] != q][:5]
        assert [got[q][k] for k in range(1, 6)] == best


def test_quantised_search_recall(vectors):
    from pyspark.sql import functions as F

    x, table = vectors
    found = {}
    for r in additive_quantisation.search(table, F.col("vec_id") % 20 == 0, books=6, words=16, rerank=100).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 600, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits / (30 * 20) >= 0.9
