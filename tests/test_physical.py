import hashlib
import os
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from stratavault.archive import Archive
from stratavault.functions import exprs as X
from stratavault.operators import archive as A
from stratavault.operators import backup as K
from stratavault.operators import bytes_ops as B
from stratavault.operators import physical as P
from stratavault.sources import config as C
from stratavault.sources import silo
from stratavault.sources import text as T
from stratavault.streaming import ingest

PAYLOAD = "seq long, payload binary"


def payloads(spark, bodies):
    return spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bodies)], PAYLOAD)


def made(spark, folder, **more):
    return Archive(spark, C.ArchiveConfig(**{"prefix": X.PREFIX, "directory": f"{folder}/", "max_size": 15360} | more), "2024-01-01T00:00:00Z")


def random_bodies(n, seed=1):
    rng = random.Random(seed)
    return [rng.randbytes(rng.randrange(1, 9000)) for _ in range(n)]


def refused(call, text):
    with pytest.raises(Exception, match=text):
        call()


def test_two_stores_keep_both(spark, tmp_path):
    a = made(spark, tmp_path)
    one, two = random_bodies(12), random_bodies(12, 2)
    a.store(payloads(spark, one))
    silos = a.next_silo()
    a.store(payloads(spark, one[:3] + two))
    assert a.next_silo() > silos
    got = {r["digest"] for r in a.get(spark.createDataFrame([(i, __import__("hashlib").sha256(b).hexdigest()[:32]) for i, b in enumerate(one + two)], "pos long, id string")).where("verified").collect()}
    assert len(got) == 24
    assert not [f for _, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".hold")]
    assert all(os.path.getsize(p) <= 15360 for p in silo.enumerate_silos(str(tmp_path)))
    assert a.audit().where("bad > 0").count() == 0 and P.audit_objects(a.records(body=True)).where("size(problems) > 0").count() == 0


def test_a_silo_is_never_replaced(spark, tmp_path):
    a = made(spark, tmp_path)
    a.make_silo(3)
    before = (tmp_path / "0" / "00000003.warc.gz").read_bytes()
    refused(lambda: a.make_silo(3), "there already")
    assert (tmp_path / "0" / "00000003.warc.gz").read_bytes() == before and os.listdir(tmp_path / "0") == ["00000003.warc.gz"]
    a.append_to(3, payloads(spark, [b"one", b"two"]))
    after = (tmp_path / "0" / "00000003.warc.gz").read_bytes()
    assert after.startswith(before) and [r["offset"] for r in a.records(silos=[3]).collect()][1] == len(before)
    refused(lambda: a.append_to(3, payloads(spark, [random.Random(1).randbytes(15360)])), "too large")
    refused(lambda: a.append_to(4, payloads(spark, [b"x"])), "no such silo")
    rows = spark.createDataFrame([("ab" * 16, {"WARC-Type": "resource"}, bytearray(b"x"))], "record_id string, headers map<string,string>, body binary").coalesce(1)
    for _ in range(2):  # without numbers, each write takes the next one
        rows.write.format("silo").mode("append").save(str(tmp_path / "flat"))
    assert len(silo.enumerate_silos(str(tmp_path / "flat"))) == 2


def test_store_rules(spark, tmp_path):
    a = made(spark, tmp_path, resource_types=("text/plain",))
    one = payloads(spark, [b"hello"])
    refused(lambda: a.store(payloads(spark, [b""]), mime_type="text/plain"), "empty input")
    refused(lambda: a.store(one), "illegal mime-type")
    refused(lambda: a.store(one, "warcinfo"), "illegal record type")
    refused(lambda: a.store(one, "metadata"), "need a reference")
    refused(lambda: a.store(one.withColumn("forced_id", F.lit("0" * 32))), "only metadata")
    refused(lambda: a.store(one.withColumn("refers_to", F.lit("0" * 32)), "metadata"), "does not exist")
    key = a.store(one, mime_type="text/plain").first()["id"]
    about = payloads(spark, [b"about it"]).withColumn("refers_to", F.lit(key))
    meta = a.store(about, "metadata").first()["id"]
    a.store(about.withColumn("payload", F.lit(b"more")).withColumn("forced_id", F.lit("AB" * 16)), "metadata")
    got = {r["record_id"]: r for r in a.records().where("warc_type = 'metadata'").collect()}
    assert set(got) == {meta, "ab" * 16} and got[meta]["refers_to"] == f"<{X.PREFIX}{key}>"
    assert a.audit().agg(F.sum("bad")).first()[0] == 1 and a.audit(ignore_metadata_id=True).agg(F.sum("bad")).first()[0] == 0
    # only warcinfo and continuations don't count as there
    info = a.records().where("warc_type = 'warcinfo'").first()["record_id"]
    assert [r["problem"] for r in a.get(spark.createDataFrame([(0, info), (1, "f" * 32)], "pos long, id string")).orderBy("pos").collect()] == ["ID is warcinfo segment", "ID not found"]


def test_commands(spark, tmp_path):
    a = made(spark, tmp_path)
    bodies = [b"a" * 40000, *random_bodies(5)]
    ids = [r["id"] for r in a.store(payloads(spark, bodies)).orderBy("seq").collect()]
    wanted = spark.createDataFrame(list(enumerate(ids)), "pos long, id string")
    out = tmp_path / "out"
    a.save(wanted, str(out))
    assert [(out / i).read_bytes() for i in ids] == bodies
    a.save(wanted, str(out), gzip=True)

    def unzipped(data):
        whole = b""
        while data:
            reader = zlib.decompressobj(31)
            whole += reader.decompress(data)
            data = reader.unused_data
        return whole

    assert [unzipped((out / f"{i}.gz").read_bytes()) for i in ids] == bodies
    before = sorted(map(tuple, a.index().collect()))
    a.housekeeping()
    a.housekeeping()
    assert sorted(map(tuple, a.index().collect())) == before
    os.rename(tmp_path / "index" / "sorted", tmp_path / "index" / "previous")  # as if broken off
    a.housekeeping()
    assert sorted(map(tuple, a.index().collect())) == before and sorted(os.listdir(tmp_path / "index")) in (["sorted"], ["appendix", "sorted"])
    seen = []
    assert a.visit("", lambda *row: seen.append(row) or len(seen) == 2) is True and len(seen) == 2
    assert a.info() == "id_size: 32" and '"id_size": 32' in a.info(True)
    assert a.dump_index(flags=X.RESOURCE | X.SEGMENTED | X.FIRST).count() == sum(len(b) > 15360 // 4 for b in bodies)
    refused(lambda: a.by_id(spark.createDataFrame([("xyz",)], "fragment string")).collect(), "invalid id fragment")
    lines = a.by_id(spark.createDataFrame([(ids[1],), (X.PREFIX + ids[2].upper(),), (ids[0] + "00",)], "fragment string")).collect()
    assert sorted(r["line"].split()[1] for r in lines) == sorted(ids[:3])
    assert a.by_id(spark.createDataFrame([("",)], "fragment string")).count() == len(before)


def test_fragments_of_every_length(spark):
    rng = random.Random(1)
    keys = [f"{rng.getrandbits(96):024x}" for _ in range(300)]
    index = spark.createDataFrame([(k, 4, 0, i, "0" * 8) for i, k in enumerate(keys)], "key string, flags int, silo int, offset long, cont string")
    frags = ["", "A", "0f", "123", keys[0], keys[1] + "00000000", keys[2][:13].upper()]
    got = sorted((r["fragment"], r["key"]) for r in A.by_id(index, spark.createDataFrame([(f,) for f in frags], "fragment string")).collect())
    assert got == sorted((f, k) for f in frags for k in keys if k.startswith(f[:24].lower()))


def test_reader_options_and_damage(spark, tmp_path):
    a = made(spark, tmp_path)
    a.store(payloads(spark, random_bodies(8)))
    path = silo.enumerate_silos(str(tmp_path))[0]
    rows = list(silo.read_silo(path, True, False, True))
    later = list(silo.read_silo(path, True, False, False, rows[1][2]))
    assert [r[2] for r in later] == [r[2] for r in rows[1:]] and all(zlib.decompress(r[19], 31) == r[17] for r in rows)
    assert all(r[21] - r[2] == r[15] + r[16] and r[22] == "WARC/1.1" and r[20] == len(r[17]) for r in rows)
    whole = open(path, "rb").read()
    head, size = rows[1][15], rows[1][16]
    at = rows[1][2] + head
    plain = bytearray(whole)
    plain[at + 16 : at + 20] = struct.pack("<I", size + 1)  # a wrong length field
    (tmp_path / "00000007.warc.gz").write_bytes(plain)
    assert any("bad gzip length" in (r[18] or "") for r in silo.read_silo(str(tmp_path / "00000007.warc.gz"), True, False))
    packer = zlib.compressobj(9, zlib.DEFLATED, 31)
    bare = packer.compress(b"body") + packer.flush()
    (tmp_path / "00000008.warc.gz").write_bytes(B.member(b"WARC/1.0\r\nWARC-Record-ID: <ab>\r\n\r\n", 0) + bare + silo.SEPARATOR)
    strict, lenient = (list(silo.read_silo(str(tmp_path / "00000008.warc.gz"), True, x)) for x in (False, True))
    assert "lacks its length" in strict[0][18] and lenient[0][17] == b"body" and lenient[0][18] is None


def test_enumeration_stops_at_a_missing_folder(tmp_path):
    for n in (0, 5, 99, 100, 350):
        path = tmp_path / silo.silo_folder(n) / f"{n:08d}.warc.gz"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"")
    assert [silo.silo_number(p) for p in silo.enumerate_silos(str(tmp_path))] == [0, 5, 99, 100]
    (tmp_path / silo.silo_folder(200)).mkdir(parents=True, exist_ok=True)
    assert [silo.silo_number(p) for p in silo.enumerate_silos(str(tmp_path))] == [0, 5, 99, 100, 350]


def test_rebuild_of_legacy_records(spark, tmp_path):
    source, out = tmp_path / "old", tmp_path / "new"
    source.mkdir()
    body = b"legacy body"
    (source / "00000000.warc.gz").write_bytes(
        silo.encode("ab" * 16, {"WARC-Type": "resource", "WARC-record-digest": "x", "Content-Length-GZIP": "9", "z": "zz", "Content-Length": "11"}, body)
        + silo.encode(__import__("hashlib").sha256(b"k").hexdigest()[:32], {"WARC-Type": "resource", "Content-Length": "1", "WARC-Block-Digest": "sha256:" + __import__("hashlib").sha256(b"k").hexdigest(), "z": "pad"}, b"k")
    )
    made(spark, source).rebuild(str(out))
    rows = made(spark, out).records(body=True).orderBy("offset").collect()
    assert [bytes(r["body"]) for r in rows] == [body, b"k"] and all("z" not in r["headers"] and "warc-record-digest" not in r["headers"] for r in rows)
    assert rows[0]["record_id"] == __import__("hashlib").sha256(body).hexdigest()[:32] and made(spark, out).audit().first()["bad"] == 0


def test_paths_names_and_dates(spark):
    numbers = [0, 5, 99, 100, 123, 12345, 10**6 - 1, 10**8, 2**31, 10**10 + 7]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", X.silo_path(F.col("n")).alias("p"), X.silo_path(F.col("n"), "s%03u", True).alias("h")).collect()
    assert all(r["p"] == f"{silo.silo_folder(r['n'])}{r['n']:08d}.warc.gz" for r in got)
    assert [r["h"] for r in got if r["n"] == 5] == ["0/s005.hold"]
    names = ["plain", "a\\303\\251b", "\\040x\\134", "\\360\\237\\230\\200", "é\\303\\251"]
    text = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(X.unvis(F.col("n"))).collect()]
    assert text == ["plain", "aéb", " x\\", "\U0001f600", "éé"]
    assert spark.range(1).select(X.warc_date(F.lit("2024-05-06 07:08:09").cast("timestamp"))).first()[0] == "2024-05-06T07:08:09Z"
    long = "f" * (1 << 21)
    row = spark.createDataFrame([(X.PREFIX + long,)], "t string").select(X.id_problem(F.col("t")).alias("p")).first()
    assert row["p"] == "too long"


def test_id_lists(spark, tmp_path):
    good = ["ab" * 16, X.PREFIX.upper() + "CD" * 16 + " and text", "", "01" * 16 + "tail"]
    (tmp_path / "a").write_text("\n".join(good) + "\n")
    (tmp_path / "b").write_text("23" * 16 + "\r\n")
    rows = T.id_list(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).orderBy("pos").collect()
    assert [r["id"] for r in rows] == ["ab" * 16, "cd" * 16, "01" * 16, "23" * 16] and rows[1]["line"] == good[1]
    for text, error in (("abc\n", "ID too short"), ("zz" * 16 + "\n", "Non-hex")):
        (tmp_path / "c").write_text(text)
        refused(lambda: T.id_list(spark, [str(tmp_path / "c")]).collect(), error)
    assert spark.createDataFrame([("a\rb\r\nc\n\n",)], "t string").select(T.assemble(F.col("t"))).first()[0] == ["a", "b", "c"]


def test_frames(spark):
    rng = random.Random(4)
    sent = [(rng.randrange(8), rng.randbytes(rng.choice([0, 1, 31, 32, 33, 255, 256, 70000]))) for _ in range(40)]
    rows = spark.createDataFrame([(i, c, bytearray(p)) for i, (c, p) in enumerate(sent)], "i long, cmd int, payload binary").select("i", T.frame(F.col("cmd"), F.col("payload")).alias("f")).orderBy("i").collect()
    stream = b"".join(bytes(r["f"]) for r in rows)
    assert list(T.parse_frames(stream)) == sent
    assert bytes(rows[0]["f"])[0] & 7 == sent[0][0]
    for end in (1, len(stream) - 1):
        with pytest.raises(ValueError):
            list(T.parse_frames(b"\xc0\x00"[:end] if end == 1 else stream[:-1] if sent[-1][1] else b"\x80"))


def test_manifest_rules():
    text = "# c\n/set type=file\n. type=dir\nempty sha256digest=" + T.EMPTY + "\na sha256digest=11\nsub type=dir\nb \\\n  sha256digest=22\n..\nlink type=link\n/set type=dir\nin\nc type=file sha256digest=33\n..\n..\n"
    assert list(T.parse_manifest(text.replace("# c\n", ""))) == [(".", "a", "11"), ("./sub", "b", "22"), ("./in", "c", "33")]


def test_cache_and_config(tmp_path):
    path = str(tmp_path / "cache")
    assert T.read_cache(path) == (0, 0)
    T.write_cache(path, 7, 2**32 - 1)
    assert T.read_cache(path) == (7, 2**32 - 1)
    (tmp_path / "short").write_bytes(b"abc")
    assert T.read_cache(str(tmp_path / "short")) == (0, 0)
    conf = tmp_path / "conf"
    conf.write_text("id.prefix:\n  https://x.org/\nwarcinfo.body:\n  operator: me\n")
    assert C.load(C.read(C.search(None, (str(tmp_path / "none"), str(conf))))).warcinfo == (("operator:", "me"),)
    assert C.search("given") == "given"
    for bad in (b"a\x00", b"\xc0\x80", b"\xf5"):
        conf.write_bytes(bad)
        with pytest.raises(C.ConfigError):
            C.read(str(conf))
    for missing in (lambda: C.read(str(tmp_path)), lambda: C.search(None, (str(tmp_path / "none"),))):
        with pytest.raises(C.ConfigError):
            missing()


def test_cipher_and_backup(spark, tmp_path):
    """The key stream is AES-256 (a published test vector), xor is its own inverse,
    and side files hold the digests of what was written."""
    import hashlib
    import hmac

    key, block = bytes.fromhex("603deb1015ca71be2b73aef0857d77811f352c073b6108d72d9810a30914dff4"), bytes.fromhex("6bc1bee22e409f96e93d7e117393172a")
    out = spark.range(1).select(F.substring(F.aes_encrypt(F.lit(block), F.lit(key), F.lit("ECB"), F.lit("PKCS")), 1, 16)).first()[0]
    assert bytes(out).hex() == "f3eed1bdb5d2a03c064b5a7e3db181f8"
    source, saved = tmp_path / "silos", tmp_path / "saved"
    source.mkdir()
    bodies = {f"{i:08d}.warc.gz": random.Random(i).randbytes(n) for i, n in enumerate((5, 16, 70000))}
    for name, body in bodies.items():
        (source / name).write_bytes(body)
    secrets = lambda name: (key, b"s" * 16)
    ledger = str(tmp_path / "ledger")
    rows = K.backup(spark, str(source), str(saved), ledger, 10**9, 100.0, secrets).collect()
    assert {r["fn"]: r["length"] for r in rows} == {k: len(v) for k, v in bodies.items()}
    for name, body in bodies.items():
        cipher = (saved / name).read_bytes()
        assert (saved / f"{name}.sha256").read_text() == f"SHA256 ({name}) = {hashlib.sha256(cipher).hexdigest()}\n"
        assert (saved / f"{name}.hmac").read_text().strip() == hmac.new(b"s" * 16, cipher, "sha256").hexdigest()
        first = int.from_bytes(hmac.new(b"s" * 16, name.encode(), "sha256").digest()[:16], "big")
        counters = [((first + k) % (1 << 128)).to_bytes(16, "big") for k in range(-(-len(body) // 16))][:40]
        pads = spark.createDataFrame([(k, bytearray(c)) for k, c in enumerate(counters)], "k int, c binary").select("k", F.substring(F.aes_encrypt("c", F.lit(key), F.lit("ECB"), F.lit("PKCS")), 1, 16).alias("p")).orderBy("k").collect()
        pad = b"".join(bytes(r["p"]) for r in pads)
        n = min(len(pad), len(body))
        assert bytes(a ^ b for a, b in zip(cipher[:n], pad)) == body[:n]
    # chunks at any place give the same cipher
    again = K.encrypt(K.scan(spark, str(source)), secrets, chunk=4096).orderBy("fn", "at").collect()
    assert {n: b"".join(bytes(r["cipher"]) for r in again if r["fn"] == n) for n in bodies} == {n: (saved / n).read_bytes() for n in bodies}
    assert K.backup(spark, str(source), str(saved), ledger, 10**9, 200.0, secrets).count() == 0
    (source / "00000001.warc.gz").write_bytes(b"longer than it was before")
    assert [r["fn"] for r in K.backup(spark, str(source), str(saved), ledger, 10**9, 300.0, secrets).collect()] == ["00000001.warc.gz"]
    assert "00000001.warc.gz 300.0 25" in open(ledger).read()


def test_streaming_goes_on(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    docs = "doc_id long, text string"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], docs).coalesce(1).write.parquet(source)
    assert {r["seq"] for r in ingest.stream_dedup(spark, source, folder=folder).collect()} == {1, 2}
    spark.createDataFrame([(4, "b"), (5, "c")], docs).coalesce(1).write.mode("append").parquet(source)
    assert {r["seq"] for r in ingest.stream_dedup(spark, source, folder=folder).collect()} == {1, 2, 5}
    assert {r["seq"] for r in ingest.stored_ids(spark, folder, 1).collect()} == {1, 2}  # what batch 1 compares itself with
    ingest.compact(spark, folder)
    assert {r["seq"] for r in ingest.stored_ids(spark, folder).collect()} == {1, 2, 5} and len(os.listdir(f"{folder}/stored")) == 1
    spark.createDataFrame([(6, "a"), (7, "d")], docs).coalesce(1).write.mode("append").parquet(source)
    assert {r["seq"] for r in ingest.stream_dedup(spark, source, folder=folder).collect()} == {1, 2, 5, 7}


def test_snapshot_of_a_folder(spark, tmp_path):
    a = made(spark, tmp_path / "arc")
    files = [("d", f"f{i}", bytearray(b)) for i, b in enumerate([b"one", b"two", b"one", b""])]
    rows = spark.createDataFrame(files, "dirname string, filename string, content binary")
    first = a.snapshot("home", rows, 5).first()
    stored = a.index().where("flags in (4, 8)").count()
    assert stored == 4 and first["manifest"] in first["report"] and '"time":5' in first["report"]
    a.snapshot("home", rows, 5)
    assert a.index().where("flags in (4, 8)").count() == stored  # nothing new


def test_listing_names_files_as_they_lie(spark, tmp_path):
    (tmp_path / "a" / "b c").mkdir(parents=True)
    for name, text in (("a/one", b"1"), ("a/b c/two.txt", b"22"), ("a/empty", b""), ("top", b"3")):
        (tmp_path / name).write_bytes(text)
    found = {(r.dirname, r.filename, r.digest) for r in T.listing(spark, str(tmp_path)).collect()}
    wanted = {("a", "one", b"1"), ("a/b c", "two.txt", b"22"), ("", "top", b"3")}
    assert found == {(d, n, hashlib.sha256(t).hexdigest()) for d, n, t in wanted}
    left = {r.filename for r in T.listing(spark, str(tmp_path), r"^a/b c/|^top$").collect()}
    assert left == {"one"}


def test_short_fragments_find_all_their_keys(spark):
    keys = [f"{n:03x}".ljust(24, "0") for n in range(0, 4096, 5)]
    index = spark.createDataFrame([(k, 4, i, i) for i, k in enumerate(keys)], "key string, flags int, silo int, offset long")
    fragments = ["", "A", "a", "a", "0a", "FFF", "0050"]
    found = A.by_id(index, spark.createDataFrame([(x,) for x in fragments], "fragment string"))
    assert sorted((r.fragment, r.key) for r in found.collect()) == sorted((x, k) for x in fragments for k in keys if k.startswith(x.lower()))


def test_reading_holds_some_megabytes(spark, tmp_path):
    """A reader's batches end by bytes, whatever the number of records in a partition."""
    rng = random.Random(5)
    bodies = [rng.randbytes(20_000) for _ in range(600)] + [b"x" * (5 << 20)]
    with open(tmp_path / "00000000.warc.gz", "wb") as out:
        for i, body in enumerate(bodies):
            out.write(silo.encode(f"{i:032x}", {"WARC-Type": "resource"}, body))
    for options in ({"body": "true"}, {"raw": "true"}):
        reader = silo._Reader({"path": str(tmp_path)} | options)
        batches = list(reader.read(reader.partitions()[0]))
        sizes = [sum(len(x.as_py() or b"") for name in ("body", "body_gz") for x in b.column(b.schema.names.index(name))) for b in batches]
        assert sum(b.num_rows for b in batches) == 601 and max(b.num_rows for b in batches) <= 1000
        assert max(sizes[:-1]) < 5 << 20 and len(sizes) > 2  # all but the record that is larger by itself
    back = spark.read.format("silo").option("body", "true").load(str(tmp_path)).select("record_id", "body", "headers").collect()
    assert sorted((int(r[0], 16), bytes(r[1])) for r in back) == list(enumerate(bodies)) and all(r[2] == {"warc-type": "resource"} for r in back)


def test_packed_objects(spark):
    rows = [("a", 1, bytearray(B.member(b"one"))), ("a", 2, bytearray(B.member(b"two" * 1000))), ("b", 1, bytearray(B.member(b"")))]
    got = {r["id"]: r["digest"] for r in P.digest_objects(spark.createDataFrame(rows, "id string, number int, body binary").withColumn("gz", F.lit(0)), packed=True).collect()}
    assert got == {"a": hashlib.sha256(b"one" + b"two" * 1000).hexdigest(), "b": hashlib.sha256(b"").hexdigest()}


def test_store_moves_payloads_once(spark):
    """Before encoding there is one window, which drops copies before its exchange; cutting needs none."""
    rows = spark.createDataFrame([(i, bytearray(b"%d" % (i % 7) * 40)) for i in range(50)], PAYLOAD).withColumns({"warc_type": F.lit("resource"), "content_type": F.lit("text/plain")})
    key = hashlib.sha256(b"3" * 40).hexdigest()[:24]
    present = spark.createDataFrame([(key, X.RESOURCE, 0, 0, "00000000"), (hashlib.sha256(b"4" * 40).hexdigest()[:24], X.WARCINFO, 0, 0, "00000000")], "key string, flags int, silo int, offset long, cont string")
    cut = A.segments(A.store_dedup(rows, present), 16)
    plan = cut._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window [") == 1 and "Partial" in plan.split("Window [")[1]
    got = {(r["seq"], r["number"]): (bytes(r["body"]), r["segment_id"], r["cont"], r["flags"]) for r in cut.collect()}
    want = {}
    for seq in (0, 1, 2, 4, 5, 6):
        whole = b"%d" % seq * 40
        parts = [whole[i : i + 16] for i in range(0, 40, 16)]
        ids = [hashlib.sha256(whole).hexdigest()[:32]] + [hashlib.sha256(p).hexdigest()[:32] for p in parts[1:]]
        for k, p in enumerate(parts):
            want[seq, k + 1] = (p, ids[k], ids[k + 1][:8] if k < 2 else "00000000", (52, 16, 80)[k])
    assert got == want


def test_equal_places_fill_several_silos(spark, tmp_path):
    a = made(spark, tmp_path)
    bodies = random_bodies(15)
    a.store(payloads(spark, bodies).withColumn("seq", F.when(F.col("seq") % 3 > 0, F.lit(0).cast("long"))))
    found = silo.enumerate_silos(str(tmp_path))
    assert len(found) > 3 and all(os.path.getsize(p) <= 15360 for p in found)
    stored = sorted(bytes(r["body"]) for r in a.records(body=True).where("warc_type <> 'warcinfo'").collect())
    assert stored == sorted(b[i : i + 3840] for b in bodies for i in range(0, len(b), 3840))  # segments of a quarter of a silo
    firsts = [next(silo.read_silo(p, False, False))[4] for p in found]
    assert set(firsts) == {"warcinfo"}


def test_writing_takes_batches(tmp_path, monkeypatch):
    import pyarrow as pa
    import pyspark

    class Context:
        partitionId, taskAttemptId = staticmethod(lambda: 2), staticmethod(lambda: 7)

    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: Context))
    records = [silo.encode(f"{i:032x}", {"WARC-Type": "resource"}, b"%d" % i) for i in range(6)]
    batches = [pa.RecordBatch.from_pydict({"silo": pa.array([k, k, k + 1], pa.int32()), "record": pa.array(r, pa.binary())}) for k, r in ((4, records[:3]), (6, records[3:]))]
    writer = silo._Writer({"path": str(tmp_path)})
    writer.commit([writer.write(iter(batches))])
    got = [int(r[3], 16) for p in silo.enumerate_silos(str(tmp_path)) for r in silo.read_silo(p, False, False)]
    assert got == list(range(6)) and len(os.listdir(tmp_path / "0")) == 4


def test_key_stream_of_a_chunk_is_one_value(spark):
    """Counters go through the cipher together, and carry into their upper half."""
    high = (1 << 128) - 3
    assert B.counters(high, 5) == b"".join(((high + k) % (1 << 128)).to_bytes(16, "big") for k in range(5))
    low = (7 << 64) - 2
    assert B.counters(low, 4) == b"".join((low + k).to_bytes(16, "big") for k in range(4)) and B.counters(9, 0) == b""
    rows = spark.createDataFrame([(b"k" * 32, B.counters(high, 5))], "key binary, counters binary")
    each = F.expr("substring(aes_encrypt(substring(counters, 33, 16), key, 'ECB', 'PKCS'), 1, 16)")
    r = rows.select(B.key_stream(F.col("counters"), F.col("key")).alias("stream"), each.alias("third")).first()
    assert len(r["stream"]) == 80 and r["stream"][32:48] == r["third"]


def test_a_stream_comes_in_even_files(spark, tmp_path):
    """Files of an incoming stream are bounded by bytes; their number grows with the rows."""
    rows = spark.createDataFrame([(i, bytearray(b"%06d" % i * 100)) for i in range(400)], PAYLOAD)
    few, many = (ingest.spread(rows, str(tmp_path / name), size) for name, size in (("few", 1 << 30), ("many", 24_000)))
    assert few == 3 and many == 10
    for name, n in (("few", 3), ("many", 10)):
        files = spark.read.parquet(str(tmp_path / name)).groupBy(F.input_file_name()).agg(F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high")).orderBy("low").collect()
        assert len(files) == n and sum(r["n"] for r in files) == 400 and all(a["high"] < b["low"] for a, b in zip(files, files[1:])) and max(r["n"] for r in files) < 800 // n
