import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from stratavault.operators import bytes_ops as B
from stratavault.plans import catalogue
from stratavault.sources import config as C
from stratavault.sources import silo

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({catalogue.ORACLES[name]})").fetchall()
    assert plain(tuple(r) for r in df.select(*columns).collect()) == plain(expected)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_first_fit_invariants(spark):
    rows = catalogue.QUERIES["q33_first_fit"](spark, SF).collect()
    total = {}
    for r in sorted(rows, key=lambda r: (r["shard"], r["silo"], r["offset"])):
        key = (r["shard"], r["silo"])
        assert r["offset"] == total.get(key, 0)
        total[key] = r["offset"] + r["length"]
    assert max(total.values()) <= 15360


def test_first_fit_is_first_fit():
    fit, rooms = B._Fit(10), []
    for need in (4, 7, 3, 3, 6, 1, 10, 2, 5):
        want = next((i for i, r in enumerate(rooms) if r >= need), len(rooms))
        if want == len(rooms):
            rooms.append(10)
        assert fit.put(need) == (want, 10 - rooms[want])
        rooms[want] -= need


def test_members_and_stitching():
    import zlib

    bodies = [b"a" * 1000, b"", os.urandom(500)]
    members = [B.member(b) for b in bodies]
    assert all(B.good_length(m) == len(m) for m in members)
    assert zlib.decompress(B.stitched(members, bodies), 31) == b"".join(bodies)


def test_config():
    text = "id.prefix:\n  https://x.org/\nsilo.max_size:\n  15k  # small\nresource.mime-types:\n  text/plain\n  *\n"
    # a comment sign cuts anything behind it, also inside addresses
    config = C.load(text)
    assert config.max_size == 15360 and config.id_size == 32 and config.resource_types == ("text/plain", "*")
    for bad in ("x\n", "  y\n", "a:\na:\n"):
        with pytest.raises(C.ConfigError):
            C.parse(bad)
    for bad in ({"prefix": "x"}, {"prefix": "x/", "id_bits": 62}, {"prefix": "x/", "basename": "a/%d"}, {"prefix": "x/", "sort_size": 100}):
        with pytest.raises(C.ConfigError):
            C.ArchiveConfig(**bad)


def test_silo_round_trip(spark, tmp_path):
    silo.register(spark)
    rows = [("ab%030d" % i, {"WARC-Type": "resource", "Content-Length": str(len(b))}, b) for i, b in enumerate([b"hello", b"", b"x" * 5000])]
    df = spark.createDataFrame(rows, "record_id string, headers map<string,string>, body binary").coalesce(1)
    df.write.format("silo").mode("append").save(str(tmp_path))
    back = spark.read.format("silo").option("body", "true").load(str(tmp_path)).collect()
    assert [(r["record_id"], bytes(r["body"]), r["error"]) for r in back] == [(i, b, None) for i, _, b in rows]
    heads = spark.read.format("silo").load(str(tmp_path)).collect()
    assert [r["offset"] for r in heads] == [r["offset"] for r in back] and all(r["body"] is None for r in heads)


def test_silo_damage_is_reported(tmp_path):
    path = tmp_path / "00000007.warc.gz"
    whole = B.member(b"WARC/1.1\r\nWARC-Record-ID: <ab>\r\n\r\n", 0) + B.member(b"body") + silo.SEPARATOR
    path.write_bytes(whole + whole[:-20])
    rows = list(silo.read_silo(str(path), True, False))
    assert rows[0][1] == 7 and rows[0][18] is None and rows[1][18]
