"""Web archives, components, and the pipeline."""

import base64
import gzip
import hashlib
import os
import random
import zlib

import pytest

from trialweave.llm import warc
from trialweave.llm.components import components
from trialweave.llm.scratch import new_path

PAGES = "page_id bigint, url string, html string"


def through(spark, pages, min_bytes=0, archive_bytes=2000):
    first, second = new_path(spark, "warc"), new_path(spark, "members")
    warc.write_archives(pages, first, min_bytes, archive_bytes)
    warc.normalise(warc.archives(spark, first), first, second)
    return first, second


def local(folder, name):
    return open(f"{folder.removeprefix('file://')}/{name}", "rb").read()


def test_archives(spark):
    rows = [(k, f"http://x.example/{k} a\r\nb", f"<p>page {k % 7} é</p>" * (k % 7 * 30)) for k in range(60)] + [(60, None, None), (61, "http://y.example/", "")]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as body", "2 as name", "3 as _digest", "4 as first_id").repartition(3)
    first, second = through(spark, pages)
    got = {r["page_id"]: r for r in warc.page_records(spark, second, True).collect()}
    assert len(got) == len(rows)
    seen = {}
    for key, _, html in rows:
        data = (html or "").encode()
        own = seen.setdefault(data, key)
        r = got[key]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if own == key else ("revisit", own))
        assert r["payload"] == (bytearray(data) if own == key else None)
    listed = warc.archives(spark, first).collect()
    assert sum(r["records"] for r in listed) == len(rows) and len(listed) > 3
    for r in listed:
        assert gzip.decompress(local(first, r["name"])).count(b"WARC/1.1\r\n") == r["records"]
    places = warc.sidecar(spark, second).collect()
    assert len(places) == len(rows)
    for r in places:
        one = gzip.decompress(local(second, r["name"])[r["offset"] : r["offset"] + r["length"]])
        assert one.startswith(b"WARC/1.1\r\n") and r["record_id"].encode() in one


def test_records_in_small_pieces(monkeypatch):
    made = [warc.record(k, "http://a/", bytes([k]) * (k * 997), None, False) for k in range(12)]
    for piece in (1, 7, 1000, 1 << 20):
        monkeypatch.setattr(warc, "PIECE", piece)
        assert list(warc.records(warc.cut(warc.member(b"".join(made))))) == made
        assert list(warc.records(warc.cut(b"".join(map(warc.member, made))))) == made
    whole = warc.member(b"".join(made))
    for broken in (warc.member(made[3][:-9]), whole[:-5], whole[: len(whole) // 2], warc.member(b"HTTP/1.1 200 OK\r\n\r\n")):
        with pytest.raises(ValueError):
            list(warc.records(warc.cut(broken)))
    # a stream that is cut where a record ends
    pack = zlib.compressobj(wbits=31)
    with pytest.raises(ValueError):
        list(warc.records(warc.cut(pack.compress(made[1] + made[2]) + pack.flush(zlib.Z_SYNC_FLUSH))))


def test_archives_of_other_tools(spark):
    """Records of every kind, ids of other forms, records without digest or target, several members."""

    def one(kind, fields, block):
        head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Date: 2020-01-01T00:00:00Z", *fields, f"Content-Length: {len(block)}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    page = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<html>"
    made = [
        one("warcinfo", ["WARC-Record-ID: <urn:uuid:1>", "Content-Type: application/warc-fields"], b"software: some\r\n"),
        one("request", ["WARC-Record-ID: <urn:uuid:2>", "WARC-Target-URI: http://a/", "Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.1\r\n\r\n"),
        one("response", ["WARC-Record-ID: <urn:uuid:3>", "WARC-Target-URI: http://a/b\r\n c", "content-type: application/http;msgtype=response"], page),
        one("response", ["WARC-Record-ID: <urn:uuid:4>", "WARC-Payload-Digest: sha256:abc", "Content-Type: application/http"], page),
        one("revisit", ["WARC-Record-ID: <urn:uuid:5>", "WARC-Refers-To: <urn:uuid:3>"], b""),
        one("metadata", ["WARC-Record-ID: <urn:uuid:6>"], b"\xff\x00 anything"),
    ]
    source, target = new_path(spark, "foreign"), new_path(spark, "members")
    os.makedirs(source.removeprefix("file://"))
    with open(source.removeprefix("file://") + "/x.warc.gz", "wb") as f:
        f.write(warc.member(b"".join(made[:4])) + warc.member(b"".join(made[4:])))
    warc.normalise(spark.createDataFrame([("x.warc.gz",)], "name string"), source, target)
    got = {r["record_id"]: r for r in warc.read_archives(spark, target).collect()}
    html = base64.b32encode(hashlib.sha1(b"<html>").digest()).decode()
    assert [got[f"<urn:uuid:{k}>"]["record_type"] for k in range(1, 7)] == ["warcinfo", "request", "response", "response", "revisit", "metadata"]
    assert (got["<urn:uuid:3>"]["payload"], got["<urn:uuid:3>"]["payload_digest"]) == (bytearray(b"<html>"), html)
    assert got["<urn:uuid:4>"]["payload_digest"] == "sha256:abc" and got["<urn:uuid:5>"]["refers_to"] == "<urn:uuid:3>"
    assert got["<urn:uuid:6>"]["payload"] == bytearray(b"\xff\x00 anything") and got["<urn:uuid:1>"]["uri"] is None
    assert {r["record_id"] for r in warc.sidecar(spark, target).collect()} == set(got)
    assert warc.page_records(spark, target).count() == 0


def test_archive_odd_tables(spark):
    rows = [(1, "u", "same"), (1, "u", "same"), (None, None, "same"), (None, "v", None), (3, "w", "long enough to share")] + [(4, "w", "long enough to share")]
    _, second = through(spark, spark.createDataFrame(rows, PAGES), min_bytes=5)
    got = sorted((r["page_id"] or 0, r["record_type"]) for r in warc.page_records(spark, second).collect())
    assert got == [(0, "response"), (0, "response"), (1, "response"), (1, "response"), (3, "response"), (4, "revisit")]
    _, second = through(spark, spark.createDataFrame([], PAGES))
    assert warc.page_records(spark, second).count() == 0


def test_components_against_union_find(spark):
    r = random.Random(1)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(1000, 1001 + k) for k in range(300)] + [(2000 + k, 2001 + k) for k in range(70)] + [(5, None), (7, 7)]
    part = {x: x for p in links if None not in p and p[0] != p[1] for x in p}

    def find(x):
        return x if part[x] == x else find(part[x])

    for a, b in links:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            part[y] = x
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in part}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs, sizes = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in p.STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf).write.parquet(path)
        out = spark.read.parquet(path)
        if name != p.STAGES[-1][0]:
            assert out.columns == list(p.COLUMNS)
        if name in ("quality", "near_dedup", "clean_of_benchmark"):
            ids = [r["doc_id"] for r in out.select("doc_id").collect()]
            assert len(ids) == len(set(ids)) and set(ids) <= {r["doc_id"] for r in docs.select("doc_id").collect()}
            sizes.append((docs.count(), len(ids)))
        docs = out
    assert all(0 < b <= a for a, b in sizes) and sizes[0][1] < sizes[0][0] and sizes[1][1] < sizes[1][0]
    assert docs.count() > 0


def test_near_dedup_stage_takes_likeness_of_80(spark):
    """Pairs from below 0.80 to over 0.85, against brute force at 0.80."""
    import corpus_pipeline as p

    def shingles(text):
        w = text.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    rows, between = [], 0
    for k in range(24):
        words = [f"w{k}x{j}" for j in range(104)]
        changed = words[:]
        for at in range(20, 20 + 25 * (1 + k % 3), 25):
            changed[at] = f"c{k}x{at}"
        cut = k // 3
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed[cut:]))]
    gone = set()
    for (_, x), (b, y) in zip(rows[::2], rows[1::2], strict=True):
        both, either = len(shingles(x) & shingles(y)), len(shingles(x) | shingles(y))
        between += 80 * either <= 100 * both < 85 * either
        if 100 * both >= 80 * either:
            gone.add(b)
    assert between > 2 and len(gone) < 24
    docs = spark.createDataFrame([(k, x, "en", "s", len(x)) for k, x in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = {r["doc_id"] for r in p.near_dedup(spark, docs, "").collect()}
    assert left == {k for k, _ in rows} - gone


def test_stages_on_odd_tables(spark):
    """Nulls in every column, empty, long and repeated rows, clashing names, an empty table: what the docstrings say."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    long = " ".join(f"Word{k} of a very long text." for k in range(40_000))
    text = " ".join(f"word{k}" for k in range(30))
    rows = [(1, text, "en", "s1", 9), (1, text, "en", "s1", 9), (2, text, None, None, None), (3, None, "en", "s1", None), (4, "", "en", None, 0), (5, long, "de", "s2", 9), (None, text, "en", "s1", 9), (None, None, None, None, None), (6, "x", "en", "s1", 1), (6, "y", "en", "s1", 1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    names = ("score", "_quality_score", "_n_words", "_hits", "_mix_times", "_node", "_id", "component", "shard", "slot")
    docs = spark.createDataFrame(rows, schema).selectExpr("*", *[f"'other' as {n}" for n in names])
    got = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, sf)
        assert name == p.STAGES[-1][0] or out.columns == list(p.COLUMNS)
        got[name] = out.collect()
        assert stage(spark, docs.limit(0), sf).count() == 0
    ids = {name: sorted(str(r["doc_id"]) for r in out) for name, out in got.items()}
    kept = [[r["doc_id"] for r in got["quality"]].count(k) for k in (1,)]
    assert kept[0] in (0, 2)  # repeated rows all go or all stay
    assert ids["near_dedup"] == ["1", "3", "4", "5", "6", "6", "None", "None"]
    assert ids["clean_of_benchmark"] == sorted(str(r[0]) for r in rows)
    assert ids["mixture"].count("1") % 2 == 0  # rows of one id together, the last of them cut
    assert ids["sharding"] == sorted(str(r[0]) for r in rows)
    assert {r["size"] for r in got["sharding"] if r["doc_id"] in (3, 4)} == {1}
