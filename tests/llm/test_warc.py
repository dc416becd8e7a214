"""Hostile and unusual WARC input, defined cases and SQL."""

import base64
import hashlib
import io
import random
import zlib

import pytest

from cairn.llm import op06_warc as W
from tests.llm.oracle import rows_of, rows_of_sql


def member(*raws):
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(b"".join(raws)) + packer.flush()


def raw(i, body=b"<p>x", **change):
    out = zlib.decompress(W.record(f"http://a/{i}", body, i, "t"), 31)
    for key, value in change.items():
        name = key.replace("_", "-").encode()
        head, _, tail = out.partition(b"\r\n\r\n")
        lines = [b"" if x.lower().startswith(name.lower() + b":") else x for x in head.split(b"\r\n")] + ([] if value is None else [name + b": " + value])
        out = b"\r\n".join(x for x in lines if x) + b"\r\n\r\n" + tail
    return out


def read(data, step=None, monkeypatch=None):
    if step:
        monkeypatch.setattr(W, "STEP", step)
    return list(W.members(io.BytesIO(data)))


@pytest.mark.parametrize("value", ["²", "-4", "", "1e3", "9" * 30, "٣"])
def test_lengths_that_are_no_numbers(value):
    rows = read(member(raw(1, Content_Length=value.encode())) + member(raw(2)))
    assert [r["status"] for r in rows] == ["bad header", "ok"]


def test_page_ids_that_are_no_numbers():
    for value, want in (("--5", None), ("-5", -5), ("²", None), (str((1 << 63) - 1), (1 << 63) - 1), (str(1 << 63), None), (str(-(1 << 63)), -(1 << 63))):
        rows = read(member(raw(1, X_Page_Id=value.encode())))
        assert [(r["status"], r["page_id"]) for r in rows] == [("ok", want)]


def test_digests_in_other_forms():
    block = W._HTTP + b"<p>x"
    good = [b"sha1:" + hashlib.sha1(block).hexdigest().encode(), b"SHA1:" + base64.b32encode(hashlib.sha1(block).digest()).lower(), b"sha-256:" + hashlib.sha256(block).hexdigest().upper().encode(), b"md5:" + hashlib.md5(block).hexdigest().encode(), b"blake9:zzz"]
    for value in good:
        assert [r["status"] for r in read(member(raw(1, WARC_Block_Digest=value)))] == ["ok"]
    for value in (b"sha1:" + b"0" * 40, b"md5:00", b"sha256:"):
        assert [r["status"] for r in read(member(raw(1, WARC_Block_Digest=value)))] == ["bad digest"]


def test_many_records_in_a_member(monkeypatch):
    rng = random.Random(1)
    bodies = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 5, 3000]))) for _ in range(40)]
    data = member(*[raw(i, b) for i, b in enumerate(bodies[:30])]) + member(raw(30, bodies[30])) + member(*[raw(i, bodies[i]) for i in range(31, 40)])
    for step in (1 << 16, 7):
        rows = read(data, step, monkeypatch)
        assert [(r["page_id"], r["payload"], r["status"]) for r in rows] == [(i, b, "ok") for i, b in enumerate(bodies)]
        assert [r["place"] for r in rows] == [*range(30), 0, *range(9)]
        ends = [r for r in rows if r["length"] is not None]
        assert [r["page_id"] for r in ends] == [29, 30, 39] and sum(r["length"] for r in ends) == len(data)


def test_a_record_of_bad_length_takes_the_rest_of_its_member():
    rows = read(member(raw(0), raw(1, Content_Length=b"3"), raw(2)) + member(raw(3)))
    assert [(r["page_id"], r["status"]) for r in rows] == [(0, "ok"), (1, "bad length"), (3, "ok")]
    rows = read(member(raw(0), raw(1, Content_Length=b"99999")) + member(b"") + member(raw(3)))
    assert [(r["page_id"], r["status"]) for r in rows] == [(0, "ok"), (1, "bad length"), (3, "ok")]


def test_random_damage_never_raises():
    rng = random.Random(2)
    data = b"".join(member(raw(i), raw(i + 100)) for i in range(6))
    for _ in range(300):
        bad = bytearray(data)
        for _ in range(rng.randint(1, 4)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        rows = read(bytes(bad[: rng.randint(1, len(bad))]))
        assert all(r["status"] in ("ok", "bad gzip", "truncated", "bad header", "bad length", "bad digest") for r in rows)


def test_round_trip_of_odd_pages_and_sql(spark, tmp_path):
    shape = "page_id long, url string, html string, uri string, payload string"
    rows = [(1, "http://a/1", "<p>ü"), (None, "http://a/2", "x"), (3, None, "y"), (4, "http://a/4", None), (4, "http://a/4", None), (5, "a\r\nb", ""), (6, "http://a/6", "long " * 50_000)]
    pages = spark.createDataFrame([(*r, "c", "c") for r in rows], shape)
    (tmp_path / "sf").mkdir()
    pages.write.parquet(f"{tmp_path}/sf/pages.parquet")
    found = W.query(spark, f"{tmp_path}/sf")
    clean = spark.createDataFrame([(i, None if u is None else u.replace("\r\n", ""), h) for i, u, h in rows], "page_id long, url string, html string")
    assert rows_of(found) == rows_of_sql(W.ORACLE_SQL, pages=clean)
    (tmp_path / "none").mkdir()
    pages.limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert W.query(spark, f"{tmp_path}/none").count() == 0
