import base64
import glob
import gzip
import hashlib

import pytest

from docketry.llm import warc

ROWS = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, "http://a/3", "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
    (4, None, None), (5, "http://a/5\r\nX: y", ""), (6, "http://é/", "é漢😀" * 40_000), (7, "http://a/7", "é漢😀" * 40_000), (8, "u", "<p>one</p>"),
    (9, "u", "\r\n\r\n"), (10, "u", "\n"), (11, "u", "same"), (11, "u", "same"), (None, "u", "same"), (None, None, "alone"), (12, "u", "x\0y"),
]


@pytest.fixture
def pages(spark):
    from pyspark.sql import functions as F

    def make(rows):
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
        for name in ("kind", "digest", "value", "payload", "r", "t", "u", "p"):
            df = df.withColumn(name, F.lit("x"))
        return df

    return make


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(rows, least=0):
    by = {}
    for k, (i, _, h) in enumerate(rows):
        by.setdefault(h or "", []).append((-1 if i is None else i, k))
    out = []
    for k, (i, _, h) in enumerate(rows):
        n, best = len((h or "").encode()), max(by[h or ""])
        first = n < least or best[1] == k
        out.append((i, n, digest(h), "response" if first else "revisit", None if first else rows[best[1]][0]))
    return sorted(map(repr, out))


@pytest.mark.parametrize("least", [0, 5])
def test_archives_read_back_as_brute_force(pages, least):
    out = warc.deduplicated_archive(pages(ROWS), least).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out]
    assert sorted(map(repr, got)) == brute(ROWS, least)


def test_archives_are_valid_and_complete(pages, spark, tmp_path):
    path = str(tmp_path / "out")
    warc.deduplicated_archive(pages(ROWS), path=path).collect()
    records = [x for f in glob.glob(f"{path}/part-*") for x in warc.parsed(gzip.open(f).read())]
    assert len(records) == len(ROWS)
    records = [(h, b) for h, _, b in records]
    names = {h["warc-record-id"] for h, _ in records}
    assert len(names) == len(ROWS)
    bodies = {b.split(b"\r\n\r\n", 1)[1].decode() for h, b in records if h["warc-type"] == "response"}
    assert bodies == {h or "" for _, _, h in ROWS}
    by_name = {h["warc-record-id"]: h for h, _ in records}
    for h, _ in records:
        if h["warc-type"] == "revisit":
            own = by_name[h["warc-refers-to"]]
            assert own["warc-type"] == "response"
            assert (h.get("warc-refers-to-target-uri"), h["warc-refers-to-date"]) == (own.get("warc-target-uri"), own["warc-date"])
    urls = {h.get("warc-target-uri") for h, _ in records}
    assert "http://a/5%0D%0AX: y" in urls


def test_resolving_again_changes_nothing(pages, spark, tmp_path):
    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    warc.deduplicated_archive(pages(ROWS), path=first).collect()
    warc.resolve_revisits(spark, first, second)
    columns = ["kind", "page_id", "url", "digest", "payload_bytes", "refers_page", "payload"]
    a, b = (sorted(map(repr, warc.read_archives(spark, p).select(*columns).collect())) for p in (first, second))
    assert a == b


def record(kind, name, block, **headers):
    lines = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: <urn:uuid:{name}>".encode(), b"WARC-Date: 2020-02-02T00:00:00Z"]
    lines += [f"{k.replace('_', '-')}: {v}".encode() for k, v in headers.items()]
    return b"\r\n".join([*lines, f"Content-Length: {len(block)}".encode()]) + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("how", ["one", "many", "plain"])
def test_archives_of_others(spark, tmp_path, how):
    """A member a record, other kinds of records, bytes that are no text, and a response without a digest."""
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    raw = [
        record("warcinfo", "i", b"software: some\r\n", Content_Type="application/warc-fields"),
        record("request", "q", b"GET / HTTP/1.1\r\n\r\n\xff\x00", Content_Type="application/http;msgtype=request", WARC_Target_URI="http://a"),
        record("response", "a", http + b"\xff\xfe body", Content_Type="application/http;msgtype=response", WARC_Target_URI="http://a"),
        record("response", "b", http + b"\xff\xfe body", Content_Type="application/http;msgtype=response", WARC_Target_URI="http://b"),
        record("response", "c", http + b"x" * 3_000_000, Content_Type="application/http;msgtype=response"),
    ]
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    data = b"".join(gzip.compress(r) for r in raw) if how == "many" else gzip.compress(b"".join(raw)) if how == "one" else b"".join(raw)
    (folder / ("x.warc" if how == "plain" else "x.warc.gz")).write_bytes(data)
    assert warc.read_archives(spark, str(folder)).count() == 5
    warc.resolve_revisits(spark, str(folder), out)
    back = {r.kind: [] for r in warc.read_archives(spark, out).collect()}
    rows = warc.read_archives(spark, out).collect()
    for r in rows:
        back[r.kind].append(r)
    assert {k: len(v) for k, v in back.items()} == {"warcinfo": 1, "request": 1, "response": 2, "revisit": 1}
    assert bytes(back["request"][0].payload).endswith(b"\xff\x00") and bytes(back["warcinfo"][0].payload) == b"software: some\r\n"
    assert {bytes(r.payload) for r in back["response"]} == {b"\xff\xfe body", b"x" * 3_000_000}
    visit = back["revisit"][0]
    assert visit.refers_url == ("http://b" if visit.url == "http://a" else "http://a") and visit.refers_date == "2020-02-02T00:00:00Z"


def test_large_records_have_archives_of_their_own(pages, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LARGE_BYTES", 1000)
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    rows = [(k, "u", f"{k} " * (1000 if k % 4 == 0 else 10)) for k in range(40)]
    path = str(tmp_path / "raw")
    warc.write_archives(pages(rows).coalesce(1), path)
    sizes = [len(gzip.open(f).read()) for f in glob.glob(f"{path}/part-*")]
    assert len(sizes) >= 10 and max(sizes) < 16_000
    assert warc.read_archives(spark, path).count() == 40


def test_damaged_archives_are_refused():
    with pytest.raises(ValueError):
        list(warc.parsed(warc.unpacked(gzip.compress(record("response", "a", b"abc"))[:-20])))
    with pytest.raises(ValueError):
        list(warc.parsed(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcdef\r\n\r\n"))


def test_empty_table(pages):
    assert warc.deduplicated_archive(pages([])).count() == 0


def test_a_payload_moves_for_archives_of_its_size_only(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(1, "u", "a" * 10), (2, "v", "b" * warc.LARGE_BYTES), (3, "w", "a" * 10)], "page_id long, url string, html string")
    raw = str(tmp_path / "raw")
    warc.write_archives(pages, raw)
    plans, write = [], warc._write

    def seen(records, path, largest, **options):
        plans.extend(records(of)._jdf.queryExecution().optimizedPlan().toString() for of in (warc._small, lambda size: ~warc._small(size)))
        write(records, path, largest, **options)

    monkeypatch.setattr(warc, "_write", seen)
    warc.resolve_revisits(spark, raw, str(tmp_path / "out"))
    for plan in plans:  # decided rows and payloads are both told apart by size before they meet
        assert plan.count(f"{warc.LARGE_BYTES}") >= 2
    got = warc.read_archives(spark, str(tmp_path / "out"), payloads=False)
    assert sorted((r.page_id, r.kind, r.refers_page) for r in got.collect()) == [(1, "revisit", 3), (2, "response", None), (3, "response", None)]
