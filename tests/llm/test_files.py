import gzip
import io
import random
import time

import numpy as np
import pytest

from terraload.llm import vector_files, warc
from terraload.llm.scratch import Scratch


def test_archives_in_ranges_of_any_size():
    rng = random.Random(4)
    payloads = [bytes(rng.choices(range(256), k=rng.choice([0, 10, 3000]))) for _ in range(60)] + [warc.record(5, None, b"inner", None, "d") * 3]
    members = [warc.record(i, "http://x/é y", p, None, "2000-01-01T00:00:00Z") for i, p in enumerate(payloads)]
    whole = b"".join(members)
    for size in (50, 700, 5000, len(whole)):
        got = []
        for start in range(0, len(whole), size):
            got += [warc._fields(c) for c in warc.members(io.BytesIO(whole), start, min(start + size, len(whole)))]
        assert [(f[0], f[1], f[6]) for f in got] == [(i, len(p), p) for i, p in enumerate(payloads)]


def test_a_broken_member_is_passed_over():
    members = [warc.record(i, None, b"payload %d " % i * 50, None, "d") for i in range(5)]
    broken = members[2][:30] + b"\0" * 20 + members[2][50:]
    raw = b"".join([*members[:2], broken, *members[3:], members[0][:40]])
    assert [warc._fields(c)[0] for c in warc.members(io.BytesIO(raw), 0, len(raw))] == [0, 1, 3, 4]


def test_round_trip(spark):
    rows = [(1, "http://a", "x"), (2, None, "x"), (3, "http://c\r\nX: y", "x"), (4, "u", None), (5, "u", ""), (6, "u", "é" * 70_000), (None, "u", "x"),
            (None, "u", "only nulls"), (7, "u", "again"), (7, "u", "again"), (8, "u", "z"), (9, "u", "again")]
    pages = spark.createDataFrame([(*r, "r", 1) for r in rows], "page_id long, url string, html string, record_type string, start int").repartition(3)
    got = sorted(warc.round_trip(pages).collect(), key=lambda r: (r.page_id is not None, r.page_id or 0, r.payload_bytes))
    assert [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got] == [
        (None, 1, "revisit", 3), (None, 10, "response", None), (1, 1, "revisit", 3), (2, 1, "revisit", 3), (3, 1, "response", None),
        (4, 0, "revisit", 5), (5, 0, "response", None), (6, 140_000, "response", None), (7, 5, "revisit", 9), (7, 5, "revisit", 9),
        (8, 1, "response", None), (9, 5, "response", None)]
    assert all(r.payload_digest == warc.payload_digest((dict((i, h) for i, _, h in rows if i)[r.page_id] or "").encode()) for r in got if r.page_id)
    bigger = warc.round_trip(pages, least_bytes=2)
    assert bigger.where("record_type = 'revisit'").count() == 2
    assert warc.round_trip(pages.where("false")).count() == 0


def exact(rows, is_query, k):
    best = []
    for q, v in rows:
        if is_query(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:k]
            best += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(best)


@pytest.mark.parametrize("spread", [1.0, 1e7])
def test_top_k(spark, monkeypatch, spread):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(vector_files, "STEP", 4)
    rows = [(i, (rng.normal(size=6) * spread).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(2000, [1.0, 2.0]), (2001, [])]
    odd = [(3000, None), (None, [1.0] * 6), (3001, [1.0, None]), (3002, [float("nan")]), (3003, [float("inf")]), rows[5]]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + odd], "vec_id long, embedding array<double>, rank int, score int").repartition(4)
    got = vector_files.top_k(table, "vec_id % 50 = 0", k=10, scale=16)
    whole = [(i, [int(np.floor(16 * x)) for x in v]) for i, v in rows]
    assert sorted(tuple(r) for r in got.collect()) == exact(whole, lambda i: i % 50 == 0, 10)
    assert vector_files.top_k(table.where("false"), "true").count() == 0
    assert vector_files.top_k(table.where("vec_id = 2000"), "true").count() == 0


def test_bounds_hold_and_save_reads(spark, tmp_path):
    rng = np.random.default_rng(9)
    ids, rows = np.arange(2000), np.floor(rng.normal(size=(2000, 16)) * 1000).astype(np.int64)
    path = Scratch(spark, "test").path("shard")
    vector_files.write_shard(path, ids, rows)
    shard = vector_files.Shard(path)
    assert (shard.low <= rows).all() and (rows <= shard.high).all()
    reads = []
    read = shard.exact
    shard.exact = lambda handle, some: reads.append(len(some)) or read(handle, some)
    for q, found, scores in shard.search(ids[:3], rows[:3], 10):
        order = np.lexsort((ids, -(rows @ rows[q])))
        assert found.tolist() == [i for i in order.tolist() if i != q][:10] and scores.tolist() == (rows[found] @ rows[q]).tolist()
    assert sum(reads) < 1000


def foreign(kind, block, *lines):
    head = "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:6b8f-%s>" % kind, *lines, "", ""])
    return gzip.compress(head.encode() + block + b"\r\n\r\n")


def test_archives_written_elsewhere():
    http = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n"
    members = [
        foreign("warcinfo", b"software: any", "Content-Type: application/warc-fields", "Content-Length: 13"),
        foreign("response", http + b"<p>", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + 3}", "WARC-Target-URI: http://x/"),
        foreign("revisit", b"", "Content-Type: application/http", "Content-Length: 0", "WARC-Refers-To: <urn:uuid:1>", "WARC-Payload-Digest: sha1:ABC"),
        foreign("revisit", http, "Content-Type: application/http", "Content-Length: x"),
        foreign("response", b"20240101\r\n\r\nx", "Content-Type: text/dns", "Content-Length: 13"),
        foreign("response", b"", "WARC-Record-ID: <urn:page:99999999999999999999>"), warc.record(4, None, b"own", None, "d")]
    whole = b"".join(members)
    for size in (1, 50, len(whole)):
        got = [warc._fields(c) for start in range(0, len(whole), size) for c in warc.members(io.BytesIO(whole), start, min(start + size, len(whole)))]
        got = [g for g in got if g is not None]
        assert [(g[0], g[1], g[3], g[4], g[6]) for g in got] == [
            (None, 3, "response", None, b"<p>"), (None, None, "revisit", None, b""), (None, None, "revisit", None, b""),
            (None, 13, "response", None, b"20240101\r\n\r\nx"), (None, 4, "response", None, b"\r\n\r\n"), (4, 3, "response", None, b"own")]
        assert got[1][2] == "ABC" and got[2][2] is None and got[1][7:9] == ("<urn:uuid:6b8f-revisit>", "<urn:uuid:1>")


def test_a_large_member_takes_linear_time():
    took = {}
    for megabytes in (8, 64):
        payload = random.Random(1).randbytes(1 << 20) * megabytes
        raw = warc.record(1, None, payload, None, "d")
        # Stored, so that the member is as large as its payload.
        started = time.process_time()
        [content] = list(warc.members(io.BytesIO(raw), 0, len(raw)))
        took[megabytes] = time.process_time() - started
        assert len(content) > len(payload)
    assert took[64] < 30 * took[8] + 1
