import gzip
import hashlib

import pytest
from sql_compare import connect, same

from lineal.llm import common, queries, warc


def test_chunked_framing():
    for n in (0, 1, 4095, 4096, 4097, 20_000):
        data = bytes(i % 251 for i in range(n))
        assert warc.dechunk(warc.chunked(data)) == data
    assert warc.dechunk(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for bad in (b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabcX0\r\n\r\n", b"zz\r\n", b""):
        with pytest.raises(ValueError):
            warc.dechunk(bad)


def pages():
    long = "<p>é</p>" * 9000
    return [(5, "http://a", long), (3, "http://b", long), (9, None, long), (1, "u\r\nX: y", "tiny"), (2, "u", "tiny"), (4, "u", None), (6, "u", ""), (7, "u", "WARC/1.1\r\n\r\n\r\n\r\n" * 40), (8, "u", "x" * 100), (10, "u", "x" * 100), (11, "u", "x" * 99), (12, "u", "x" * 99)]


def test_round_trip(spark, frame):
    rows = pages()
    df = frame([(k, u, h, "r") for k, u, h in rows], "page_id long, url string, html string, record_type string")
    got = {r.page_id: r for r in warc.archive_round_trip(df).collect()}
    for k, _, h in rows:
        b = (h or "").encode()
        same_ = [q for q, _, x in rows if (x or "") == (h or "")]
        first = min(same_) if len(b) >= 100 else k
        r = got[k]
        assert (r.record_type, r.refers_to) == (("response", None) if k == first else ("revisit", first))
        assert r.digest == hashlib.sha256(b).hexdigest() and r.length == len(b)
        assert r.payload is None if k != first else bytes(r.payload) == b
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_query_is_its_sql(spark, frame, tmp_path):
    frame(pages(), "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name in ("op9_warc", "op2_url_filter"):
        same(queries.QUERIES[name](spark, str(tmp_path)), c, queries.ORACLES[name])


def _archive(spark, records):
    path = common.fresh_path(spark, "broken")
    import os

    local = path.removeprefix("file://")
    os.makedirs(local)
    with gzip.open(f"{local}/a.warc.gz", "wb") as f:
        f.write(b"".join(r + b"\r\n\r\n" for r in records))
    return path


def test_broken_segments_raise(spark):
    records = warc.records_of("1#0-1", "u", b"p" * 50_000, "0" * 64, None, 10_000)
    assert len(records) > 3
    whole = warc.read_warc(spark, _archive(spark, records[::-1])).collect()
    assert len(whole) == 1 and bytes(whole[0].payload) == b"p" * 50_000
    for broken in (records[:-1], records[1:], [*records, records[1]], [records[0], *records[2:]]):
        with pytest.raises(Exception, match="segments missing"):
            warc.read_warc(spark, _archive(spark, broken)).collect()


def test_null_keys_and_repeated_long_rows(frame):
    """No two records share an identifier, so segments of equal rows don't mix; a null key is never the first of its payload."""
    long, other = "<p>x</p>" * 9000, "<q>y</q>" * 9000
    rows = [(None, "u", long), (7, "u", long), (7, "u", long), (None, "u", other), (None, "u", other), (None, "u", None), (3, None, "short")]
    got = warc.archive_round_trip(frame(rows, "page_id long, url string, html string")).collect()
    told = sorted(((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to or 0, r.length, None if r.payload is None else bytes(r.payload).decode()) for r in got), key=lambda x: (*x[:5], x[5] or ""))
    want = [(False, 3, "response", 0, 5, "short"), *[(False, 7, "response", 0, len(long), long)] * 2, (True, 0, "response", 0, 0, ""), *[(True, 0, "response", 0, len(other), other)] * 2, (True, 0, "revisit", 7, len(long), None)]
    assert told == sorted(want, key=lambda x: (*x[:5], x[5] or ""))
