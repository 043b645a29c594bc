from __future__ import annotations

import base64
import gzip
import hashlib
import io
import os

import pytest

from proofgrid.llm import queries, warc

FOLDER = "/root/testdata/sf0.001"


def brute(pages):
    owner, count = {}, {}
    for page, html in pages:
        data = (html or "").encode()
        count[data] = count.get(data, 0) + 1
        if page is not None:
            owner[data] = max(owner.get(data, page), page)
    out = []
    for page, html in pages:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = owner.get(data)
        revisit = count[data] > 1 and first is not None and first != page
        out.append((page, len(data), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_query_matches_brute_force(spark):
    pages = [(r[0], r[1]) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "html").collect()]
    assert sorted(map(tuple, queries.op2_warc(spark, FOLDER).collect()), key=str) == brute(pages)


@pytest.mark.parametrize("split", [7, 100, 5000, 1 << 20])
def test_round_trip_at_every_split(spark, tmp_path, split):
    noise = os.urandom(3000).hex()
    pages = [(1, None), (2, ""), (3, "é😀\r\n\r\nWARC/1.0"), (4, noise), (9, noise), (7, noise), (None, noise), (5, "one"), (6, "x" * 200_000), (5, "one"), (-8, "\x1f")]
    rows = spark.createDataFrame([(p, h, None if p == 4 else "http://a b/\n") for p, h in pages], "page_id long, html string, url string").coalesce(1)
    files = warc.write_archives(rows, str(tmp_path))
    out = warc.read_archives(files, split).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out), key=str)
    assert got == brute(pages)
    assert all(r["payload"] is None if r["record_type"] == "revisit" else len(r["payload"]) == r["payload_bytes"] for r in out)
    path = files.first()["path"]
    assert gzip.open(path).read().count(b"WARC-Record-ID") == len(pages)


def test_an_archive_inside_a_payload_is_not_read_as_records(spark, tmp_path):
    inner = gzip.compress(warc.record(99, "u", b"inner", "D", None), 0, mtime=0)
    payload = b"before" + inner + b"after" * 50
    members = [gzip.compress(warc.record(i, "u", payload, warc.base32_sha1(payload), None), 0, mtime=0) for i in range(3)]
    data = b"".join(members)
    file = FakeFile(data)
    for split in (50, 333, 10_000):
        found = [warc.parsed(m)["page_id"] for s in range(0, len(data), split) for m in warc.members(file, len(data), s, min(s + split, len(data)))]
        assert found == [0, 1, 2]


class FakeFile(io.BytesIO):
    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


def test_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([], "page_id long, html string, url string")
    assert warc.read_archives(warc.write_archives(rows, str(tmp_path))).collect() == []


def test_small_payloads_are_never_revisits(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ab", None), (2, "ab", None), (3, "abc", None), (4, "abc", None)], "page_id long, html string, url string")
    out = warc.read_archives(warc.write_archives(rows, str(tmp_path), least_bytes=3)).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in out) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]
