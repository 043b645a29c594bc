from __future__ import annotations

import hashlib
import re

import duckdb

from proofgrid.llm import lines, queries

FOLDER = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\f\r"


def brute(docs):
    """(doc, lines, dropped, kept text); a null id is one document behind all others."""
    rank = lambda d: (d is None, d or 0)
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(SPACES))
    holders = {}
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders.setdefault(key(x), set()).add(rank(d))
    out = []
    for d, t in docs:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == rank(d)]
        out.append((d, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


ROWS = [
    (4, "A shared line.\nown four own four\n\n a SHARED line.\t"),
    (2, "a shared line.\na shared line.\nshort\nshort"),
    (9, "  A Shared Line. "),
    (None, "a shared line.\nown null own null\nÉcole égale école"),
    (None, "école égale école\nÉcole égale école"),
    (7, None),
    (8, ""),
    (8, ""),
    (11, "\n\n\n"),
    (12, "own four own four\x1c\nown four own four \nx"),
    (12, "own four own four\x1c\nown four own four \nx"),
    (13, "line of many\n" * 20_000),
    (14, "line of many\nlast"),
    (4, "same id, other text\na shared line."),
]


def test_odd_rows_match_brute_force(spark):
    docs = spark.createDataFrame([(d, t, 5, "x") for d, t in ROWS], "doc_id long, text string, n_lines int, d string")
    out = lines.drop_repeated_lines(docs)
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()), key=str)
    assert got == brute(ROWS)
    assert {"d"} <= set(out.columns)


def test_query_matches_brute_force_and_its_sql(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(docs))
    assert sorted(map(tuple, queries.op9_line_dedup(spark, FOLDER).collect())) == want
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{FOLDER}/documents.parquet')")
    sql = con.sql(queries.SQL["op9_line_dedup"]).df()[["doc_id", "n_lines", "n_dropped", "kept_sha256"]]
    assert sorted(sql.itertuples(index=False, name=None)) == want
    assert any(r[2] for r in want)


def test_empty_table(spark):
    assert lines.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
