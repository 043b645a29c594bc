"""Line deduplication across documents.

Normalised lines are exploded and hashed; a hash held by two documents or more loses its lines everywhere but in the
smallest document; what is left is put together again by position. Only hashes travel for the counting, with minimum
and maximum id combined on the map side, so a line that stands in a third of all documents costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.texts import ascii_lower, whole
from proofgrid.session import cut_lineage

BLANKS = " \t\n\x0b\f\r"
LEAST_CHARS = 10
LAST_ID = 2**63 - 1


def line_key(line):
    """A line without blanks at its ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """All rows and columns of `docs`, `text` replaced, with n_lines and n_dropped.

    A key of at least `least_chars` code points that stands in two documents or more keeps its lines (all of them) only
    in the document with the smallest id. Null or empty text is one empty line and stays as the empty text. A null id
    counts as one document after all others. Rows that share an id are one document; a repeated row gives a repeated
    row. n_lines and n_dropped replace columns of the same name.
    """
    docs = docs.drop("n_lines", "n_dropped")
    ident = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID))
    base = docs.select(ident.alias("d"), whole(F.col(text)).alias("t")).select("d", F.xxhash64("t").alias("th"), F.split("t", "\n", -1).alias("lines"))
    keyed = (
        base.select("d", "th", F.posexplode("lines").alias("pos", "line"))
        .select("d", "th", "pos", line_key(F.col("line")).alias("k"))
        .where(F.length("k") >= least_chars)
        # Two seeds: 128 bits in all, so that different lines of a very large corpus don't meet.
        .select("d", "th", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), "k").alias("h2"))
    )
    shared = cut_lineage(
        keyed.groupBy("h1", "h2").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi").select("h1", "h2", "lo")
    )
    # Written before the join, so that both sides are plain exchanges and a hot line is split between tasks.
    lost = keyed.join(shared, ["h1", "h2"]).where("d <> lo").groupBy("d", "th").agg(F.array_sort(F.collect_set("pos")).alias("_lost"))
    clean = whole(F.col(text))
    lines = F.split(clean, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_lost"))
    out = docs.select("*", ident.alias("_d"), F.xxhash64(clean).alias("_th")).join(
        lost.withColumnsRenamed({"d": "_d", "th": "_th"}), ["_d", "_th"], "left"
    )
    return out.select(
        *[
            F.when(F.col("_lost").isNull(), clean).otherwise(F.array_join(F.transform(kept, lambda p: lines[p]), "\n")).alias(text)
            if c == text
            else F.col(f"`{c}`")
            for c in docs.columns
        ],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("_lost"), F.lit(0)).cast("long").alias("n_dropped"),
    )
