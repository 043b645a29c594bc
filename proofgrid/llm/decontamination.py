"""Benchmark decontamination by a prefix-filtered containment join.

A benchmark window (13 words, or a whole shorter item) is a set of word trigrams that a document must hold in full, so one
necessary trigram suffices to find it: the one that is rarest in the corpus. Documents keep only trigrams that the
benchmark knows; those are counted, candidates come from the rarest ones, must fit into the document at their offset, and
are verified trigram by trigram over the window. The documents' texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.llm.texts import ascii_lower, joined, sha256_hex, whole
from proofgrid.session import cut_lineage

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
GRAM = 3
#: A benchmark table of at most so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
LAST_ID = 2**63 - 1
#: Marks the one row that every document has, whatever it shares with the benchmark.
END = -6148914691236517205
KEY = ["d", "th"]


def words(text: Column) -> Column:
    """Lower-cased words of a text; null has none."""
    return F.array_remove(F.split(ascii_lower(whole(text)), BREAKS, -1), "")


def grams(column: str, size: int) -> Column:
    """Hashes of `size` consecutive words, one for each place."""
    w = F.col(column)
    return F.when(
        F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)]))
    ).otherwise(F.array().cast("array<bigint>"))


def _small(df: DataFrame) -> DataFrame:
    """A benchmark table, to be broadcast if its counted rows are few enough."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _windows(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, wid, len, w): every window of every item."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1)))
    return (
        items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, WINDOW))).alias("w"))
        # Words hold no space, so the joined window is exact.
        .select("item", F.xxhash64(F.array_join("w", " ")).alias("wid"), F.size("w").alias("len"), "w")
        .distinct()
    )


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per different (id, text): d, th, copies, n_words, n_hit, n_items, items (sorted texts), contaminated.

    `d` is the id (null: 2**63 - 1), `th` a hash of the text. Words without text are none; an item without words has no
    window; items that share an id are one item, a null id reads as the empty text. `copies` counts repeated rows.
    An empty benchmark contaminates nothing.
    """
    windows = _windows(benchmark, item_id, item_text)
    unique = cut_lineage(windows.dropDuplicates(["wid"]).select("wid", "len", "w"))
    sizes = [r[0] for r in unique.select(F.least("len", F.lit(GRAM)).alias("n")).distinct().collect()]  # at most 1, 2 and 3
    parts = None
    for size in sizes:
        some = unique.where(F.least("len", F.lit(GRAM)) == size).select("wid", "len", F.posexplode(grams("w", size)).alias("offset", "gram"))
        parts = some if parts is None else parts.unionByName(some)
    known = docs.sparkSession.createDataFrame([(END,)], "gram long")
    if parts is not None:
        parts = cut_lineage(parts)
        known = known.union(parts.select("gram").distinct())
    held = F.concat(*[grams("w", size) for size in sizes], F.array(F.lit(END).cast("long")))
    # Places in the concatenated array become word places again.
    base = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("d"), F.xxhash64(whole(F.col(text))).alias("th"), words(F.col(text)).alias("w")
    )
    rows = base.select("d", "th", F.size("w").alias("n_words"), F.posexplode(held).alias("at", "gram"))
    rows = rows.select("d", "th", "n_words", _place(sizes).alias("pos"), "gram")
    found = cut_lineage(rows.join(_small(known), "gram"))
    documents = found.where(F.col("gram") == END).groupBy(*KEY, "n_words").agg(F.count("*").alias("copies"))
    if parts is None:
        return documents.select(
            *KEY, "copies", F.col("n_words").cast("long"), *[F.lit(0).cast("long").alias(c) for c in ("n_hit", "n_items")],
            F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"),
        )
    known_grams = found.where(F.col("gram") != END)
    rarity = known_grams.groupBy("gram").agg(F.count("*").alias("times"))
    order = F.struct(F.coalesce("times", F.lit(0)).alias("times"), "gram", "offset")
    prefix = parts.join(_small(rarity), "gram", "left").groupBy("wid", "len").agg(F.min(order).alias("p"))
    prefix = _small(prefix.where("p.times > 0").select("wid", "len", "p.gram", "p.offset"))
    distinct = known_grams.dropDuplicates([*KEY, "pos", "gram"])
    candidates = (
        distinct.join(prefix, "gram")
        .select(*KEY, "n_words", "wid", "len", (F.col("pos") - F.col("offset")).alias("start"))
        # Length and positional bounds: the window must lie inside the document.
        .where("start >= 0 and start + len <= n_words")
    )
    # Trigrams side by side and the last one cover every word of the window.
    probes = parts.where((F.col("offset") % GRAM == 0) | (F.col("offset") == F.greatest(F.col("len") - GRAM, F.lit(0))))
    probes = probes.select("wid", F.col("offset").alias("o"), "gram", F.count("*").over(Window.partitionBy("wid")).alias("need"))
    wanted = candidates.join(_small(probes), "wid").select(*KEY, "wid", "len", "start", "need", "gram", (F.col("start") + F.col("o")).alias("pos"))
    verified = cut_lineage(
        wanted.join(distinct.select(*KEY, "pos", "gram"), [*KEY, "pos", "gram"])
        .groupBy(*KEY, "wid", "len", "start", "need")
        .agg(F.count("*").alias("got"))
        .where("got = need")
        .select(*KEY, "wid", "len", "start")
    )
    stretch = lambda run, x: F.struct(
        (run["hit"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(run["end"], x["start"]))).alias("hit"),
        F.greatest(run["end"], x["start"] + x["len"]).alias("end"),
    )
    n_hit = F.aggregate(F.array_sort(F.collect_set(F.struct("start", "len"))), F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end")), stretch, lambda run: run["hit"])
    hits = verified.groupBy(*KEY).agg(n_hit.cast("long").alias("n_hit"))
    of_items = _small(windows.select("wid", "item"))
    items = verified.select(*KEY, "wid").distinct().join(of_items, "wid").groupBy(*KEY).agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = documents.join(hits, KEY, "left").join(items, KEY, "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        *KEY,
        "copies",
        F.col("n_words").cast("long"),
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def _place(sizes: list[int]) -> Column:
    """The word place of an entry of the concatenated gram arrays."""
    at, place = F.col("at"), F.col("at")
    before = F.lit(0)
    for size in sizes:
        n = F.greatest(F.col("n_words") - size + 1, F.lit(0))
        place = F.when(at >= before, at - before).otherwise(place)
        before = before + n
    return place


def item_list(items: Column) -> Column:
    return sha256_hex(joined(items))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """The rows of `docs`, all columns, that aren't contaminated."""
    bad = contamination(docs, benchmark, doc_id, text, **names).where("contaminated").select(F.col("d").alias("_d"), F.col("th").alias("_th"))
    keyed = docs.select("*", F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("_d"), F.xxhash64(whole(F.col(text))).alias("_th"))
    return keyed.join(bad, ["_d", "_th"], "left_anti").select(*docs.columns)
