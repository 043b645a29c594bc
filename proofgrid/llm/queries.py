"""The registered queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.llm import bpe, chat, decontamination, jaccard, lines, lm, negatives, pii, quality, resampling, secrets, sharding, warc
from proofgrid.llm.shipping import ship
from proofgrid.llm.texts import joined, sha256_hex, whole

SHARDS = 24


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets by rules and entropy."""
    out = secrets.find_secrets(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    of = lambda rank: F.filter("secrets", lambda s: s["rank"] == rank)
    return out.select(
        "doc_id",
        *[F.size(of(rank)).cast("long").alias(f"n_{kind}") for rank, kind in enumerate(secrets.KINDS[:3])],
        sha256_hex(secrets.listed(F.filter("secrets", lambda s: s["rank"] < 3))).alias("base_sha256"),
        secrets.listed(F.col("secrets")).alias("spans"),
    )


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Archives of all pages, read back in splits."""
    files = warc.write_archives(table(spark, folder, "pages").select("page_id", "url", "html"), warc.archive_folder(spark))
    return warc.read_archives(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = decontamination.contamination(docs, table(spark, folder, "benchmark").select("item_id", "text"))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        F.when(F.col("d") != decontamination.LAST_ID, F.col("d")).alias("doc_id"),
        "n_words",
        "n_hit",
        "n_items",
        decontamination.item_list(F.col("items")).alias("items_sha256"),
        "contaminated",
    )


def op4_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """Log probabilities of all texts under a model of the training texts."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = lm.train(docs.where(~lm.held_out(F.col("doc_id"))))
    out = lm.score(docs, model).withColumn("held_out", lm.held_out(F.col("doc_id")))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_shard(spark: SparkSession, folder: str) -> DataFrame:
    """Shards of near-equal bytes; equal texts stand together."""
    text = whole(F.col("text"))
    rows = table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash")
    )
    out = sharding.shard_by_bytes(rows, ["text_hash", "doc_id"], "size", SHARDS)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard")
    )


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Rule counts and the classifier's verdict for every text."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = quality.judge(docs, quality.train(docs, table(spark, folder, "labels")))
    return out.drop("text", "p_quality")


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Encode, then decode again."""
    out = bpe.decode(bpe.encode(table(spark, folder, "documents").select("doc_id", "text")).drop("text"))
    return out.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        sha256_hex(F.array_join(F.col("token_ids").cast("array<string>"), ",")).alias("ids_sha256"),
        sha256_hex(F.col("decoded")).alias("decoded_sha256"),
    )


def op8_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents that share 80% of their five-word shingles."""
    return jaccard.jaccard_components(table(spark, folder, "documents").select("doc_id", "text")).drop("th")


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that stand in an earlier document are dropped."""
    out = lines.drop_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("text")).alias("kept_sha256"))


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of personal data by rules and the trained tagger."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = pii.find_personal_data(docs, pii.train(docs)).drop("text")
    listed = lambda spans: joined(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    of = lambda rank: F.filter("personal", lambda s: s["rank"] == rank)
    return out.select(
        "doc_id",
        *[F.size(of(rank)).cast("long").alias(f"n_{kind}") for rank, kind in enumerate(pii.KINDS)],
        sha256_hex(listed(F.filter("personal", lambda s: s["rank"] < len(pii.KINDS)))).alias("base_sha256"),
        listed(F.col("personal")).alias("spans"),
    )


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh label is moved on by one."""
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)


#: A conversation whose texts are control strings.
PLANTED = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def op12_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations formatted, read back and digested."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string"))
    return chat.digests(chat.format_conversations(rows), in_order=True)


def op13_resample(spark: SparkSession, folder: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark's words and word pairs."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    target = table(spark, folder, "benchmark").select("text")
    gains = resampling.bucket_gains(resampling.bucket_counts(docs), resampling.bucket_counts(target))
    return resampling.draw(resampling.weigh(docs, gains)).drop("n_words")


OP9_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
l as (select doc_id, unnest(string_split(t, chr(10))) as line, unnest(range(len(string_split(t, chr(10))))) as pos from d),
k as (select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
s as (select key, min(doc_id) as lo from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
m as (select k.doc_id, k.pos, k.line, s.key is not null and k.doc_id <> s.lo as gone from k left join s on k.key = s.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""

OP11_SQL = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c as (select vec_id, label, unnest(v) as x, unnest(range(len(v))) as k from e),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(sum(a.x * b.x) as bigint) as score
  from c as a join c as b on a.k = b.k where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id group by all),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over w as integer) as rank, s.vec_id as negative_id, positive_score, s.score as negative_score
from p join s using (anchor_id)
where not same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score
window w as (partition by anchor_id, positive_id order by s.score desc, s.vec_id)
qualify row_number() over w <= 10
"""

OP12_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'),
  '[/INST]', '[\/INST]') as kept from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(3 + sum(case when role = 'assistant' then length(kept) + 4 else length('[INST]' || role || chr(10) || kept || '[/INST]') end) as bigint)
    as formatted_chars
from e group by conv_id
"""

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_warc": op2_warc,
    "op3_decontaminate": op3_decontaminate,
    "op4_lm_score": op4_lm_score,
    "op5_shard": op5_shard,
    "op6_quality": op6_quality,
    "op7_bpe": op7_bpe,
    "op8_ngram_join": op8_ngram_join,
    "op9_line_dedup": op9_line_dedup,
    "op10_pii": op10_pii,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_chat": op12_chat,
    "op13_resample": op13_resample,
}
SQL = {"op9_line_dedup": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_chat": OP12_SQL}
