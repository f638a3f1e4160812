"""One query for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm.collision_search import nearest_by_inner_product
from barloom.llm.ctph import fingerprint_of, likeness_of, with_next_row
from barloom.llm.embedding_dedup import near_embeddings
from barloom.llm.hash_ring import assign_shards
from barloom.llm.importance import resampling_report
from barloom.llm.line_dedup import line_report
from barloom.llm.mixing import mix_sources
from barloom.llm.sentencepiece_codec import encode_documents
from barloom.llm.simhash import near_duplicates
from barloom.llm.suffix_dedup import remove_repeats
from barloom.llm.token_counts import count_tokens
from barloom.llm.toxicity import score_documents
from barloom.llm.whitening import whiten


def piece_model() -> str:
    """Path of the SentencePiece model; the same on driver and executors."""
    return str(public_tokenizers.path("piece_bpe_32k.model"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"), piece_model(), n=4)


def op3_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    led = with_next_row(docs.withColumn("fingerprint", fingerprint_of(F.col("text"))), ["text", "fingerprint"])
    n, moved = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - moved), F.substring("next_text", F.lit(1), moved))
    rows = led.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "next_fingerprint", fingerprint_of(F.col("edited")).alias("edited_fingerprint"))
    near = likeness_of(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near, likeness_of(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def op4_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.coalesce("text", F.lit(""))
    rows = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data.cast("binary")).cast("long").alias("text_crc32")
    )
    placed = assign_shards(rows, 24, order=("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(read(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(read(spark, sf_dir, "embeddings"), 0.93)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), piece_model(), limit=4096)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read(spark, sf_dir, "documents"), with_kept=False)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"), words=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = resampling_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), share=25, least_words=20)
    return report.select("doc_id", "n_features", "weight", "score", "rank")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(read(spark, sf_dir, "embeddings"), components=8)
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op13_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_by_inner_product(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing, op2_sentencepiece, op3_ctph, op4_hash_ring, op5_line_dedup,
        op6_embedding_dedup, op7_token_counts, op8_toxicity, op9_suffix_dedup, op10_simhash,
        op11_importance_resampling, op12_whitening, op13_collision_search,
    )
}

#: The others need hashes, tokenizers or trained models that SQL lacks; tests hold them against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op6_embedding_dedup": """with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
usable as (select * from v where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(e, lambda x: x * x)) > 0),
p as (select a.vec_id as a, b.vec_id as b from usable a join usable b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
r(node, reached) as (select vec_id, vec_id from v union select r.node, p.b from r join p on p.a = r.reached),
c as (select node, min(reached) as component_id from r group by 1), n as (select a, count(*) as n_links from p group by 1)
select v.vec_id, coalesce(n_links, 0) as n_links, component_id, v.vec_id = component_id as kept from v join c on c.node = v.vec_id left join n on n.a = v.vec_id""",
    "op11_importance_resampling": """with texts as (select 0 as side, doc_id as id, text from documents union all select 1, item_id, text from benchmark),
w as (select side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as words from texts),
f as (select side, id, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) as feature from w),
crc as (select list_transform(range(256), lambda b: list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crcs),
h as (select feature, hex(encode(feature)) as digits from (select distinct feature from f)),
b as (select feature, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(len(digits) // 2), lambda i: (16 * (strpos('0123456789ABCDEF', digits[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', digits[2 * i + 2]) - 1)::bigint)),
    lambda c, x: xor(crcs[(xor(c, x) & 255) + 1]::bigint, c >> 8)), 4294967295) % 10000 as bucket from h, crc),
n as (select bucket, count(*) filter (where side = 0) as s, count(*) filter (where side = 1) as t from f join b using (feature) group by 1),
g as (select bucket, floor(1000 * ln(((t + 1) * (sum(s) over () + 10000))::double / ((s + 1) * (sum(t) over () + 10000))::double))::bigint as gain from n),
m as (select id, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight from f join b using (feature) join g using (bucket) where side = 0 group by 1),
u as (select id, len(words) as n_words, substr(sha256('7:' || id), 1, 8) as u from w where side = 0),
v as (select id, n_words, list_reduce(list_prepend(0::bigint, list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', u[i]) - 1)::bigint)), lambda a, x: a * 16 + x) as h from u),
z as (select id, n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from v left join m using (id)),
r as (select *, row_number() over (order by n_words < 20, score desc, id) as k, count(*) filter (where n_words >= 20) over () as able from z)
select id as doc_id, n_features, weight, score, case when n_words >= 20 and k <= 25 * able // 100 then k end as rank from r""",
}
