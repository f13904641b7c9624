"""The corpus operators as queries over the synthetic tables: {name: f(spark, sf_dir)}, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown_lm, decontaminate, langid, minhash, pu_quality, sentencepiece_bpe, sharding, simhash, substring_dedup, warc
from .common import crc_fold, tokenizer_file

MODEL = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_fold(F.col("doc_id"), 4) == 2)
    model = langid.fit(docs.where("not held_out"))
    got = langid.predict(docs, model)
    return got.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_fold(F.col("doc_id"), 7) == 2
    model = brown_lm.fit(docs.where(~held_out))
    return brown_lm.score(docs, model).withColumn("held_out", held_out)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sentencepiece_bpe.encode(table(spark, sf_dir, "documents"), tokenizer_file(MODEL))
    return got.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = minhash.edited_texts(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op6_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trusted = table(spark, sf_dir, "labels").where((F.col("quality") == 1) & (crc_fold(F.col("doc_id"), 5) != 0)).select("doc_id")
    model = pu_quality.fit(docs.where(crc_fold(F.col("doc_id"), 5) != 0), trusted)
    got = pu_quality.score(docs, model)
    return got.select("doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= pu_quality.THRESHOLD).cast("int").alias("predicted"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_langid": op1_langid,
        "op2_simhash": op2_simhash,
        "op3_brown_lm": op3_brown_lm,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_minhash": op5_minhash,
        "op6_hash_tree": op6_hash_tree,
        "op7_pu_quality": op7_pu_quality,
        "op8_substring": op8_substring,
        "op9_warc": op9_warc,
        "op10_decontaminate": op10_decontaminate,
    }


#: Windows by a sliding string_agg over words in order; a word goes if one of the 35 windows that cover it repeats.
_SUBSTRING_SQL = r"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
words as (select doc_id, unnest(ws) word, unnest(range(len(ws))) pos, len(ws) n from docs),
wins as (select doc_id, pos, word, n, case when pos <= n - 35 then string_agg(word, ' ') over (partition by doc_id order by pos rows between current row and 34 following) end win from words),
seen as (select *, case when win is not null and count(*) over (partition by win) > 1 then 1 else 0 end again from wins),
cover as (select *, max(again) over (partition by doc_id order by pos rows between 34 preceding and current row) gone from seen),
done as (select doc_id, count(*) n_words, sum(gone)::bigint n_removed, coalesce(string_agg(word, ' ' order by pos) filter (gone = 0), '') kept from cover group by 1)
select d.doc_id, coalesce(n_words, 0) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from docs d left join done using (doc_id)"""

#: Base 32 takes 5 bits at a time, out of two hex digits.
_WARC_SQL = """
with p as (select page_id, coalesce(html, '') html, sha1(coalesce(html, '')) hex, max(page_id) over (partition by coalesce(html, '')) latest from pages)
select page_id, strlen(html) payload_bytes,
array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, ((5 * k) // 4 + 1)::bigint, 2))::int >> (3 - (5 * k) % 4)::int) & 31) + 1, 1)), '') payload_digest,
case when page_id = latest then 'response' else 'revisit' end record_type, case when page_id = latest then null else latest end refers_to from p"""


def oracle_sql() -> dict[str, str]:
    """Those that SQL can express; the others' tests compare them with brute force or the library they equal."""
    return {"op8_substring": _SUBSTRING_SQL, "op9_warc": _WARC_SQL}
