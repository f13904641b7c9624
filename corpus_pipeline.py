"""From raw documents to token ids: language ID, SimHash near-dedup, substring dedup, decontamination, SentencePiece.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm import decontaminate, langid, sentencepiece_bpe, simhash, substring_dedup
from lakeweave.llm.common import tokenizer_file, unused, written
from lakeweave.llm.queries import MODEL, table

#: A text of which no learned language has this probability is rejected, as is one without letters.
LEAST_LANGUAGE = 0.3
#: Least Jaccard similarity of five-word shingles of near-duplicates.
SIMILARITY = 0.8
#: Row numbers that are sent to all tasks at most: 8 bytes each, 64 MB in a task's hash table.
BROADCAST = 4_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language, with lang as predicted; learned from the stage's own labelled documents."""
    return langid.keep_known(docs, langid.fit(docs), LEAST_LANGUAGE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id, of repeated ids any one row.

    Fingerprints of four-word shingles at 4 bits find copies and the nearest of near copies, in groups of any size;
    MinHash bands find those of a similarity of 0.8 or more on five words. A group is what both kinds of links connect.
    Rows are told apart by numbers given in a table written first, so ids may be null (those go after all others) or
    repeat: rows of one id go only if their texts are alike. Null texts count as empty, and empty ones as alike. Empty
    tables give no rows. The numbers of rows that go are counted: up to BROADCAST of them are sent to all tasks, so that
    texts aren't shuffled; more meet the documents in a sort-merge join.
    """
    row = unused("row", docs)
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    near = written(simhash.near_duplicates(rows, row).select(row, "component"), "near-links")
    linked = simhash.similar_groups(rows, SIMILARITY, row, known=near).select(F.col(row).alias("member"), F.col("component").alias("of_group"))
    members = written(linked.union(linked.select("of_group", "of_group")).distinct(), "near-groups")
    named = members.join(rows.select(F.col(row).alias("at"), F.col("doc_id").alias("id")), F.col("member") == F.col("at"))
    first = named.groupBy(F.col("of_group").alias("g")).agg(F.min(F.struct(F.col("id").isNull(), "id", "member")).alias("first"))
    gone = members.join(first, F.col("of_group") == F.col("g")).where("member <> first.member").select("member")
    gone = written(gone, "near-gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST else gone.hint("merge")
    return rows.join(gone, F.col(row) == F.col("member"), "left_anti").drop(row)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that it repeats or shares; a text that loses nothing stays as it is.

    Null texts, null and repeated ids and extra columns stay as well; copies of a text lose all their windows. Empty
    tables give none.
    """
    others = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    got = substring_dedup.remove_repeats(docs, carry=others, as_is=True)
    made = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast(docs.schema["n_chars"].dataType)}
    return got.select(*[made.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item, all columns as they are.

    Null and empty texts leak nothing and stay, as do all rows if the benchmark is empty; ids play no part, and equal
    rows stay or go together. Empty tables give none.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): each document's token ids, and the text that they decode to.

    One row for each row, null and repeated ids included. Null texts count as empty: no ids, an empty text.
    """
    got = sentencepiece_bpe.encode(docs, tokenizer_file(MODEL))
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("passages", passages),
    ("decontaminated", decontaminated),
    ("tokens", tokens),
]

#: The stages' kernels have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
