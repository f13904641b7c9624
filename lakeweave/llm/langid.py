"""Language ID by multinomial naive Bayes over hashed character n-grams.

Grams of one to three characters of the lower-cased text, other characters than letters read as a space, are hashed
into 2^16 buckets. Training counts all grams of all labelled texts; the matrix of log-probabilities is broadcast, and
batches of texts are scored as sparse rows of bucket numbers against it in numpy. More languages than one broadcast may
have go in blocks, one after the other, and the texts' probabilities are normalised over all of them.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import added_up, in_arrow, pieces, task_group, unused, written

ORDERS, BUCKET_BITS, BLOCK, SMOOTHING = 3, 16, 1024, 0.5
#: Languages that a broadcast matrix may have: 128 MB.
MOST_LANGUAGES = 256
UNKNOWN = "und"
#: Overlapping grams aren't independent: of the grams of each order, one in each character's worth counts.
TEMPERATURE = 3.0


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_buckets(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order (buckets, texts they belong to), and whether each text has a letter.

    A text stands between one blank and two more, so that a gram that begins in it ends in its own blanks; grams that
    would begin in the last two are left out, as are those without letters.
    """
    texts = [t.lower() for t in texts]
    code = np.frombuffer(("".join(f"\0{t}\0\0" for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(texts)), size := np.array([len(t) + 3 for t in texts]))
    begins = np.ones(len(code), bool)
    for back in (1, 2):
        begins[np.cumsum(size) - back] = False
    letter = _letters()[code]
    code = np.where(letter, code, np.uint32(32))
    out, key, some = [], np.zeros(len(code), np.uint32), np.zeros(len(code), bool)
    for n in range(ORDERS):
        m = len(code) - n
        key, some = (key[:m] ^ code[n:]) * np.uint32(0x9E3779B1) + np.uint32(n), some[:m] | letter[n:]
        mixed = (key ^ key >> np.uint32(15)) * np.uint32(0x85EBCA6B)
        take = some & begins[:m]
        out.append(((mixed >> np.uint32(32 - BUCKET_BITS))[take], text[:m][take]))
    return out, np.bincount(text, letter, len(texts)) > 0


@dataclass
class Block:
    """A stretch of the languages, in order of their names."""

    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # languages x buckets

    def like(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the likeliest language, its logarithm and the sum of all in the block, not normalised; whether
        it has a letter, and how many grams."""
        parts, some = gram_buckets(texts)
        like = np.stack([sum(np.bincount(text, w[bucket], len(texts)) for bucket, text in parts) for w in self.log_prob], axis=1)
        like = like / TEMPERATURE + self.log_prior
        top = like.max(axis=1)
        many = sum(np.bincount(text, minlength=len(texts)) for _, text in parts)
        return [self.languages[k] for k in like.argmax(axis=1)], top, np.exp(like - top[:, None]).sum(axis=1), some, many


@dataclass
class Model:
    """languages with their shares of the training texts; counts: (lang, block, docs, counts) of all of them, written."""

    languages: list[str]
    log_prior: np.ndarray
    counts: DataFrame

    def blocks(self, most: int | None = None) -> Iterator[Block]:
        most = most or MOST_LANGUAGES
        for a in range(0, len(self.languages), most):
            names = self.languages[a : a + most]
            at, counts = {x: i for i, x in enumerate(names)}, np.zeros((len(names), 1 << BUCKET_BITS))
            for r in self.counts.where(F.col("lang").between(names[0], names[-1])).collect():
                counts[at[r.lang], r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.int64)
            prob = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * counts.shape[1])
            yield Block(names, self.log_prior[a : a + most], np.log(prob))


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from every row with text and language, whatever their number.

    Each task adds its rows into one matrix and sends it in blocks of buckets, which are summed by block, 32 at a time, and written;
    the driver gets half a megabyte a language, of MOST_LANGUAGES at a time. Rows with null in either column teach
    nothing, and a table without others gives a model without languages.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for b in pieces(batches, "text"):
            lang = b.column("lang").to_pylist()
            names = sorted(set(lang))
            parts, _ = gram_buckets(b.column("text").to_pylist())
            of = np.array([names.index(x) for x in lang])
            for bucket, text in parts:
                got = np.bincount(of[text] << BUCKET_BITS | bucket, minlength=len(names) << BUCKET_BITS).reshape(len(names), -1)
                for k, x in enumerate(names):
                    sums[x] = sums[x] + got[k] if x in sums else got[k]
            for x in lang:
                docs[x] = docs.get(x, 0) + 1
        for x, got in sums.items():
            rows = got.reshape(-1, BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(rows)), pa.array(range(len(rows)), pa.int32()), pa.array([docs[x]] * len(rows), pa.int64()), pa.array([r.astype(np.int64).tobytes() for r in rows], pa.binary()), pa.array([task_group()] * len(rows), pa.int32())], ["lang", "block", "docs", "counts", "part"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in t["counts"].to_pylist())
        return pa.table({"lang": t["lang"][:1], "block": t["block"][:1], "docs": [sum(t["docs"].to_pylist())], "counts": pa.array([total.tobytes()], pa.binary()), "part": t["part"][:1]})

    schema = "lang string, block int, docs long, counts binary, part int"
    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = written(added_up(rows.transform(in_arrow, count, schema), ("lang", "block"), add, schema).drop("part"), "languages")
    docs = sorted((r.lang, r.docs) for r in counts.groupBy("lang").agg(F.max("docs").alias("docs")).collect())
    n = np.array([d for _, d in docs], np.float64)
    return Model([x for x, _ in docs], np.log(n / n.sum()) if len(n) else n, counts)


def with_language(df: DataFrame, model: Model, text_col: str, lang: str, score: str, keep: list[str], seen: str | None = None) -> DataFrame:
    """Columns of df, as named by keep, and two more: the likeliest language of each text and its probability; `und` and 0 without letters.

    seen: name of a third, whether the text is likelier in that language than grams drawn evenly from all buckets (under
    the rarest language's share). Text in an unlearned script isn't, though some learned language is always likeliest.

    One pass over the texts for each block of languages; between blocks the rows are written with what is known so far.
    Of equally likely languages the first by name is taken.
    """
    top, total, many = unused("top", df), unused("total", df), unused("many", df)
    more, at = StructType.fromDDL(f"`{lang}` string, `{top}` double, `{total}` double, `{many}` long"), df.columns.index(text_col)
    n, blocks = len(df.columns), -(-len(model.languages) // MOST_LANGUAGES)
    rows = df.select("*", F.lit(UNKNOWN).alias(lang), F.lit(float("-inf")).alias(top), F.lit(0.0).alias(total), F.lit(0).cast("long").alias(many))
    for number, block in enumerate(model.blocks()):
        sent = df.sparkSession.sparkContext.broadcast(block)
        names = keep if number == blocks - 1 else df.columns  # the text needn't come back from the last block
        kind = StructType([*(df.schema[c] for c in names), *more])

        def run(batches: Iterator[pa.RecordBatch], sent=sent, places=tuple(df.columns.index(c) for c in names), kind=kind) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, text_col):
                best, new, mass, some, grams = sent.value.like([x or "" for x in b.column(at).to_pylist()])
                before, old, sums = b.column(n).to_pylist(), np.asarray(b.column(n + 1)), np.asarray(b.column(n + 2))
                high = np.maximum(old, new)
                sums = np.where(np.isinf(old), 0, sums * np.exp(old - high)) + mass * np.exp(new - high)
                found = [(x if u > v else y) if s else UNKNOWN for x, y, u, v, s in zip(best, before, new, old, some, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in places), pa.array(found, pa.string()), pa.array(np.where(some, high, -np.inf)), pa.array(np.where(some, sums, 0.0)), pa.array(grams.astype(np.int64))], kind.names)

        rows = (written(rows, "languages-so-far") if number else rows).transform(in_arrow, run, kind)
    even = F.col(many) * (-BUCKET_BITS * math.log(2) / TEMPERATURE) + float(min(model.log_prior, default=0.0))
    known = [(F.col(top) >= even).alias(seen)] if seen else []
    return rows.select(*keep, lang, F.when(F.col(total) > 0, 1 / F.col(total)).otherwise(0.0).alias(score), *known)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row: a learned language and its probability from 0 to 1.

    Null text and text without letters give `und` with score 0, as does every text if nothing was learned. Ties go
    to the language that is first by name. Rows are independent: repeated rows and null ids each keep their row. Empty
    tables give none.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return with_language(rows, model, "text", "lang_pred", "score", ["id"]).select(F.col("id").alias(id_col), "lang_pred", "score")


def keep_known(df: DataFrame, model: Model, least: float, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of df whose language is known with at least that probability, with lang_col as predicted.

    Rejected are null texts, texts without letters, texts of which no language is likely enough, and texts less likely
    in theirs than grams drawn evenly, as those in a script that was not learned (see with_language). All other
    columns stay as they are, ids play no part, and equal rows stay or go together. Ties go to the language that is
    first by name; empty tables give none.
    """
    lang, score, seen = unused("predicted", df), unused("likely", df), unused("seen", df)
    rows = with_language(df, model, text_col, lang, score, df.columns, seen).where((F.col(lang) != UNKNOWN) & (F.col(score) >= least) & F.col(seen))
    return rows.select(*[F.col(lang).cast(df.schema[c].dataType).alias(c) if c == lang_col else c for c in df.columns])
