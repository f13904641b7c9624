"""Document fingerprints by one-permutation MinHash.

Each shingle is hashed once; the top bits choose one of 512 bins and the rest compete for the bin's least value.
Empty bins are filled by optimal densification: bin i looks at bins u(i, 1), u(i, 2), ... given by one fixed hash
until it finds one that was filled by shingles, so any two texts look in the same order. The lowest 4 bits of each
bin are packed. Two bins that differ still agree in 4 bits with chance 1/16, for which likeness() corrects.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, pieces, with_id
from .hashing import grams, mix, within, word_hashes

U64 = np.uint64
BINS, BITS, SHINGLE = 512, 4, 5
EMPTY = np.iinfo(np.uint64).max


def signatures(texts: list[bytes], bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(texts x bins of low bits, whether each text has any shingle). A text of fewer words is one shingle."""
    own, some = bin_values(texts, bins, shingle)
    return (own & U64((1 << bits) - 1)).astype(np.uint8), some


def bin_values(texts: list[bytes], bins: int = BINS, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """As signatures(), with whole 64-bit values."""
    hashes, offsets = word_hashes(texts)
    count = np.diff(offsets)
    at, text = within(offsets, shingle)
    value = grams(hashes, shingle)[at]
    short = np.flatnonzero((count > 0) & (count < shingle))
    if len(short):
        whole = np.array([mix(grams(hashes[offsets[i] : offsets[i + 1]], int(count[i])) + U64(count[i]))[0] for i in short], U64)
        value, text = np.concatenate((value, whole)), np.concatenate((text, short))
    shift = U64(64 - (bins - 1).bit_length())
    least = np.full(len(texts) * bins, EMPTY, U64)
    np.minimum.at(least, text * bins + (value >> shift).astype(np.int64), value & ((U64(1) << shift) - U64(1)))
    least = least.reshape(len(texts), bins)
    return densified(least), count > 0


#: Attempts, over all empty bins, that densification makes at a time.
LOOKED = 1 << 20


@functools.lru_cache(64)
def _looks(bins: int, done: int, step: int) -> np.ndarray:
    """The bins that each bin looks at in attempts done + 1 to done + step."""
    attempt = np.arange(done + 1, done + step + 1, dtype=U64) << U64(20)
    return (mix(np.arange(bins, dtype=U64)[:, None] + attempt[None, :]) % U64(bins)).astype(np.int16)


def densified(least: np.ndarray) -> np.ndarray:
    """Fills EMPTY bins of rows that have any other; then the hashed values of all bins."""
    rows, bins = least.shape
    filled = least != EMPTY
    row, bin_ = np.nonzero(~filled & filled.any(axis=1, keepdims=True))
    out, done, step = least.copy(), 0, 4
    while len(row):
        look = _looks(bins, done, step)
        wait = []
        for at in range(0, len(row), LOOKED // step):
            r, b = row[at : at + LOOKED // step], bin_[at : at + LOOKED // step]
            hit = filled[r[:, None], look[b]]
            found = hit.any(axis=1)
            r, b, first, rest = r[found], b[found], hit[found].argmax(axis=1), ~found
            out[r, b] = least[r, look[b, first]]
            wait.append((row[at : at + LOOKED // step][rest], bin_[at : at + LOOKED // step][rest]))
        row, bin_ = (np.concatenate(x) for x in zip(*wait, strict=True))
        done, step = done + step, min(4 * step, 256)
    # a value that fills several bins is hashed anew with each bin's number, so that its bits agree by chance in each apart
    return mix(out ^ np.arange(1, bins + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def packed(low: np.ndarray, some: np.ndarray) -> list[str]:
    """Two bins a byte, in hex; a text without words has the empty fingerprint."""
    data = (low[:, 0::2] << 4 | low[:, 1::2]).astype(np.uint8)
    return [x.tobytes().hex() if s else "" for x, s in zip(data, some, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of the shingle sets, from 0 to 1; without words: 1 with one alike, else 0."""
    by_chance = 0.5**bits
    got = np.clip(((a == b).mean(axis=1) - by_chance) / (1 - by_chance), 0, 1)
    return np.where(some_a & some_b, got, (some_a == some_b).astype(float))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint string) of every whole text, no shuffle. Null counts as empty, with fingerprint ""."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            got = packed(*signatures([(x or "").encode() for x in b.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(got, pa.string())], ["id", "fingerprint"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).transform(in_arrow, run, with_id(df, id_col, "fingerprint string")).withColumnRenamed("id", id_col)


def with_successor(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (bucket, tail, id, text) dealt by ranges of id and sorted within: each row stands before its successor.

    Range ends are ids that exist. The row at the start of a range is also sent to the end of the range before it,
    and the first row of all to the end of the last, marked as tail: so every successor is at hand in one shuffle.
    Equal ids follow in order of their text's hash; null ids come last.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    first, ends = rows.agg(F.min("id"), F.percentile_approx("id", [i / parts for i in range(parts)], 100 * parts)).first()
    ends = np.array(sorted({x for x in ends or [] if x != first}), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            known = np.asarray(b.column("id").is_valid())
            ids = np.asarray(b.column("id").fill_null(0))
            bucket = np.where(known, np.searchsorted(ends, ids, "right"), len(ends)).astype(np.int32)
            head = np.flatnonzero(known & np.isin(ids, ends))
            wrap = np.flatnonzero(known & (ids == first)) if first is not None else np.arange(len(ids))
            take = np.concatenate((np.arange(len(ids)), head, wrap))
            to = np.concatenate((bucket, bucket[head] - 1, np.full(len(wrap), len(ends)))).astype(np.int32)
            tail = np.arange(len(take)) >= len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(tail), b.column("id").take(pa.array(take)), b.column("text").take(pa.array(take))], ["bucket", "tail", "id", "text"])

    dealt = rows.transform(in_arrow, deal, "bucket int, tail boolean, id long, text string")
    return dealt.repartitionById(len(ends) + 1, "bucket").sortWithinPartitions("bucket", "tail", F.col("id").asc_nulls_last(), F.xxhash64("text"))


def edited_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    edited: the text whose last floor(n_chars / 2) code points give way to the first as many (or all) of its
    successor's, by ascending id, the first row following the last. near_*: likeness of the text's fingerprint to the
    edited one's and to the successor's. Null text counts as empty. Equal ids follow in order of their text's hash.
    A single row is its own successor. Empty tables give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, whose successor comes with the next batch
        for b in pieces(batches, "text"):
            b = b.select(["tail", "id", "text"])
            t = pa.Table.from_batches([b] if held is None else [held, b])
            held = b.slice(b.num_rows - 1)
            texts = [x or "" for x in t["text"].to_pylist()]
            own = [i for i, tail in enumerate(t["tail"].to_pylist()[:-1]) if not tail]
            if not own:
                continue
            edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in own]
            low, some = signatures([x.encode() for x in texts])
            new, new_some = signatures([x.encode() for x in edited])
            at = np.array(own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([t["id"][i].as_py() for i in own], pa.int64()), pa.array([len(texts[i]) for i in own], pa.int64()), pa.array(edited, pa.string()),
                    pa.array(packed(low[at], some[at]), pa.string()), pa.array(packed(new, new_some), pa.string()),
                    pa.array(likeness(low[at], new, some[at], new_some)), pa.array(likeness(low[at], low[at + 1], some[at], some[at + 1])),
                ],
                ["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    schema = "id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_successor(df, id_col, text_col).transform(in_arrow, run, schema).withColumnRenamed("id", id_col)
