"""Substring dedup by a log-structured index of window fingerprints.

A window is 35 consecutive words. Its fingerprint is the least hash of the 16-word grams in it, so equal windows have
equal fingerprints, neighbouring windows mostly share theirs, and the index takes about a tenth of a row a word. Each
batch of documents becomes one immutable run, sorted by fingerprint, in the shared folder. While it is written it is
merge-joined with the live runs of the batches before, so that it says which of its fingerprints history has; two runs
of a level are then merged into one of the next.

Fingerprints met twice are candidates only. All windows with such a fingerprint are verified by 128 bits of SHA-256 of
their words' bytes; what tells texts apart is such a digest as well. Within a task, repeats that are certain already are
counted before the shuffle, so a passage that very many documents share reaches the verifying task about once a
task; verification streams through sorted rows and holds none of them.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeweave.sources.fs import Files

from .common import drop_path, in_arrow, new_path, pieces, settings, text_bytes
from .hashing import grams, sliding_min, within, word_hashes

U64 = np.uint64
WINDOW, GRAM = 35, 16
#: Bits of the filter of candidate fingerprints that tasks get: 64 for each, within these powers of two. The most is
#: 64 MB; beyond some 10^7 candidates it lets more windows through to verification, and never drops one.
LEAST_BITS, MOST_BITS = 20, 29
#: Runs of one level that are merged into one of the next.
FANOUT = 2
#: Certain repeats that a task remembers; it only saves rows of the shuffle.
REMEMBERED = 1 << 18
ENTRY = "fp long, n tinyint"


def _windows(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the texts' windows among all words, the windows' texts, fingerprints and the fingerprints' places."""
    hashes, offsets = word_hashes(texts)
    at, text = within(offsets, window)
    gram = min(GRAM, window)
    fp, place = sliding_min(grams(hashes, gram), window - gram + 1)
    return at - offsets[:-1][text], text, fp[at], place[at]


def _counted(df: DataFrame, text_col: str, window: int) -> DataFrame:
    """(fp, n): the fingerprints of all windows, n 1 or 2 for one or more places. Equal windows have equal
    fingerprints at equal distance from their starts, so at two places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            at, _, fp, place = _windows(text_bytes(b.column("text")), window)
            if len(at):
                got, n = np.unique(fp[np.concatenate(([True], place[1:] != place[:-1]))], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], ["fp", "n"])

    rows = df.select(F.col(text_col).alias("text")).transform(in_arrow, run, ENTRY)
    return rows.groupBy("fp").agg(F.least(F.sum("n"), F.lit(2)).cast("tinyint").alias("n"))


class FingerprintIndex:
    """Immutable runs of (fp, n) under one folder, each a bucketed table with its buckets sorted by fp.

    fp occurs once in a run; n is 2 if it had been met at two places or more, in the run's batch or in those before.
    The newest manifest names the live runs, so an index may be opened again by its path, by another session too. Joins
    of runs, and of a batch with them, neither shuffle nor sort a run. A run that no manifest names, as an add that was
    broken off may leave, is written over.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW, fanout: int = FANOUT, buckets: int | None = None):
        """buckets: of every run, for the life of the index; as many as shuffles have partitions if not given."""
        self.spark, self.path, self.files, self.fanout = spark, path or new_path(spark, "fingerprints"), Files(spark), max(2, fanout)
        self.name = f"fingerprints_{uuid.uuid4().hex}"
        self.runs: list[tuple[int, int]] = []  # (level, number), the oldest first
        self.made, self.version, self.window = 0, 0, window
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        manifests = [n for n in self.files.names(self.path) if n.startswith("manifest-") and n.endswith(".json")]
        if manifests:
            said = json.loads(self.files.read(f"{self.path}/{max(manifests)}"))
            if said["window"] != window:
                raise ValueError(f"the index is of windows of {said['window']} words")
            self.version, self.made, self.buckets, self.runs = said["version"], said["made"], said["buckets"], [tuple(x) for x in said["runs"]]

    def _settings(self):
        """For writing runs: one partition a bucket, and scans that say how their buckets are sorted."""
        return settings(self.spark, {"spark.sql.shuffle.partitions": self.buckets, "spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.autoBroadcastJoinThreshold": -1, "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"})

    def _at(self, number: int) -> str:
        return f"{self.path}/run-{number:06d}"

    def read(self, number: int) -> DataFrame:
        name = f"{self.name}_{number}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"create table {name} (fp bigint, n tinyint) using parquet options (path '{self._at(number)}') clustered by (fp) sorted by (fp) into {self.buckets} buckets")
        return self.spark.table(name)

    def _write(self, df: DataFrame) -> int:
        self.made += 1
        df.write.mode("overwrite").format("parquet").bucketBy(self.buckets, "fp").sortBy("fp").option("path", self._at(self.made)).saveAsTable(f"{self.name}_{self.made}")
        return self.made

    def _commit(self, runs: list[tuple[int, int]]) -> None:
        self.runs, self.version = runs, self.version + 1
        self.files.write(f"{self.path}/manifest-{self.version:06d}.json", json.dumps({"version": self.version, "made": self.made, "window": self.window, "buckets": self.buckets, "runs": runs}))

    def joined(self, batch: DataFrame) -> DataFrame:
        """A batch's (fp, n) merge-joined with all live runs: n is 2 if the batch and history have two places."""
        out, total = batch, F.col("n").cast("int")
        for _, number in self.runs:
            run = self.read(number).select(F.col("fp").alias(f"fp{number}"), F.col("n").alias(f"n{number}"))
            out = out.join(run.hint("merge"), F.col("fp") == F.col(f"fp{number}"), "left")
            total = total + F.coalesce(f"n{number}", F.lit(0))
        return out.select("fp", F.least(total, F.lit(2)).cast("tinyint").alias("n"))

    def add(self, batch: DataFrame, text_col: str = "text") -> None:
        """A new run from a batch of documents, joined with history as it is written; then merges of full levels."""
        with self._settings():
            number = self._write(self.joined(_counted(batch, text_col, self.window)))
        self._commit([*self.runs, (0, number)])
        level = 0
        while sum(x == level for x, _ in self.runs) >= self.fanout:
            self.compact(level)
            level += 1

    def merged(self, a: int, b: int) -> DataFrame:
        """Two runs as one, by a full outer merge join of their sorted buckets."""
        more = self.read(b).select(F.col("fp").alias("fp2"), F.col("n").alias("n2"))
        both = self.read(a).hint("merge").join(more, F.col("fp") == F.col("fp2"), "full_outer")
        return both.select(F.coalesce("fp", "fp2").alias("fp"), F.least(F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0)), F.lit(2)).cast("tinyint").alias("n"))

    def compact(self, level: int | None = None) -> None:
        """The runs of one level, or all, become one, two at a time; old ones go once the manifest names the new one."""
        old = [x for x in self.runs if level is None or x[0] == level]
        while len(old) > 1:
            (_, a), (_, b), *rest = old
            with self._settings():
                number = self._write(self.merged(a, b))
            new = (max(x for x, _ in old) + (not rest), number)
            self._commit([new, *(x for x in self.runs if x[1] not in (a, b))])
            self._forget(a, b)
            old = [new, *rest]

    def _forget(self, *numbers: int) -> None:
        for number in numbers:
            self.spark.sql(f"drop table if exists {self.name}_{number}")
            drop_path(self.spark, self._at(number))

    def drop(self) -> None:
        """Deletes the index."""
        self._forget(*(number for _, number in self.runs))
        drop_path(self.spark, self.path)

    def repeated(self) -> DataFrame:
        """(fp) of fingerprints met at two places or more; one may stand in several runs."""
        none = self.spark.createDataFrame([], "fp long")
        return none.union(self.spark.read.schema(ENTRY).parquet(*[self._at(x) for _, x in self.runs]).where("n >= 2").select("fp")) if self.runs else none

    def filter(self) -> np.ndarray:
        """A filter of repeated(): 2^k bits, two for each fingerprint."""
        count = self.repeated().count()
        k = min(MOST_BITS, max(LEAST_BITS, (64 * count).bit_length()))
        low = F.shiftrightunsigned("fp", 64 - 2 * k).bitwiseAND((1 << k) - 1)
        slots = self.repeated().select(F.explode(F.array(F.shiftrightunsigned("fp", 64 - k), low)).alias("slot"))
        bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
        rows = slots.groupBy(F.shiftright("slot", 6).cast("int").alias("at")).agg(F.bit_or(bit).alias("word")).toArrow()
        out = np.zeros(1 << (k - 6), np.int64)
        out[np.asarray(rows.column("at"))] = np.asarray(rows.column("word"))
        return out.view(U64)


def _passes(bits: np.ndarray, fp: np.ndarray) -> np.ndarray:
    k = (len(bits) * 64).bit_length() - 1

    def has(slot):
        return (bits[slot >> U64(6)] >> (slot & U64(63)) & U64(1)).astype(bool)

    return has(fp >> U64(64 - k)) & has(fp >> U64(64 - 2 * k) & U64((1 << k) - 1))


def _wide(data: bytes) -> bytes:
    return sha256(data).digest()[:16]


def _pairs(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def window_digests(text: bytes, places: np.ndarray, window: int) -> list[bytes]:
    """Digests of the words of the windows that start at these words, joined by one space."""
    words = text.split()
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size)
    return [_wide(joined[a:b]) for a, b in zip((end - size)[places].tolist(), (end[places + window - 1] - 1).tolist(), strict=True)]


class _Certain:
    """Digests of windows that a task knows to repeat; when there are too many, it starts anew."""

    def __init__(self):
        self.w1, self.w2 = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def has(self, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        if not len(self.w1):
            return np.zeros(len(w1), bool)
        at = np.minimum(np.searchsorted(self.w1, w1), len(self.w1) - 1)
        return (self.w1[at] == w1) & (self.w2[at] == w2)

    def add(self, w1: np.ndarray, w2: np.ndarray) -> None:
        if len(self.w1) + len(w1) <= REMEMBERED:
            w1, w2 = np.concatenate((self.w1, w1)), np.concatenate((self.w2, w2))
        order = np.argsort(w1, kind="stable")[:REMEMBERED]
        self.w1, self.w2 = w1[order], w2[order]


#: Of rows on their way to verification: k1 and k2 the text's digest, a and b the first window's start and the last
#: one's, plus one; w1 and w2 the window's digest; n how many places the row stands for, or CERTAIN.
SPAN = "k1 long, k2 long, a int, b int"
CERTAIN = 3


def _rows(k1, k2, a, b, w1, w2, n: int) -> pa.RecordBatch:
    m = len(w1)
    full = lambda x, kind: pa.array(np.broadcast_to(np.asarray(x, kind), m).copy())
    return pa.RecordBatch.from_arrays([full(k1, np.int64), full(k2, np.int64), full(a, np.int32), full(b, np.int32), full(w1, np.int64), full(w2, np.int64), full(n, np.int8)], ["k1", "k2", "a", "b", "w1", "w2", "n"])


def repeated_windows(texts: DataFrame, window: int, bits) -> DataFrame:
    """(k1, k2, spans array<long>): for the digest of each text that has any, the stretches of windows that start at
    another place of texts too, each as first << 32 | last + 1.

    texts: (text) rows; copies of a text count as many places. bits: the broadcast filter of an index that holds them.
    """
    spark = texts.sparkSession

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        certain, told = _Certain(), set()
        for batch in pieces(batches, "text"):
            number: dict[bytes, int] = {}
            for t in text_bytes(batch.column("text")):
                number[t] = number.get(t, 0) + 1
            each, copies = list(number), np.fromiter(number.values(), np.int64, len(number))
            place, text, fp, _ = _windows(each, window)
            take = _passes(bits.value, fp)
            if not take.any():
                continue
            place, text = place[take], text[take]
            cut = np.flatnonzero(np.diff(text)) + 1
            first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(text)]))
            digests = [d for x, y in zip(first, last, strict=True) for d in window_digests(each[text[x]], place[x:y], window)]
            w1, w2 = _pairs(digests)
            keys = np.zeros((len(each), 2), np.int64)
            keys[text[first], 0], keys[text[first], 1] = _pairs([_wide(each[t]) for t in text[first]])
            # places in this piece of the same words
            order = np.lexsort((w2, w1))
            new = np.concatenate(([True], (w1[order][1:] != w1[order][:-1]) | (w2[order][1:] != w2[order][:-1])))
            group = np.cumsum(new) - 1
            here = np.empty(len(order), np.int64)
            here[order] = np.bincount(group, copies[text[order]])[group]
            heads = order[new]  # one place of each window
            before = certain.has(w1, w2)
            known = before | (here > 1)
            once = np.flatnonzero(~known)
            yield _rows(keys[text[once], 0], keys[text[once], 1], place[once], place[once] + 1, w1[once], w2[once], 1)
            told_now = heads[(here[heads] > 1) & ~before[heads]]  # signals to the other tasks, without a place
            if len(told_now):
                yield _rows(0, 0, -1, -1, w1[told_now], w2[told_now], 2)
                certain.add(w1[told_now], w2[told_now])
            at = np.flatnonzero(known)
            if len(at):  # stretches of neighbours
                new = np.concatenate(([True], (text[at][1:] != text[at][:-1]) | (place[at][1:] != place[at][:-1] + 1)))
                begin, end = at[new], at[np.concatenate((new[1:], [True]))]
                a, b, k = place[begin], place[end] + 1, keys[text[begin]]
                if len(told) > REMEMBERED:
                    told.clear()
                names = list(zip(k[:, 0].tolist(), k[:, 1].tolist(), a.tolist(), b.tolist(), strict=True))
                fresh = np.array([x not in told for x in names], bool)
                told.update(names)
                yield _rows(k[fresh, 0], k[fresh, 1], a[fresh], b[fresh], k[fresh, 0] ^ a[fresh], k[fresh, 1] ^ b[fresh], CERTAIN)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.select("text").transform(in_arrow, candidates, f"{SPAN}, w1 long, w2 long, n tinyint").repartition(parts, "w1").sortWithinPartitions("w1", "w2", "k1", "k2", "a")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of windows that have two or more, each once, and what is certain; a window's first place waits for the second."""
        wait, last, total = None, None, 0  # the row that waits, its window, how many places that has so far

        def out(b: pa.RecordBatch, keep: np.ndarray) -> pa.RecordBatch:
            return b.select(["k1", "k2", "a", "b"]).filter(pa.array(keep))

        for b in batches:
            k1, k2, a, w1, w2, n = (np.asarray(b.column(x)) for x in ("k1", "k2", "a", "w1", "w2", "n"))
            again = np.zeros(len(a), bool)  # the same place of a copy
            again[1:] = (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1]) & (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1]) & (a[1:] == a[:-1]) & (n[1:] == n[:-1])
            sure = n == CERTAIN
            if sure.any():
                yield out(b, sure & ~again)
                rest = ~sure
                b, again = b.filter(pa.array(rest)), again[rest]
                a, w1, w2, n = a[rest], w1[rest], w2[rest], n[rest]
            if not len(a):
                continue
            new = np.concatenate(([last != (w1[0], w2[0])], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])))
            group = np.cumsum(new)  # 0: goes on from the batch before
            places = np.bincount(group, n, group[-1] + 1)
            places[0] += total
            if wait is not None and not new[0] and places[0] > 1:
                yield wait
                wait = None
            yield out(b, (places[group] > 1) & (a >= 0) & ~again)
            if group[-1]:
                wait = None
            if places[-1] == 1 and a[-1] >= 0 and n[-1] == 1:
                wait = b.select(["k1", "k2", "a", "b"]).slice(len(a) - 1, 1)
            last, total = (w1[-1], w2[-1]), places[-1]

    spans = dealt.transform(in_arrow, verify, SPAN)
    return spans.groupBy("k1", "k2").agg(F.collect_list(F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))).alias("spans"))


def remove_repeats(
    df: DataFrame, window: int = WINDOW, batches: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), as_is: bool = False, index: FingerprintIndex | None = None, history: DataFrame | None = None
) -> DataFrame:
    """(id, n_words long, n_removed long, kept string) for each row: the text without repeated passages.

    Columns named in carry come along, in a struct `rest` after these. as_is: a text that loses nothing is kept as it
    is written, null too, instead of its words joined by one space.

    Removed is each word covered by a window of `window` words that also starts anywhere else, in the same text or
    another; all copies go, judged on the input. Kept words are joined by one space. Words are as written, parted by
    0x20 and 0x09-0x0D. Null, empty and short texts lose nothing (null: no words, kept is empty). Texts are told apart
    by their bytes alone, so ids may be null, repeat or be of any type; rows of equal texts are copies, so their windows
    go. Empty tables give none.
    The index takes the documents in `batches` batches; how many changes nothing in the result.
    index, history: an index that has taken the texts of history, for which there are no rows in the result. df is
    judged on both, and the index has taken df too afterwards.
    """
    spark = df.sparkSession
    own = index is None
    index = FingerprintIndex(spark, window=window) if own else index
    for i in range(batches):
        index.add(df.where(F.pmod(F.hash(F.col(text_col)), F.lit(batches)) == i) if batches > 1 else df, text_col)
    bits = spark.sparkContext.broadcast(index.filter())
    if own:
        index.drop()
    texts = df.select(F.col(text_col).alias("text"))
    flags = repeated_windows(texts if history is None else texts.union(history.select(text_col)), window, bits)
    rest = F.struct(*carry) if carry else F.lit(None).cast("int")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), rest.alias("rest"))
    names = ["id", "n_words", "n_removed", "kept", "rest"]

    def doubtful(b: pa.RecordBatch) -> np.ndarray:
        _, text, fp, _ = _windows(text_bytes(b.column("text")), window)
        out = np.zeros(b.num_rows, bool)
        out[text[_passes(bits.value, fp)]] = True
        return out

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            b = b.filter(pa.array(doubtful(b)))
            if b.num_rows:
                k1, k2 = _pairs([_wide(t) for t in text_bytes(b.column("text"))])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k1), pa.array(k2)], [*b.schema.names, "t1", "t2"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            b = b.filter(pa.array(~doubtful(b)))
            words = [x.split() for x in text_bytes(b.column("text"))]
            kept = b.column("text").cast(pa.string()) if as_is else pa.array([b" ".join(w).decode() for w in words], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(map(len, words)), pa.int64()), pa.array([0] * len(words), pa.int64()), kept, b.column("rest")], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            total, kept, removed = [], [], []
            for raw, spans in zip(text_bytes(b.column("text")), b.column("spans"), strict=True):
                words = raw.split()
                step = np.zeros(len(words) + 1, np.int64)
                if spans.is_valid:
                    both = np.asarray(spans.values)
                    np.add.at(step, both >> 32, 1)
                    np.add.at(step, (both & 0xFFFFFFFF) + window - 1, -1)
                keep = np.cumsum(step[:-1]) == 0
                total.append(len(words))
                removed.append(len(words) - int(keep.sum()))
                kept.append((raw if as_is and not removed[-1] else b" ".join(itertools.compress(words, keep.tolist()))).decode())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), b.column("rest")], names)

    out = StructType([rows.schema["id"], *StructType.fromDDL("n_words long, n_removed long, kept string"), rows.schema["rest"]])
    keyed = rows.transform(in_arrow, some, StructType([*rows.schema, *StructType.fromDDL("t1 long, t2 long")]))
    left = keyed.join(flags, (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2")), "left").select("id", "text", "rest", "spans")
    done = rows.transform(in_arrow, whole, out).union(left.transform(in_arrow, cut, out)).withColumnRenamed("id", id_col)
    return done if carry else done.drop("rest")
