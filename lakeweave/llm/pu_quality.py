"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are all it learns from. With the squared loss, the risk of a linear score is a
quadratic form of the two kinds' second moments, which tasks add up over every text in one pass: the risk of positives,
plus that of the unlabelled texts less the positives' share of it, which stands in for the risk of negatives. The latter
is held at zero or above by a Lagrange multiplier, so the unbiased estimate can't be driven negative by overfitting. The
class prior, and the probability that a score stands for, come from histograms of the scores of texts that the weights
were not learned from: a checksum deals every text to one of the two uses.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added_up, in_arrow, pieces, task_group, with_id
from .hashing import grams, mix, within, word_hashes

HASHED = 1024
PLAIN = 9 + 10
WIDTH = PLAIN + HASHED
#: Trusted ids that positives are taken from: those with the least hashes. Unlabelled texts have no bound.
MOST_POSITIVE = 4000
THRESHOLD = 0.3
#: What hashed frequencies are scaled by against the statistics: there are many, and each says little.
SHRINK = 0.3
#: Weight of the squared weights, of the probe by which the prior is estimated and of the classifier.
PROBE_RIDGE, RIDGE = 0.1, 0.3
#: Bins of the histograms of scores, from -REACH to REACH.
BINS, REACH = 1024, 3.0

_KIND = np.zeros(256, np.int8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 stops, 5 other punctuation, 6 space, 7 line end, 8 beyond ASCII
for _k, _set in enumerate((string.ascii_lowercase, string.ascii_uppercase, string.digits, ".,;:?'\"-()", "!@#$%&*+/<=>[\\]^_`{|}~", " \t", "\n\r"), 1):
    _KIND[[ord(c) for c in _set]] = _k
_KIND[128:] = 8


def features(texts: list[bytes]) -> np.ndarray:
    """For each text: shares of character kinds, word and line statistics, and hashed frequencies of byte trigrams."""
    n = len(texts)
    size = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts) + b"\0\0", np.uint8)
    text = np.repeat(np.arange(n), size)
    kinds = np.bincount(text * 9 + _KIND[data[:-2]], minlength=n * 9).reshape(n, 9) / np.maximum(size, 1)[:, None]
    code = data[:-2].astype(np.uint32) << 16 | data[1:-1].astype(np.uint32) << 8 | data[2:]
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(22)
    inner = np.ones(len(text), bool)
    ends = np.cumsum(size)
    for back in (1, 2):  # trigrams that would go on into the next text
        inner[np.maximum(ends - back, 0)[size >= back]] = False
    share = np.bincount(text[inner] * HASHED + bucket[inner], minlength=n * HASHED).reshape(n, HASHED)
    hashes, offsets = word_hashes(texts)
    words = np.diff(offsets)
    of = np.repeat(np.arange(n), words)
    order = np.lexsort((hashes, of))
    h, o = hashes[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[new], minlength=n)
    runs = np.diff(np.concatenate((np.flatnonzero(new), [len(h)])))
    top = np.zeros(n)
    np.maximum.at(top, o[new], runs)
    # words that come again at once, and pairs of words that come again anywhere in the text
    again = np.bincount(of[1:], (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1]), n) if len(of) else np.zeros(n)
    at, pair_of = within(offsets, 2)
    _, one = np.unique(grams(hashes, 2)[at] ^ mix(pair_of.astype(np.uint64) + np.uint64(1)), return_index=True)
    pairs = np.bincount(pair_of[one], minlength=n)
    lines = [t.split(b"\n") for t in texts]
    some = np.maximum(words, 1)
    stats = np.stack([np.log1p(words), kinds[:, 1:].sum(axis=1) * size / some / 10, distinct / some, top / some, np.array([len(set(x)) / len(x) for x in lines]), np.log1p([len(x) for x in lines]) / 5, words == 0, again / some, pairs / np.maximum(words - 1, 1), np.sqrt(again / some)], axis=1)
    return np.concatenate((kinds, stats, np.sqrt(share / np.maximum(share.sum(axis=1), 1)[:, None])), axis=1).astype(np.float32)


@dataclass
class Model:
    """A linear score and the probabilities that it stands for, at the middles of the bins."""

    weights: np.ndarray
    bias: float
    prior: float
    curve: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        middles = (np.arange(BINS) + 0.5) / BINS * 2 * REACH - REACH
        return np.clip(np.interp(self.raw(x), middles, self.curve), 0, 1)


UNSURE = Model(np.zeros(WIDTH), 0.0, 0.5, np.full(BINS, 0.5))
PIECE = "at int, part int, data binary"


def _summed(rows: DataFrame) -> dict[int, np.ndarray]:
    """Sums of arrays by `at`, over groups of tasks, then of such groups; tasks send single precision."""

    def adder(kind):
        def add(t: pa.Table) -> pa.Table:
            total = np.zeros(1)
            for x in t["data"].to_pylist():
                total = total + np.frombuffer(zlib.decompress(x), kind)
            return pa.table({"at": t["at"][:1], "part": t["part"][:1], "data": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

        return add

    rows = added_up(rows, ("at",), adder(np.float64), PIECE, first=adder(np.float32))
    return {r.at: np.frombuffer(zlib.decompress(r.data), np.float64) for r in rows.collect()}


def _piece(at: int, total: np.ndarray) -> pa.RecordBatch:
    data = zlib.compress(total.astype(np.float32).tobytes(), 1)
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([task_group()], pa.int32()), pa.array([data], pa.binary())], ["at", "part", "data"])


def _texts(b: pa.RecordBatch) -> np.ndarray:
    return features([(t or "").encode() for t in b.column("text").to_pylist()])


def _dealt(batches: Iterator[pa.RecordBatch], use: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features, and which are trusted, of the texts of one use: 0 for weights, 1 for histograms."""
    for b in pieces(batches, "text"):
        b = b.filter(pa.array([zlib.crc32((t or "").encode()) & 1 == use for t in b.column("text").to_pylist()], pa.bool_()))
        if b.num_rows:
            yield _texts(b), b.column("trusted").to_numpy(zero_copy_only=False).astype(bool)


def moments(rows: DataFrame) -> dict[int, np.ndarray]:
    """Sums of x x' over all texts for weights (0) and the trusted ones (1), x having a one at last; (text, trusted) rows.

    A task sends two triangles of a fixed size. Kinds without a text are left out.
    """
    upper = np.triu_indices(WIDTH + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((2, WIDTH + 1, WIDTH + 1)), [False, False]
        for x, trusted in _dealt(batches, 0):
            x = np.concatenate((x, np.ones((len(x), 1), np.float32)), axis=1)
            for k, part in enumerate((x, x[trusted])):
                if len(part):
                    total[k] += part.T @ part
                    some[k] = True
        for k in (0, 1):
            if some[k]:
                yield _piece(k, total[k][upper])

    out = {}
    for k, flat in _summed(rows.transform(in_arrow, run, PIECE)).items():
        half = np.zeros((WIDTH + 1, WIDTH + 1))
        half[upper] = flat
        out[k] = half + np.triu(half, 1).T
    return out


def histograms(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """How many of all texts for histograms, and of the trusted ones, have their raw score in each bin."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BINS))
        for x, trusted in _dealt(batches, 1):
            at = np.clip((sent.value.raw(x) + REACH) / (2 * REACH) * BINS, 0, BINS - 1).astype(np.int64)
            total[0] += np.bincount(at, minlength=BINS)
            total[1] += np.bincount(at[trusted], minlength=BINS)
        yield _piece(0, total)

    got = _summed(rows.transform(in_arrow, run, PIECE)).get(0, np.zeros(2 * BINS))
    return got[:BINS], got[BINS:]


def prior_of(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """The share of positives among the unlabelled, from histograms of a probe that tells the two samples apart.

    Above any score the unlabelled have at least prior times the positives' share, so the least ratio of the two
    shares bounds the prior; the score is chosen where that bound, with a margin for the samples' size, is least.
    """
    share_u, share_p = (np.cumsum(x[::-1])[::-1] / x.sum() for x in (unlabelled, positive))
    enough = share_p >= 0.1
    margin = sum(np.sqrt(np.log(40) / 2 / x.sum()) for x in (unlabelled, positive))
    best = np.argmin((share_u[enough] + margin) / share_p[enough])
    return float(np.clip(share_u[enough][best] / share_p[enough][best], 0.02, 0.98))


def least_risk(unl: np.ndarray, pos: np.ndarray, prior: float, ridge: float = RIDGE) -> np.ndarray:
    """Weights, the bias at last, of least prior * risk(positives) + max(0, risk(unlabelled) - prior * its positives').

    unl, pos: mean x x'. Where the unbounded minimum has a negative second part, the least risk lies where that part is
    zero: the multiplier between 0 and 1 is found by halving. The bias is not held small.
    """
    small = ridge * np.eye(len(unl))
    small[-1, -1] = 1e-9

    def at(m: float) -> np.ndarray:
        return np.linalg.solve(prior * (1 - m) * pos + m * unl + small, prior * (1 + m) * pos[-1] - m * unl[-1])

    def negative(w: np.ndarray) -> float:
        return (w @ unl @ w + 2 * unl[-1] @ w + 1 - prior * (w @ pos @ w + 2 * pos[-1] @ w + 1)) / 4

    w, low, high = at(1.0), 0.0, 1.0
    if negative(w) >= 0:
        return w
    for _ in range(20):
        m = (low + high) / 2
        low, high = (low, m) if negative(at(m)) < 0 else (m, high)
    return at(low)


def rising(num: np.ndarray, den: np.ndarray) -> np.ndarray:
    """num / den, made to rise by pooling neighbours that don't."""
    pools: list[list[float]] = []
    for a, b in zip(num.tolist(), den.tolist(), strict=True):
        pools.append([a, b, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a, b, n = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + b, pools[-1][2] + n]
    return np.concatenate([np.full(int(n), a / max(b, 1e-300)) for a, b, n in pools])


def fit(df: DataFrame, positives: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_positive: int = MOST_POSITIVE) -> Model:
    """positives: (id) of trusted texts; df: all texts, which together are the unlabelled ones.

    Every text of df counts, whatever its id, null texts as empty ones; three passes over them send the driver arrays
    of a fixed size. Trusted are the texts of at most most_positive ids, those with the least hashes, which is the one
    bounded sample; all rows of such an id count, and a null id trusts none. Without positives or other texts for both
    uses every text gets the score 0.5.
    """
    picked = positives.select(F.col(id_col).cast("string").alias("key")).where("key is not null").distinct().orderBy(F.xxhash64("key"), "key").limit(most_positive)
    picked = df.sparkSession.createDataFrame(picked.toArrow(), "key string").withColumn("trusted", F.lit(True))
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), F.col("id") == F.col("key"), "left")
    rows = rows.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    sums = moments(rows)
    if 0 not in sums or 1 not in sums:
        return UNSURE
    unl, pos = (sums[k] / sums[k][-1, -1] for k in (0, 1))
    mean = unl[-1, :-1]
    scale = np.sqrt(np.maximum(unl.diagonal()[:-1] - mean * mean, 0)) + 1e-3
    scale[-HASHED:] /= SHRINK
    # the same moments of (x - mean) / scale
    to = np.diag(np.append(1 / scale, 1.0))
    to[:-1, -1] = -mean / scale
    unl, pos = to @ unl @ to.T, to @ pos @ to.T

    def of_raw(w: np.ndarray) -> tuple[np.ndarray, float]:
        flat = w @ to
        return flat[:-1], float(flat[-1])

    # the probe has the few plain statistics alone, so that it can't learn the trusted texts by heart
    few = np.append(np.arange(PLAIN), WIDTH)
    both = (unl + pos)[np.ix_(few, few)] / 2 + PROBE_RIDGE * np.eye(len(few))
    probe = np.zeros(WIDTH + 1)
    probe[few] = np.linalg.solve(both, (pos[-1] - unl[-1])[few] / 2)
    model = replace(UNSURE, **dict(zip(("weights", "bias"), of_raw(probe), strict=True)))
    every, some = histograms(rows, model)
    if not some.any():
        return UNSURE
    prior = prior_of(every, some)
    weights, bias = of_raw(least_risk(unl, pos, prior))
    model = Model(weights, bias, prior, UNSURE.curve)
    all_texts, trusted = histograms(rows, model)
    # empty bins take a neighbour's probability, as they are pooled with it
    curve = prior * rising(trusted / trusted.sum() + 1e-12, all_texts / all_texts.sum() + 1e-12)
    return replace(model, curve=np.clip(curve, 0, 1))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row: the model's probability that a whole text is of good quality, from 0 to 1.

    Null counts as empty, and empty texts have a score as well. Rows are independent, ids may be null or repeat, equal
    texts have equal scores; no shuffle. Empty tables give none.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sent.value.score(_texts(b)).astype(np.float64))], ["id", "score"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).transform(in_arrow, run, with_id(df, id_col, "score double")).withColumnRenamed("id", id_col)
