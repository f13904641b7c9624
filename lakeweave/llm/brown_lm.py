"""Class-based n-gram scoring after Brown et al.: P(w | before) = P(class(w) | class before) * P(w | class(w)).

Every word has a class. Exchange clustering moves each of the commonest words, the core, in turn to the class that most
raises the likelihood of all class bigrams, until few move. All other words fall into hash buckets, as many as there are
words up to a bound, and each bucket takes one exchange step against the core's classes: it goes to the class that
raises the likelihood most, to the first order, by all the contexts that its words have next to core words in the
corpus. So the vocabulary may grow without limit, the table of classes stays small, and a text's classes are known
where the text is. Transitions between classes are counted over the whole corpus after that.

Counts of words grow with the vocabulary, so only those of a head of bounded size go along with the tasks; the tail's
are joined to the texts' rare words by shuffle.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added_up, drop_path, drop_table, in_arrow, new_path, pieces, task_group, text_bytes, with_id, written

#: Words of the core, whose bigrams are counted word by word, and classes. The end of a text is a class of its own.
CORE, CLASSES = 2047, 64
#: Words whose counts every task holds; a tail word's count comes by a join.
HEAD = 200_000
#: Distinct words that a task adds up before it sends them on.
HELD = 300_000
#: Buckets are a power of two, as many as words at least within these bounds; beyond the upper one words share more.
LEAST_BUCKETS, MOST_BUCKETS = 16, 24
#: Kinds of words by their looks; a word whose bucket has no context next to the core goes by its kind.
SHAPES = 12
BLOCK_BITS = 12  # buckets that are assigned together
GATHERED = 1 << 21  # contexts that a task adds up before it sends them on
ROUNDS, MOVED = 8, 0.005
ROWS = 64  # of the bigram matrix, in one block of the shuffle
BY_SHAPE = 255
SMOOTHING, STRENGTH = 0.5, 5.0


def shape(word: bytes) -> int:
    """Whether a word ends with a mark, has other than ASCII bytes, and its length in three steps."""
    last = word[-1]
    mark = last < 128 and not (97 <= last <= 122 or 65 <= last <= 90 or 48 <= last <= 57)
    return (mark * 2 + (not word.isascii())) * 3 + (0 if len(word) <= 4 else 1 if len(word) <= 8 else 2)


def bucket(word: bytes, bits: int) -> int:
    return (zlib.crc32(word) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits)


class Codes(dict):
    """word -> number; what isn't given is worked out once and remembered, as long as that doesn't get too much."""

    def __init__(self, given: dict[bytes, int], work_out):
        super().__init__(given)
        self.given, self.work_out = given, work_out

    def __missing__(self, word: bytes) -> int:
        if len(self) > len(self.given) + HELD:
            self.clear()
            self.update(self.given)
        got = self[word] = self.work_out(word)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _tokens(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All texts' words in a row, A-Z lower-cased, and each text's number of them."""
    words = [t.lower().split() for t in texts]
    return list(itertools.chain.from_iterable(words)), np.array([len(w) for w in words], np.int64)


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of all words of all texts, added up in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for b in pieces(batches, "text"):
            held.update(_tokens(text_bytes(b.column("text")))[0])
            if len(held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    rows = df.select(F.col(text_col).alias("text")).transform(in_arrow, run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _bounded(ids: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """end, text, end, text, ..., end: each text's end is what comes before the next one's first word."""
    at = np.cumsum(np.concatenate(([0], counts)))
    return np.insert(ids, at, end)


SUMS = "at int, part int, counts binary"


def _added(rows: DataFrame) -> dict[int, np.ndarray]:
    """Sums of compressed arrays by `at`: over groups of tasks, then of such groups."""

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in t["counts"].to_pylist())
        return pa.table({"at": t["at"][:1], "part": t["part"][:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    rows = added_up(rows, ("at",), add, SUMS)
    return {r.at: np.frombuffer(zlib.decompress(r.counts), np.int64) for r in rows.collect()}


def _sum_row(at: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([task_group()], pa.int32()), pa.array([zlib.compress(total.astype(np.int64).tobytes(), 1)], pa.binary())], ["at", "part", "counts"])


def gathered(df: DataFrame, core: dict[bytes, int], bits: int, text_col: str = "text") -> DataFrame:
    """All that is learned from the order of words, in one pass: rows (kind, at, part, counts, codes).

    Kind 0: blocks of rows of the matrix of (token, next token), tokens being core words, shapes of others, the end.
    Kind 1: for a block of buckets, how often each stands before and after each core word or end.
    Kind 2: how often a word outside of the core stands before another one, by buckets and shapes.
    """
    m = len(core)
    size = m + SHAPES + 1
    sent = df.sparkSession.sparkContext.broadcast(core)
    names = ["kind", "at", "part", "counts", "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(sent.value, lambda w: m + 1 + bucket(w, bits) * SHAPES + shape(w))  # m is the end
        total, wait, waiting = np.zeros(size * size, np.int64), [], 0
        near: list[np.ndarray] = []
        pairs: list[np.ndarray] = []

        def rows(kind: int, at: list[int], counts: list[bytes], held: list[bytes]):
            n = len(at)
            part = task_group()
            return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int8()), pa.array(at, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(counts, pa.binary()), pa.array(held, pa.binary())], names)

        def sent_on():
            code, n = np.unique(np.concatenate(near or [np.zeros(0, np.int64)]), return_counts=True)
            if len(code):
                block = code >> (BLOCK_BITS + 12)
                cut = np.flatnonzero(np.diff(block)) + 1
                first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(code)]))
                inner, n = (code & ((1 << (BLOCK_BITS + 12)) - 1)).astype(np.uint32), n.astype(np.uint32)
                yield rows(1, block[first].tolist(), [n[a:b].tobytes() for a, b in zip(first, last, strict=True)], [inner[a:b].tobytes() for a, b in zip(first, last, strict=True)])
            code, n = np.unique(np.concatenate(pairs or [np.zeros(0, np.int64)]), return_counts=True)
            if len(code):
                yield rows(2, [0], [n.astype(np.uint32).tobytes()], [code.tobytes()])
            near.clear()
            pairs.clear()

        held = 0
        for b in pieces(batches, "text"):
            words, counts = _tokens(text_bytes(b.column("text")))
            seq = _bounded(codes.of(words), counts, m)
            rare = seq > m
            row = np.where(rare, m + (seq - m - 1) % SHAPES, np.where(seq == m, size - 1, seq))
            wait.append(row[:-1] * size + row[1:])
            waiting += len(wait[-1])
            if waiting > size * size // 4:
                total += np.bincount(np.concatenate(wait), minlength=size * size)
                wait, waiting = [], 0
            place = (seq - m - 1) // SHAPES
            left = rare[:-1] & ~rare[1:]  # a rare word before a core word
            right = ~rare[:-1] & rare[1:]
            near.append(place[:-1][left] << 12 | seq[1:][left])
            near.append(place[1:][right] << 12 | 1 << 11 | seq[:-1][right])
            two = rare[:-1] & rare[1:]
            pairs.append(seq[:-1][two] - m - 1 << 32 | seq[1:][two] - m - 1)
            held += len(near[-1]) + len(near[-2]) + len(pairs[-1])
            if held > GATHERED:
                yield from sent_on()
                held = 0
        yield from sent_on()
        if wait:
            total += np.bincount(np.concatenate(wait), minlength=size * size)
        total = total.reshape(size, size)
        for at in range(0, size, ROWS):
            if total[at : at + ROWS].any():
                yield rows(0, [at], [zlib.compress(total[at : at + ROWS].tobytes(), 1)], [b""])

    return df.select(F.col(text_col).alias("text")).transform(in_arrow, run, f"kind tinyint, {SUMS}, codes binary")


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, words: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Classes of the first `words` tokens of a bigram matrix; the other tokens are classes of their own, in order.

    From classes dealt by rank, each word in turn goes where the sum of n log n over class bigrams, less that over
    classes twice, is largest; of equals to the class with the lower number. Ends when under one in 200 moves.
    """
    classes = max(1, min(classes, words))
    fixed = pairs.shape[0] - words
    k = classes + fixed
    of = np.concatenate((np.arange(words) % classes, classes + np.arange(fixed)))
    pairs = pairs.astype(np.float64)
    to = np.zeros((pairs.shape[0], k))  # counts of each token before each class, and after it
    np.add.at(to.T, of, pairs.T)
    fro = np.zeros((pairs.shape[0], k))
    np.add.at(fro.T, of, pairs)
    both = np.zeros((k, k))
    np.add.at(both, of, to)
    n = pairs.sum(axis=1)
    total = np.bincount(of, n, k)
    for _ in range(rounds):
        moved = 0
        for w in range(words):
            a, self_pairs = of[w], pairs[w, w]
            after, before = to[w].copy(), fro[w].copy()
            after[a] -= self_pairs
            before[a] -= self_pairs
            both[a] -= after
            both[:, a] -= before
            both[a, a] -= self_pairs
            total[a] -= n[w]
            own = both[:classes, :classes].diagonal()
            gain = (_f(both[:classes] + after) - _f(both[:classes])).sum(axis=1) + (_f(both[:, :classes].T + before) - _f(both[:, :classes].T)).sum(axis=1)
            gain -= _f(own + after[:classes]) + _f(own + before[:classes]) - 2 * _f(own)
            gain += _f(own + after[:classes] + before[:classes] + self_pairs) - _f(own)
            gain -= 2 * (_f(total[:classes] + n[w]) - _f(total[:classes]))
            c = a if gain[a] >= gain.max() - 1e-9 else int(gain.argmax())
            both[c] += after
            both[:, c] += before
            both[c, c] += self_pairs
            total[c] += n[w]
            if c != a:
                of[w] = c
                to[:, a] -= pairs[:, w]
                to[:, c] += pairs[:, w]
                fro[:, a] -= pairs[w]
                fro[:, c] += pairs[w]
                moved += 1
        if moved <= MOVED * words:
            break
    return of


@dataclass
class Steps:
    """One exchange step for words outside of the core: the core's class bigrams are what it is measured by.

    A word that is small against its class changes the sum of n log n by its contexts times the logarithms of the
    class's shares of them, so a matrix product gives the gains of all classes.
    """

    of: np.ndarray  # classes of core words, and of the end at last
    after: np.ndarray  # (class, class after it): log share
    before: np.ndarray

    @classmethod
    def from_core(cls, of: np.ndarray, table: np.ndarray) -> Steps:
        smooth = table + SMOOTHING
        return cls(of, np.log(smooth / smooth.sum(axis=1, keepdims=True)), np.log(smooth / smooth.sum(axis=0, keepdims=True)).T)

    def best(self, after: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The class of each row of counts of the classes after and before a word; of equals the lower number."""
        gain = after @ self.after[:-1].T + before @ self.before[:-1].T  # the end's class takes no words
        return np.where(after.any(axis=1) | before.any(axis=1), np.round(gain, 9).argmax(axis=1), BY_SHAPE).astype(np.uint8)


def assigned(rows: DataFrame, steps: Steps, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all buckets, and the counts of class bigrams of a bucket's word and a core word."""
    spark, k = rows.sparkSession, len(steps.after)
    sent = spark.sparkContext.broadcast(steps)
    size = 1 << min(BLOCK_BITS, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, table, block, counts = sent.value, np.zeros((k, k), np.int64), None, None

        def done():
            both = counts.reshape(size, 2, k)
            classes = s.best(both[:, 0].astype(np.float64), both[:, 1].astype(np.float64))
            known = np.flatnonzero(classes != BY_SHAPE)
            np.add.at(table, classes[known], both[known, 0])
            np.add.at(table.T, classes[known], both[known, 1])
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([-1], pa.int32()), pa.array([zlib.compress(classes.tobytes(), 1)], pa.binary())], ["at", "part", "counts"])

        for b in batches:
            for at, n, codes in zip(b.column("at").to_pylist(), b.column("counts").to_pylist(), b.column("codes").to_pylist(), strict=True):
                if at != block:
                    if block is not None:
                        yield done()
                    block, counts = at, np.zeros(size * 2 * k, np.int64)
                codes = np.frombuffer(codes, np.uint32).astype(np.int64)
                place = (codes >> 12) * 2 * k + (codes >> 11 & 1) * k + s.of[codes & 2047]
                counts += np.bincount(place, np.frombuffer(n, np.uint32), size * 2 * k).astype(np.int64)
        if block is not None:
            yield done()
        yield _sum_row(0, table)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = rows.select("at", "counts", "codes").repartition(parts, "at").sortWithinPartitions("at")
    got = written(blocks.transform(in_arrow, run, SUMS), "lm-buckets")
    classes = np.full(1 << bits, BY_SHAPE, np.uint8)
    for r in got.where("part < 0").collect():
        classes[r.at * size : (r.at + 1) * size] = np.frombuffer(zlib.decompress(r.counts), np.uint8)
    table = _added(got.where("part >= 0")).get(0, np.zeros(k * k, np.int64)).reshape(k, k)
    drop_table(got)
    return classes, table


def _class_of(numbers: np.ndarray, classes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Classes of bucket * SHAPES + shape."""
    got = classes[numbers // SHAPES]
    return np.where(got == BY_SHAPE, shapes[numbers % SHAPES], got).astype(np.int64)


def rare_pairs(rows: DataFrame, classes: np.ndarray, shapes: np.ndarray, k: int) -> np.ndarray:
    """Counts of class bigrams of two words outside of the core."""
    sent = rows.sparkSession.sparkContext.broadcast((classes, shapes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(k * k, np.int64)
        for b in batches:
            for n, codes in zip(b.column("counts").to_pylist(), b.column("codes").to_pylist(), strict=True):
                codes = np.frombuffer(codes, np.int64)
                place = _class_of(codes >> 32, *sent.value) * k + _class_of(codes & 0xFFFFFFFF, *sent.value)
                table += np.bincount(place, np.frombuffer(n, np.uint32), k * k).astype(np.int64)
        yield _sum_row(0, table)

    return _added(rows.select("counts", "codes").transform(in_arrow, run, SUMS)).get(0, np.zeros(k * k, np.int64)).reshape(k, k)


def _types(counts: DataFrame, model: Model) -> np.ndarray:
    """How many words each class has."""
    k = model.classes
    sent = counts.sparkSession.sparkContext.broadcast(model.for_tasks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, total = codes_of(sent.value), np.zeros(k + 1, np.int64)
        for b in batches:
            words = text_bytes(b.column("word"))
            total += np.bincount([codes.work_out(w) if (c := codes.given.get(w)) is None else c for w in words], minlength=k + 1) if words else 0
        yield _sum_row(0, total)

    return _added(counts.select("word").transform(in_arrow, run, SUMS)).get(0, np.zeros(k + 1, np.int64))


@dataclass
class Model:
    """What tasks need, and the table of the tail's counts."""

    head: dict[bytes, int]
    head_class: np.ndarray
    head_count: np.ndarray
    core: int  # the first words of the head
    classes: int  # the end is the class after them
    buckets: np.ndarray
    shapes: np.ndarray
    bits: int
    transition: np.ndarray
    class_tokens: np.ndarray
    class_types: np.ndarray
    discount: float
    tokens: int
    types: int
    ends: int
    tail: DataFrame

    def for_tasks(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tail"}

    def emission(self, count: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 of a word's probability in its class, or of any word never seen there, by its count."""
        mass = np.where(count > 0, count - self.discount, self.discount * np.maximum(self.class_types[cls], 1))
        return np.log10(mass / np.maximum(self.class_tokens[cls], 1))


def codes_of(m: dict) -> Codes:
    """Classes of words: of core words their own, of others their bucket's or shape's."""
    core = {w: int(m["head_class"][i]) for w, i in m["head"].items() if i < m["core"]}

    def work_out(word: bytes) -> int:
        got = int(m["buckets"][bucket(word, m["bits"])])
        return int(m["shapes"][shape(word)]) if got == BY_SHAPE else got

    return Codes(core, work_out)


def _head(counts: DataFrame, by_count: list[tuple[int, int]], most: int) -> list[tuple[int, bytes]]:
    """The commonest words, at most so many, sorted. Of the words of the last count that fits in part, those with the
    least hashes come along."""
    least, room = (by_count[0][0] + 1 if by_count else 1), most
    for n, words in by_count:
        if words > room:
            break
        least, room = n, room - words
    take = F.col("n") >= least
    partial = next(((n, words) for n, words in by_count if n < least), None)
    if partial and room:
        share = int((room / partial[1]) * (1 << 30))
        take = take | ((F.col("n") == partial[0]) & (F.shiftrightunsigned(F.xxhash64("word"), 34) < share))
    got = counts.where(take).toArrow()
    return sorted(zip(got["n"].to_pylist(), text_bytes(got["word"].combine_chunks()), strict=True), key=lambda r: (-r[0], r[1]))[:most]


def fit(df: DataFrame, text_col: str = "text", core: int = CORE, classes: int = CLASSES, head: int = HEAD) -> Model:
    """Learns from every row; a null text is an empty one, that is, one end."""
    if not 0 < core <= CORE or not 0 < classes < BY_SHAPE:
        raise ValueError("codes have room for 2047 core words and 254 classes")
    spark = df.sparkSession
    counts = written(word_counts(df, text_col), "lm-counts")
    # how many words have each count: a short list
    by_count = sorted(((r.n, r.words) for r in counts.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True)
    types = sum(w for _, w in by_count)
    bits = min(MOST_BUCKETS, max(LEAST_BUCKETS, types.bit_length()))
    rows = _head(counts, by_count, head)
    index = {w: i for i, (_, w) in enumerate(rows)}
    words = min(core, len(rows))
    path = new_path(spark, "lm-gathered")
    gathered(df, {w: i for w, i in index.items() if i < words}, bits, text_col).write.partitionBy("kind").parquet(path)
    learned = spark.read.schema(f"{SUMS}, codes binary, kind tinyint").parquet(path)
    size = words + SHAPES + 1
    pairs = np.zeros((size, size), np.int64)
    for at, block in _added(learned.where("kind = 0").select("at", "part", "counts")).items():
        pairs[at : at + ROWS] = block.reshape(-1, size)
    of = exchange(pairs, words, classes) if words else np.arange(SHAPES + 1) + 1
    k = max(1, int(of[:words].max(initial=0)) + 1)  # the end is class k
    of_core = np.concatenate((of[:words], [k]))
    # class bigrams of core words and ends, by which the others are measured
    table = np.zeros((k + 1, k + 1), np.int64)
    inner = np.concatenate((np.arange(words), [size - 1]))
    np.add.at(table, (of_core[:, None], of_core[None, :]), pairs[np.ix_(inner, inner)])
    steps = Steps.from_core(of_core, table)
    by_shape = [np.zeros((SHAPES, k + 1)), np.zeros((SHAPES, k + 1))]
    np.add.at(by_shape[0].T, of_core, pairs[words : words + SHAPES, inner].T)
    np.add.at(by_shape[1].T, of_core, pairs[inner, words : words + SHAPES])
    shapes = steps.best(*by_shape)
    shapes = np.where(shapes == BY_SHAPE, 0, shapes)
    buckets, rare = assigned(learned.where("kind = 1"), steps, bits)
    table = table + rare + rare_pairs(learned.where("kind = 2"), buckets, shapes, k + 1)
    drop_path(spark, path)
    tokens = table.sum(axis=0)
    share = (tokens + 0.5) / (tokens.sum() + 0.5 * (k + 1))
    transition = np.log10((table + STRENGTH * share) / (table.sum(axis=1, keepdims=True) + STRENGTH))
    ends = int(pairs[-1].sum())
    ones, twos = (dict(by_count).get(n, 0) for n in (1, 2))
    discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
    total = sum(n * w for n, w in by_count) + ends
    head_class = np.concatenate((of[:words], np.zeros(len(rows) - words, np.int64))).astype(np.int64)
    tail = counts if len(rows) < types else counts.limit(0)
    model = Model(index, head_class, np.array([n for n, _ in rows], np.float64), words, k, buckets, shapes, bits, transition, tokens[:k], np.ones(k + 1), discount, total, types + (ends > 0), ends, tail)
    codes = codes_of(model.for_tasks())
    head_class[words:] = codes.of([w for _, w in rows[words:]])
    model.class_types = _types(counts, model)[:k]
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row.

    Tokens are the A-Z lower-cased words and one end. n_known: tokens seen in training. base_score: sum of log10 of
    (count + 1) / (N + V + 1) over tokens. score: log10 of the class model's probability of the whole text, its end
    included. A null text is an empty one; texts without words have the end alone. Rows are told apart by their place
    in a table written on the way, so ids may be null or repeat, with equal or different texts. Empty tables give no
    rows.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(model.for_tasks())
    all_log = float(np.log10(model.tokens + model.types + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        codes, n_head, end, row = codes_of(m), len(m["head"]), m["classes"], TaskContext.get().partitionId() << 40
        codes.given = m["head"]  # numbers of head words; a tail word has its class after them
        codes.clear()
        codes.update(codes.given)
        class_of = codes.work_out
        codes.work_out = lambda w: n_head + class_of(w)
        count, cls = m["head_count"], np.concatenate((m["head_class"], np.arange(end)))
        mine = Model(**m, tail=None)
        base = np.concatenate((np.log10(count + 1) - all_log, np.zeros(end)))
        emission = np.concatenate((mine.emission(count, m["head_class"]), np.zeros(end)))
        for b in pieces(batches, "text"):
            words, counts = _tokens(text_bytes(b.column("text")))
            ids = codes.of(words)
            n = len(counts)
            text = np.repeat(np.arange(n), counts)
            seq = _bounded(cls[ids], counts, end)
            step = np.bincount(np.repeat(np.arange(n), counts + 1), m["transition"][seq[:-1], seq[1:]], n)
            base_sum = np.bincount(text, base[ids], n) + np.log10(m["ends"] + 1) - all_log
            known = np.bincount(text, ids < n_head, n).astype(np.int64) + (m["ends"] > 0)
            rare = np.flatnonzero(ids >= n_head).tolist()
            each = Counter(zip(text[rare].tolist(), [words[i] for i in rare], (ids[rare] - n_head).tolist(), strict=True))
            texts = np.fromiter((t for t, _, _ in each), np.int64, len(each))
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(texts, minlength=n)))), pa.int32())
            lists = pa.array([w.decode() for _, w, _ in each], pa.string()), pa.array([c for _, _, c in each], pa.int16()), pa.array(list(each.values()), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), b.column("id"), pa.array(counts + 1), pa.array(known), pa.array(base_sum), pa.array(step + np.bincount(text, emission[ids], n)), *(pa.ListArray.from_arrays(offsets, x) for x in lists)],
                ["row", "id", "n_tokens", "n_known", "base", "model", "words", "classes", "times"],
            )
            row += n

    kind = with_id(df, id_col, "x int")["id"].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = written(rows.transform(in_arrow, run, f"row long, id {kind}, n_tokens long, n_known long, base double, model double, words array<string>, classes array<smallint>, times array<int>"), "lm-rows")
    tail = rows.select("row", F.explode(F.arrays_zip("words", "classes", "times")).alias("x")).select("row", "x.*")
    tail = tail.join(model.tail.select(F.col("word").alias("w"), "n"), F.col("words") == F.col("w"), "left")
    n, d, at = F.coalesce(F.col("n"), F.lit(0)), F.lit(model.discount), F.col("classes").cast("int") + 1
    of = lambda values: F.element_at(F.array(*map(F.lit, np.maximum(values, 1).astype(float).tolist())), at)
    emitted = F.log10(F.when(n > 0, n - d).otherwise(d * of(model.class_types)) / of(model.class_tokens))
    tail = tail.groupBy("row").agg(F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * (F.log10(n + 1.0) - all_log)).alias("b"), F.sum(F.col("times") * emitted).alias("m"))
    rows = rows.select("row", "id", "n_tokens", "n_known", "base", "model").join(tail.withColumnRenamed("row", "of"), F.col("row") == F.col("of"), "left")
    more = lambda c, x: F.col(c) + F.coalesce(F.col(x), F.lit(0))
    return rows.select(F.col("id").alias(id_col), "n_tokens", more("n_known", "known").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), more("base", "b").alias("base_score"), more("model", "m").alias("score"))
