"""Benchmark decontamination by greedy string tiling.

A text and a benchmark item are compared only if they share a run of words, the seed. Then tiles are laid: the longest
matches that overlap no earlier tile are marked, over and over, found by running Karp-Rabin hashes of shrinking length.
Tiles may stand in any order, so reordered passages count as well. An item leaks if tiles cover enough of its words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, pieces, text_bytes, with_id
from .hashing import grams, within, word_hashes

U64 = np.uint64
#: Least words of a tile, and least share of an item's words under tiles.
TILE, COVERAGE = 5, 0.5
#: Bytes of benchmark text that go along with the tasks at a time; a larger benchmark goes in blocks.
BLOCK_BYTES = 16 << 20
BASE, MODULUS = 1_000_003, (1 << 61) - 1


def normal(text: bytes) -> bytes:
    """A-Z lower-cased."""
    return text.lower()


def tiles(a: list[int], b: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token sequences: (start in a, start in b, length), the longest first.

    Karp-Rabin: hashes of all unmarked runs of one length of b are looked up for those of a and matches extended as
    far as they go. If some match is at least twice as long as searched for, the search starts anew at its length;
    otherwise matches are marked, longest first, and the length shrinks. Of equal lengths the earlier in a, then b.
    """
    mark_a, mark_b, out = bytearray(len(a)), bytearray(len(b)), []
    length = max(least, min(len(a), len(b), 20))
    while True:
        found, longest = _matches(a, b, mark_a, mark_b, length)
        if longest > 2 * length:
            length = longest
            continue
        for size, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            while size >= length:  # what earlier tiles have left of it
                hit = next((k for k in range(size) if mark_a[i + k] or mark_b[j + k]), size)
                if hit >= length:
                    mark_a[i : i + hit] = mark_b[j : j + hit] = b"\1" * hit
                    out.append((i, j, hit))
                i, j, size = i + hit + 1, j + hit + 1, size - hit - 1
        if length > 2 * least:
            length //= 2
        elif length > least:
            length = least
        else:
            return out


def _matches(a, b, mark_a, mark_b, length):
    where = defaultdict(list)
    for h, j in _running(b, mark_b, length):
        where[h].append(j)
    found, longest = [], 0
    for h, i in _running(a, mark_a, length):
        for j in where.get(h, ()):
            if i and j and not mark_a[i - 1] and not mark_b[j - 1] and a[i - 1] == b[j - 1]:
                continue  # part of the match that began one word before
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not mark_a[i + k] and not mark_b[j + k]:
                k += 1
            if k >= length:
                found.append((k, i, j))
                longest = max(longest, k)
    return found, longest


def _running(s, mark, length):
    """(hash, start) of all runs of unmarked tokens of one length, each from the one before."""
    top, h, run = pow(BASE, length - 1, MODULUS), 0, 0
    for i, x in enumerate(s):
        if mark[i]:
            h = run = 0
            continue
        if run == length:
            h = (h - s[i - length] * top) % MODULUS
            run -= 1
        h = (h * BASE + x) % MODULUS
        run += 1
        if run == length:
            yield h, i - length + 1


class Benchmark:
    """Items of one block and their seeds: for each seed length, sorted hashes with the items and places they are at."""

    def __init__(self, items: list[tuple[int, str]], least: int = TILE, coverage: float = COVERAGE):
        self.least, self.coverage = least, coverage
        self.ids, texts = [], []
        for i, t in sorted(items, key=lambda x: (x[0], x[1])):
            raw = normal(t.encode())
            if raw.split():
                self.ids.append(i)
                texts.append(raw)
        hashes, offsets = word_hashes(texts)
        self.words = [hashes[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.seeds = []
        count = np.diff(offsets)
        for n in sorted({min(least, int(c)) for c in count}):
            at, item = within(offsets, n)
            use = np.minimum(count[item], least) == n  # items shorter than a tile are matched whole
            at, item = at[use], item[use]
            h = grams(hashes, n)[at]
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << 16, U64)
            slot = h >> U64(42)
            np.bitwise_or.at(bits, slot >> U64(6), U64(1) << (slot & U64(63)))
            self.seeds.append((n, h[order], item[order], (at - offsets[:-1][item])[order], bits))

    def leaks(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, tiles, words covered, words of the item) of all pairs that are covered enough."""
        hashes, offsets = word_hashes([normal(t) for t in texts])
        out = []
        for n, seed, item, place, bits in self.seeds:
            at, text = within(offsets, n)
            h = grams(hashes, n)[at]
            slot = h >> U64(42)
            maybe = np.flatnonzero(bits[slot >> U64(6)] >> (slot & U64(63)) & U64(1))
            lo, hi = np.searchsorted(seed, h[maybe]), np.searchsorted(seed, h[maybe], "right")
            pairs: dict[tuple[int, int], tuple[list[int], set[int]]] = {}
            for k in np.flatnonzero(hi > lo).tolist():
                p = int(maybe[k])
                for s in range(lo[k], hi[k]):
                    of = pairs.setdefault((int(text[p]), int(item[s])), ([], set()))
                    if not of[0] or of[0][-1] != at[p]:
                        of[0].append(int(at[p]))
                    of[1].update(range(place[s], place[s] + n))
            for (t, i), (starts, reach) in pairs.items():
                words = self.words[i]
                need = self.coverage * len(words)
                if len(reach) < need:  # tiles can't cover more than seeds do
                    continue
                got = tiles(self._near(hashes, starts, n), words.tolist(), n)
                covered = sum(x for _, _, x in got)
                if covered >= need:
                    out.append((t, i, len(got), covered, len(words)))
        return out

    @staticmethod
    def _near(hashes: np.ndarray, starts: list[int], n: int) -> list[int]:
        """The words under seeds, a token that matches nothing between runs that don't touch."""
        out, done = [], -1
        for s in starts:
            if s > done:
                out.append(-1 - s)
                done = s
            out += hashes[done : s + n].tolist()
            done = s + n
        return out


def blocks(benchmark: DataFrame, id_col: str, text_col: str, least: int, coverage: float) -> Iterator[Benchmark]:
    """The benchmark in blocks of bounded size."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null and id is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // BLOCK_BYTES)
    for k in range(parts):
        got = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k).collect()
        yield Benchmark([(r.id, r.text) for r in got], least, coverage)


def leaks(df: DataFrame, benchmark: DataFrame, least: int = TILE, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, item_id, tiles, covered, item_words, coverage): each text and item whose tiles cover enough of the item.

    Words are A-Z lower-cased. An item shorter than a tile has to occur whole. Items with null id or no words match
    nothing, as do null and empty texts. Rows that repeat an id each give their rows; so do items that repeat an
    item_id with other text. No shuffle; one pass over the texts for each 16 MB of benchmark.
    """
    out = None
    kind = with_id(df, id_col, "x int")["id"].dataType.simpleString()
    schema = f"id {kind}, {item_col} long, tiles int, covered int, item_words int"
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for block in blocks(benchmark, item_col, text_col, least, coverage):
        sent = df.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, "text"):
                got = sent.value.leaks(text_bytes(b.column("text")))
                if got:
                    t, i, *more = map(list, zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(t)), pa.array([sent.value.ids[x] for x in i], pa.int64()), *(pa.array(x, pa.int32()) for x in more)], ["id", item_col, "tiles", "covered", "item_words"])

        got = rows.transform(in_arrow, run, schema)
        out = got if out is None else out.union(got)
    if out is None:
        out = df.sparkSession.createDataFrame([], schema)
    return out.withColumn("coverage", F.col("covered") / F.col("item_words")).withColumnRenamed("id", id_col)


def clean(df: DataFrame, benchmark: DataFrame, least: int = TILE, coverage: float = COVERAGE, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of df, all columns as they are, that leak no item; what leaks() finds goes. Null texts stay."""
    for block in blocks(benchmark, item_col, text_col, least, coverage):
        sent = df.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, text_col):
                keep = np.ones(b.num_rows, bool)
                keep[[t for t, *_ in sent.value.leaks(text_bytes(b.column(text_col)))]] = False
                yield b.filter(pa.array(keep))

        df = df.transform(in_arrow, run, df.schema)
    return df
