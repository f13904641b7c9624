"""SimHash near-duplicates: 64-bit fingerprints, linked by a self-join of binary tries.

A fingerprint pair within k differing bits agrees on at least r of k + r blocks of bits. Each distinct fingerprint goes
once to the value of each choice of r blocks, with these turned to the front; below each such root stands a binary trie
of the rest. r grows with the number of fingerprints, so that a root's trie stays small. Pairs of trie nodes are traversed together, level by level: each pair carries the differing bits so far,
and is pruned as soon as they exceed the budget, or as soon as all leaves below both are known to be connected.
Tries are sorted arrays: a node is a range and a depth.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, drop_table, in_arrow, pieces, text_bytes, with_id, written
from .hashing import grams, mix, word_hashes

U64 = np.uint64
BITS, SHINGLE, SEED, BUDGET = 64, 4, 42, 4
#: Node pairs that a traversal expands at a time; the rest wait on a stack.
FRONTIER = 1 << 16
#: Rows of whole units that a task joins at a time; a larger unit is joined alone.
PORTION = 1 << 16
#: Fingerprints that a root may have on average before roots are cut finer.
UNIT = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the XXH64 values of the text's shingles, repeats included."""
    from xxhash import xxh64_intdigest as xxh

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh(b" ".join(words), SEED)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size)
    start, end = (end - size)[: len(words) - shingle + 1].tolist(), (end - 1)[shingle - 1 :].tolist()
    votes, n = np.zeros(BITS, np.int64), len(start)
    for at in range(0, n, 1 << 16):
        h = np.fromiter((xxh(joined[s:e], SEED) for s, e in zip(start[at : at + (1 << 16)], end[at : at + (1 << 16)], strict=True)), U64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * votes > n, bitorder="little").view(U64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fingerprint long) of every whole text, the 64 bits read as a signed number.

    A-Z lower-cased, words without white space, a shorter text is one shingle; null, empty and blank texts get
    fingerprint 0. One row for each row, null ids included; no shuffle.
    """
    schema = with_id(df, id_col, "fingerprint long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            got = np.array([fingerprint(t, shingle) for t in text_bytes(b.column("text"))], U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(got)], ["id", "fingerprint"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).transform(in_arrow, run, schema).withColumnRenamed("id", id_col)


#: One turning of the 64 bits: (right shift that brings a block down, its width, its shift after the turning) of each.
Turning = tuple[tuple[int, int, int], ...]


def turnings(budget: int, front: int = 1) -> tuple[list[Turning], list[int]]:
    """For each choice of `front` out of budget + front nearly equal blocks the turning that puts these first, and how
    many bits they have: values within the budget agree on all blocks of at least one choice."""
    edges = [round(i * BITS / (budget + front)) for i in range(budget + front + 1)]
    blocks = range(budget + front)
    out, bits = [], []
    for chosen in itertools.combinations(blocks, front):
        moved, to = [], BITS
        for i in (*chosen, *(i for i in blocks if i not in chosen)):
            width = edges[i + 1] - edges[i]
            to -= width
            moved.append((BITS - edges[i + 1], width, to))
        out.append(tuple(moved))
        bits.append(sum(edges[i + 1] - edges[i] for i in chosen))
    return out, bits


def blocks_in_front(count: int, budget: int) -> int:
    """How many blocks a root takes so that it has UNIT fingerprints or fewer on average; at most three."""
    return next((r for r in (1, 2) if count >> min(turnings(budget, r)[1]) <= UNIT), 3)


def turned(values: np.ndarray, turning: Turning) -> np.ndarray:
    out = np.zeros(len(values), U64)
    for down, width, up in turning:
        out |= (values >> U64(down) & U64((1 << width) - 1)) << U64(up)
    return out


def turned_back(values: np.ndarray, turning: Turning) -> np.ndarray:
    return turned(values, tuple((up, width, down) for down, width, up in turning))


class Forest:
    """Union-find over positions, by repeated minimum."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links positions; keeps those links that connect what wasn't connected before, so fewer than n in all."""
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = np.flatnonzero(ra != rb)
            if not len(apart):
                return
            a, b, hi, lo = a[apart], b[apart], np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart]
            hooked, first = np.unique(hi, return_index=True)  # each root hangs below one smaller root
            self.edges.append((a[first], b[first]))
            self.root[hooked] = lo[first]
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def trie_join(values: np.ndarray, root_bits: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) within each root that connect all pairs of values within the budget.

    The tries are traversed with budgets 1, 2, ... in turn, so that the links are those of least distance.

    values: distinct within a root, sorted by (root, value); root_bits: for each, a number of its root. The roots'
    leading bits are equal below each root, so the descent starts at the first bit in which a range differs.
    """
    forest = Forest(len(values))
    for most in range(1, budget + 1):
        _traverse(forest, values, root_bits, most)
    if not forest.edges:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*forest.edges, strict=True))


def _traverse(forest: Forest, values: np.ndarray, root_bits: np.ndarray, budget: int) -> None:
    if len(values) < 2:
        return
    cut = np.flatnonzero(np.diff(root_bits)) + 1
    lo = np.concatenate(([0], cut)).astype(np.int64)
    hi = np.concatenate((cut, [len(values)])).astype(np.int64)
    big = hi - lo > 1
    # a pair: node a [alo, ahi), node b, depth of bits done, differing bits so far; a pair of a node with itself has alo == blo
    stack = [(lo[big], hi[big], lo[big], hi[big], np.zeros(big.sum(), np.int64), np.zeros(big.sum(), np.int64))]
    mask_of = np.array([((1 << d) - 1) << (BITS - d) for d in range(BITS + 1)], U64)  # the first d bits

    def halves(lo, hi, depth):
        """Where the range's values with the next bit set begin."""
        bit = U64(1) << (BITS - 1 - depth).astype(U64)
        a, b = lo.copy(), hi.copy()
        while True:
            open_ = a < b
            if not open_.any():
                return a
            mid = (a + b) >> 1
            one = (values[np.minimum(mid, len(values) - 1)] & bit) != 0
            b = np.where(open_ & one, mid, b)
            a = np.where(open_ & ~one, mid + 1, a)

    while stack:
        alo, ahi, blo, bhi, depth, dist = stack.pop()
        if len(alo) > FRONTIER:
            stack.append(tuple(x[FRONTIER:] for x in (alo, ahi, blo, bhi, depth, dist)))
            alo, ahi, blo, bhi, depth, dist = (x[:FRONTIER] for x in (alo, ahi, blo, bhi, depth, dist))
        # leaves on both sides: the whole distance is known
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        if leaf.any():
            a, b = alo[leaf], blo[leaf]
            near = (np.bitwise_count(values[a] ^ values[b]) <= budget) & (a != b)
            forest.join(a[near], b[near])
        keep = ~leaf
        # all below both nodes connected already: nothing left to find
        if keep.any():
            change = np.concatenate(([0], np.cumsum(forest.root[1:] != forest.root[:-1])))
            one = (change[ahi - 1] == change[alo]) & (change[bhi - 1] == change[blo]) & (forest.root[alo] == forest.root[blo])
            keep &= ~one
        alo, ahi, blo, bhi, depth, dist = (x[keep] for x in (alo, ahi, blo, bhi, depth, dist))
        if not len(alo):
            continue
        # skip the bits in which both nodes hold one value each throughout, adding those in which the two differ
        spread = (values[alo] ^ values[ahi - 1]) | (values[blo] ^ values[bhi - 1])
        clear = spread.copy()
        for s in (1, 2, 4, 8, 16, 32):
            clear |= clear >> U64(s)
        common = BITS - np.bitwise_count(clear).astype(np.int64)  # leading bits in which each node is of one value
        to = np.maximum(common, depth)
        dist = np.bitwise_count((values[alo] ^ values[blo]) & mask_of[to]).astype(np.int64)
        ok = (dist <= budget) & (to < BITS)
        alo, ahi, blo, bhi, depth, dist = (x[ok] for x in (alo, ahi, blo, bhi, to, dist))
        if not len(alo):
            continue
        am, bm = halves(alo, ahi, depth), halves(blo, bhi, depth)
        same, d1 = alo == blo, depth + 1
        out = []
        for side_a, side_b, more in ((0, 0, 0), (1, 1, 0), (0, 1, 1), (1, 0, 1)):
            xlo, xhi = (alo, am) if side_a == 0 else (am, ahi)
            ylo, yhi = (blo, bm) if side_b == 0 else (bm, bhi)
            ok = (xlo < xhi) & (ylo < yhi) & (dist + more <= budget)
            if (side_a, side_b) == (1, 0):
                ok &= ~same  # of a node with itself, one order of its two halves is enough
            if more == 0:
                ok &= ~(same & (xhi - xlo == 1))
            out.append((xlo[ok], xhi[ok], ylo[ok], yhi[ok], d1[ok], dist[ok] + more))
        far = tuple(np.concatenate(x) for x in zip(*out[2:], strict=True))
        near = tuple(np.concatenate(x) for x in zip(*out[:2], strict=True))
        if len(far[0]) + len(near[0]) <= FRONTIER:
            far, near = tuple(np.concatenate(x) for x in zip(near, far, strict=True)), ([],)
        for x in (far, near):  # the nearer half on top: early links prune later pairs
            if len(x[0]):
                stack.append(x)


def links(distinct: DataFrame, budget: int = BUDGET, col: str = "fingerprint", front: int | None = None) -> DataFrame:
    """(a, b) long links between distinct fingerprints that connect all pairs within the budget.

    Each fingerprint goes once to each choice of blocks; a task's rows come sorted by root. A root's trie is one unit.
    Returned are the links of a spanning forest of each unit, never all its pairs. A null fingerprint links to nothing.
    front: blocks that a root takes; by the number of fingerprints if not given.
    """
    front = front or blocks_in_front(distinct.count(), budget)
    ways, bits = turnings(budget, front)

    def piece(down: int, width: int, up: int):
        return F.shiftleft(F.shiftrightunsigned("v", down).bitwiseAND((1 << width) - 1 if width < BITS else -1), up)

    def way(i: int):
        new = functools.reduce(lambda x, y: x.bitwiseOR(y), [piece(*x) for x in ways[i]])
        return F.struct(F.lit(i).alias("block"), new.alias("turned"))

    units = distinct.select(F.col(col).alias("v")).where("v is not null").select(F.explode(F.array(*[way(i) for i in range(len(ways))])).alias("x")).select("x.*")
    width = F.element_at(F.array(*[F.lit(BITS - n) for n in bits]), F.col("block") + 1)
    units = units.withColumn("key", F.call_function("shiftrightunsigned", F.col("turned"), width))
    units = units.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block", "key").sortWithinPartitions("block", "key", "turned")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def new_unit(block, value, key):
            return (block[1:] != block[:-1]) | (key[1:] != key[:-1])

        def done(block, value, key):
            v = value.view(U64)
            root = np.concatenate(([0], np.cumsum(new_unit(block, value, key))))
            order = np.lexsort((v, root))  # signed order within a root differs from that of unsigned bits
            v, root, block = v[order], root[order], block[order]
            a, b = trie_join(v, root, budget)
            ends = np.zeros((2, len(a)), U64)
            for i in np.unique(block[a]).tolist():
                here = block[a] == i
                ends[0, here], ends[1, here] = turned_back(v[a[here]], ways[i]), turned_back(v[b[here]], ways[i])
            return pa.RecordBatch.from_arrays([pa.array(ends[0].view(np.int64)), pa.array(ends[1].view(np.int64))], ["a", "b"])

        held, most = [[np.zeros(0, np.int64)] * 3], PORTION
        for b in batches:
            held.append([np.asarray(b.column(x)).astype(np.int64) for x in ("block", "turned", "key")])
            if sum(len(x[0]) for x in held) < most:
                continue
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            change = np.flatnonzero(new_unit(*cols))
            cut = change[-1] + 1 if len(change) else 0  # the last unit may go on in the next batch
            if cut:
                yield done(*(c[:cut] for c in cols))
            held = [[c[cut:] for c in cols]]
            most = max(PORTION, 2 * len(held[0][0]))
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        if len(cols[0]):
            yield done(*cols)

    return units.transform(in_arrow, run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """(id, fingerprint long, component long) for each row: component is the smallest id that links lead to.

    Equal fingerprints link at distance 0, so copies never meet as pairs: tries hold distinct fingerprints, and
    components go to rows by fingerprint. Null and blank texts have fingerprint 0 and link like any other. A row
    with a null id gets the component of its group, null only if the group has no id. Repeated ids each keep their
    row. Empty tables give none.
    """
    prints = written(fingerprints(df, id_col, text_col).withColumnRenamed(id_col, "id"), "simhash")
    classes = written(prints.groupBy("fingerprint").agg(F.min("id").alias("least")), "simhash-classes")
    comps = connected_components(links(classes, budget), "simhash-links")
    named = classes.join(comps, F.col("fingerprint") == F.col("node"), "left").withColumn("root", F.coalesce("component", "fingerprint"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select("fingerprint", "root").join(least, "root").select(F.col("fingerprint").alias("f"), "component_id")
    return prints.join(named, F.col("fingerprint") == F.col("f")).select(F.col("id").alias(id_col), "fingerprint", F.col("component_id").alias("component"))


# ------------------------------------------------------------------ groups of a given similarity

#: Bins of the MinHash sketch by which candidate pairs are compared first; 4 bits each, so 512 bytes a text.
SKETCH = 1024
#: Bands of bins of which a candidate pair shares one, and bins of a band. A pair of similarity J shares none with a
#: chance of (1 - J ** DEPTH) ** BANDS, whatever the edits: 5 in a million at 0.8.
BANDS, DEPTH = 40, 6
#: What a sketch's estimate may be off by, five standard errors: nearer to the asked similarity, the sets are compared.
UNSURE = 0.065
#: Bits of the small sketch that goes along with every band key, one a bin, from the bins that bands don't use; a pair
#: goes on to the whole sketch unless the estimate is five standard errors (0.019 of the bits, twice that of the
#: similarity) below the one asked for. Texts with fewer words than SHORT always go on: theirs is too coarse.
SMALL, SMALL_UNSURE, SHORT = 256, 0.19, 100
#: Ids that are sent to all tasks at most: 8 bytes each, 64 MB in a task's hash table.
BROADCAST = 4_000_000
#: Texts that a task sketches, rows and bytes of whole units that it holds, and pairs that it compares at a time.
SKETCHED, UNITS, UNIT_BYTES, COMPARED = 1024, 1 << 14, 16 << 20, 4096

_ALIKE = np.array([(x >> 4 == 0) + (x & 15 == 0) for x in range(256)], np.uint8)  # of two packed bins, by their xor


def band_keys(values: np.ndarray) -> np.ndarray:
    """(texts x BANDS) keys from the whole bin values; bands have keys of their own."""
    out = np.repeat(np.arange(1, BANDS + 1, dtype=U64)[None, :], len(values), axis=0)
    for k in range(DEPTH):
        out = mix(out ^ values[:, k : BANDS * DEPTH : DEPTH])
    return out


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    return np.unique(grams(word_hashes([text])[0], shingle))


def compare(key: np.ndarray, ids: np.ndarray, group: np.ndarray, judge) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions a and b of a forest of links, and positions of rows that have a pair in doubt. Rows come sorted by key.

    All pairs of a key are judged, but for those that known groups or links found before connect already.
    judge(a, b): which pairs of positions are alike, and which are in doubt.
    """
    node, at = np.unique(ids, return_inverse=True)
    forest, order = Forest(len(node)), np.argsort(group, kind="stable")
    same = np.flatnonzero(group[order][1:] == group[order][:-1])
    forest.join(at[order[same]], at[order[same + 1]])
    forest.edges.clear()
    place = np.zeros(len(node), np.int64)
    place[at] = np.arange(len(ids))
    cut = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
    unit = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(key))))
    end = np.append(cut[1:], len(key))[unit]
    rows, d, doubt = np.arange(len(key)), 1, np.zeros(len(key), bool)
    while True:
        if d & (d - 1) == 0:  # now and then, units leave that are connected throughout
            root = forest.root[at]
            rows = rows[(np.minimum.reduceat(root, cut) != np.maximum.reduceat(root, cut))[unit[rows]]]
        rows = rows[rows + d < end[rows]]
        if not len(rows):
            break
        apart = rows[forest.root[at[rows]] != forest.root[at[rows + d]]]
        for i in range(0, len(apart), COMPARED):
            a = apart[i : i + COMPARED]
            yes, near = judge(a, a + d)
            forest.join(at[a[yes]], at[a[yes] + d])
            doubt[a[near]] = doubt[a[near] + d] = True
        d += 1
    a, b = (np.concatenate(x) for x in zip(*forest.edges, (np.zeros(0, np.int64),) * 2, strict=True))
    return place[a], place[b], np.flatnonzero(doubt)


def small_sketch(values: np.ndarray) -> np.ndarray:
    """(texts x 4) the low bits of SMALL bins that no band uses."""
    low = (values[:, BANDS * DEPTH : BANDS * DEPTH + SMALL] & U64(1)).astype(np.uint8)
    return np.packbits(low, axis=1).view(np.int64)


def hopeful(key: np.ndarray, group: np.ndarray, small: np.ndarray, short: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows have a row of the same key and of another group that may be alike by the small sketch. Rows come
    sorted by key. Pairs of rows that are both known to have one needn't be looked at."""
    most = int((1 - similarity + SMALL_UNSURE) / 2 * SMALL)
    cut = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
    unit = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(key))))
    end = np.append(cut[1:], len(key))[unit]
    rows, d, out, small = np.arange(len(key)), 1, np.zeros(len(key), bool), small.view(U64)
    while True:
        if d & (d - 1) == 0:  # now and then, units leave of which all rows are known
            rows = rows[~np.logical_and.reduceat(out, cut)[unit[rows]]]
        rows = rows[rows + d < end[rows]]
        if not len(rows):
            return out
        apart = rows[(group[rows] != group[rows + d]) & ~(out[rows] & out[rows + d])]
        for i in range(0, len(apart), 1 << 16):
            a = apart[i : i + (1 << 16)]
            yes = a[(np.bitwise_count(small[a] ^ small[a + d]).sum(axis=1) <= most) | short[a] | short[a + d]]
            out[yes] = out[yes + d] = True
        d += 1


def by_sketch(sketch: np.ndarray, similarity: float):
    def judge(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        equal = _ALIKE[sketch[a] ^ sketch[b]].sum(axis=1, dtype=np.int64) / SKETCH
        got = (equal - 1 / 16) / (1 - 1 / 16)
        return got >= similarity + UNSURE, np.abs(got - similarity) < UNSURE

    return judge


def by_set(sets: list[np.ndarray], similarity: float):
    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= similarity * (len(x) + len(y) - both) - 1e-9

    def judge(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.array([alike(sets[x], sets[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool), np.zeros(len(a), bool)

    return judge


def each_once(units: DataFrame) -> DataFrame:
    """(key, id, group) rows without units, that is, keys, of the very same ids as another: alike texts share many keys,
    and one is enough to compare them in. Sets of ids are told apart by their number and two checksums."""
    rows = units.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit("again"))).alias("y"))
    kept = rows.groupBy("n", "x", "y").agg(F.min("key").alias("kept"))
    return units.join(kept.select("kept"), F.col("key") == F.col("kept"), "left_semi")


def similar_groups(df: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, known: DataFrame | None = None) -> DataFrame:
    """(id, component) of rows that a chain of pairs of at least that Jaccard similarity of word shingles links to a smaller id.

    Candidates are texts that share one of BANDS band keys of their MinHash sketches, which depends on the similarity
    alone, not on where texts differ. All pairs of a key are compared, except those connected already: by a small
    sketch that comes with the key, which rules out most; then by the whole sketch; then, where the estimate is within
    UNSURE of the similarity, by the whole sets of shingle hashes.
    known: (id, component) of rows that are linked already, as near_duplicates() gives them; chains lead through both
    kinds of links, and rows that only these link are returned too. Texts of fewer words than a shingle have no pairs
    of their own. Rows without id are left out; rows that repeat an id count as one. Empty tables give no rows.
    """
    from .minhash import bin_values

    minis = ["s1", "s2", "s3", "s4", "short"]
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")

    def long_enough(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
        for b in pieces(batches, "text"):
            for k in range(0, b.num_rows, SKETCHED):
                part = b.slice(k, SKETCHED)
                texts = text_bytes(part.column("text"))
                keep = [len(t.split(None, shingle)) >= shingle for t in texts]  # as bytes, white space is that of words
                if any(keep):
                    yield part.filter(pa.array(keep)), [t for t, x in zip(texts, keep, strict=True) if x]

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in long_enough(batches):
            values, _ = bin_values(texts, SKETCH, shingle)
            low = (values & U64(15)).astype(np.uint8)
            sketch = pa.array([x.tobytes() for x in low[:, 0::2] << 4 | low[:, 1::2]], pa.binary())
            keys = pa.array(list(band_keys(values).view(np.int64)), pa.list_(pa.int64()))
            small, short = small_sketch(values), [len(t.split(None, SHORT)) < SHORT for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(values.sum(axis=1, dtype=U64).view(np.int64)), keys, sketch, *(pa.array(small[:, i].copy()) for i in range(4)), pa.array(short)], ["id", "digest", "keys", "sketch", *minis])

    def in_units(done):
        """done() of whole units, some at a time."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, most = None, UNITS
            for b in batches:
                t = pa.Table.from_batches([b])
                held = t if held is None else pa.concat_tables([held, t])
                if len(held) < most and held.nbytes < UNIT_BYTES:
                    continue
                change = np.flatnonzero(np.diff(held["key"].to_numpy()))
                cut = int(change[-1]) + 1 if len(change) else 0  # the last unit may go on in the next batch
                if cut:
                    yield done(held.slice(0, cut))
                    held = held.slice(cut)
                most = max(UNITS, 2 * len(held))
            if held is not None and len(held):
                yield done(held)

        return run

    def still_hopeful(t: pa.Table) -> pa.RecordBatch:
        key, ids, group, short = (t[c].to_numpy() for c in ("key", "id", "group", "short"))
        keep = hopeful(key, group, np.stack([t[c].to_numpy() for c in minis[:4]], axis=1), short.astype(bool), similarity)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, ids, group)], ["key", "id", "group"])

    def linked(column: str, judge):
        """Rows (a, b) of links between groups; then rows (key, id, group) in doubt."""

        def done(t: pa.Table) -> pa.RecordBatch:
            key, ids, group = (t[c].to_numpy() for c in ("key", "id", "group"))
            a, b, doubt = compare(key, ids, group, judge(t[column].to_pylist()))
            n, m = [None] * len(a), [None] * len(doubt)
            cols = [(group[a].tolist() + m), (group[b].tolist() + m), (n + key[doubt].tolist()), (n + ids[doubt].tolist()), (n + group[doubt].tolist())]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["a", "b", "key", "id", "group"])

        return in_units(done)

    def sketched(column: list[bytes]):
        return by_sketch(np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1), similarity)

    def listed(column: list[bytes]):
        return by_set([np.frombuffer(x, U64) for x in column], similarity)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in long_enough(batches):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([shingle_set(t, shingle).tobytes() for t in texts], pa.large_binary()).cast(pa.binary())], ["id", "shingles"])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = written(rows.transform(in_arrow, prints, "id long, digest long, keys array<long>, sketch binary, s1 long, s2 long, s3 long, s4 long, short boolean"), "similar-sketches")
    if known is None:
        groups = rows.select("id", F.array("id").alias("groups")).distinct()
    else:
        groups = known.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.sort_array(F.collect_set(F.col("component").cast("long"))).alias("groups"))
    groups = written(groups.select("id", F.col("groups")[0].alias("group"), "groups"), "similar-known")
    named = every.join(groups.select(F.col("id").alias("of"), "group"), F.col("id") == F.col("of")).select("id", "digest", "keys", "group", *minis)
    # of equal texts that are connected already, one is enough
    each = named.groupBy("digest", "group").agg(F.min("id").alias("id"), F.first("keys").alias("keys"), *[F.first(x).alias(x) for x in minis])
    units = Window.partitionBy("key")
    met = each.select("id", "group", F.explode("keys").alias("key"), *minis).withColumns({"lo": F.min("group").over(units), "hi": F.max("group").over(units)}).where("lo <> hi")
    met = met.select("key", "id", "group", *minis).sortWithinPartitions("key", "id")  # dealt by key already
    pairs = written(met.transform(in_arrow, in_units(still_hopeful), "key long, id long, group long"), "similar-met")
    met = each_once(pairs).join(every.select(F.col("id").alias("of"), "sketch"), F.col("id") == F.col("of")).drop("of")
    kind = "a long, b long, key long, id long, group long"
    links = written(met.repartition(parts, "key").sortWithinPartitions("key", "id").transform(in_arrow, linked("sketch", sketched), kind), "similar-links")
    unsure = written(each_once(links.where("key is not null").select("key", "id", "group")), "similar-doubt")
    asked = written(unsure.select(F.col("id").alias("of")).distinct(), "similar-asked")
    asked = F.broadcast(asked) if asked.count() <= BROADCAST else asked.hint("merge")  # texts aren't shuffled for a few
    shingles = rows.join(asked, F.col("id") == F.col("of"), "left_semi").transform(in_arrow, sets, "id long, shingles binary")
    doubt = unsure.join(shingles.withColumnRenamed("id", "of"), F.col("id") == F.col("of")).drop("of").repartition(parts, "key").sortWithinPartitions("key", "id")
    exact = doubt.transform(in_arrow, linked("shingles", listed), kind).select("a", "b")
    repeated = groups.where(F.size("groups") > 1).select("group", F.explode("groups"))
    edges = links.where("key is null").select("a", "b").union(exact).union(repeated).toDF("a", "b")
    found = connected_components(edges, "similar-groups").withColumnRenamed("component", "least")
    for t in (every, pairs, links, unsure):  # what found needs is written
        drop_table(t)
    return groups.join(found, F.col("group") == F.col("node"), "left").select(F.col("id").alias(id_col), F.coalesce("least", "group").alias("component")).where(F.col(id_col) != F.col("component"))
