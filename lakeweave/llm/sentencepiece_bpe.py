"""SentencePiece encoding and decoding of merge-type (BPE) models, exact, by backtracking.

Merging pieces in order of score from the characters up gives one sequence of pieces. That sequence is the only
one whose every two adjacent pieces, merged anew from their characters, give these same two pieces. So the text
is walked from the left: an Aho-Corasick automaton lists the pieces that start at each place, the longest is
tried first, a piece that doesn't stand with its left neighbour gives way to the next shorter one, and if none is
left the last piece taken back. A bitfield of positions from which the walk has failed keeps it from going there
again, which bounds it by text length times pieces per place.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, pieces, with_id

#: The library's mark of a space in pieces, and its piece types.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Chunks (a word with its marks) whose ids a worker remembers of each kind; beyond that the memory is emptied.
REMEMBERED = 250_000


class Merges:
    """A model of merge type. encode(text) and decode(ids) are those of the library, without begin and end ids."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces) or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only merge-type models with byte fallback, identity normalisation and a dummy prefix are done here")
        if any(MARK in p.piece.lstrip(MARK) for p in proto.pieces if p.type == NORMAL):
            raise ValueError("a piece goes on past a space mark")
        self.pieces = [p.piece for p in proto.pieces]
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i, p in enumerate(proto.pieces) if p.type in (CONTROL, UNKNOWN)}
        #: Only pieces that merging can arrive at take part.
        reachable = [p for p in self.ids if self.merged(p) == (p,)]
        self.automaton = ahocorasick.Automaton()
        for p in reachable:
            self.automaton.add_word(p, (len(p), self.ids[p]))
        self.automaton.make_automaton()
        self.single = {p for p in reachable if len(p) == 1}
        self.line_breaks = not any("\n" in p for p in self.ids)  # else a line break may lie inside a piece
        #: What adjacent-token checks have found: left id * pieces + right id -> they stand together.
        self.pairs: dict[int, bool] = {}
        #: Ids of chunks seen, those that begin with the mark (left out of the key) and others.
        self.known: dict[str, tuple[int, ...]] = {}
        self.bare: dict[str, tuple[int, ...]] = {}
        #: The text of each id but those of bytes beyond ASCII, and of <unk> and control ids.
        self.plain = [None if i in self.silent else chr(self.byte_of[i]) if self.byte_of.get(i, 255) < 128 else None if i in self.byte_of else p for i, p in enumerate(self.pieces)]

    def merged(self, text: str) -> tuple[str, ...]:
        """Merging from characters: the best-scored pair first, the leftmost of equals. For short texts."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(parts)

    def stands(self, a: int, b: int) -> bool:
        """Whether two pieces stay as they are when their text is merged anew."""
        if len(self.pairs) >= 1 << 19:
            self.pairs.clear()
        x, y = self.pieces[a], self.pieces[b]
        got = self.pairs[a * len(self.pieces) + b] = self.merged(x + y) == (x, y)
        return got

    def walk(self, text: str) -> list[int]:
        """The ids of a text all of whose characters are pieces."""
        n, starts = len(text), [[] for _ in text]
        for end, piece in self.automaton.iter(text):  # ends grow, so each place's pieces come shortest first
            starts[end - piece[0] + 1].append(piece)
        pairs, stands, many = self.pairs, self.stands, len(self.pieces)
        failed = 0  # bitfield of positions from which the walk can't reach the end
        out, back, at, last = [], [], 0, -1  # back: how many pieces are yet to try at each place taken, and the place
        k = len(starts[0])
        while at < n:
            choice = starts[at]
            while k:
                k -= 1
                size, piece = choice[k]
                if failed >> at + size & 1:
                    continue
                if last >= 0:
                    ok = pairs.get(last * many + piece)
                    if ok is None:
                        ok = stands(last, piece)
                    if not ok:
                        continue
                back.append((at, k))
                out.append(piece)
                last = piece
                at += size
                k = len(starts[at]) if at < n else 0
                break
            else:  # nothing fits here: the piece that led here gives way
                failed |= 1 << at
                at, k = back.pop()
                out.pop()
                last = out[-1] if out else -1
        return out

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        """The ids of a chunk, in which no space mark follows another character."""
        if self.single.issuperset(chunk):
            return tuple(self.walk(chunk))
        ids, at = [], 0
        while at < len(chunk):
            if chunk[at] not in self.single:
                ids += [self.bytes[b] for b in chunk[at].encode()]
                at += 1
                continue
            to = at + 1
            while to < len(chunk) and chunk[to] in self.single:
                to += 1
            ids += self.walk(chunk[at:to])
            at = to
        return tuple(ids)

    def _kept(self, memory: dict, key: str, chunk: str) -> tuple[int, ...]:
        got = self.chunk_ids(chunk)
        if len(key) <= 64:
            if len(memory) >= REMEMBERED:
                memory.clear()
            memory[key] = got
        return got

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out, known, bare = [], self.known, self.bare
        if MARK in text:
            text = text.replace(MARK, " ")
        blanks = 1  # spaces that stand before the next word; the dummy prefix is the first
        for word in text.split(" "):
            if word:
                if blanks > 1:
                    word = " " * (blanks - 1) + word
                got = known.get(word)
                if got is None:
                    if self.line_breaks and "\n" in word:
                        word, *lines = word.split("\n")
                        got = known.get(word) or self._kept(known, word, MARK + word.replace(" ", MARK))
                        for x in lines:
                            got = (*got, self.bytes[10], *((bare.get(x) or self._kept(bare, x, x)) if x else ()))
                    else:
                        got = self._kept(known, word, MARK + word.replace(" ", MARK))
                out += got
                blanks = 0
            blanks += 1
        if blanks > 1:
            out += self.chunk_ids(MARK * (blanks - 1))
        return out

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, marks turned into spaces, the dummy prefix dropped, bytes read as UTF-8."""
        try:
            text = "".join(map(self.plain.__getitem__, ids))
        except TypeError:
            out, raw = [], []
            for i in ids:
                if i in self.byte_of:
                    raw.append(self.byte_of[i])
                    continue
                if raw:
                    out.append(_read_bytes(raw))
                    raw = []
                out.append(" ⁇ " if i in self.silent and self.pieces[i] == "<unk>" else "" if i in self.silent else self.pieces[i])
            if raw:
                out.append(_read_bytes(raw))
            text = "".join(out)
        return (text[1:] if text.startswith(MARK) else text).replace(MARK, " ")


def _read_bytes(raw: list[int]) -> str:
    """UTF-8 bytes; each byte that is no part of a character becomes a replacement character."""
    out, data = [], bytes(raw)
    while data:
        try:
            return "".join(out) + data.decode()
        except UnicodeDecodeError as e:
            out.append(data[: e.start].decode() + "�")
            data = data[e.start + 1 :]
    return "".join(out)


@functools.lru_cache(2)
def load(path: str) -> Merges:
    with open(path, "rb") as f:
        return Merges(f.read())


@functools.lru_cache(2)
def _from_bytes(model: bytes) -> Merges:
    return Merges(model)


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every text: the ids the library gives, and what it makes of them again.

    Null text counts as empty: no ids, decoded "". Rows are independent, so repeated and tied rows each give their
    own row, a null id stays null, an empty table gives none, and other columns of any name are left behind. Very
    long texts are encoded whole. No shuffle; the model (under a megabyte) goes along with the tasks.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = with_id(df, id_col, "ids array<int>, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _from_bytes(sent.value)
        for b in pieces(batches, "text"):
            ids = [model.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(ids, pa.list_(pa.int32())), pa.array(map(model.decode, ids), pa.string())], ["id", "ids", "decoded"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).transform(in_arrow, run, schema).withColumnRenamed("id", id_col)
