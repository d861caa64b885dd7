"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled into machines over characters:

* the normaliser has an arc for each character that it rewrites (spaces to boundary marks) and states that squeeze runs of spaces
  and write the first mark;
* the piece machine is a tree of states with an arc for each character of a piece; from the state where a piece ends an arc
  without input writes its id and goes back to the root;
* a byte-fallback arc from the root reads a character that is no piece by itself and writes its UTF-8 bytes.

Arcs have weights of the tropical semiring (they add up along a path, the least path counts).  In a unigram model writing a
piece weighs minus its log probability.  A merge-based (BPE) model has no such weights: writing ``b`` after ``a`` weighs 0 if
merging the text ``ab`` ends in exactly these two pieces, else infinity, so the machine remembers the piece that it wrote
last.  A sequence of pieces is the one that merging gives if and only if all its neighbours are such pairs, so the only
path of finite weight is the merge result.

The piece machine is composed with the text as it is read and made deterministic at the same time: a composed state holds
every place in the tree that some best path may be at, with the weight by which it lags behind the best, and its arcs are
made the first time a character needs them and kept.  The shortest path is then one arc for each character and a walk back from
the end over the pieces that the states say end there; both kinds of model go the same way.

No piece has a word-boundary mark after another character (checked when compiling), so a text is composed word by word
and results of words that were met before come from a bounded cache.

Edge cases: null and empty texts have no ids; literal boundary marks in a text encode as spaces, as the model defines
(and so do not survive a round trip); repeated rows give repeated results; other columns are ignored, whatever their
names; very long texts are encoded whole.
"""

from __future__ import annotations

import math
import re
import struct
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkpi.llm.shared import ship, table

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            x = data[i]
            out |= (x & 127) << shift
            i, shift = i + 1, shift + 7
            if x < 128:
                return out, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            n = {1: 8, 5: 4}.get(kind)
            if n is None:
                n, i = varint(i)
            value, i = data[i : i + n], i + n
        yield key >> 3, value


class Transducer:
    """The compiled machine of one model file."""

    LIMIT, PAIRS, STATES = 300_000, 1_000_000, 400_000  # words, pairs and composed states that are kept

    def __init__(self, model: bytes):
        pieces: list[tuple[str, float, int]] = []
        self.kind, self.dummy, self.squeeze, self.escape = UNIGRAM, True, True, True
        for field, value in _fields(model):
            if field == 1:
                got = dict(_fields(value))
                pieces.append((got[1].decode(), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, NORMAL)))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                got = dict(_fields(value))
                if got.get(2):
                    raise ValueError("a normaliser with a character map is not supported")
                self.dummy, self.squeeze, self.escape = bool(got.get(3, 1)), bool(got.get(4, 1)), bool(got.get(5, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and merge-based models are supported")
        if any(t == USER for _, _, t in pieces):
            raise ValueError("user-defined pieces are not supported")
        self.size = len(pieces)
        self.text = [p for p, _, _ in pieces]
        self.score = [s for _, s, _ in pieces]
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.unknown = next(i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN)
        self.output = [p.replace(MARK, " ").encode() if t == NORMAL else bytes([int(p[1:-1], 16)]) if t == BYTE else b" \xe2\x81\x87 " if t == UNKNOWN else b"" for p, _, t in pieces]
        self.longest = max((len(p) for p in self.ids), default=1)
        self.whole = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.reads = str.maketrans({" ": MARK} if self.escape else {})
        self.words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        if self.kind == BPE:
            order = {s: k for k, s in enumerate(sorted({self.score[i] for i in self.ids.values()}, reverse=True))}
            self.rank = [order.get(s, 0) for s in self.score]
            seen: dict[int, int] = {}
            for i in self.ids.values():
                seen[self.rank[i]] = seen.get(self.rank[i], 0) + 1
            self.tied = [seen.get(r, 0) > 1 for r in self.rank]
            self.halves: list[tuple[int, int] | None] = [None] * self.size
            self.alone = [False] * self.size
            for p, i in self.ids.items():
                made = self.merge(p, i)
                self.alone[i] = made == [p]
        # the piece machine: by state its arcs and the piece that ends there
        self.tree: list[dict[str, int]] = [{}]
        self.final = [-1]
        for p, i in self.ids.items():
            node = 0
            for c in p:
                after = self.tree[node].get(c)
                if after is None:
                    after = self.tree[node][c] = len(self.tree)
                    self.tree.append({})
                    self.final.append(-1)
                node = after
            self.final[node] = i
        self.fallback = 1.0 if self.kind == BPE else 10.0 - min((self.score[i] for i in self.ids.values()), default=0.0)
        self._reset()

    def _reset(self) -> None:
        """Forget all composed states but the first, which is at the root and has written nothing."""
        self.places: list[tuple] = [((0, -2, 0.0, 0),)]
        self.last: list[tuple[int, int]] = [(-1, 0)]
        self.arcs: list[dict[str, int]] = [{}]
        self.known: dict[tuple, int] = {}

    def merge(self, text: str, target: int = -1) -> list[str]:
        """Merging by definition: the neighbours whose union scores best, the leftmost of equals, until none is left.

        With ``target``, the halves that were merged last into that piece are noted.
        """
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if at < 0:
                break
            if len(parts) == 2 and target >= 0 and parts[0] in self.ids and parts[1] in self.ids:
                self.halves[target] = (self.ids[parts[0]], self.ids[parts[1]])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, a: int, b: int) -> bool:
        """Whether merging the text of a then b ends in these two pieces."""
        if self.tied[a] or self.tied[b]:
            return self.merge(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]
        # Undo the merges of both pieces, the latest first; before each, a union across the border must not have been due.
        ids, text, rank, halves = self.ids, self.text, self.rank, self.halves
        bound = math.inf
        while True:
            across = ids.get(text[a] + text[b])
            if across is not None and rank[across] < bound:
                return False
            at, bt = halves[a], halves[b]
            if at is None and bt is None:
                return True
            if bt is None or (at is not None and rank[a] > rank[b]):
                bound, a = rank[a], at[1]
            else:  # of equal unions the left one comes first, so one across the border would precede that inside b
                bound, b = rank[b] + 0.5, bt[0]

    def allowed(self, state: int, piece: int) -> bool:
        """Whether the arc for ``piece`` out of ``state`` has finite weight (state -2: the start, -1: a fallback)."""
        if state < 0:
            return self.alone[piece]
        key = state * self.size + piece
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > self.PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.alone[piece] and self._follows(state, piece)
        return found

    def weight(self, before: int, piece: int) -> float:
        """Of writing ``piece`` after ``before``."""
        return -self.score[piece] if self.kind == UNIGRAM else 0.0 if self.allowed(before, piece) else math.inf

    def _arc(self, state: int, c: str) -> int:
        """The composed state after reading ``c``: made, unless another arc leads to the same.

        A place is (characters read since the root, piece written before, weight behind the best, state of the tree); the first
        one is at the root.
        """
        places, best, piece, length = [], math.inf, -1, 1
        for read, before, behind, node in self.places[state]:
            node = self.tree[node].get(c)
            if node is None:
                continue
            ends = self.final[node]
            if ends >= 0:
                total = behind + self.weight(before, ends)
                if total < best:
                    best, piece, length = total, ends, read + 1
            if self.tree[node]:
                places.append((read + 1, before, behind, node))
        if c not in self.ids and self.fallback < best:
            best, piece, length = self.fallback, -1, 1
        key = ((0, piece, 0.0, 0), *[(read, before, behind - best, node) for read, before, behind, node in places]), (piece, length)
        after = self.known.get(key)
        if after is None:
            after = self.known[key] = len(self.arcs)
            self.places.append(key[0])
            self.last.append(key[1])
            self.arcs.append({})
        self.arcs[state][c] = after
        return after

    def shortest_path(self, text: str) -> list[int]:
        """The ids on the best path of the machine composed with a normalised text."""
        arcs, last, state, path = self.arcs, self.last, 0, []
        for c in text:
            after = arcs[state].get(c)
            state = self._arc(state, c) if after is None else after
            path.append(state)
        out: list[int] = []
        end = len(text)
        while end > 0:
            piece, length = last[path[end - 1]]
            if piece >= 0:
                out.append(piece)
            else:
                raw = text[end - 1].encode()
                out.extend(reversed([self.bytes[x] for x in raw] if self.bytes else [self.unknown]))
            end -= length
        out.reverse()
        if len(arcs) > self.STATES:
            self._reset()
        return out

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return ((" " if self.dummy else "") + text).translate(self.reads)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit bytes."""
        if not text:
            return b""
        if self.whole:
            return np.array(self.shortest_path(self.normalise(text)), "<i4").tobytes()
        if len(self.cache) > self.LIMIT:  # words that are met again come back from the older half
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        if self.dummy and self.escape and not self.squeeze and text[0] != " " and "  " not in text and MARK not in text:
            words = [MARK + w for w in text.split(" ")]
        else:
            words = self.words.findall(self.normalise(text))
        out = []
        for w in words:
            got = cache.get(w)
            if got is None:
                got = older.get(w)
                if got is None:
                    got = array("i", self.shortest_path(w)).tobytes()
                cache[w] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.output.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if self.dummy and out[:1] == " " else out


_COMPILED: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    """The machine of a model file, compiled once in each Python process."""
    if path not in _COMPILED:
        with open(path, "rb") as f:
            _COMPILED[path] = Transducer(f.read())
    return _COMPILED[path]


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public model file of that name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids of every text, and whether decoding them gives the text back."""
    ship(docs.sparkSession)
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [x or "" for x in part.column(1).to_pylist()]
                codes = [np.frombuffer(machine.encode(x), "<i4") for x in texts]
                same = [machine.decode(c.tolist()) == x for c, x in zip(codes, texts, strict=True)]
                sizes = np.array([len(c) for c in codes], np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(codes) if codes else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), lists, pa.array(same)], ["doc_id", "n_ids", "ids", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_ids long, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of every row of ids."""
    ship(encoded.sparkSession)
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(path)
        for batch in batches:
            texts = [machine.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document and whether they decode to its text."""
    return encode_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_sentencepiece": op8_sentencepiece}
ORACLES: dict[str, str] = {}
