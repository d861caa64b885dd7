"""Best-fit packing of tokenised documents into fixed-length sequences by minimum bin slack.

Token lengths are cut into pieces of at most ``capacity``, so the whole packing problem is a histogram of at most
``capacity`` lengths, whatever the number of documents.  The driver solves that histogram: the longest open length
seeds a bin, a bitset subset-sum over the open lengths finds the fullest feasible completion, and that combination is
removed as often as the counts allow (repeating the search would find it again).  Executors then look up the place of
each piece by its length and its rank among the pieces of that length.

Edge cases: a null text packs as an empty one (one separator token); repeated rows and repeated or null ``doc_id`` are
packed each on its own; an empty table gives an empty result; other columns are ignored, whatever their names; a very
long text becomes as many pieces as it needs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenkpi.llm.shared import cut, table

CAPACITY = 2048
SPECIAL = "<|endoftext|>"

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"
_RESULT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer file of that name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


class CachedEncoder:
    """Byte-level BPE ids of whole texts as little-endian 32-bit bytes.

    The pre-tokeniser never joins what stands before a space with a non-space after it, so a text is encoded as the
    chunks between such places, and chunks that were met before come from a bounded cache.  Where the same vocabulary
    lies beside the tokenizer as a file of ranks, chunks of basic Latin are encoded from that, which gives the same ids
    in a third of the time; anything else goes through the tokenizer itself.
    """

    LIMIT = 300_000
    LATIN = "\u0250"  # first character after Latin, Latin-1 and the Latin extensions A and B

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.ranked = self._ranked(path)
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.odd = re.compile(r" (?:\s|\Z)")
        self.gap = re.compile(r"(?= \S)")

    def _ranked(self, path: str):
        """A second encoder of the same vocabulary, or None."""
        import base64
        import os

        at = os.path.splitext(path)[0] + ".tiktoken"
        if not os.path.exists(at):
            return None
        import public_tokenizers
        import tiktoken

        with open(at, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _fill(self, cache: dict[str, bytes], missing: list[str], prefix: str) -> None:
        if self.ranked is not None:
            encode, latin, rest = self.ranked.encode_ordinary, self.LATIN, []
            for x in missing:
                if x and max(x) < latin:
                    cache[x] = np.array(encode(prefix + x), "<u4").tobytes()
                else:
                    rest.append(x)
            missing = rest
        for a in range(0, len(missing), 20_000):
            part = missing[a : a + 20_000]
            done = self.model.encode_batch_fast([prefix + x for x in part], add_special_tokens=False)
            for x, e in zip(part, done, strict=True):
                cache[x] = np.array(e.ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.first) + len(self.later) > self.LIMIT:
            self.first.clear()
            self.later.clear()
        split: list[list[str] | None] = []
        heads: dict[str, None] = {}
        tails: dict[str, None] = {}
        for x in texts:
            if SPECIAL in x:
                split.append(None)
            elif self.odd.search(x):
                parts = self.gap.split(x)
                if parts and not parts[0]:
                    parts = parts[1:]
                # keys of "first" are whole chunks; a chunk that begins with a space is kept there too
                split.append(["", *parts])
                heads |= dict.fromkeys(p for p in parts if p not in self.first)
            else:
                parts = x.split(" ")
                split.append(parts)
                if parts[0] not in self.first:
                    heads[parts[0]] = None
                later = self.later
                tails |= dict.fromkeys(p for p in parts[1:] if p not in later)
        self._fill(self.first, list(heads), "")
        self._fill(self.later, list(tails), " ")
        out = []
        first, later = self.first, self.later
        for x, parts in zip(texts, split, strict=True):
            if parts is None:
                out.append(np.array(self.model.encode(x, add_special_tokens=False).ids, "<u4").tobytes())
            elif parts[0] == "" and len(parts) > 1 and self.odd.search(x):
                out.append(b"".join([first[p] for p in parts[1:]]))
            else:
                out.append(first[parts[0]] + b"".join([later[p] for p in parts[1:]]))
        return out


_ENCODERS: dict[str, CachedEncoder] = {}


def encoder_of(path: str) -> CachedEncoder:
    """The encoder of a tokenizer file, made once in each Python process, so that tasks share it and what it has cached."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]


def pieces_of(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of one document's ids: all full but the first, which may be shorter."""
    n = len(ids) // 4
    at = 0
    end = n if n <= capacity else (n % capacity or capacity)
    k = 0
    while at < n:
        yield k, at, end - at, zlib.crc32(ids[4 * at : 4 * end])
        k, at, end = k + 1, end, end + capacity


def tokenize_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """One row per piece with its task and its place among that task's pieces of the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder_of(path), Counter()
        task, tail = TaskContext.get().partitionId(), np.array([separator], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a in range(0, len(ids), 256):
                texts = ["" if x is None else x for x in batch.column(1).slice(a, 256).to_pylist()]
                rows = []
                for key, codes in zip(ids[a : a + 256], encode(texts), strict=True):
                    for k, start, length, crc in pieces_of(codes + tail, capacity):
                        rows.append((key, k, start, length, crc, task, seen[length]))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECES)


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """The (length, uses) that fill ``room`` best: a bitset subset-sum over ``lengths`` (descending, each at most
    ``counts`` times), read back from the states after each length."""
    states, sums, full = [], 1, 1 << room
    mask = (full << 1) - 1
    for x in lengths:
        if x > room:
            continue
        uses = min(counts[x], room // x)
        if uses <= 0:
            continue
        states.append((x, sums, uses))
        step = 1
        while uses > 0:  # bounded multiples by doubling
            step = min(step, uses)
            sums |= (sums << (step * x)) & mask
            uses -= step
            step *= 2
        if sums & full:
            break
    got, out = sums.bit_length() - 1, []
    for x, before, uses in reversed(states):
        k = 0
        while not before >> got & 1:
            got -= x
            k += 1
        assert k <= uses
        if k:
            out.append((x, k))
    assert got == 0
    return out


def minimum_bin_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Packs a histogram of lengths: (combination as (length, uses), number of bins filled so), in order."""
    counts = {x: n for x, n in histogram.items() if n > 0}
    lengths = sorted(counts, reverse=True)
    plan = []
    while lengths:
        seed = lengths[0]
        counts[seed] -= 1
        chosen = Counter(dict(fullest(counts, lengths, capacity - seed))) if capacity > seed else Counter()
        counts[seed] += 1
        chosen[seed] += 1
        times = min(counts[x] // k for x, k in chosen.items())
        for x, k in chosen.items():
            counts[x] -= k * times
        lengths = [x for x in lengths if counts[x]]
        plan.append((sorted(chosen.items(), reverse=True), times))
    return plan


def places(plan: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """Per length an array with a row for each combination that holds it: first rank, first bin, uses, offset."""
    rank: Counter = Counter()
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    bins = 0
    for chosen, times in plan:
        offset = 0
        for x, k in chosen:
            found.setdefault(x, []).append((rank[x], bins, k, offset))
            rank[x] += k * times
            offset += x * k
        bins += times
    return {x: np.array(rows, np.int64) for x, rows in found.items()}


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """Packs all documents (``doc_id``, ``text``); returns a row per piece with its sequence and the offset in it."""
    pieces = cut(tokenize_pieces(docs, path or vocabulary_path(), capacity, separator), "pieces")
    per_task = cut(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity
    where = places(minimum_bin_slack(histogram, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = per_task.select(F.col("task").alias("t"), F.col("length").alias("l"), F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(base, (F.col("task") == F.col("t")) & (F.col("length") == F.col("l")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            bins, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                rows = where[x][np.searchsorted(where[x][:, 0], rank[at], "right") - 1]
                k = rank[at] - rows[:, 0]
                bins[at] = rows[:, 1] + k // rows[:, 2]
                offset[at] = rows[:, 3] + k % rows[:, 2] * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, _RESULT)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in the packed sequences."""
    return pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_packing": op6_packing}
ORACLES: dict[str, str] = {}
