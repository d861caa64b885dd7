"""Removal of passages that repeat across documents, by paragraph MinHash banding and components.

The paragraphs of a text, all of at least ``min_words`` words, are

* its lines,
* runs of consecutive lines of fewer than ``SHORT_LINE`` words with no blank line between them (text may be wrapped),
* windows of ``SPAN`` words, for passages that stand anywhere in longer lines or go over several.  A window begins where
  a 5-word shingle has the least hash of some ``PASSAGE - SPAN + 1`` in a row.  Whether one begins at a place depends on the words near it alone, so
  a passage has the same windows in every text, and any passage of ``PASSAGE`` words holds at least one whole window.

Every paragraph has a MinHash sketch of ``T_SKETCH`` coordinates in bands of ``ROWS``.  Lines and runs use all bands: a
pair of similarity 0.75 shares one with probability 0.9987.  Windows use the first ``WINDOW_BANDS`` (0.81 for a window; a
passage has several).  Windows are compared with windows, lines and runs with each other.
Paragraphs that collide are joined, the exact Jaccard similarity of their 5-word shingles decides,
and linked ones form a component: see ``neardup`` for how that is done without ever expanding a bucket into its pairs.
Equal shingle sets are one class, which collides in every band and is linked by definition.

The first paragraph of a component (by document, then place) stays, the others are removed.  Paragraphs that overlap (a
line and a window in it) are no copies of each other: they are not linked, and one that overlaps the first of its
component all the same is left alone.

Edge cases: null and empty texts have no paragraphs; shorter paragraphs than ``min_words`` are left alone, and one of
fewer than five words has its words as its only shingle; rows with a null ``doc_id`` are left out of the search and keep
their text; repeated rows are one document; ties cannot arise, as a paragraph is named by document, hash of its text and
place; other columns are ignored, whatever their names; an empty table gives an empty result; very long texts are cut
into paragraphs whole.  Sets are told apart by 128 hashed bits, shingles by 64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkpi.llm import neardup
from lumenkpi.llm import textkernel as K
from lumenkpi.llm.shared import cut, drop, fold, screen, ship, table, unfold

WIDTH = neardup.WIDTH
#: The least passage that the registered query looks for, in words.  The operator takes any.
MIN_WORDS = 20
PASSAGE, SPAN = 50, 20
SHORT_LINE = 32  # words; shorter lines may be pieces of a wrapped paragraph
T_SKETCH, ROWS, WINDOW_BANDS = 16, 2, 2
NEWLINE = 10
UNIT = "doc_id long, h long, start int, stop int, n int, s1 long, bands array<long>"


class _Block:
    """The paragraphs of the texts of one block, with places in code points."""

    def __init__(self, part: np.ndarray, offsets: np.ndarray):
        low = K.LOWER[part]
        self.rows = len(offsets) - 1
        ws, we, first = K.words(low, offsets)
        self.hashes, self.first = K.run_hashes(low, ws, we), first
        self.shingles = K.shingles(self.hashes, WIDTH)
        self.row_of_word = np.repeat(np.arange(self.rows), np.diff(first))
        points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        base = points[offsets[:-1]]
        self.begin = points[ws] - base[self.row_of_word]
        self.end = points[we] - base[self.row_of_word]
        # a line's first word follows a newline or begins a text
        line = np.zeros(len(ws), bool)
        line[first[:-1][np.diff(first) > 0]] = True
        breaks = np.flatnonzero(part == NEWLINE)
        after = np.searchsorted(ws, breaks)
        line[after[after < len(ws)]] = True
        self.lines = np.flatnonzero(line)
        self.line_ends = np.append(self.lines[1:], len(ws)) if len(self.lines) else self.lines
        newlines = np.searchsorted(breaks, ws[self.lines[1:]]) - np.searchsorted(breaks, we[self.line_ends[:-1] - 1])
        row, short = self.row_of_word[self.lines], self.line_ends - self.lines < SHORT_LINE
        self.wrapped = (newlines == 1) & (row[1:] == row[:-1]) & short[1:] & short[:-1]  # a line and the one after it

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and end of each run of two or more short lines without a blank line between them."""
        bound = np.diff(np.concatenate([[0], self.wrapped.astype(np.int8), [0]]))
        return self.lines[np.flatnonzero(bound > 0)], self.line_ends[np.flatnonzero(bound < 0)]

    def windows(self) -> np.ndarray:
        """First word of each window of SPAN words."""
        ends = self.first[1:]
        starts = K.least_of_windows(self.shingles, self.first[:-1], np.maximum(self.first[:-1], ends - WIDTH + 1), PASSAGE - SPAN + 1)
        return starts[starts + SPAN <= ends[self.row_of_word[starts]]] if len(starts) else starts

    def sets_of_ranges(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shingle sets of word ranges, one after the other, and their sizes."""
        found = []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            found.append(np.unique(self.shingles[a : b - WIDTH + 1]) if b - a >= WIDTH else K.shingle_sets(self.hashes[a:b], np.array([0, b - a]))[0])
        return np.concatenate(found) if found else np.zeros(0, np.uint64), np.array([len(x) for x in found], np.int64)

    def sets_of_windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for windows from these words on."""
        rows = np.sort(self.shingles[starts[:, None] + np.arange(SPAN - WIDTH + 1)], axis=1)
        new = np.ones(rows.shape, bool)
        np.not_equal(rows[:, 1:], rows[:, :-1], out=new[:, 1:])
        return rows[new], new.sum(axis=1)


def units(docs: DataFrame, min_words: int = WIDTH) -> DataFrame:
    """The paragraphs of at least ``min_words`` words: document, place, number of shingles, identity and bands."""
    ship(docs.sparkSession)

    def rows_of(block: _Block, batch: pa.RecordBatch, a: int, sketcher: K.FastSketch) -> Iterator[pa.RecordBatch]:
        kinds = [(*pair, None) for pair in ((block.lines, block.line_ends), block.runs())]
        if min_words <= SPAN:
            begin = block.windows()
            kinds.append((begin, begin + SPAN, WINDOW_BANDS))
        for s, e, few in kinds:
            keep = e - s >= min_words
            s, e = s[keep], e[keep]
            if not len(s):
                continue
            items, sizes = block.sets_of_ranges(s, e) if few is None else block.sets_of_windows(s)
            bands = K.band_hashes(sketcher.flat(items, sizes), ROWS)[:, :few]
            if few is not None:  # windows collide with windows only, not with the lines they are cut from
                bands = K.mix(bands.view(np.uint64) + np.uint64(1)).view(np.int64)
            offsets = np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32)
            at = pa.array(a + block.row_of_word[s])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(block.begin[s].astype(np.int32)), pa.array(block.end[e - 1].astype(np.int32)), pa.array(sizes.astype(np.int32)), pa.array(K.set_identities(items, sizes)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(bands).reshape(-1)))],
                ["doc_id", "h", "start", "stop", "n", "s1", "bands"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = K.FastSketch(T_SKETCH)
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(2))
            for a, b in K.blocks(offsets):
                yield from rows_of(_Block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), batch, a, sketcher)

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return rows.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text").mapInArrow(run, UNIT)


KEY = ["doc_id", "h", "start", "stop"]


def _colliding(found: DataFrame) -> DataFrame:
    """The units that share a band with another one; hashes and numbers of units are shuffled, not the units' places.

    Bands are counted before they are shuffled, and those of a hot bucket are split by the join.
    """
    banded = found.select("uid", F.explode("bands").alias("bucket"))
    often = cut(banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select(F.col("bucket").alias("_b")), "often")
    some = cut(banded.join(often, F.col("bucket") == F.col("_b"), "left_semi").select(F.col("uid").alias("_u")).distinct(), "colliding")
    drop(often)
    # equal sets have equal first bands too, so both numbers tell classes apart
    return cut(found.join(some, F.col("uid") == F.col("_u"), "left_semi").select(*KEY, F.col("n").cast("long").alias("n"), "s1", F.col("bands")[0].alias("s2"), "bands"), "units")


def _overlaps(a: str) -> Column:
    """Whether the paragraph in the columns KEY of struct ``a`` (or of the row) overlaps ``rep``, the first of its component."""
    return (F.col(f"{a}doc_id") == F.col("rep.doc_id")) & (F.col(f"{a}h") == F.col("rep.h")) & (F.col(f"{a}start") < F.col("rep.stop"))


def _apart(a: Column, b: Column) -> Column:
    """Whether two paragraphs do not overlap."""
    return ~((a["doc_id"] == b["doc_id"]) & (a["h"] == b["h"]) & (a["start"] < b["stop"]) & (b["start"] < a["stop"]))


def _texts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(nid, text) of the paragraphs (nid, rep); the places of one text are cut out of it together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for a in range(0, len(wanted), 4096):
                    part = wanted[a : a + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([x["nid"] for x in part], pa.int64()), pa.array([text[x["start"] : x["stop"]] for x in part], pa.string())], ["nid", "text"])

    wanted = found.groupBy(F.col("rep.doc_id").alias("_id"), F.col("rep.h").alias("_h")).agg(F.collect_list(F.struct("nid", F.col("rep.start").alias("start"), F.col("rep.stop").alias("stop"))).alias("wanted"))  # within one text
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    places = found.select(F.col("rep.doc_id").alias("_id"), F.col("rep.h").alias("_h"))
    return screen(source, ["doc_id", "h"], places, ["_id", "_h"]).join(wanted, (F.col("doc_id") == F.col("_id")) & (F.col("h") == F.col("_h"))).select("text", "wanted").mapInArrow(run, "nid long, text string")


def repeated_paragraphs(docs: DataFrame, min_words: int = WIDTH) -> DataFrame:
    """Every paragraph with a copy: KEY, kind, the place of the one that stays, and ``removed``.

    ``kind`` is ``equal`` where the shingle sets are those of the one that stays, else ``near``.
    """
    named = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"))
    if not named.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # repeated rows are one document
        docs = docs.select("doc_id", "text").dropDuplicates()
    found = cut(units(docs, min_words).withColumn("uid", F.monotonically_increasing_id()), "paragraphs")
    signatures = _colliding(found)
    drop(found)
    classes = neardup.classes_of(signatures, KEY)
    _, merged = neardup.linked_classes(classes, lambda wanted: _texts(docs, wanted), apart=_apart)
    named = classes.join(merged.withColumnRenamed("node", "_node"), F.col("nid") == F.col("_node"), "left").select("s1", "s2", "nid", "rep", F.coalesce("component", "nid").alias("component"))
    first = named.groupBy("component").agg(F.min(F.struct("rep", "nid")).alias("_first")).select(F.col("component").alias("_c"), "_first")
    named = named.join(first, F.col("component") == F.col("_c")).select(F.col("s1").alias("_1"), F.col("s2").alias("_2"), F.col("_first.rep").alias("rep"), (F.col("nid") == F.col("_first.nid")).alias("_equal"))
    rows = cut(signatures.join(cut(named, "named"), (F.col("s1") == F.col("_1")) & (F.col("s2") == F.col("_2"))).select(*KEY, "rep", "_equal"), "copies")
    drop(signatures)
    rows = rows.where(~_overlaps("") | (F.struct(*KEY) == F.col("rep")))
    copied = cut(rows.where(F.struct(*KEY) != F.col("rep")).select(F.col("rep").alias("_rep")).distinct(), "copied", classes.count())  # a table, so that the join can split a hot one
    rows = rows.join(copied, F.col("rep") == F.col("_rep"), "left_semi")
    kind = F.when(F.col("_equal"), "equal").otherwise("near")
    return rows.select(*KEY, kind.alias("kind"), F.col("rep.doc_id").alias("rep_doc_id"), F.col("rep.start").alias("rep_start"), (F.struct(*KEY) != F.col("rep")).alias("removed"))


def strip_paragraphs(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the removed paragraphs cut out of ``text``; all other columns as they are."""
    spans = found.where("removed").groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("_spans"))  # within one text
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "_spans")
    on = (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_h"))
    kept = """aggregate(_spans, struct(0 AS at, '' AS kept),
        (s, x) -> struct(greatest(s.at, x.stop) AS at, s.kept || substring(text, s.at + 1, greatest(0, x.start - s.at)) AS kept),
        s -> s.kept || substring(text, s.at + 1))"""
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.expr(kept))
    rows = fold(docs).join(spans, on, "left")
    return rows.select(*unfold(rows, docs.columns, text))


def op9_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph of every document that repeats, with the one that stays."""
    return repeated_paragraphs(table(spark, sf_dir, "documents"), MIN_WORDS).drop("h")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_paragraphs": op9_paragraphs}
ORACLES: dict[str, str] = {}
