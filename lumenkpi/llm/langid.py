"""Language identification of mixed-language text.

A word's script narrows its languages to those with at least ``SCRIPT_SHARE`` of their training words in it (so that a
foreign name in a text does not count; all languages, if none has); each candidate gets the word's score
under a character n-gram model; Viterbi over the words of a text, with a penalty for switching languages, labels spans.
A document's language is the one whose spans hold most letters, its score that share of the letters.

The model holds, per n-gram order, log probabilities of hashed character n-grams by language: ``orders * buckets *
languages`` numbers, whatever the size of the corpus.  It is trained on a bounded sample of labelled documents
(``max_docs`` per language, chosen by a hash of the text), counted on the executors.

Edge cases: a null text, an empty one or one without letters is ``und`` with score 0; without any training text every
document is ``und``; repeated rows give repeated results; ties go to the first language in order; rows with a null
``lang`` take no part in training; other columns are ignored, whatever their names; long texts are read whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkpi.llm.shared import ship, table

ORDERS, BITS = 4, 16
BUCKETS = 1 << BITS
MAX_DOCS = 3000
SCRIPT_SHARE = 0.01
SWITCH_PENALTY = 10.0
UNDETERMINED = "und"

#: First and last code point of each script's main ranges; a letter outside all of them has script 0.
SCRIPT_RANGES = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "telugu": ((0xC00, 0xC7F),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF), (0x2D00, 0x2D2F)),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
}
SCRIPTS = len(SCRIPT_RANGES) + 1

_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    """By code point: whether it is a letter, whether it belongs to a word, its lower case, its script."""
    if not _TABLES:
        n = 0x110000
        letter, word = np.zeros(n, bool), np.zeros(n, bool)
        lower, script = np.arange(n, dtype=np.uint32), np.zeros(n, np.uint8)
        for c in range(n):
            kind = unicodedata.category(chr(c))[0]
            if kind == "L":
                letter[c] = True
                x = chr(c).lower()
                if len(x) == 1:
                    lower[c] = ord(x)
            word[c] = kind in "LM"
        for k, ranges in enumerate(SCRIPT_RANGES.values(), 1):
            for a, b in ranges:
                script[a : b + 1] = k
        _TABLES.update(letter=letter, word=word, lower=lower, script=script)
    return _TABLES


@dataclass
class Words:
    """The words of several texts: per word its letters and script, per text the first word."""

    features: np.ndarray  # orders x places: hashed n-grams that end at a place
    starts: np.ndarray  # per word, its first place
    letters: np.ndarray
    script: np.ndarray
    first: np.ndarray


def split_words(texts: list[str]) -> Words:
    """Maximal runs of letters and marks, with the hashed n-grams of each, word borders included."""
    t = _tables()
    sizes = np.array([len(x) for x in texts], np.int64)
    # a border after every text keeps words of neighbours apart
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "replace"), np.uint32)
    inside = t["word"][codes]
    c0 = np.where(inside, t["lower"][codes], np.uint32(0)).astype(np.uint64)
    prev = np.zeros(len(c0), bool)
    prev[1:] = inside[:-1]
    place = np.flatnonzero(inside | prev)
    shifted = [c0]
    for k in range(1, ORDERS):
        s = np.zeros_like(c0)
        s[k:] = c0[:-k]
        if k > 1:
            s[shifted[-1] == 0] = 0
        shifted.append(s)
    features = np.empty((ORDERS, len(place)), np.int32)
    h = np.zeros(len(place), np.uint64)
    for k in range(ORDERS):
        h = (h ^ (shifted[k][place] + np.uint64(k + 1))) * np.uint64(0x9E3779B97F4A7C15)
        features[k] = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int32)
    begins = inside & ~prev
    at = np.flatnonzero(begins)
    starts = np.searchsorted(place, at)
    if len(at):
        letters = np.add.reduceat(t["letter"][codes[place]].astype(np.int64), starts)
        script = t["script"][codes[at]]
    else:
        letters, script = np.zeros(0, np.int64), np.zeros(0, np.uint8)
    ends = np.cumsum(sizes + 1)
    first = np.searchsorted(at, np.concatenate([[0], ends]))
    return Words(features, starts, letters, script, first)


def _blocks(texts: list[str], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    a = total = 0
    for i, x in enumerate(texts):
        if total and total + len(x) > size:
            yield a, i
            a, total = i, 0
        total += len(x)
    if a < len(texts):
        yield a, len(texts)


@dataclass
class Model:
    """languages; log probabilities by order, bucket and language; which languages a script's words may have."""

    languages: list[str]
    scores: np.ndarray
    candidates: np.ndarray

    def word_scores(self, w: Words) -> np.ndarray:
        """words x languages, the best of a word at 0; languages that the script rules out far below."""
        out = np.zeros((len(w.starts), len(self.languages)), np.float32)
        if len(w.starts):
            total = self.scores[0][w.features[0]]
            for k in range(1, ORDERS):
                total += self.scores[k][w.features[k]]
            np.add.reduceat(total, w.starts, axis=0, out=out)
            out[~self.candidates[w.script]] = -1e4
            out -= out.max(axis=1, keepdims=True)
        return out


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of every word: texts are run in step, the longest first, so a step is one array operation."""
    n_lang, sizes = scores.shape[1], np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = first[:-1][order], sizes[order]
    live = int((sizes > 0).sum())
    path = np.zeros(len(scores), np.int16)
    if not live:
        return path
    longest = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(longest), "left")  # texts with more than t words
    stay, best = np.ones(scores.shape, bool), np.zeros(len(scores), np.int16)
    v = scores[begin[:live]].copy()
    for t in range(1, longest):
        at = begin[: active[t]] + t
        v = v[: len(at)] if len(at) < len(v) else v
        lead = v.argmax(axis=1)
        moved = v[np.arange(len(at)), lead] - penalty
        keep = v >= moved[:, None]
        stay[at], best[at] = keep, lead
        now = np.where(keep, v, moved[:, None]) + scores[at]
        if t + 1 >= longest or active[t + 1] < len(at):
            done = active[t + 1] if t + 1 < longest else 0
            path[at[done:]] = now[done:].argmax(axis=1)
        v = now
    ones = np.flatnonzero(sizes == 1)
    path[begin[ones]] = scores[begin[ones]].argmax(axis=1)
    for t in range(longest - 1, 0, -1):
        at = begin[: active[t]] + t
        now = path[at]
        path[at - 1] = np.where(stay[at, now], now, best[at])
    return path


def _train_counts(docs: DataFrame, languages: list[str]) -> DataFrame:
    """(kind, language, bucket, n): hashed n-gram counts by order, and words by script under kind ``ORDERS``."""
    index = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((ORDERS, len(languages), BUCKETS), np.int64)
        scripts = np.zeros((len(languages), SCRIPTS), np.int64)
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(x)
            for lang, texts in by.items():
                for a, b in _blocks(texts):
                    w = split_words(texts[a:b])
                    for k in range(ORDERS):
                        counts[k, index[lang]] += np.bincount(w.features[k], minlength=BUCKETS)
                    scripts[index[lang]] += np.bincount(w.script, minlength=SCRIPTS)
        for k in range(ORDERS + 1):
            lang, bucket = np.nonzero(counts[k] if k < ORDERS else scripts)
            n = (counts[k] if k < ORDERS else scripts)[lang, bucket]
            if len(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k, np.int32)), pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(n)], ["kind", "language", "bucket", "n"])

    found = docs.select("lang", "text").mapInArrow(run, "kind int, language int, bucket int, n long")
    return found.groupBy("kind", "language", "bucket").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, max_docs: int = MAX_DOCS, smoothing: float = 0.5, script_share: float = SCRIPT_SHARE) -> Model:
    """Fit on labelled rows (``lang``, ``text``), about ``max_docs`` of each language at most.

    A language is a candidate for a script if at least ``script_share`` of its training words are in it.
    """
    ship(labelled.sparkSession)
    labelled = labelled.select("lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((ORDERS, BUCKETS, 0), np.float32), np.zeros((SCRIPTS, 0), bool))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, max_docs / sizes[lang]))])
    chosen = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    counts = np.zeros((ORDERS, len(languages), BUCKETS))
    scripts = np.zeros((len(languages), SCRIPTS))
    rows = _train_counts(chosen, languages).toPandas()  # bounded: orders x buckets x languages
    for k in range(ORDERS):
        part = rows[rows.kind == k]
        counts[k, part.language, part.bucket] = part.n
    part = rows[rows.kind == ORDERS]
    scripts[part.language, part.bucket] = part.n
    logs = np.log((counts + smoothing) / (counts.sum(axis=2, keepdims=True) + smoothing * BUCKETS))
    candidates = (scripts >= script_share * np.maximum(scripts.sum(axis=1, keepdims=True), 1)).T & (scripts.T > 0)
    candidates[~candidates.any(axis=1)] = True
    return Model(languages, np.ascontiguousarray(logs.transpose(0, 2, 1) / ORDERS).astype(np.float32), candidates)


def label_texts(texts: list[str], model: Model, penalty: float = SWITCH_PENALTY) -> list[tuple[str, float, int]]:
    """(language, score, spans) of each text."""
    out: list[tuple[str, float, int]] = []
    if not model.languages:
        return [(UNDETERMINED, 0.0, 0)] * len(texts)
    for a, b in _blocks(texts):
        w = split_words(texts[a:b])
        path = viterbi(model.word_scores(w), w.first, penalty)
        text_of = np.repeat(np.arange(b - a), np.diff(w.first))
        letters = np.zeros((b - a, len(model.languages)), np.int64)
        np.add.at(letters, (text_of, path), w.letters)
        new = np.ones(len(path), bool)
        if len(path):
            new[1:] = (path[1:] != path[:-1]) | (text_of[1:] != text_of[:-1])
        spans = np.bincount(text_of[new], minlength=b - a)
        total, lead = letters.sum(axis=1), letters.argmax(axis=1)
        for i in range(b - a):
            out.append((model.languages[lead[i]], float(letters[i, lead[i]] / total[i]), int(spans[i])) if total[i] else (UNDETERMINED, 0.0, 0))
    return out


def spans(text: str, model: Model, penalty: float = SWITCH_PENALTY) -> list[tuple[int, int, str]]:
    """(start, end, language) of the labelled spans of one text, in code points, from word to word."""
    if not model.languages:
        return []
    w = split_words([text])
    path = viterbi(model.word_scores(w), w.first, penalty)
    inside = _tables()["word"][np.frombuffer((text + "\0").encode("utf-32-le", "replace"), np.uint32)]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    out: list[tuple[int, int, str]] = []
    for a, b, k in zip(begin.tolist(), end.tolist(), path.tolist(), strict=True):
        if out and out[-1][2] == model.languages[k]:
            out[-1] = (out[-1][0], b, out[-1][2])
        else:
            out.append((a, b, model.languages[k]))
    return out


def identify(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """doc_id, lang_pred, score, n_spans of every document (``doc_id``, ``text``)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # orders x buckets x languages floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                got = label_texts([x or "" for x in part.column(1).to_pylist()], shared.value, penalty)
                lang, score, n = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int64())], ["doc_id", "lang_pred", "score", "n_spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, n_spans long")


def held_out(doc_id: F.Column | str = "doc_id") -> F.Column:
    """Whether a document is in the test fold: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; the model has seen no document of the test fold."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_langid": op2_langid}
ORACLES: dict[str, str] = {}
