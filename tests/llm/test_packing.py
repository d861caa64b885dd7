import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenkpi.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.vocabulary_path())


def test_cached_encoder_gives_the_tokenizer_s_ids(tokenizer):
    rnd = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "The", "é", "'s", "<|endoftext|>", "1", "%%", "漢", "\x1c", ".", "\xa0", "\x85", "½", "ª", "ǅ"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    got = P.CachedEncoder(P.vocabulary_path())(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_are_full_but_the_first():
    ids = np.arange(10, dtype="<u4").tobytes()
    assert [(k, s, n) for k, s, n, _ in P.pieces_of(ids, 4)] == [(0, 0, 2), (1, 2, 4), (2, 6, 4)]
    assert [(k, s, n) for k, s, n, _ in P.pieces_of(ids[:32], 4)] == [(0, 0, 4), (1, 4, 4)]
    assert next(P.pieces_of(ids[:8], 4))[3] == zlib.crc32(ids[:8])


def test_fullest_combination_against_brute_force():
    rnd = random.Random(1)
    for _ in range(200):
        lengths = sorted(rnd.sample(range(1, 25), rnd.randint(1, 6)), reverse=True)
        counts = {x: rnd.randint(1, 3) for x in lengths}
        room = rnd.randint(0, 50)
        got = sum(x * k for x, k in P.fullest(counts, lengths, room))
        best = max(s for ks in itertools.product(*[range(counts[x] + 1) for x in lengths]) if (s := sum(x * k for x, k in zip(lengths, ks, strict=True))) <= room)
        assert got == best


def test_plan_is_the_same_as_removing_one_bin_at_a_time():
    histogram = {7: 5, 5: 9, 3: 8, 2: 1}
    plan = P.minimum_bin_slack(histogram, 12)
    counts, bins = dict(histogram), []
    while any(counts.values()):
        lengths = sorted((x for x in counts if counts[x]), reverse=True)
        counts[lengths[0]] -= 1
        chosen = dict(P.fullest(counts, lengths, 12 - lengths[0]))
        chosen[lengths[0]] = chosen.get(lengths[0], 0) + 1
        counts[lengths[0]] += 1
        for x, k in chosen.items():
            counts[x] -= k
        bins.append(sorted(chosen.items(), reverse=True))
    assert [c for c, n in plan for _ in range(n)] == bins


def check(rows, documents, tokenizer):
    got = rows.orderBy("sequence_id", "offset").collect()
    for _, part in itertools.groupby(got, key=lambda r: r.sequence_id):
        at = 0
        for r in part:
            assert r.offset == at
            at += r.length
        assert at <= P.CAPACITY
    expected = []
    for i, t in documents:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        expected += [(i, *p) for p in P.pieces_of(ids, P.CAPACITY)]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(expected, key=key)
    return len({r.sequence_id for r in got}), sum(r.length for r in got)


def test_edge_cases(docs_of, tokenizer):
    texts = [None, "", "a", "a", "word " * 5000, "  x  ", "same", "same"]
    ids = [0, 1, 2, 3, 4, None, 7, 7]
    check(P.pack(docs_of(texts, ids)), list(zip(ids, texts, strict=True)), tokenizer)


def test_empty_table(docs_of):
    assert P.pack(docs_of([])).count() == 0


def test_whole_table_needs_no_more_sequences_than_its_tokens(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bins, total = check(P.op6_packing(spark, sf), [(r.doc_id, r.text) for r in docs.collect()], tokenizer)
    assert bins <= -(-total // P.CAPACITY) + 1
    assert docs.select(F.max("doc_id")).first()[0] >= 0
