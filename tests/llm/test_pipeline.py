from tokenizers import Tokenizer

import corpus_pipeline as C
from lumenkpi.llm import packing as P
from lumenkpi.llm import quality as Q
from lumenkpi.llm.shared import cut
from tests.llm.test_native import plain_dedup, plain_spans
from tests.llm.test_near import brute_components

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    good = cut(C.STAGES[0][1](spark, docs, SF))
    assert good.columns == names
    drawn = {r.doc_id: r for r in Q.resample(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    k = sum(r.kept for r in drawn.values())
    assert 0 < k < docs.count() and {r.doc_id for r in good.collect()} == {i for i, r in drawn.items() if r.key >= sorted((x.key for x in drawn.values()), reverse=True)[k - 1]}
    lines = cut(C.STAGES[1][1](spark, good, SF))
    before = {r.doc_id: r.text for r in good.collect()}
    expected = {i: t for i, t in plain_dedup(list(before.items())) if t == before[i] or t.strip()}
    assert lines.columns == names and {r.doc_id: r.text for r in lines.collect()} == expected
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    one = cut(C.STAGES[2][1](spark, lines, SF))
    groups = brute_components(list(expected.items()))
    assert one.columns == names and {r.doc_id for r in one.collect()} == {i for i, (_, c) in groups.items() if c == i}
    safe = cut(C.STAGES[3][1](spark, one, SF))
    assert safe.columns == names and safe.count() == one.count()
    assert all(plain_spans(r.text) == "" for r in safe.collect())
    packed = C.STAGES[4][1](spark, safe, SF).collect()
    tokenizer = Tokenizer.from_file(P.vocabulary_path())
    lengths, sequences = {}, {}
    for r in packed:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert lengths == {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in safe.collect()}
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= P.CAPACITY
    assert len(sequences) <= 1.02 * sum(lengths.values()) / P.CAPACITY + 1


def test_stages_take_odd_rows(spark, docs_of):
    """Nulls, empty, very long and repeated texts, equal ids and columns whose names clash."""
    long = "\n".join(f"line {i} of a very long text with words of its own {i * i}" for i in range(20_000))
    rows = {1: None, 2: "", 3: "a b c", 4: "token = abcdefgh\nx\ny", 5: long, 6: long + " end", 7: "a b c"}
    docs = docs_of([*rows.values(), "a b c", None, long], [*rows, None, None, 5])
    names, stages = docs.columns, []
    for _, stage in C.STAGES:
        docs = cut(stage(spark, docs, SF))
        stages.append(docs.collect())
    quality, lines, near, safe, packed = stages
    kept = {r.doc_id for r in quality}
    assert all([*r.asDict()] == names for x in stages[:4] for r in x) and kept <= {*rows, None} and len(kept) > 1
    assert {r.text for r in quality} <= {*rows.values()} and all(r.text == rows[r.doc_id] for r in quality if r.doc_id)
    assert {r.doc_id for r in near} <= {r.doc_id for r in lines} <= kept
    texts = [t for _, t in {(r.doc_id, r.text) for r in near if r.doc_id is not None and r.text and r.text.strip()}]  # repeated rows are one document
    assert len(texts) == len(set(texts)) and len([r for r in near if r.doc_id in (3, 7)]) <= 1
    assert len(safe) == len(near) and not any("abcdefgh" in (r.text or "") for r in safe)
    assert sorted({(r.doc_id or -1) for r in packed}) == sorted({(r.doc_id or -1) for r in safe})
    empty = docs_of([])
    for _, stage in C.STAGES:
        empty = cut(stage(spark, empty, SF))
    assert empty.count() == 0
