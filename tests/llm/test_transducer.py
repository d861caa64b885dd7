import random

import numpy as np
import pytest

from lumenkpi.llm import transducer as T


@pytest.fixture(scope="module")
def machine():
    return T.compiled(T.model_path())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=T.model_path())


def ids(machine, text):
    return np.frombuffer(machine.encode(text), "<i4").tolist()


def test_random_texts_against_the_library(machine, library):
    rnd = random.Random(5)
    parts = [" ", "  ", "     ", "\n", "the", "a", "é", "x", "ing", "漢", "😀", "aa", "aaa", "ss", "\t", "tion", "1", "12", "==", "-", "--", "ßü", "th", "er", "re", "▁", "e", "s", "t", "n"]
    for _ in range(8000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert ids(machine, text) == library.encode(text), text
        if "▁" not in text:
            assert machine.decode(ids(machine, text)) == text


def test_follow_rule_is_merging(machine):
    rnd = random.Random(2)
    pieces = list(machine.ids)
    for _ in range(3000):
        a, b = (machine.ids[rnd.choice(pieces[:6000])] for _ in range(2))
        assert machine._follows(a, b) == (machine.merge(machine.text[a] + machine.text[b]) == [machine.text[a], machine.text[b]])


def test_caches_do_not_change_results(library):
    with open(T.model_path(), "rb") as f:
        machine = T.Transducer(f.read())
    machine.LIMIT = machine.PAIRS = machine.STATES = 3
    for text in ("the theatre there", "a b c d e f g", "the theatre"):
        assert ids(machine, text) == library.encode(text)


def test_whole_table_round_trips(spark, sf, library):
    rows = T.op8_sentencepiece(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts) and all(r.round_trip and r.n_ids == len(r.ids) for r in rows)
    assert all(list(r.ids) == library.encode(texts[r.doc_id]) for r in rows)


def test_edge_cases(docs_of):
    docs = docs_of([None, "", " ", "same", "same", "word " * 50_000], [None, 1, 2, 3, 3, 4])
    encoded = T.encode_documents(docs)
    rows = encoded.collect()
    assert [r.n_ids for r in rows[:2]] == [0, 0] and all(r.round_trip for r in rows) and list(rows[3].ids) == list(rows[4].ids)
    assert [r.text for r in T.decode_documents(encoded).collect()][1:5] == ["", " ", "same", "same"]
    assert T.encode_documents(docs_of([])).count() == 0


def test_unigram_shortest_path():
    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    def piece(text, score, kind=1):
        return field(1, field(1, text.encode()) + bytes([2 << 3 | 5]) + np.float32(score).tobytes() + bytes([3 << 3, kind]))

    model = piece("<unk>", 0, 2) + piece("▁a", -1) + piece("b", -2) + piece("▁ab", -4) + piece("bb", -2.5) + field(2, bytes([3 << 3, 1])) + field(3, bytes([4 << 3, 0]))
    machine = T.Transducer(model)
    assert ids(machine, "abb") == [1, 4] and ids(machine, "ab") == [1, 2] and ids(machine, "ax") == [1, 0]


def plain_unigram(pieces, text, fallback):
    """The least weight of any way to cut a text into pieces and single characters that are none."""
    best = [0.0] + [np.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            part = text[start:end]
            if part in pieces:
                best[end] = min(best[end], best[start] - pieces[part])
            elif len(part) == 1:
                best[end] = min(best[end], best[start] + fallback)
    return best[-1]


@pytest.mark.parametrize("seed", range(5))
def test_composed_states_against_all_paths(seed):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(25)} - {"c"}
    pieces = {w: float(np.float32(-rnd.choice([1, 1.5, 2, 3, rnd.random() * 4]))) for w in words}

    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    def piece(text, score, kind=1):
        return field(1, field(1, text.encode()) + bytes([2 << 3 | 5]) + np.float32(score).tobytes() + bytes([3 << 3, kind]))

    model = piece("<unk>", 0, 2) + b"".join(piece(w, x) for w, x in pieces.items()) + field(2, bytes([3 << 3, 1])) + field(3, bytes([3 << 3, 0, 4 << 3, 0, 5 << 3, 0]))
    machine = T.Transducer(model)
    machine.STATES = rnd.choice([5, 10**6])
    for _ in range(300):
        text = "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 12)))
        got = ids(machine, text)
        spelled, weight = "", 0.0
        for i in got:
            weight += machine.fallback if i == 0 else -machine.score[i]
            spelled += text[len(spelled)] if i == 0 else machine.text[i]
        assert spelled == text and weight == pytest.approx(plain_unigram(pieces, text, machine.fallback))
