import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lumenkpi.llm import textkernel as K
from lumenkpi.llm.neardup import choose_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_shingles(text, width=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def texts():
    rnd = random.Random(4)
    parts = ["a", "B", "é", "漢字", "\n", "\t", " ", "  ", "x1", " ", "the"]
    out = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    return [*out, None, "", " ", "one", "word " * 70_000, "w" * (3 << 20)]


def test_shingle_counts_and_overlaps_match_plain_sets():
    rows = texts()
    sets = [s for _, part in K.text_shingles(pa.array(rows)) for s in part]
    plain = [plain_shingles(t) for t in rows]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for i in range(0, 300, 7):
        for j in range(1, 300, 11):
            assert len(np.intersect1d(sets[i], sets[j])) == len(plain[i] & plain[j])


def test_slices_and_large_strings_read_alike():
    rows = texts()[:50]
    a = [s.tolist() for _, p in K.text_shingles(pa.array(rows).slice(10, 20)) for s in p]
    b = [s.tolist() for _, p in K.text_shingles(pa.array(rows[10:30], pa.large_string())) for s in p]
    assert a == b


def test_every_coordinate_fills_and_estimates_similarity():
    sketch, rng = K.FastSketch(128), np.random.default_rng(1)
    sizes = [1, 2, 5, 100, 5000]
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in sizes]
    got = sketch([*sets, np.zeros(0, np.uint64)])
    empty = np.uint64(2**64 - 1)
    assert not (got[:-1] == empty).any() and (got[-1] == empty).all()
    base = np.unique(rng.integers(0, 2**63, 800).astype(np.uint64))
    errors = []
    for share in (0.2, 0.5, 0.75, 0.9):
        n = int(800 * share)
        other = np.unique(np.concatenate([base[:n], rng.integers(0, 2**63, 800 - n).astype(np.uint64)]))
        true = len(np.intersect1d(base, other)) / len(np.union1d(base, other))
        one, two = sketch([base, other])
        errors.append(abs((one == two).mean() - true))
    assert max(errors) < 0.16


def test_sketch_does_not_depend_on_the_company():
    sketch = K.FastSketch(64)
    sets = [np.arange(n, dtype=np.uint64) * np.uint64(77) for n in (1, 3, 500)]
    alone = np.concatenate([sketch([s]) for s in sets])
    assert (sketch(sets) == alone).all()


def test_bands_are_tuned_for_recall():
    assert choose_rows(128, 0.75, 0.99999) == 4
    for rows in range(1, 5):
        assert 1 - (1 - 0.75**rows) ** (128 // rows) >= 0.99999
    assert choose_rows(128, 0.75, 0.9) > 4


@pytest.mark.parametrize("size", [1, 50, 1 << 21])
def test_blocks_cover_all_rows_once(size):
    offsets = np.array([0, 10, 10, 500, 501, 5000])
    got = list(K.blocks(offsets, size))
    assert got[0][0] == 0 and got[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
