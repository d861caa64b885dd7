import random
import re

import numpy as np
import pytest

from lumenkpi.llm import neardup as N
from lumenkpi.llm import paragraphs as P
from lumenkpi.llm.components import components
from tests.llm.test_kernels import plain_shingles


def brute_components(rows):
    """Smallest doc_id reachable by links of similarity 0.75 on plain sets."""
    sets = {i: plain_shingles(t) for i, t in rows}
    name = {i: i for i in sets}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                name[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def random_groups(seed, groups=6, copies=12, words=60):
    """Originals with copies of all degrees of change: many of a group are close but not close enough."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    texts = []
    for _ in range(groups):
        original = [word() for _ in range(words)]
        for _ in range(copies):
            changed = list(original)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 4, 6])):
                changed[rnd.randrange(words)] = word()
            texts.append(rnd.choice([" ", "  ", "\n"]).join(changed))
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_all_pairs(docs_of, seed):
    rows = random_groups(seed)
    docs = docs_of([t for _, t in rows], [i for i, _ in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def test_edge_cases(docs_of):
    long = "lorem ipsum dolor sit amet " * 40_000
    texts = [None, "", " \n ", "a b", "A  b", "a b c", long, long + "x", "same text of more than five words here", "same text of more than five words here", "no id"]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 8, None]
    rows = N.near_duplicates(docs_of(texts, ids)).collect()
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is not None)
    assert got[:6] == [(0, 0, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True)]
    assert [g[2] for g in got[6:]] == [6, 6, 8, 8] and len(rows) == 11
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert N.near_duplicates(docs_of([])).count() == 0


def test_chains_and_stars_of_links(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(500, 500), (7, 3), (3, 7)]
    rows = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components(rows).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert components(rows.limit(0)).count() == 0


def passage(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def test_repeated_passages_are_found_wherever_they_stand(docs_of):
    rnd = random.Random(3)
    repeated = passage(rnd, 60)
    near = repeated.split()
    near[20] = "changed"
    texts = [
        passage(rnd, 40) + " " + repeated + " " + passage(rnd, 30),  # in the middle of a line
        passage(rnd, 20) + "\n" + repeated + "\n" + passage(rnd, 20),  # on its own line
        passage(rnd, 90),
        passage(rnd, 10) + "\n" + " ".join(near),
        passage(rnd, 120) + "\n" + passage(rnd, 50),
        None, "", "short", passage(rnd, 5),
    ]
    docs = docs_of(texts)
    found = P.repeated_paragraphs(docs)
    rows = found.collect()
    assert {r.doc_id for r in rows} == {0, 1, 3}
    assert {r.doc_id for r in rows if r.removed} == {1, 3} or {r.doc_id for r in rows if r.removed} == {0, 1, 3}
    assert any(r.kind == "near" and r.doc_id == 3 and r.removed for r in rows)
    for r in rows:
        if r.kind == "equal":
            mine, stays = texts[r.doc_id][r.start : r.stop].lower(), texts[r.rep_doc_id]
            assert mine.split() == stays[r.rep_start :].lower().split()[: len(mine.split())]
    cleaned = {r.doc_id: r for r in P.strip_paragraphs(docs, found).collect()}
    assert cleaned[0].text == texts[0] and cleaned[2].text == texts[2] and cleaned[4].text == texts[4] and cleaned[5].text is None
    assert len(cleaned[1].text.split()) < 75 and cleaned[1].spans == "s" and len(cleaned) == 9


def test_paragraphs_of_nothing_and_without_ids(docs_of):
    assert P.repeated_paragraphs(docs_of([])).count() == 0
    rnd = random.Random(1)
    line = passage(rnd, 40)
    assert P.repeated_paragraphs(docs_of([line, line], [None, 1])).count() == 0
    assert P.repeated_paragraphs(docs_of([line, line], [1, 1])).where("removed").count() == 0


def test_near_copies_of_short_and_wrapped_lines_are_found(docs_of):
    rnd = random.Random(7)
    eleven, seven, long = passage(rnd, 11).split(), passage(rnd, 7).split(), passage(rnd, 60).split()
    wrapped = lambda words, n: "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))
    edited = [*long[:30], "changed", *long[31:]]
    texts = [
        " ".join(eleven),
        passage(rnd, 9) + "\n" + " ".join(["other", *eleven[1:]]),
        " ".join(seven),
        passage(rnd, 12) + "\n\n" + " ".join([*seven, "more"]),
        wrapped(long, 10),
        passage(rnd, 40) + "\n\n" + wrapped(edited, 7) + "\n\n" + passage(rnd, 40),
        wrapped([*(line := passage(rnd, 24).split()), "x1", "x2", "x3", "x4"], 24),  # a line is most of its own paragraph
    ]
    docs = docs_of(texts)
    found = P.repeated_paragraphs(docs)
    removed = {(r.doc_id, texts[r.doc_id][r.start : r.stop]) for r in found.where("removed AND kind = 'near'").collect()}
    assert {(1, " ".join(["other", *eleven[1:]])), (3, " ".join([*seven, "more"])), (5, wrapped(edited, 7))} <= removed
    assert {d for d, _ in removed} == {1, 3, 5} and found.where("doc_id = 6").count() == 0
    kept = {r.doc_id: r.text for r in P.strip_paragraphs(docs, found).collect()}
    assert kept[4] == texts[4] and kept[6] == texts[6] and "changed" not in kept[5] and line[0] in kept[6]


def block_of(*texts):
    data = [t.encode() for t in texts]
    return P._Block(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))


def test_every_passage_of_fifty_words_holds_a_window():
    rnd = random.Random(11)
    covered = []
    for _ in range(300):
        shared, sides = passage(rnd, P.PASSAGE), []
        for _ in range(2):
            before = rnd.randint(0, 60)
            block = block_of(f"{passage(rnd, before)} {shared} {passage(rnd, rnd.randint(0, 40))}")
            sides.append({a - before for a in block.windows().tolist() if before <= a <= before + P.PASSAGE - P.SPAN})
        found = sides[0] & sides[1]
        assert found
        covered.append(len({i for a in found for i in range(a, a + P.SPAN)}))
    assert sum(covered) > 0.5 * P.PASSAGE * 300


def test_windows_do_not_depend_on_the_texts_beside():
    rnd = random.Random(13)
    for _ in range(40):
        texts = [passage(rnd, rnd.choice([0, 1, 2, 9, 19, 20, 30, 90])) for _ in range(4)]
        alone, base = [], 0
        for text in texts:
            alone += (block_of(text).windows() + base).tolist()
            base += len(text.split())
        assert block_of(*texts).windows().tolist() == alone


def plain_paragraphs(text, min_words):
    """(first word, end, words, whether it is a window) of the lines, runs of short lines and windows of a text."""
    words, lines = [], []
    for line in text.split("\n"):
        lines.append((len(words), len(words := words + line.lower().split())))
    found = [x for x in lines if x[1] > x[0]]
    run = []
    for x in [*lines, (0, 10**9)]:
        if 0 < x[1] - x[0] < P.SHORT_LINE:
            run.append(x)
            continue
        if len(run) > 1:
            found.append((run[0][0], run[-1][1]))
        run = []
    found = [(*x, False) for x in found] + [(a, a + P.SPAN, True) for a in block_of(text).windows().tolist()]
    return [(a, b, words[a:b], window) for a, b, window in found if b - a >= min_words]


def plain_set(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("min_words", [1, 20])
def test_paragraphs_against_all_pairs(docs_of, min_words):
    rnd = random.Random(17)
    pool = [passage(rnd, n).split() for n in (2, 4, 7, 12, 22, 26, 30, 45, 60, 70, 110)]

    def edited(words):
        words = list(words)
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            words[rnd.randrange(len(words))] = passage(rnd, 1)
        return words

    texts = []
    for _ in range(24):
        lines = []
        for _ in range(rnd.randint(1, 5)):
            words = edited(rnd.choice(pool)) if rnd.random() < 0.6 else passage(rnd, rnd.randint(1, 60)).split()
            lines.append(" ".join(words if rnd.random() < 0.7 else [*passage(rnd, 9).split(), *words, *passage(rnd, 13).split()]))
        texts.append(rnd.choice(["\n", "\n\n"]).join(lines))
    units = {(d, a, b, window): plain_set(w) for d, t in enumerate(texts) for a, b, w, window in plain_paragraphs(t, min_words)}
    places = sorted(units)
    name = {u: u for u in units}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for i, x in enumerate(places):
        for y in places[i + 1 :]:
            both = len(units[x] & units[y])
            overlap = x[0] == y[0] and x[1] < y[2] and y[1] < x[2]
            if x[3] == y[3] and not overlap and 100 * both >= 75 * (len(units[x]) + len(units[y]) - both):
                one, two = sorted((find(x), find(y)))
                name[two] = one
    overlaps = lambda x, first: x[0] == first[0] and x[1] < first[2]
    expected = {(u[:3], find(u)) for u in units if find(u) != u and not overlaps(u, find(u))}
    starts = [[t[: m.start()].count("") - 1 for m in re.finditer(r"\S+", t)] for t in texts]
    rows = P.repeated_paragraphs(docs_of(texts), min_words).where("removed").collect()
    ends = [[m.end() for m in re.finditer(r"\S+", t)] for t in texts]
    at = lambda d, start, stop: (d, starts[d].index(start), ends[d].index(stop) + 1)
    got = {at(r.doc_id, r.start, r.stop): (r.rep_doc_id, starts[r.rep_doc_id].index(r.rep_start)) for r in rows}
    wanted = {}
    for u, first in expected:
        wanted.setdefault(u, set()).add(first[:2])
    assert got.keys() <= wanted.keys() and len(got) >= 0.97 * len(wanted) and len(wanted) > 40
    assert sum(first in wanted[u] for u, first in got.items()) >= 0.97 * len(got)


def test_odd_paragraphs(docs_of):
    """Very long texts, repeated rows and ties: the least document and place stays."""
    rnd = random.Random(19)
    line = passage(rnd, 40)
    long = " ".join(passage(rnd, 30) for _ in range(1500))
    texts = [long + "\n" + line, line, line, line, long, "a " * 3000, None, ""]
    rows = P.repeated_paragraphs(docs_of(texts, [5, 3, 3, 4, 6, 7, 8, 9]), 20).collect()
    kept = {(r.rep_doc_id, r.rep_start) for r in rows if texts.index(line) >= 0 and r.rep_doc_id == 3}
    assert kept and {r.doc_id for r in rows if r.removed and r.rep_doc_id == 3} == {4, 5}
    assert len([r for r in rows if r.doc_id == 6 and r.removed]) > 1000 and {r.rep_doc_id for r in rows if r.doc_id == 6} == {5}
    assert {r.rep_doc_id for r in rows if r.doc_id == 7} == {7}  # it repeats itself
