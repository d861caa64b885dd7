import hashlib
import random
import re

import pytest
import xxhash

from lumenkpi.llm import linededup as L
from lumenkpi.llm import secrets as S
from lumenkpi.llm import syncmers as M

BASE = [
    ("assign", re.compile(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def plain_spans(text):
    found = [(m.start(), k, m.end(), name) for k, (name, p, g, least) in enumerate(BASE) for m in p.finditer(text or "") if len(m[g]) >= least]
    return ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(found))


def secret_texts():
    rnd = random.Random(7)
    parts = ["token", "Password", "=", ":", " ", "'", '"', "abc", "abcdef", "AKIA", "ABCDEFGHIJKLMNOP1234", "0123456789abcdef" * 2, "é", "漢", "\n", "api_key", "APIKEY", "token=token:abcdefgh", "secret = ", "_"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(400)]


def test_spans_against_the_patterns_one_text_at_a_time(docs_of):
    texts = [*secret_texts(), None, "", "x" * 200_000 + " token = abcdefgh"]
    rows = S.scan(docs_of(texts)).collect()
    got = {r.doc_id: ",".join(f"{S.RULES[f.kind].kind}:{f.start}:{f.stop}" for f in r.found) for r in rows}
    assert got == {i: plain_spans(t) for i, t in enumerate(texts)}


def test_query_digest(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in S.op5_secrets(spark, sf).collect():
        spans = plain_spans(texts[r.doc_id])
        assert r.spans == spans and r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert r.n_assign + r.n_access + r.n_hex == (spans.count(",") + 1 if spans else 0)


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "path string, content string")
    ledger = S.BlobLedger(spark, str(tmp_path / "ledger"))
    ledger.update(rows(("a", "token = abcdefgh"), ("b", "token = abcdefgh"), ("c", None)))
    assert ledger.entries().count() == 2
    ledger.update(rows(("d", "token = abcdefgh"), ("e", "clean")))
    assert ledger.entries().count() == 3
    report = {r.path: len(r.found) for r in ledger.report(rows(("a", "token = abcdefgh"), ("d", "token = abcdefgh"), ("e", "clean"), ("n", None))).collect()}
    assert report == {"a": 1, "d": 1, "e": 0, "n": 0}
    newer = S.BlobLedger(spark, str(tmp_path / "ledger"), (S.Rule("assign", S.RULES[0].pattern, 2, 9, version=2), *S.RULES[1:]))
    newer.update(rows(("a", "token = abcdefgh")))
    assert newer.entries().count() == 4 and newer.entries().where("array_contains(scanned, 'assign@2') AND size(scanned) = 1").count() == 1
    assert newer.findings().count() == 0 and ledger.findings().count() == 1


def test_redaction_keeps_everything_else(docs_of):
    texts = ["a token = abcdefgh b", "clean", None, "", "hex " + "0a" * 20 + " and AKIA" + "B" * 20]
    rows = sorted(S.redact(docs_of(texts)).collect(), key=lambda r: r.doc_id)
    assert [r.text for r in rows] == ["a [SECRET] b", "clean", None, "", "hex [SECRET] and [SECRET]"]
    assert rows[0].found == "f" and rows[0]._id == 4 and S.redact(docs_of([])).count() == 0


def plain_chunks(text):
    lines = text.split("\n")
    hashes = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    first, out = 0, []
    for i, h in enumerate(hashes):
        rolled = ((hashes[i - 1] if i else 0) * L.MULTIPLIER + h) % L.MODULUS
        if i == len(lines) - 1 or rolled % L.DIVISOR == 0:
            if i + 1 - first >= 2:
                out.append((first, i + 1))
            first = i + 1
    return lines, out


def plain_dedup(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out.append((i, None))
            continue
        lines, chunks = plain_chunks(t)
        gone = set()
        for a, b in chunks:
            chunk = "\n".join(lines[a:b])
            if chunk.strip() and chunk in seen:
                gone |= set(range(a, b))
            seen.add(chunk)
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_against_plain_loops(docs_of, seed):
    rnd = random.Random(seed)
    pool = [f"line {i} é" for i in range(60)] + [""]
    blocks = [[rnd.choice(pool) for _ in range(rnd.randint(2, 9))] for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [rnd.choice(blocks) if rnd.random() < 0.5 else [f"own {rnd.random()}" for _ in range(rnd.randint(0, 4))] for _ in range(rnd.randint(1, 4))]
        texts.append("\n".join(x for p in parts for x in p))
    texts += [None, "", "\n\n\n", "\n\n\n", "one", "y" * 300_000 + "\n" + "z"]
    got = sorted((r.doc_id, r.text) for r in L.line_dedup(docs_of(texts)).collect())
    assert got == plain_dedup(list(enumerate(texts)))


def test_repeated_rows_are_one_document_and_columns_stay(docs_of):
    rows = L.line_dedup(docs_of(["a\nb\nc\nd\ne"] * 2 + [None], [1, 1, None])).collect()
    assert [r.n_removed for r in rows] == [0, 0, 0] and rows[0].spans == "s" and rows[0].h == 1
    assert L.line_dedup(docs_of([])).count() == 0


def spark_hash(value, seed=42):
    raw = value.encode() if isinstance(value, str) else value.to_bytes(8, "little", signed=True)
    x = xxhash.xxh64_intdigest(raw, seed)
    return x - (1 << 64) if x >= 1 << 63 else x


def pair_hash(*values):
    seed = 42
    for v in values:
        seed = spark_hash(v, seed % (1 << 64))
    return seed


def plain_anchors(text):
    """(first word, hash) of the anchors."""
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if w]
    h = [spark_hash(x) for w in words for x in (w if len(w) > M.LONG else [w])]
    if not h:
        return []
    if len(h) < M.K:
        total = 0
        for x in h:
            total = pair_hash(total, x)
        return [(0, total)]
    g = [pair_hash(a, b) for a, b in zip(h, h[1:], strict=False)]
    out = []
    for i in range(len(h) - M.K + 1):
        inner = g[i : i + M.K - M.S + 1]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, pair_hash(g[i], g[i + 2], h[i + 4])))
    return out


def plain_text(anchors):
    return "".join(f"{h % (1 << 32):08x}{p - q:x}" for (p, h), q in zip(anchors, [0, *[p for p, _ in anchors]], strict=False))


def plain_links(anchors):
    if len(anchors) < 2:
        return {h for _, h in anchors}
    gap_hash = lambda a, gap, b: spark_hash(b, xxhash.xxh64_intdigest(gap.to_bytes(4, "little", signed=True), spark_hash(a) % (1 << 64)))
    return {gap_hash(a, q - p, b) for (p, a), (q, b) in zip(anchors, anchors[1:], strict=False)}


def plain_likeness(a, b):
    if a == b:
        return 1.0
    return len(a & b) / len(a | b)


def test_fingerprints_against_plain_loops(docs_of):
    rnd = random.Random(5)
    solid = ["".join(chr(rnd.randint(0x4E00, 0x4E40)) for _ in range(n)) for n in (65, 400, 400)]
    texts = [" ".join(f"w{rnd.randint(0, 60)}" for _ in range(rnd.randint(0, 90))) for _ in range(40)] + [None, "", "one two", "é" * 11, "a b c d e", "x y " * 4000, *solid, f"a {solid[1]} b", solid[2][:200] + solid[1][200:]]
    ids = [i * 37 % 101 for i in range(len(texts))]
    rows = {r.doc_id: r for r in M.compare_edited(docs_of(texts, ids)).collect()}
    by_id = {i: t or "" for i, t in zip(ids, texts, strict=True)}
    order = sorted(by_id, reverse=True)
    for k, i in enumerate(order):
        text, after = by_id[i], by_id[order[(k + 1) % len(order)]]
        n = len(text) // 2
        edited = text[: len(text) - n] + after[:n]
        r = rows[i]
        mine, new, other = (plain_anchors(t) for t in (text, edited, after))
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == plain_text(mine) and r.edited_fingerprint == plain_text(new)
        mine, new, other = map(plain_links, (mine, new, other))
        assert r.near_edited == plain_likeness(mine, new) and r.near_next == plain_likeness(mine, other)


def test_anchors_align_a_shared_passage(docs_of):
    rnd = random.Random(2)
    shared = " ".join(f"s{rnd.random()}" for _ in range(40))
    rows = M.anchors(docs_of(["x1 x2 x3 x4 " + shared, "y1 " + shared + " y2"])).collect()
    places = {}
    for r in rows:
        places.setdefault(r.hash, {})[r.doc_id] = r.position
    both = [p for p in places.values() if len(p) == 2]
    assert len(both) > 10 and {p[0] - p[1] for p in both} == {3}


def test_one_document_repeated_rows_and_none(docs_of):
    assert M.compare_edited(docs_of([])).count() == 0
    one = M.compare_edited(docs_of(["a b c d e f g h"])).first()
    assert one.near_next == 1.0
    rows = M.compare_edited(docs_of(["same words here and there"] * 2 + ["other", None], [1, 1, None, 2])).collect()
    assert len(rows) == 4 and len({r.fingerprint for r in rows if r.doc_id == 1}) == 1


def test_likeness_of_long_texts_is_exact_and_by_position(docs_of):
    rnd = random.Random(9)
    words = [[f"w{rnd.random()}" for _ in range(3000)] for _ in range(2)]
    shuffled = [x for k in rnd.sample(range(0, 3000, 6), 500) for x in words[0][k : k + 6]]  # most anchors, in another order
    texts = [" ".join(words[0]), " ".join(words[1][:1700] + words[0][:1300]), " ".join(shuffled)]
    rows = {r.doc_id: r for r in M.compare_edited(docs_of(texts)).collect()}
    anchors = [plain_anchors(t) for t in texts]
    assert all(rows[i].fingerprint == plain_text(anchors[i]) and len(anchors[i]) > 1000 for i in rows)
    a, b, c = map(plain_links, anchors)
    assert len(a & b) > 500 and rows[1].near_next == len(a & b) / len(a | b)
    same = [{h for _, h in x} for x in (anchors[0], anchors[2])]
    assert rows[0].near_next == len(a & c) / len(a | c) < 0.5 * len(same[0] & same[1]) / len(same[0] | same[1])
    n = len(texts[0]) // 2
    new = plain_links(plain_anchors(texts[0][: len(texts[0]) - n] + texts[2][:n]))
    assert rows[0].near_edited == len(a & new) / len(a | new)


def test_anchors_have_64_bits_and_texts_without_white_space_have_some(docs_of):
    rnd = random.Random(4)
    solid = ["".join(chr(rnd.randint(0x4E00, 0x9000)) for _ in range(400)) for _ in range(2)]
    solid.append(solid[1][:7] + solid[0][200:] + "𠀀" * 3)
    docs = docs_of(solid)
    hashes = {}
    for r in M.anchors(docs).collect():
        hashes.setdefault(r.doc_id, {})[r.hash] = r.position
    assert max(abs(x) for x in hashes[0]) > 1 << 40
    shared = [hashes[0][x] - hashes[2][x] for x in hashes[0].keys() & hashes[2].keys()]
    assert len(shared) > 50 and set(shared) == {193}
    assert all(0.1 < r.near_edited < 1 for r in M.compare_edited(docs).collect())
