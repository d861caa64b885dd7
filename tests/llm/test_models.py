import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenkpi.llm import langid as I
from lumenkpi.llm import quality as Q
from lumenkpi.llm import textkernel as K


@pytest.fixture(scope="module")
def data():
    return "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = I.op2_langid(spark, data).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    n = rows.count()
    assert n > 100 and rows.where("lang = lang_pred").count() / n > 0.97
    assert rows.where("score < 0 OR score > 1").count() == 0


@pytest.fixture(scope="module")
def model(spark):
    rnd = random.Random(1)
    make = lambda parts: " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(2, 4))) for _ in range(200))
    rows = [("aa", make(["ba", "be", "no", "ka"])) for _ in range(20)] + [("bb", make(["sch", "ung", "ter", "en"])) for _ in range(20)] + [("ru", make(["про", "ста", "ни", "во"])) for _ in range(20)] + [(None, "x y z"), ("aa", None)]
    return I.train(spark.createDataFrame(rows, "lang string, text string"))


def test_spans_of_mixed_text(model):
    text = "babe noka beno kaba nobe, schung teren ungter schen; прони ставо Ниста 12"
    got = I.spans(text, model, penalty=6.0)
    assert [g[2] for g in got] == ["aa", "bb", "ru"]
    assert text[got[1][0] : got[1][1]] == "schung teren ungter schen"
    assert I.spans("12 !", model) == []


def test_scripts_narrow_the_candidates(model):
    latin, cyrillic = (list(I.SCRIPT_RANGES).index(s) + 1 for s in ("latin", "cyrillic"))
    names = np.array(model.languages)
    assert names[model.candidates[cyrillic]].tolist() == ["ru"] and names[model.candidates[latin]].tolist() == ["aa", "bb"]
    assert model.candidates[0].all()


def test_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(3)
    sizes = [0, 1, 4, 6, 2, 6]
    scores = rng.normal(size=(sum(sizes), 3)).astype(np.float32) * 3
    first = np.concatenate([[0], np.cumsum(sizes)])
    path = I.viterbi(scores, first, 2.0)
    total = lambda s, p: sum(s[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
    for a, b in zip(first[:-1], first[1:], strict=True):
        part = scores[a:b]
        best = max((total(part, p) for p in itertools.product(range(3), repeat=b - a)), default=0)
        assert total(part, path[a:b].tolist()) == pytest.approx(best, abs=1e-4)


def test_language_edge_cases(docs_of, model):
    texts = [None, "", "12 34 !?", "babe noka", "babe noka", "babe " * 60_000, "漢字", "é"]
    rows = I.identify(docs_of(texts, [0, 1, 2, 3, 3, 4, None, 5]), model).collect()
    assert [(r.lang_pred, r.score) for r in rows[:3]] == [("und", 0.0)] * 3
    assert rows[3].lang_pred == rows[4].lang_pred == rows[5].lang_pred == "aa" and rows[5].score == 1.0
    assert rows[6].lang_pred in model.languages and rows[7].lang_pred in model.languages
    assert I.identify(docs_of([]), model).count() == 0


def test_no_training_text(spark, docs_of):
    empty = I.train(spark.createDataFrame([], "lang string, text string"))
    assert [r.lang_pred for r in I.identify(docs_of(["abc"]), empty).collect()] == ["und"]


def test_quality_on_labels_the_model_has_not_seen(spark, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = Q.op1_quality(spark, data).join(labels, "doc_id").where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(2)) == 1)
    good, bad = rows.where("quality = 1"), rows.where("quality = 0")
    assert good.where("kept").count() / good.count() > 0.97
    assert bad.where("NOT kept").count() / bad.count() > 0.6


def test_weights_against_plain_counts(spark, docs_of):
    texts = ["Good words, good!", "bad%% bad%% words", "", None, "good good words", "words"]
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    docs = docs_of(texts)
    ratio = Q.fit(docs, labels, buckets=97)
    half = {r.doc_id for r in labels.where(Q._half() == 0).collect()}

    def features(text):
        import re

        t = [m[0].lower().encode() for m in re.finditer(r"\w+|[^\w\s]+", text or "")]
        h = [int(K.run_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0]) for x in t]
        pairs = [int(K.mix(np.array([(a * 3 + b) % (1 << 64)], np.uint64))[0]) for a, b in zip(h, h[1:], strict=False)]
        return [x % 97 for x in h + pairs]

    raw, target = np.zeros(97), np.zeros(97)
    for i, t in enumerate(texts):
        np.add.at(raw, features(t), 1)
        if i in half:
            np.add.at(target, features(t), 1)
    p = (raw + 1) / (raw.sum() + 97)
    expected = np.log((target / target.sum() + Q.PRIOR * p) / (1 + Q.PRIOR) / p)
    assert ratio == pytest.approx(expected)
    got = {r.doc_id: r.log_weight for r in Q.weigh(docs, ratio).collect()}
    assert got == {i: pytest.approx(sum(expected[f] for f in features(t))) for i, t in enumerate(texts)}


def test_kth_largest_is_exact(spark):
    rnd = random.Random(1)
    values = [rnd.choice([rnd.gauss(0, 1), rnd.gauss(0, 1e-9), 5.0, -1e300, 1e300]) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    for k in (1, 2, 77, 250, 499, 500):
        assert Q.kth_largest(rows, "v", k) == sorted(values, reverse=True)[k - 1]
    assert Q.kth_largest(rows, "v", 501) is None and Q.kth_largest(rows, "v", 0) == float("inf")


def test_gumbel_noise_has_its_moments(spark):
    ratio = np.zeros(Q.BUCKETS)
    docs = spark.createDataFrame([(i, f"w{i}") for i in range(4000)], "doc_id long, text string")
    keys = Q.weigh(docs, ratio, temperature=1.0).toPandas().key.to_numpy()
    assert abs(keys.mean() - 0.5772) < 0.1 and abs(keys.var() - np.pi**2 / 6) < 0.25


def test_gumbel_top_k_draws_in_proportion_to_weights(spark):
    ratio = np.zeros(Q.BUCKETS)
    data = np.frombuffer(b"light" + b"heavy", np.uint8)
    light, heavy = (int(x) % Q.BUCKETS for x in K.run_hashes(data, np.array([0, 5]), np.array([5, 10])))
    assert light != heavy
    ratio[heavy] = np.log(3.0)
    docs = spark.createDataFrame([(i, "heavy" if i % 2 else "light") for i in range(8000)], "doc_id long, text string")
    weights = Q.weigh(docs, ratio, temperature=1.0)
    assert weights.where("log_weight > 0").count() == 4000
    bound = Q.kth_largest(weights, "key", 400)
    drawn = weights.where(F.col("key") >= bound)
    assert drawn.count() == 400 and abs(drawn.where("log_weight > 0").count() / 400 - 0.75) < 0.07  # few of many: 3 to 1
    low = Q.weigh(docs, ratio, temperature=0.01)
    assert low.where(F.col("key") >= Q.kth_largest(low, "key", 400)).where("log_weight > 0").count() == 400


def test_a_draw_that_ends_in_a_tie_keeps_all_of_it(spark, docs_of):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    texts = ["good words", "%% ##", "good words", "good words", "## %%", ""]
    rows = Q.resample(docs_of(texts, [1, 2, 1, 1, 2, 3]), labels, k=2).collect()
    kept = [r.kept for r in rows if r.doc_id == 1]
    assert all(kept) or not any(kept)
    keys = sorted((r.key for r in rows), reverse=True)
    assert {r.kept for r in rows if r.key >= keys[1]} == {True} and not any(r.kept for r in rows if r.key < keys[1])


def test_quality_edge_cases(spark, docs_of):
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    texts = ["fine words here", "fine words there", "%% && ##", "## $$ %%", None, "", "fine words here", "x " * 100_000]
    rows = Q.resample(docs_of(texts, [0, 1, 2, 3, 4, 5, None, 6]), labels).collect()
    assert len(rows) == 8 and next(r for r in rows if r.doc_id == 4).log_weight == 0
    assert all(r.kept for r in Q.resample(docs_of(texts), labels.limit(0)).collect())
    assert Q.resample(docs_of([]), labels).count() == 0
    assert sum(r.kept for r in Q.resample(docs_of(texts), labels, k=3).collect()) == 3
