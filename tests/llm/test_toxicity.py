import random
import zlib

import numpy as np

from lodestar.llm import toxicity


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def corpus(n=900, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        toxic = int(r.random() < 0.15)
        text = [r.choice(words) for _ in range(r.randint(20, 200))]
        if toxic:
            for _ in range(r.randint(2, 5)):
                text[r.randrange(len(text))] = r.choice(["zqwidiot", "zqwmoron", "xxstem" + r.choice("abcdefghij") + r.choice("klmno")])
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    return rows, labels


def test_scores_of_held_out_documents(spark):
    rows, labels = corpus()
    odd = [(10_000, None), (10_001, ""), (10_002, "word " * 60_000 + "zqwidiot zqwmoron"), (3, rows[3][1]), (None, "a b")]
    docs = spark.createDataFrame([(i, t, 1.0, "x") for i, t in [*rows, *odd]], "doc_id long, text string, score double, term string")
    marks = spark.createDataFrame([*labels, (None, 1), (20_000, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    truth = dict(labels)
    right = [r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(right) > 100 and sum(right) / len(right) > 0.98
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["doc_id"] is None or r["held_out"] == held_out(r["doc_id"])
        assert len(r["evidence"]) <= 3 and all(truth[e["doc_id"]] == e["toxic"] and not held_out(e["doc_id"]) for e in r["evidence"])
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[10_002]["predicted"] == 1 and by_id[10_000]["score"] == by_id[10_001]["score"] < 0.3
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if not r["predicted"])


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    rows, labels = corpus(300, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    other = toxicity.fit(docs, spark.createDataFrame([(i, 1 - t if held_out(i) else t) for i, t in labels], "doc_id long, toxic int"))
    assert one.number == other.number and one.labels.tolist() == other.labels.tolist() and np.allclose(one.levels, other.levels)


def test_nearest_is_exact():
    r = random.Random(4)
    rows = [(i, r.randint(0, 1), {t: r.randint(1, 5) for t in r.sample(range(60), r.randint(0, 12))}) for i in range(700)]
    model = toxicity.Model([str(i) for i in range(60)], np.random.default_rng(1).uniform(1, 5, 60), rows, 0.3, (1.0, 1.0))
    dense = np.zeros((len(model.labels), 60))
    for t, (place, weight, _) in model.postings.items():
        dense[place, t] = weight
    assert np.allclose((dense ** 2).sum(axis=1), 1)
    for _ in range(200):
        at, weight = model.vector({t: r.randint(1, 4) for t in r.sample(range(60), r.randint(1, 10))})
        got = model.nearest(at, weight)
        sums = np.round(dense[:, at] @ weight, 12)
        want = sorted((-s, i) for i, s in enumerate(sums.tolist()) if s > 0)[: toxicity.NEIGHBOURS]
        assert np.allclose([s for s, _ in got], [-s for s, _ in want], atol=1e-9)
        assert sum(1 for (_, p), (_, q) in zip(got, want) if p != q) <= 2  # sums in another order may swap ties


def test_without_usable_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, none) is None
    assert [r["score"] for r in toxicity.score(docs, None).collect()] == [0.0, 0.0]
    assert toxicity.without_toxic(docs, None).count() == 2
    one_kind = toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert all(r["score"] < 0.3 for r in toxicity.score(docs, one_kind).collect())
    model = toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert toxicity.score(docs.limit(0), model).count() == 0
