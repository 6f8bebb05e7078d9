"""Maximal segments against their definition, learning on planted words, and odd rows."""
import random

import numpy as np
import pytest

from marketframe.llm import toxicity as tox


def maximal(scores):
    """Definition by recursion: the segment of largest sum (first, then shortest), and the same to either side of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > 0 and (best is None or s > best[2] + 1e-9 or abs(s - best[2]) < 1e-9 and j - i < best[1] - best[0]):
                best = (i, j, s)
    if best is None:
        return []
    i, j, s = best
    return maximal(scores[:i]) + [(i, j, s)] + [(a + j, b + j, v) for a, b, v in maximal(scores[j:])]


@pytest.mark.parametrize("seed", range(30))
def test_maximal_segments(seed):
    rng = random.Random(seed)
    scores = [rng.choice((-5, -3, -1, -0.4, 2.3, 4.7)) + rng.random() / 100 for _ in range(25)]
    got = tox.maximal_segments(np.array(scores))
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in maximal(scores)]
    assert tox.maximal_segments(np.array([])) == []


def corpus(seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    bad = ["vilgrub", "zorkhead", "blofnik"]
    docs, labels = [], []
    for i in range(1200):
        w = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "en", "ix"]))
        docs.append((i, " ".join(w).capitalize() + "."))
        labels.append((i, int(toxic)))
    return docs, labels


def test_learns_planted_words_and_places(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([(i, t, 0.0) for i, t in docs], "doc_id long, text string, score double")
    y = dict(labels)
    model = tox.fit(d, spark.createDataFrame([(i, t) for i, t in labels if i % 2], "doc_id long, toxic int").union(
        spark.createDataFrame([(i, t) for i, t in labels if i % 4 == 0], "doc_id long, toxic int")))
    rows = tox.score(d, model).collect()
    wrong = [r.doc_id for r in rows if (r.score >= 0.7) != bool(y[r.doc_id])]
    assert len(wrong) <= 6
    text = dict(docs)
    for r in rows:
        if r.passages:
            assert any(b in text[r.doc_id][r.passages[0]["start"]:r.passages[-1]["end"]].lower() for b in ("vilgrub", "zorkhead", "blofnik"))
    kept = tox.keep_clean(d, model)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.score < 0.7}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (2, "é" * 50_000), (2, "é" * 50_000), (3, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(None, 1), (1, None), (3, 0), (3, 1)], "doc_id long, toxic int")
    for labels in (none, odd):
        model = tox.fit(docs, labels)
        rows = tox.score(docs, model).collect()
        assert len(rows) == 5 and all(0 <= r.score < 0.7 for r in rows)
    assert tox.score(docs.limit(0), model).count() == 0
    assert [(r.doc_id, r.toxic) for r in tox.labelled_sample(odd).collect()] == [(3, 1)]


def test_sample_is_bounded_and_stable(spark):
    labels = spark.range(500).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    a = {r.doc_id for r in tox.labelled_sample(labels, 100).collect()}
    assert len(a) == 100 and a == {r.doc_id for r in tox.labelled_sample(labels.repartition(5), 100).collect()}
