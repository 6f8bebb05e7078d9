"""Counts and base score against plain code, exchange clustering on planted classes, held-out gain, and odd rows."""
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketframe.llm import brown

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
HELD = lambda: F.expr("crc32(cast(doc_id as string)) % 7 = 2")


def brute(rows):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + [None] for _, t in rows]
    held = [k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows]
    c = Counter(x for t, h in zip(tokens, held) if not h for x in t)
    n, v = sum(c.values()), len(c)
    return [(k, h, len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)) for (k, _), h, t in zip(rows, held, tokens)]


def language(n, seed=1):
    """Determiners, adjectives, nouns and verbs in fixed order; words drawn with different weights."""
    rng = random.Random(seed)
    kinds = [[f"{k}{i}" for i in range(m)] for k, m in (("d", 4), ("a", 40), ("n", 120), ("v", 60))]
    weight = [[1 / (i + 1) for i in range(len(k))] for k in kinds]
    rows = []
    for i in range(n):
        words = [rng.choices(k, w)[0] for _ in range(rng.randint(3, 20)) for k, w in zip(kinds, weight)]
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = f"Rare{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("listed", [1 << 19, 50])
def test_counts_and_base_score(spark, listed):
    rows = language(300) + [(1000, None), (1001, ""), (None, "d0 A0"), (7, "d1 unknownword"), (7, "d1 unknownword")]
    df = spark.createDataFrame([(k, t, 1.5) for k, t in rows], "doc_id long, text string, score double")
    got = brown.score(df, HELD(), listed=listed, clustered=30, classes=4).collect()
    have = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got))
    assert have == sorted((str(k), h, n, m, t, round(b, 6)) for k, h, n, m, t, b in brute(rows))


def test_listing_does_not_change_tail_sums(spark):
    """The same words scored through the list and through the join get the same base score."""
    df = spark.createDataFrame(language(200), "doc_id long, text string")
    a, b = ({r.doc_id: round(r.base_score, 6) for r in brown.score(df, HELD(), listed=n, clustered=10, classes=3).collect()} for n in (10, 5000))
    assert a == b


@pytest.mark.parametrize("listed", [10, 60, 150])
def test_scores_do_not_depend_on_the_list(spark, listed):
    """Words beyond the list have the classes, transitions and emissions they would have on it."""
    df = spark.createDataFrame(language(300) + [(1000, "Unknown1 unknown2"), (1001, "v59 unknown3 n119 n118"), (1002, None)], "doc_id long, text string")
    few, all_ = ({r.doc_id: r for r in brown.score(df, HELD(), listed=n, clustered=20, classes=4).collect()} for n in (listed, 5000))
    assert few.keys() == all_.keys()
    assert all(few[k].score == pytest.approx(all_[k].score, abs=1e-6) and few[k].n_known == all_[k].n_known for k in all_)


@pytest.mark.parametrize("listed", [12, 5000])
def test_neighbours_equal_plain_counts(spark, listed):
    from marketframe.llm.storage import Shelf
    texts_ = [t for _, t in language(40)] + ["", "rare1 rare2"]
    df = spark.createDataFrame([(t,) for t in texts_], "text string").repartition(5)
    c = Counter(x for t in texts_ for x in t.lower().split())
    seen = {}
    stop = RuntimeError()

    def look(table, words, classes, sweeps=0):
        seen["n"] = Counter()
        for r in table.collect():
            body = np.frombuffer(bytes(r.entries), dtype=np.uint32).reshape(-1, 2).astype(int)
            for key, n in body.tolist():
                seen["n"][(r.w, key >> 1) if key % 2 == 0 else (key >> 1, r.w), key % 2, r.w] += n
        seen["words"] = words
        raise stop
    before, brown.cluster = brown.cluster, look
    try:
        with pytest.raises(RuntimeError):
            brown.fit(df, Shelf(spark, "test"), listed=listed, clustered=10, classes=3)
    finally:
        brown.cluster = before
    words = seen["words"]
    assert words.known == sum(n > 1 for n in c.values()) and words.whole == (listed == 5000)
    pairs = Counter()
    for t in texts_:
        ids = [None, *(x if c[x] > 1 else "tail" for x in t.lower().split()), None]
        pairs.update(zip(ids[:-1], ids[1:]))
    # every pair stands under each of its words beyond the head, or under the left one; the numbers of words may differ, their counts not
    left = Counter(sorted(n for (p, side, w), n in seen["n"].items() if side == 0 or not words.moving(np.array([p[0]]))[0]))
    assert left == Counter(sorted(pairs.values()))
    assert sum(n for (p, side, w), n in seen["n"].items() if p == (words.end, words.end)) == pairs[None, None]
    assert sum(n for (p, side, w), n in seen["n"].items() if side == 0 and p[0] == words.tail) + sum(
        n for (p, side, w), n in seen["n"].items() if side == 1 and p[0] == words.tail) == sum(n for (a, _), n in pairs.items() if a == "tail")


def test_every_known_word_is_clustered(spark):
    """Words beyond the head find the classes of their kind, and score nearly as well as if all were in the head."""
    from marketframe.llm.storage import Shelf
    df = spark.createDataFrame(language(1500), "doc_id long, text string")
    model, _ = brown.fit(df, Shelf(spark, "test"), clustered=30, classes=8)
    words = model.words
    names = [f"{k}{i}" for k, m in (("a", 40), ("n", 120), ("v", 60)) for i in range(m)]
    chunk = next(brown.texts.chunks(brown.pa.array([" ".join(names)])))
    chunk.words(lower=True)
    at = words.find(chunk.hash)
    ids = words.array.values[0][at]
    assert (at >= 0).all() and (ids >= 30).sum() > 150
    cls = model.label[ids]
    kinds = [Counter(cls[[n[0] == k for n in names]].tolist()) for k in "anv"]
    assert all(c < 8 for k in kinds for c in k)
    assert not any(set(a) & set(b) for i, a in enumerate(kinds) for b in kinds[:i])
    every, counts = words.array.values
    assert np.array_equal(np.bincount(model.label[every], weights=counts, minlength=10)[:8], model.total[:8]) and model.total.sum() == words.tokens
    few, many = (brown.score(df, HELD(), clustered=n, classes=8).where("held_out").agg(F.sum("score")).first()[0] for n in (30, 300))
    assert few > 1.01 * many


def test_classes_beat_single_words_on_held_out_texts(spark):
    df = spark.createDataFrame(language(1500), "doc_id long, text string")
    r = brown.score(df, HELD(), clustered=200, classes=8).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > 0.9 * r[1]


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(3)
    kind = rng.permutation(np.repeat([0, 1, 2], 12))
    pairs = np.zeros((37, 37))
    for _ in range(6000):
        a = rng.integers(36)
        b = rng.choice(np.flatnonzero(kind == (kind[a] + 1) % 3))
        pairs[a, b] += 1
    label = brown.exchange(pairs, 36, 3)
    assert len({(k, x) for k, x in zip(kind.tolist(), label[:36].tolist())}) == 3 and label[36] == 3


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame(language(100), "doc_id long, text string")
    from marketframe.llm.storage import Shelf
    model, _ = brown.fit(df, Shelf(spark, "test"), clustered=30, classes=4)
    assert np.allclose((10.0 ** model.move).sum(axis=1), 1)
    ids, _ = model.words.array.values
    mass = np.bincount(model.label[ids], weights=10.0 ** model.emit)
    assert np.allclose(mass[mass > 0], 1)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert brown.score(df, HELD()).count() == 0
    only = spark.createDataFrame([(9, "a b")], "doc_id long, text string")
    r = brown.score(only, F.lit(True)).first()
    assert (r.train_tokens, r.n_known, r.n_tokens) == (0, 0, 3) and math.isfinite(r.score) and r.base_score == 0
