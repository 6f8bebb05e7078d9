"""Phrase counts and collocations against plain counting, whatever the shards and slots, and on odd rows."""
import random
import re
from collections import Counter

import pytest

from marketframe.llm import collocations as co

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, n string, size int, phrase string"


def counts(docs, longest):
    f, total = Counter(), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    return f, total


def brute(docs, longest, threshold, top):
    f, total = counts(docs, longest)
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= threshold}
    rows = {}
    for (lang, p), a in cands.items():
        longer = [b for (other, q), b in cands.items() if other == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= 80 * a for b in longer):
            continue
        score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        rows.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, found in rows.items()
                  for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["été", "Été", " x", "ÄB", "ab"]
    stock = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(2, 6))) for _ in range(12)]
    docs = []
    for i in range(n):
        parts = [rng.choice(stock) if rng.random() < 0.5 else rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        text = "".join(p + rng.choice([" ", "  ", "\t", " ", ". ", ",", "\n", "!?", "\r\n", " ", "\x0b"]) for p in parts)
        docs.append((i, text.upper() if rng.random() < 0.2 else text, rng.choice(["en", "en", "en", "de", None, "und", ""])))
    return docs + [(900, None, "en"), (901, "", "en"), (902, " .,", "xx"), (903, "one", "yy"), (904, "late pair " * 40, "zz"), docs[0], docs[0]]


def frame(spark, docs):
    return spark.createDataFrame([(*d, "n", 1, "p") for d in docs], SCHEMA).repartition(6)


def as_rows(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("shards, slots, threshold", [(4, 1 << 16, 8), (1, 1 << 16, 8), (7, 64, 12), (3, 64, 5), (4, 1 << 16, 1)])
def test_equals_brute_force(spark, shards, slots, threshold):
    docs = corpus(shards)
    got = as_rows(co.collocations(frame(spark, docs), 4, threshold, 2000, shards, slots))
    assert got == brute(docs, 4, threshold, 2000)
    assert len(got) > 20


def test_top_and_other_lengths(spark):
    docs = corpus(11)
    assert as_rows(co.collocations(frame(spark, docs), 3, 6, 5, 4, 1 << 12)) == brute(docs, 3, 6, 5)


def test_counts_are_whole(spark):
    docs = corpus(5)
    phrases, totals = co.count(frame(spark, docs), 5, 4, 3, 1 << 14)
    f, total = counts(docs, 5)
    assert sorted((r.lang, r.phrase, r.n) for r in phrases.collect()) == sorted((lang, " ".join(p), n) for (lang, p), n in f.items() if n >= 4)
    assert {r.lang: r.n for r in totals.collect()} == {k: v for k, v in total.items() if v}


def test_exact_scores_beyond_64_bits(spark):
    rows = [("en", 1, "a", 8 * 10 ** 12), ("en", 1, "b", 9 * 10 ** 12), ("en", 2, "a b", 7 * 10 ** 12)]
    out = co.scored(spark.createDataFrame(rows, "lang string, size int, phrase string, n long")).collect()
    assert [(r.phrase, r.score) for r in out] == [("a b", 2000000 * 7 // 17)]


def test_empty_table_and_long_text(spark):
    assert co.collocations(frame(spark, corpus(1)).limit(0)).count() == 0
    docs = [(1, "big deal and " * 100_000, "en"), (2, "x" * 500_000, "en")]
    assert as_rows(co.collocations(frame(spark, docs))) == brute(docs, 4, 30, 2000)
    with pytest.raises(ValueError):
        co.count(frame(spark, docs), 4, 30, 64)
    with pytest.raises(ValueError):
        co.count(frame(spark, docs), 4, 30, 4, 100)


def test_query_columns(spark, path):
    assert co.op13_phrase_collocations(spark, path).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
