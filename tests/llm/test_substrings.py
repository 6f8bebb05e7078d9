"""Repeated windows against brute force, covers, and odd rows."""
import hashlib
import random
import re

import pytest

from marketframe.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, spans string, lang string"


def brute(docs, window):
    """(words, kept words) of every row."""
    rows = [((1 << 63) - 1 if k is None else k, WORD.findall(t or "")) for k, t in docs]
    least = {}
    for k, w in rows:
        for i in range(len(w) - window + 1):
            s = tuple(w[i:i + window])
            least[s] = min(least.get(s, k), k)
    out = []
    for k, w in rows:
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i:i + window])] < k:
                gone |= set(range(i, i + window))
        out.append((len(w), [x for i, x in enumerate(w) if i not in gone]))
    return out


def corpus(seed, window):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 3)))
    passages = [[word() for _ in range(window + extra)] for extra in (-1, 0, 1, 7, 30)]
    docs = []
    for i in range(80):
        w = [word() for _ in range(rng.randrange(5, 60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w))
            w[at:at] = rng.choice(passages)
        docs.append((i * 3 % 80, w))
    docs += [(200 + i, docs[i][1]) for i in range(20)]                                  # exact copies
    docs += [(300 + i, docs[5][1][:i] + ["edit"] + docs[5][1][i:]) for i in range(25)]  # near copies of each other
    docs += [(400, ["x"] * 200), (401, ["x"] * 90), (402, ["x", "y"] * 60), (403, ["y", "x"] * 60)]
    gap = [" ", "\t", "\n", "  ", "\x0b"]
    texts = [(k, "".join(x + rng.choice(gap) for x in w)) for k, w in docs]
    return texts + [(500, None), (501, ""), (502, " \n "), (7, texts[3][1]), (None, texts[4][1]), (None, texts[4][1]), (None, "only here " * 30), (7, texts[3][1])]


@pytest.mark.parametrize("window, period", [(12, 5), (12, 12), (20, 13), (50, 21), (7, 1)])
def test_equals_brute_force(spark, window, period):
    docs = corpus(window, window)
    frame = spark.createDataFrame([(k, t, "s", "en") for k, t in docs], SCHEMA).repartition(5)
    got = substrings.scan(frame, window, period).collect()
    have = sorted((str(r.doc_id), r.n_words, r.kept, sum(s.end - s.start for s in r.spans)) for r in got)
    want = sorted((str(k), n, " ".join(kept), n - len(kept)) for (k, _), (n, kept) in zip(docs, brute(docs, window)))
    assert have == want


def test_remove_keeps_columns_and_clear_texts(spark):
    docs = corpus(3, 12)
    frame = spark.createDataFrame([(k, t, "s", "en") for k, t in docs], SCHEMA)
    cut = substrings.remove(frame, 12, 5)
    assert cut.columns == frame.columns
    want = sorted((str(k), str(t if n == len(kept) else " ".join(kept))) for (k, t), (n, kept) in zip(docs, brute(docs, 12)))
    assert sorted((str(r.doc_id), str(r.text)) for r in cut.collect()) == want


@pytest.mark.parametrize("period", [1, 2, 3, 7, 13, 21, 31, 40])
def test_cover_reaches_every_difference(period):
    cover = substrings.cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert len(cover) <= 1.5 * period ** 0.5 + 1


def test_crowded_bitmaps_lose_nothing(spark, monkeypatch):
    from marketframe.llm import bitmaps
    fill = bitmaps.fill
    monkeypatch.setattr(bitmaps, "fill", lambda keys, bits=64: fill(keys, 64))
    docs = corpus(9, 12)
    got = substrings.scan(spark.createDataFrame([(k, t, "s", "en") for k, t in docs], SCHEMA), 12, 5).collect()
    assert sorted((str(r.doc_id), r.kept) for r in got) == sorted((str(k), " ".join(x)) for (k, _), (_, x) in zip(docs, brute(docs, 12)))


def test_empty_table_and_long_text(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert substrings.scan(none).count() == 0 and substrings.remove(none).count() == 0
    words = [f"w{i}" for i in range(300_000)]
    frame = spark.createDataFrame([(1, " ".join(words[1000:])), (2, " ".join(words)), (3, "end " + " ".join(words[:-1]))], "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.scan(frame).collect()}
    assert (got[1].spans, got[1].n_words) == ([], 299_000)
    assert got[2].kept == " ".join(words[:1000]) and got[3].kept == "end"


def test_wrong_period(spark):
    with pytest.raises(ValueError):
        substrings.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 10, 11)


def test_digest_columns(spark, path):
    rows = substrings.op11_substring_dedup(spark, path)
    assert rows.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    whole = rows.where("n_removed = n_words and n_words > 0").first()
    assert whole.kept_sha256 == hashlib.sha256(b"").hexdigest()
