"""Benchmark windows against brute force, in one block and in many, and on odd rows."""
import hashlib
import random
import re

import pytest

from marketframe.llm import decontamination as dec

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items, size=10):
    windows = {}
    for key, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(key)
    lengths, out = {len(x) for x in windows}, []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((key, len(w), len(hit), sorted(x for x in found if x is not None)))
    return out


def tables(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé9") for _ in range(rng.randint(2, 5)))
    items = [(i, " ".join(word() for _ in range(rng.choice((3, 9, 10, 11, 25))))) for i in range(20)]
    items += [(20, items[0][1]), (21, None), (22, ""), (23, " -- !"), (None, " ".join(word() for _ in range(12))), (25, "a b " * 9)]
    docs = []
    for i in range(60):
        parts = [word() for _ in range(40)]
        for _ in range(i % 4):
            item = words(rng.choice(items)[1])
            a = rng.randrange(max(1, len(item)))
            at = rng.randrange(len(parts))
            parts[at:at] = item[a:] if i % 2 else item
        docs.append((i, " ".join(x.upper() if rng.random() < 0.2 else x for x in parts) + "."))
    docs += [(60, None), (61, ""), (62, "x, y; " * 30), (62, "x, y; " * 30), (63, "a b " * 4000), (None, items[3][1])]
    return docs, items


@pytest.mark.parametrize("bound", [500_000, 40])
def test_hits_equal_brute_force(spark, bound):
    docs, items = tables()
    d = spark.createDataFrame([(k, t, "n") for k, t in docs], "doc_id long, text string, n_words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = dec.scan(d, b, bound=bound).collect()
    have = sorted((str(r.doc_id), r.n_words, sum(s["end"] - s["start"] for s in r.words), r["items"]) for r in got)
    assert have == sorted((str(k), n, h, i) for k, n, h, i in brute(docs, items))


def test_remove_documents_and_spans(spark):
    docs, items = tables(2)
    d = spark.createDataFrame([(k, t, "n") for k, t in docs], "doc_id long, text string, words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    clean = {str(k) for k, _, h, _ in brute(docs, items) if not h}
    kept = dec.remove(d, b)
    assert kept.columns == d.columns and {str(r.doc_id) for r in kept.collect()} == clean
    cut = dec.remove(d, b, mode="spans").collect()
    assert len(cut) == len(docs)
    want = {str(k): n - h for k, n, h, _ in brute(docs, items)}
    assert all(len(words(r.text)) == want[str(r.doc_id)] for r in cut)
    with pytest.raises(ValueError):
        dec.remove(d, b, mode="lines")


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.words) for r in dec.scan(d, none).collect()] == [(2, [])]
    assert dec.scan(d.limit(0), none).count() == 0 and dec.remove(d, none).count() == 1


def test_digest_columns(spark, path):
    row = dec.op10_decontamination(spark, path).where("contaminated").first()
    assert len(row.items_sha256) == 64 and row.n_hit > 0
    clean = dec.op10_decontamination(spark, path).where("not contaminated").first()
    assert clean.items_sha256 == hashlib.sha256(b"").hexdigest()
