"""Base rules against plain code, Kneser-Ney against a direct computation, bands, and odd rows."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketframe.llm import perplexity as ppl, texts
from marketframe.llm.storage import Shelf

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text)
    places = defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i:i + 3])].append(i)
    hit = {i + j for v in places.values() if len(v) > 1 for i in v for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def corpus():
    rng = random.Random(2)
    pool = ["a", "bb", "é", "x#", "|", "\n", "\n", " ", "a b c", "\t", " ", "日本", "\n \n", "*$%"]
    return ["".join(rng.choice(pool) + rng.choice(["", " "]) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "\n", "a", "a\na\n a", "x" * 3_000_000 + " y"]


def test_base_rules():
    rows = corpus()
    got = []
    for chunk in texts.chunks(pa.array(rows), 500):
        f = ppl.features(chunk)
        got += list(zip(*(f[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
    assert got == [base(t) for t in rows]


def kneser_ney(corpus_, order):
    """P(last byte | bytes before) by the textbook, as a function of an n-gram."""
    padded = [b"\0" * (order - 1) + t.encode() + b"\0" for t in corpus_]
    counts = {order: Counter(p[i:i + order] for p in padded for i in range(len(p) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    disc = {}
    for k, c in counts.items():
        n = Counter(c.values())
        disc[k] = ppl._discounts(n[1], n[2], n[3], n[4])
    after = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            after[k][g[:-1]].append(n)

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / 257
        rows = after[k].get(g[:-1])
        if not rows:
            return p(g[1:])
        off = sum(disc[k][min(n, 3) - 1] for n in rows)
        c = counts[k].get(g, 0)
        return max(c - (disc[k][min(c, 3) - 1] if c else 0), 0) / sum(rows) + off / sum(rows) * p(g[1:])
    return p


def test_model_equals_the_textbook(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 5)))
    vocab = [word() for _ in range(30)]
    rows = [" ".join(rng.choice(vocab) for _ in range(60 + i % 9)) for i in range(40)]
    rows = [t for t in rows if base(t)[4] * 100 <= 50 * base(t)[0]]
    df = spark.createDataFrame([(i, "en", t) for i, t in enumerate(rows)], "doc_id long, lang string, text string")
    model = ppl.fit(ppl.with_language(df))
    p = kneser_ney(rows, ppl.ORDER)
    language = ppl.with_language(df).first()["l"]
    test = rows[:3] + ["abc zzz!", "", "ééé"]
    chunk = next(texts.chunks(pa.array(test)))
    row, g = ppl.grams(chunk, np.full(len(test), language))
    got = texts.row_sums(row, model.log_prob(g), len(test))
    for i, t in enumerate(test):
        s = b"\0" * (ppl.ORDER - 1) + t.encode() + b"\0"
        want = sum(np.log10(p(s[j:j + ppl.ORDER])) for j in range(len(s) - ppl.ORDER + 1))
        assert got[i] == pytest.approx(want, rel=2e-3, abs=1e-3)


def test_bands_reject_what_is_odd_and_keep_the_rest(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("aeilmnrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows = [(i, "en", " ".join(rng.choice(vocab) for _ in range(90))) for i in range(300)]
    rows += [(1000, "en", " ".join("".join(rng.choice("QXZJKWV9") for _ in range(6)) for _ in range(90))), (1001, "en", "too short"), (1002, None, None),
             (1003, "en", ""), (1004, "xx", " ".join(rng.sample(vocab, 80))), (1004, "xx", "a b c " * 40)]
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, lang string, text string, kept boolean")
    got = ppl.judge(df).collect()
    assert len(got) == len(rows)
    assert sum(r.kept for r in got if r.doc_id is not None and r.doc_id < 1000) >= 297
    assert not any(r.kept for r in got if r.doc_id in (1000, 1001, 1002, 1003))
    assert sorted((r.base_failed, r.kept) for r in got if r.doc_id == 1004) == [(False, True), (True, False)]
    assert ppl.judge(df.limit(0)).count() == 0


def test_lower_band_rejects_droning(spark):
    """Documents that repeat a stock phrase below the base rule's share lie under the lower band of their length; others of any length stay."""
    rng = random.Random(9)
    vocab = ["".join(rng.choice("aeilmnrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows = [(i, "en", " ".join(rng.choice(vocab) for _ in range(60 if i % 3 else 1500))) for i in range(300)]
    droning = [" ".join(w for _ in range(150) for w in [*(rng.choice(vocab) for _ in range(6)), "buy", "it", "now"]) for _ in range(3)]
    df = spark.createDataFrame(rows + [(1000 + i, "en", t) for i, t in enumerate(droning)], "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in ppl.judge(df).collect()}
    assert not any(got[1000 + i].base_failed or got[1000 + i].kept for i in range(3))
    assert all(got[1000 + i].log_ppl < got[1000 + i].low for i in range(3))
    assert sum(got[i].kept for i in range(300)) >= 298


def test_bands_equal_plain_code(spark):
    rng = random.Random(10)
    rows = [(rng.choice(["en", "de"]), rng.random() < 0.8, round(rng.gauss(1.5, 0.2), 3), rng.randint(50, 5000)) for _ in range(400)] + [("xx", False, 9.0, 60), ("yy", True, 0.5, 60)]
    got = {r["_lang"]: r for r in ppl.bands(spark.createDataFrame(rows, "lang string, trusted boolean, log_ppl double, n long"), Shelf(spark, "test")).collect()}

    def quantile(values, q):
        return sorted(values)[max(int(np.ceil(len(values) * q)) - 1, 0)]
    middle = {k: quantile([p for lang, t, p, _ in rows if t and lang == k], 0.5) for k in ("en", "de", "yy")}
    assert got.keys() == {*middle, None}
    for k, r in got.items():
        here = [(p, n, middle[lang]) for lang, t, p, n in rows if t and k in (lang, None)]
        assert r.middle == pytest.approx(quantile([p for p, _, _ in here], 0.5), abs=1e-3)
        strays = [(p - m) * n ** 0.5 for p, n, m in here]
        assert (-r.below, r.above) == pytest.approx((quantile(strays, 0.25), quantile(strays, 0.75)), rel=2e-3, abs=2e-3)


def test_a_language_without_trusted_documents_is_judged(spark):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("aeilmnrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows = [(i, "en", " ".join(rng.choice(vocab) for _ in range(90))) for i in range(100)]
    rows += [(1000, "xx", " ".join(rng.choice("#*$%&|<>") + rng.choice(vocab) for _ in range(90))), (1001, None, "$ " + "too short")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in ppl.judge(df).collect()}
    assert not got[1000].base_failed and not got[1000].trusted and not got[1000].kept and not got[1001].kept
    assert all(got[i].kept for i in range(100))
    # without any trusted document nothing is outside
    assert ppl.judge(df.where("doc_id = 1000")).first().kept


def test_slots_bound_the_model(spark):
    df = spark.createDataFrame([(1, "en", " ".join(f"w{i}" for i in range(400)))], "doc_id long, lang string, text string")
    model = ppl.fit(ppl.with_language(df), slots=64)
    assert max(len(a.hash) for a in model.seen) <= 64


@pytest.mark.parametrize("slots", [8, 150, 700])
def test_perplexity_does_not_depend_on_slots(spark, slots):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 6))) for _ in range(80)]
    rows = [(i, rng.choice(["en", "de"]), " ".join(rng.choice(vocab) for _ in range(90))) for i in range(30)]
    rows += [(100, "en", "$$$$$$$$$ zzz"), (101, None, "abc"), (102, "en", None), (103, "xx", "ab ab")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    few, all_ = ({r.doc_id: r.log_ppl for r in ppl.judge(df, slots=n).collect()} for n in (slots, ppl.SLOTS))
    assert few.keys() == all_.keys() and all(few[k] == pytest.approx(all_[k], abs=1e-5) for k in all_)
