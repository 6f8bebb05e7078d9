"""Notices planted in prose: exact, varied, several in a text, near misses, and odd rows."""
import random

from marketframe.llm import licenses


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."


def test_every_planted_notice_is_found(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(120):
        names = rng.sample(sorted(licenses.TEMPLATES), i % 3)
        parts = [prose(rng, rng.randint(5, 200)) for _ in range(4)]
        for name in names:
            parts.insert(rng.randrange(len(parts)), licenses.TEMPLATES[name][0])
        rows.append((i, "é\n" + "\n".join(parts), "x"))
        want[i] = sorted(names)
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = licenses.scan(df).collect()
    text = {r[0]: r[1] for r in rows}
    for i, names in want.items():
        assert sorted(r.license for r in got if r.doc_id == i) == names
    for r in got:
        assert r.verdict == "exact" and r.n_missing == r.n_added == 0 and r.reduction > 0
        assert licenses.WORD.findall(text[r.doc_id][r.start:r.end].lower()) == licenses.WORD.findall(licenses.TEMPLATES[r.license][0].lower())


def test_variants_and_near_misses(spark):
    rows = [(1, "This work is licensed under the terms of the GNU General Public License, version 3."), (2, "This work is licensed under the GNU General Public License, version 7."),
            (3, "We licensed the song to a film company."), (4, "LICENSED UNDER THE APACHE LICENSE VERSION 2.0"),
            (5, "Licensed under the Apache License,\nVersion 2.0."), (6, "Released under the MIT License. " * 3)]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.verdict))
    assert got == {1: [("GPL-3.0", "variant")], 4: [("Apache-2.0", "exact")], 5: [("Apache-2.0", "exact")], 6: [("MIT", "exact")] * 3}


def test_differences_are_listed(spark):
    df = spark.createDataFrame([(1, "This work is licensed under the new GNU General Public License, version 3.")], "doc_id long, text string")
    r = licenses.scan(df).first()
    assert (r.n_missing, r.n_added, r.differences) == (0, 1, "-+new")


def test_odd_rows(spark):
    long = "word " * 300_000 + "\nReleased under the MIT License.\n" + "é" * 10_000
    df = spark.createDataFrame([(None, None), (1, ""), (2, long), (2, long), (None, "Released under the MIT License.")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.start) for r in licenses.scan(df).collect()) == [("2", 1_500_001), ("2", 1_500_001), ("None", 0)]
    assert licenses.scan(df.limit(0)).count() == 0
