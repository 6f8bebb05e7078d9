"""The Jaccard join against all pairs, on near copies, shared passages and odd rows."""
import random
import re

import pytest

from marketframe.llm import similarity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, words=3, percent=90):
    sets, parent = [], list(range(len(rows)))
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(k)
    return sorted((k, len(s), min((x for x in groups[root(i)] if x is not None), default=None)) for i, ((k, _), s) in enumerate(zip(rows, sets)) if k is not None)


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows, ids = [], iter(rng.sample(range(10_000), 2_000))
    for size in (1, 2, 3, 8, 9, 10, 11, 12, 13, 18, 19, 20, 21, 22, 40, 75, 150, 400, 900):
        base = [word() for _ in range(size)]
        for copies in range(9):
            w = list(base)
            for _ in range(copies * max(1, size // 60)):
                at = rng.randrange(len(w))
                kind = rng.random()
                if kind < 0.4:
                    w[at] = word()
                elif kind < 0.7:
                    w.insert(at, word())
                elif len(w) > 1:
                    del w[at]
            rows.append((next(ids), " ".join(w).upper() if copies == 3 else "\n".join(w)))
        rows.append((next(ids), " ".join(passage + base)))
    # a chain whose ends do not link
    chain = [word() for _ in range(200)]
    for step in range(12):
        rows.append((next(ids), " ".join(chain)))
        chain[step * 3:step * 3 + 3] = [word() for _ in range(3)]
    rows += [(next(ids), None), (next(ids), ""), (next(ids), " \n\t "), (next(ids), "Éa  b"), (next(ids), "éa b"), (rows[5][0], rows[5][1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, cls string, n int")


@pytest.mark.parametrize("tile", [512, 3])
def test_links_equal_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(similarity, "TILE", tile)
    rows = corpus()
    got = sorted(tuple(r) for r in similarity.linked(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_keep_one_of_each_component(spark):
    rows = corpus(5)
    kept = similarity.keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "cls", "n"]
    want = sorted({c for _, n, c in brute(rows) if n} | {k for k, n, _ in brute(rows) if not n})
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_null_ids_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(None, text), (7, text + " end"), (None, text + " a"), (None, None)]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in similarity.linked(frame(spark, rows)).collect()}
    assert got == {(None, 98): 7, (7, 99): 7, (None, 99): 7, (None, 0): None}
    assert similarity.keep_one(frame(spark, rows)).count() == 2
    assert similarity.linked(frame(spark, [])).count() == 0
    assert similarity.keep_one(frame(spark, [])).count() == 0


def by_rule(rows, words, percent):
    """Component of every row by all pairs of its shingle sets, as row numbers."""
    sets, root = [], list(range(len(rows)))
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    return sets, root


@pytest.mark.parametrize("words,percent", [(5, 80), (1, 70)])
def test_other_rules_equal_all_pairs(spark, words, percent):
    rows = [(i, t) for i, (_, t) in enumerate(corpus(11))]
    sets, root = by_rule(rows, words, percent)
    got = sorted(tuple(r) for r in similarity.linked(frame(spark, rows), similarity.Rule(words, percent)).collect())
    assert got == [(i, len(s), root[i]) for i, s in enumerate(sets)]


def keys_of(texts, rule):
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "th": [0] * len(texts), "text": texts})
    return [set(k) for out in similarity.signatures([batch], rule) for k in out.column("keys").to_pylist()]


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_long_texts_meet_when_they_link_and_not_by_chance(words, percent):
    rng = random.Random(4)
    lines = [" ".join(f"line{i}x{j}" for j in range(12)) for i in range(40)]
    base, rows = [[f"d{i}w{rng.random()}" for _ in range(rng.randrange(2500, 4000))] for i in range(30)], []
    for w in base:
        for _ in range(6):                                                     # a few lines that all texts draw from
            at = rng.randrange(len(w))
            w[at:at] = rng.choice(lines).split()
        near, n = list(w), len(w) - words + 1
        for j in range(n * (100 - percent) // (100 + percent) // words):       # as many scattered words as a link allows
            near[j * (len(w) // (n * (100 - percent) // (100 + percent) // words))] = f"new{rng.random()}"
        rows += [" ".join(w), " ".join(near)]
    keys = keys_of(rows, similarity.Rule(words, percent))
    assert all(keys[i] & keys[i + 1] for i in range(0, len(rows), 2))
    apart = sum(bool(keys[i] & keys[j]) for i in range(len(rows)) for j in range(i) if i // 2 != j // 2)
    assert apart <= 17                                                         # of 1,740 pairs


def test_scattered_words_link_by_five_words_and_80_percent(spark):
    w = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:30] + ["x"] + w[31:70] + ["y"] + w[71:]))]
    assert similarity.keep_one(frame(spark, rows)).count() == 2
    assert similarity.keep_one(frame(spark, rows), similarity.Rule(5, 80)).count() == 1


def test_rules_out_of_range():
    for words, percent in ((0, 90), (3, 100), (3, 66)):
        with pytest.raises(ValueError):
            similarity.Rule(words, percent)


def test_join_lists_every_link(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TILE", 3)
    rows = [(i, t) for i, (_, t) in enumerate(corpus(7))]
    sets, _ = by_rule(rows, 3, 90)
    link = lambda a, b: bool(a and b) and 100 * len(a & b) >= 90 * len(a | b)
    pairs, members = (d.collect() for d in similarity.join(frame(spark, rows)))
    assert sorted((r.doc_id, r.n_shingles, r.n_links) for r in members) == [
        (i, len(a), sum(link(a, b) for j, b in enumerate(sets) if j != i)) for i, a in enumerate(sets)]
    text = {r.cls: frozenset(sets[r.doc_id]) for r in members if r.cls is not None}
    got = [frozenset((text[r.a], text[r.b])) for r in pairs]
    every = sorted(set(text.values()), key=sorted)
    want = {frozenset((a, b)) for i, a in enumerate(every) for b in every[:i] if link(a, b)}
    assert len(got) == len(set(got)) and set(got) == want and all(r.a < r.b for r in pairs)


@pytest.mark.parametrize("tile,mass", [(512, 300), (3, 1 << 20)])
def test_circles_in_parts_equal_all_pairs(spark, monkeypatch, tile, mass):
    monkeypatch.setattr(similarity, "TILE", tile)
    monkeypatch.setattr(similarity, "MASS", mass)
    rng = random.Random(2)
    rows = [(i, t) for i, (_, t) in enumerate(corpus(13))]
    for base in (rng.sample(range(10 ** 6), 179), rng.sample(range(10 ** 6), 700)):        # near the edge of a link
        for _ in range(30):
            w = [str(x) for x in base]
            for _ in range(len(w) // 90 + rng.randrange(2)):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    sets, root = by_rule(rows, 5, 80)
    got = sorted(tuple(r) for r in similarity.linked(frame(spark, rows), similarity.Rule(5, 80)).collect())
    assert got == [(i, len(s), root[i]) for i, s in enumerate(sets)]


def test_blocks_make_no_row_for_each_pair():
    """120 sets of which all 7,140 pairs link: one circle, and the links of a tree."""
    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(8)
    shared, members = rng.integers(0, 1 << 62, 170), []
    for k in range(120):
        items = np.sort(np.concatenate([shared, rng.integers(0, 1 << 62, 5)])).astype(np.uint64)
        bits = np.zeros(similarity.BITS, dtype=np.uint64)
        np.bitwise_xor.at(bits, (items & np.uint64(similarity.BITS - 1)).astype(np.int64), np.uint64(1) << ((items >> np.uint64(8)) & np.uint64(63)))
        members.append({"side": 2, "cls": k, "root": k, "n": len(items), "bits": bits.view(np.int64).tolist(), "items": items.view(np.int64).tolist()})
    kind = pa.struct([("side", pa.int32()), *[(c, pa.int64()) for c in ("cls", "root", "n")], ("bits", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))])
    batch = pa.RecordBatch.from_arrays([pa.array([members, members[:2]], pa.list_(kind))], names=["members"])
    circles, = similarity._circles([batch], 80)
    assert circles.column("circle").to_pylist() == [list(range(120)), [0, 1]]
    links, = similarity._link([batch], 80)
    assert len(links) == 119 + 1 and set(links.column("a").to_pylist() + links.column("b").to_pylist()) == set(range(120))
