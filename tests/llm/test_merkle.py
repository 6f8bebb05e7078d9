"""Manifests against a plain tree, tampering, and odd rows."""
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from marketframe.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, idx int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def code(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves, fanout):
    """(root, proof of every leaf as a list of (before, after))."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i:i + fanout] for i in range(0, len(level), fanout)]
        for k, i in enumerate(at):
            run = runs[i // fanout]
            paths[k].append(("".join(run[:i % fanout]), "".join(run[i % fanout + 1:])))
        level, at = [sha("".join(r)) for r in runs], [i // fanout for i in at]
    return level[0], paths


def plain(docs, fanout):
    """{(leaf): (subroot, root, path)} of every row (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for d, t, lang, s, n in docs:
        groups.setdefault(s, []).append((-1 if d is None else d, sha("".join(map(code, (d, s, lang, n, t))))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: tree([h for _, h in sorted(groups[s])], fanout) for s in order}
    root, tops = tree([subs[s][0] for s in order], fanout)
    out = []
    for s, top in zip(order, tops):
        for (_, h), path in zip(sorted(groups[s]), subs[s][1]):
            out.append((h, subs[s][0], root, tuple(path + top)))
    return sorted(out)


def corpus(n=130, seed=1):
    rng = random.Random(seed)
    names = ["a", "b", "Z", "é", "", None, "lone", "zz", "m", "n"]
    docs = [(i, rng.choice(["x\ny\n", "plain", "", None, "line\nö"]), rng.choice(["en", None]), "b" if rng.random() < 0.4 else rng.choice(names), rng.choice([3, None]))
            for i in rng.sample(range(1000), n)]
    return docs + [(5, "t", "en", "lone2", 1), (None, "t", "en", "a", 1), (None, "u", None, None, 1), docs[0], docs[0], (docs[1][0], "other", "en", docs[1][3], 9)]


def frame(spark, docs):
    return spark.createDataFrame([(*d, "x", 7) for d in docs], SCHEMA).repartition(7)


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_equals_plain_tree(spark, fanout):
    docs = corpus(seed=fanout)
    got = merkle.manifest(frame(spark, docs), fanout).collect()
    assert sorted((r.h, r.subroot, r.root, tuple((s.before, s.after) for s in r.path)) for r in got) == plain(docs, fanout)


def test_one_source_one_row_and_none(spark):
    for docs in (corpus()[:1], [(i, "t", "en", "s", 1) for i in range(10)], [(i, "t", "en", f"s{i}", 1) for i in range(10)]):
        got = merkle.manifest(frame(spark, docs)).collect()
        assert sorted((r.h, r.subroot, r.root, tuple((s.before, s.after) for s in r.path)) for r in got) == plain(docs, 3)
    assert merkle.manifest(frame(spark, docs).limit(0)).count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(frame(spark, docs), 1)


def test_changes_are_found(spark):
    docs = corpus(60, 4)
    changed = F.when(F.col("doc_id") % 2 == 0, merkle.leaf({"text": F.regexp_replace("text", "\n", "")}))
    proved = merkle.verified(merkle.manifest(frame(spark, docs), carry={"changed": changed}), "changed")
    texts = {d: t for d, t, *_ in docs}
    seen = 0
    for r in proved.collect():
        if r.doc_id is not None and list(texts).count(r.doc_id) == 1 and [d[0] for d in docs].count(r.doc_id) == 1:
            tampered = r.doc_id % 2 == 0 and "\n" in (texts[r.doc_id] or "")
            assert r.verified is not tampered
            seen += tampered
    assert seen > 5


def test_query_columns(spark, path):
    rows = merkle.op12_merkle_manifest(spark, path).collect()
    assert len({r.root for r in rows}) == 1
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    for r in rows:
        assert r.verified is not (zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (text[r.doc_id] or ""))
        assert (r.folded_root == r.root) is r.verified


def test_long_text(spark):
    docs = [(1, "long\n" * 400_000, "en", "s", 1), (2, "", "en", "s", 0)]
    got = merkle.manifest(frame(spark, docs)).collect()
    assert sorted((r.h, r.subroot, r.root, tuple((s.before, s.after) for s in r.path)) for r in got) == plain(docs, 3)
