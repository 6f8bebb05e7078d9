"""The corpus pipeline stage by stage against plain rules, and on odd rows."""
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline  # noqa: E402
from marketframe.llm import toxicity  # noqa: E402
from test_decontamination import brute as hits  # noqa: E402
from test_secrets import brute as secrets  # noqa: E402
from test_similarity import brute as components  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, path, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(str(folder / name))
        docs = out[name] = spark.read.parquet(str(folder / name))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]
    for name in ("toxicity", "near_duplicates", "decontamination", "secrets"):
        assert stages[name].columns == stages["documents"].columns


def test_toxic_documents_go(spark, path, stages):
    docs = stages["documents"]
    model = toxicity.fit(docs, spark.read.parquet(f"{path}/labels.parquet"), train=toxicity.TRAIN)
    want = {r.doc_id for r in toxicity.score(docs, model).collect() if r.score < 0.7}
    assert {r.doc_id for r in stages["toxicity"].collect()} == want


def test_one_document_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages["toxicity"].collect()]
    found = components(rows, words=5, percent=80)
    want = sorted({c for _, n, c in found if n} | {k for k, n, _ in found if not n})
    assert sorted(r.doc_id for r in stages["near_duplicates"].collect()) == want


def test_contaminated_documents_go(spark, path, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in stages["near_duplicates"].collect()]
    assert sorted(r.doc_id for r in stages["decontamination"].collect()) == sorted(k for k, _, h, _ in hits(rows, items) if not h)


def test_secrets_are_redacted(stages):
    before = {r.doc_id: r for r in stages["decontamination"].collect()}
    after = {r.doc_id: r for r in stages["secrets"].collect()}
    assert before.keys() == after.keys()
    for k, r in after.items():
        assert not secrets(r.text) and r.n_chars == len(r.text)
        assert secrets(before[k].text) or "[SECRET]" in r.text or r.text == before[k].text


def test_mixture_is_drawn_from_the_rest(spark, path, stages):
    rows = stages["mixing"].collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in stages["secrets"].collect()}
    for (k, n), m in Counter((r.doc_id, r.copies) for r in rows).items():
        assert n == m
    assert Counter(r.shuffle_key for r in corpus_pipeline.run(spark, path).collect()) == Counter(r.shuffle_key for r in rows)


def test_odd_rows(spark, path):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "a", 0, 2), (2, "x " * 30_000, "en", "a", 60_000, 3), (3, "token=abcdefgh12 é", "en", None, 3, 4), (3, "token=abcdefgh12 é", "en", None, 3, 4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, cls int"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert name == "mixing" or docs.count() == (5 if name == "toxicity" else 4)
        if name == "secrets":
            assert sorted((str(r.doc_id), r.text or "", r.n_chars) for r in docs.collect())[2:] == [("3", "[SECRET] é", 10), ("None", "", None)]
        if name != "mixing":
            assert docs.columns == [x.split()[0] for x in schema.split(", ")]
    none = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, path)
    assert none.count() == 0
