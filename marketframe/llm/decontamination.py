"""Benchmark decontamination by word windows.

Benchmark items and documents are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters. A window is
WINDOW consecutive words of an item; an item with fewer words, but not none, is one window. The distinct windows go to the
executors as a sorted hash set behind a bitmap. A benchmark with more than BLOCK windows is dealt into blocks of items by hash
and the documents are scanned once per block within one stage, so that no broadcast exceeds the bound whatever the size of
the benchmark. Hits are verified word by word: all word hashes must agree, and the bytes are compared once per window and chunk.

Results per row: words, hit words, items with occurring windows, and the hit spans in code points. remove() drops documents or cuts
the spans. Null or empty texts have no words. Null item ids mark words as hit but are no items; repeated items count once;
repeated documents are scanned each. An empty benchmark hits nothing. Further columns are kept by remove() and ignored by
scan(), so names may clash.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from marketframe.llm import texts
from marketframe.llm.registry import query, table

WINDOW = 10
#: windows in one broadcast: hashes, word hashes and texts of a block take about 300 bytes each
BLOCK = 500_000
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
SCANNED = "doc_id long, text string, n_words long, words array<struct<start:long,end:long>>, spans array<struct<start:long,end:long>>, items array<long>"


def _items(batches, size: int):
    """Windows of each item: item_id, words (one text), number of words."""
    for batch in batches:
        ids = batch.column("item_id").cast(pa.int64()).to_pylist()
        item, words, n = [], [], []
        for chunk in texts.chunks(batch.column("text")):
            chunk.words(texts.ALNUM, lower=True)
            low = texts.LOWER[chunk.data]
            first = np.concatenate(([0], np.cumsum(chunk.count()))).tolist()
            for r in range(chunk.rows):
                own = [low[a:b].tobytes() for a, b in zip(chunk.starts[first[r]:first[r + 1]], chunk.ends[first[r]:first[r + 1]])]
                k = min(size, len(own))
                for i in range(len(own) - k + 1 if own else 0):
                    item.append(ids[chunk.first + r])
                    words.append(b" ".join(own[i:i + k]).decode())
                    n.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["item_id", "words", "n"])


class Windows:
    """The windows of one block, by their number of words."""

    BITS = 22

    def __init__(self, rows: pd.DataFrame):
        self.sizes = {}
        for n, part in rows.groupby("n"):
            listed = part.groupby("words")["item_id"].agg(lambda x: sorted({int(i) for i in x if not pd.isna(i)}))
            chunk = next(texts.chunks(pa.array(["\n".join(listed.index)]), 1))
            chunk.words(texts.ALNUM)
            h = chunk.hash.reshape(-1, int(n))
            key, _ = texts.window_hash(chunk.hash, np.zeros(len(chunk.hash), dtype=np.int64), int(n))
            key = key[::int(n)]
            order = np.argsort(key)
            bitmap = np.zeros(1 << self.BITS, dtype=bool)
            bitmap[(key & np.uint64((1 << self.BITS) - 1)).astype(np.int64)] = True
            names = list(listed.index)
            self.sizes[int(n)] = (key[order], h[order], [names[i].encode() for i in order], [listed.iloc[i] for i in order], bitmap)

    def find(self, chunk: texts.Chunk):
        """Verified hits: word position, words, and the block's window (n, index)."""
        for n, (keys, words, names, _, bitmap) in self.sizes.items():
            h, within = texts.window_hash(chunk.hash, chunk.row, n)
            at = np.flatnonzero(bitmap[(h & np.uint64((1 << self.BITS) - 1)).astype(np.int64)] & within) if len(h) else np.zeros(0, np.int64)
            # two windows of one block with equal hashes would share a run; every one of the run is compared
            lo, hi = np.searchsorted(keys, h[at]), np.searchsorted(keys, h[at], side="right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            sure: dict[int, bool] = {}
            while len(at):
                same = np.ones(len(at), dtype=bool)
                for j in range(n):
                    same &= chunk.hash[at + j] == words[lo, j]
                for i in np.flatnonzero(same).tolist():
                    k = int(lo[i])
                    if k not in sure:
                        a = int(at[i])
                        own = b" ".join(texts.LOWER[chunk.data[s:e]].tobytes() for s, e in zip(chunk.starts[a:a + n], chunk.ends[a:a + n]))
                        sure[k] = own == names[k]
                good = same & np.array([sure.get(int(k), False) for k in lo], dtype=bool)
                yield n, at[good], lo[good]
                lo = lo + 1
                at, lo, hi = at[lo < hi], lo[lo < hi], hi[lo < hi]


def scan_batch(block: Windows, ids: pa.Array, column: pa.Array, before=None) -> list[tuple]:
    """(n_words, word spans, code point spans, items) of every row, joined with those of earlier blocks."""
    out = []
    for chunk in texts.chunks(column):
        chunk.words(texts.ALNUM, lower=True)
        n_words = chunk.count()
        first = np.concatenate(([0], np.cumsum(n_words)))
        edge = np.zeros(len(chunk.hash) + 1, dtype=np.int64)
        found: dict[int, set] = {}
        for n, at, window in block.find(chunk):
            np.add.at(edge, at, 1)
            np.add.at(edge, at + n, -1)
            lists = block.sizes[n][3]
            pair = np.unique(np.stack([chunk.row[at], window]), axis=1) if len(at) else np.zeros((2, 0), dtype=np.int64)
            for r, w in pair.T.tolist():
                found.setdefault(r, set()).update(lists[w])
        hit = np.cumsum(edge[:-1]) > 0
        points = chunk.code_points() if found else None
        for r in range(chunk.rows):
            words, items = [], set(found.get(r, ()))
            if before is not None:
                words = [(s["start"], s["end"]) for s in before[0][chunk.first + r]]
                items |= set(before[1][chunk.first + r])
            if r in found or words:
                mask = hit[first[r]:first[r + 1]].copy()
                for a, b in words:
                    mask[a:b] = True
                turn = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
                words = list(zip(turn[::2].tolist(), turn[1::2].tolist()))
                points = chunk.code_points() if points is None else points
                base = int(points[chunk.offsets[r]])
                spans = [(int(points[chunk.starts[first[r] + a]]) - base, int(points[chunk.ends[first[r] + b - 1]]) - base) for a, b in words]
            else:
                spans = []
            out.append((int(n_words[r]), words, spans, sorted(items)))
    return out


def _pairs(rows: list[list[tuple]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in x] for x in rows], _SPANS)


def _scan(batches, block: Windows, keep_text: bool, later: bool):
    for batch in batches:
        before = (batch.column("words").to_pylist(), batch.column("items").to_pylist()) if later else None
        ids, text = batch.column("doc_id").cast(pa.int64()), batch.column("text")
        rows = scan_batch(block, ids, text, before)
        yield pa.RecordBatch.from_arrays(
            [ids, text if keep_text else pa.nulls(len(text), pa.string()), pa.array([r[0] for r in rows], pa.int64()), _pairs([r[1] for r in rows]),
             _pairs([r[2] for r in rows]), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
            names=["doc_id", "text", "n_words", "words", "spans", "items"])


def blocks(benchmark: DataFrame, window: int = WINDOW, bound: int = BLOCK) -> list[Windows]:
    """The windows of the benchmark in as many blocks as the bound asks for; at least one, which may be empty."""
    rows = benchmark.select("item_id", "text").mapInArrow(lambda b: _items(b, window), "item_id long, words string, n long").distinct()
    total = rows.count()
    n = max(1, -(-total // bound))
    if n == 1:
        return [Windows(rows.toArrow().to_pandas())]
    # equal windows fall into one block; a block holds about half the bound
    n *= 2
    return [Windows(rows.where(F.pmod(F.xxhash64("words"), F.lit(n)) == i).toArrow().to_pandas()) for i in range(n)]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, bound: int = BLOCK, keep_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, text (null unless kept), n_words, hit word spans, code point spans, items."""
    parts = blocks(benchmark, window, bound)
    out = docs.select("doc_id", "text")
    for i, part in enumerate(parts):
        held, last = docs.sparkSession.sparkContext.broadcast(part), i == len(parts) - 1
        out = out.mapInArrow(lambda b, h=held, k=keep_text or not last, later=i > 0: _scan(b, h.value, k, later), SCANNED)
    return out


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = WINDOW, bound: int = BLOCK) -> DataFrame:
    """docs without contaminated rows (mode documents), or with their hit spans cut out of text (mode spans); all columns stay."""
    parts = [docs.sparkSession.sparkContext.broadcast(p) for p in blocks(benchmark, window, bound)]

    def spans(text: pd.Series) -> list[list[tuple]]:
        column, before = pa.array(text, pa.string()), None
        rows: list[tuple] = []
        for held in parts:
            rows = scan_batch(held.value, None, column, before)
            before = ([[{"start": a, "end": b} for a, b in r[1]] for r in rows], [r[3] for r in rows])
        return [r[2] for r in rows]

    if mode == "documents":
        @F.pandas_udf("boolean")
        def clean(text: pd.Series) -> pd.Series:
            return pd.Series([not s for s in spans(text)], dtype=bool)
        return docs.where(clean(F.coalesce("text", F.lit(""))))
    if mode != "spans":
        raise ValueError(f"mode is documents or spans, not {mode}")

    @F.pandas_udf("string")
    def cut(text: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans(text.fillna(""))):
            for a, b in reversed(s):
                t = t[:a] + t[b:]
            out.append(t)
        return pd.Series(out, dtype=object)
    return docs.withColumn("text", cut("text"))


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS words
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.words = bw.words),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS ids
       FROM hits GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query("op10_decontamination", SQL)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("words", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
                        (n_hit > 0).alias("contaminated"))
