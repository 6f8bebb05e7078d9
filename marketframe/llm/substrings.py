"""Substring dedup by difference-cover anchors: word windows that also start in a document with a smaller id are cut.

A window is WINDOW consecutive words. Two occurrences of one window start at some positions i and j of their documents. A difference
cover D modulo PERIOD holds, for every pair of residues, a step s < PERIOD for which i + s and j + s both fall on D. So only
the anchors are hashed that start at cover positions, WINDOW - PERIOD + 1 words long: any shared window holds an anchor that
both documents hash, and no anchor reaches beyond it. With PERIOD 21 the cover has 5 residues: 24 % of the positions.

1. Every row gives its anchors and the digest of its whole word sequence. Rows with equal sequences are one class; only the row with
   the smallest id of a class has to be compared. An anchor counts as shared when several classes have it.
2. Extension: around shared anchors, and there alone, the windows that hold one are taken whole, as 128-bit digests. A window's smallest
   document follows from an aggregation that combines before its shuffle; no pairs of documents are made, so a passage with
   many owners costs one row for each.
3. Windows whose smallest document is smaller than their own mark their words; marks are merged to spans per row.

Rows travel without texts, but for those with shared anchors and those that lose words. Joins on anchors, windows and rows are exact;
bitmaps of fixed size before them only spare rows the shuffle, let more through when they are crowded and never lose one.
Digests have 128 bits, so 10 ** 12 different windows share one with a chance below 10 ** -14.

Odd rows: null and empty texts have no words; texts with fewer words than a window lose none; a null id counts as the largest one;
rows with equal ids (repeated rows too) do not cut each other, but both lose what a smaller id holds; an empty table gives an
empty result; further columns stay in remove() and are ignored by scan(), so names may clash. A text of any length is one row and
is worked on whole.
"""
from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from marketframe.llm import bitmaps, texts
from marketframe.llm.registry import query, table
from marketframe.llm.storage import Shelf

WINDOW = 50
PERIOD = 21
#: stands for a null id
LAST = (1 << 63) - 1
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
HEADS = "id long, th long, n_words long, c1 long, c2 long, anchors array<long>"
RESULT = "doc_id long, th long, n_words long, spans array<struct<start:long,end:long>>, kept string"


@lru_cache
def cover(period: int) -> tuple[int, ...]:
    """A smallest set of residues whose differences take every value modulo the period."""
    def grow(have: list[int], seen: frozenset, most: int):
        if len(seen) == period:
            return tuple(have)
        left = most - len(have)
        if not left or len(seen) + sum(2 * (len(have) + i) for i in range(left)) < period:
            return None
        for x in range(have[-1] + 1, period):
            found = grow([*have, x], seen | {(x - y) % period for y in have} | {(y - x) % period for y in have}, most)
            if found:
                return found
        return None
    size = 1
    while True:
        found = grow([0], frozenset([0]), size)
        if found:
            return found
        size += 1


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _places(chunk: texts.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(words per row, position of every word in its row)."""
    n = chunk.count()
    first = np.concatenate(([0], np.cumsum(n)))
    return n, np.arange(len(chunk.hash)) - first[chunk.row]


def _anchors(chunk: texts.Chunk, place: np.ndarray, window: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of the anchors at cover positions."""
    h, inside = texts.window_hash(chunk.hash, chunk.row, window - period + 1)
    on = np.zeros(period, dtype=bool)
    on[list(cover(period))] = True
    at = np.flatnonzero(inside & on[place[:len(h)] % period])
    return at, h[at]


def _heads(batches, window: int, period: int):
    """id, th, text -> HEADS."""
    for batch in batches:
        for chunk in texts.chunks(batch.column("text")):
            chunk.words()
            n, place = _places(chunk)
            digests = []
            for seed in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
                own = np.zeros(chunk.rows, dtype=np.uint64)
                np.add.at(own, chunk.row, texts.mix(chunk.hash ^ texts.mix(place.astype(np.uint64) + np.uint64(seed))))
                digests.append(texts.mix(own ^ n.astype(np.uint64)))
            at, h = _anchors(chunk, place, window, period)
            keep = n[chunk.row[at]] >= window
            at, h = at[keep], h[keep]
            ends = np.concatenate(([0], np.cumsum(np.bincount(chunk.row[at], minlength=chunk.rows)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(chunk.first, chunk.rows), batch.column("th").slice(chunk.first, chunk.rows), pa.array(n.astype(np.int64)),
                 _long(digests[0]), _long(digests[1]), pa.ListArray.from_arrays(pa.array(ends), _long(h))],
                names=["id", "th", "n_words", "c1", "c2", "anchors"])


def _likely(batches, shared):
    """id, th, anchors -> k, id, th, nth of the anchors that the bitmap lets through."""
    for batch in batches:
        anchors = batch.column("anchors")
        ends, k = anchors.offsets.to_numpy(), anchors.values.to_numpy()
        at = np.flatnonzero(bitmaps.holds(shared.value, k[ends[0]:ends[-1]])) + ends[0]
        row = np.searchsorted(ends, at, side="right") - 1
        yield pa.RecordBatch.from_arrays([pa.array(k[at]), batch.column("id").take(pa.array(row)), batch.column("th").take(pa.array(row)),
                                          pa.array((at - ends[row]).astype(np.int32))], names=["k", "id", "th", "nth"])


def _windows(batches, window: int, period: int):
    """id, th, text, nths -> w1, w2, id, th, pos of the windows that hold one of these anchors."""
    for batch in batches:
        lists = batch.column("nths")
        for chunk in texts.chunks(batch.column("text")):
            chunk.words()
            _, place = _places(chunk)
            at, _ = _anchors(chunk, place, window, period)
            first = np.concatenate(([0], np.cumsum(np.bincount(chunk.row[at], minlength=chunk.rows))))
            total = len(chunk.hash)
            seen = np.zeros(total + 1, dtype=np.int64)
            for r in range(chunk.rows):
                seen[at[first[r] + lists[chunk.first + r].values.to_numpy()] + 1] = 1
            np.cumsum(seen, out=seen)
            start = np.arange(max(0, total - window + 1))
            # anchors that start in [start, start + period) end within the window
            start = start[(seen[start + period] > seen[start]) & (chunk.row[start] == chunk.row[start + window - 1])]
            digests = []
            for seed in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
                acc = np.full(len(start), seed, dtype=np.uint64)
                for j in range(window):
                    acc = (acc ^ chunk.hash[start + j]) * np.uint64(0xFF51AFD7ED558CCD)
                    acc ^= acc >> np.uint64(29)
                digests.append(texts.mix(acc))
            row = pa.array(chunk.row[start] + chunk.first)
            yield pa.RecordBatch.from_arrays(
                [_long(digests[0]), _long(digests[1]), batch.column("id").take(row), batch.column("th").take(row), pa.array(place[start].astype(np.int32))],
                names=["w1", "w2", "id", "th", "pos"])


def _through(batches, bitmap):
    """The rows whose k the bitmap lets through."""
    for batch in batches:
        yield from pa.Table.from_batches([batch]).filter(pa.array(bitmaps.holds(bitmap.value, batch.column("k").to_numpy()))).to_batches()


def marks(docs: DataFrame, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """id, th, whole, starts: of every row that loses words, whether it loses all, else the starts of the windows that it loses.

    id is doc_id, LAST for null; th is xxhash64(text). Rows that lose nothing are absent.
    """
    if not 1 <= period <= window:
        raise ValueError(f"a period of {period} does not fit into windows of {window} words")
    shelf = Shelf(docs.sparkSession, "substrings")
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64("text").alias("th"), "text")
    heads = shelf.put(rows.mapInArrow(lambda b: _heads(b, window, period), HEADS).where(F.col("n_words") >= window), "heads")
    firsts = shelf.put(heads.groupBy("c1", "c2").agg(F.min("id").alias("low")), "classes")
    known = heads.select("id", "th", "c1", "c2").join(firsts, ["c1", "c2"])
    copies = known.where("id > low").select("id", "th").distinct()
    shared = heads.select(F.explode("anchors").alias("k"), "c1").groupBy("k").agg(F.min("c1").alias("a"), F.max("c1").alias("b")).where("a <> b")
    shared = shelf.put(shared.select("k"), "shared")
    shared_bits = context.broadcast(bitmaps.fill(shared))
    # the first row of a class stands for it; the bitmaps spare most rows the exact joins that follow
    near = (heads.select("id", "th", "anchors").mapInArrow(lambda b: _likely(b, shared_bits), "k long, id long, th long, nth int").join(shared, "k")
            .groupBy("id", "th").agg(F.collect_set("nth").alias("nths")).join(known.where("id = low").select("id", "th").distinct(), ["id", "th"]))
    near = shelf.put(near, "near")
    near_bits = context.broadcast(bitmaps.fill(near.select(bitmaps.row_key("id", "th"))))
    open_ = rows.select("id", "th", "text", bitmaps.row_key("id", "th")).mapInArrow(lambda b: _through(b, near_bits), "id long, th long, text string, k long")
    found = shelf.put(open_.select("id", "th", "text").join(near, ["id", "th"]).mapInArrow(lambda b: _windows(b, window, period), "w1 long, w2 long, id long, th long, pos int"), "windows")
    # a table of its own, so that the join can split a window with very many rows
    least = shelf.put(found.groupBy("w1", "w2").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("w1", "w2", "low"), "least")
    starts = found.join(least, ["w1", "w2"]).where("id > low").groupBy("id", "th").agg(F.collect_set("pos").alias("starts"))
    starts = starts.select("id", "th", F.lit(False).alias("whole"), "starts")
    both = starts.union(copies.select("id", "th", F.lit(True), F.array().cast("array<int>")))
    out = shelf.put(both.groupBy("id", "th").agg(F.max("whole").alias("whole"), F.flatten(F.collect_list("starts")).alias("starts")), "marks")
    for used in (heads, firsts, shared, near, found, least):
        shelf.drop(used)
    return out


def _spans(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    starts = np.unique(starts)
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + window).tolist()))


def _joined(chunk: texts.Chunk, keep: np.ndarray) -> pa.Array:
    """The kept words of every row, one space between them, as array arithmetic over the bytes."""
    starts, ends, row = chunk.starts[keep], chunk.ends[keep], chunk.row[keep]
    size = ends - starts + 1                                            # a space follows every word
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.full(int(at[-1]), 0x20, dtype=np.uint8)
    inside = np.ones(len(out), dtype=bool)
    inside[at[1:] - 1] = False
    source = np.arange(len(out)) + np.repeat(starts - at[:-1], size)
    out[inside] = chunk.data[source[inside]]
    words = np.bincount(row, minlength=chunk.rows)
    stops = at[np.cumsum(words)]
    offsets = np.concatenate(([0], stops)).astype(np.int64)
    last = stops[words > 0] - 1                                         # the space after a row's last word goes
    gone = np.zeros(len(out) + 1, dtype=np.int64)
    gone[last + 1] = 1
    offsets -= np.cumsum(gone)[offsets]
    return pa.LargeStringArray.from_buffers(chunk.rows, pa.py_buffer(offsets), pa.py_buffer(np.delete(out, last)))


def _result(part, chunk: texts.Chunk, spans: list[list[tuple]], keep: np.ndarray):
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id").slice(chunk.first, chunk.rows), part.column("th").slice(chunk.first, chunk.rows), pa.array(chunk.count().astype(np.int64)),
         pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], SPANS), _joined(chunk, keep).cast(pa.string())],
        names=["doc_id", "th", "n_words", "spans", "kept"])


def _untouched(batches, affected):
    """Rows that surely lose nothing."""
    for batch in batches:
        own = pa.Table.from_batches([batch]).filter(pa.array(~bitmaps.holds(affected.value, batch.column("k").to_numpy()))).combine_chunks()
        for part in own.to_batches():
            for chunk in texts.chunks(part.column("text")):
                chunk.words()
                yield _result(part, chunk, [[]] * chunk.rows, np.ones(len(chunk.hash), dtype=bool))


def _cut(batches, window: int):
    """Rows with their marks, those without any included."""
    for batch in batches:
        whole = batch.column("whole").fill_null(False).to_numpy(zero_copy_only=False)
        starts = batch.column("starts")
        for chunk in texts.chunks(batch.column("text")):
            chunk.words()
            n = chunk.count()
            first = np.concatenate(([0], np.cumsum(n)))
            keep, spans = np.ones(len(chunk.hash), dtype=bool), []
            for r in range(chunk.rows):
                i = chunk.first + r
                marked = starts[i]
                if whole[i]:
                    spans.append([(0, int(n[r]))])
                elif marked.is_valid:
                    spans.append(_spans(marked.values.to_numpy(zero_copy_only=False), window))
                else:
                    spans.append([])
                for a, b in spans[-1]:
                    keep[first[r] + a:first[r] + b] = False
            yield _result(batch, chunk, spans, keep)


def scan(docs: DataFrame, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """Per row of docs: doc_id, th, n_words, spans of removed words (word positions, end exclusive), kept (the other words, one space between)."""
    found = marks(docs, window, period)
    affected = docs.sparkSession.sparkContext.broadcast(bitmaps.fill(found.select(bitmaps.row_key("id", "th"))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    rows = rows.select("*", F.coalesce("doc_id", F.lit(LAST)).alias("id")).select("*", bitmaps.row_key("id", "th"))
    clear = rows.select("doc_id", "th", "text", "k").mapInArrow(lambda b: _untouched(b, affected), RESULT)
    # only texts that may lose words are shuffled
    open_ = rows.select("doc_id", "th", "id", "k", "text").mapInArrow(lambda b: _through(b, affected), "doc_id long, th long, id long, k long, text string")
    cut = (open_.join(found, ["id", "th"], "left").select("doc_id", "th", "text", "whole", "starts")
           .mapInArrow(lambda b: _cut(b, window), RESULT))
    return clear.union(cut)


def remove(docs: DataFrame, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """docs whose texts keep only the words that no smaller document has in a window; texts that lose nothing stay as they are."""
    cut = scan(docs, window, period).where(F.size("spans") > 0).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("kept").alias("__kept")).distinct()
    own = docs["doc_id"].cast("long").eqNullSafe(cut["__id"]) & (F.xxhash64(docs["text"]) == cut["__th"])
    return docs.join(cut, own, "left").select(*[F.coalesce(cut["__kept"], docs["text"]).alias("text") if c == "text" else docs[c] for c in docs.columns])


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least AS (SELECT h, min(doc_id) AS low FROM starts GROUP BY h HAVING min(doc_id) < max(doc_id)),
cut AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM starts JOIN least USING (h) WHERE doc_id > low),
gone AS (SELECT doc_id, count(*) AS n FROM cut GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN cut USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op11_substring_dedup", SQL)
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
