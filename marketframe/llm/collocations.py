"""Phrase collocations by dynamic itemset counting.

Texts are lower-cased (A-Z), cut at punctuation and line ends into pieces and those at blanks into words; counts are per language, null
being `und`. Phrases of 2 to LONGEST words are counted together in cyclic scans of SHARDS shards: step t reads shard t modulo SHARDS.
Words are active from step 0. A longer phrase becomes active at the step after both its subphrases (without its last and without its
first word) have reached THRESHOLD, and is counted from then on for exactly SHARDS steps, one full cycle, so that its
count is exact. As a phrase never occurs more often than its subphrases, every phrase that reaches the threshold becomes active.
Scans end when no phrase is active; lengths overlap, so that most of the corpus is read about twice instead of once per length.

What has reached the threshold goes to the scans as one byte per hash slot: the step at which it did. Equal slots can only activate a
phrase early, which costs a row and changes no count, since its cycle then starts earlier too. The table has SLOTS bytes
whatever the corpus, and the driver gets at most SLOTS / 64 rows a step. All counts are tables in the shared folder. Tasks combine
their occurrences before the shuffle; rows are keyed by phrase, so a hot language is no hot key. While phrases are counted they are
two hashes of 112 bits together (64 within a task: one with 10 ** 7 distinct phrases meets an equal pair with a chance of about
3 in a million); a last scan gives those that reached the threshold their text.

Odd rows: null and empty texts have no words; repeated rows count each; a piece shorter than a phrase holds none; texts are worked on
whole; an empty table gives an empty result; further columns are ignored, so names may clash; ties are settled as ranked() states.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marketframe.llm import bitmaps, texts
from marketframe.llm.registry import query, table
from marketframe.llm.storage import Shelf, arrays

LONGEST = 4
THRESHOLD = 30
SHARDS = 2
#: one byte each: the step at which a phrase with this hash reached the threshold
SLOTS = 1 << 24
NEVER = 255
TOP = 2000
WHOLE = 80
SALTS = 64
#: the share 1 / NAMING of the texts is searched for the texts of phrases first
NAMING = 16
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, 0x09, *b".,;:!?", *range(0x0A, 0x0E)]] = False
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
COUNTED = "key long, tag long, n long"
NAMED = "key long, tag long, n long, lang string, phrase string"
LANGS = "lang string, key long"


class Counts:
    """Counts of phrases within a task by 64-bit hash, with the columns of the first one of each, merged as they come."""

    def __init__(self, names: list[str], most: int = 1_000_000):
        self.names, self.most, self.parts, self.waiting = names, most, [], 0

    def add(self, key: np.ndarray, n: np.ndarray, columns: list[pa.Array]):
        self.parts.append((key, n, pa.RecordBatch.from_arrays(columns, names=self.names)))
        self.waiting += len(key)
        if self.waiting > self.most:
            self._merge()
            if self.waiting > self.most // 2:
                yield from self.end()

    def _merge(self) -> None:
        key = np.concatenate([p[0] for p in self.parts])
        at, first, where = np.unique(key, return_index=True, return_inverse=True)
        n = np.bincount(where, weights=np.concatenate([p[1] for p in self.parts]), minlength=len(at)).astype(np.int64)
        rows = pa.Table.from_batches([p[2] for p in self.parts]).take(pa.array(first)).combine_chunks().to_batches()
        self.parts, self.waiting = [(at, n, b) for b in rows], len(at)

    def end(self):
        if self.waiting:
            self._merge()
            for key, n, rows in self.parts:
                full = pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), rows.column(0), pa.array(n), *rows.columns[1:]],
                                                  names=["key", self.names[0], "n", *self.names[1:]])
                for i in range(0, len(full), 50_000):
                    yield full.slice(i, 50_000)
        self.parts, self.waiting = [], 0


def _phrases(chunk: texts.Chunk, at: np.ndarray, size: int) -> pa.Array:
    """The words at..at + size - 1 of each entry, lower-cased, one space between."""
    word = (at[:, None] + np.arange(size)).reshape(-1)
    starts, length = chunk.starts[word], chunk.ends[word] - chunk.starts[word] + 1
    ends = np.cumsum(length)
    begin = ends - length
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, dtype=np.uint8)
    inside = np.ones(len(out), dtype=bool)
    inside[ends - 1] = False
    source = np.arange(len(out)) + np.repeat(starts - begin, length)
    out[inside] = texts.LOWER[chunk.data[source[inside]]]
    last = np.zeros(len(out), dtype=bool)
    last[ends[size - 1::size] - 1] = True                               # no space after a phrase
    offsets = np.concatenate(([0], ends[size - 1::size] - np.arange(1, len(at) + 1))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(out[~last])).cast(pa.string())


def _tags(chunk: texts.Chunk, pick: np.ndarray, seed: np.ndarray, size: int, when: np.ndarray) -> np.ndarray:
    """48 bits of a second hash, the step at which the phrase is active, and its size."""
    other = np.zeros(len(pick), dtype=np.uint64)
    for j in range(size):
        other = (other + chunk.hash[pick + j]) * np.uint64(0xD6E8FEB86659FD93)
    return (texts.mix(other + seed[pick]) & ~np.uint64(0xFFFF)) | (when[pick] << 3 | size).astype(np.uint64)


def _scan(batches, held, step: int, shards: int, longest: int):
    """lang, text -> COUNTED: the active phrases of this step, and in the first cycle the words of each language (tag 0)."""
    reached = np.frombuffer(zlib.decompress(held.value), dtype=np.uint8)
    counts = Counts(["tag"])
    for lang, seeds, code, chunk in _chunks(batches):
        for size, h, same, when, before, seed in _phrases_of(chunk, seeds, code, reached, longest):
            at = np.flatnonzero(same & (when <= step) & (step < when + shards))
            if len(at):
                key, first, where = np.unique(h[at], return_index=True, return_inverse=True)
                yield from counts.add(key, np.bincount(where), [pa.array(_tags(chunk, at[first], seed, size, when).view(np.int64))])
        if step < shards and len(chunk.hash):
            own, words = np.unique(code[chunk.first + chunk.row], return_counts=True)
            yield from counts.add(seeds[own], words, [pa.array(np.zeros(len(own), dtype=np.int64))])
    yield from counts.end()


def _names(batches, held, longest: int, wanted):
    """lang, text -> NAMED: what has reached the threshold, of the keys that the bitmap (all without one) lets through."""
    reached = np.frombuffer(zlib.decompress(held.value), dtype=np.uint8)
    counts = Counts(["tag", "lang", "phrase"], 300_000)
    for lang, seeds, code, chunk in _chunks(batches):
        for size, h, same, when, before, seed in _phrases_of(chunk, seeds, code, reached, longest):
            at = np.flatnonzero(before < NEVER)
            if wanted is not None:
                at = at[bitmaps.holds(wanted.value, h[at])]
            if len(at):
                key, first, where = np.unique(h[at], return_index=True, return_inverse=True)
                pick = at[first]
                yield from counts.add(key, np.bincount(where), [
                    pa.array(_tags(chunk, pick, seed, size, when).view(np.int64)), lang.take(pa.array(chunk.first + chunk.row[pick])), _phrases(chunk, pick, size)])
    yield from counts.end()


def _chunks(batches):
    """(languages of the batch, hash of each distinct one, which one each row has, chunk) of every chunk."""
    for batch in batches:
        lang = batch.column("lang")
        names = lang.dictionary_encode()
        seeds = np.array([hash_bytes(v) for v in names.dictionary.to_pylist()], dtype=np.uint64)
        code = names.indices.to_numpy()
        for chunk in texts.chunks(batch.column("text")):
            chunk.words(_WORD, lower=True)
            yield lang, seeds, code, chunk


def _phrases_of(chunk: texts.Chunk, seeds: np.ndarray, code: np.ndarray, reached: np.ndarray, longest: int):
    """For every size, of the phrase at each word: hash, whether it lies in one piece, the step at which it is active, and the one at which it reached the threshold."""
    broken = np.zeros(len(chunk.data) + 1, dtype=np.int64)
    np.cumsum(_BREAK[chunk.data], out=broken[1:])
    # words of one piece have as many breaks before them, and one row
    piece = broken[chunk.starts] + chunk.row
    seed = seeds[code[chunk.first + chunk.row]] if len(chunk.row) else np.zeros(0, dtype=np.uint64)
    when, before = np.zeros(len(chunk.hash), dtype=np.int64), None
    for size in range(1, longest + 1):
        if len(chunk.hash) < size:
            return
        h, _ = texts.window_hash(chunk.hash, chunk.row, size)
        h = texts.mix(h ^ seed[:len(h)] ^ np.uint64(size))
        same = piece[:len(h)] == piece[size - 1:]
        if size > 1:
            when = np.maximum(before[:-1], before[1:]) + 1
        at_slot = reached[(h & np.uint64(len(reached) - 1)).astype(np.int64)]
        # no phrase reaches the threshold before it is active, whatever else has its slot
        before = np.where(same & (when < NEVER), np.maximum(at_slot, when), NEVER)
        yield size, h, same, when, before, seed


def _seeds(batches):
    for batch in batches:
        names = batch.column("lang")
        key = np.array([hash_bytes(v) for v in names.to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([names, pa.array(key.view(np.int64))], names=["lang", "key"])


def hash_bytes(name: str) -> int:
    """A value of the whole name, the same in every process."""
    value = 0xCBF29CE484222325
    for b in name.encode():
        value = (value ^ b) * 0x100000001B3 % (1 << 64)
    return value


def _note(reached: np.ndarray, fresh: DataFrame, step: int) -> None:
    """Mark the slots of what reached the threshold at this step."""
    slot = F.col("key").bitwiseAND(F.lit(len(reached) - 1))
    found = arrays(fresh.select(F.shiftright(slot, 6).alias("w"), slot.bitwiseAND(F.lit(63)).cast("int").alias("b"))
                   .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")))
    bits = np.unpackbits(found["v"].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    at = found["w"][row] * 64 + bit
    reached[at] = np.minimum(reached[at], step)


def count(docs: DataFrame, longest: int = LONGEST, threshold: int = THRESHOLD, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(phrases: lang, size, phrase, n of all phrases of 1 to longest words with n >= threshold; totals: lang, n of all words)."""
    if longest * shards >= NEVER or longest > 7:
        raise ValueError(f"{longest} lengths in {shards} shards: at most 7 lengths and {NEVER - 1} steps")
    if slots < 64 or slots & (slots - 1):
        raise ValueError(f"slots are a power of two from 64, not {slots}")
    spark = docs.sparkSession
    shelf = Shelf(spark, "collocations")
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text <> ''")
    # a shard is a folder, so that a step reads its own part only
    root = shelf.put(source.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int")), "texts", by="shard")
    reached = np.full(slots, NEVER, dtype=np.uint8)
    size, closing = F.expr("tag & 7"), F.expr("((tag >> 3) & 8191)") + shards - 1
    open_, done, step, last = None, [], 0, shards - 1
    while step <= last:
        held = spark.sparkContext.broadcast(zlib.compress(reached, 1))
        part = root.where(F.col("shard") == step % shards).select("lang", "text")
        counted = part.mapInArrow(lambda b, h=held, t=step: _scan(b, h, t, shards, longest), COUNTED)
        counted = counted.withColumn("old", F.lit(0).cast("long"))
        if open_ is not None:
            counted = open_.where(closing >= step).select("key", "tag", "n", F.col("n").alias("old")).union(counted)
        now = shelf.put(counted.groupBy("key", "tag").agg(F.sum("n").alias("n"), F.sum("old").alias("old")), f"step-{step}")
        if step == shards - 1:
            totals = shelf.put(now.where("tag = 0").select("key", "n"), "words")
        fresh = (F.col("n") >= threshold) & (F.col("old") < threshold) & (size > 0)
        _note(reached, now.where(fresh), step)
        done.append(shelf.put(now.where((F.col("n") >= threshold) & (closing == step) & (size > 0)).drop("old"), f"done-{step}"))
        if open_ is not None:
            shelf.drop(open_)
        held.destroy()                                                  # the step is a table now
        open_ = now
        # active phrases end their cycle; what has reached the threshold may have extensions, active from the next step on
        ends = now.agg(F.max(closing), F.max(F.when(fresh & (size < longest), F.lit(step + shards)))).first()
        last = max(last, ends[0] or 0, ends[1] or 0)
        step += 1
    shelf.drop(open_)
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    # a phrase needs its text once: most have theirs in a part of the corpus, the others are looked up in the rest
    held = spark.sparkContext.broadcast(zlib.compress(reached, 1))
    part = F.pmod(F.shiftright(F.xxhash64("text"), 20), F.lit(NAMING)) == 0

    def named(rows: DataFrame, wanted, name: str) -> DataFrame:
        texts_ = rows.select("lang", "text").mapInArrow(lambda b: _names(b, held, longest, wanted), NAMED)
        own = F.struct("lang", "phrase")
        return shelf.put(texts_.groupBy("key", "tag").agg(F.min(own).alias("x"), F.max(own).alias("y")).select("key", "tag", "x.*", (F.col("x") == F.col("y")).alias("one")), name)
    names = named(root.where(part), None, "names")
    missing = shelf.put(found.join(names, ["key", "tag"], "left_anti").select(F.col("key").alias("k")), "missing")
    wanted = spark.sparkContext.broadcast(bitmaps.fill(missing))
    names = names.union(named(root.where(~part), wanted, "more-names").join(missing, F.col("key") == F.col("k"), "left_semi"))
    # two texts under one pair of hashes would be a collision; they are told apart or the job fails, never mixed
    checked = F.when(F.col("one"), F.col("phrase")).otherwise(F.raise_error(F.lit("two phrases have equal hashes")).cast("string"))
    phrases = shelf.put(found.join(names, ["key", "tag"]).select("lang", size.cast("int").alias("size"), checked.alias("phrase"), "n"), "phrases")
    langs = root.select("lang").distinct().mapInArrow(_seeds, LANGS)
    totals = shelf.put(totals.join(langs, "key").select("lang", "n"), "totals")
    held.destroy()
    wanted.destroy()
    shelf.drop(root)
    return phrases, totals


def scored(phrases: DataFrame, threshold: int = THRESHOLD, whole: int = WHOLE) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer candidate holds in whole percent of their occurrences.

    score is the least floor(2000000 a / (l + r)) over the cuts into a first part (l times) and the rest (r times), the earliest on ties.
    """
    words = F.split("phrase", " ")
    cands = phrases.where((F.col("size") > 1) & (F.col("n") >= threshold)).select("lang", "phrase", "size", F.col("n").alias("a"))
    parts = phrases.select(F.col("lang").alias("pl"), F.col("phrase").alias("pp"), "n")
    cuts = cands.select("lang", "phrase", "size", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.col("size")), " ").alias("rest"))
    for side, name in (("head", "l"), ("rest", "r")):
        cuts = cuts.join(parts, (F.col("lang") == F.col("pl")) & (F.col(side) == F.col("pp"))).withColumnRenamed("n", name).drop("pl", "pp", side)
    # decimals: 2000000 a may pass 64 bits
    score = F.expr("cast(floor(cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r)) as bigint)")
    best = (cuts.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r", "a")).alias("x")).select("lang", "phrase", "x.a", "x.l", "x.r", "x.score"))
    inner = cands.where("size > 2").select("lang", F.col("a").alias("b"), "size", words.alias("w")).select(
        "lang", "b", "w", "size", F.explode(F.expr("sequence(2, size - 1)")).alias("m")).select(
        "lang", "b", "w", "m", F.explode(F.expr("sequence(1, size - m + 1)")).alias("i")).select(
        F.col("lang").alias("pl"), F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("pp"), "b")
    inner = inner.groupBy("pl", "pp").agg(F.max("b").alias("b"))
    kept = best.join(inner, (F.col("lang") == F.col("pl")) & (F.col("phrase") == F.col("pp")), "left")
    hundred = lambda c: F.col(c).cast("decimal(20, 0)")
    return kept.where(F.col("b").isNull() | (hundred("b") * 100 < hundred("a") * whole)).select("lang", "phrase", "a", "l", "r", "score")


def ranked(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The first rows of each language by score and a descending, then phrase in byte order; rank from 1. Salted, so that no task ranks a language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt", "rank")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, longest: int = LONGEST, threshold: int = THRESHOLD, top: int = TOP, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    phrases, totals = count(docs, longest, threshold, shards, slots)
    totals = totals.select(F.col("lang").alias("pl"), "n")
    out = ranked(scored(phrases, threshold), top)
    return out.join(totals, F.col("lang") == F.col("pl")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, doc_id, p, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM
  (SELECT lang, doc_id, unnest(s) AS piece, unnest(range(len(s))) AS p FROM
    (SELECT lang, doc_id, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS s FROM documents))),
f AS (SELECT lang, m, w[i:i + m - 1] AS x, count(*) AS n FROM
  (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT lang, m, x, n AS a FROM f WHERE m > 1 AND n >= 30),
cuts AS (SELECT c.lang, c.x, c.a, k, l.n AS l, r.n AS r, CAST(2000000::HUGEINT * c.a // (l.n + r.n) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c JOIN f l ON l.lang = c.lang AND l.x = c.x[:k] JOIN f r ON r.lang = c.lang AND r.x = c.x[k + 1:]),
best AS (SELECT lang, x, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, k) = 1),
held AS (SELECT lang, x[i:i + s - 1] AS x, max(a) AS b FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM c)) GROUP BY ALL),
kept AS (SELECT b.lang, array_to_string(b.x, ' ') AS phrase, a, l, r, score FROM best b LEFT JOIN held h ON b.lang = h.lang AND b.x = h.x WHERE h.b IS NULL OR 100 * h.b < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""


@query("op13_phrase_collocations", SQL)
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
