"""Secret scans with DataFrame functions only.

Base patterns give the spans of assignments, access keys and hexadecimal strings. Two character Markov models, one of random
strings and one of ordinary identifiers, add spans: a run of CANDIDATE characters outside the base spans is a secret
when its log-likelihood ratio reaches RATIO. Both models are bigram tables over ALPHABET with add-one smoothing, counted by Spark
from labelled samples: values that base patterns find, and strings of hash digits in three alphabets, are random; words of
documents outside base matches are ordinary. The sample has at most SAMPLE documents (those with the smallest hash of
their id and text, a documented bound on labelled rows) and GENERATED random strings, so the tables are bounded by the alphabet and
travel as one constant. The scan covers all rows and whole texts, and shuffles nothing.

Positions are code points, ends exclusive. They come from splitting a text by the pattern: what lies between matches, and the
matches, have lengths. Null and empty texts have no spans; repeated rows are scanned each; an empty table gives no rows; other
columns are kept by redact() and ignored by find().
"""
from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketframe.llm.registry import query, table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: longest runs: a shorter run matches nowhere inside a longer one, so the least lengths can stand in the pattern
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
VALUE_LEAST = 8
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: log-likelihood ratio in nats from which a run counts as random
RATIO = 12.0
SAMPLE, GENERATED = 2_000, 3_000
KINDS = ("assign", "access", "hex", "random")
SPAN = "array<struct<start:int,rank:int,end:int>>"


#: elements folded at a time: an array that grows by one element per step is copied at every step, so it grows in pieces
PIECE = 64


def _folded(items: Column, at: Column, kind: str, step) -> Column:
    """Fold with a state and an output array, in time linear in the items: step(at, item) -> (at, array of what to add)."""
    empty = F.array().cast(f"array<{kind}>")

    def one(s: Column, x: Column) -> Column:
        now, more = step(s["at"], x)
        return F.struct(now.alias("at"), F.concat(s["out"], more).alias("out"))

    def piece(s: Column, p: Column) -> Column:
        inner = F.aggregate(p, F.struct(s["at"].alias("at"), empty.alias("out")), one)
        # through an array of one, so that the inner fold is computed once and used twice
        return F.aggregate(F.array(inner), s, lambda t, i: F.struct(i["at"].alias("at"), F.concat(t["out"], F.array(i["out"])).alias("out")))
    start = F.struct(at.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))

    def whole(own: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / PIECE).cast("int"))
        return F.aggregate(places, start, lambda s, c: piece(s, F.slice(own, c * PIECE + 1, PIECE)), lambda s: F.flatten(s["out"]))
    # again through an array of one: the items are computed once, not once a piece
    return F.element_at(F.transform(F.array(items), lambda own: F.when(F.size(own) > 0, whole(own)).otherwise(empty)), 1)


FOUND = "struct<start:int,end:int,m:string>"


def _matches(text: Column, pattern: str, good=None) -> Column:
    """(start, end, match) of the leftmost non-overlapping matches; good: a condition on (match, group 2 of it)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if good else found
    gaps = F.split(text, pattern, -1)
    parts = F.arrays_zip(found.alias("m"), value.alias("v"), F.slice(gaps, 1, F.greatest(F.size(found), F.lit(1))).alias("g"))

    def step(at: Column, p: Column):
        begin = at + F.length(p["g"])
        end = begin + F.length(p["m"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end"), p["m"].alias("m")))
        return end, F.when(good(p["m"], p["v"]), span).otherwise(F.array().cast(f"array<{FOUND}>")) if good else span
    # most texts match nowhere; they pay for one search only
    return F.when(F.regexp_like(text, F.lit(pattern)), _folded(parts, F.lit(0), FOUND, step)).otherwise(F.array().cast(f"array<{FOUND}>"))


def _spans(matches: Column, rank: int) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"))).cast(SPAN)


def _runs(text: Column, pattern: str, rank: int, good=None) -> Column:
    return _spans(_matches(text, pattern, good), rank)


def base_spans(text: Column) -> Column:
    """All base spans (start, rank in KINDS, end), ordered by start and rank."""
    return F.array_sort(F.concat(_runs(text, ASSIGN, 0, lambda m, v: F.length(v) >= VALUE_LEAST), _runs(text, ACCESS, 1), _runs(text, HEX, 2)))


class RandomStrings:
    """The log-likelihood ratio of character pairs, random strings against ordinary identifiers."""

    def __init__(self, ratio: list[float]):
        self.ratio = ratio

    def score(self, run: Column) -> Column:
        width = len(ALPHABET) + 1
        # a constant: folded once, not built per row
        ratios = F.from_json(F.lit(json.dumps([round(x, 6) for x in self.ratio])), "array<double>")
        start = F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum"))

        def step(s: Column, c: Column) -> Column:
            place = F.instr(F.lit(ALPHABET), c)
            return F.struct(place.alias("before"), (s["sum"] + F.when(s["before"] < 0, F.lit(0.0)).otherwise(F.get(ratios, s["before"] * width + place))).alias("sum"))
        # one pass over the characters of the run
        return F.aggregate(F.split(run, ""), start, step, lambda s: s["sum"])


def _free(matches: Column, base: Column) -> Column:
    """The matches that overlap no base span: both in one order, and the furthest end of the base spans that begin before a match ends."""
    event = "array<struct<key:int,order:int,start:int,end:int,m:string>>"
    of_base = F.transform(base, lambda b: F.struct(b["start"].alias("key"), F.lit(1).alias("order"), b["start"].alias("start"), b["end"].alias("end"), F.lit(None).cast("string").alias("m"))).cast(event)
    of_match = F.transform(matches, lambda m: F.struct(m["end"].alias("key"), F.lit(0).alias("order"), m["start"].alias("start"), m["end"].alias("end"), m["m"].alias("m"))).cast(event)
    none = F.array().cast(f"array<{FOUND}>")

    def step(reach: Column, e: Column):
        kept = F.array(F.struct(e["start"].alias("start"), e["end"].alias("end"), e["m"].alias("m")))
        return F.when(e["order"] == 1, F.greatest(reach, e["end"])).otherwise(reach), F.when((e["order"] == 0) & (reach <= e["start"]), kept).otherwise(none)
    return F.when((F.size(base) > 0) & (F.size(matches) > 0), _folded(F.array_sort(F.concat(of_base, of_match)), F.lit(0), FOUND, step)).otherwise(matches)


def labelled(docs: DataFrame, sample: int = SAMPLE, generated: int = GENERATED) -> DataFrame:
    """(value, random): strings of both classes, each once."""
    # the sample is chosen by keys alone; its rows are then found by a broadcast of at most `sample` keys
    keyed = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("__key"))
    chosen = keyed.select("__key").distinct().orderBy("__key").limit(sample)
    some = keyed.join(F.broadcast(chosen), "__key")
    assigned = F.transform(F.filter(F.arrays_zip(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)).alias("v")), lambda p: F.length(p["v"]) >= VALUE_LEAST),
                           lambda p: p["v"])
    known = F.concat(assigned, F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    positive = some.select(F.explode(known).alias("value"), F.lit(1).alias("random"))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", F.lit(ASSIGN), F.lit(" ")), F.lit(ACCESS), F.lit(" ")), F.lit(HEX), F.lit(" "))
    words = F.regexp_extract_all(rest, F.lit(r"[A-Za-z][A-Za-z0-9_-]{4,}"), F.lit(0))
    negative = some.select(F.explode(words).alias("value"), F.lit(0).alias("random"))
    digest = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256)
    strings = F.array(F.regexp_replace(F.base64(F.unhex(digest)), "=+$", ""), F.substring(digest, 1, 40),
                      F.translate(F.upper(F.substring(F.sha2(digest, 256), 1, 32)), "0123456789ABCDEF", "G7KQZX2MVB4TJ9WP"))
    made = docs.sparkSession.range(generated).select(F.explode(strings).alias("value"), F.lit(1).alias("random"))
    return positive.union(negative).union(made).distinct()


def fit(docs: DataFrame, sample: int = SAMPLE, generated: int = GENERATED) -> RandomStrings:
    """Count character pairs of both classes; the result has one number per pair of the alphabet."""
    rows = labelled(docs, sample, generated)
    pairs = F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring("value", i, F.lit(2)))
    counts = rows.where(F.length("value") > 1).select("random", F.explode(pairs).alias("pair")).groupBy("pair").agg(
        F.sum("random").alias("r"), F.sum(1 - F.col("random")).alias("o")).collect()
    width = len(ALPHABET) + 1
    table_of = [[1.0] * (width * width), [1.0] * (width * width)]
    for row in counts:
        a, b = ALPHABET.find(row["pair"][0]) + 1, ALPHABET.find(row["pair"][1]) + 1
        table_of[0][a * width + b] += row["r"]
        table_of[1][a * width + b] += row["o"]
    ratio = []
    for a in range(width):
        r, o = (t[a * width:(a + 1) * width] for t in table_of)
        ratio += [math.log(x / sum(r)) - math.log(y / sum(o)) for x, y in zip(r, o)]
    return RandomStrings(ratio)


def find(docs: DataFrame, model: RandomStrings) -> DataFrame:
    """doc_id, text, base, spans: base spans, and all spans, of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("base", base_spans(F.col("text")))
    # columns of their own, so that later expressions refer to them instead of repeating them
    rows = rows.withColumn("__runs", _matches(F.col("text"), CANDIDATE)).withColumn("__free", _free(F.col("__runs"), F.col("base")))
    random = _spans(F.filter("__free", lambda r: model.score(r["m"]) >= RATIO), 3)
    return rows.withColumn("spans", F.array_sort(F.concat("base", random))).drop("__runs", "__free")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: RandomStrings, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of text replaced by mark (overlapping spans by one), all other columns as they are."""
    text = F.coalesce("text", F.lit(""))
    base = base_spans(text)
    random = _spans(F.filter(_matches(text, CANDIDATE), lambda r: model.score(r["m"]) >= RATIO), 3)
    spans = F.array_sort(F.concat(base, random))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, p: Column) -> Column:
        fresh = p["start"] >= s["at"]
        gap = F.substring(text, s["at"] + 1, p["start"] - s["at"])
        return F.struct(F.greatest(s["at"], p["end"]).alias("at"), F.when(fresh, F.concat(s["out"], gap, F.lit(mark))).otherwise(s["out"]).alias("out"))
    clean = F.aggregate(F.col("__spans"), state, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    marked = docs.withColumn("__spans", spans)
    return marked.withColumn("text", F.when(F.size("__spans") > 0, clean).otherwise(F.col("text"))).drop("__spans")


@query("op3_secret_scan")
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find(docs, fit(docs))
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), count(3).alias("n_random"))
