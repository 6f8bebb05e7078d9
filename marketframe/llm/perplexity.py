"""Quality rules with n-gram perplexity.

The model is a modified Kneser-Ney model over the last ORDER bytes of a text and its language. Spark counts the n-grams of every
document that passes the base rules with few symbols (the trusted ones; no document is sampled), derives continuation counts
order by order, and joins the orders from the shortest up into tables of probabilities and back-off weights of all n-grams. Workers hold
the most frequent n-grams, at most SLOTS per order whatever the corpus, as arrays sorted by hash and searched through an index of leading bits. Where
these are not all, the n-grams of a text that are not held are looked up in the tables by shuffle joins, each distinct one once, so the result
does not depend on SLOTS. A document's perplexity is per byte. Each language gets a lower and an upper band around the median of
its trusted documents, from exact histograms; documents outside are rejected, e.g. symbol noise above and droning
repetition below. A mean over n bytes strays as 1 / sqrt(n), so deviations from the median count times sqrt(n), and the bands of a
document follow its own length; each side is measured by the quartile of its own side.

Base rules (see features()): words are runs without white space; fewer than LEAST_WORDS words, or more than half of the words in
repeated three-word windows, fail.

Nulls and empty texts have no words and fail; a null language is one of its own; repeated rows are scored each; ids are only
carried along; other columns are ignored; an empty table gives no rows; a language without trusted documents has the bands of all
trusted documents (its model has no n-grams, so every byte has the chance 1 / 257); without any trusted document there are no bands.
"""
from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketframe.llm import texts
from marketframe.llm.hasharrays import HashArray, Tally
from marketframe.llm.registry import query, table
from marketframe.llm.storage import Shelf, arrays

ORDER = 5
SLOTS = 1 << 21
LEAST_WORDS, REPEAT_SHARE = 50, 50
#: a trusted document has at most this many symbols per 1000 code points of words
SYMBOLS = 10
#: bands reach this many spreads beyond the quartiles of log perplexity, in steps of 1 / STEPS; a side's spread is the way from
#: the median to its quartile at the document's length, LEAST_SPREAD at least
REACH, STEPS = 10.0, 1000
LEAST_SPREAD = 0.01
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: bits of an n-gram, above which stand 16 bits of the language
BODY = 8 * ORDER
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, trusted boolean"
SCORED = f"rid long, doc_id long, lang string, {FEATURES}, n long, log_sum double, open array<long>, times array<long>"


def features(chunk: texts.Chunk) -> dict[str, np.ndarray]:
    """Base numbers of every row of a chunk."""
    chunk.words()
    rows, data = chunk.rows, chunk.data
    points = chunk.code_points()
    n_words = chunk.count()
    out = {"n_words": n_words, "word_chars": texts.row_sums(chunk.row, points[chunk.ends] - points[chunk.starts], rows).astype(np.int64)}
    marks = np.flatnonzero(SYMBOL[data])
    out["n_symbols"] = np.bincount(np.searchsorted(chunk.offsets, marks, side="right") - 1, minlength=rows)
    # lines: between line feeds and row edges
    feeds = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([chunk.offsets[:-1], feeds + 1]))
    starts = starts[starts < len(data)]
    ends = np.minimum(np.append(starts[1:], len(data)), len(data))
    ends = ends - ((data[ends - 1] == 10) if len(ends) else 0)
    worded = np.searchsorted(chunk.starts, ends) > np.searchsorted(chunk.starts, starts)
    starts, ends = starts[worded], ends[worded]
    row = np.searchsorted(chunk.offsets, starts, side="right") - 1
    distinct, _, _ = texts.distinct_per_row(row, chunk.span_hash(starts, ends))
    out["n_dup_lines"] = np.bincount(row, minlength=rows) - np.bincount(distinct, minlength=rows)
    # words inside a three-word window that occurs again
    h, within = texts.window_hash(chunk.hash, chunk.row, 3)
    at = np.flatnonzero(within)
    order = at[np.lexsort((h[at], chunk.row[at]))]
    same = np.zeros(len(order), dtype=bool)
    if len(order) > 1:
        pair = (h[order[1:]] == h[order[:-1]]) & (chunk.row[order[1:]] == chunk.row[order[:-1]])
        same[1:] |= pair
        same[:-1] |= pair
    hit = np.zeros(len(chunk.hash), dtype=bool)
    for j in range(3):
        hit[order[same] + j] = True
    out["n_repeat_words"] = np.bincount(chunk.row[hit], minlength=rows)
    out["failed"] = (n_words < LEAST_WORDS) | (100 * out["n_repeat_words"] > REPEAT_SHARE * n_words)
    out["trusted"] = ~out["failed"] & (1000 * out["n_symbols"] <= SYMBOLS * out["word_chars"])
    return out


def grams(chunk: texts.Chunk, language: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram) of every byte and the end of each row: ORDER bytes in the low bits, the language above; zeros pad the front."""
    length = np.diff(chunk.offsets)
    rows = np.arange(chunk.rows)
    source = chunk.data
    if keep is not None:
        source = source[np.repeat(keep, length)]
        rows, length = rows[keep], length[keep]
    room = length + ORDER
    base = np.concatenate(([0], np.cumsum(room)))
    padded = np.zeros(base[-1], dtype=np.uint64)
    ends = np.concatenate(([0], np.cumsum(length)))
    padded[np.arange(len(source)) + np.repeat(base[:-1] + ORDER - 1 - ends[:-1], length)] = source
    g = np.zeros(max(len(padded) - ORDER + 1, 0), dtype=np.uint64)
    for j in range(ORDER):
        g = (g << np.uint64(8)) | padded[j:j + len(g)]
    owner = np.repeat(np.arange(len(rows)), room)[ORDER - 1:]
    # windows that start in one row and end in the next are dropped
    place = np.arange(len(g)) + ORDER - 1 - base[owner]
    good = place >= ORDER - 1
    owner = rows[owner[good]] if len(rows) else owner[:0]
    return owner, g[good] | (language[owner].astype(np.uint64) << np.uint64(BODY))


def _languages(batch) -> np.ndarray:
    return batch.column("l").to_numpy(zero_copy_only=False).astype(np.int64)


def _count(batches):
    tally = Tally(("g", "c"))
    for batch in batches:
        language = _languages(batch)
        for chunk in texts.chunks(batch.column("text")):
            keep = features(chunk)["trusted"]
            _, g = grams(chunk, language[chunk.first:chunk.first + chunk.rows], keep)
            yield from tally.add(*np.unique(g, return_counts=True))
    yield from tally.end()


class KneserNey:
    """Log probabilities and back-off weights of the n-grams that workers hold, in hash arrays; log10."""

    def __init__(self, orders: Iterable[dict[str, np.ndarray]], whole: int = ORDER):
        """orders, from 1 up: g, p and b (log10 of the probability, and of the context's weight). whole: orders up to this hold all n-grams."""
        self.seen: list[HashArray] = []
        self.back: list[HashArray] = []
        for k, rows in enumerate(orders, 1):
            key = rows["g"].view(np.uint64)
            self.seen.append(HashArray(key, rows["p"].astype(np.float32)))
            one, first = np.unique(self._context(key, k), return_index=True)
            self.back.append(HashArray(one, rows["b"][first].astype(np.float32)))
        self.orders, self.whole = len(self.seen), whole

    @staticmethod
    def _body(key: np.ndarray, k: int) -> np.ndarray:
        """The last k bytes, and the language."""
        return (key & np.uint64((1 << 8 * k) - 1)) | ((key >> np.uint64(BODY)) << np.uint64(BODY))

    @classmethod
    def _context(cls, key: np.ndarray, k: int) -> np.ndarray:
        """The k - 1 bytes before the last one, and the language."""
        return ((key & np.uint64((1 << 8 * k) - 1)) >> np.uint64(8)) | ((key >> np.uint64(BODY)) << np.uint64(BODY))

    def log_prob(self, key: np.ndarray, most: int | None = None) -> np.ndarray:
        """log10 P of the last byte of each n-gram given the bytes before it, by what is held of the orders up to most."""
        most = self.orders if most is None else most
        out = np.zeros(len(key))
        open_ = np.arange(len(key))
        for k in range(most, 0, -1):
            own = key[open_]
            at = self.seen[k - 1].find(self._body(own, k))
            hit = at >= 0
            out[open_[hit]] += self.seen[k - 1].values[0][at[hit]]
            open_, own = open_[~hit], own[~hit]
            if not len(open_):
                return out
            at = self.back[k - 1].find(self._context(own, k))
            known = at >= 0
            out[open_[known]] += self.back[k - 1].values[0][at[known]]
        out[open_] += np.log10(1 / 257)
        return out

    def certain(self, key: np.ndarray) -> np.ndarray:
        """Of which n-grams log_prob() knows the whole answer: all, or those that are held where others are not."""
        return np.ones(len(key), dtype=bool) if self.whole == self.orders else self.seen[-1].find(key) >= 0


def _language() -> Column:
    return F.shiftright("g", BODY)


def _last(k: int) -> Column:
    """The last k bytes of g, and the language."""
    return F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1)).bitwiseOR(F.shiftleft(_language(), BODY))


def _before(k: int) -> Column:
    """The k - 1 bytes before the last one of g, and the language."""
    return F.shiftright(F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1)), 8).bitwiseOR(F.shiftleft(_language(), BODY))


def tables(docs: DataFrame, shelf: Shelf) -> list[DataFrame]:
    """docs: text, l. Per order, from 1 up: g, c, and p and b (see KneserNey) of every n-gram of the trusted documents."""
    spark = docs.sparkSession
    counts = [shelf.put(docs.select("text", "l").mapInArrow(_count, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")), "counts")]
    for k in range(ORDER - 1, 0, -1):
        counts.insert(0, shelf.put(counts[0].groupBy(_last(k).alias("g")).agg(F.count("*").alias("c")), f"counts-{k}"))
    of = [rows.groupBy(F.lit(k).alias("k"), _language().alias("cl")).agg(*[F.sum((F.col("c") == n).cast("long")).alias(f"t{n}") for n in (1, 2, 3, 4)])
          for k, rows in enumerate(counts, 1)]
    discounts = [(r["k"], r["cl"], *_discounts(*(r[f"t{n}"] for n in (1, 2, 3, 4)))) for r in reduce(DataFrame.union, of).collect()]
    off = spark.createDataFrame(discounts, "k int, cl long, d1 double, d2 double, d3 double")
    out: list[DataFrame] = []
    for k, rows in enumerate(counts, 1):
        stats = rows.groupBy(_before(k).alias("cg")).agg(
            F.sum("c").alias("s"), *[F.sum((F.col("c") == n).cast("long")).alias(f"n{n}") for n in (1, 2)], F.sum((F.col("c") > 2).cast("long")).alias("n3"))
        weighed = stats.withColumn("cl", F.shiftright("cg", BODY)).join(off.where(F.col("k") == k), "cl").withColumn(
            "gamma", (F.expr("d1 * n1 + d2 * n2 + d3 * n3")) / F.col("s")).select("cg", "s", "gamma", "d1", "d2", "d3")
        joined = rows.withColumn("cg", _before(k)).join(weighed, "cg").withColumn("own", F.expr("greatest(c - CASE c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END, 0) / s"))
        if out:
            below = out[-1].select(F.col("g").alias("cut"), F.pow(F.lit(10.0), "p").alias("below"))
            joined = joined.withColumn("cut", _last(k - 1)).join(below, "cut")
        else:
            joined = joined.withColumn("below", F.lit(1 / 257))
        out.append(shelf.put(joined.select("g", "c", F.log10(F.greatest(F.expr("own + gamma * below"), F.lit(1e-12))).alias("p"),
                                           F.log10(F.greatest(F.least("gamma", F.lit(1.0)), F.lit(1e-6))).alias("b")), f"order-{k}"))
    for rows in counts:
        shelf.drop(rows)
    return out


def held(orders: list[DataFrame], slots: int = SLOTS) -> KneserNey:
    """What workers hold: all n-grams of the orders that have at most slots, the most frequent ones of the others."""
    least = []
    for df in orders:
        levels = [(r[0], r[1]) for r in df.groupBy("c").count().orderBy(F.desc("c")).collect()]
        total = np.cumsum([n for _, n in levels])
        fits = int(np.searchsorted(total, slots, side="right"))
        # the counts of what is held, 0 where that is everything
        least.append(0 if fits == len(levels) else levels[fits - 1][0] if fits else levels[0][0] + 1)
    whole = next((k for k, c in enumerate(least) if c), len(least))
    return KneserNey((arrays(df.where(F.col("c") >= c).select("g", "p", "b")) for df, c in zip(orders, least)), whole)


def fit(docs: DataFrame, slots: int = SLOTS) -> KneserNey:
    """docs: text, l. The held part of the model of all trusted documents."""
    shelf = Shelf(docs.sparkSession, "kneser-ney")
    orders = tables(docs, shelf)
    model = held(orders, slots)
    for df in orders:
        shelf.drop(df)
    return model


def looked_up(open_: DataFrame, orders: list[DataFrame], model) -> DataFrame:
    """open_: distinct n-grams g. g and its log10 probability v by joins with the orders that are not held whole, the rest by what is held."""
    whole = model.value.whole
    rows = open_.select("g", F.lit(0.0).alias("v"), F.lit(False).alias("done"))
    for k in range(len(orders), whole, -1):
        seen = orders[k - 1].select(F.col("g").alias("sg"), "p")
        back = orders[k - 1].groupBy(_before(k).alias("bg")).agg(F.any_value("b").alias("b"))
        rows = (rows.withColumn("sg", _last(k)).withColumn("bg", _before(k)).join(seen, "sg", "left").join(back, "bg", "left")
                .select("g", (F.col("v") + F.when(F.col("done"), 0.0).otherwise(F.coalesce("p", "b", F.lit(0.0)))).alias("v"), (F.col("done") | F.col("p").isNotNull()).alias("done")))

    def finish(batches):
        for batch in batches:
            v, done = batch.column("v").to_numpy(), batch.column("done").to_numpy(zero_copy_only=False)
            more = model.value.log_prob(batch.column("g").to_numpy().view(np.uint64), whole)
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(v + np.where(done, 0.0, more))], names=["g", "v"])
    return rows.mapInArrow(finish, "g long, v double")


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from counts of counts; the middle of their ranges where these are empty."""
    if not n1 or not n2 or not n3:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(float(np.clip(d, 0.05, i + 0.95)) for i, d in enumerate(raw))


def _score(batches, broadcast):
    names = [x.split()[0] for x in FEATURES.split(", ")]
    for batch in batches:
        model, language = broadcast.value, _languages(batch)
        parts, opens = [], []
        for chunk in texts.chunks(batch.column("text")):
            f = features(chunk)
            row, g = grams(chunk, language[chunk.first:chunk.first + chunk.rows])
            sure = model.certain(g)
            f["n"] = np.diff(chunk.offsets) + 1
            f["log_sum"] = texts.row_sums(row[sure], model.log_prob(g[sure]), chunk.rows)
            at, key, times = texts.distinct_per_row(row[~sure], g[~sure])
            f["n_open"] = np.bincount(at, minlength=chunk.rows)
            parts.append(f)
            opens.append((key, times))
        if parts:
            whole = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            key, times = (np.concatenate(x) for x in zip(*opens))
            ends = pa.array(np.concatenate(([0], np.cumsum(whole["n_open"]))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.uint64).view(np.int64))) for x in (key, times)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id").cast(pa.int64()), batch.column("lang")] + [pa.array(whole[k]) for k in [*names, "n", "log_sum"]] + lists,
                names=["rid", "doc_id", "lang", *names, "n", "log_sum", "open", "times"])


def with_language(docs: DataFrame) -> DataFrame:
    """doc_id, lang, l (16 bits of the language), text."""
    lang = F.coalesce("lang", F.lit(""))
    return docs.select("doc_id", lang.alias("lang"), F.xxhash64(lang).bitwiseAND(F.lit(0xFFFF)).cast("long").alias("l"), "text")


def _quantiles(values: DataFrame, value: Column, **parts: float) -> DataFrame:
    """_lang and one column per part: exact quantiles of a value, in steps of 1 / STEPS, of each language and (_lang null) of all rows."""
    bins = values.groupBy("lang", F.round(value * STEPS).cast("long").alias("bin")).count()
    both = bins.select(F.explode(F.array("lang", F.lit(None).cast("string"))).alias("_lang"), "bin", "count").groupBy("_lang", "bin").agg(F.sum("count").alias("count"))
    # one row per language: an array of its bins, bounded by the range of the value
    hist = both.groupBy("_lang").agg(F.array_sort(F.collect_list(F.struct("bin", "count"))).alias("h"), F.sum("count").alias("m"))

    def quantile(q: float):
        state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("b"))
        return F.aggregate("h", state, lambda s, x: F.struct((s["n"] + x["count"]).alias("n"),
                           F.coalesce(s["b"], F.when(s["n"] + x["count"] >= F.col("m") * q, x["bin"])).alias("b")), lambda s: s["b"] / F.lit(float(STEPS)))
    return hist.select("_lang", *[quantile(q).alias(name) for name, q in parts.items()])


def bands(scored: DataFrame, shelf: Shelf) -> DataFrame:
    """_lang, middle, below, above: per language, and with a null _lang for all, the median of the trusted log perplexities and the
    spreads of both sides, times sqrt(bytes)."""
    trusted = scored.where("trusted").select("lang", "log_ppl", "n")
    # written, so that Spark sees how small it is and does not deal documents by language
    middle = shelf.put(_quantiles(trusted, F.col("log_ppl"), middle=0.5), "middle")
    strays = trusted.join(middle, F.col("lang") == F.col("_lang")).select("lang", ((F.col("log_ppl") - F.col("middle")) * F.sqrt("n")).alias("stray"))
    # asinh: steps of 1 / STEPS near the median, in proportion far from it, so that long documents make no more bins
    sides = _quantiles(strays, F.asinh("stray"), below=0.25, above=0.75).withColumnRenamed("_lang", "_of")
    return middle.join(sides, F.col("_lang").eqNullSafe(F.col("_of"))).select("_lang", "middle", (-F.sinh("below")).alias("below"), F.sinh("above").alias("above"))


def judge(docs: DataFrame, slots: int = SLOTS, reach: float = REACH) -> DataFrame:
    """Every row with its features, log perplexity, the bands of its language and the verdict."""
    rows = with_language(docs)
    shelf = Shelf(docs.sparkSession, "perplexity")
    orders = tables(rows, shelf)
    model = rows.sparkSession.sparkContext.broadcast(held(orders, slots))
    # row numbers become stable by being written
    first = shelf.put(rows.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(lambda b: _score(b, model), SCORED), "first")
    log_sum = F.col("log_sum")
    whole = first.drop("open", "times")
    if model.value.whole < len(orders):
        open_ = first.select("rid", F.explode(F.arrays_zip("open", "times")).alias("o")).select("rid", F.col("o.open").alias("g"), F.col("o.times").alias("m"))
        more = open_.join(looked_up(open_.select("g").distinct(), orders, model), "g").groupBy("rid").agg(F.sum(F.col("m") * F.col("v")).alias("more"))
        whole, log_sum = whole.join(more, "rid", "left"), F.col("log_sum") + F.coalesce("more", F.lit(0.0))
    scored = shelf.put(whole.withColumn("log_ppl", -log_sum / F.col("n") * float(np.log(10)))
                       .select("doc_id", "lang", *[x.split()[0] for x in FEATURES.split(", ")], "n", "log_ppl"), "scored")
    for used in (first, *orders):
        shelf.drop(used)
    limit = shelf.put(bands(scored, shelf), "bands")
    of_all = limit.where("_lang IS NULL").first()
    middle, below, above = (F.coalesce(name, F.lit(of_all[name] if of_all else None).cast("double")) for name in ("middle", "below", "above"))
    far = lambda side: (1 + reach) * F.greatest(side / F.sqrt("n"), F.lit(LEAST_SPREAD))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(True))
    return (scored.join(limit, F.col("lang") == F.col("_lang"), "left").withColumn("low", middle - far(below)).withColumn("high", middle + far(above))
            .drop("middle", "below", "above").withColumn("base_failed", failed).withColumn("kept", ~failed & inside))


@query("op1_kneser_ney_quality")
def op1_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.exp("log_ppl").alias("perplexity"))
