"""Toxicity by maximum-scoring segments.

Every token has a log-odds score between toxic and clean labelled documents under an informative Dirichlet prior (the
background rate of the token, weighted by PRIOR tokens, at most PRIOR_SHARE of all). Counts are of distinct preceding words, so that copies, near copies
and shared passages count once. Tokens whose log-odds stand out (z >= Z_LEAST) score their log-odds, all others
score the log-odds of an unremarkable token, which is negative, so that maximal segments of the score sequence are passages.
All maximal segments are found by one linear scan over cumulative sums, which only has to stop at positive tokens. A segment
with score S in a text of n tokens has E = K n exp(-lambda S) expected rivals by chance (lambda solves
sum p(s) exp(lambda s) = 1 over the clean scores, K is the rate of positive tokens there); -log of its probability of arising by
chance, summed over significant segments, is the evidence that a logistic curve maps to [0, 1].

Tokens are words of letters, digits and non-ASCII characters with A-Z lower-cased; a token's features are the word and its
first four and five bytes, and the best of them counts, so that inflected forms share evidence.

Fitting takes at most LABELLED labelled rows (those with the smallest hashes of their id, a documented bound); exact copies
among them count once. Scoring covers all rows and whole texts. Null or empty texts have no tokens and get the score of no
evidence; null ids and labels are never used for fitting; of several labels of one id the largest counts; without any labelled
row (or without both classes) no token scores. Columns of the input other than doc_id and text are ignored, so names may clash.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from marketframe.llm import texts
from marketframe.llm.registry import query, table
from marketframe.llm.storage import arrays

LABELLED = 8_000
PRIOR, PRIOR_SHARE = 20_000.0, 0.05
Z_LEAST = 3.0
#: a segment counts when its probability of arising by chance is below this
SIGNIFICANT = 0.01
EVIDENCE_BINS, EVIDENCE_MOST = 200, 50.0
PREFIXES = (4, 5)
OUT = ("doc_id long, score double, evidence double, n_tokens long, passages array<struct<start:long,end:long,score:double>>")


def _features(chunk: texts.Chunk) -> list[np.ndarray]:
    """Hashes of the word and of its prefixes, one array a feature; 0 where the word is shorter."""
    out = [chunk.hash]
    for size in PREFIXES:
        long = chunk.ends - chunk.starts >= size
        h = np.zeros(len(chunk.starts), dtype=np.uint64)
        h[long] = texts.mix(chunk.span_hash(chunk.starts[long], chunk.starts[long] + size) ^ np.uint64(size))
        out.append(h)
    return out


def _tokens(batches):
    """(word, two prefixes, preceding word, label) of every token, each combination once per batch."""
    for batch in batches:
        toxic = np.asarray(batch.column("toxic").to_pylist(), dtype=np.int64)
        parts = []
        for chunk in texts.chunks(batch.column("text")):
            chunk.words(texts.ALNUM, lower=True)
            before = np.zeros(len(chunk.hash), dtype=np.uint64)
            before[1:] = np.where(chunk.row[1:] == chunk.row[:-1], chunk.hash[:-1], 0)
            label = toxic[chunk.first + chunk.row]
            _, at = np.unique(texts.mix(chunk.hash) ^ before ^ label.astype(np.uint64), return_index=True)
            parts.append([x[at].view(np.int64) for x in (*_features(chunk), before)] + [label[at]])
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["w", "p4", "p5", "ctx", "t"])


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences [start, end) with their scores, in linear time (only positive entries are visited)."""
    total = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[list] = []              # start, end, sum before, sum after
    for i in np.flatnonzero(scores > 0).tolist():
        now = [i, i + 1, total[i], total[i + 1]]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= now[2]:
                j -= 1
            if j < 0 or stack[j][3] >= now[3]:
                stack.append(now)
                break
            now = [stack[j][0], now[1], stack[j][2], now[3]]
            del stack[j:]
    return [(a, b, float(hi - lo)) for a, b, lo, hi in stack]


class ToxicityModel:
    """Token scores, the constants of the extreme-value law, and the calibration curve."""

    def __init__(self, keys: np.ndarray, odds: np.ndarray, plain: float, rate: float, decay: float, curve=(-3.0, 0.0)):
        order = np.argsort(keys)
        self.keys, self.odds = keys[order], odds[order]
        self.plain, self.rate, self.decay, self.curve = plain, rate, decay, curve

    def token_scores(self, chunk: texts.Chunk) -> np.ndarray:
        best = np.full(len(chunk.starts), self.plain)
        if len(self.keys):
            for h in _features(chunk):
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                best = np.maximum(best, np.where(self.keys[at] == h, self.odds[at], self.plain))
        return best

    def evidence(self, scores: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
        """Summed -log10 chance of the significant segments, and these segments."""
        found, total = [], 0.0
        for start, end, s in maximal_segments(scores):
            expected = self.rate * len(scores) * math.exp(-self.decay * s)
            chance = -math.expm1(-expected)
            if chance <= SIGNIFICANT:
                total -= math.log10(max(chance, 1e-300))
                found.append((start, end, s))
        return total, found

    def score(self, x: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.curve[0] + self.curve[1] * min(x, EVIDENCE_MOST)))))

    def apply(self, batches):
        """doc_id, text -> OUT; positions in code points."""
        for batch in batches:
            ids = batch.column("doc_id")
            out_score, out_x, out_n, out_p = [], [], [], []
            for chunk in texts.chunks(batch.column("text")):
                chunk.words(texts.ALNUM, lower=True)
                s = self.token_scores(chunk)
                n = chunk.count()
                first = np.concatenate(([0], np.cumsum(n)))
                hot = set(np.unique(chunk.row[s > 0]).tolist())
                points = chunk.code_points() if hot else None
                for r in range(chunk.rows):
                    x, found = 0.0, []
                    if r in hot:
                        a = int(first[r])
                        x, segments = self.evidence(s[a:int(first[r + 1])])
                        base = points[chunk.offsets[r]]
                        found = [{"start": int(points[chunk.starts[a + i]] - base), "end": int(points[chunk.ends[a + j - 1]] - base), "score": v}
                                 for i, j, v in segments]
                    out_x.append(x)
                    out_p.append(found)
                    out_score.append(self.score(x))
                out_n.append(n)
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(out_score, pa.float64()), pa.array(out_x, pa.float64()),
                 pa.array(np.concatenate(out_n) if out_n else [], pa.int64()), pa.array(out_p, kinds)],
                names=["doc_id", "score", "evidence", "n_tokens", "passages"])


def labelled_sample(labels: DataFrame, bound: int = LABELLED, train=None) -> DataFrame:
    """At most bound labelled ids (doc_id, toxic), the same ones in every run."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    if train is not None:
        rows = rows.where(train)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED, train=None) -> ToxicityModel:
    """docs (doc_id, text), labels (doc_id, toxic); train: a condition on labels that chooses the rows to learn from."""
    sample = labelled_sample(labels, bound, train)
    known = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
             .groupBy(F.xxhash64("text").alias("_copy")).agg(F.any_value("text").alias("text"), F.max("toxic").cast("long").alias("toxic"))
             .select("text", "toxic"))
    sizes = {bool(r[0]): r[1] for r in known.groupBy((F.col("toxic") > 0)).count().collect()}
    n_t, n_c = sizes.get(True, 0), sizes.get(False, 0)
    if not n_t or not n_c:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -0.01, 1e-6, 1.0)
    pairs = (known.mapInArrow(_tokens, "w long, p4 long, p5 long, ctx long, t long").groupBy("w", "ctx", "t")
             .agg(F.min("p4").alias("p4"), F.min("p5").alias("p5")))
    counts = (pairs.select(F.explode(F.array("w", "p4", "p5")).alias("key"), "t").where("key != 0")
              .groupBy("key").agg(F.sum("t").alias("t"), F.sum(1 - F.col("t")).alias("c")))
    # the first feature of each token is its word, so words alone give the number of tokens
    total = pairs.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum(1 - F.col("t")), F.lit(0))).first()
    tokens_t, tokens_c = float(total[0]), float(total[1])
    if not tokens_t or not tokens_c:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -0.01, 1e-6, 1.0)
    strength = min(PRIOR, PRIOR_SHARE * (tokens_t + tokens_c))
    prior = F.lit(strength) * (F.col("t") + F.col("c")) / (tokens_t + tokens_c)
    up, down = F.col("t") + prior, F.col("c") + prior
    odds = F.log(up / (tokens_t + strength - up)) - F.log(down / (tokens_c + strength - down))
    rows = arrays(counts.where((up < tokens_t + strength) & (down < tokens_c + strength)).withColumn("odds", odds)
            .where((F.col("odds") > 1.0) & (F.col("odds") / F.sqrt(1 / up + 1 / down) >= Z_LEAST))
            .select("key", "odds", (down / (tokens_c + strength)).alias("p")))
    odds_of = rows["odds"]
    rate = min(max(float(rows["p"].sum()), 1e-9), 0.05)
    plain = -0.02
    decay = _decay(odds_of, rate, plain)
    model = ToxicityModel(rows["key"].view(np.uint64), odds_of, plain, rate, decay)
    bins = arrays(known.select(F.col("toxic").alias("doc_id"), "text").mapInArrow(model.apply, OUT)
            .groupBy((F.col("doc_id") > 0).alias("y"), F.round(F.least("evidence", F.lit(EVIDENCE_MOST)) * (EVIDENCE_BINS / EVIDENCE_MOST)).alias("bin"))
            .count())
    model.curve = _logistic(bins["bin"] * EVIDENCE_MOST / EVIDENCE_BINS, bins["y"].astype(float), bins["count"].astype(float))
    return model


def _decay(odds: np.ndarray, rate: float, plain: float) -> float:
    """lambda > 0 with (1 - rate) exp(lambda plain) + rate mean(exp(lambda odds)) = 1, by bisection."""
    if not len(odds):
        return 1.0

    def over(x: float) -> bool:
        return (1 - rate) * math.exp(x * plain) + rate * float(np.mean(np.exp(np.minimum(x * odds, 500)))) > 1
    low, high = 0.0, 4.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) else (mid, high)
    return max(low, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Intercept and slope with a weak Gaussian prior, by Newton's method."""
    w = np.zeros(2)
    design = np.stack([np.ones_like(x), x], axis=1)
    prior = np.array([1e-4, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (n * (y - p)) - prior * w
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag(prior)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, evidence, n_tokens and the significant passages of every row."""
    return docs.select("doc_id", "text").mapInArrow(model.apply, OUT)


TRAIN = "crc32(cast(doc_id as string)) % 3 != 1"


@query("op9_toxic_segments")
def op9_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), train=TRAIN)
    return score(docs, model).select(
        "doc_id", F.expr("coalesce(crc32(cast(doc_id as string)) % 3 = 1, false)").alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages"),
        F.array_join(F.transform("passages", lambda p: F.concat_ws(":", p["start"].cast("string"), p["end"].cast("string"))), ",").alias("passages"))


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, whose score is below threshold."""
    return docs.where(_score_column(model)(F.coalesce("text", F.lit(""))) < threshold)


def _score_column(model: ToxicityModel):
    @F.pandas_udf("double")
    def one(text: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(text))), pa.array(text, pa.string())], names=["doc_id", "text"])
        return pd.Series([x for out in model.apply([batch]) for x in out.column("score").to_pylist()], dtype="float64")
    return one
