"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mixture. Its repetition rate is share * budget / size, with sizes in code points counted over
all rows. Each document draws its number of copies from a Poisson distribution with that mean: a uniform number from the MD5 of
the seed and the document's identity is inverted through the cumulative distribution, so that a retried task and another engine
draw the same. Documents are exploded by their counts and put into a global random order: copies are dealt to partitions by
the hash of a random key and sorted by it within each.

Targets are a map from source to weight (any positive scale; sources without one get none), or None for the temperature rule
weight = size ** TEMPERATURE. No row is grouped by source, so a source with a third of all rows fills no task; sizes are
aggregated before they are shuffled, and the table of rates has one row per source.

Nulls: a null source is a source of its own, named by the empty text; a null text has size 0 and is drawn like any other; a
null id is the empty text for the draw. Rows that repeat an id and its text draw alike. Sources of size 0 get no copies. An
empty table gives no rows. Columns of the input are kept; the added ones are named in the signature.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketframe.llm.registry import query, table
from marketframe.llm.storage import Shelf

SEED = "mix-1"
TEMPERATURE = 0.7
#: largest mean of a single inversion; exp(-PART) is far from underflow
PART = 64.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """_source, _rate: mean copies of a document of each source; budget in code points, by default the size of docs."""
    sizes = (docs.groupBy(F.coalesce("source", F.lit("")).alias("_source"))
             .agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("_size")))
    if targets is None:
        weight = F.pow(F.col("_size").cast("double"), F.lit(temperature))
    else:
        pairs = [F.lit(x) for k, v in sorted(targets.items()) for x in (k, float(v))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("_source")], F.lit(0.0)) if pairs else F.lit(0.0)
    # one row per source, written so that Spark knows its size and broadcasts it only while that is small
    weighted = Shelf(docs.sparkSession, "mixing").put(sizes.where("_size > 0").withColumn("_weight", weight), "weights")
    every, full = weighted.agg(F.sum("_weight"), F.sum("_size").cast("double")).first()
    if not every:
        return weighted.where("false").select("_source", F.lit(0.0).alias("_rate"))
    full = full if budget is None else float(budget)
    return weighted.where("_weight > 0").select("_source", (F.col("_weight") / every * full / F.col("_size")).alias("_rate"))


def poisson(u: Column, rate: Column) -> Column:
    """The number of cumulative probabilities of a Poisson law below u; terms up to ten deviations above the mean."""
    last = F.ceil(rate + F.lit(10) * F.sqrt(rate) + F.lit(20)).cast("int")
    state = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("n"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), (s["n"] + F.when(s["c"] <= u, 1).otherwise(0)).alias("n"))
    return F.aggregate(F.sequence(F.lit(1), last), state, step, lambda s: s["n"])


def drawn(identity: list[Column], rate: Column) -> Column:
    """Copies of a row: one Poisson draw, or for large rates the sum of several with means of PART at most."""
    parts = F.greatest(F.ceil(rate / PART).cast("int"), F.lit(1))
    one = lambda j: poisson(uniform(*identity, j.cast("string")), rate / parts)
    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, j: n + one(j))


def mix(docs: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, temperature: float = TEMPERATURE,
        seed: str = SEED) -> DataFrame:
    """docs with copy (from 0), copies and shuffle_key: each row as often as drawn, in global random order."""
    rate = rates(docs, targets, budget, temperature)
    identity = [F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))]
    own = [F.col(c) for c in docs.columns if c not in ("copy", "copies", "shuffle_key")]
    chosen = (docs.join(rate, F.coalesce("source", F.lit("")) == F.col("_source"))
              .withColumn("copies", drawn(identity, F.col("_rate"))).where("copies > 0"))
    out = (chosen.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
           .withColumn("shuffle_key", F.md5(F.concat_ws("|", *identity, F.col("copy").cast("string")))))
    return out.select(*own, "copy", "copies", "shuffle_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key")


SQL = """
WITH d AS (SELECT *, coalesce(source, '') AS s, concat_ws('|', 'mix-1', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, ''))) AS ident FROM documents),
sizes AS (SELECT s, sum(length(coalesce(text, ''))) AS size FROM d GROUP BY 1),
rated AS (SELECT s, pow(CAST(size AS DOUBLE), 0.7) / sum(pow(CAST(size AS DOUBLE), 0.7)) OVER () * sum(CAST(size AS DOUBLE)) OVER () / size AS rate
          FROM sizes WHERE size > 0),
cdf AS (SELECT s, list(c ORDER BY k) AS c FROM (SELECT s, k, sum(exp(-rate) * pow(rate, k) / factorial(CAST(k AS INTEGER))) OVER (PARTITION BY s ORDER BY k) AS c
        FROM rated, range(0, 33) AS r(k)) GROUP BY 1),
n AS (SELECT d.*, CAST(len(list_filter(c, lambda x: x <= CAST(CAST(concat('0x', substr(md5(concat_ws('|', ident, '1')), 1, 13)) AS BIGINT) AS DOUBLE) / 4503599627370496)) AS INTEGER) AS copies
      FROM d JOIN cdf USING (s))
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, copies, md5(concat_ws('|', ident, CAST(copy AS VARCHAR))) AS shuffle_key
FROM (SELECT *, unnest(range(0, copies)) AS copy FROM n)
"""


@query("op5_poisson_mixing", SQL)
def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
