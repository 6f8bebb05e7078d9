"""A bar store: yearly partitions sorted by asset and date, a manifest per version, merges that rewrite only what changed.

    <root>/data/year=2020/part=<id>/*.parquet      one folder per written state of a partition; never changed once written
    <root>/manifest/<version>.json                 the folders of a version with rows, dates and a digest of their content
    <root>/quarantine/batch=<id>                   refused rows with their reason, one folder per batch

A reader takes the newest manifest, leaves out the years it does not need before Spark lists any file, and leaves the rest to
partition pruning and to the row-group statistics of the sorted files. A writer merges the years it touches, writes those whose
content changed beside the old ones, and commits by renaming the next manifest into place; the rename fails if another writer was
faster, so a version is seen whole or not at all. Nothing but manifests (a row per year) is handled by the driver.
"""
from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marketframe.operators.quality import reject_reason
from marketframe.session import durable

KEYS = ["asset_id", "ts"]
REQUIRED = [*KEYS, "open", "high", "low", "close", "volume"]
#: rows of one row group at most, so that a range of one asset reads a small share of a file
GROUP_BYTES = 1 << 20


@dataclass(frozen=True)
class Part:
    """A written partition: its folder, rows, first and last date, and a digest of its rows whatever their order."""
    year: int
    folder: str
    rows: int
    first: str
    last: str
    digest: str


class Conflict(RuntimeError):
    """Another writer has committed the version this one was about to write."""


class BarStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- files of the driver: one small JSON per version
    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path("manifest")
        if not self._fs().exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs().listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> tuple[int, list[Part]]:
        """(version, parts), 0 and none for a new store."""
        known = self.versions()
        if not known:
            return 0, []
        version = known[-1] if version is None else version
        stream = self._fs().open(self._path(f"manifest/{version}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, [Part(**p) for p in json.loads(text)]

    def _commit(self, version: int, parts: list[Part]) -> None:
        jvm, hidden = self.spark._jvm, self._path(f"manifest/_{uuid.uuid4().hex}")
        out = self._fs().create(hidden, False)
        try:
            out.write(json.dumps([vars(p) for p in sorted(parts, key=lambda p: p.year)], indent=1).encode())
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(hidden.toUri(), self.spark._jsc.hadoopConfiguration()) \
            if hidden.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        flags = self.spark.sparkContext._gateway.new_array(option, 1)
        flags[0] = option.NONE
        try:
            context.rename(hidden, self._path(f"manifest/{version}.json"), flags)
        except Exception as error:  # noqa: BLE001  (the JVM's exception)
            self._fs().delete(hidden, False)
            if version in self.versions():
                raise Conflict(f"version {version} of {self.root} exists") from error
            raise

    # ---- reading
    def read(self, first: str | None = None, last: str | None = None, version: int | None = None) -> DataFrame:
        """The bars of a version, between two dates inclusive; years outside are not even listed."""
        parts = [p for p in self.manifest(version)[1] if (first is None or p.last >= first) and (last is None or p.first <= last)]
        if not parts:
            return self.spark.createDataFrame([], "asset_id string, ts date, open double, high double, low double, close double, volume long, factor double")
        df = self._parts(parts)
        if first is not None:
            df = df.where((F.col("ts") >= F.lit(first).cast("date")) & (F.col("year") >= int(first[:4])))
        if last is not None:
            df = df.where((F.col("ts") <= F.lit(last).cast("date")) & (F.col("year") <= int(last[:4])))
        return df.drop("year", "part", "_state")

    def bars_between(self, asset_id: str, first: str, last: str) -> DataFrame:
        """Bars of one asset, both ends inclusive, in time order."""
        return self.read(first, last).where(F.col("asset_id") == asset_id).orderBy("ts")

    def _parts(self, parts: list[Part]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/data/{p.folder}" for p in parts])

    # ---- writing
    def ingest(self, raw: DataFrame, batch: str, order: str | None = None) -> dict[str, int]:
        """Merge a batch of raw bars; the later row of a key wins, by `order` within the batch (any row on ties), and over what is stored.

        Refused rows go to the quarantine of the batch, which a second run replaces. Returns the number of rows read, refused by
        reason, superseded within the batch, inserted, updated and unchanged. A batch that changes nothing commits no version.
        """
        # judged once; everything below reads this table
        judged = durable(raw.withColumn("reason", F.when(F.array_contains(F.array(*[F.col(c).isNull() for c in REQUIRED]), True), "missing_value").otherwise(reject_reason())))
        counts = {r.reason: r.n for r in judged.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
        refused = {k: v for k, v in counts.items() if k != "ok"}
        (judged.where("reason <> 'ok'").write.mode("overwrite").parquet(f"{self.root}/quarantine/batch={batch}"))
        fresh = judged.where("reason = 'ok'").drop("reason")
        best = Window.partitionBy(*KEYS).orderBy(F.desc(order) if order else F.lit(1))
        fresh = fresh.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", *([order] if order else []))
        fresh = fresh.withColumn("year", F.year("ts"))
        version, parts = self.manifest()
        years = {r.year for r in fresh.select("year").distinct().collect()}
        held = [p for p in parts if p.year in years]
        merged, columns = self._merged(fresh, held), [c for c in fresh.columns if c != "year"]
        name = uuid.uuid4().hex
        data = f"{self.root}/data"
        # every touched year is written to a new folder, in files of whole assets sorted by asset and date
        staged = merged.withColumn("part", F.lit(name)).repartitionByRange("year", "asset_id").sortWithinPartitions("year", "asset_id", "ts")
        (staged.select(*columns, "_state", "year", "part").write.mode("append").option("parquet.block.size", GROUP_BYTES)
         .partitionBy("year", "part").parquet(f"{data}/_staged/{name}"))
        written = self.spark.read.parquet(f"{data}/_staged/{name}") if years else None
        states, found = {}, []
        if years:
            states = {r["_state"]: r.n for r in written.groupBy("_state").agg(F.count(F.lit(1)).alias("n")).collect()}
            digest = F.sum(F.xxhash64(*sorted(columns)).cast("decimal(38,0)"))
            found = written.groupBy("year").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last"), digest.alias("digest")).collect()
        old = {p.year: p for p in held}
        changed = [Part(r.year, f"year={r.year}/part={name}", r.rows, str(r.first), str(r.last), str(r.digest)) for r in found
                   if r.year not in old or (old[r.year].rows, old[r.year].digest) != (r.rows, str(r.digest))]
        for p in changed:
            # a move within one file system; readers do not see it before the manifest names it
            self._fs().mkdirs(self._path(f"data/year={p.year}"))
            self._fs().rename(self._path(f"data/_staged/{name}/year={p.year}/part={name}"), self._path(f"data/{p.folder}"))
        self._fs().delete(self._path(f"data/_staged/{name}"), True)
        if changed:
            self._commit(version + 1, [p for p in parts if p.year not in {c.year for c in changed}] + changed)
        total, ok = sum(counts.values()), counts.get("ok", 0)
        kept = states.get("inserted", 0) + states.get("updated", 0) + states.get("unchanged", 0)
        return {"read": total, **{f"refused_{k}": v for k, v in sorted(refused.items())}, "superseded": ok - kept,
                **{k: states.get(k, 0) for k in ("inserted", "updated", "unchanged")}}

    def _merged(self, fresh: DataFrame, held: list[Part]) -> DataFrame:
        """Incoming and stored rows of the touched years with _state: inserted, updated, unchanged or kept."""
        columns = [c for c in fresh.columns if c not in KEYS and c != "year"]
        if not held:
            return fresh.withColumn("_state", F.lit("inserted"))
        stored = self._parts(held).drop("part", "_state").select(*KEYS, "year", F.struct(*columns).alias("_old"))
        both = fresh.select(*KEYS, "year", F.struct(*columns).alias("_new")).join(stored, [*KEYS, "year"], "full_outer")
        state = (F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted")
                 .when(F.col("_new").eqNullSafe(F.col("_old")), "unchanged").otherwise("updated"))
        return both.withColumn("_state", state).select(*KEYS, "year", F.coalesce("_new", "_old").alias("_row"), "_state").select(*KEYS, "year", "_row.*", "_state")

    def quarantine(self) -> DataFrame:
        """All refused rows with reason and batch."""
        return self.spark.read.parquet(f"{self.root}/quarantine")

    def vacuum(self, keep: int = 1) -> int:
        """Remove the manifests but the newest `keep`, and the folders that none of those names; the number of folders removed."""
        versions = self.versions()
        named = {p.folder for v in versions[-keep:] for p in self.manifest(v)[1]}
        for v in versions[:-keep]:
            self._fs().delete(self._path(f"manifest/{v}.json"), False)
        gone = 0
        if self._fs().exists(self._path("data")):
            for year in self._fs().listStatus(self._path("data")):
                for part in self._fs().listStatus(year.getPath()):
                    folder = f"{year.getPath().getName()}/{part.getPath().getName()}"
                    if folder.startswith("year=") and folder not in named:
                        gone += bool(self._fs().delete(part.getPath(), True))
        return gone
