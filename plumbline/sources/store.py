"""The chunk store: Parquet partitioned by key bucket and provider, written by key, read with pruning."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.session import prepare

SCHEMA = "chunk_id string, arxiv_id string, page int, ordinal int, page_content string, text_sha8 string, embedding array<float>, metadata map<string,string>, provider string"
# The providers and their models.
PROVIDERS = {
    "groq": ["openai/gpt-oss-20b", "openai/gpt-oss-120b"],
    "gemini": ["gemini-3.1-flash-lite", "gemini-3.5-flash"],
}
#: Snapshots that stay readable; files that only older ones name are deleted.
KEPT = 3
#: Folders that no snapshot names, left by killed writers, go when they are so old; younger ones may be in the making.
ORPHAN_SECONDS = 24 * 3600


def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Rows of new replace those of old that have the same provider and key (chunk_id, or a hash of the text without
    one). Several rows of a key in new: the last in the order of its files and rows stays."""
    key = T.join_key(F.col("chunk_id"), F.col("page_content"))
    prepare(new.sparkSession)
    keyed = new.withColumn("_at", F.monotonically_increasing_id()).withColumn("_key", key)
    last = keyed.groupBy("provider", "_key").agg(F.max_by(F.struct(*new.columns), "_at").alias("_r")).select("_key", "_r.*").select("_key", *new.columns)
    if old is None:
        return last.drop("_key")
    kept = old.withColumn("_key", key).join(last.select("provider", "_key"), ["provider", "_key"], "left_anti")
    return kept.select(*new.columns).unionByName(last.drop("_key"))


@dataclass
class Store:
    """path/data/gen=ID/bucket=B/provider=P holds rows; path/snapshots/N.json names the gen that each bucket is read from.

    A write goes to a folder of its own, rewrites only the buckets that its keys fall in, and then publishes the next
    snapshot under a number that nobody else can take. So readers never see half a write, a killed writer leaves
    nothing but a folder that no snapshot names, and of two writers the second starts again from the first one's rows."""

    spark: SparkSession
    path: str
    buckets: int = 64

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _names(self, folder: str) -> dict[str, int]:
        """Entries of a folder and when they changed, in milliseconds."""
        fs, path = self._fs()
        at = path(f"{self.path}/{folder}")
        return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(at)} if fs.exists(at) else {}

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("snapshots") if n.endswith(".json"))

    def _snapshot(self, number: int) -> dict:
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/snapshots/{number}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, number: int, snapshot: dict) -> bool:
        """Whether the snapshot could take its number."""
        fs, path = self._fs()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        draft = path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(snapshot).encode()))
        out.close()
        fs.mkdirs(path(f"{self.path}/snapshots"))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, path(f"{self.path}/snapshots/{number}.json"), options)
            return True
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(draft, False)
            return False

    @property
    def version(self) -> int:
        """0 before the first write."""
        return (self._numbers() or [0])[-1]

    def exists(self) -> bool:
        return self.version > 0

    def create(self) -> None:
        """Empty collections."""
        if not self.exists():
            self._publish(1, {"buckets": self.buckets, "gens": {}})

    def _rows(self, snapshot: dict, only: list[int] | None = None) -> DataFrame:
        cols = [f.split()[0] for f in SCHEMA.split(", ")]
        gens = {b: g for b, g in snapshot["gens"].items() if only is None or int(b) in only}
        if not gens:
            return self.spark.createDataFrame([], SCHEMA)
        paths = [f"{self.path}/data/gen={g}/bucket={b}" for b, g in sorted(gens.items())]
        return self.spark.read.schema(SCHEMA).option("basePath", f"{self.path}/data").parquet(*paths).select(*cols)

    def read(self, provider: str | None = None) -> DataFrame:
        """A missing store is an error."""
        if not self.exists():
            raise FileNotFoundError(f"no store at {self.path}")
        df = self._rows(self._snapshot(self.version))
        return df.where(F.col("provider") == provider) if provider else df

    def count(self, provider: str) -> int:
        return self.read(provider).count()

    def upsert(self, chunks: DataFrame, tries: int = 20) -> None:
        """A new snapshot with merge() of the current one and the chunks."""
        key = T.join_key(F.col("chunk_id"), F.col("page_content"))
        for _ in range(tries):
            number = self.version
            now = self._snapshot(number) if number else {"buckets": self.buckets, "gens": {}}
            bucket = F.pmod(F.xxhash64(key), F.lit(now["buckets"])).cast("int")
            touched = [r[0] for r in chunks.select(bucket.alias("b")).distinct().collect()]  # at most `buckets`
            gen, gens = uuid.uuid4().hex, dict(now["gens"])
            if touched:
                rows = merge(self._rows(now, touched), chunks).withColumn("bucket", bucket)
                rows.hint("rebalance", "bucket").write.partitionBy("bucket", "provider").parquet(f"{self.path}/data/gen={gen}")
                gens |= {str(b): gen for b in touched}
            if self._publish(number + 1, {"buckets": now["buckets"], "gens": gens}):
                self.clean()
                return
        raise RuntimeError(f"other writers were faster {tries} times")

    def clean(self, orphan_seconds: float = ORPHAN_SECONDS) -> None:
        """Deletes all but the last KEPT snapshots, files that only deleted ones name, and old folders that none names."""
        fs, path = self._fs()
        numbers = self._numbers()
        kept = {g for n in numbers[-KEPT:] for g in self._snapshot(n)["gens"].values()}
        gone = {g for n in numbers[:-KEPT] for g in self._snapshot(n)["gens"].values()} - kept
        for n in numbers[:-KEPT]:
            fs.delete(path(f"{self.path}/snapshots/{n}.json"), False)
        for name, changed in self._names("data").items():
            gen = name.removeprefix("gen=")
            if gen in gone or gen not in kept and time.time() - changed / 1000 >= orphan_seconds:
                fs.delete(path(f"{self.path}/data/{name}"), True)

    def missing(self, chunks: DataFrame) -> DataFrame:
        """What a resumed ingest has still to do, by id."""
        if not self.exists():
            return chunks
        return chunks.join(self.read().select("provider", "chunk_id"), ["provider", "chunk_id"], "left_anti")

    def reset(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.path), True)
