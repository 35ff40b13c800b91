"""Vectors of texts, kept by the hash of their text, in versions that readers can rely on.

    vectors/<part>      key, embedding: written once, never changed
    index/<version>     id, key: the records of a version
    manifest/<version>  one row: version, encoder, parts, records, dimension

An upsert encodes the texts that no part of the same encoder holds, once each however many records share one, writes them as
a new part, then the index, then the manifest. A reader takes the newest version that has a manifest, so what it reads stays
as it is while another version is made, and a job that dies in between leaves the old version in force.

Nulls: a null text is the empty one; a null id is kept. Repeated records are kept each. An empty table makes an empty version.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.lineage import settled

MANIFEST = "version long, encoder string, parts array<string>, records long, dimension int"
VECTORS = "key string, embedding array<double>"


class VectorStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self, version: int | None = None) -> Row | None:
        """A version's entry, the newest by default; null if there is none."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/*")
        except AnalysisException:
            return None
        wanted = rows if version is None else rows.where(F.col("version") == version)
        return wanted.orderBy(F.desc("version")).first()

    def index(self, entry: Row) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/index/{entry.version}")

    def vectors(self, parts: list[str]) -> DataFrame:
        where = [f"{self.path}/vectors/{p}" for p in parts]
        return self.spark.read.schema(VECTORS).parquet(*where) if where else self.spark.createDataFrame([], VECTORS)

    def read(self, version: int | None = None) -> DataFrame:
        """id and embedding of a version's records."""
        entry = self.manifest(version)
        if entry is None:
            raise ValueError(f"{self.path} holds no version {'' if version is None else version}".rstrip())
        return self.index(entry).join(self.vectors(entry.parts), "key").select("id", "embedding")

    def upsert(self, records: DataFrame, encode: Callable[[Column], Column], encoder: str = "hashed") -> int:
        """The version that holds the vectors of these records (id, text) and no others: the newest if nothing has changed."""
        keyed = settled(records.select("id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.sha2("text", 256)))
        last = self.manifest()
        parts = list(last.parts) if last is not None and last.encoder == encoder else []
        if parts or (last is not None and last.encoder == encoder):
            count = lambda rows, n: rows.groupBy("id", "key").agg(F.count("*").alias(n))
            both = count(keyed, "_n").join(count(self.index(last), "_m").withColumnsRenamed({"id": "_i", "key": "_k"}), F.col("id").eqNullSafe(F.col("_i")) & (F.col("key") == F.col("_k")), "full")
            if not both.where(~F.col("_n").eqNullSafe(F.col("_m"))).limit(1).count():
                return last.version
        version = 1 if last is None else last.version + 1
        fresh = keyed.groupBy("key").agg(F.min("text").alias("text")).join(self.vectors(parts).select("key"), "key", "left_anti")
        part = f"{version}-{uuid4().hex}"
        fresh.select("key", encode(F.col("text")).alias("embedding")).write.parquet(f"{self.path}/vectors/{part}")
        parts.append(part)
        # An index that an upsert left behind without a manifest is nobody's, and is made anew.
        keyed.select("id", "key").write.mode("overwrite").parquet(f"{self.path}/index/{version}")
        sizes = self.vectors(parts).agg(F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
        if sizes.least != sizes.most:
            raise ValueError(f"vectors of {sizes.least} and of {sizes.most} dimensions")
        entry = [(version, encoder, parts, self.spark.read.parquet(f"{self.path}/index/{version}").count(), sizes.most)]
        self.spark.createDataFrame(entry, MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest/{version}")
        return version
