"""Claim packets: strict JSON of a run's evidence, and the check of packet folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, StructType

VERSION = 2
#: What a packet must hold, and the tiers it may claim.
REQUIRED = ("packet_version", "name", "config_hash", "claim_tier", "metrics", "artifacts")
TIERS = ("no_claim", "mechanics", "gross", "net", "robust")


def _finite(x: Column, kind: DataType) -> Column:
    """``x`` with every number inside that is not finite as NULL."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    if isinstance(kind, StructType):
        return F.when(x.isNotNull(), F.struct(*(_finite(x[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, ArrayType):
        return F.transform(x, lambda v: _finite(v, kind.elementType))
    return x


def build_packets(runs: DataFrame, metrics: list[str], keep: list[str]) -> DataFrame:
    """``(name, packet)``: one strict JSON text for each run; ``artifacts`` is an array of file names."""
    fields = {f.name: f.dataType for f in runs.schema.fields}
    values = F.struct(*(_finite(F.col(m), fields[m]).alias(m) for m in metrics))
    body = F.struct(F.lit(VERSION).alias("packet_version"), *(_finite(F.col(c), fields[c]).alias(c) for c in keep), values.alias("metrics"))
    return runs.select("name", F.to_json(body, {"ignoreNullFields": "false"}).alias("packet"))


def write_packets(packets: DataFrame, path: str) -> None:
    """A folder ``name=...`` with the packet as JSON for each run."""
    packets.select("name", F.col("packet").alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def packet_faults(packets: DataFrame, files: DataFrame) -> DataFrame:
    """``(name, fault)`` of packets that cannot be read, lack a key, have another version or tier, or name a missing file.

    ``packets(name, packet)`` and ``files(name, file)``; sound packets give no row.
    """
    keys = F.json_object_keys("packet")
    read = packets.withColumns({
        "_keys": keys, "_p": F.from_json("packet", "packet_version int, claim_tier string, artifacts array<string>"),
    })
    strict = ~F.col("packet").rlike(r"[:\[,]\s*-?(NaN|Infinity)")
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), F.coalesce("_keys", F.array().cast("array<string>")))
    fault = (
        F.when(F.col("_keys").isNull() | ~strict, "not strict JSON").when(F.size(missing) > 0, F.concat(F.lit("lacks "), F.array_join(missing, ", ")))
        .when(F.col("_p.packet_version") != VERSION, "version").when(~F.col("_p.claim_tier").isin(*TIERS), "tier")
    )
    judged = read.withColumn("fault", fault)
    named = judged.where("fault is null").select("name", F.explode("_p.artifacts").alias("file"))
    absent = named.join(files, ["name", "file"], "left_anti").select("name", F.concat(F.lit("no file "), "file").alias("fault"))
    return judged.where("fault is not null").select("name", "fault").unionByName(absent)


def validate_packet_folder(spark: SparkSession, path: str) -> DataFrame:
    """``packet_faults`` of a written folder: ``name=.../*.txt`` packets beside their artifacts."""
    texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").withColumn("file", F.col("_metadata.file_path"))
    folder = lambda c: F.regexp_extract(c, r"name=([^/]+)/", 1)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    files = listing.select(folder("path").alias("name"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    return packet_faults(texts.select(folder("file").alias("name"), F.col("value").alias("packet")), files)
