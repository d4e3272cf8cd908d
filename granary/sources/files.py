"""Files as a source: bodies with all digests in one pass, and blobs kept once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.documents import digests
from granary.operators.snapshots import matching, without
from granary.schema import BLOBS


def binary_files(spark: SparkSession, folder: str, domain: str = "default", glob: str | None = None) -> DataFrame:
    """(domain, relative_path, content, size) of all files under a folder, by any path that
    Spark's readers can open. Hadoop gives the folder its full form, so that is cut off."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return with_paths(reader.load(folder), folder, domain)


def with_paths(files: DataFrame, folder: str, domain: str) -> DataFrame:
    base = files.sparkSession._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/")
    at = F.regexp_replace("path", r"\A[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    return files.select(F.lit(domain).alias("domain"), F.substring(at, F.lit(len(base) + 2), F.lit(2**31 - 1)).alias("relative_path"), "content", F.col("length").alias("size"))


#: Keys of new bodies are broadcast to the bodies up to so many, and shuffled beyond.
BROADCAST_KEYS = 1 << 18


def _hashed(files: DataFrame) -> DataFrame:
    path = F.col("relative_path") if "relative_path" in files.columns else F.lit("")
    return files.where(F.col("content").isNotNull()).select("domain", F.sha2("content", 256).alias("sha256"), path.alias("path"), "content")


def body_keys(files: DataFrame, known: DataFrame | None) -> DataFrame:
    """(domain, sha256, path, n): for each body that the domain does not have, the file that
    stands for it and how often that file is there. Found from digests and paths alone."""
    held = _hashed(files).groupBy("domain", "sha256", "path").agg(F.count("*").alias("n"))
    chosen = held.groupBy("domain", "sha256").agg(F.min(F.struct("path", "n")).alias("one")).select("domain", "sha256", "one.*")
    return chosen if known is None else without(chosen, matching(known, chosen, ["domain", "sha256"]), ["domain", "sha256"])


def new_blobs(files: DataFrame, known: DataFrame | None, staged: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Blobs to append: those whose digest the domain does not have. Bodies stay where they are
    read, while the keys are few; files that repeat path and body are the only ones to be dealt."""
    keys = staged(body_keys(files, known))
    few = F.broadcast if keys.count() <= BROADCAST_KEYS else lambda rows: rows
    rows, names = _hashed(files), ["domain", "sha256", "path"]
    single = matching(rows, few(keys.where("n = 1")), names)
    repeated = matching(rows, few(keys.where("n > 1")), names).dropDuplicates(["domain", "sha256"])
    full = single.unionByName(repeated).withColumn("size", F.octet_length("content").cast("long"))
    return full.withColumns({k: c for k, c in digests(F.col("content")).items() if k != "sha256"}).select(*BLOBS.names)


def blobs_of(files: DataFrame) -> DataFrame:
    """A blob for each distinct body in a domain."""
    return new_blobs(files, None)


def text_blobs(documents: DataFrame) -> DataFrame:
    """Blobs of generated documents (domain, body)."""
    return blobs_of(documents.select("domain", "relative_path", F.col("body").cast("binary").alias("content")))
