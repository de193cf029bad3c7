"""Files in and out: evidence as binary files with their hash and kind, and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# First bytes of each kind of file, in hexadecimal, as patterns.
SIGNATURES = (
    ("JPEG", "^FFD8FF"), ("PNG", "^89504E470D0A1A0A"), ("TIFF", "^(49492A00|4D4D002A)"), ("HEIF", "^.{8}66747970(68656963|68656978|6D696631|6D736631)"),
    ("MOV", "^.{8}6674797071742020"), ("MP4", "^.{8}66747970"), ("AVI", "^52494646.{8}41564920"), ("ULOG", "^554C6F67011235"), ("DATAFLASH", "^A395"), ("ZIP", "^504B0304"),
)


def kind(content: Column) -> Column:
    """The kind of a file by its first bytes; subtitle text by its first cue."""
    head = F.hex(F.substring(content, 1, 64))
    out = F.when(F.decode(F.substring(content, 1, 64), "ISO-8859-1").rlike(r"^(\xEF\xBB\xBF)?\s*\d+\s*\r?\n\d{2}:\d{2}:\d{2}[,.]\d"), "SRT")
    for name, pattern in reversed(SIGNATURES):
        out = F.when(head.rlike(pattern), name).otherwise(out)
    return out


def evidence_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(path, size, modified, sha256, kind, extension, extension_matches)`` of the files
    below a directory. Files that cannot be read and empty files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("ignoreCorruptFiles", "true").load(path)
    ext = F.upper(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    k = kind(F.col("content"))
    same = F.create_map(*[F.lit(x) for kv in {"JPG": "JPEG", "TIF": "TIFF", "HEIC": "HEIF", "ULG": "ULOG", "BIN": "DATAFLASH", "M4V": "MP4"}.items() for x in kv])
    return files.select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), k.alias("kind"), F.lower(ext).alias("extension"),
        (F.coalesce(F.try_element_at(same, ext), ext) == k).alias("extension_matches"),
    )


def sidecar_files(spark: SparkSession, path: str) -> DataFrame:
    """Subtitle files as rows of documents, for :func:`plumbline.sources.sidecars.frames`."""
    texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.[sS][rR][tT]").select("value", F.col("_metadata.file_path").alias("path"))
    return texts.select(F.xxhash64("path").alias("doc_id"), F.col("value").alias("text"), F.lit("drone_sidecar").alias("source"), "path")


def json_safe(df: DataFrame) -> DataFrame:
    """Values that are no finite number become null, so that the rows are valid JSON."""
    real = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) if c in real else F.col(c) for c in df.columns])


def write_report(df: DataFrame, path: str, form: str = "json", by: list[str] | None = None) -> None:
    """A result as JSON lines, CSV or parquet, partitioned by columns if given."""
    if form not in ("json", "csv", "parquet"):
        raise ValueError("form is 'json', 'csv' or 'parquet'")
    out = (json_safe(df) if form == "json" else df).write.mode("errorifexists")
    out = out.option("header", "true") if form == "csv" else out
    (out.partitionBy(*by) if by else out).format(form).save(path)


def write_manifest(spark: SparkSession, path: str) -> str:
    """Beside a written result, ``<path>.sha256`` with the hash and name of each of its files, as
    hashing tools write and check them; gives that path."""
    files = evidence_files(spark, path).where(~F.col("path").rlike(r"/[._][^/]*$"))
    out = path.rstrip("/") + ".sha256"
    files.select(F.concat_ws("  ", "sha256", F.regexp_extract("path", r"[^/]+$", 0))).write.mode("errorifexists").text(out)
    return out
