"""Files of a repository: addresses, path filters, reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import extension

#: Extensions of source files, folders and endings to skip.
SOURCE_EXTENSIONS = ".py .pyi .js .jsx .ts .tsx .mjs .cjs .java .c .h .cpp .hpp .cc .hh .cs .go .php .rb .rs .kt .kts .swift .scala .sql".split()
SKIP_FOLDERS = ".git .github .idea .vscode __pycache__ .venv venv env node_modules dist build coverage .next .nuxt vendor target site-packages bower_components".split()
LOCAL_SKIP_FOLDERS = [*SKIP_FOLDERS, ".pytest_cache", ".mypy_cache", ".ruff_cache"]
SKIP_ENDINGS = ".min.js .min.css .map .lock .svg .png .jpg .jpeg .gif .ico .pdf .zip .gz .tar .woff .woff2 .ttf .eot".split()
REMOTE_SKIP_ENDINGS = [".min.js", ".min.css", ".map"]

REPO_URL = r"(?i)^https?://(?:www\.)?github\.com/([^/#?\s]+)/([^/#?\s]+?)(?:\.git)?/?$"


def repo_address(url: Column) -> Column:
    """struct(owner, repo, status) of a repository's address; both are null if it is invalid."""
    owner, repo = (F.regexp_extract(F.trim(url), REPO_URL, k) for k in (1, 2))
    ok = (owner != "") & (repo != "")
    return F.struct(F.when(ok, owner).alias("owner"), F.when(ok, repo).alias("repo"), F.when(ok, "valid").otherwise("invalid").alias("status"))


def http_error(status: Column, remaining: Column, operation: Column) -> Column:
    """What a failed request is reported as; null if it did not fail."""
    return (
        F.when((status == 403) & (remaining == "0"), F.concat(operation, F.lit(": rate limit exceeded")))
        .when(status == 401, F.concat(operation, F.lit(": credentials rejected")))
        .when(status == 403, F.concat(operation, F.lit(": access denied")))
        .when(status == 404, F.concat(operation, F.lit(": not found")))
        .when(status >= 400, F.concat(operation, F.lit(": status "), status.cast("string")))
    )


def is_source_name(name: Column) -> Column:
    lower = F.lower(name)
    skipped = F.lit(False)
    for ending in SKIP_ENDINGS:
        skipped = skipped | lower.endswith(ending)
    return ~skipped & extension(lower).isin(SOURCE_EXTENSIONS)


def is_remote_source(path: Column, folders: list[str] = SKIP_FOLDERS) -> Column:
    """A path of a source file in no skipped folder; only folders are looked at, not the file's own name."""
    parts = F.split(path, "/")
    in_skipped = F.exists(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda d: F.lower(d).isin(folders))
    minified = F.lit(False)
    for ending in REMOTE_SKIP_ENDINGS:
        minified = minified | F.lower(path).endswith(ending)
    return ~in_skipped & ~minified & extension(path).isin(SOURCE_EXTENSIONS)


def candidates(tree: DataFrame) -> DataFrame:
    """The files of a repository tree (type, path, size) that are worth reading."""
    return tree.where((F.col("type") == "blob") & (F.col("path") != "") & (F.col("size") > 0) & is_remote_source(F.col("path")))


def control_share(content: Column) -> Column:
    """Share of control bytes among the first 8192: below 9, or 14 to 31."""
    head = F.decode(F.substring(content.cast("binary"), 1, 8192), "ISO-8859-1")
    n = F.char_length(head)
    return F.when(n > 0, F.regexp_count(head, F.lit(r"[\x00-\x08\x0E-\x1F]")) / n).otherwise(F.lit(0.0))


def is_binary(content: Column) -> Column:
    head = F.substring(content.cast("binary"), 1, 8192)
    return F.contains(head, F.lit(b"\x00")) | (control_share(content) > 0.3)


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """file, source of the source files under a folder, in any store Spark reads; path and length filters reach the scan,
    binary files are dropped, bad bytes replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    found = files.where((F.col("length") > 0) & is_remote_source(F.col("path"), LOCAL_SKIP_FOLDERS) & is_source_name(F.col("path")))
    return found.where(~is_binary(F.col("content"))).select(F.col("path").alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("source"))
