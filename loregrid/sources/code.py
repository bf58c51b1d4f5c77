"""Source code files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, MOST_FILES = 1 << 20, 20_000
#: Languages by file name and by extension, folders and files that are passed over.
BY_NAME = {"dockerfile": "dockerfile", "makefile": "make"}
BY_EXTENSION = {
    "go": "go", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "rs": "rust", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp",
    "rb": "ruby", "sh": "shell", "sql": "sql", "kt": "kotlin", "swift": "swift", "cs": "csharp", "php": "php", "scala": "scala",
}
SKIPPED = r"(?i)/(?:\.git|vendor|node_modules|\.venv|__pycache__|dist|build)/|/\.env[^/]*$|\.min\.(?:js|css)$"


def language(path: Column) -> Column:
    """The language of a file by its name, else by its extension; null if it is no code."""
    table = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    name = F.lower(F.regexp_extract(path, "([^/]+)$", 1))
    return F.coalesce(F.try_element_at(table(BY_NAME), name), F.try_element_at(table(BY_EXTENSION), F.regexp_extract(name, r"\.([^.]+)$", 1)))


def repository(path: Column, roots: list[str]) -> Column:
    """The longest of the roots that holds the path."""
    best = F.lit("")
    for r in sorted((r.rstrip("/") for r in roots), key=len):
        best = F.when(path.startswith(r + "/") | (path == r), r).otherwise(best)
    return best


def documents(files: DataFrame, roots: list[str]) -> DataFrame:
    """Code files (path, content, length) as documents: UTF-8 without NUL, line ends unified."""
    rows = files.withColumn("language", language(F.col("path"))).filter(F.col("language").isNotNull() & ~F.col("path").rlike(SKIPPED) & (F.col("length") <= LIMIT))
    rows = rows.filter(F.is_valid_utf8(F.col("content").cast("string"))).withColumn("text", F.regexp_replace(F.col("content").cast("string"), "\r\n", "\n"))
    rows = rows.filter(~F.col("text").contains("\0"))
    root = repository(F.col("path"), roots)
    meta = F.create_map(F.lit("kind"), F.lit("source_code"), F.lit("language"), F.col("language"), F.lit("repository"), root, F.lit("line_count"), (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("string"))
    return rows.select(
        F.concat(F.lit("code:"), F.substring(F.sha2(F.concat_ws("\0", F.lit("code"), "path"), 256), 1, 32)).alias("id"), F.lit("code").alias("source"), "path", F.regexp_extract("path", "([^/]+)$", 1).alias("title"),
        F.col("text").alias("content"), meta.alias("metadata"), F.sha2("text", 256).alias("content_hash"), F.lit("").alias("error"),
    )
