"""Text files as documents: found, classified, decoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.sources.diff import glob_pattern

# Paths taken by default, folders left out, suffixes of text, largest size.
INCLUDE = (
    "README README.* AGENTS.md CLAUDE.md SKILL.md CHANGELOG CHANGELOG.* docs/*.md docs/*.txt docs/*.json docs/*.yaml docs/*.yml docs/**/*.md docs/**/*.txt docs/**/*.json docs/**/*.yaml docs/**/*.yml "
    "src/*.py src/*.pyi src/*.js src/*.jsx src/*.ts src/*.tsx src/*.md src/*.json src/*.yaml src/*.yml src/**/*.py src/**/*.pyi src/**/*.js src/**/*.jsx src/**/*.ts src/**/*.tsx src/**/*.md src/**/*.json src/**/*.yaml src/**/*.yml "
    "*.md *.txt *.json *.yaml *.yml *.toml"
).split()
EXCLUDE_DIRS = ".termweave .git .hg .mypy_cache .pytest_cache .ruff_cache .tox .venv __pycache__ build dist node_modules site-packages venv".split()
TEXT_SUFFIXES = ".md .mdx .txt .rst .py .pyi .js .jsx .ts .tsx .json .yaml .yml .toml .ini .cfg .conf .env .sh .bash .zsh .sql".split()
MAX_BYTES = 1_000_000


def suffix_of(path) -> Column:
    """The last suffix of the last part, lower-cased; a leading dot is no suffix."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def source_kind(path) -> Column:
    s, name = suffix_of(path), F.lower(F.regexp_extract(path, r"([^/]+)$", 1))
    return (
        F.when(s.isin(".md", ".mdx", ".rst") | name.isin("readme", "changelog"), "markdown").when(s.isin(".py", ".pyi"), "python").when(s.isin(".ts", ".tsx"), "typescript")
        .when(s.isin(".js", ".jsx"), "javascript").when(s == ".json", "json").when(s.isin(".yaml", ".yml"), "yaml").when(s == ".toml", "toml").when(s == ".txt", "text")
        .when(s.isin(*TEXT_SUFFIXES), "code").otherwise("unknown")
    )


def discover(spark: SparkSession, root: str, include=INCLUDE, exclude_dirs=EXCLUDE_DIRS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, relative_path, size_bytes, content of the files that count. Contents of others are never read."""
    base = (root if "://" in root else f"file://{root}").rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    plain = F.regexp_replace("path", "^[a-z]+:/+", "/")
    rel = F.substring(plain, F.lit(len("/" + base.split("://", 1)[1].lstrip("/")) + 2), F.length(plain))
    out = files.where(F.col("length") <= max_bytes).withColumn("relative_path", rel)
    parts = F.split(F.regexp_replace(plain, "/[^/]*$", ""), "/")
    text = suffix_of(F.col("relative_path")).isin(*TEXT_SUFFIXES) | (suffix_of(F.col("relative_path")) == "")
    wanted = F.col("relative_path").rlike("|".join(glob_pattern(g) for g in include))
    return out.where(wanted & text & ~F.arrays_overlap(parts, F.array(*map(F.lit, exclude_dirs)))).select(plain.alias("path"), "relative_path", F.col("length").alias("size_bytes"), "content")


def read_documents(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_ord by path, path, text, kind, size_bytes, line_count, sha256) and the paths that are no text."""
    binary = F.locate("00", F.hex(F.substring("content", 1, 4096))) % 2 == 1
    utf8 = F.try_validate_utf8("content") if hasattr(F, "try_validate_utf8") else F.decode("content", "UTF-8")
    wide = F.hex(F.substring("content", 1, 2)).isin("FFFE", "FEFF")
    text = F.when(wide, F.decode("content", "UTF-16")).when(~binary, F.regexp_replace(utf8, "^﻿", ""))
    read = found.withColumn("text", text)
    lines = F.size(F.split(F.regexp_replace("text", r"(\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029])$", ""), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]", -1))
    count = F.when(F.col("text") == "", 0).otherwise(lines)
    docs = read.where("text IS NOT NULL").select(F.col("relative_path").alias("path"), "text", source_kind(F.col("relative_path")).alias("kind"), "size_bytes", count.alias("line_count"), F.sha2("content", 256).alias("sha256"))
    return docs.withColumn("doc_ord", F.xxhash64("path")), read.where("text IS NULL").select("relative_path")
