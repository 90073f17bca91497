"""Added lines of a unified diff."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def git_diff(root: str, base: str, head: str, git: str = "git") -> str:
    """The diff of two refs without context, as text."""
    run = subprocess.run([git, "-C", root, "diff", "--unified=0", "--no-color", "--diff-filter=ACMR", f"{base}...{head}"], capture_output=True, text=True, check=False)
    if run.returncode:
        raise RuntimeError(run.stderr.strip() or "git diff failed")
    return run.stdout


def parse_added_lines(diffs: DataFrame, id_col: str = "diff_id", text_col: str = "diff") -> DataFrame:
    """diff_id, path, line_number, text of every added line; diffs has one text for each row.

    The state of the parser (file, hunk, line counter) are running functions over the lines of one diff.
    """
    rows = diffs.select(F.col(id_col).alias("diff_id"), F.posexplode(F.split(text_col, "\r?\n")).alias("pos", "row"))
    w = Window.partitionBy("diff_id").orderBy("pos")
    hunk = F.regexp_extract("row", HUNK, 1)
    marked = rows.withColumn("start", F.when(hunk != "", hunk.cast("int")))
    # a file's header lies before its hunks: lines starting with +++ inside a hunk are added text
    marked = marked.withColumn("section", F.sum(F.when(F.col("row").startswith("diff --git "), 1).otherwise(0)).over(w))
    f = Window.partitionBy("diff_id", "section").orderBy("pos")
    marked = marked.withColumn("hunk_no", F.sum(F.when(F.col("start").isNotNull(), 1).otherwise(0)).over(f))
    header = F.when((F.col("hunk_no") == 0) & F.col("row").startswith("+++ "), F.substring("row", 5, 1 << 20))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(header, "\t.*$", ""), '^"(.*)"$', "$1"), "^[abciw]/", "")
    marked = marked.withColumn("path", F.last(F.when(header == "/dev/null", F.lit("")).otherwise(plain), ignorenulls=True).over(f))
    h = Window.partitionBy("diff_id", "section", "hunk_no").orderBy("pos")
    advances = F.when(F.col("start").isNull() & (F.col("row").startswith("+") | F.col("row").startswith(" ")), 1).otherwise(0)
    numbered = marked.where("hunk_no > 0").withColumn("line_number", F.first("start").over(h) + F.sum(advances).over(h) - 1)
    added = numbered.where(F.col("start").isNull() & F.col("row").startswith("+") & (F.col("path") != ""))
    return added.select("diff_id", "path", "line_number", F.substring("row", 2, 1 << 20).alias("text"))


def added_lines(spark: SparkSession, diff: str, include: list[str] | None = None) -> DataFrame:
    """path, line_number, text of one diff; include: globs of paths."""
    out = parse_added_lines(spark.createDataFrame([(0, diff)], "diff_id int, diff string")).drop("diff_id")
    if include:
        out = out.where(F.col("path").rlike("|".join(glob_pattern(g) for g in include)))
    return out


def glob_pattern(glob: str) -> str:
    """A glob as a pattern for a whole path; a star also crosses slashes."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"
