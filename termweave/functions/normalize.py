"""Unicode normalisation of text for matching, with a map back to the original offsets.

Plain rows (printable ASCII without runs of blanks) need no change and never leave the JVM; only the others go through
Arrow.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.constants import BIDI_CONTROLS, ZERO_WIDTH

UNPLAIN = r"[^\x20-\x7E]|  "
RESULT = "norm string, index_map array<int>, findings array<struct<kind:string,start:int,`end`:int,text:string,replacement:string,name:string>>"


def normalize(text: str) -> tuple[str, list[int], list[dict]]:
    """Text without bidirectional controls, compatibility forms replaced, all white space single blanks."""
    out, back, findings = [], [], []

    def note(kind: str, at: int, ch: str, by: str) -> None:
        findings.append({"kind": kind, "start": at, "end": at + 1, "text": ch, "replacement": by, "name": unicodedata.name(ch, "UNKNOWN")})

    for at, ch in enumerate(text):
        if ch in BIDI_CONTROLS:
            note("bidi_control", at, ch, "")
            continue
        if ch in ZERO_WIDTH or (ch.isspace() and ch != " "):
            note("zero_width" if ch in ZERO_WIDTH else "non_ascii_space", at, ch, " ")
            new = " "
        else:
            new = unicodedata.normalize("NFKC", ch)
            if new != ch:
                note("compatibility", at, ch, new)
        for c in new:
            c = " " if c.isspace() else c
            if c == " " and out and out[-1] == " ":
                continue
            out.append(c)
            back.append(at)
    return "".join(out), back, findings


def _rows(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([normalize(t or "") for t in texts], columns=["norm", "index_map", "findings"])


def with_normalized(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds norm, index_map (null where offsets are the same) and findings."""
    safe = F.coalesce(F.col(text), F.lit(""))
    plain = ~safe.rlike(UNPLAIN)
    none = F.array().cast("array<struct<kind:string,start:int,`end`:int,text:string,replacement:string,name:string>>")
    same = df.where(plain).withColumns({"norm": safe, "index_map": F.lit(None).cast("array<int>"), "findings": none})
    changed = df.where(~plain).withColumn("_n", F.pandas_udf(_rows, RESULT)(safe))
    changed = changed.withColumns({"norm": F.col("_n.norm"), "index_map": F.col("_n.index_map"), "findings": F.col("_n.findings")}).drop("_n")
    return same.unionByName(changed)


def original_start(start, index_map):
    return F.when(index_map.isNull(), start).otherwise(F.get(index_map, start))


def original_end(end, index_map):
    return F.when(index_map.isNull(), end).otherwise(F.get(index_map, end - 1) + 1)


def unicode_metadata(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds changed and has_bidi to the normalised columns."""
    n = with_normalized(df, text)
    return n.withColumns({"changed": ~F.col("norm").eqNullSafe(F.col(text)), "has_bidi": F.exists("findings", lambda f: f["kind"] == "bidi_control")})
