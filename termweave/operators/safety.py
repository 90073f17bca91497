"""Instruction-like content in untrusted text: rules over three views of it, summed up by document and risk.

Views: each line, its normalised form where that differs, and a document's lines joined. Rows that no rule can hit are
sorted out in the JVM; only the rest go through Arrow for the places of the hits.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.constants import RISK_RANK, SAFETY_RULES
from termweave.functions.normalize import normalize
from termweave.functions.text import sanitize

FOUND = "array<struct<rule_id:string,risk:string,line_number:int,matched_text:string,scope:string>>"
#: Any rule's first words, with anything that normalisation may change between them.
LIKELY = r"(?iU)[^\x00-\x{17E}]|[ªºĲĳĿŀŉ]|ignore|disregard|forget|reveal|print|show|dump|output|send|exfiltrate|upload|leak|copy|call|run|execute|invoke|rm\s+-rf|you\s+are|act\s+as|do\s+not|<|###|begin\s+system|end\s+system"


def find(text: str) -> list[dict]:
    """Findings in a text: each rule, line and matched text once, the first view wins."""
    rules = [(r, k, re.compile(p, re.IGNORECASE)) for r, k, p in SAFETY_RULES]
    rows, seen, out = text.splitlines(), set(), []

    def scan(view: str, scope: str, line_of) -> None:
        for rule, risk, pattern in rules:
            for m in pattern.finditer(view):
                said = " ".join(m.group().split())
                said = said if len(said) <= 120 else said[:119] + "…"
                key = (rule, line_of(m.start()), said.casefold())
                if key not in seen:
                    seen.add(key)
                    out.append({"rule_id": rule, "risk": risk, "line_number": key[1], "matched_text": said, "scope": scope})

    for n, row in enumerate(rows, 1):
        scan(row, "line", lambda _, n=n: n)
        plain = normalize(row)[0]
        if plain != row:
            scan(plain, "normalized_line", lambda _, n=n: n)
    joined, starts = "", []
    for n, row in enumerate(rows):
        starts.append(len(joined))  # the blank that joins two lines belongs to the second
        joined += (" " if n else "") + normalize(row)[0]
    scan(joined, "joined_window", lambda p: bisect_right(starts, p))
    return out


def _rows(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: find(t or ""))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rule_id, risk, line_number, matched_text, scope: one row for each finding."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = base.where(F.col("text").rlike(LIKELY)).select("doc_id", F.explode(F.pandas_udf(_rows, FOUND)("text")).alias("f"))
    return found.select("doc_id", "f.*")


def rank(c):
    out = F.lit(0)
    for name, r in RISK_RANK.items():
        out = F.when(c == name, r).otherwise(out)
    return out


def rollup(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """For every document: counts by risk, the highest risk and whether a model may read it."""
    by = findings.groupBy("doc_id").agg(*[F.count_if(F.col("risk") == r).alias(f"{r}_count") for r in ("high", "medium", "low")], F.max(rank(F.col("risk"))).alias("r"))
    out = docs.select(F.col(id_col).alias("doc_id")).join(by, "doc_id", "left").fillna(0, ["high_count", "medium_count", "low_count", "r"])
    top = F.when(F.col("r") == 3, "high").when(F.col("r") == 2, "medium").when(F.col("r") == 1, "low").otherwise("none")
    action = F.when(F.col("r") == 3, "block_llm_review").when(F.col("r") > 0, "review_required").otherwise("allow")
    return out.select("doc_id", "high_count", "medium_count", "low_count", top.alias("highest_risk"), action.alias("action"))


def pack_for_review(packs: DataFrame, longest: int | None = None) -> DataFrame:
    """key, rendered: an evidence pack as text that a model reads as data only."""
    lines_ = lambda n: F.array_join(F.transform(F.coalesce(f"{n}_snippets", F.expr(f"{n}_snippets")), lambda s: F.concat_ws(" ", F.lit(f"[{n}]"), F.concat(s["path"], F.lit(":"), s["start_line"], F.lit("-"), s["end_line"]), s["text"])), "\n")
    text = F.concat_ws("\n", F.concat(F.lit("surface: "), F.col("surface")), lines_("positive"), lines_("negative"))
    return packs.select("key", sanitize(text, longest).alias("rendered"))
