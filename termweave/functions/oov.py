"""Pluggable scores of how far a tokenizer breaks a surface up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions import score as S
from termweave.functions.text import fragments

PIECES = "pieces int, continued int, unknown int"


def with_tokenizer(df: DataFrame, load: Callable[[], Callable[[str], list[str]]], surface: str = "surface") -> DataFrame:
    """Adds oov_tokenizer_score. load gives a function from a surface to its tokens; it runs once for each task.

    Each distinct surface is tokenized once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens_of = load()
        for b in batches:
            rows = []
            for s in b[surface]:
                ts = tokens_of(s)
                rows.append((s, len(ts), sum(t.startswith(("##", "@@")) for t in ts), sum(t.lower() in ("[unk]", "<unk>", "unk") for t in ts)))
            yield pd.DataFrame(rows, columns=[surface, "pieces", "continued", "unknown"])

    counted = df.select(surface).distinct().mapInPandas(run, f"{surface} string, {PIECES}")
    value: Column = S.tokenizer_oov("pieces", "unknown", "continued", F.size(fragments(surface)), S.oov_proxy(surface))
    return df.join(counted.select(surface, value.alias("oov_tokenizer_score")), surface, "left")
