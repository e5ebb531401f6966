"""Training rows: labels that hide the prompt, and batches of bounded padding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIDDEN = -100


def masked_example(prompt: Column, response: Column, end: int | None, most: int) -> Column:
    """Struct (input_ids, labels, length): prompt and response ids with the prompt's labels hidden, cut to ``most``."""
    body = response if end is None else F.when(F.try_element_at(response, F.lit(-1)) == end, response).otherwise(F.concat(response, F.array(F.lit(end).cast("long"))))
    ids = F.slice(F.concat(prompt, body), 1, most)
    labels = F.slice(F.concat(F.array_repeat(F.lit(HIDDEN).cast("long"), F.size(prompt)), body), 1, most)
    return F.struct(ids.alias("input_ids"), labels.alias("labels"), F.size(ids).alias("length"))


def token_batches(rows: DataFrame, group: str, order: str, length: str, most_rows: int = 12, most_tokens: int = 16384) -> DataFrame:
    """Deal the rows of each group to batches in order: a batch ends before it has too many rows or padded tokens."""

    def deal(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        out, batch, n, longest = [], 0, 0, 0
        for x in part[length]:
            if n and (n + 1 > most_rows or (n + 1) * max(longest, x) > most_tokens):
                batch, n, longest = batch + 1, 0, 0
            n, longest = n + 1, max(longest, x)
            out.append(batch)
        return pd.DataFrame({group: part[group], order: part[order], "batch": out})

    kinds = dict(rows.dtypes)
    return rows.select(group, order, length).groupBy(group).applyInPandas(deal, f"`{group}` {kinds[group]}, `{order}` {kinds[order]}, batch long")
