"""Filter interaction audit (operator 12): what each filter removes, in every order of the filters.

Each document becomes a mask of the filters that it fails; documents are counted by (part, mask), an aggregate of
at most 32 cells a part. One Gray-code walk then visits all 32 sets of active filters, toggling one filter a
step: each mask cell has a counter of the active filters that it fails, and a cell whose counter leaves or
reaches 0 leaves or joins the running survivors. The survivors of each set are stored; what a filter removes at a
step of an order is the difference of two stored states, so 120 orders of 5 steps cost no pass over documents.
The walk is made for a batch of parts at a time, as rows of arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import settle
from .exact_dedup import SPACES

#: Letters of the filters in the order of their bits, and thresholds of their failure conditions. Fixed values.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
SYMBOLS = r"[#$%&*|]"
#: Parts that are walked and told at once; a part is 600 rows.
PARTS = 200

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails the filters A to D: too few words, too few distinct ones, too many capitals, a symbol."""
    whole = F.coalesce(text, F.lit(""))
    spaced = whole
    for s in SPACES[1:]:
        spaced = F.replace(spaced, F.lit(s), F.lit(" "))
    words = F.split(spaced, " ")
    blank = F.when(F.array_contains(words, ""), 1).otherwise(0)
    count = F.size(F.array_remove(words, ""))
    distinct = F.size(F.array_distinct(words)) - blank
    capitals = F.length(whole) - F.length(F.regexp_replace(whole, "[A-Z]+", ""))
    return [count < LEAST_WORDS, 100 * distinct.cast("long") < LEAST_DISTINCT * count, 100 * capitals.cast("long") > MOST_CAPITALS * F.length(whole), whole.rlike(SYMBOLS)]


def masks(df: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``(id, part, mask)``: a bit for each filter that the row fails. A null part is the empty string.

    The last filter fails texts that a smaller id also has, told by their SHA-256 (null texts are empty ones). Null
    ids come after all others, and none of them is smaller than another; rows that repeat an id and a text fail no
    filter for each other's sake.
    """
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_failures(F.col("text")))), F.lit(0))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    rows = settle(rows.select("id", "part", bits.alias("bits"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")))
    # only texts that several rows have are joined; what is counted with them stays apart from the join, so that a hot text can be split
    often = settle(rows.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first"))
    again = F.coalesce((F.col("id") > F.col("first")) | (F.col("id").isNull() & F.col("first").isNotNull()), F.lit(False))
    return rows.join(often, "sha", "left").select("id", "part", (F.col("bits") + F.when(again, 1 << 4).otherwise(0)).alias("mask"))


def walk(cells: np.ndarray) -> np.ndarray:
    """Survivors of every set of active filters, ``[parts, sets, kinds]``, from ``cells`` ``[parts, masks, kinds]``, by a Gray-code walk."""
    sets = cells.shape[1]
    numbers, failing = np.arange(sets), np.zeros(sets, np.int64)
    alive = cells.sum(axis=1)
    states = np.empty_like(cells)
    active = 0
    states[:, active] = alive
    for step in range(1, sets):
        bit = step & -step  # the filter that the reflected Gray code toggles
        hit = (numbers & bit) > 0
        active ^= bit
        if active & bit:
            alive = alive - cells[:, hit & (failing == 0)].sum(axis=1)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            alive = alive + cells[:, hit & (failing == 0)].sum(axis=1)
        states[:, active] = alive
    return states


def told(parts: list[str], cells: np.ndarray) -> pd.DataFrame:
    """A row for each part, order and step from the counts of documents, good and toxic ones in ``[parts, 32, 3]``."""
    states = walk(cells)
    orders = list(permutations(range(len(FILTERS))))
    letters = np.array(orders)
    after = np.bitwise_or.accumulate(1 << letters, axis=1)
    before = after ^ (1 << letters)
    lost = states[:, before] - states[:, after]  # [parts, orders, steps, kinds]
    removed = lost[..., 0]
    numbers = np.arange(cells.shape[1])
    fails = np.stack([cells[:, (numbers >> f & 1) > 0, 0].sum(axis=1) for f in range(len(FILTERS))], axis=1)
    shares = np.stack([np.where(letters == f, removed, 0).sum(axis=(1, 2)) for f in range(len(FILTERS))], axis=1)
    columns = {
        "part": np.repeat(np.array(parts, object), letters.size),
        "filter_order": np.tile(np.repeat(np.array(["".join(FILTERS[f] for f in o) for o in orders], object), letters.shape[1]), len(parts)),
        "step": np.tile(np.arange(1, letters.shape[1] + 1, dtype=np.int32), len(parts) * len(orders)),
        "kept": states[:, after][..., 0], "removed": removed, "redundant": fails[:, letters] - removed, "unique_fails": cells[:, 1 << letters, 0],
        "good_lost": lost[..., 1], "toxic_lost": lost[..., 2], "shapley": shares[:, letters],
    }
    return pd.DataFrame({c: v.reshape(-1) for c, v in columns.items()})


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row for each value of ``part`` (null: the empty string), each of the 120 orders of the filters and each step: see the contract columns in ``COUNTS``.

    ``removed``: failed at this step and not before; ``redundant``: fails this filter, but an earlier one had removed it;
    ``unique_fails``: fails this filter only; ``good_lost`` and ``toxic_lost``: removed here with a label quality = 1 or
    toxic = 1; ``shapley``: what the filter removes, summed over all orders. Texts are read whole (null: empty; empty texts fail A,
    not B or C). Rows without a label count in no label's number; of an id with several labels one of 1 is enough; a null id has none. Zeros
    are told too. An empty table gives an empty one.
    """
    marks = labels.select(F.col(id_col).alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marks = marks.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    rows = masks(df, id_col, text, part).join(marks, "id", "left")
    cells = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), PARTS):
                some = batch.iloc[start : start + PARTS]
                counts = np.zeros((len(some), 1 << len(FILTERS), 3), np.int64)
                for i, own in enumerate(some["cells"]):
                    for cell in own:
                        counts[i, cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
                yield told(list(some["part"]), counts)

    return parts.mapInPandas(walked, SCHEMA)
