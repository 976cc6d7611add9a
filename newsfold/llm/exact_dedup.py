"""Exact dedup (operator 4), by DataFrame functions only.

Rows are grouped by the 128-bit hash of their normalised text; an aggregation with
map-side combine finds each group's size and keeper, so that a group with a third of all
rows is a few rows a task. Then every member of a group of two or more is compared byte by
byte with its keeper's text (one join that adaptive execution may split). Groups in which
a text differs, that is hash collisions, are formed again by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import settle

#: ASCII white space, which doesn't count when texts are compared. Fixed values.
SPACES = [" ", "\t", "\n", "\x0b", "\f", "\r"]


def squeezed(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("")), SPACES, F.coalesce(text, F.lit("")))


def _best() -> Column:
    """Most code points in the original text, then the smallest id (a null id comes last)."""
    return F.min_by(F.col("_id"), F.struct((-F.col("_len")).alias("l"), F.col("_id").isNull().alias("z"), "_id")).alias("keep_id")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text", hashed: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256.

    Null and empty texts, and those of white space only, are one group (the empty text).
    Of rows that repeat an id and a text, each is counted, and each is kept if its id is
    the keeper's; :func:`keep_first` leaves one of them. An empty frame gives an empty one.
    ``hashed`` maps a text to its hash and is a parameter for tests of collisions.
    """
    norm = squeezed(F.col(text))
    rows = df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).select(
        "_id", F.coalesce(F.length("_text"), F.lit(0)).alias("_len"), squeezed(F.col("_text")).alias("_norm")
    )
    keyed = rows.select("_id", "_len", hashed(F.col("_norm")).alias("_h"), F.sha2("_norm", 256).alias("text_sha256"))
    keyed = settle(keyed)
    groups = settle(keyed.groupBy("_h").agg(_best(), F.count("*").alias("group_size")))  # apart from the joins, which can so be split

    # bytes inside groups: every member against its keeper
    texts = df.select(F.col(id_col).alias("_id"), norm.alias("_norm")).withColumn("_h", hashed(F.col("_norm")))
    several = groups.where("group_size > 1").select("_h", F.col("keep_id").alias("_id"))
    models = texts.join(several, ["_h", "_id"], "left_semi").select("_h", F.col("_norm").alias("_model"))
    clash = settle(texts.join(models, "_h").where("_norm <> _model").select("_h"))  # no aggregate here: hot joins can be split
    clash = clash.distinct()

    if clash.isEmpty():
        out = keyed.join(groups, "_h")
    else:  # rare: the hash of the text and the text itself
        odd = texts.join(clash, "_h", "left_semi").join(keyed.select("_h", "_id", "_len").distinct(), ["_h", "_id"])
        split = odd.groupBy("_h", "_norm").agg(_best(), F.count("*").alias("group_size"))
        again = split.withColumn("text_sha256", F.sha2("_norm", 256)).drop("_norm")
        plain = keyed.join(clash, "_h", "left_anti").join(groups, "_h")
        out = plain.unionByName(keyed.join(clash, "_h", "left_semi").join(again, ["_h", "text_sha256"]))
    kept = F.col("_id").eqNullSafe(F.col("keep_id"))
    return out.select(F.col("_id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")


def keep_first(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, one for each distinct text, with all their columns.

    Of rows that repeat the keeper's id and its text, any one stays. No column name is reserved.
    """
    kept = exact_groups(df, id_col, text).where("kept").select(F.col(id_col).alias("id"), "text_sha256")
    kept = settle(kept.groupBy("id", "text_sha256").agg((F.count("*") > 1).alias("several")))
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("own_id"), F.sha2(squeezed(F.col(text)), 256).alias("sha"))
    rows = rows.join(kept, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("text_sha256")))
    if not kept.where("several").isEmpty():
        rows = rows.where("not several").unionByName(rows.where("several").dropDuplicates(["own_id", "sha"]))
    return rows.select("row.*")
