"""Rows told apart by id and text, where ids may be null or repeat and columns may have any names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_hash(id_col: str) -> Column:
    return F.xxhash64(F.col(id_col)).alias("id_hash")


def text_hash(text: str) -> Column:
    return F.xxhash64(F.col(text)).alias("text_hash")


def matched(df: DataFrame, id_col: str, text: str, picked: DataFrame) -> DataFrame:
    """``row`` (a struct of all columns of ``df``) with the columns of ``picked(id_hash, text_hash, several, …)``,
    for rows of its hashes. ``picked`` must be settled, and tells by ``several`` that ``df`` holds that id and
    text more than once and one of those rows is to be taken.
    """
    rows = df.select(F.struct("*").alias("row"), id_hash(id_col), text_hash(text))
    if not picked.where("several").isEmpty():
        often = picked.where("several").select("id_hash", "text_hash").distinct()
        once = rows.join(often, ["id_hash", "text_hash"]).dropDuplicates(["id_hash", "text_hash"])
        rows = rows.join(often, ["id_hash", "text_hash"], "left_anti").unionByName(once)
    return rows.join(picked, ["id_hash", "text_hash"])
