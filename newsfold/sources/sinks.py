"""Sinks that a stream's ``foreachBatch`` calls: a batch that comes again after a failure changes nothing.

Without a table format, a keyed table lies in folders by a hash of its key, ``name/bucket=…``, and every row carries
the number of the last batch that it took (``_batch``). An upsert reads the buckets that its keys fall into, folds the
updates in by the table's rules, stages the result in the shared folder and then replaces these buckets (dynamic partition
overwrite). If it dies in between, the batch is folded again: rows that have its number are left as they are, the others take it now. Appended
tables lie in folders by date and batch, which a batch that comes again replaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import Scratch, ensure_checkpoint_dir
from .tables import KEYS, RULES, SCHEMAS

#: Folders that a keyed table is cut into; fixed for the life of a table.
BUCKETS = 64


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def read_keyed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A keyed table without its bookkeeping columns; before the first batch it is empty."""
    return _stored(spark, folder, name).drop("_batch", "bucket")


def _stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    schema = f"{SCHEMAS[name]}, _batch long, bucket int"
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def folded(updates: DataFrame, keys: list[str], rules: dict[str, str], order: str) -> DataFrame:
    """One row for each key of ``updates``: every column by its rule, taken in the order of ``order``. Rows without a key (a null in it) are left out."""
    how = lambda c: rules.get(c, rules.get("*", "old"))
    at = F.col(order)
    takes = {
        "max": lambda c: F.max(c), "sum": lambda c: F.sum(c), "or": lambda c: F.bool_or(c), "replace": lambda c: F.max_by(c, at),
        "new": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)), "old": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), at)),
    }
    told = updates.where(" and ".join(f"`{k}` is not null" for k in keys))
    return told.groupBy(*keys).agg(*[takes[how(c)](c).alias(c) for c in updates.columns if c not in keys and c != order], F.max(at).alias(order))


def upsert_batch(spark: SparkSession, folder: str, name: str, updates: DataFrame, batch: int, order: str) -> None:
    """Fold ``updates`` into a keyed table by its ``KEYS`` and ``RULES``: ``old`` (first wins), ``new`` (last told wins), ``replace`` (last row wins, nulls too), ``max``, ``or``, ``sum``.

    Updates may lack columns (they then say nothing of them); ``order`` tells which of several updates of a key is the last. Batches must come in the order of
    their numbers.
    """
    keys, rules = KEYS[name], RULES.get(name, {})
    columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
    scratch = Scratch(spark, f"sink-{name}")
    given = [c for c in columns if c in updates.columns]
    fresh = folded(updates.select(*given, F.col(order).alias("_order")), keys, rules, "_order").drop("_order").withColumn("bucket", _bucket(keys))
    fresh = scratch.put(fresh, "updates")
    touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # BUCKETS at most
    target = _stored(spark, folder, name).where(F.col("bucket").isin(touched))
    both = target.alias("t").join(fresh.alias("u"), [F.col(f"t.{k}") == F.col(f"u.{k}") for k in keys], "full_outer")
    told, applied = F.col(f"u.{keys[0]}").isNotNull(), F.coalesce(F.col("t._batch") >= batch, F.lit(False))

    def merged(c: str) -> Column:
        if c in keys:
            return F.coalesce(f"t.{c}", f"u.{c}").alias(c)
        if c not in given:
            return F.col(f"t.{c}").alias(c)
        old, new, how = F.col(f"t.{c}"), F.col(f"u.{c}"), rules.get(c, rules.get("*", "old"))
        value = {
            "max": F.greatest(old, new), "or": F.coalesce(old | new, old, new), "replace": new,
            "sum": F.coalesce(old + new, old, new), "new": F.coalesce(new, old), "old": F.coalesce(old, new),
        }[how]
        return F.when(applied | ~told, old).otherwise(value).alias(c)

    number = F.when(told & ~applied, F.lit(batch)).otherwise(F.col("t._batch")).cast("long").alias("_batch")
    rows = both.select(*[merged(c) for c in columns], number, F.coalesce("t.bucket", "u.bucket").alias("bucket"))
    kinds = dict(x.split(None, 1) for x in SCHEMAS[name].split(", "))
    staged = scratch.put(rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in columns], "_batch", "bucket"), "merged")
    staged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{folder}/{name}")
    scratch.clear()


def append_batch(folder: str, name: str, rows: DataFrame, batch: int, at: str = "created_at") -> None:
    """Append rows in folders by date and batch; the batch's own folders are replaced. Rows without a time go to a date of their own."""
    dated = rows.withColumn("date", F.to_date(at)).withColumn("batch", F.lit(batch).cast("long"))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(f"{folder}/{name}")


def upsert_sink(folder: str, name: str, order: str) -> Callable[[DataFrame, int], None]:
    """For ``run_stream``: every micro-batch is folded into the table."""

    def each(df: DataFrame, batch: int) -> None:
        ensure_checkpoint_dir(df.sparkSession)
        upsert_batch(df.sparkSession, folder, name, df, batch, order)

    return each


def append_sink(folder: str, name: str, at: str = "created_at") -> Callable[[DataFrame, int], None]:
    return lambda df, batch: append_batch(folder, name, df, batch, at)
