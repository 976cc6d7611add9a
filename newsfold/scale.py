"""Helpers that several operators share: lineage cuts, components, running totals.

All of them work on narrow keyed rows, shuffle by bounded groups and send at
most a few numbers per partition or per bucket to the driver.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``. Where it is unset, a local session (as in tests) gets a
    folder of its own; on a cluster that is an error, as machines don't share their folders."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="newsfold-checkpoint-"))


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of whatever file system Spark can write to; one that isn't there is no error."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame, *keys: Column | str, rows: int = 200_000) -> DataFrame:
    """``df`` by ``keys`` in as many parts as its rows ask, about ``rows`` each; what is grouped by these keys and more stays where it is.

    Adaptive execution joins parts by their compressed bytes, of which sorted and repetitive rows take few, so that the memory of a task grows with the table.
    """
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(least, -(-df.count() // rows)), *keys)


def spread_hot(df: DataFrame, keys: list[str], by: str, out: str, rows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """``df`` as :func:`spread` gives it by ``keys`` and ``out``, and the table ``(keys…, _parts)`` of the keys of more than ``rows`` rows.

    Those are dealt over ``_parts`` parts by hash of the column ``by``: ``out`` numbers them from 0; it is 0 for all other keys. Keys must not be null.
    """
    hot = settle(df.groupBy(*keys).agg(F.ceil(F.count("*") / rows).alias("_parts")).where("_parts > 1"))  # at most a row for every ``rows`` rows
    dealt = df.join(F.broadcast(hot), keys, "left").withColumn(out, F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    return spread(dealt, *keys, out, rows=rows), hot


class Scratch:
    """A folder of one run of an operator below ``spark.checkpoint.dir``. What is put there survives lost executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        ensure_checkpoint_dir(spark)
        self.spark, self.root = spark, f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str, *parts: str) -> DataFrame:
        """Write ``df`` as Parquet, in folders by the columns ``parts``, and read it again."""
        df.write.mode("overwrite").partitionBy(*parts).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.root}/{name}")

    def clear(self) -> None:
        delete(self.spark, self.root)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(id, component)`` of the undirected graph ``edges(src, dst)``; component = smallest id.

    Alternates large-star and small-star steps: every step is one aggregation (with
    map-side combine) and one join that adaptive execution may split, so that a node
    with very many neighbours is no hot task. Null ends and loops are ignored; nodes
    without an edge to another node don't appear. Empty edges give an empty frame.
    """
    # rounds are written tables and not checkpoints: those keep the planner's size of their joins, a product that squares itself in every round
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.put(
        edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
        .where("a is not null and b is not null and a <> b").distinct(), "round-0"
    )
    seen, count = None, now.count()
    for number in range(1, rounds + 1):
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        # few edges stay in few files: a partition for each 20,000 of the round before, up to the shuffle's own number
        now = scratch.put(small.select("e.*").where("a <> b").distinct().coalesce(count // 20_000 + 2), f"round-{number}")
        scratch.drop(f"round-{number - 1}")
        sign = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.expr("cast(pmod(xxhash64(b, a), 1000003) as long)"))).first()
        if sign == seen:
            break
        seen, count = sign, sign[0]
    else:
        raise RuntimeError("components did not converge")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    found = settle(now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(roots))
    scratch.clear()
    return found


def global_rank(df: DataFrame, *order: Column | str, out: str = "rank") -> DataFrame:
    """Add ``out``: 0, 1, ... in the order given. A range sort, then one count a partition."""
    placed = settle(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).cast("int")
    counts = dict(placed.groupBy(part.alias("p")).agg(F.count("*")).collect())
    before, start = 0, []
    for p in sorted(counts):
        start.append((p, before))
        before += counts[p]
    base = F.broadcast(df.sparkSession.createDataFrame(start, "_part int, _base long"))  # a row a partition
    ranked = placed.withColumn("_part", part).join(base, "_part")
    return ranked.withColumn(out, F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_base")


def running_total(
    df: DataFrame, by: list[str], order: str, value: Column | str, out: str = "before", group_rows: int = 20_000,
    ties: list[str] | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier rows (by ``order``, an integral
    column with well-spread values such as a hash) of the same ``by`` keys.

    A key may hold most of all rows, so each key is cut into ranges of ``order`` of about
    ``group_rows`` rows (their number follows the key's count); sums of ranges are added up
    first and rows only within their range. Rows with equal ``order`` share one range and are
    taken by value, then by the columns ``ties``. Null keys are a key of their own; the column
    order must not be null.
    """
    value = F.col(value) if isinstance(value, str) else value
    df = df.withColumn("_v", F.coalesce(value, F.lit(0)).cast("long"))
    keys = [(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_k{i}"), F.col(k).isNull().alias(f"_z{i}")) for i, k in enumerate(by)]
    df = df.select("*", *(c for pair in keys for c in pair))
    names = [f"_{x}{i}" for i in range(len(by)) for x in "kz"]
    # cells: 4096 equal ranges of the 64-bit order, their counts and sums; one row per key and cell
    cell = F.shiftright(F.col(order), 52)
    df = df.withColumn("_cell", cell)
    cells = df.groupBy(*names, "_cell").agg(F.sum("_v").alias("_cs"), F.count("*").alias("_cn"))
    w = W.partitionBy(*names).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("_base", F.coalesce(F.sum("_cs").over(w), F.lit(0))).withColumn("_parts", F.ceil(F.col("_cn") / group_rows))
    df = df.join(cells.select(*names, "_cell", "_base", "_parts"), [*names, "_cell"])
    # a cell of more than group_rows rows is cut again by the next bits of the order
    df = df.withColumn("_part", F.when(F.col("_parts") > 1, F.floor(F.shiftright(F.col(order), 20).bitwiseAND(F.lit((1 << 32) - 1)) * F.col("_parts") / F.lit(1 << 32))).otherwise(F.lit(0)).cast("long"))
    within = W.partitionBy(*names, "_cell", "_part").orderBy(order, "_v", *(ties or []))
    df = df.withColumn("_in", F.sum("_v").over(within.rowsBetween(W.unboundedPreceding, -1)))
    parts = df.groupBy(*names, "_cell", "_part").agg(F.sum("_v").alias("_ps"))
    pw = W.partitionBy(*names, "_cell").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("_pbase", F.coalesce(F.sum("_ps").over(pw), F.lit(0))).drop("_ps")
    df = df.join(parts, [*names, "_cell", "_part"])
    total = F.col("_base") + F.col("_pbase") + F.coalesce(F.col("_in"), F.lit(0))
    return df.withColumn(out, total.cast("long")).drop("_v", "_cell", "_cs", "_cn", "_base", "_parts", "_part", "_in", "_pbase", *names)


def carried(df: DataFrame, by: list[str], order: list[str], chunk: Column, last: dict[str, str] | None = None, most: dict[str, str] | None = None) -> DataFrame:
    """Add columns that look back over all earlier rows (by ``order``) of the same ``by`` keys.

    ``last``: result -> column, its latest non-null value; ``most``: result -> column, its
    greatest value. A key may hold most of all rows: ``chunk``, which must grow with the
    order (say, the hour), cuts it into pieces; one row a piece carries values from piece to
    piece, and rows look back only within theirs. Ties in ``order`` are taken as one engine's
    sort gives them, so the order should be unique. Null keys are a key of their own.
    """
    last, most = last or {}, most or {}
    df = df.withColumn("_chunk", chunk)
    at = F.struct(*order)
    ends = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_e_{o}") for o, c in last.items()] + [F.max(c).alias(f"_e_{o}") for o, c in most.items()]
    pieces = df.groupBy(*by, "_chunk").agg(*ends)
    w = W.partitionBy(*by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = [F.last(f"_e_{o}", ignorenulls=True).over(w).alias(f"_c_{o}") for o in last] + [F.max(f"_e_{o}").over(w).alias(f"_c_{o}") for o in most]
    pieces = pieces.select(*[F.col(k).alias(f"_p{i}") for i, k in enumerate([*by, "_chunk"])], *carry)
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_p{i}")) for i, k in enumerate([*by, "_chunk"])))
    joined = df.join(pieces, same).drop(*[f"_p{i}" for i in range(len(by) + 1)])
    within = W.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    for o, c in last.items():
        joined = joined.withColumn(o, F.coalesce(F.last(c, ignorenulls=True).over(within), F.col(f"_c_{o}")))
    for o, c in most.items():
        joined = joined.withColumn(o, F.greatest(F.max(c).over(within), F.col(f"_c_{o}")))
    return joined.drop("_chunk", *[f"_c_{o}" for o in [*last, *most]])


def cut_by_time(df: DataFrame, by: list[str], at: str, out: str = "cut", rows: int = 20_000) -> DataFrame:
    """Add ``out``, a ``(day, part)`` that grows with the time ``at`` and cuts each key's days into parts of about ``rows`` rows.

    The number of a day's parts follows its count, so that a key may hold most rows; parts are equal spans of the day. Null keys are a key of their own.
    """
    days = df.groupBy(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(by)], F.to_date(at).alias("_day")).agg(F.ceil(F.count("*") / rows).alias("_parts"))
    second = F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    part = F.floor(second * F.col("_parts") / 86_400).cast("int")
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(by)), F.to_date(at).eqNullSafe(F.col("_day")))
    return df.join(days, same).withColumn(out, F.struct(F.col("_day").alias("day"), part.alias("part"))).drop("_day", "_parts", *[f"_s{i}" for i in range(len(by))])


def cut_by_number(df: DataFrame, by: list[str], at: str, out: str = "cut", rows: int = 20_000) -> DataFrame:
    """Add ``out``, a number that grows with the number ``at`` and cuts each key into equal spans of ``at``, of about ``rows`` rows where it is well spread.

    The number of a key's spans follows its count, so that a key may hold most rows. Null keys are a key of their own; rows without ``at`` have no span.
    """
    spans = df.groupBy(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(by)]).agg(F.min(at).alias("_low"), F.max(at).alias("_high"), F.ceil(F.count("*") / rows).alias("_parts"))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(by)))
    span = F.floor((F.col(at).cast("double") - F.col("_low")) * F.col("_parts") / (F.col("_high").cast("double") - F.col("_low") + 1))
    return df.join(spans, same).withColumn(out, span).drop("_low", "_high", "_parts", *[f"_s{i}" for i in range(len(by))])
