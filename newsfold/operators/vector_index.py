"""A persisted inverted file of article vectors: lists by nearest centroid, partitioned by day."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.tables import lookback
from .memory import LOOKBACK_DAYS, MIN_SIMILARITY, TOP, epoch_day, lists_asked, nearest_in_cells

#: Most lists of an index (so that its centroids can be sent to every task), and vectors that centroids are fitted on.
MOST_LISTS, SAMPLE = 4_096, 50_000
#: The list of vectors that have no direction of the index's length: they are compared with each other only.
REST = -1
_SLACK = 1e-6


def _usable(v: Column, size: int | None = None) -> Column:
    """Whether a vector has finite components, not all of them zero (and the given length)."""
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(sound if size is None else sound & (F.size(v) == size), F.lit(False))


def _angles(vectors: pd.Series, centroids: np.ndarray) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.arccos(np.clip(x @ centroids.T, -1, 1))


class VectorIndex:
    """Vectors ``(id, at, v)`` in ``folder``: ``centroids`` (unit vectors) and ``lists``, partitioned by day, within a day sorted by list.

    Centroids are fitted once, by cosine k-means over a bounded sample; every vector is stored, in the list of its nearest
    centroid, with its angle to it. A query asks the lists that may hold an answer: with ``probes=None`` all those that the
    list's radius and the triangle inequality of angles don't rule out, which is exact; else the ``probes`` nearest,
    which is not, and whose recall depends on how well the vectors cluster.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def fit(self, vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, rounds: int = 5, seed: int = 1) -> VectorIndex:
        """Choose and store the centroids. ``sample`` bounds the vectors that they are fitted on (about; chosen by hash of the id), ``lists``
        defaults to the square root of the number of vectors; both only steer speed and the recall of probing.

        The index's length of vectors is the most frequent one of the sample. A table without a usable vector gives an index of one list.
        """
        usable = vectors.where(_usable(F.col("v"))).select("id", "v", F.size("v").alias("size"))
        count = usable.count()
        some = usable.where(F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(count / sample)))) == 0)
        sizes = some.groupBy("size").count().orderBy(F.desc("count"), "size").first()
        size = sizes["size"] if sizes else 0
        number = min(MOST_LISTS, lists or math.ceil(math.sqrt(count))) if count else 1
        centers = []
        if size and number > 1:
            points = some.where(F.col("size") == size).select(array_to_vector(F.col("v").cast("array<double>")).alias("features"))
            centers = KMeans(k=number, maxIter=rounds, seed=seed, initMode="random", distanceMeasure="cosine").fit(points).clusterCenters()
        elif size:
            centers = [np.eye(1, size)[0]]
        made = [(i, [float(x) for x in c / np.linalg.norm(c)]) for i, c in enumerate(centers) if np.linalg.norm(c) > 0]
        self.spark.createDataFrame(made, "list int, c array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/centroids")
        return self

    def centroids(self) -> np.ndarray:
        """At most ``MOST_LISTS`` rows."""
        rows = sorted(self.spark.read.parquet(f"{self.folder}/centroids").collect())
        return np.array([r.c for r in rows]) if rows else np.zeros((0, 0))

    def append(self, vectors: DataFrame) -> None:
        """Store vectors. The days that they touch are replaced, so that writing a day again changes nothing."""
        sent = self.spark.sparkContext.broadcast(self.centroids())

        @F.pandas_udf("list int, angle double")
        def nearest(v: pd.Series) -> pd.DataFrame:
            angles = _angles(v, sent.value)
            return pd.DataFrame({"list": angles.argmin(axis=1).astype(np.int32), "angle": angles.min(axis=1)})

        usable = _usable(F.col("v"), sent.value.shape[1]) if len(sent.value) else F.lit(False)
        placed = vectors.select("id", F.col("at").cast("timestamp").alias("at"), F.col("v").cast("array<double>").alias("v"), usable.alias("usable"))
        good = placed.where("usable").withColumn("near", nearest("v")).select("id", "at", "v", "near.*")
        rest = placed.where("not usable").select("id", "at", "v", F.lit(REST).alias("list"), F.lit(0.0).alias("angle"))
        rows = good.unionByName(rest).withColumn("day", F.to_date("at"))
        rows = rows.repartitionByRange("day", "list", "id").sortWithinPartitions("day", "list")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.folder}/lists")

    def lists(self) -> DataFrame:
        return self.spark.read.schema("id long, at timestamp, v array<double>, list int, angle double, day date").parquet(f"{self.folder}/lists")

    def stored(self, first: int | None, last: int | None, days: int) -> DataFrame:
        """Rows that queries of a span of time (in microseconds) may ask for; other days' folders are not read."""
        at = lambda n: F.timestamp_micros(F.lit(n).cast("long"))
        return lookback(self.lists(), at(last), days, "at", since=at(first), day="day")

    def search(
        self, queries: DataFrame, days: int = LOOKBACK_DAYS, most: int = TOP, least: float = MIN_SIMILARITY, probes: int | None = None, block: int = 2048
    ) -> DataFrame:
        """``(id, match_id, similarity, rank)`` as :func:`find_similar` gives it, from the stored vectors.

        Each span of ``days`` is cut into cells of successive lists, of about ``block`` rows. A query goes to the cells of two spans that hold a
        list which it asks, with the lists that it asks as bits, and meets only rows of these lists. So what is shuffled is
        linear in the stored rows of these days and in queries x such cells, two where a span holds few rows, however many lists
        the index has. Cells are compared in bounded blocks, so one list may hold most rows. Ties go to the smaller id.
        """
        micros = F.unix_micros(F.col("at").cast("timestamp"))
        span = queries.agg(F.min(micros), F.max(micros)).first()
        kept = self.stored(span[0], span[1], days)
        sent = self.spark.sparkContext.broadcast((self.centroids(), self._radii(kept) if probes is None else None))
        limit = math.acos(max(-1.0, min(1.0, least))) + _SLACK

        @F.pandas_udf("binary")
        def asked(v: pd.Series) -> pd.Series:
            centroids, radii = sent.value
            angles = _angles(v, centroids)
            if radii is None:
                fit = np.zeros(angles.shape, bool)
                np.put_along_axis(fit, np.argsort(angles, axis=1, kind="stable")[:, :probes], True, axis=1)
            else:
                fit = angles - radii <= limit
            return pd.Series([row.tobytes() for row in np.packbits(fit, axis=1)])

        @F.pandas_udf("boolean")
        def asks(bits: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
            upto = np.cumsum(np.pad(lists_asked(bits), ((0, 0), (1, 0))), axis=1, dtype=np.int32)
            at = np.arange(len(bits))
            return pd.Series(upto[at, high.to_numpy() + 1] > upto[at, low.to_numpy()])

        size = sent.value[0].shape[1]
        s = kept.select(F.col("id").alias("s"), F.unix_micros("at").alias("s_at"), F.col("v").alias("s_v"), "list", F.floor(epoch_day("at") / days).alias("span"))
        counts = s.groupBy("span", "list").agg(F.count("*").alias("n"))
        before = F.sum(F.when(F.col("list") != REST, F.col("n")).otherwise(0)).over(W.partitionBy("span").orderBy("list").rowsBetween(W.unboundedPreceding, -1))
        # at most MOST_LISTS + 1 rows a span; vectors without a direction have a cell of their own
        bins = counts.select("span", "list", F.when(F.col("list") == REST, REST).otherwise(F.floor(F.coalesce(before, F.lit(0)) / block)).alias("bin"))
        cells = bins.where(F.col("list") != REST).groupBy("span", "bin").agg(F.min("list").alias("low"), F.max("list").alias("high")).select(F.col("span").alias("span"), F.col("bin").alias("bin"), "low", "high")
        rows = queries.select(F.col("id").alias("q"), micros.alias("q_at"), F.col("v").cast("array<double>").alias("q_v"), F.floor(epoch_day("at") / days).alias("last"))
        rows = rows.withColumn("usable", _usable(F.col("q_v"), size) if len(sent.value[0]) else F.lit(False))
        spans = F.explode(F.array(F.col("last"), F.col("last") - 1)).alias("span")
        good = rows.where("usable").withColumn("asked", asked("q_v")).select("q", "q_at", "q_v", "asked", spans)
        good = good.join(cells, "span").where(asks("asked", "low", "high")).drop("low", "high")
        rest = rows.where("not usable").select("q", "q_at", "q_v", F.lit(None).cast("binary").alias("asked"), spans, F.lit(REST).cast("long").alias("bin"))
        return nearest_in_cells(good.unionByName(rest), s.join(bins, ["span", "list"]), ["span", "bin"], days, most, least, block)

    def _radii(self, kept: DataFrame) -> np.ndarray:
        """The largest angle in each list, one number a list; a list without rows is never asked."""
        out = np.full(len(self.centroids()), -math.inf)
        for r in kept.where(F.col("list") != REST).groupBy("list").agg(F.max("angle").alias("radius")).collect():
            out[r["list"]] = r["radius"]
        return out
