"""Line dedup (operator 11), by DataFrame and SQL functions only.

A line that many documents hold (licence lines, menus, footers) stays in one of them. What is known of
lines lies in levelled sorted runs: a run is a table of (hash, documents, keeper), bucketed and sorted by the
128-bit hash of the line's key, so that runs meet each other and a new batch's hashes by merging buckets,
without a shuffle of theirs. A batch of documents drops the hashes that the runs have settled (a merge anti-join
with each run) and adds a run of the others. Every ``fanout`` runs of a level are compacted into one of the
next. Which runs are live follows from the number of batches alone (its digits in base ``fanout``), so there is no
list to keep: a batch that is absorbed again after a failure writes the same run again.

A whole table is absorbed in batches of descending ids. So the first batch that holds a line holds the document
that keeps it, and a line counted in ``least`` documents is settled: later batches need not write it again,
which keeps the runs small though a third of all documents may share a line.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import Scratch, delete, settle
from .rows import id_hash, text_hash

#: Key of a line: white space at both ends that doesn't count, letters that are lower-cased, least length and documents. Fixed values.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_DOCUMENTS = 40, 5


def line_key(line: Column) -> Column:
    """The line without blanks at both ends and with A-Z lower-cased; pure ASCII takes Spark's faster ``lower``."""
    inner = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(inner) == F.length(inner), F.lower(inner)).otherwise(F.translate(inner, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_lines(df: DataFrame, id_col: str, text: str, least_length: int) -> DataFrame:
    """``(id, id_hash, text_hash, pos, h1, h2)`` of every line whose key has ``least_length`` code points or more."""
    rows = df.select(F.col(id_col).alias("id"), id_hash(id_col), text_hash(text), F.posexplode(_lines(F.col(text))).alias("pos", "line"))
    keyed = rows.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= least_length)
    return keyed.select("id", "id_hash", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


class LineRuns:
    """Levelled sorted runs in ``folder``; batches are numbered 0, 1, ... and absorbed in that order.

    ``keys`` of a batch are ``(h1, h2, docs, keeper)``, one row a hash. Batches must share no document. Where they
    come in descending order of ids, the keeper (the largest id) of a settled hash is final.
    ``buckets`` is fixed for the life of the folder.
    """

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "bigint", fanout: int = 2, least: int = LEAST_DOCUMENTS, buckets: int | None = None) -> None:
        self.spark, self.folder, self.id_type, self.fanout, self.least = spark, folder, id_type, fanout, least
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.prefix = "line_runs_" + hashlib.md5(folder.encode()).hexdigest()[:16]

    def live(self, batches: int) -> list[tuple[int, int]]:
        """The runs, as ranges of batches, that hold what ``batches`` batches told; the oldest and largest first."""
        spans, start, size = [], 0, 1
        while size * self.fanout <= batches:
            size *= self.fanout
        while size:
            for _ in range((batches - start) // size):
                spans.append((start, start + size))
                start += size
            size //= self.fanout
        return spans

    def run(self, span: tuple[int, int]) -> DataFrame:
        return self.spark.table(self._attach(span))

    def _name(self, span: tuple[int, int]) -> str:
        return f"{self.prefix}_{span[0]}_{span[1]}"

    def _attach(self, span: tuple[int, int]) -> str:
        """The run's table; its files may be those of an earlier session."""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._name(span)} (h1 BIGINT, h2 BIGINT, docs BIGINT, keeper {self.id_type}) USING parquet "
            f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/run-{span[0]}-{span[1]}'"
        )
        return self._name(span)

    def _write(self, df: DataFrame, span: tuple[int, int]) -> None:
        df.select("h1", "h2", F.col("docs").cast("long").alias("docs"), F.col("keeper").cast(self.id_type).alias("keeper")).write.insertInto(self._attach(span), overwrite=True)

    def _forget(self, span: tuple[int, int]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(span)}")
        delete(self.spark, f"{self.folder}/run-{span[0]}-{span[1]}")

    def absorb(self, keys: DataFrame, batch: int) -> None:
        """Add batch number ``batch``: its hashes that no run has settled, as a run; then compact what is due.

        Runs that a compaction has replaced are deleted only once the next batch comes, so that a
        batch that failed halfway can be absorbed again.
        """
        known = self.live(batch)
        for span in self._replaced(batch):
            self._forget(span)
        for span in known:
            keys = keys.join(self.run(span).where(F.col("docs") >= self.least).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self._write(keys, (batch, batch + 1))
        size = 1
        while (batch + 1) % (size * self.fanout) == 0:
            parts = [(start, start + size) for start in range(batch + 1 - size * self.fanout, batch + 1, size)]
            size *= self.fanout
            self._write(self._merged(parts), (batch + 1 - size, batch + 1))

    def _replaced(self, batches: int) -> list[tuple[int, int]]:
        """Runs that the compactions after the batch before ``batches`` have replaced."""
        out, size = [], 1
        while batches and batches % (size * self.fanout) == 0:
            out += [(start, start + size) for start in range(batches - size * self.fanout, batches, size)]
            size *= self.fanout
        return out

    def _merged(self, spans: list[tuple[int, int]]) -> DataFrame:
        """Runs merged pairwise, by full outer joins of tables that are bucketed and sorted alike (a union of such tables would have to be shuffled)."""

        def pair(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.withColumnsRenamed({"docs": "more", "keeper": "other"})
            docs = F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))
            return a.join(b.hint("merge"), ["h1", "h2"], "full").select("h1", "h2", docs.alias("docs"), F.greatest("keeper", "other").alias("keeper"))

        return reduce(pair, map(self.run, spans))

    def settled(self, batches: int) -> DataFrame:
        """``(h1, h2, keeper)`` of the hashes that ``least`` documents or more of the first ``batches`` batches hold."""
        if not batches:
            return self.spark.createDataFrame([], f"h1 long, h2 long, keeper {self.id_type}")
        return self._merged(self.live(batches)).where(F.col("docs") >= self.least).select("h1", "h2", "keeper")

    def clear(self) -> None:
        for row in self.spark.sql(f"SHOW TABLES LIKE '{self.prefix}_*'").collect():
            self.spark.sql(f"DROP TABLE IF EXISTS {row.tableName}")
        delete(self.spark, self.folder)


def batch_keys(lines: DataFrame) -> DataFrame:
    """``(h1, h2, docs, keeper)``: documents that hold a hash, and the largest of their ids; a line with a third of all rows is a few rows a task."""
    once = lines.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    return once.groupBy("h1", "h2").agg(F.count("one").alias("docs"), F.max("id").alias("keeper"))


def dropped_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least: int = LEAST_DOCUMENTS, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``(id_hash, text_hash, dropped)``: positions of the lines that go, of documents that lose any."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "lines")
    cuts = [1 - i / batches for i in range(1, batches)]
    bounds = (df.select(F.percentile_approx(id_col, cuts, 1000)).first()[0] if cuts else None) or []
    number = sum(((F.col("id") < b).cast("int") for b in bounds), F.lit(0))
    # a null id is no number: the last batch takes it
    lines = scratch.put(long_lines(df, id_col, text, least_length).withColumn("batch", F.coalesce(number, F.lit(len(bounds)))), "lines", "batch")
    runs = LineRuns(spark, f"{scratch.root}/runs", dict(df.dtypes)[id_col], fanout, least)
    for batch in range(len(bounds) + 1):
        runs.absorb(batch_keys(lines.where(F.col("batch") == batch)), batch)
    common = settle(runs.settled(len(bounds) + 1))
    hits = lines.join(common, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper"))).select("id_hash", "text_hash", "pos")
    found = settle(hits.groupBy("id_hash", "text_hash").agg(F.collect_set("pos").alias("dropped")))  # as many as a document has lines
    runs.clear()
    scratch.clear()
    return found


def drop_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", **settings: int) -> DataFrame:
    """``(row, kept_text, n_lines, n_dropped)``: ``row`` is a struct of all columns of ``df``, whatever their names.

    Lines end at ``\\n``; a null or empty text is one empty line. A key (see :func:`line_key`) of ``least_length`` code
    points or more, found in ``least`` documents or more, loses all its lines but those of the largest id that holds
    it; that document keeps every one of its lines with that key. A document is an id: rows that repeat an id are parts of one, and rows
    without an id (null, smaller than all others) are one document too. Other lines stay, joined by ``\\n``; a text of which
    nothing stays is empty. An empty table gives an empty one. Ids must be numbers.
    """
    found = dropped_lines(df, id_col, text, **settings)
    whole = F.coalesce(F.col("text"), F.lit(""))
    rows = df.select(F.struct("*").alias("row"), F.col(text).alias("text"), id_hash(id_col), text_hash(text)).join(found, ["id_hash", "text_hash"], "left")
    count = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    stay = F.array_except(F.sequence(F.lit(0), count - 1), F.col("dropped"))
    # the lines are an argument of the outer transform, so that the text is split once and not once a line
    rest = F.get(F.transform(F.array(_lines(F.col("text"))), lambda lines: F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")), F.lit(0))
    kept = F.when(F.col("dropped").isNull(), whole).otherwise(rest)
    return rows.select("row", kept.alias("kept_text"), count.cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))


def without_common_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", **settings: int) -> DataFrame:
    """``df`` with the text of each row reduced to the lines that stay (see :func:`drop_lines`)."""
    row = F.col("row")
    out = drop_lines(df, id_col, text, **settings)
    return out.select(*[F.when(row[text].isNotNull(), F.col("kept_text")).alias(c) if c == text else row[c].alias(c) for c in df.columns])


def digests(df: DataFrame, id_col: str = "doc_id", text: str = "text", **settings: int) -> DataFrame:
    """Per row of ``df``: id, ``n_lines`` before dropping, ``n_dropped``, ``kept_sha256`` of the text that stays (see :func:`drop_lines` for nulls and ties)."""
    out = drop_lines(df, id_col, text, **settings)
    return out.select(F.col("row")[id_col].alias(id_col), "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
