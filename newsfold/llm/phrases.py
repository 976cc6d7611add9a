"""Phrase collocation mining (operator 13) by dynamic itemset counting.

The corpus is cut into shards that are scanned in a cycle. Words are counted from the first scan on. As soon as both
subphrases of a longer phrase have reached the threshold (both words of a pair; both pairs of a triple), the phrase is
counted too, from the next shard on, until it has seen each shard once, so that lengths are interleaved instead
of taking a pass each. A phrase whose subphrases never reach the threshold is never counted: it can't reach it either.

Which subphrases reached the threshold after which scan is told to the workers by bitmaps, one for each
scan and length, whose size is a parameter. A phrase that meets another one's bit only has longer ones counted in vain: they too
are counted in every shard once, and counts are compared with the threshold exactly. So results don't depend on the
bitmaps, and their size bounds what is broadcast. Counting is done by arrays in the workers, some million words at a time
(map-side), and summed by Spark. A phrase is keyed by 64-bit numbers of its words; words are counted with their
spelling, so that two words with one number are seen, and all are numbered anew by another seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scale import Scratch, settle

#: Bytes that end a piece, least count of a candidate, share of a longer phrase that hides it, scale of scores. Fixed values.
ENDS, LEAST, HIDDEN, SCALE = b".,;:!?\n\x0b\x0c\r", 10, 50, 1_000_000
UNKNOWN, BEST = "und", 2_000
#: Shards of a cycle, bits of a bitmap of words (one of pairs has four times as many), words that a worker counts at once.
SHARDS, BITS, CHUNK = 2, 1 << 23, 3_000_000

#: Every ending becomes a point, which no word can hold; a tab becomes a blank.
_PLAIN = bytes.maketrans(ENDS + b"\t", b"." * len(ENDS) + b" ")
_NEVER = 1 << 20


def tokens(text: bytes) -> list[bytes]:
    """Words in order, A-Z lower-cased, with ``b"."`` between pieces (and empty ones where blanks meet)."""
    return text.lower().translate(_PLAIN).replace(b".", b" . ").split(b" ")


def spelled(lang: str, words: list[bytes]) -> list[bytes]:
    """Language and word in one, as words are counted."""
    before = lang.encode() + b"\x00"
    return [before + w for w in words]


def numbered(words: list[bytes], seed: int) -> np.ndarray:
    """A number other than 0 for each spelled word."""
    out = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))
    return np.maximum(out, np.uint64(1))


class Ids(dict):
    """Places of words in order of appearance: 0 is the end of a piece, 1 the empty word."""

    def __init__(self) -> None:
        super().__init__({b".": 0, b"": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Filters:
    """For words and pairs: bitmaps of those that reached the threshold after scan 0, 1, ..."""

    def __init__(self, bits: int, seed: int = 0) -> None:
        self.bits, self.seed, self.maps = {1: bits, 2: 4 * bits}, seed, {1: {}, 2: {}}

    def since(self, length: int, at: np.ndarray) -> np.ndarray:
        """The scan after which each phrase counts as frequent; ``_NEVER`` if it doesn't."""
        out = np.full(len(at), _NEVER, np.int64)
        at = (at & np.uint64(self.bits[length] - 1)).astype(np.int64)
        for scan in sorted(self.maps[length], reverse=True):
            out[(self.maps[length][scan][at >> 3] >> (at & 7).astype(np.uint8) & 1) > 0] = scan
        return out


def pair_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a ^ (b >> np.uint64(20))


def count_chunk(lang: str, ids: Ids, seq: np.ndarray, scan: int, shards: int, filters: Filters) -> Iterator[tuple[list[np.ndarray], list[bytes] | None, np.ndarray]]:
    """``([first, second, third], spelling, counts)`` of what is active in this scan, of the words ``seq`` (their places) of some texts of one language."""
    seq = seq[seq != 1].astype(np.int64)
    names = spelled(lang, list(ids))
    word, many = numbered(names, filters.seed), len(ids)
    nothing = lambda n: np.zeros(n, np.uint64)
    if scan < shards:
        counts = np.bincount(seq, minlength=many)
        told = np.flatnonzero(counts[2:]) + 2
        yield [word[told], nothing(len(told)), nothing(len(told))], [names[i] for i in told.tolist()], counts[told]
    start = filters.since(1, word)
    start[:2] = _NEVER
    first = np.maximum(start[seq[:-1]], start[seq[1:]])  # the scan after which both words were frequent
    both = np.flatnonzero(first < scan)
    pairs, which, counts = np.unique(seq[both] * many + seq[both + 1], return_inverse=True, return_counts=True)
    left, right = word[pairs // many], word[pairs % many]
    begun = np.full(len(pairs), _NEVER, np.int64)
    begun[which] = first[both]
    told = begun + shards >= scan  # counted in the scans begun + 1 to begun + shards
    yield [left[told], right[told], nothing(told.sum())], None, counts[told]
    if not filters.maps[2]:
        return
    start = filters.since(2, pair_bits(left, right))
    at = np.flatnonzero(both[1:] == both[:-1] + 1)  # pairs that follow each other
    one = which[at]
    first = np.maximum(start[one], start[which[at + 1]])
    live = (first < scan) & (first + shards >= scan)
    triples, counts = np.unique(one[live] * many + seq[both[at[live]] + 2], return_counts=True)
    yield [left[triples // many], right[triples // many], word[triples % many]], None, counts


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, Ids, np.ndarray]]:
    """The words of ``(lang, text)`` as places, some million at a time of one language."""
    ids: dict[str, Ids] = {}
    parts: dict[str, list[np.ndarray]] = {}
    counts: dict[str, int] = {}

    def take(lang: str) -> tuple[str, Ids, np.ndarray]:
        counts.pop(lang)
        return lang, ids.pop(lang), np.concatenate(parts.pop(lang))

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = ids.setdefault(lang, Ids())
            words = tokens(text.as_py())
            words.append(b".")
            parts.setdefault(lang, []).append(np.fromiter(map(own.__getitem__, words), np.int32, len(words)))
            counts[lang] = counts.get(lang, 0) + len(words)
            if sum(counts.values()) >= size:
                yield take(max(counts, key=counts.get))
    for lang in list(ids):
        yield take(lang)


def counted(shard: DataFrame, scan: int, shards: int, filters: object, chunk: int) -> DataFrame:
    """``(a, b, c, word, n)``: partial counts of the active phrases of one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, seq in _chunks(batches, chunk):
            for keys, names, counts in count_chunk(lang, ids, seq, scan, shards, filters.value):
                if len(counts):
                    words = pa.nulls(len(counts), pa.string()) if names is None else pa.array(names, pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([*[pa.array(k.view(np.int64)) for k in keys], words, pa.array(counts.astype(np.int64))], ["a", "b", "c", "word", "n"])

    return shard.mapInArrow(run, "a long, b long, c long, word string, n long")


def _bitmap(reached: DataFrame, at: Column, bits: int) -> np.ndarray:
    """The bitmap of the numbers ``at``: at most ``bits / 64`` numbers come to the driver."""
    at = at.bitwiseAND(F.lit(bits - 1))
    cells = reached.select(F.shiftright(at, 6).alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("set")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found["cell"].to_numpy()] = found["set"].to_numpy()
    return out.view(np.uint8)


class Counts:
    """Exact counts of the frequent: ``words(a, lang, word, n)``, ``pairs(a, b, n)``, ``triples(a, b, c, n)``; and ``sizes(lang, n)`` of all words."""

    def __init__(self, words: DataFrame, pairs: DataFrame, triples: DataFrame, sizes: DataFrame) -> None:
        self.words, self.pairs, self.triples, self.sizes = words, pairs, triples, sizes


def frequent(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, shards: int = SHARDS, bits: int = BITS, chunk: int = CHUNK, seed: int = 0) -> Counts:
    """Exact counts of the phrases of one to three words that occur ``least`` times or more.

    Scans go on until every active phrase has seen all shards: at most three cycles. Each reads the table and takes the texts of
    its shard (by hash of the text). ``seed`` numbers the words; should two words get one number, the next seed is taken.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "phrases")
    corpus = df.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("binary").alias("text")).where("length(text) > 0")
    filters, totals, done, sizes = Filters(bits, seed), None, {}, None
    last = {1: -1, 2: -1, 3: -1}  # the last scan after which a phrase of the length became active: words all at the start
    of = {1: F.col("b") == 0, 2: (F.col("b") != 0) & (F.col("c") == 0), 3: F.col("c") != 0}
    at = {1: F.col("a"), 2: F.col("a").bitwiseXOR(F.shiftrightunsigned("b", 20))}
    scan = 0
    while len(done) < 3:
        sent = spark.sparkContext.broadcast(filters)
        shard = corpus.where(F.pmod(F.xxhash64("text"), F.lit(shards)) == scan % shards)
        fresh = counted(shard, scan, shards, sent, chunk).withColumn("old", F.lit(0).cast("long"))
        both = fresh if totals is None else fresh.unionByName(totals.select("a", "b", "c", "word", "n", F.col("n").alias("old")))
        sums = both.groupBy("a", "b", "c", "word").agg(F.sum("n").alias("n"), F.sum("old").alias("before"))
        totals = scratch.put(sums, f"totals-{scan}")
        scratch.drop(f"totals-{scan - 1}")
        sent.destroy()
        reached = totals.where((F.col("before") < least) & (F.col("n") >= least))
        for length in (1, 2):
            if length not in done:
                crossed = reached.where(of[length])
                found = _bitmap(crossed, at[length], filters.bits[length])
                if found.any():
                    filters.maps[length][scan] = found
                    last[length + 1] = scan
        for length in (1, 2, 3):  # complete lengths are set apart, without what is too rare
            if length not in done and scan >= last[length] + shards and (length == 1 or length - 1 in done):
                own = totals.where(of[length])
                if length == 1:
                    if not own.groupBy("a").count().where("count > 1").isEmpty():
                        scratch.clear()
                        return frequent(df, text, lang, least, shards, bits, chunk, seed + 1)
                    parts = [F.split_part("word", F.lit("\x00"), F.lit(1)).alias("lang"), F.expr("substring(word, instr(word, '\\0') + 1)").alias("word")]
                    sizes = settle(own.select(parts[0], "n").groupBy("lang").agg(F.sum("n").alias("n")))
                    own = own.select("a", *parts, "n")
                done[length] = settle(own.where(F.col("n") >= least).select(*(("a", "lang", "word", "n"), ("a", "b", "n"), ("a", "b", "c", "n"))[length - 1]))
                totals = totals.where(~of[length])
        _forget_shuffles(spark)
        scan += 1
    scratch.clear()
    return Counts(done[1], done[2], done[3], sizes)


def _forget_shuffles(spark) -> None:
    """Spark deletes a finished scan's shuffle files once the driver has collected its garbage."""
    spark.sparkContext._jvm.System.gc()


def _score(a: str, l: str, r: str) -> Column:
    """floor(1000000 a^2 / (l r)) by decimals of 38 digits, exact up to counts of 10^15."""
    wide = "cast({} as decimal(38,0))"
    return F.expr(f"({SCALE} * {wide.format(a)} * {wide.format(a)}) div ({wide.format(l)} * {wide.format(r)})")


def scored(counts: Counts) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(lang, phrase, a, l, r, score, first, second)`` and triples alike (with ``third``), each with the parts of its lowest-scoring cut (of equal scores the earliest).

    A frequent word is a part of very many candidates: all joins are plain ones that can be split.
    """
    word = lambda key, name, n: counts.words.select(F.col("a").alias(key), F.col("word").alias(name), F.col("n").alias(n))
    pairs = counts.pairs.select(F.col("a").alias("first"), F.col("b").alias("second"), F.col("n").alias("a"))
    known = pairs.join(counts.words.select(F.col("a").alias("first"), "lang", F.col("word").alias("w1"), F.col("n").alias("l")), "first").join(word("second", "w2", "r"), "second")
    two = known.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score("a", "l", "r").alias("score"), "first", "second")
    triples = counts.triples.select(F.col("a").alias("first"), F.col("b").alias("second"), F.col("c").alias("third"), F.col("n").alias("a"))
    known = triples.join(pairs.withColumnRenamed("a", "n12"), ["first", "second"]).join(pairs.select(F.col("first").alias("second"), F.col("second").alias("third"), F.col("a").alias("n23")), ["second", "third"])
    known = known.join(counts.words.select(F.col("a").alias("first"), "lang", F.col("word").alias("w1"), F.col("n").alias("n1")), "first").join(word("second", "w2", "n2"), "second").join(word("third", "w3", "n3"), "third")
    known = known.withColumns({"s1": _score("a", "n1", "n23"), "s2": _score("a", "n12", "n3")})
    early = F.col("s1") <= F.col("s2")
    three = known.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(early, F.col("n1")).otherwise(F.col("n12")).alias("l"),
        F.when(early, F.col("n23")).otherwise(F.col("n3")).alias("r"), F.least("s1", "s2").alias("score"), "first", "second", "third",
    )
    return two, three


def shown(two: DataFrame, three: DataFrame) -> DataFrame:
    """Candidates without those that lie in a longer candidate of at least ``HIDDEN`` percent of their count."""
    ends = F.array(F.struct("first", "second"), F.struct(F.col("second").alias("first"), F.col("third").alias("second")))
    longer = three.select(F.explode(F.array_distinct(ends)).alias("e"), F.col("a").alias("n")).select("e.first", "e.second", "n")
    most = longer.groupBy("first", "second").agg(F.max("n").alias("most"))
    open_ = two.join(most, ["first", "second"], "left").where(F.col("most").isNull() | (100 * F.col("most") < HIDDEN * F.col("a")))
    names = ["lang", "phrase", "a", "l", "r", "score"]
    return open_.select(*names).unionByName(three.select(*names))


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", best: int = BEST, buckets: int = 64, **settings: int) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``best`` collocations of each language by score, then count, then phrase.

    A null language is ``und`` (and one with languages of that name); null and empty texts have no words. Counts are
    exact, over whole texts; rows that repeat count again. Ranks are found in ``buckets`` parts of each language first, so
    that no language is sorted in one task. An empty table gives an empty one. ``settings`` are those of :func:`frequent`.
    """
    counts = frequent(df, text, lang, **settings)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows = shown(*scored(counts)).withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(buckets)))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= best)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return rows.join(counts.sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
