"""MinHash near-dedup by tensored banding (operator 2).

A document is the set of its distinct five-word shingles. ``collections`` small hash
collections of three minhashes each are computed once; table keys combine the *pairs* of
collections, so that collections * (collections - 1) / 2 tables of six minhashes cost
only 3 * collections minhashes. Two documents meet in a table if they agree on two
collections. With 28 collections two documents of similarity 0.75 miss each other with a
probability of 5e-6 (at 0.8: 2e-7), and 18 % of those of similarity 0.3 meet at all.

Work is in six steps, none of which gathers a large group or emits a group's pairs:

1. sets: one pass over the texts gives each set's size, 128-bit digest, collection keys and
   a signature of 16 bits a minhash. Equal sets form classes by aggregation (map-side
   combine), so that thousands of copies go on as one row.
2. tables: keys that only one class has are dropped by collection *before* pairs are
   combined; buckets with the same members go on as one.
3. links: each member of a bucket is compared with the bucket's centre by their
   signatures, whose estimate must come within 4.5 deviations of the threshold. Where one
   fails in a bucket of three or more, all that are connected by such comparisons are
   compared in bounded blocks, which report a forest of the links found.
4. clusters: connected components of these links.
5. verify: a cluster's classes are cut into blocks of bounded size; each pair of blocks is
   one bounded task that counts exact set intersections and reports a spanning forest of
   the confirmed links (at most one row a class).
6. components of the confirmed links, and the way back to documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import connected_components, settle
from .rows import id_hash, matched, text_hash
from .worker import held

#: Mixing constants of the splitmix64 finaliser. Fixed values.
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hash of a word; holds up to a bound of them, which changes no result."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little", signed=True)
        if len(self) < 100_000 and len(word) <= 32:
            self[word] = value
        return value


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after the other, and each text's number of them.

    Words are runs of other characters than ASCII white space, with A-Z in lower case. A
    text of fewer than ``words`` words has its whole sequence as one shingle; one without
    words (or null) has none.
    """
    split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    count = np.fromiter(map(len, split), np.int64, len(split))
    total = int(count.sum())
    look = held(("words",), _Words).__getitem__
    hashes = np.fromiter((look(w) for own in split for w in own), np.int64, total).view(np.uint64)
    made = np.maximum(count - words + 1, 0)
    rolled = np.zeros(max(total - words + 1, 0), np.uint64)
    for i in range(words):
        rolled = _mix(rolled * _A + hashes[i : len(rolled) + i])
    sets, sizes, at = [], np.zeros(len(texts), np.int64), 0
    for k, (n, m) in enumerate(zip(count.tolist(), made.tolist())):
        if m:
            own = np.sort(rolled[at : at + m])
            if m > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            sets.append(own)
            sizes[k] = len(own)
        elif n:
            short = np.uint64(n)
            for h in hashes[at : at + n]:
                short = _mix(np.array([short], np.uint64) * _A + h)[0]
            sets.append(np.array([short], np.uint64))
            sizes[k] = 1
        at += n
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), sizes


#: Minhashes of a collection.
EACH = 3


def _multipliers(collections: int) -> np.ndarray:
    draw = np.random.default_rng(20_040_607).integers(1, 1 << 63, EACH * collections, dtype=np.uint64)
    return draw * np.uint64(2) + np.uint64(1)


def minhashes(own: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, bytes]:
    """One 64-bit key for each collection, its minhashes mixed; and 16 bits of each minhash."""
    low = np.full(len(factors), np.uint64(0xFFFFFFFFFFFFFFFF))
    for start in range(0, len(own), 4096):
        x = own[start : start + 4096] * factors[:, None]
        np.minimum(low, (x ^ (x >> np.uint64(32))).min(1), out=low)
    mixed = _mix(low)
    key = np.zeros(len(factors) // EACH, np.uint64)
    for k in range(EACH):
        key = _mix(key * _A + mixed[k::EACH])
    return key.view(np.int64), mixed.astype("<u2").tobytes()


def _slices(texts: list, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most or i + 1 == len(texts):
            yield start, i + 1
            start, size = i + 1, 0


def _keyed(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), id_hash(id_col), text_hash(text), F.col(text).alias("text"))


def features(df: DataFrame, id_col: str, text: str, words: int, collections: int) -> DataFrame:
    """``(id, id_hash, text_hash, n_shingles, digest, keys, signature)`` of each row; the last three null for empty sets."""
    factors = _multipliers(collections)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _slices(texts):
                values, sizes = shingle_sets(texts[a:b], words)
                digests, keys, signs, at = [], [], [], 0
                for n in sizes.tolist():
                    own = values[at : at + n]
                    key, sign = minhashes(own, factors) if n else (None, None)
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if n else None)
                    keys.append(key)
                    signs.append(sign)
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(a, b - a) for k in range(3)), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.binary())],
                    names=["id", "id_hash", "text_hash", "n_shingles", "digest", "keys", "signature"],
                )

    return _keyed(df, id_col, text).mapInArrow(run, "id long, id_hash long, text_hash long, n_shingles long, digest binary, keys array<long>, signature binary")


def buckets(classes: DataFrame) -> DataFrame:
    """``(bucket, src, n, c)``: the members ``c`` of table buckets of two or more, with the centre
    of them and their number; of buckets with the same members only one.

    The centre is the member whose keys most classes share (the smallest of equals). Buckets of one large group so have
    few centres between them, and a member few links to centres, where the smallest members would be as many as the buckets.
    """
    single = classes.select("c", F.posexplode("keys").alias("pos", "key"))
    shared = single.groupBy("pos", "key").agg(F.count("*").alias("n")).where("n > 1")
    left = single.join(shared, ["pos", "key"]).groupBy("c").agg(F.sort_array(F.collect_list(F.struct("pos", "key"))).alias("own"), F.sum("n").alias("w"))  # at most one a collection
    pairs = left.where("size(own) > 1").selectExpr(
        "c", "w", "explode(flatten(transform(own, (x, i) -> transform(slice(own, i + 2, size(own)), y -> xxhash64(x.pos, y.pos, x.key, y.key))))) as bucket"
    )
    pairs = settle(pairs)
    shape = pairs.groupBy("bucket").agg(F.max_by("c", F.struct("w", -F.col("c"))).alias("src"), F.count("*").alias("n"), F.expr("bit_xor(xxhash64(c))").alias("x"), F.expr("bit_xor(xxhash64(1, c))").alias("y"))
    once = shape.where("n > 1").groupBy("src", "n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "src", "n")
    return settle(pairs.join(once, "bucket").select("bucket", "src", "n", "c"))


def _signs(column: pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<u2").reshape(len(values), -1)


def _dealt(members: DataFrame, block: int) -> DataFrame:
    """``(c, task, side)`` from ``members(part, n, c)``: parts of ``n`` members are cut into blocks of about
    ``block``, and each pair of blocks (each with itself too) is a task."""
    placed = members.withColumn("b", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("c", "part"), F.col("b")).cast("int"))
    task = "explode(transform(sequence(0, b - 1), o -> struct(xxhash64(part, least(o, own), greatest(o, own)) as task, if(o >= own, 0, 1) as side))) as t"
    return placed.selectExpr("c", task).select("c", "t.task", "t.side")


def _by_task(rows: DataFrame, decide: Callable[[list], list]) -> DataFrame:
    """``(src, dst)``: what ``decide`` finds in the rows (side, c, value) of each ``task``."""

    def run(batches):
        now, block = None, []
        for batch in batches:
            found = []
            for task, side, number, own in zip(*(c.to_pylist() for c in batch.columns)):
                if task != now:
                    found += decide(block)
                    now, block = task, []
                block.append((side, number, own))
            if found:
                yield _pairs(found)
        yield _pairs(decide(block))

    return rows.repartition(F.col("task")).sortWithinPartitions("task").mapInArrow(run, "src long, dst long")


def alike(classes: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """``(src, dst)``: links of :func:`buckets`' members whose signatures are so alike that their sets may be.

    First each member is compared with its bucket's centre. Members of buckets of three or
    more form neighbourhoods by these comparisons, whatever they gave; in a neighbourhood with a failed one, the
    classes are compared in blocks, so that a class goes to as many tasks as its neighbourhood
    has blocks, however many buckets it is in. Tasks report a forest of the links found.
    """
    signs = classes.select("c", "signature")

    def least(n: int) -> float:
        p = percent / 100
        return (p - 4.5 * np.sqrt(p * (1 - p) / n)) * n

    def compare(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = _signs(batch.column(2)), _signs(batch.column(3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((a == b).sum(1) >= least(a.shape[1])), batch.column(4)], names=["src", "dst", "near", "n"])

    stars = members.where("c <> src").groupBy("src", F.col("c").alias("dst")).agg(F.max("n").alias("n"))
    first = stars.join(signs.select(F.col("c").alias("src"), F.col("signature").alias("a")), "src").join(signs.select(F.col("c").alias("dst"), F.col("signature").alias("b")), "dst")
    compared = settle(first.select("src", "dst", "a", "b", "n").mapInArrow(compare, "src long, dst long, near boolean, n long"))
    links = compared.where("near").select("src", "dst")
    failed = compared.where("not near and n > 2").select(F.col("dst").alias("c"))
    if failed.isEmpty():
        return links
    near = connected_components(compared.where("n > 2").select("src", "dst")).select(F.col("id").alias("c"), F.col("component").alias("part"))
    rest = near.join(near.join(failed, "c", "left_semi").select("part").distinct(), "part")
    rest = settle(rest.join(signs, "c").select("part", "c", "signature"))

    def forest(block: list) -> list[tuple[int, int]]:
        if len(block) < 2:
            return []
        block.sort(key=lambda x: x[:2])
        first = sum(side == 0 for side, _, _ in block)
        made = np.frombuffer(b"".join(x[2] for x in block), "<u2").reshape(len(block), -1)
        same = np.zeros((first, len(block)), np.int16)
        for k in range(made.shape[1]):
            same += made[:first, None, k] == made[None, :, k]
        return [(block[i][1], block[r][1]) for i, r in enumerate(roots(same >= least(made.shape[1])).tolist()) if r != i]

    tasks = _dealt(rest.join(rest.groupBy("part").agg(F.count("*").alias("n")), "part").select("part", "n", "c"), 512)
    more = _by_task(tasks.join(rest.select("c", "signature"), "c").select("task", "side", "c", "signature"), forest)
    return links.unionAll(more)


def roots(link: np.ndarray) -> np.ndarray:
    """Smallest reachable index for each column of a link matrix whose rows are the first columns."""
    first, n = link.shape
    label = np.arange(n)
    while True:
        row = np.minimum(label[:first], np.where(link, label, n).min(1, initial=n))
        now = label.copy()
        now[:first] = row
        now = np.minimum(now, np.where(link, row[:, None], n).min(0, initial=n))
        now = now[now]
        if (now == label).all():
            return label
        label = now


def intersections(values: np.ndarray, owner: np.ndarray, n: int, first: int) -> np.ndarray:
    """Exact intersection sizes of sets 0..first-1 (rows) with all n sets (columns).

    ``values`` holds all sets' elements and ``owner`` the set of each. Elements that many
    sets hold go through a matrix product, the others through their pairs of holders.
    """
    out = np.zeros((first, n), np.float32)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    begin = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    held = np.diff(np.concatenate((begin, [len(values)])))
    flat = out.reshape(-1)
    for times in np.unique(held):
        starts = begin[held == times]
        if times < 2:
            continue
        if times <= 24:
            step = max(1, 2_000_000 // int(times * times))
            for i in range(0, len(starts), step):
                who = owner[starts[i : i + step, None] + np.arange(times)]
                row = np.repeat(who, times, axis=1).ravel()
                col = np.tile(who, (1, times)).ravel()
                keep = row < first
                flat += np.bincount(row[keep] * n + col[keep], minlength=len(flat)).astype(np.float32)
    many = held > 24
    starts, times = begin[many], held[many]
    for i in range(0, len(starts), 2048):
        s, t = starts[i : i + 2048], times[i : i + 2048]
        at = np.repeat(s - (np.cumsum(t) - t), t) + np.arange(int(t.sum()))
        holds = np.zeros((n, len(s)), np.float32)
        holds[owner[at], np.repeat(np.arange(len(s)), t)] = 1
        out += holds[:first] @ holds.T
    return out


def _verified(block: list, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the exact links in one task's classes: ``block`` holds (side, class, set)."""
    if len(block) < 2:
        return []
    block.sort(key=lambda x: x[:2])
    ids = [x[1] for x in block]
    first, n = sum(x[0] == 0 for x in block), len(ids)
    sets = [np.frombuffer(x[2], np.uint64) for x in block]
    size = np.array([len(s) for s in sets], np.float32)
    both = intersections(np.concatenate(sets), np.repeat(np.arange(n), size.astype(np.int64)), n, first)
    # sizes are whole numbers; float32 holds them exactly up to 2^24 / 100, beyond that float64 is taken
    if size.max() > 80_000:
        both, size = both.astype(np.float64), size.astype(np.float64)
    link = 100 * both >= percent * (size[:first, None] + size[None, :] - both)
    return [(ids[x], ids[r]) for x, r in enumerate(roots(link).tolist()) if r != x]


def confirmed_links(
    df: DataFrame, id_col: str, text: str, members: DataFrame, words: int, percent: int, block_words: int
) -> DataFrame:
    """``(src, dst)`` confirmed on full sets; ``members(c, id_hash, text_hash, cluster, n_shingles)``, whose
    hashes tell the row that has the class's text.

    A cluster is cut into blocks of up to ``block_words`` shingles in sum on average (512
    classes at most); tasks are the pairs of blocks, and a class is sent to as many of them as
    its cluster has blocks.
    """
    total = members.groupBy("cluster").agg(F.sum("n_shingles").alias("w"), F.count("*").alias("k")).where("k > 1")
    blocks = F.greatest(F.ceil(F.col("w") / block_words), F.ceil(F.col("k") / 512))
    tasks = _dealt(members.join(total.select("cluster", blocks.alias("n")), "cluster").select("c", F.col("cluster").alias("part"), "n"), 1)
    # texts of candidates only go on: Spark may add a Bloom filter of the hashes at scale
    wanted = members.select("c", "id_hash", "text_hash")
    rows = _keyed(df, id_col, text).drop("id").join(wanted, ["id_hash", "text_hash"]).dropDuplicates(["id_hash", "text_hash"]).select("c", "text")

    def sets(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                values, sizes = shingle_sets(texts[a:b], words)
                ends = np.cumsum(sizes)
                made = [values[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(made, pa.binary())], names=["c", "own"])

    ready = rows.mapInArrow(sets, "c long, own binary")
    return _by_task(ready.join(tasks, "c").select("task", "side", "c", "own"), lambda block: _verified(block, percent))


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    src, dst = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])


def _grouped(df: DataFrame, id_col: str, text: str, words: int, percent: int, collections: int, block_words: int) -> DataFrame:
    """Each row's ``(id, id_hash, text_hash, n_shingles, part, component_id)``; ``part`` numbers components, null for empty sets."""
    rows = settle(features(df, id_col, text, words, collections))
    classes = rows.where("digest is not null").groupBy("digest").agg(
        F.min("id").alias("least_id"), F.min(F.struct("id_hash", "text_hash")).alias("row"),
        *(F.first(c).alias(c) for c in ("n_shingles", "keys", "signature")),  # equal sets have equal ones
    )
    classes = settle(classes.withColumn("c", F.monotonically_increasing_id()))
    clusters = connected_components(alike(classes, buckets(classes), percent))
    members = classes.join(clusters.select(F.col("id").alias("c"), F.col("component").alias("cluster")), "c")
    members = settle(members.select("c", "row.id_hash", "row.text_hash", "cluster", "n_shingles"))
    parts = connected_components(confirmed_links(df, id_col, text, members, words, percent, block_words)).select(F.col("id").alias("c"), "component")
    named = classes.select("digest", "c", "least_id").join(parts, "c", "left").withColumn("part", F.coalesce("component", "c"))
    several = named.where("component is not null").groupBy("part").agg(F.min("least_id").alias("of_several"))
    known = named.join(several, "part", "left").select("digest", "part", F.coalesce("of_several", "least_id").alias("of_class"))
    found = rows.select("id", "id_hash", "text_hash", "n_shingles", "digest").join(known, "digest", "left")
    return found.select("id", "id_hash", "text_hash", "n_shingles", "part", F.when(F.col("part").isNull(), F.col("id")).otherwise(F.col("of_class")).alias("component_id"))


def near_groups(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75, collections: int = 28, block_words: int = 200_000
) -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id, kept.

    Texts without words (null, empty, white space) link with nothing and are their own
    component. Rows are told apart by id and text: rows that repeat an id, with the same text
    or others, are each linked and returned. Rows with a null id link as others do; they have
    the smallest id of their component (null if it has none) and are not kept. An empty
    frame gives an empty one.
    """
    found = _grouped(df, id_col, text, words, percent, collections, block_words)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75, collections: int = 28, block_words: int = 200_000
) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id (null ids last), then of the least text hash.

    Rows without words are all kept. Of rows with the same id and text that would be kept, any one is.
    The result's columns are those of ``df``; no name is reserved.
    """
    found = settle(_grouped(df, id_col, text, words, percent, collections, block_words))
    best = found.where("part is not null").groupBy("part").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "text_hash", "id_hash")).alias("b"))
    kept = best.select("b.id_hash", "b.text_hash", F.lit(True).alias("once"))
    kept = kept.unionAll(found.where("part is null").select("id_hash", "text_hash", F.lit(False).alias("once")).distinct())
    times = found.groupBy("id_hash", "text_hash").agg(F.count("*").alias("times")).where("times > 1")
    kept = settle(kept.join(times, ["id_hash", "text_hash"], "left").withColumn("several", F.col("once") & F.col("times").isNotNull()).select("id_hash", "text_hash", "several"))
    return matched(df, id_col, text, kept).select("row.*")
