"""Embedding near-dedup by randomised-rotation binary codes (operator 10).

A unit vector is rotated at random and stored as the signs of its coordinates, one bit each,
with a correction factor: the inner product of the rotated vector with its own code. The
other side of a comparison is the rotated vector in whole numbers of 8 bits with a step.
The inner product of a code with the other's numbers, divided by the factor, estimates the
vectors' inner product without bias, with an error bound that shrinks with the dimension;
the rounding adds a bound of its own. Codes, factors, numbers and steps are made once a
vector; only they go to the comparisons. Vectors themselves are fetched for those rows of a
task that have a pair whose estimate plus bound reaches the threshold, and such pairs are
computed again exactly, in double precision.

Which pairs are looked at: further rotations give sign bits for tables of hash keys; the
number of bits follows the logarithm of the number of vectors, and the number of tables
follows the recall that a pair at the threshold itself shall have. Equal vectors go as one.
A bucket is cut into blocks, and a pair of blocks is one bounded task; tasks report rows,
link counts for each vector and a spanning forest, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import connected_components, settle
from .minhash import roots


@lru_cache(16)
def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same on each machine."""
    q, r = np.linalg.qr(np.random.default_rng([dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def layout(count: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a table key and number of tables for ``count`` vectors."""
    same = 1 - math.acos(threshold) / math.pi  # that one sign agrees, for a pair at the threshold
    bits = max(8, math.ceil(math.log2(max(count, 2))))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same**bits))


def table_keys(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Keys (n, tables) from the signs of enough rotations."""
    n, dim = unit.shape
    need = bits * tables
    signs = np.concatenate([unit @ rotation(dim, k + 1) > 0 for k in range(-(-need // dim))], axis=1)[:, :need]
    return signs.reshape(n, tables, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, correction factors, 8-bit numbers and their steps of unit vectors."""
    turned = unit @ rotation(unit.shape[1], 0)
    above = turned > 0
    factor = np.abs(turned).sum(1) / math.sqrt(unit.shape[1])
    step = np.maximum(np.abs(turned).max(1), 1e-30) / 127
    return np.packbits(above, axis=1), factor, np.rint(turned / step[:, None]).astype(np.int8), step


def signs(packed: np.ndarray, dim: int) -> np.ndarray:
    """Codes as +1 and -1."""
    return np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1


def reach(factor: np.ndarray, step: np.ndarray, dim: int, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of an estimate's error: by the code (``sure`` deviations), and by the rounding for each unit of 1 / factor."""
    by_code = sure * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(dim - 1, 1))
    return by_code, math.sqrt(dim) * step / 2


def passing(code: np.ndarray, factor: np.ndarray, number: np.ndarray, step: np.ndarray, row: np.ndarray, col: np.ndarray, threshold: float, sure: float) -> np.ndarray:
    """Which pairs (row, col) of stored codes may reach the threshold."""
    dim = number.shape[1]
    estimate = np.einsum("ij,ij->i", code[row], number[col].astype(np.float32)) * step[col] / (math.sqrt(dim) * factor[row])
    by_code, by_step = reach(factor, step, dim, sure)
    return estimate + by_code[row] + by_step[col] / factor[row] + 1e-5 >= threshold


def block_passing(code: np.ndarray, factor: np.ndarray, number: np.ndarray, step: np.ndarray, first: int, threshold: float, sure: float) -> np.ndarray:
    """The same for the first codes with all, as a matrix."""
    dim = number.shape[1]
    estimate = (code[:first] @ number.T.astype(np.float32)) * step[None, :] / (math.sqrt(dim) * factor[:first, None])
    by_code, by_step = reach(factor, step, dim, sure)
    return estimate + by_code[:first, None] + by_step[None, :] / factor[:first, None] + 1e-5 >= threshold


def _stored(columns: list[pa.Array]) -> tuple[np.ndarray, ...]:
    """Codes (+1, -1), factors, numbers and steps of rows of one dimension."""
    packed, factor, number, step = columns
    n = len(factor)
    numbers = np.frombuffer(b"".join(number.to_pylist()), np.int8).reshape(n, -1)
    bits = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(n, -1)
    return signs(bits, numbers.shape[1]), factor.to_numpy(), numbers, step.to_numpy()


def _tasks(batches, column: str, least_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Whole tasks, several at a time: batches whose rows are sorted by the column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < least_rows:
            continue
        table = pa.Table.from_batches(held)
        last = table.column(column)[-1]
        task = table.column(column).to_numpy()
        cut = int(np.flatnonzero(task != last.as_py())[-1]) + 1 if (task != last.as_py()).any() else 0
        if cut:
            yield table.slice(0, cut).combine_chunks().to_batches()[0]
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    task = batch.column(0).to_numpy()
    edge = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1], [True])))
    return zip(edge[:-1].tolist(), edge[1:].tolist())


def _hopeful(batch: pa.RecordBatch, threshold: float, sure: float) -> np.ndarray:
    """Which rows (task, side, dim, c, packed, factor, number, step) have a partner in their task that may reach the threshold."""
    keep = np.zeros(batch.num_rows, bool)
    side, dims = batch.column(1).to_numpy(), batch.column(2).to_numpy()
    small: dict[int, list[tuple[int, int]]] = {}
    for a, b in _parts(batch):
        if b - a <= 48:
            small.setdefault(int(dims[a]), []).append((a, b))
        else:
            own = np.argsort(side[a:b], kind="stable") + a
            first = int((side[own] == 0).sum())
            may = block_passing(*_stored([batch.column(k).take(pa.array(own)) for k in range(4, 8)]), first, threshold, sure)
            if first == b - a:
                np.fill_diagonal(may, False)
            else:
                may[:, :first] = False
            keep[own[:first]] |= may.any(1)
            keep[own] |= may.any(0)
    for parts in small.values():  # the pairs of all small tasks at once
        rows = np.concatenate([np.arange(a, b) for a, b in parts])
        stored = _stored([batch.column(k).take(pa.array(rows)) for k in range(4, 8)])
        size = np.array([b - a for a, b in parts])
        begin = np.cumsum(size) - size
        each = np.repeat(size, size)  # partners of each row, itself among them
        row = np.repeat(np.arange(len(rows)), each)
        col = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(np.repeat(begin, size), each)
        crossed = np.repeat(np.add.reduceat(side[rows], begin) > 0, size)[row]
        valid = (row != col) & (side[rows][row] == 0) & ((side[rows][col] == 1) == crossed)
        row, col = row[valid], col[valid]
        for i in range(0, len(row), 200_000):
            r, c = row[i : i + 200_000], col[i : i + 200_000]
            may = passing(*stored, r, c, threshold, sure)
            keep[rows[r[may]]] = True
            keep[rows[c[may]]] = True
    return keep


def linked(vectors: np.ndarray, stored: tuple[np.ndarray, ...], first: int, threshold: float, sure: float = 6.0) -> tuple[np.ndarray, int]:
    """Which of the first vectors (rows) link with which (columns), and how many pairs were computed exactly.

    ``sure``: the error bound in units of the estimate's deviation.
    """
    vectors = vectors / np.abs(vectors).max(1)[:, None]  # so that squares neither overflow nor vanish
    norm = np.sqrt((vectors * vectors).sum(1))
    row, col = np.nonzero(block_passing(*stored, first, threshold, sure))
    out = np.zeros((first, len(vectors)), bool)
    for i in range(0, len(row), 100_000):
        r, c = row[i : i + 100_000], col[i : i + 100_000]
        out[r, c] = np.einsum("ij,ij->i", vectors[r], vectors[c]) / (norm[r] * norm[c]) >= threshold
    return out, len(row)


def _links(batch: pa.RecordBatch, threshold: float, sure: float) -> list[tuple]:
    """Link counts (c, None, n) and forest links (c, c, None) of the rows (task, side, tab, c, copies, keys, v, stored …)."""
    out: list[tuple] = []
    side, tab, number, copies = (batch.column(k).to_numpy() for k in range(1, 5))
    for a, b in _parts(batch):
        own = np.lexsort((number[a:b], side[a:b])) + a
        first = int((side[own] == 0).sum())
        if first == 0 or b - a < 2:
            continue
        taken = batch.take(pa.array(own))
        keys, vectors = (np.stack([np.asarray(x) for x in taken.column(k).to_pylist()]) for k in (5, 6))
        link, _ = linked(vectors.astype(np.float64), _stored([taken.column(k) for k in range(7, 11)]), first, threshold, sure)
        if first < b - a:
            link[:, :first] = False
        else:
            np.fill_diagonal(link, False)
        if not link.any():
            continue
        ids, table = number[own], int(tab[a])
        out += [(int(ids[i]), int(ids[r]), None) for i, r in enumerate(roots(link).tolist()) if r != i]
        count = np.zeros(b - a, np.int64)
        for i in np.flatnonzero(link.any(1)).tolist():  # a pair counts in the first table where it meets
            js = np.flatnonzero(link[i])
            js = js[~(keys[js, :table] == keys[i, :table]).any(1)]
            count[i] += copies[own][js].sum()
            if first < b - a:
                count[js] += copies[own[i]]
        out += [(int(ids[i]), None, int(count[i])) for i in np.flatnonzero(count).tolist()]
    return out


def near_links(
    df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, recall: float = 0.999, block: int = 512, sure: float = 6.0
) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept.

    Vectors that are null, empty or zero, or hold a null or non-finite component, link with
    nothing; vectors of other dimensions link only among themselves. Components are compared in
    double precision. Rows that repeat an id, with the same or other vectors, count each. A row
    with a null id links as others do; it has the smallest id of its component (null if there
    is none) and is not kept. Pairs at the threshold are found with the given recall, others with more.
    """
    values = F.col(vector).cast("array<double>")
    good = values.isNotNull() & (F.size(values) > 0) & F.forall(
        values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ) & F.exists(values, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.when(good, values).alias("v"))
    rows = settle(rows.withColumn("h", F.when(F.col("v").isNotNull(), F.md5(F.to_json(F.struct("v"))))))
    classes = rows.where("v is not null").groupBy("h").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.first("v").alias("v"))  # equal ones
    classes = settle(classes.withColumn("c", F.monotonically_increasing_id()))
    bits, tables = layout(classes.count(), threshold, recall)

    def coded(batches):
        for batch in batches:
            number, lists = batch.column(0), batch.column(1)
            width = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(width)
            for dim in np.unique(width).tolist():
                own = np.flatnonzero(width == dim)
                values = flat[(ends[own] - dim)[:, None] + np.arange(dim)]
                values = values / np.abs(values).max(1)[:, None]  # so that squares neither overflow nor vanish
                unit = values / np.sqrt((values * values).sum(1))[:, None]
                packed, factor, numbers, step = codes(unit)
                yield pa.RecordBatch.from_arrays(
                    [
                        number.take(pa.array(own)), pa.array(np.full(len(own), dim, np.int32)), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(factor),
                        pa.array([x.tobytes() for x in numbers], pa.binary()), pa.array(step), pa.array(list(table_keys(unit, bits, tables)), pa.list_(pa.int64())),
                    ],
                    names=["c", "dim", "packed", "factor", "number", "step", "keys"],
                )

    stored = ["packed", "factor", "number", "step"]
    model = settle(classes.select("c", "v").mapInArrow(coded, "c long, dim int, packed binary, factor double, number binary, step double, keys array<long>"))
    entries = model.select("c", "dim", F.posexplode("keys").alias("tab", "key"))
    several = entries.groupBy("tab", "key", "dim").agg(F.count("*").alias("n")).where("n > 1").withColumn("b", F.ceil(F.col("n") / block).cast("int")).drop("n")
    placed = entries.join(several, ["tab", "key", "dim"]).withColumn("own", F.pmod(F.xxhash64("c", "tab"), F.col("b")).cast("int"))
    dealt = placed.selectExpr(
        "c", "tab", "explode(transform(sequence(0, b - 1), o -> struct(xxhash64(tab, key, dim, least(o, own), greatest(o, own)) as task, if(o >= own, 0, 1) as side))) as t"
    ).select("c", "tab", "t.task", "t.side")

    def hopeful(batches):
        for batch in _tasks(batches, "task"):
            keep = pa.array(_hopeful(batch, threshold, sure))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1, 3, 8)], names=["task", "side", "c", "tab"])

    ready = dealt.join(model.select("c", "dim", *stored), "c").select("task", "side", "dim", "c", *stored, "tab")
    hoped = settle(ready.repartition(F.col("task")).sortWithinPartitions("task").mapInArrow(hopeful, "task long, side int, c long, tab int"))

    def links(batches):
        for batch in _tasks(batches, "task", 1024):
            yield _rows(_links(batch, threshold, sure))

    wide = hoped.join(model.drop("dim"), "c").join(classes.select("c", "copies", "v"), "c").select("task", "side", "tab", "c", "copies", "keys", "v", *stored)
    found = settle(wide.repartition(F.col("task")).sortWithinPartitions("task").mapInArrow(links, "src long, dst long, n long"))
    counts = found.where("n is not null").groupBy(F.col("src").alias("c")).agg(F.sum("n").alias("others"))
    parts = connected_components(found.where("dst is not null").select("src", "dst")).select(F.col("id").alias("c"), "component")
    named = classes.select("h", "c", "least_id", "copies").join(parts, "c", "left").join(counts, "c", "left").withColumn("part", F.coalesce("component", "c"))
    least = named.where("component is not null").groupBy("part").agg(F.min("least_id").alias("of_several"))
    known = named.join(least, "part", "left").select(
        "h", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("of_several", "least_id").alias("component_id")
    )
    out = rows.select("vec_id", "h").join(known, "h", "left")
    component = F.when(F.col("h").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )


def _rows(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) if found else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["src", "dst", "n"])
