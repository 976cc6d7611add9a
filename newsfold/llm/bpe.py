"""Byte-level BPE encoding and decoding (operator 1).

Each match of the public split pattern is encoded by itself. Over its byte positions
stands a segment tree whose leaves hold the rank of the pair that begins there, and
whose root so gives the smallest rank, leftmost first. A merge changes three leaves (the
merged pair, its left and its right live neighbour) by point updates of logarithmic cost.
Pieces of up to 64 bytes share trees laid out as rows of one numpy array, so that one
array step makes a merge in each of thousands of pieces; longer ones have a tree each,
which keeps a piece of a million letters at n log n.

Rows are independent: no shuffle, and a lost executor costs its own partitions.
"""

from __future__ import annotations

import base64
import itertools
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .worker import held

#: Unicode white space, as the split pattern's \s has it. Fixed values.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: No match of the split pattern crosses the end of a run of non-spaces, so text is first cut there.
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_NONE = np.int64(1 << 62)


class Merges:
    """The ranks of a vocabulary, with encoding of chunks and decoding of ids."""

    def __init__(self, ranks: bytes, pattern: str, cache_chunks: int) -> None:
        rows = (line.split() for line in ranks.splitlines() if line.strip())
        self.rank = {base64.b64decode(token): int(number) for token, number in rows}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for token, number in self.rank.items():
            self.token[number] = token
        self.table = np.frombuffer(b"".join(self.token), np.uint8)
        self.width = np.fromiter(map(len, self.token), np.int64, len(self.token))
        self.start = np.cumsum(self.width) - self.width
        self.split = regex.compile(pattern.replace("\\s", f"[{_SPACE}]").replace("\\S", f"[^{_SPACE}]").replace(f"[^[{_SPACE}]", f"[^{_SPACE}"))
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        keys, ranks_ = [], []
        for token, number in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ranks_.append(number)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[order], np.array(ranks_, np.int64)[order]
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}
        self.cache_chunks = cache_chunks

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens; _NONE where no such merge exists or one side is absent (-1)."""
        key = left << np.int64(32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], _NONE)

    def _merge_short(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of many pieces of 2 to ``width`` bytes: one segment tree a row."""
        n = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, n)
        filled = np.arange(width) < length[:, None]
        token = np.full((n, width + 2), -1, np.int64)  # columns width and width + 1 stand for "no neighbour"
        body = token[:, :width]
        body[filled] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, width + 3), (n, 1))
        after[np.arange(n), length - 1] = width
        before = np.tile(np.arange(-1, width + 1), (n, 1))
        before[:, 0] = width + 1
        tree = np.full((n, 2 * width), _NONE, np.int64)
        first = self.ranks_of(body[:, :-1].ravel(), body[:, 1:].ravel()).reshape(n, width - 1)
        tree[:, width : 2 * width - 1] = np.where(first < _NONE, first * width + np.arange(width - 1), _NONE)
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        row = np.flatnonzero(tree[:, 1] < _NONE)
        while len(row):
            best = tree[row, 1]
            at, merged = best % width, best // width
            dead = after[row, at]
            right = after[row, dead]
            left = before[row, at]
            token[row, at] = merged
            token[row, dead] = -1
            after[row, at] = right
            before[row, right] = at
            here = self.ranks_of(merged, token[row, right])
            there = self.ranks_of(token[row, left], merged)
            tree[row, width + dead] = _NONE
            tree[row, width + at] = np.where(here < _NONE, here * width + at, _NONE)
            has = left < width
            tree[row[has], width + left[has]] = np.where(there[has] < _NONE, there[has] * width + left[has], _NONE)
            for rows, leaf in ((row, dead), (row, at), (row[has], left[has])):
                node = (width + leaf) >> 1
                while node.size and node[0]:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node = node >> 1
            row = row[tree[row, 1] < _NONE]
        live = body >= 0
        ends = np.cumsum(live.sum(1)) * 4
        flat = body[live].astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _merge_long(self, piece: bytes) -> bytes:
        """Ids of one piece of any length by its own segment tree."""
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        none = int(_NONE)
        token = [*self.byte[np.frombuffer(piece, np.uint8)].tolist(), -1]
        after, before = list(range(1, n + 1)), list(range(-1, n))
        tree = [none] * (2 * width)
        joined, held_rank = self.token, self.rank.get
        pair = lambda left, right: held_rank(joined[left] + joined[right])
        for i in range(n - 1):
            rank = pair(token[i], token[i + 1])
            if rank is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(leaf: int, value: int) -> None:
            node = width + leaf
            tree[node] = value
            node >>= 1
            while node:
                tree[node] = min(tree[2 * node], tree[2 * node + 1])
                node >>= 1

        while tree[1] < none:
            merged, at = divmod(tree[1], width)
            dead = after[at]
            right = after[dead]
            token[at] = merged
            token[dead] = -1
            after[at] = right
            put(dead, none)
            if right < n:
                before[right] = at
            rank = pair(merged, token[right]) if right < n else None
            put(at, none if rank is None else rank * width + at)
            left = before[at]
            if left >= 0:
                rank = pair(token[left], merged)
                put(left, none if rank is None else rank * width + left)
        ids = np.array(token[:-1], np.int64)
        return ids[ids >= 0].astype("<u4").tobytes()

    def merge(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Little-endian ids of each piece; a piece that is itself a token is that token."""
        out: dict[bytes, bytes] = {}
        sizes: dict[int, list[bytes]] = {}
        for piece in pieces:
            whole = self.rank.get(piece)
            if whole is not None:
                out[piece] = whole.to_bytes(4, "little")
            elif len(piece) <= 64:
                sizes.setdefault(max(8, 1 << (len(piece) - 1).bit_length()), []).append(piece)
            else:
                out[piece] = self._merge_long(piece)
        for width, same in sizes.items():
            for i in range(0, len(same), 4096):
                part = same[i : i + 4096]
                out.update(zip(part, self._merge_short(part, width)))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        cut = [_CHUNK.findall(t) for t in texts]
        todo: set[str] = set()
        for parts in cut:
            todo.update(parts)
        chunks, pieces = self.chunks, self.pieces
        if len(chunks) > self.cache_chunks:  # caches save time only; what they hold never changes a result
            chunks.clear()
            pieces.clear()
        new = [c for c in todo if c not in chunks]
        found = [[p.encode("utf-8", "surrogatepass") for p in self.split.findall(c)] for c in new]
        pieces.update(self.merge([p for p in set(itertools.chain.from_iterable(found)) if p not in pieces]))
        look = pieces.__getitem__
        for c, own in zip(new, found):
            chunks[c] = look(own[0]) if len(own) == 1 else b"".join(map(look, own))
        look = chunks.__getitem__
        out = [b"".join(map(look, parts)) for parts in cut]
        for c in new:
            if len(c) > 32:
                del chunks[c]
        for p in set(itertools.chain.from_iterable(found)):
            if len(p) > 32:
                del pieces[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        """Bytes of packed ids, gathered from one table of all tokens' bytes."""
        numbers = np.frombuffer(ids, "<u4").astype(np.int64)
        width = self.width[numbers]
        shift = self.start[numbers] - (np.cumsum(width) - width)
        return self.table[np.repeat(shift, width) + np.arange(int(width.sum()))].tobytes()


def _merges(ranks: bytes, pattern: str, cache_chunks: int) -> Merges:
    """One copy per Python worker."""
    return held(("bpe", hash(ranks), pattern, cache_chunks), lambda: Merges(ranks, pattern, cache_chunks))


def _slices(batch: pa.RecordBatch, column: str, most: int = 1_000_000):
    """Parts of a batch of about ``most`` characters, with the column's texts."""
    texts = batch.column(column).to_pylist()
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most or i + 1 == len(texts):
            yield batch.slice(start, i + 1 - start), texts[start : i + 1]
            start, size = i + 1, 0


def _named(df: DataFrame, *out: str) -> None:
    clash = {c.lower() for c in df.columns} & {o.lower() for o in out}
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already; pass other names for the results")


def round_trip(
    df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids_le", decoded: str | None = "decoded",
    cache_chunks: int = 80_000,
) -> DataFrame:
    """Add the ids of each whole text (binary, little-endian unsigned 32 bit) and, unless
    ``decoded`` is None, the bytes that these ids stand for.

    ``vocabulary`` is the path of a rank file (base64 token, rank), read on the driver and
    broadcast (a vocabulary is a fixed file of under a few MB). Null and empty texts give
    empty ids. Other columns stay, repeated rows too; an existing column of a result's name
    is an error. ``cache_chunks`` bounds each worker's memory and never changes a result.
    """
    _named(df, ids, *([decoded] if decoded else []))
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        merges = _merges(shared.value, pattern, cache_chunks)
        for batch in batches:
            if not batch.num_rows:
                continue
            for part, texts in _slices(batch, text):
                encoded = merges.encode([t or "" for t in texts])
                columns = [*part.columns, pa.array(encoded, pa.binary())]
                names = [*part.schema.names, ids]
                if decoded:
                    columns.append(pa.array([merges.decode(x) for x in encoded], pa.binary()))
                    names.append(decoded)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    made = [T.StructField(name, T.BinaryType()) for name in (ids, decoded) if name]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *made]))


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids_le") -> DataFrame:
    """Only the ids of :func:`round_trip`."""
    return round_trip(df, vocabulary, pattern, text, ids, None)


def decode(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids_le", decoded: str = "decoded") -> DataFrame:
    """Add the bytes that packed ids stand for; null ids give empty bytes."""
    _named(df, decoded)
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        merges = _merges(shared.value, pattern, 80_000)
        for batch in batches:
            made = [merges.decode(x or b"") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, decoded])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(decoded, T.BinaryType())]))


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """The contract's row per document: counts and digests of :func:`round_trip`'s results."""
    made = round_trip(docs.select("doc_id", "text"), vocabulary, pattern)
    return made.select(
        "doc_id",
        F.expr("cast(length(ids_le) div 4 as long)").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
