"""Language ID by segmentation-marginalised unigrams (operator 7).

Every language has probabilities of pieces from one fixed public vocabulary. A word's
probability in a language is the sum over all its segmentations into pieces, by the
forward algorithm; a text's score is the sum of its words' logarithms. Piece probabilities
are fitted by expectation-maximisation: with the present probabilities, forward and
backward sums give each piece's expected count in the words of the training documents;
counts by language and piece are added up by Spark.

Words are runs of letters in lower case with a mark for the word's start. Pieces are found
along a trie, for thousands of words at a time. Whole texts are scored; each worker
remembers the scores of words (bounded, and without effect on results).
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import settle
from .worker import held


_WORD = re.compile(r"[^\W\d_]+")
#: Characters that Python's word class holds though they are neither letters nor decimal digits (½, Ⅷ, ²).
_NUMBERS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_TO_SPACE = dict.fromkeys(map(ord, _NUMBERS), " ")
#: Letters outside all pieces have at most this probability; sums under the second are scaled.
UNKNOWN, SMALL = 1e-7, 1e-150
START = "▁"
#: Languages are few: their list and probabilities go through the driver, so more are refused.
MOST_LANGUAGES = 1_000
#: A text is rejected if fewer of its words are likelier in some language than by their letters alone.
LEAST = 0.2


def _lower(text: str) -> str:
    """In lower case, with a space for each number that isn't a decimal digit."""
    text = text.lower()
    return text if text.isascii() or _NUMBERS.isdisjoint(text) else text.translate(_TO_SPACE)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(_lower(text)) if text else []


def _word_blocks(text: str | None, most: int = 200_000) -> Iterator[list[str]]:
    """The words of a text, in blocks, so that a very long one isn't held as words all at once."""
    if text:
        found = (m.group() for m in _WORD.finditer(_lower(text)))
        while block := list(islice(found, most)):
            yield block


def read_pieces(path: str) -> list[str]:
    """Distinct pieces of a sentencepiece vocabulary, in lower case and of letters only."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if _WORD.fullmatch(p.removeprefix(START) or "a")})


class Trie:
    """Pieces as a trie of numbered nodes, whose edges stand in an open hash table."""

    def __init__(self, pieces: list[str]) -> None:
        letters = sorted({c for p in pieces for c in p})
        self.letter = np.zeros(sys.maxunicode + 1, np.int32)  # 0: in no piece
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.letters = len(letters) + 1
        node: dict[str, int] = {"": 0}
        for p in pieces:
            for k in range(1, len(p) + 1):
                node.setdefault(p[:k], len(node))
        self.piece = np.full(len(node), -1, np.int32)
        self.piece[[node[p] for p in pieces]] = np.arange(len(pieces))
        self.first = np.full(self.letters, -1, np.int32)
        self.bits = max(10, (4 * len(node)).bit_length())
        keys, values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        for text, number in node.items():
            if len(text) == 1:
                self.first[self.letter[ord(text)]] = number
            elif text:
                key = node[text[:-1]] * self.letters + int(self.letter[ord(text[-1])])
                slot = int(self._slots(np.array([key]))[0])
                while keys[slot] >= 0:
                    slot = (slot + 1) % len(keys)
                keys[slot], values[slot] = key, number
        self.keys, self.values = keys, values

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The nodes after one more letter, -1 where no piece goes on."""
        key = nodes.astype(np.int64) * self.letters + letters
        slot = self._slots(key)
        there = self.keys[slot]
        out = np.where(there == key, self.values[slot], -1)
        open_ = np.flatnonzero((there != key) & (there >= 0))
        while open_.size:
            slot[open_] = (slot[open_] + 1) % len(self.keys)
            there = self.keys[slot[open_]]
            found = there == key[open_]
            out[open_[found]] = self.values[slot[open_[found]]]
            open_ = open_[~found & (there >= 0)]
        return out


class Segments:
    """Forward and backward sums over all segmentations, for many words at a time."""

    def __init__(self, pieces: list[str]) -> None:
        self.number = {p: i for i, p in enumerate(pieces)}
        self.size = len(pieces) + 1  # the last number: a letter that is no piece
        self.longest = max(map(len, pieces), default=1)
        self.trie = Trie(pieces)

    def spans(self, words: list[str]) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray]]]:
        """Lengths of the words, which must come shortest first, and all spans (start, end, words, pieces) by start.

        The mark of the start stands before each word, so lengths are one more.
        """
        flat = np.frombuffer("".join(START + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.trie.letter[flat]
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begin = np.cumsum(length) - length
        out = []
        for a in range(int(length[-1]) if len(words) else 0):
            live = np.arange(np.searchsorted(length, a, side="right"), len(words))
            node = self.trie.first[letter[begin[live] + a]]
            number = np.where(node >= 0, self.trie.piece[node], -1)
            out.append((a, a + 1, live, np.where(number >= 0, number, self.size - 1)))
            for b in range(a + 2, a + self.longest + 1):
                on = (node >= 0) & (length[live] >= b)
                live, node = live[on], node[on]
                if not live.size:
                    break
                node = self.trie.step(node, letter[begin[live] + b - 1])
                number = np.where(node >= 0, self.trie.piece[node], -1)
                has = number >= 0
                if has.any():
                    out.append((a, b, live[has], number[has]))
        return length, out

    def forward(self, length: np.ndarray, spans: list, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over segmentations of the first k letters, and logarithms of their scales: (longest + 1, words, languages) both."""
        out = np.zeros((int(length[-1]) + 1, len(length), prob.shape[1]))
        scale = np.zeros(out.shape)
        out[0] = 1
        at = 0
        for a, b, own, number in spans:
            if a > at:
                at = a
                self._scaled(out, scale, a, slice(a, None))
            out[b, own] += out[a, own] * prob[number]
        return out, scale

    def backward(self, length: np.ndarray, spans: list, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((int(length[-1]) + 1, len(length), prob.shape[1]))
        scale = np.zeros(out.shape)
        out[length, np.arange(len(length))] = 1
        at = len(out)
        for a, b, own, number in reversed(spans):
            if a < at:
                at = a
                self._scaled(out, scale, a + 1, slice(0, a + 1 + self.longest))
            out[a, own] += out[b, own] * prob[number]
        return out, scale

    @staticmethod
    def _scaled(out: np.ndarray, scale: np.ndarray, at: int, used: slice) -> None:
        """Bring rows that are still used, and those to come, to the scale of row ``at``, where that is small."""
        if at < len(out) and out[at].min(initial=1) < SMALL:
            low = np.where((out[at] < SMALL) & (out[at] > 0), out[at], 1.0)
            out[used] /= low
            scale[used] += np.log(low)

    def scores(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """Log-probabilities (words, languages); words may have any lengths."""
        out = np.zeros((len(words), prob.shape[1]))
        for part in _alike(words, prob.shape[1]):
            if len(words[part[0]]) > 256:
                out[part] = self._long(START + words[part[0]], prob)
            else:
                length, spans = self.spans([words[k] for k in part])
                ahead, scale = self.forward(length, spans, prob)
                last = length, np.arange(len(part))
                with np.errstate(divide="ignore"):
                    out[part] = np.maximum(np.log(ahead[last]), -1e300) + scale[last]
        return out

    def _long(self, word: str, prob: np.ndarray) -> np.ndarray:
        """One long word: the same sums, scaled at each letter, of which only the last few are held."""
        row, scale = [np.ones(prob.shape[1])], np.zeros(prob.shape[1])
        for b in range(1, len(word) + 1):
            total = np.zeros(prob.shape[1])
            for a in range(max(0, b - self.longest), b):
                number = self.number.get(word[a:b], self.size - 1 if a == b - 1 else -1)
                if number >= 0:
                    total += row[a - b] * prob[number]
            low = np.maximum(total, 1e-300)
            scale += np.log(low)
            row = [r / low for r in row[-self.longest :]] + [total / low]
        return scale

    def expected(self, words: list[str], count: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected counts of pieces in one language; prob: (pieces + 1, 1)."""
        total = np.zeros(self.size)
        for part in _alike(words, 2):
            length, spans = self.spans([words[k] for k in part])
            (ahead, up), (back, down) = ((x[:, :, 0], y[:, :, 0]) for x, y in (self.forward(length, spans, prob), self.backward(length, spans, prob)))
            with np.errstate(divide="ignore"):
                ahead, back = np.log(ahead) + up, np.log(back) + down
            whole = np.maximum(ahead[length, np.arange(len(part))], -1e300)
            for a, b, own, number in spans:
                share = np.exp(ahead[a, own] + back[b, own] - whole[own]) * count[part][own] * prob[number, 0]
                total += np.bincount(number, share, self.size)
        return total


def _alike(words: list[str], width: int, most: int = 600_000) -> Iterator[list[int]]:
    """Indices of words of like length, shortest first, as many as tables of ``most`` numbers hold; long words stand alone."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        n = len(words[order[at]])
        end = at + 1
        while n <= 256 and end < len(order) and len(words[order[end]]) <= max(n + 4, 8) and (end - at) * width * (len(words[order[end]]) + 2) < most:
            end += 1
        yield order[at:end]
        at = end


def fit(df: DataFrame, pieces: list[str], sample: int, rounds: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, piece probabilities (pieces + 1, languages) and letters' shares (by code
    point, the start mark among them), from ``(lang, text, order)``.

    Learns from about ``sample`` rows of each language: those whose hash ``order`` is under the
    share that gives so many; a language of fewer rows has them all. Languages without any
    word are not learned. The vocabulary is fixed and languages are few (more than
    MOST_LANGUAGES are an error), so what goes through the driver has a fixed bound.
    """
    df = df.where(F.col("lang").isNotNull())
    share = settle(df.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample)) / F.count("*")).alias("share")))
    if share.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows = df.join(F.broadcast(share), "lang").where(F.pmod("order", F.lit(1 << 30)) < F.col("share") * F.lit(1 << 30)).select("lang", "text")
    parallel = 2 * df.sparkSession.sparkContext.defaultParallelism

    def count(batches):
        for batch in batches:
            total: dict[str, Counter] = {}
            for name, t in zip(*(c.to_pylist() for c in batch.columns)):
                for block in _word_blocks(t):
                    total.setdefault(name, Counter()).update(block)
            flat = [(name, w, n) for name, own in total.items() for w, n in own.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in flat], pa.string()), pa.array([f[1] for f in flat], pa.string()), pa.array([f[2] for f in flat], pa.int64())], names=["lang", "word", "n"]
            )

    tokens = settle(rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition(parallel))
    letters = tokens.select(F.explode(F.split(F.concat(F.lit(START), "word"), "")).alias("letter"), "n").where("letter <> ''").groupBy("letter").agg(F.sum("n").alias("n"))
    shares = np.full(sys.maxunicode + 1, 0.5)
    for letter, n in letters.collect():  # at most the letters of Unicode
        shares[ord(letter)] += n
    shares /= shares[shares > 0.5].sum() or 1.0
    langs = sorted(r["lang"] for r in tokens.select("lang").distinct().collect())
    segments = Segments(pieces)
    prob = np.full((segments.size, max(len(langs), 1)), 1 / segments.size)
    number = {name: i for i, name in enumerate(langs)}
    for _ in range(rounds if langs else 0):
        now = prob

        def expect(batches, now=now):
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                names, words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), np.array(batch.column(2).to_pylist(), np.float64)
                for name in sorted(set(names)):
                    own = [i for i, x in enumerate(names) if x == name]
                    made = segments.expected([words[i] for i in own], counts[own], now[:, [number[name]]])
                    total[name] = total.get(name, 0) + made
            for name, made in total.items():
                some = np.flatnonzero(made > 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(made[some])], names=["lang", "piece", "n"])

        sums = tokens.mapInArrow(expect, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        prob = np.full_like(prob, 0.01)
        for name, piece, n in sums.collect():  # at most vocabulary x languages
            prob[piece, number[name]] += n
        prob /= prob.sum(0)
    prob[-1] = np.minimum(prob[-1], UNKNOWN)
    return langs, prob, np.log(shares).astype(np.float32)


class Scorer:
    """Log-likelihoods of texts, with the scores of at most about ``most`` words held at a time.

    Columns are the languages, and last a 1 for each word that some language makes likelier than
    single letters do, each with its share in all training words.
    """

    def __init__(self, pieces: list[str], prob: np.ndarray, letters: np.ndarray, most: int = 100_000) -> None:
        self.segments, self.prob, self.letters, self.most = Segments(pieces), prob, letters, most
        self.row: dict[str, int] = {}
        self.table = np.zeros((2 * most, prob.shape[1] + 1))

    def _add(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.row]
        if len(self.row) + len(new) > self.most:
            self.row, new = {}, list(words)
        if len(new) > len(self.table) - len(self.row):
            self.table = np.zeros((len(new), self.table.shape[1]))
        if new:
            first = len(self.row)
            self.row.update(zip(new, range(first, first + len(new))))
            own = self.table[first : first + len(new)]
            own[:, :-1] = self.segments.scores(new, self.prob)
            flat = np.frombuffer("".join(START + w for w in new).encode("utf-32-le", "surrogatepass"), np.uint32)
            begin = np.cumsum([0] + [len(w) + 1 for w in new[:-1]])
            own[:, -1] = own[:, :-1].max(1) > np.add.reduceat(self.letters[flat].astype(np.float64), begin)

    def totals(self, texts: list[list[str]]) -> np.ndarray:
        """Sums over each list of words: (texts, languages + 1)."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        out = np.zeros((len(texts), self.table.shape[1]))
        if size.any():
            self._add(set(chain.from_iterable(texts)))
            rows = np.fromiter(map(self.row.__getitem__, chain.from_iterable(texts)), np.int64, int(size.sum()))
            some = np.flatnonzero(size)
            out[some] = np.add.reduceat(self.table[rows], (np.cumsum(size) - size)[some])
        return out

    def judged(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """Number of words and log-likelihoods of each whole text, in order."""
        part: list[list[str]] = []
        held_words = 0
        for text in texts:
            if text is not None and len(text) > 1_000_000:
                yield from zip(map(len, part), self.totals(part))
                part, held_words = [], 0
                n, total = 0, np.zeros(self.table.shape[1])
                for block in _word_blocks(text):
                    n, total = n + len(block), total + self.totals([block])[0]
                yield n, total
                continue
            part.append(words_of(text))
            held_words += len(part[-1])
            if held_words > 100_000:
                yield from zip(map(len, part), self.totals(part))
                part, held_words = [], 0
        yield from zip(map(len, part), self.totals(part))


def _learned(df: DataFrame, pieces: list[str], id_col: str, text: str, lang: str, sample: int, rounds: int):
    """The model of :func:`fit` on the rows that may be learned from, broadcast (vocabulary x languages)."""
    learn = df.select(F.col(id_col).cast("string").alias("_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    learn = learn.where("_id is not null and pmod(crc32(_id), 5) <> 0").withColumn("order", F.xxhash64(F.lit("langid"), "_id", "text"))
    return df.sparkSession.sparkContext.broadcast((pieces, *fit(learn, pieces, sample, rounds)))


def _judged(shared, texts: list[str | None]) -> Iterator[tuple[str, float, float]]:
    """Language, score, and share of words that are likelier in a language than by letters alone; ``und`` without letters or languages."""
    pieces, langs, prob, letters = shared.value
    scorer = held(("langid", shared.value[2].tobytes()[:4096], len(pieces), *langs), lambda: Scorer(pieces, prob, letters))
    for n, total in scorer.judged(texts):
        if not n or not langs:
            yield "und", 0.0, 0.0
        else:
            own = total[:-1]
            yield langs[int(own.argmax())], float(1 / np.exp((own - own.max()) / n).sum()), float(total[-1] / n)


def identify(
    df: DataFrame, pieces: list[str], id_col: str = "doc_id", text: str = "text", lang: str = "lang", train: DataFrame | None = None,
    sample: int = 4_000, rounds: int = 3,
) -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, lang_pred, score.

    Learns only from rows of ``train`` (default: ``df``) with a language whose crc32 of the id
    as text, modulo 5, is not 0, about ``sample`` of them at most in each language. A text that is null or has no letter is
    ``und`` with score 0; without any training row, all are. ``score`` is the language's share
    of the likelihood per word. Rows that repeat an id are each returned; an empty frame gives
    an empty one.
    """
    shared = _learned(df if train is None else train, pieces, id_col, text, lang, sample, rounds)

    def run(batches):
        for batch in batches:
            made = list(_judged(shared, batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=["doc_id", "lang_pred", "score"]
            )

    found = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    is_held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return found.select("doc_id", is_held.alias("held_out"), "lang_pred", "score")


def accepted(
    df: DataFrame, pieces: list[str], id_col: str = "doc_id", text: str = "text", lang: str = "lang", train: DataFrame | None = None,
    sample: int = 4_000, rounds: int = 3, least: float = LEAST,
) -> DataFrame:
    """The rows of ``df`` in a learned language, with all their columns, in one pass without a shuffle.

    A text without letters is rejected, and one of whose words a share below ``least`` is likelier
    in some language than by letters alone: random letters, or a script that wasn't learned. Rows are judged by themselves: null and repeated ids and
    columns of any names stay as they are. Without any training row nothing is accepted.
    """
    shared = _learned(df if train is None else train, pieces, id_col, text, lang, sample, rounds)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keep = [name != "und" and known >= least for name, _, known in _judged(shared, batch.column(text).to_pylist())]
                yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)
