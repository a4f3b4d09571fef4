"""Interpolated modified Kneser-Ney language model of word pairs, counted in Spark and memory-mapped for scoring.

Method.  Words are counted in chunks, hashed, and added up by ranges of the hash; each range becomes a file of sorted
hashes with their counts, and a word's number is its place in those files.  A second pass counts pairs of numbers, dealt
to files by a hash of the first word, or of both for the few first words so frequent that their pairs would make one file
much larger; each file holds its pairs' keys in order, their counts, and the back-off weights of its first words.  Every
pair then adds one to the continuation count of its second word, kept beside the word counts.  Discounts are the three
of modified Kneser-Ney, from the counts of counts.  Scoring maps the files into memory and looks sorted queries up.

    p(b | a) = max(c(ab) - D(c(ab)), 0) / c(a) + gamma(a) p(b),   p(b) = max(n(b) - D(n(b)), 0) / n + lambda / (V + 1)

with n(b) the number of different words before b.  A word never seen gets lambda / (V + 1); after a word never seen, p(b).

Scale.  Texts are read three times and never shuffled.  Counts leave a task once for each chunk of words, already added
up.  Files are in the folder that all executors share; their number follows the corpus, so each has about the same size.
The driver sees sums, and the frequent words: those whose pairs would fill a file, so at most as many as files.

Defined results: null text is empty; every text ends with an end token; null ids learn and are not held out; repeated
rows are counted as often as they occur; an empty table gives no rows, and a model of nothing scores 0.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, new_path, remove

CHUNK = 1_500_000  # words in hand at once
DOCS_A_FILE, WORDS_A_FILE = 4096, 1_500_000
END = b""  # no word is empty
FOLD = np.uint64(0xFFFFFFFF)  # numbers of words beyond 2^32 are folded in pairs


def _path(uri: str) -> str | None:
    return uri[7:] if uri.startswith("file://") else uri if uri.startswith("/") else None


def save(uri: str, arrays: list[np.ndarray]) -> None:
    """Write arrays one after another; a task that runs again replaces the file as a whole."""
    data = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    path = _path(uri)
    if path is None:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(uri)
        with store.open_output_stream(name) as out:
            out.write(data)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        out.write(data)
    os.replace(part, path)


def mapped(uri: str, kinds: list[tuple[str, int]]) -> list[np.ndarray]:
    """The arrays of a file, mapped into memory."""
    path = _path(uri)
    if not sum(n for _, n in kinds):
        return [np.zeros(0, k) for k, _ in kinds]
    if path is None:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(uri)
        whole = np.frombuffer(store.open_input_file(name).read(), np.uint8)
    else:
        whole = np.memmap(path, np.uint8, "r")
    out, at = [], 0
    for kind, n in kinds:
        size = np.dtype(kind).itemsize * n
        out.append(whole[at : at + size].view(kind))
        at += size
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def tokens(text: bytes | None) -> list[bytes]:
    words = text.lower().split() if text else []
    words.append(END)
    return words


def _hashes(words) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words], np.uint64)


def _power(n: float, low: int, high: int) -> int:
    """Smallest power of two not below ``n``, as its exponent, within bounds."""
    return min(max(low, int(np.ceil(np.log2(max(1.0, n))))), high)


def _discounts(n: np.ndarray) -> np.ndarray:
    """D for counts 0, 1, 2 and from 3 on, of the numbers of types seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 3 - 3 * y]
    return np.array([0, *np.clip(d, [0.01, 0.01, 0.01], [0.99, 1.99, 2.99])])


def _tally(counts: np.ndarray) -> np.ndarray:
    return np.array([(counts == k).sum() for k in (1, 2, 3, 4)] + [(counts >= 3).sum()], np.int64)


@dataclass
class Model:
    folder: str
    word_bits: int
    pair_bits: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # words in each file
    pair_sizes: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))  # pairs and first words in each
    total: int = 0  # N
    types: int = 0  # V
    starts: int = 0  # training texts
    frequent: dict = field(default_factory=dict)  # number of a frequent first word: its back-off weight
    pair_discounts: np.ndarray = field(default_factory=lambda: np.zeros(4))
    word_discounts: np.ndarray = field(default_factory=lambda: np.zeros(4))
    continuations: int = 0
    word_backoff: float = 1.0

    def offsets(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.sizes)))

    def words_file(self, k: int, counts: bool = True) -> list[np.ndarray]:
        """Hashes and counts of a file of words, or the continuation counts beside it."""
        n = int(self.sizes[k])
        if counts:
            return mapped(f"{self.folder}/words-{k}", [("<u8", n), ("<i8", n)])
        return mapped(f"{self.folder}/continuations-{k}", [("<u4", n)])

    def pairs_file(self, k: int) -> list[np.ndarray]:
        """Keys of pairs and their discounted shares; first words and their back-off weights."""
        n, m = (int(x) for x in self.pair_sizes[k])
        return mapped(f"{self.folder}/shares-{k}", [("<u8", n), ("<f4", n), ("<u8", m), ("<f4", m)])

    def pair_file_of(self, a: np.ndarray, b: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """Number of the file of each pair."""
        if not self.pair_bits:
            return np.zeros(len(a), np.int64)
        with np.errstate(over="ignore"):
            spread = mix(a.astype(np.uint64) + np.uint64(1) + hot * mix(b.astype(np.uint64) + np.uint64(1)))
        return (spread >> np.uint64(64 - self.pair_bits)).astype(np.int64)


class Reader:
    """Looks words and pairs up in the mapped files."""

    def __init__(self, model: Model):
        self.model, self.offset = model, model.offsets()
        self.words = [model.words_file(k) for k in range(1 << model.word_bits)]
        self.hot = np.array(sorted(model.frequent), np.int64)
        self.start = model.types  # number of the text's start, beyond all words

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words, -1 if unknown, and their counts."""
        order = np.argsort(hashes)
        found, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        queries = hashes[order]
        shift = np.uint64(64 - self.model.word_bits)
        edge = np.searchsorted(queries >> shift, np.arange((1 << self.model.word_bits) + 1, dtype=np.uint64)) if self.model.word_bits else [0, len(queries)]
        for k, (keys, n) in enumerate(self.words):
            q = queries[edge[k] : edge[k + 1]]
            if len(q) and len(keys):
                at = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
                hit = keys[at] == q
                where = order[edge[k] : edge[k + 1]][hit]
                found[where], counts[where] = self.offset[k] + at[hit], n[at[hit]]
        return found, counts

    def continuations(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.int64)
        file = np.searchsorted(self.offset, numbers, "right") - 1
        for k in np.unique(file[numbers >= 0]):
            at = (file == k) & (numbers >= 0)
            out[at] = self.model.words_file(k, counts=False)[0][numbers[at] - self.offset[k]]
        return out

    def is_hot(self, numbers: np.ndarray) -> np.ndarray:
        return np.isin(numbers, self.hot).astype(np.uint64)


def _chunks(batches, at: int = 1):
    """Lists of texts' token lists, with the rows' other columns, of about ``CHUNK`` tokens."""
    held, others, n = [], [], 0
    for batch in batches:
        for i, text in enumerate(batch.column(at).cast(pa.large_binary())):
            words = tokens(text.as_py())
            held.append(words)
            others.append((batch, i))
            n += len(words)
            if n >= CHUNK:
                yield held, others
                held, others, n = [], [], 0
    if held:
        yield held, others


def _numbered(texts: list[list[bytes]], reader: Reader) -> tuple[np.ndarray, ...]:
    """Of all tokens in turn: place among the chunk's different words; of these: numbers, counts."""
    different: dict[bytes, int] = {}
    for words in texts:
        for w in words:
            if w not in different:
                different[w] = len(different)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    get = different.__getitem__
    local = np.fromiter((i for words in texts for i in map(get, words)), np.int64, int(lengths.sum()))
    numbers, counts = reader.numbers(_hashes(different))
    return local, lengths, numbers, counts


def _before(ids: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """The number of the token before each."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(lengths) - lengths] = start
    return before


def _count_words(model: Model, train: DataFrame) -> None:
    bits, folder = model.word_bits, model.folder

    def run(batches):
        for texts, _ in _chunks(batches, 0):
            tally = Counter()
            for words in texts:
                tally.update(words)
            hashes = _hashes(tally)
            counts = np.fromiter(tally.values(), np.int64, len(tally))
            order = np.argsort(hashes)
            hashes, counts = hashes[order], counts[order]
            edge = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) if bits else [0, len(hashes)]
            cut = [(k, edge[k], edge[k + 1]) for k in range(1 << bits) if edge[k] < edge[k + 1]]
            yield _batch(file=[k for k, _, _ in cut], a=[hashes[x:y].tobytes() for _, x, y in cut], b=[counts[x:y].tobytes() for _, x, y in cut])

    def merged(key, frame):
        hashes, counts = _joined(frame["a"], "<u8"), _joined(frame["b"], "<i8")
        hashes, first = _sorted_sums(hashes, counts)
        save(f"{folder}/words-{key[0]}", [hashes, first])
        # candidates for the frequent words: the caller knows the total only later
        top = np.argsort(-first, kind="stable")[:64]
        return pd.DataFrame({"file": [key[0]], "n": [len(hashes)], "total": [int(first.sum())], "a": [top.astype("<i8").tobytes()], "b": [first[top].astype("<i8").tobytes()]})

    sizes, tops = np.zeros(1 << bits, np.int64), {}
    for r in train.select("text").mapInArrow(run, "file int, a binary, b binary").groupBy("file").applyInPandas(merged, "file int, n long, total long, a binary, b binary").collect():
        sizes[r.file] = r.n
        model.total += r.total
        tops[r.file] = (np.frombuffer(r.a, "<i8"), np.frombuffer(r.b, "<i8"))
    model.sizes, model.types = sizes, int(sizes.sum())
    model.pair_bits = _power(model.total / WORDS_A_FILE, 0, 16)
    offset, least = model.offsets(), max(1, model.total >> model.pair_bits)
    # a word beyond this share is among its file's 64 most frequent unless that file alone has more than 64 of them
    model.frequent = {int(offset[k] + i): 0.0 for k, (at, n) in tops.items() for i, c in zip(at, n) if c >= least}
    model.frequent[model.types] = 0.0  # the start of a text


def _count_pairs(model: Model, train: DataFrame) -> DataFrame:
    """Writes the files of pairs; a row for each with its size and sums, and rows of continuation counts."""
    folder = model.folder

    def run(batches):
        reader = Reader(model)
        for texts, _ in _chunks(batches, 0):
            local, lengths, numbers, _ = _numbered(texts, reader)
            b = numbers[local]
            a = _before(b, lengths, reader.start)
            keys, counts = np.unique((a.astype(np.uint64) & FOLD) << np.uint64(32) | (b.astype(np.uint64) & FOLD), return_counts=True)
            first, second = keys >> np.uint64(32), keys & FOLD
            file = model.pair_file_of(first, second, reader.is_hot(first.astype(np.int64)))
            order = np.argsort(file, kind="stable")
            keys, counts, edge = keys[order], counts[order], np.searchsorted(file[order], np.arange((1 << model.pair_bits) + 1))
            cut = [(k, edge[k], edge[k + 1]) for k in range(1 << model.pair_bits) if edge[k] < edge[k + 1]]
            yield _batch(file=[k for k, _, _ in cut], a=[keys[x:y].tobytes() for _, x, y in cut], b=[counts[x:y].astype("<u4").tobytes() for _, x, y in cut])

    offset = model.offsets()

    def merged(key, frame):
        keys, counts = _sorted_sums(_joined(frame["a"], "<u8"), _joined(frame["b"], "<u4").astype("<i8"))
        save(f"{folder}/pairs-{key[0]}", [keys, counts.astype("<u4")])
        seconds, n = np.unique((keys & FOLD).astype(np.int64), return_counts=True)
        at = np.searchsorted(offset, seconds, "right") - 1
        edge = np.searchsorted(at, np.arange(len(offset)))
        cut = [(k, edge[k], edge[k + 1]) for k in range(len(offset) - 1) if edge[k] < edge[k + 1]]
        rows = [(int(key[0]), -1, np.array([len(keys)], "<i8").tobytes(), _tally(counts).astype("<i8").tobytes())]
        rows += [(int(key[0]), k, (seconds[x:y] - offset[k]).astype("<u4").tobytes(), n[x:y].astype("<u4").tobytes()) for k, x, y in cut]
        return pd.DataFrame(rows, columns=["file", "words", "a", "b"])

    counted = train.select("text").mapInArrow(run, "file int, a binary, b binary")
    return counted.groupBy("file").applyInPandas(merged, "file int, words int, a binary, b binary")


def _share_pairs(model: Model, spark) -> None:
    """From the counts of pairs to shares and back-off weights, file by file."""
    files, d, folder, lengths = 1 << model.pair_bits, model.pair_discounts, model.folder, model.pair_sizes
    hot = np.array(sorted(model.frequent), np.int64)

    def run(frames):
        for f in frames:
            for k in f["id"]:
                n = int(lengths[k, 0])
                keys, counts = mapped(f"{folder}/pairs-{k}", [("<u8", n), ("<u4", n)])
                keys, counts = np.array(keys), counts.astype(np.int64)
                first, start = np.unique(keys >> np.uint64(32), return_index=True)
                kind = np.minimum(counts, 3)
                sums = [np.add.reduceat(x, start) if n else np.zeros(0, np.int64) for x in (counts, kind == 1, kind == 2, kind == 3)]
                sums = [s.astype(np.int64) for s in sums]
                known = np.isin(first.astype(np.int64), hot)
                parts = np.vstack([first.astype(np.int64), *sums])[:, known]
                told = np.hstack([[[-1], [int((~known).sum())], [0], [0], [0]], parts])  # the file's own row, then frequent words
                yield pd.DataFrame({"file": k, **dict(zip(("word", "c", "n1", "n2", "n3"), told))})
                first, sums = first[~known], [s[~known] for s in sums]
                weight = (d[1] * sums[1] + d[2] * sums[2] + d[3] * sums[3]) / np.maximum(sums[0], 1)
                save(f"{folder}/backoff-{k}", [first.astype("<u8"), weight.astype("<f4"), sums[0].astype("<i8")])

    told = spark.range(0, files, 1, min(files, 200)).mapInPandas(run, "file int, word long, c long, n1 long, n2 long, n3 long")
    told = materialise(told, "lm-sums")
    for r in told.where("word < 0").select("file", "c").collect():
        model.pair_sizes[r.file, 1] = r.c
    names = ("c", "n1", "n2", "n3")
    sums = {r.word: [r[n] for n in names] for r in told.where("word >= 0").groupBy("word").agg(*[F.sum(n).alias(n) for n in names]).collect()}
    totals = {a: s[0] for a, s in sums.items()}
    model.frequent = {a: float(d[1] * s[1] + d[2] * s[2] + d[3] * s[3]) / s[0] for a, s in sums.items()}
    pair_sizes = model.pair_sizes

    def finish(frames):
        for f in frames:
            for k in f["id"]:
                n, m = (int(x) for x in pair_sizes[k])
                keys, counts = mapped(f"{folder}/pairs-{k}", [("<u8", n), ("<u4", n)])
                first, weight, total = mapped(f"{folder}/backoff-{k}", [("<u8", m), ("<f4", m), ("<i8", m)])
                a = np.asarray(keys) >> np.uint64(32)
                at = np.minimum(np.searchsorted(first, a), max(0, m - 1))
                whole = np.where(first[at] == a, total[at], 0) if m else np.zeros(n, np.int64)
                for i in np.flatnonzero(whole == 0):
                    whole[i] = totals[int(a[i])]
                counts = counts.astype(np.int64)
                share = (counts - d[np.minimum(counts, 3)]) / whole
                save(f"{folder}/shares-{k}", [keys, share.astype("<f4"), first, weight])
                yield pd.DataFrame({"file": [k]})

    spark.range(0, files, 1, min(files, 200)).mapInPandas(finish, "file int").count()
    for k in range(files):  # scoring needs the shares alone
        remove(spark, f"{folder}/pairs-{k}")
        remove(spark, f"{folder}/backoff-{k}")


def _batch(**columns) -> pa.RecordBatch:
    kinds = {"file": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.binary())) for k, v in columns.items()], names=list(columns))


def _joined(column, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in column])


def _sorted_sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def train(docs: DataFrame) -> Model:
    """Learn from all rows of ``docs(text)``; the files stay in the shared folder."""
    spark, n = docs.sparkSession, docs.count()
    model = Model(new_path(spark, "lm"), _power(n / DOCS_A_FILE, 0, 16))
    model.sizes = np.zeros(1 << model.word_bits, np.int64)
    if not n:
        return model
    docs = docs.select(F.col("text").cast("string"))
    _count_words(model, docs)
    model.starts = n
    told = materialise(_count_pairs(model, docs), "lm-counts")
    model.pair_sizes = np.zeros((1 << model.pair_bits, 2), np.int64)
    tally = np.zeros(5, np.int64)
    for r in told.where("words < 0").collect():
        model.pair_sizes[r.file, 0] = np.frombuffer(r.a, "<i8")[0]
        tally += np.frombuffer(r.b, "<i8")
    model.pair_discounts = _discounts(tally[:4])
    folder, sizes = model.folder, model.sizes

    def added(key, frame):
        counts = np.zeros(int(sizes[key[0]]), np.int64)
        for at, n in zip(frame["a"], frame["b"]):
            counts[np.frombuffer(at, "<u4")] += np.frombuffer(n, "<u4")
        save(f"{folder}/continuations-{key[0]}", [counts.astype("<u4")])
        return pd.DataFrame({"n": [int(counts.sum())], "b": [_tally(counts).astype("<i8").tobytes()]})

    tally = np.zeros(5, np.int64)
    for r in told.where("words >= 0").groupBy("words").applyInPandas(added, "n long, b binary").collect():
        model.continuations += r.n
        tally += np.frombuffer(r.b, "<i8")
    d = model.word_discounts = _discounts(tally[:4])
    model.word_backoff = float(d[1] * tally[0] + d[2] * tally[1] + d[3] * tally[4]) / model.continuations
    _share_pairs(model, spark)
    return model


class Scorer:
    """Log probabilities of texts, chunk by chunk."""

    def __init__(self, model: Model):
        self.model, self.reader = model, Reader(model)
        self.pairs = {}
        self.hot = self.reader.hot
        self.hot_weights = np.array([model.frequent[a] for a in self.hot.tolist()])

    def file(self, k: int):
        if k not in self.pairs:
            self.pairs[k] = self.model.pairs_file(k)
        return self.pairs[k]

    def word_probability(self, numbers: np.ndarray) -> np.ndarray:
        m = self.model
        n = self.reader.continuations(numbers)
        seen = np.where(n > 0, n - m.word_discounts[np.minimum(n, 3)], 0) / max(1, m.continuations)
        return seen + m.word_backoff / (m.types + 1)

    def score(self, texts: list[list[bytes]]) -> tuple[np.ndarray, ...]:
        """Of each text: tokens, known tokens, base score, score."""
        m = self.model
        local, lengths, numbers, counts = _numbered(texts, self.reader)
        base = np.log10((counts + 0.5) / (m.total + 0.5 * (m.types + 1)))
        lower = self.word_probability(numbers)
        b = numbers[local]
        a = _before(b, lengths, self.reader.start)
        probability = lower[local]
        both = np.flatnonzero((a >= 0) & (m.total > 0))
        # each different pair is looked up once, in the order of its file
        mixed = (a[both].astype(np.uint64) & FOLD) << np.uint64(32) | (np.where(b[both] < 0, 0xFFFFFFFF, b[both]).astype(np.uint64) & FOLD)
        keys, where = np.unique(mixed, return_inverse=True)
        share, weight = self._pairs(keys)
        probability[both] = share[where] + weight[where] * probability[both]
        start = np.cumsum(lengths) - lengths
        sums = [np.add.reduceat(x, start) for x in ((counts[local] > 0).astype(np.int64), base[local], np.log10(probability))]
        return lengths, *sums

    def _pairs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = self.model
        first = keys >> np.uint64(32)
        hot = np.minimum(np.searchsorted(self.hot, first.astype(np.int64)), len(self.hot) - 1)
        is_hot = self.hot[hot] == first.astype(np.int64) if len(self.hot) else np.zeros(len(keys), bool)
        file = m.pair_file_of(first, keys & FOLD, is_hot.astype(np.uint64))
        order = np.argsort(file, kind="stable")
        edge = np.searchsorted(file[order], np.arange((1 << m.pair_bits) + 1))
        share, weight = np.zeros(len(keys)), np.ones(len(keys))
        for k in range(1 << m.pair_bits):
            at = order[edge[k] : edge[k + 1]]
            if not len(at):
                continue
            pairs, shares, firsts, weights = self.file(k)
            q = keys[at]
            if len(pairs):
                i = np.minimum(np.searchsorted(pairs, q), len(pairs) - 1)
                share[at] = np.where(pairs[i] == q, shares[i], 0.0)
            if len(firsts):
                i = np.minimum(np.searchsorted(firsts, q >> np.uint64(32)), len(firsts) - 1)
                weight[at] = np.where(firsts[i] == q >> np.uint64(32), weights[i], 1.0)
        if len(self.hot):
            weight[is_hot] = self.hot_weights[hot[is_hot]]
        return share, weight


def learns(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5, F.lit(0)) != 1


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row."""

    def run(batches):
        scorer = Scorer(model)
        for texts, others in _chunks(batches):
            n, known, base, score = scorer.score(texts)
            ids = pa.array([batch.column(0)[i].as_py() for batch, i in others], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (~learns()).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def digest(docs: DataFrame) -> DataFrame:
    return scored(docs, train(docs.where(learns())))
