"""Benchmark decontamination by latent semantic retrieval.

Method.  Passages are windows of ``2 * STRIDE`` words, every ``STRIDE`` words, over whole texts.  A randomised SVD of the
passages' TF-IDF matrix is computed in one distributed pass: each partition adds its passages, with random signs, into
``SKETCH`` rows of a sparse (count-sketch) range finder; the sums are added by row and decomposed.  TF-IDF columns are
the words that occur in the benchmark, as no other word can add to a product with an item.  A second pass folds every
passage into the latent space (coordinates scaled by the inverse singular values), takes the items with a cosine of at
least ``MIN_COSINE`` as candidates.  As words that many documents hold weigh next to nothing there, an item is also a
candidate, by exact look-up and whatever the weights, wherever a stretch of 1.25 times its length begins that holds one in
``THIN`` of its runs of three words.  Each candidate is checked where the text still is at hand: the longest common
subsequence of words with the item, within a stretch of 1.25 times the item's length, and that of the item's answer
(its last line or sentence).  A document is contaminated by an item when the stretch holds ``COPIED`` of the item in
order, or ``PARAPHRASED`` of it together with ``ANSWERED`` of its answer.

Scale.  The texts are read twice and never shuffled.  What moves: ``SKETCH`` vectors a task.  The benchmark is taken in
blocks of ``ITEM_BLOCK`` items and ``BLOCK_WORDS`` words at most; one block at a time is sent to the tasks, and what it
finds is written before the next one is, so that what is broadcast has a fixed bound and passes grow with the blocks.  The
words of a block fall into at most ``MAX_TERMS`` columns (beyond that by hash; the check of candidates is on the words
themselves).

Defined results: null or empty texts and items match nothing; items of fewer than ``SHORT`` words match as a whole word
for word, those of under ``LEAST`` never do; a pair is returned once, with its best stretch; repeated document rows give
repeated pairs; empty tables give none.  Columns beside id and text, whatever their names, pass through ``keep_clean`` and
aren't read by ``contaminated``.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, materialise

STRIDE, RANK, SKETCH, SEED = 16, 128, 256, 7
MIN_COSINE, COPIED, PARAPHRASED, ANSWERED, SLACK = 0.43, 0.7, 0.55, 0.85, 1.25
SHORT, LEAST, THIN = 10, 4, 12
ITEM_BLOCK, BLOCK_WORDS, MAX_TERMS = 5_000, 1 << 20, 1 << 15
CHUNK = 1 << 15  # words in hand at once
SLOTS, MOST = 1 << 20, 1 << 21  # slots that tell at once most runs of no item; hits times items in hand at once
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

_MARKS = bytes(x for x in range(128) if not chr(x).isalnum())
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _MARKS, b"abcdefghijklmnopqrstuvwxyz" + b" " * len(_MARKS))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_PLAIN).split() if text else []


def answer_of(text: str) -> str:
    """The last line or, of a single line, the last sentence."""
    parts = [x for x in (text or "").split("\n") if x.strip()]
    if len(parts) < 2:
        parts = [x for x in re.split(r"(?<=[.!?])\s+", text or "") if x.strip()]
    return parts[-1] if parts else ""


def common_subsequence(masks: dict[int, int], length: int, other) -> int:
    """Length of the longest common subsequence; ``masks`` has the bit set of positions of each word of one side."""
    full = (1 << length) - 1
    row = full
    for w in other:
        m = masks.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return length - row.bit_count()


def positions(words) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def runs_of_three(ids: np.ndarray) -> np.ndarray:
    """A hash of each three words in a row."""
    mixed = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        out = mixed[:-2] * _MIX[0] + mixed[1:-1] * _MIX[1] + mixed[2:] * _MIX[2]
        return out ^ out >> np.uint64(29)


def contaminates(share: float, told: float) -> bool:
    return share >= COPIED or (share >= PARAPHRASED and told >= ANSWERED)


def rank(share: float, told: float) -> tuple:
    """Order of stretches: one that contaminates goes before any other, so that more candidates never lose a pair."""
    return contaminates(share, told), share, told


class Items:
    """A block of benchmark items over a vocabulary of its own words."""

    def __init__(self, rows: list[tuple]):
        self.keys, self.words, self.answers = [], [], []
        self.vocabulary: dict[bytes, int] = {}
        for key, text in rows:
            words = words_of((text or "").encode())
            if len(words) < LEAST:
                continue
            self.keys.append(key)
            self.words.append([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words])
            self.answers.append([self.vocabulary[w] for w in words_of(answer_of(text).encode()) if w in self.vocabulary])
        self.columns = max(1, min(len(self.vocabulary), MAX_TERMS))
        self.masks = [positions(w) for w in self.words]
        self.answer_masks = [positions(a) for a in self.answers]
        self.terms = self.latent = None
        self._index()

    def _index(self) -> None:
        """Where each run of three words occurs: the items from SHORT words on that hold it."""
        long = [i for i, w in enumerate(self.words) if len(w) >= SHORT]
        runs = [np.unique(runs_of_three(np.asarray(self.words[i]))) for i in long]
        keys = np.concatenate([*runs, np.zeros(0, np.uint64)])
        owner = np.repeat(np.array(long, np.int64), [len(r) for r in runs])
        order = np.lexsort((owner, keys))
        self.owner = owner[order]
        self.runs, self.begins, self.held = np.unique(keys[order], return_index=True, return_counts=True)
        self.slots = np.zeros(SLOTS, bool)
        self.slots[self.runs % np.uint64(SLOTS)] = True
        length = np.array([len(w) for w in self.words], np.int64)
        self.span, self.need = (length * SLACK).astype(np.int64) + 1, np.maximum(1, length // THIN)
        self.reach = int(self.span.max()) if len(length) else 0

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words], np.int64)

    def solve(self, sketch: np.ndarray, frequency: np.ndarray, n_docs: int) -> None:
        """From the sketch of the term counts to the latent map of terms and the latent items."""
        weight = (np.log((1 + n_docs) / (1 + frequency)) + 1e-3) ** 2  # squared: common words alone make no candidate
        _, s, vt = np.linalg.svd(sketch * weight, full_matrices=False)
        rank = min(RANK, int((s > s[0] * 1e-6).sum())) if len(s) and s[0] > 0 else 0
        basis = vt[:rank].T / s[:rank] if rank else np.zeros((self.columns, 1))
        basis = weight[:, None] * basis
        # words that a large part of the documents hold weigh next to nothing; their rows are not looked up here, and
        # items made of such words are found by their runs of three words
        self.live = np.concatenate([weight >= 0.03 * weight.max(), [False]]) if rank else np.zeros(self.columns + 1, bool)
        basis[~self.live[:-1]] = 0
        self.terms = np.vstack([basis / max(np.abs(basis).max(), 1e-30), np.zeros((1, basis.shape[1]))]).astype(np.float32)
        long = [np.asarray(w) % self.columns if len(w) >= SHORT else np.zeros(0, int) for w in self.words]
        latent = np.array([self.terms[w].sum(axis=0) for w in long]).reshape(len(long), -1)
        self.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-30)).T.astype(np.float32)
        self.short = [i for i, w in enumerate(self.words) if len(w) < SHORT]

    def found(self, item: int, ids: list[int], at: int) -> tuple[float, float, int]:
        """Share of the item, share of its answer and place of the best stretch around the passage at ``at``."""
        words, n = self.words[item], len(self.words[item])
        span, low = int(n * SLACK) + 1, max(0, at - n)
        high = min(len(ids), at + 2 * STRIDE + (n if n <= 4 * STRIDE else span))  # a long item's slack is more than a passage
        area = ids[low:high]
        if common_subsequence(self.masks[item], n, area) < PARAPHRASED * n:
            return 0.0, 0.0, low
        best = (0.0, 0.0, low)
        for k in range(0, max(1, len(area) - span + max(1, n // 4)), max(1, n // 4)):
            stretch = area[k : k + span]
            share = common_subsequence(self.masks[item], n, stretch) / n
            if share >= PARAPHRASED and (share > best[0] or not contaminates(*best[:2])):
                answer = self.answers[item]
                told = common_subsequence(self.answer_masks[item], len(answer), stretch) / len(answer) if answer else 0.0
                if rank(share, told) > rank(*best[:2]):
                    best = (share, told, low + k)
        return best

    def search(self, texts: list[bytes | None]):
        """``(text number, item, cosine, share, answer share, word)`` of every contaminated pair."""
        batch: list[tuple[int, np.ndarray]] = []
        held = 0
        for number, text in enumerate(texts):
            ids = self.ids(words_of(text))
            if len(ids) < LEAST:
                continue
            batch.append((number, ids))
            held += len(ids)
            if held >= CHUNK:
                yield from self._search(batch)
                batch, held = [], 0
        yield from self._search(batch)

    def _search(self, batch):
        best: dict[tuple[int, int], tuple] = {}
        for number, ids in batch:  # a text longer than a chunk goes through in parts that overlap by one block
            for start in range(0, max(1, len(ids) - STRIDE), CHUNK):
                part = ids[start : start + CHUNK + STRIDE]
                for at, item, cosine in self._candidates(part, self._copies(ids[start : start + CHUNK + STRIDE + self.reach])):
                    self._check(best, number, ids, item, cosine, start + at)
            if self.short:
                self._whole(best, number, ids)
        for (number, item), (cosine, share, told, at) in best.items():
            if contaminates(share, told):
                yield number, item, cosine, share, told, at

    def _copies(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(word, item)`` from which a stretch holds enough of the item's runs of three words."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        runs = runs_of_three(ids)
        at = np.flatnonzero(self.slots[runs % np.uint64(SLOTS)])
        if not len(at) or not len(self.runs):
            return out[0]
        place = np.minimum(np.searchsorted(self.runs, runs[at]), len(self.runs) - 1)
        true = self.runs[place] == runs[at]
        at, place = at[true], place[true]
        total = np.cumsum(self.held[place])
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + MOST, "right")))
            k = int(np.searchsorted(at, at[j - 1] + self.reach, "right"))
            held = self.held[place[i:k]]
            within = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
            item, word = self.owner[np.repeat(self.begins[place[i:k]], held) + within], np.repeat(at[i:k], held)
            order = np.lexsort((word, item))
            item, word = item[order], word[order]
            key = item * (len(ids) + self.reach + 1) + word
            enough = np.searchsorted(key, key + self.span[item], "left") - np.arange(len(key)) >= self.need[item]
            enough &= word <= at[j - 1]
            out.append((word[enough], item[enough]))
            i = j
        return tuple(np.concatenate(x) for x in zip(*out))

    def _candidates(self, ids: np.ndarray, copies: tuple[np.ndarray, np.ndarray]):
        known = np.flatnonzero(self.live[np.where(ids < 0, self.columns, ids % self.columns)])
        blocks = (len(ids) + STRIDE - 1) // STRIDE
        within = copies[0] < len(ids)
        if not len(known) and not within.any():
            return
        sums = np.zeros((blocks + 1, self.terms.shape[1]), np.float32)
        if len(known):
            block = known // STRIDE
            first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            sums[block[first]] = np.add.reduceat(self.terms[ids[known] % self.columns], first, axis=0)
        passages = sums[:-1] + sums[1:]
        length = np.maximum(np.sqrt(np.einsum("ij,ij->i", passages, passages)), 1e-30)
        cosines = passages @ self.latent
        chosen = cosines >= MIN_COSINE * length[:, None]
        chosen[copies[0][within] // STRIDE, copies[1][within]] = True
        for p, item in zip(*np.nonzero(chosen)):
            yield int(p) * STRIDE, int(item), float(cosines[p, item] / length[p])

    def _check(self, best, number, ids, item, cosine, at):
        share, told, place = self.found(item, ids[max(0, at - 4 * len(self.words[item])) : at + 2 * STRIDE + 4 * len(self.words[item])].tolist(), min(at, 4 * len(self.words[item])))
        place += max(0, at - 4 * len(self.words[item]))
        if share and rank(share, told) > rank(*best.get((number, item), (0, 0.0, 0.0))[1:3]):
            best[number, item] = (cosine, share, told, place)

    def _whole(self, best, number, ids):
        for item in self.short:
            words = np.asarray(self.words[item])
            starts = np.flatnonzero(ids[: len(ids) - len(words) + 1] == words[0]) if len(ids) >= len(words) else []
            for at in starts:
                if np.array_equal(ids[at : at + len(words)], words):
                    best[number, item] = (1.0, 1.0, 1.0, int(at))
                    break


def _sketched(docs: DataFrame, items: Items) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums over the whole corpus: the sketch of the passages' term counts, document frequencies, documents."""
    width = items.columns

    def run(batches):
        rng = np.random.default_rng(SEED)
        odd = rng.integers(1, 1 << 62, 2, dtype=np.uint64) | np.uint64(1)
        sketch, frequency, n, cells, signs, held = np.zeros(SKETCH * width), np.zeros(width), 0, [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                n += 1
                ids = items.ids(words_of(text.as_py()))
                at = np.flatnonzero(ids >= 0)
                if not len(at):
                    continue
                terms = ids[at] % width
                frequency[np.unique(terms)] += 1
                with np.errstate(over="ignore"):
                    mixed = (np.uint64((key or 0) & (1 << 64) - 1) + np.uint64(1)) * odd[0] + (at // (2 * STRIDE)).astype(np.uint64) * odd[1]
                    mixed = (mixed ^ (mixed >> np.uint64(31))) * odd[1]
                cells.append((mixed >> np.uint64(33)).astype(np.int64) % SKETCH * width + terms)
                signs.append((mixed >> np.uint64(20) & np.uint64(1)).astype(np.float64) * 2 - 1)
                held += len(at)
                if held > 1 << 20:
                    sketch += np.bincount(np.concatenate(cells), np.concatenate(signs), SKETCH * width)
                    cells, signs, held = [], [], 0
        if held:
            sketch += np.bincount(np.concatenate(cells), np.concatenate(signs), SKETCH * width)
        rows = sketch.reshape(SKETCH, width).astype(np.float32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, SKETCH), pa.int32()), pa.array([frequency.astype(np.float32).tobytes(), *(r.tobytes() for r in rows)], pa.binary()), pa.array([n] + [0] * SKETCH, pa.int64())], names=["line", "data", "n"]
        )

    def added(frame):
        total = np.zeros(width)
        for data in frame["data"]:
            total += np.frombuffer(data, np.float32)
        return pd.DataFrame({"line": frame["line"].iloc[:1], "data": [total.tobytes()], "n": [int(frame["n"].sum())]})

    parts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "line int, data binary, n long")
    sketch, frequency, n = np.zeros((SKETCH, width)), np.zeros(width), 0
    for r in parts.groupBy("line").applyInPandas(added, "line int, data binary, n long").collect():  # SKETCH vectors of at most MAX_TERMS sums
        if r.line < 0:
            frequency, n = np.frombuffer(r.data), r.n
        else:
            sketch[r.line] = np.frombuffer(r.data)
    return sketch, frequency, n


def item_blocks(benchmark: DataFrame, size: int = ITEM_BLOCK, most: int = BLOCK_WORDS):
    """The benchmark, block by block of bounded size (an item of more words than that is a block of its own)."""
    block, held = [], 0
    for r in benchmark.select("item_id", F.col("text").cast("string")).toLocalIterator():
        n = (r[1] or "").count(" ") + 1
        if block and (len(block) == size or held + n > most):
            yield Items(block)
            block, held = [], 0
        block.append((r[0], r[1]))
        held += n
    if block:
        yield Items(block)


def solved_blocks(docs: DataFrame, benchmark: DataFrame):
    """``(items, whether it is the last)`` of each block that has items to look for, one at a time."""
    waiting = None
    for items in item_blocks(benchmark):
        if items.keys:
            if waiting:
                yield waiting, False
            waiting = items
            items.solve(*_sketched(docs, items))
    if waiting:
        yield waiting, True


PAIRS = "doc_id long, item_id long, cosine double, share double, answer_share double, word_at long"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row of ``PAIRS`` for each document and benchmark item found in it."""
    out = None
    for items, last in solved_blocks(docs, benchmark):
        found = _found(docs, items)
        found = found if last else materialise(found, "pairs")
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], PAIRS) if out is None else out


def _found(docs: DataFrame, items: Items) -> DataFrame:
    def run(batches):
        for batch in batches:
            texts, keys = [t.as_py() for t in batch.column(1).cast(pa.large_binary())], batch.column(0).to_pylist()
            rows = [(keys[i], items.keys[k], c, s, a, w) for i, k, c, s, a, w in items.search(texts)]
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "cosine", "share", "answer_share", "word_at"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PAIRS)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, columns unchanged, in which no benchmark item is found."""
    left = docs
    for items, last in solved_blocks(docs, benchmark):
        left = _without(left, items)
        left = left if last else materialise(left, "clean")
    return left


def _without(docs: DataFrame, items: Items) -> DataFrame:
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for i, *_ in items.search([t.as_py() for t in batch.column(at).cast(pa.large_binary())]):
                clean[i] = False
            yield batch.filter(pa.array(clean)).rename_columns(names)

    return map_batches(docs, run, T.StructType(docs.schema.fields))
