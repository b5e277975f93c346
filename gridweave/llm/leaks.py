"""Benchmark decontamination by latent semantic retrieval.

The benchmark is taken in blocks of at most ``block_bytes`` of text, the query set that every document is held
against. For a block:

1. Words (runs of letters, digits and longer code points, lower-cased) of all documents become numbers of the block's
   vocabulary; words outside it can't add to a product with an item. They are stored once, as numbers.
2. Term counts over all documents give the weights log(1 + words / count) squared.
3. Randomised SVD: the passages (``cell`` words each) of all documents and the items are the rows of a TF-IDF matrix.
   Each row is added with a random sign to ``probe_rows`` of the test matrix's rows, tasks sum their part, the parts are
   summed by row, and the small product (``sketch`` rows, one column a term) gives the leading right vectors.
4. Windows of a few cells slide over each document, long enough to hold an item at any place. Windows whose latent vector
   has cosine ``cosine`` or more with an item's are candidates.
5. The longest common subsequence of item and window decides: ``verbatim`` of the item's words in order, or
   ``paraphrase`` of them with the whole answer (the item's last sentence, else last quarter) in order.

Only counts, the sketch (``sketch`` x vocabulary of a block) and a block of the benchmark meet on the driver.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.shelf import Shelf
from gridweave.llm.sums import summed
from gridweave.llm.words import PUNCTUATION, blocks, words

FOUND = "doc_id long, item long, cosine double, lcs int, item_words int, answer boolean, first_word int, last_word int, raw string"


#: The sketch is summed in this many runs of rows; it divides the number of rows.
CHUNKS = 16


class Vocabulary:
    """Numbers of word fingerprints, by direct address."""

    def __init__(self, fingerprints: np.ndarray):
        self.words = np.append(np.unique(fingerprints), np.uint64(0))
        self.bits = max(12, int(np.ceil(np.log2(len(self.words) * 16))))
        self.tables = []
        left = np.arange(len(self.words) - 1)
        for shift in range(0, 64 - self.bits, 7):
            if not len(left):
                break
            table = np.full(1 << self.bits, len(self.words) - 1, dtype=np.int32)
            place = self._place(self.words[left], shift)
            table[place] = left
            self.tables.append((shift, table))
            left = left[table[place] != left]
        if len(left):
            raise ValueError("fingerprints of the vocabulary meet at every place")

    def __len__(self) -> int:
        return len(self.words) - 1

    def _place(self, hashes: np.ndarray, shift: int) -> np.ndarray:
        return ((hashes >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 if it isn't in the vocabulary."""
        out = np.full(len(hashes), -1, dtype=np.int32)
        for shift, table in self.tables:
            at = table[self._place(hashes, shift)]
            hit = self.words[at] == hashes
            out[hit] = at[hit]
        out[out == len(self.words) - 1] = -1
        return out


class Item(NamedTuple):
    """A benchmark passage: its key, its words and those of its answer, as numbers of the vocabulary."""

    key: int
    words: list[int]
    answer: list[int]


def _hashes(texts: list[str]) -> list[np.ndarray]:
    out = []
    for block in blocks(pc.utf8_lower(pa.array(texts, pa.string()))):
        w = words(block, PUNCTUATION)
        out += [w.hash[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:])]
    return out


def _answer(text: str) -> str:
    """The last sentence of a text of several, else its last quarter."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n", text) if s.strip()]
    if len(sentences) > 1:
        return sentences[-1]
    own = text.split()
    return " ".join(own[len(own) - max(1, len(own) // 4) :])


def items_of(rows: list[tuple[int, str]]) -> tuple[Vocabulary, list[Item]]:
    """The vocabulary and the items of a block of the benchmark."""
    full, answers = _hashes([t for _, t in rows]), _hashes([_answer(t) for _, t in rows])
    vocabulary = Vocabulary(np.concatenate([np.zeros(0, np.uint64), *full]))
    number = lambda h: vocabulary.numbers(h).tolist()
    return vocabulary, [Item(key, number(f), number(a)) for (key, _), f, a in zip(rows, full, answers) if len(f)]


def tokens(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, raw, words): each whole text as numbers of the vocabulary, two or four bytes each."""
    kind = np.int16 if len(vocabulary) < 32_000 else np.int32

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for block in blocks(batch["text"]):
                data = block.data.tobytes()
                raw += [hashlib.md5(data[a:b]).hexdigest() for a, b in zip(block.offsets[:-1], block.offsets[1:])]
            for block in blocks(pc.utf8_lower(batch["text"])):
                w = words(block, PUNCTUATION)
                numbers = vocabulary.numbers(w.hash).astype(kind)
                at, n = block.first, len(w.bounds) - 1
                body = pa.array([numbers[a:b].tobytes() for a, b in zip(w.bounds[:-1], w.bounds[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, n), pa.array(raw[at : at + n], pa.string()), body], ["doc_id", "raw", "words"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(made, "doc_id long, raw string, words binary")


def _numbers(batch: pa.RecordBatch, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All words of a batch of ``tokens``, and the bounds of its documents."""
    data = [np.frombuffer(x, kind) for x in batch["words"].to_pylist()]
    return np.concatenate([np.zeros(0, kind), *data]).astype(np.int64), np.cumsum([0, *map(len, data)])


def term_counts(rows: DataFrame, size: int, kind: type) -> np.ndarray:
    """How often each term occurs in all documents; at [size] all other words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            numbers, _ = _numbers(batch, kind)
            total += np.bincount(np.where(numbers < 0, size, numbers), minlength=size + 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    out = np.zeros(size + 1, dtype=np.int64)
    for r in rows.select("words").mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def sketched(rows: DataFrame, weights: np.ndarray, kind: type, cell: int, sketch: int, probe_rows: int) -> np.ndarray:
    """The test matrix times the TF-IDF matrix of all passages, summed over tasks and then by row."""
    size = len(weights)

    def part(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        random = np.random.default_rng(TaskContext.get().partitionId())
        total = np.zeros(sketch * size)
        for batch in batches:
            numbers, bounds = _numbers(batch, kind)
            lengths = np.diff(bounds)
            inside = np.arange(len(numbers)) - np.repeat(bounds[:-1], lengths)
            passage = np.cumsum(inside % cell == 0) - 1
            known = numbers >= 0
            term, passage = numbers[known], passage[known]
            if not len(term):
                continue
            weight = weights[term]
            weight = weight / np.sqrt(np.bincount(passage, weight * weight))[passage]
            for _ in range(probe_rows):
                row = random.integers(0, sketch, passage[-1] + 1)
                sign = random.integers(0, 2, passage[-1] + 1) * 2.0 - 1
                total += np.bincount(row[passage] * size + term, weight * sign[passage], minlength=sketch * size)
        return dict(enumerate(total.reshape(CHUNKS, -1)))

    out = np.zeros((CHUNKS, sketch * size // CHUNKS))
    for chunk, total in summed(rows.select("words"), part, out.shape[1]).items():
        out[chunk] = total
    return out.reshape(sketch, size)


def latent_basis(sketch: np.ndarray, items: list[Item], weights: np.ndarray, rank: int) -> np.ndarray:
    """Leading right vectors of the sketched passages and the items, both with the same total weight."""
    own = np.zeros((len(items), len(weights)))
    for i, item in enumerate(items):
        np.add.at(own[i], item.words, weights[item.words])
        own[i] /= max(np.linalg.norm(own[i]), 1e-12)
    scale = np.linalg.norm(sketch) / max(np.linalg.norm(own), 1e-12) or 1.0
    _, values, right = np.linalg.svd(np.concatenate([sketch, own * scale]), full_matrices=False)
    kept = min(rank, int((values > 1e-9 * max(values[0], 1e-300)).sum()))
    return (right[:kept] * weights).T.astype(np.float32)


def lcs(masks: dict[int, int], length: int, other: list[int]) -> int:
    """Length of the longest common subsequence; ``masks`` has the places of each word among ``length`` words, as bits."""
    row = full = (1 << length) - 1
    for word in other:
        hit = masks.get(word)
        if hit is not None:
            both = row & hit
            row = ((row + both) | (row - both)) & full
    return length - row.bit_count()


def _masks(sequence: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, word in enumerate(sequence):
        out[word] = out.get(word, 0) | 1 << i
    return out


def _searched(rows: DataFrame, items: list[Item], basis: np.ndarray, counts: np.ndarray, kind: type, cell: int, cosine: float, verbatim: float, paraphrase: float) -> DataFrame:
    """The best window of each document and item that passes both checks."""
    latent = np.stack([basis[i.words].sum(axis=0) for i in items])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    spans = np.array([-(-len(i.words) // cell) + 1 for i in items])
    pad = int(spans.max()) - 1  # empty cells after each document, so that no window holds words of two
    # Frequent terms are counted by cell and multiplied as a matrix; the others are looked up one by one.
    frequent = np.argsort(-counts, kind="stable")[:512]
    slot = np.full(len(basis), -1)
    slot[frequent] = np.arange(len(frequent))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [(_masks(i.words), _masks(i.answer)) for i in items]
        for whole in batches:
            at = 0
            while at < len(whole):  # some documents at a time, by size
                to, held = at, 0
                while to < len(whole) and held < 1 << 18:
                    held += len(whole["words"][to].as_buffer()) if whole["words"][to].is_valid else 0
                    to += 1
                yield from searched(whole.slice(at, to - at), masks)
                at = to

    def searched(batch: pa.RecordBatch, masks: list) -> Iterator[pa.RecordBatch]:
        numbers, bounds = _numbers(batch, kind)
        lengths = np.diff(bounds)
        cells = -(-lengths // cell) + pad
        first_cell = np.concatenate([[0], np.cumsum(cells)])
        doc_of_cell = np.repeat(np.arange(len(lengths)), cells)
        inside = np.arange(len(numbers)) - np.repeat(bounds[:-1], lengths)
        at = np.repeat(first_cell[:-1], lengths) + inside // cell
        known = numbers >= 0
        at, term = at[known], numbers[known]
        own = slot[term]
        often = own >= 0
        size = len(frequent)
        table = np.bincount(at[often] * size + own[often], minlength=int(first_cell[-1]) * size).astype(np.float32)
        total = table.reshape(-1, size) @ basis[frequent]
        at, term = at[~often], term[~often]
        if len(term):
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            total[at[starts]] += np.add.reduceat(basis[term], starts, axis=0)
        best: dict[tuple[int, int], tuple] = {}
        window = total.copy()
        for span in range(1, pad + 2):
            if span > 1:
                window[: len(total) - span + 1] += total[span - 1 :]
            group = np.flatnonzero(spans == span)
            norm = np.sqrt(np.einsum("ij,ij->i", window, window))
            for a in range(0, len(group), 1024):
                near = window @ latent[group[a : a + 1024]].T
                for c, g in zip(*np.nonzero((near >= cosine * norm[:, None]) & (norm[:, None] > 0))):
                    d, i = doc_of_cell[c], group[a + g]
                    from_word = bounds[d] + (c - first_cell[d]) * cell
                    to_word = min(from_word + span * cell, bounds[d + 1])
                    here = numbers[from_word:to_word].tolist()
                    n = len(items[i].words)
                    common = lcs(masks[i][0], n, here)
                    if common < paraphrase * n or common <= best.get((d, i), (0,))[0]:
                        continue
                    answered = lcs(masks[i][1], len(items[i].answer), here) == len(items[i].answer)
                    if common >= verbatim * n or answered:
                        best[d, i] = (common, float(near[c, g] / norm[c]), n, answered, int(from_word - bounds[d]), int(to_word - bounds[d]))
        if best:
            ids, raw = batch["doc_id"].to_pylist(), batch["raw"].to_pylist()
            out = [(ids[d], items[i].key, b[1], b[0], b[2], b[3], b[4], b[5], raw[d]) for (d, i), b in best.items()]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in FOUND.split(", ")])

    return rows.mapInArrow(found, FOUND)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    rank: int = 128,
    sketch: int = 256,
    probe_rows: int = 1,
    cell: int = 16,
    cosine: float = 0.5,
    verbatim: float = 0.8,
    paraphrase: float = 0.6,
    block_bytes: int = 1 << 20,
) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, item_words, answer, first_word, last_word, raw): documents that hold an item.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored. One row for each row of
    ``docs`` and item found in it, with its best window. Null, empty and wordless texts hold nothing and are found
    nowhere; items with the same text are one, with the smallest item_id; a null doc_id stays null (``raw``, the MD5 of
    the text, names the row). Empty tables give an empty one.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark, "leaks")
    one = benchmark.where("text is not null").groupBy(F.col("text").cast("string").alias("text")).agg(F.min(F.col("item_id").cast("long")).alias("item_id"))
    bytes_of = one.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-bytes_of // block_bytes)
    found = spark.createDataFrame([], FOUND.replace("item long", "item_id long"))
    for part in range(parts):
        rows = one.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()  # about block_bytes
        ids = [r["item_id"] for r in rows]
        vocabulary, items = items_of([(i, r["text"]) for i, r in enumerate(rows)])
        if not items:
            continue
        kind = np.int16 if len(vocabulary) < 32_000 else np.int32
        held = shelf.put(tokens(docs, vocabulary))
        counts = term_counts(held, len(vocabulary), kind)
        weights = np.log1p(max(counts.sum(), 1) / np.maximum(counts[:-1], 1)) ** 2
        basis = latent_basis(sketched(held, weights, kind, cell, sketch, probe_rows), items, weights, rank)
        own = shelf.put(_searched(held, items, basis, counts[:-1], kind, cell, cosine, verbatim, paraphrase))
        shelf.drop(held)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "item long, item_id long")
        found = found.union(own.join(F.broadcast(names), "item").select(found.columns))
    return found
