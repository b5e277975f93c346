"""Alignment of two tokenizers over whole texts, with an associative monoid of fragments.

1. Each text is encoded by a byte-level BPE (A, with a space ahead of the text) and by a piece BPE (B, which adds that space).
   Both must spell the same bytes. Byte offsets where tokens of both end cut the tokens into groups.
2. A text is taken in byte ranges of ``chunk_bytes``. A range gives a fragment: its tokens of A and B, the sizes of the groups that
   end in it, and what is left. The first group is open to the left (the open prefix), the tokens after the last end are open to the
   right (the open suffix), the groups between them are closed.
3. Fragments compose: the suffix of the left one and the prefix of the right one make one closed group, or go on being open where
   the right one has no end. Composition is associative, so the ranges of a very long text meet in a tree, ``FAN`` at a time, over
   as many tasks as there are groups; other texts have one fragment.
4. A link is the pair of tokens that end a group. One of them spells a suffix of the other, so the vocabularies alone say which
   pairs can occur (some hundred thousand): the corpus-wide counts are summed over tasks and sent to all tasks as one array.

Tokenizer files are read on the driver and sent to the tasks; executors need no copy of them.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.shelf import Shelf

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"

#: Fragments that one task composes at a time.
FAN = 8
#: Texts are encoded together up to this many characters.
BLOCK_CHARS = 1 << 18

#: Fixed value: the pattern by which byte-level BPE cuts a text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A run of white space this long is more than the recursion of the first encoder's pattern takes in the end.
BLANK_RUN = re.compile(r"\s{1000}")

FRAGMENT = "row long, doc_id long, chunk long, chunks long, body binary"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


class Fragment(NamedTuple):
    """Tokens of a byte range and the sizes of the groups that end in it, the first of which may begin before the range."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_sizes: np.ndarray
    b_sizes: np.ndarray


def packed(part: Fragment) -> bytes:
    """The fragment as bytes: lengths, bytes an entry and entries of its arrays, compressed."""
    kinds = [next(k for k in (np.uint8, np.uint16, np.uint32) if not len(x) or x.max() <= np.iinfo(k).max) for x in part]
    head = np.array([[len(x), np.dtype(k).itemsize] for x, k in zip(part, kinds)], np.uint32)
    return zstandard.compress(head.tobytes() + b"".join(x.astype(k).tobytes() for x, k in zip(part, kinds)), 1)


def unpacked(body: bytes) -> Fragment:
    data = zstandard.decompress(body)
    head, at, out = np.frombuffer(data, np.uint32, 8).reshape(4, 2).tolist(), 32, []
    for n, size in head:
        out.append(np.frombuffer(data, f"u{size}", n, at).astype(np.int64))
        at += n * size
    return Fragment(*out)


def composed(parts: Iterable[Fragment]) -> Fragment:
    """The fragment of consecutive ranges."""
    parts = list(parts)
    sizes = []
    for ids, own in ((0, 2), (1, 3)):
        out, open_tokens = [], 0
        for part in parts:
            ends = part[own]
            if len(ends):
                out += [np.array([open_tokens + ends[0]]), ends[1:]]
                open_tokens = len(part[ids]) - int(ends.sum())
            else:
                open_tokens += len(part[ids])
        sizes.append(np.concatenate([np.zeros(0, np.int64), *out]).astype(np.int64))
    joined = [np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]).astype(np.int64) for i in (0, 1)]
    return Fragment(*joined, *sizes)


def fragment(a_ids: np.ndarray, a_ends: np.ndarray, b_ids: np.ndarray, b_ends: np.ndarray) -> Fragment:
    """The fragment of tokens with their end offsets, both rising."""
    at = np.searchsorted(b_ends, a_ends)
    both = np.flatnonzero(b_ends[np.minimum(at, len(b_ends) - 1)] == a_ends) if len(b_ends) else np.zeros(0, np.int64)
    return Fragment(a_ids, b_ids, np.diff(both, prepend=-1), np.diff(at[both], prepend=-1))


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers from the bytes of their files; made once in each Python worker.

    A encodes by ranks; the slower general encoder of the same file takes the texts that are mostly blank.
    """

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes):
        self.files = (byte_bpe, piece_bpe)
        self._made = self._plain = None

    def __getstate__(self):
        return {"files": self.files, "_made": None, "_plain": None}

    def _load(self):
        if self._made is None:
            import sentencepiece
            import tiktoken

            spec = json.loads(self.files[0])
            special = {t["id"] for t in spec["added_tokens"]}
            letters = byte_letters()
            vocabulary = {i: bytes(letters[c] for c in piece) for piece, i in spec["model"]["vocab"].items() if i not in special}
            a = [b""] * (1 + max([*vocabulary, *special]))
            for i, piece in vocabulary.items():
                a[i] = piece
            # Ids are ranks of merges, which is what makes a byte-pair encoding by ranks the same as one by merges.
            for rank, pair in enumerate(spec["model"]["merges"]):
                left, right = pair.split(" ") if isinstance(pair, str) else pair
                if spec["model"]["vocab"][left + right] != 256 + rank:
                    raise ValueError("the ids of the byte-level vocabulary are not in the order of its merges")
            pieces = sentencepiece.SentencePieceProcessor(model_proto=self.files[1])
            b = []
            for i in range(pieces.get_piece_size()):
                piece = pieces.id_to_piece(i)
                b.append(bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode("utf-8"))
            if any(not a[i] for i in vocabulary) or not all(b):
                raise ValueError("a token without bytes ends nowhere of its own")
            encoding = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks={p: i for i, p in vocabulary.items()}, special_tokens={})
            self._made = encoding, pieces, a, b
        return self._made

    def spelled(self) -> tuple[list[bytes], list[bytes]]:
        """The bytes of each id of A and B; special tokens of A, which are never made, spell nothing."""
        return self._load()[2:]

    def _blank(self, text: str) -> list[int]:
        if self._plain is None:
            from tokenizers import Tokenizer

            self._plain = Tokenizer.from_str(self.files[0].decode("utf-8"))
            self._plain.encode_special_tokens = True
        return self._plain.encode(" " + text, add_special_tokens=False).ids

    def encoded(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of A and B of each text; none where the two don't spell a space and the text."""
        encoding, pieces, a, b = self._load()
        for text, b_ids in zip(texts, pieces.encode(texts, num_threads=1)):
            if BLANK_RUN.search(text):
                a_ids = self._blank(text)
            else:
                a_ids = encoding.encode_ordinary(" " + text) if text else []
            whole = (" " + text).encode("utf-8")
            same = text and b"".join(map(a.__getitem__, a_ids)) == whole and b"".join(map(b.__getitem__, b_ids)) == whole
            yield (a_ids, b_ids) if same else ([], [])


def possible_links(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """All pairs (A id << 32 | B id) of which one spells a suffix of the other, in rising order.

    A token of n bytes has n suffixes, so the number of pairs is bounded by the bytes of both vocabularies.
    """
    by_a, by_b = defaultdict(list), defaultdict(list)
    for ids, spelled in ((by_a, a), (by_b, b)):
        for i, piece in enumerate(spelled):
            if piece:
                ids[piece].append(i)
    pairs = {i << 32 | j for i, piece in enumerate(a) for k in range(len(piece)) for j in by_b.get(piece[k:], ())}
    pairs |= {i << 32 | j for j, piece in enumerate(b) for k in range(len(piece)) for i in by_a.get(piece[k:], ())}
    return np.array(sorted(pairs), np.int64)


def _some(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts) of consecutive texts; null is empty."""
    first, own, size = 0, [], 0
    for i, text in enumerate(column):
        own.append(text.as_py() or "")
        size += len(own[-1])
        if size >= BLOCK_CHARS:
            yield first, own
            first, own, size = i + 1, [], 0
    if own:
        yield first, own


def _fragments(docs: DataFrame, tokenizers, chunk_bytes: int) -> DataFrame:
    from pyspark import TaskContext

    names = [x.split()[0] for x in FRAGMENT.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.binary()]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = tokenizers.value
        a_long, b_long = (np.array([len(x) for x in side], np.int64) for side in tools.spelled())
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            for first, texts in _some(batch["text"]):
                out = []
                for k, (a, b) in enumerate(tools.encoded(texts), first):
                    a, b = np.array(a, np.int64), np.array(b, np.int64)
                    a_ends, b_ends = np.cumsum(a_long[a]), np.cumsum(b_long[b])
                    chunks = int(-(-a_ends[-1] // chunk_bytes)) if len(a) else 1
                    edges = np.arange(1, chunks) * chunk_bytes
                    a_cut = [0, *np.searchsorted(a_ends, edges, "right"), len(a)]
                    b_cut = [0, *np.searchsorted(b_ends, edges, "right"), len(b)]
                    for c in range(chunks):
                        own_a, own_b = slice(a_cut[c], a_cut[c + 1]), slice(b_cut[c], b_cut[c + 1])
                        out.append((row, ids[k], c, chunks, packed(fragment(a[own_a], a_ends[own_a], b[own_b], b_ends[own_b]))))
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(made, FRAGMENT)


def _tree(parts: DataFrame, shelf: Shelf) -> DataFrame:
    """One fragment for each row of texts with several."""

    def added(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        own = packed(composed(map(unpacked, group["body"])))
        return group[:1].assign(chunk=group["parent"], body=[own])[["row", "doc_id", "chunk", "chunks", "body"]]

    while True:
        parts = parts.withColumn("chunks", F.ceil(F.col("chunks") / FAN)).withColumn("parent", F.floor(F.col("chunk") / FAN))
        met = shelf.put(parts.groupBy("row", "parent").applyInPandas(added, FRAGMENT))
        if not met.where("chunks > 1").limit(1).count():
            return met
        parts = met


def _links(part: Fragment) -> np.ndarray:
    """The links of a whole text: A id << 32 | B id of the tokens that end its groups."""
    return part.a_ids[np.cumsum(part.a_sizes) - 1] << 32 | part.b_ids[np.cumsum(part.b_sizes) - 1]


def id_letters(most: int) -> tuple[np.ndarray, np.ndarray]:
    """(letters, lengths): row 4 i + s has the decimal number i and the separator s of ``,|,;``, one byte a letter."""
    texts = [f"{i}{mark}".encode() for i in range(most) for mark in ",|,;"]
    lengths = np.array(list(map(len, texts)))
    return np.array(texts, f"S{lengths.max()}").view(np.uint8).reshape(len(texts), -1), lengths


def written(part: Fragment, letters: np.ndarray, lengths: np.ndarray) -> str:
    """The groups of a whole text as ``a1,a2|b1;a3|b2,b3``."""
    if not len(part.a_sizes):
        return ""
    a_ends, b_ends = np.cumsum(part.a_sizes), np.cumsum(part.b_sizes)
    rows = np.empty(len(part.a_ids) + len(part.b_ids), np.int64)
    # A token stands after the tokens before it and those of the other side in earlier groups; B after A in its own group, too.
    a_at = np.arange(len(part.a_ids)) + np.repeat(b_ends - part.b_sizes, part.a_sizes)
    b_at = np.arange(len(part.b_ids)) + np.repeat(a_ends, part.b_sizes)
    rows[a_at], rows[b_at] = part.a_ids * 4, part.b_ids * 4 + 2
    rows[a_at[a_ends - 1]] += 1
    rows[b_at[b_ends - 1]] += 1
    kept = np.arange(letters.shape[1]) < lengths[rows][:, None]
    return letters[rows][kept].tobytes()[:-1].decode("ascii")


def align(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, chunk_bytes: int = 1 << 16) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for each row of ``docs`` (doc_id, text; others are ignored).

    ``groups`` has the ids of each group, A then B: ``a1,a2|b1;a3|b2,b3``. ``n_best`` counts links whose corpus-wide count is the
    highest of their B id (ties included), ``count_sum`` sums the counts over the links. A text that is null or empty, or that one
    of the tokenizers doesn't spell exactly, has no tokens: zeros and an empty ``groups``. Repeated rows and null ids are rows like
    any other. An empty table gives an empty one. Texts that spell a special token are plain text.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark, "align")
    with open(byte_bpe, "rb") as one, open(piece_bpe, "rb") as two:
        tools = Tokenizers(one.read(), two.read())
    links = possible_links(*tools.spelled())
    sent, universe = spark.sparkContext.broadcast(tools), spark.sparkContext.broadcast(links)
    parts = shelf.put(_fragments(docs, sent, chunk_bytes))
    whole = parts.where("chunks = 1").unionByName(_tree(parts.where("chunks > 1"), shelf))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = universe.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for body in batch["body"]:
                np.add.at(total, np.searchsorted(known, _links(unpacked(body.as_py()))), 1)
        seen = np.flatnonzero(total)
        for at in range(0, len(seen), 50_000):
            own = seen[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["link", "n"])

    # At most one row for each possible link.
    sums = whole.select("body").mapInArrow(counted, "link long, n long").groupBy("link").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(links), np.int64)
    counts[sums["link"].to_numpy()] = sums["n"].to_numpy()
    most = np.zeros(1 + int((links & 0xFFFFFFFF).max()), np.int64)
    np.maximum.at(most, links & 0xFFFFFFFF, counts)
    table = spark.sparkContext.broadcast((counts, counts == most[links & 0xFFFFFFFF]))
    most_id = max(map(len, tools.spelled()))
    names, kinds = [x.split()[0] for x in ALIGNED.split(", ")], [pa.int64()] * 7 + [pa.string()]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (count, best) = universe.value, table.value
        letters, lengths = id_letters(most_id)
        for batch in batches:
            doc_ids, out, size = batch["doc_id"].to_pylist(), [], 0
            for i, body in enumerate(batch["body"]):
                part = unpacked(body.as_py())
                at = np.searchsorted(known, _links(part))
                out.append((doc_ids[i], len(part.a_ids), len(part.b_ids), len(at), len(at), int(best[at].sum()), int(count[at].sum()), written(part, letters, lengths)))
                size += len(out[-1][-1])
                if size > BLOCK_CHARS or i + 1 == len(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names)
                    out, size = [], 0

    return whole.select("doc_id", "body").mapInArrow(measured, ALIGNED)
