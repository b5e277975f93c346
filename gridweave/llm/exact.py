"""Exact duplicates by an extendible-hash index in the shared folder.

1. Each task digests its texts, joins equal ones of an Arrow batch by their bytes, and writes an entry for each row;
   the first of equal rows (the head) carries the compressed bytes, their count and the largest doc_id.
2. The directory starts with one bucket over all digest prefixes and doubles while a bucket has more heads than
   ``capacity``; only overfull buckets split. It is built from at most 65,536 counts, whatever the input's size.
3. An owner task gets the heads of a bucket (a key range) in key order. Heads with one key chain: the texts are
   compared byte by byte, and each different text of a chain is its own class.
4. Rows take their class from their head. A text that holds a third of all rows is one head for each batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.shelf import Shelf

CELL_BITS = 16

ENTRY = "row long, doc_id long, raw string, sha binary, key long, head long, n long, top long, body binary"


def entries(docs: DataFrame) -> DataFrame:
    """An entry for each row of ``docs`` (doc_id, text)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            heads: dict[bytes, list] = {}
            out = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                data = (text or "").encode("utf-8")
                low = data.lower()
                entry = [row, doc_id, hashlib.md5(data).hexdigest()]
                head = heads.get(low)
                if head is None:
                    head = heads[low] = [hashlib.sha256(low).digest(), entry, 0, None, low]
                head[2] += 1
                if doc_id is not None and (head[3] is None or doc_id > head[3]):
                    head[1], head[3] = entry, doc_id
                out.append((entry, head))
                row += 1
            columns = list(zip(*((
                entry[0], entry[1], entry[2], head[0], int.from_bytes(head[0][:8], "big", signed=True), head[1][0],
                *((head[2], head[3], press.compress(head[4])) if head[1] is entry else (None, None, None)),
            ) for entry, head in out)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            if columns:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in ENTRY.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(made, ENTRY)


def directory(counts: np.ndarray, capacity: int) -> np.ndarray:
    """The bucket of each cell (digest prefix of ``CELL_BITS`` bits): the directory doubles while a bucket is overfull.

    ``counts`` has the heads of each cell. A bucket of one cell isn't split further.
    """
    bucket = np.zeros(len(counts), dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(counts)])
    leaves = [(0, len(counts))]
    for _ in range(CELL_BITS):
        split = []
        for a, b in leaves:
            middle = (a + b) // 2
            split += [(a, b)] if total[b] - total[a] <= capacity or b - a == 1 else [(a, middle), (middle, b)]
        if len(split) == len(leaves):
            break
        leaves = split
    for i, (a, b) in enumerate(leaves):
        bucket[a:b] = i
    return bucket


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes of heads in order of (key, top descending): each head with the first head of its class."""
    press = zstandard.ZstdDecompressor()
    key, chain = None, []  # [body, text or None, keep row, keep doc_id]
    for batch in batches:
        out = []
        for k, head, top, n, body in zip(*(batch[c].to_pylist() for c in ("key", "head", "top", "n", "body"))):
            if k != key:
                key, chain = k, []
            own = None
            if chain:
                text = press.decompress(body)
                for link in chain:
                    if link[1] is None:
                        link[1] = press.decompress(link[0])
                    if link[1] == text:
                        own = link
                        break
            if own is None:
                own = [body, None, head, top]
                chain.append(own)
            out.append((head, own[2], own[3], n))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["head", "keep_row", "keep_id", "n"])


def exact_duplicates(docs: DataFrame, capacity: int = 20_000) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, raw) for each row of ``docs`` (doc_id, text; others are ignored).

    Texts are equal if their bytes are equal after lower-casing A-Z; null counts as empty. Of equal texts the row with
    the largest doc_id stays; among rows that repeat that doc_id, exactly one. A null doc_id is smaller than any
    other. ``raw`` is the MD5 of the text as given, which with doc_id names a row. An empty table gives an empty one.
    """
    shelf = Shelf(docs.sparkSession, "exact")
    rows = shelf.put(entries(docs))
    heads = rows.where("row = head")
    cell = F.shiftrightunsigned("key", 64 - CELL_BITS).cast("int")
    counts = np.zeros(1 << CELL_BITS, dtype=np.int64)
    for r in heads.groupBy(cell.alias("cell")).count().collect():  # at most 2**CELL_BITS rows
        counts[r["cell"]] = r["count"]
    bucket = directory(counts, capacity)
    buckets = int(bucket[-1]) + 1
    owner = docs.sparkSession.createDataFrame([(c, int(b)) for c, b in enumerate(bucket)], "cell int, bucket long")
    owned = heads.select("key", "head", "top", "n", "body", cell.alias("cell")).join(F.broadcast(owner), "cell")
    owned = owned.repartition(buckets, "bucket")
    index = shelf.put(
        owned.sortWithinPartitions("key", F.col("top").desc_nulls_last(), "head")
        .select("key", "head", "top", "n", "body")
        .mapInArrow(_chained, "head long, keep_row long, keep_id long, n long")
    )
    sizes = index.groupBy("keep_row").agg(F.sum("n").alias("group_size"))
    index = index.drop("n").join(sizes, "keep_row")
    return rows.select("row", "doc_id", "raw", "sha", "head").join(index, "head").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "raw",
    )
