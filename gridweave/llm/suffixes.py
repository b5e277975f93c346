"""Removal of repeated substrings by bucket-pointer refinement of sampled suffixes.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts anywhere else. Strings (windows) are compared by the
identifiers of the buckets that their suffixes are in, which are refined from ``Q`` bytes on:

1. Initial buckets. The anchor of a window is the start of its ``Q``-gram with the smallest bucket identifier, the leftmost of
   equals. Equal windows have their anchor at the same place, so only windows of one anchor bucket can be equal, and one suffix in
   about seventy is an anchor. Consecutive windows with one anchor are a run; a run whose bucket has no other run is done.
2. Whole runs. Runs of a bucket are refined by the identifiers of all offsets they cover: equal runs are one class, which is done
   (all its windows repeat) and goes on as one suffix, however many copies there are. A bucket of one class is done.
3. Cores. Windows that start at most ``STEP`` bytes apart share a core. Buckets are refined by the identifiers of the core's later
   offsets: alone in its bucket, no window of the core repeats; with equal surroundings, all do; others go on.
4. Windows. What is left is refined by the identifiers of the window's later offsets, so each bucket has equal windows.

Identifiers are 64-bit numbers made of those of shorter strings at later offsets (of bytes, for the ``Q``-grams), so they are the
same in all tasks and only what a bucket holds has to be exchanged. Different strings of one bucket share an identifier with a
chance of about 2**-64. All steps are grouped counts and joins with them; counts are summed before the shuffle, and each join has
one row of a key on one side, so a hot key can be split.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.shelf import Shelf
from gridweave.llm.words import _power, blocks, mixed

WINDOW = 200
Q = 50
#: Q-grams of a window.
SPAN = WINDOW - Q + 1
#: Windows that are judged by one core.
STEP = 16

#: A block has fewer positions than 2 to this, so that a position fits in the low bits of a number.
_BITS = 18
_PIECE = (1 << _BITS) - 2 * WINDOW
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240513).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

RUN = "bucket long, run long, name binary, start long, reach long, n long, copies long"
#: Bytes around an anchor that its windows can cover.
SLICE = "bucket long, run long, copies long, reach long, n long, ahead long, around binary"


def prefix(data: np.ndarray) -> np.ndarray:
    """Sums from which ``gram`` makes the identifier of any substring."""
    size = 1 << (_BITS + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _power(_BASE, size)[: len(data)], dtype=np.uint64)])


def gram(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The identifiers of ``data[start:end]``."""
    back = _power(pow(_BASE, -1, 1 << 64), 1 << (_BITS + 1))
    return mixed((sums[end] - sums[start]) * back[start])


def refined(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Identifiers of longer strings from those of ``Q`` bytes at later offsets; strings of at least ``Q`` bytes."""
    total = (end - start).astype(np.uint64)
    at = start
    while True:
        total = mixed(total + gram(sums, at, at + Q))
        if (at == end - Q).all():
            return total
        at = np.minimum(at + Q, end - Q)


def runs_of(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The runs of some texts: text number, first window, offset of the anchor in it, windows, anchor bucket, run identifier."""
    n = len(data) - WINDOW + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return dict(text=none, start=none, reach=none, n=none, bucket=none, run=none)
    sums = prefix(data)
    at = np.arange(len(data) - Q + 1)
    grams = gram(sums, at, at + Q)
    # The smallest of SPAN consecutive numbers from the minima of blocks, forward and backward; the position makes it leftmost.
    low = np.uint64((1 << _BITS) - 1)
    key = (grams & ~low) | at.astype(np.uint64)
    rows = np.concatenate([key, np.full(-len(key) % SPAN + SPAN, ~np.uint64(0))]).reshape(-1, SPAN)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(backward[:n], forward[SPAN - 1 : SPAN - 1 + n]) & low).astype(np.int64)
    starts = np.arange(n)
    text = np.searchsorted(offsets, starts, "right") - 1
    window = np.flatnonzero(starts + WINDOW <= offsets[text + 1])
    if not len(window):
        return dict(text=none, start=none, reach=none, n=none, bucket=none, run=none)
    own = anchor[window]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(window) != 1) | (own[1:] != own[:-1])]))
    start, last = window[first], window[np.concatenate([first[1:] - 1, [len(window) - 1]])]
    at = own[first]
    return dict(
        text=text[start], start=start - offsets[text[start]], reach=at - start, n=last - start + 1,
        bucket=grams[at].view(np.int64), run=gram(sums, start, last + WINDOW).view(np.int64),
    )


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(number of the first text, runs) of texts in blocks; a very long text in pieces that overlap by a window."""
    column = pa.array(texts, pa.binary()).cast(pa.string())
    for block in blocks(column, _PIECE):
        if len(block.data) <= _PIECE:
            yield block.first, runs_of(block.data, block.offsets)
            continue
        for at in range(0, len(block.data) - WINDOW + 1, _PIECE):
            part = block.data[at : at + _PIECE + WINDOW - 1]
            found = runs_of(part, np.array([0, len(part)]))
            found["start"] = found["start"] + at
            yield block.first, found


def _bytes(text: pa.Scalar) -> bytes:
    return (text.as_py() or "").encode("utf-8")


def _by_size(column: pa.Array, own: list[int]) -> Iterator[list[int]]:
    """Consecutive numbers of ``own`` whose texts have about a block together."""
    some, size = [], 0
    for i in own:
        some.append(i)
        size += len(column[i].as_buffer())
        if size >= _PIECE:
            yield some
            some, size = [], 0
    if some:
        yield some


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _runs(docs: DataFrame) -> DataFrame:
    """The runs of each text; equal texts of a batch are one text with that many copies."""
    names = [x.split()[0] for x in RUN.split(", ")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch["text"]
            digests = [hashlib.md5(data).digest() if len(data) >= WINDOW else None for data in map(_bytes, column)]
            copies = Counter(digests)
            own = list({d: i for i, d in enumerate(digests) if d}.values())
            for some in _by_size(column, own):
                found_at = [digests[i] for i in some]
                times = np.array([copies[d] for d in found_at], np.int64)
                for first, found in _pieces([_bytes(column[i]) for i in some]):
                    text = found["text"] + first
                    name = pa.array(found_at, pa.binary()).take(pa.array(text))
                    columns = [found["bucket"], found["run"], name, found["start"], found["reach"], found["n"], times[text]]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names)

    return _texts(docs).select("text").mapInArrow(made, RUN)


def _packed(docs: DataFrame) -> DataFrame:
    """Each row with the name of its text and the text compressed."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            names, bodies = [], []
            for data in map(_bytes, batch["text"]):
                names.append(hashlib.md5(data).digest())
                bodies.append(press.compress(data))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names, pa.binary()), pa.array(bodies, pa.binary())], ["doc_id", "name", "body"])

    return _texts(docs).mapInArrow(made, "doc_id long, name binary, body binary")


def _slices(wanted: DataFrame, docs: DataFrame, shelf: Shelf) -> DataFrame:
    """One row for each class with the bytes around its anchor."""
    names = [x.split()[0] for x in SLICE.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.binary()]
    per_text = shelf.put(wanted.groupBy("name").agg(F.collect_list(F.struct("bucket", "run", "copies", "start", "reach", "n")).alias("runs")))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            seen, out = set(), []
            for name, body, runs in zip((x.as_py() for x in batch["name"]), batch["body"], batch["runs"]):
                if name in seen:  # copies of a text
                    continue
                seen.add(name)
                data = press.decompress(body.as_py())
                for r in runs.as_py():
                    anchor = r["start"] + r["reach"]
                    ahead = max(0, anchor - SPAN + 1)
                    out.append((r["bucket"], r["run"], r["copies"], r["reach"], r["n"], anchor - ahead, data[ahead : anchor + WINDOW]))
                if len(out) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    found = _packed(docs).select("name", "body").join(per_text, "name").select("name", "body", "runs").mapInArrow(made, SLICE)
    return found.dropDuplicates(["bucket", "run"])


def _around(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """(rows, sums, position of each anchor in them, columns) of some slices at a time."""
    for first in range(0, len(batch), 1_000):
        part = batch.slice(first, 1_000)
        texts = part["around"].to_pylist()
        size = np.array([len(x) for x in texts], np.int64)
        begin = np.cumsum(size) - size
        columns = {c: part[c].to_numpy() for c in ("bucket", "run", "copies", "reach", "n", "ahead")}
        yield slice(first, first + len(part)), prefix(np.frombuffer(b"".join(texts), np.uint8)), begin + columns["ahead"], columns


def _cores(slices: DataFrame) -> DataFrame:
    """(bucket, core, near, far, run, copies, shared, hull): for each class its windows that start ``near`` to ``far`` bytes before
    the anchor and share a core; ``shared`` names the core, ``hull`` all that these windows cover."""
    names = ["bucket", "core", "near", "far", "run", "copies", "shared", "hull"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sums, anchor, c in _around(batch):
                least = c["reach"] - c["n"] + 1
                for core in range(-(-SPAN // STEP)):
                    near, far = np.maximum(least, core * STEP), np.minimum(c["reach"], core * STEP + STEP - 1)
                    own = np.flatnonzero(near <= far)
                    if not len(own):
                        continue
                    near, far, at = near[own], far[own], anchor[own]
                    begin = at - core * STEP
                    end = at + WINDOW - min(core * STEP + STEP - 1, SPAN - 1)
                    shared = refined(sums, begin, end).view(np.int64)
                    hull = refined(sums, at - far, at + WINDOW - near).view(np.int64)
                    columns = [c["bucket"][own], np.full(len(own), core), near, far, c["run"][own], c["copies"][own], shared, hull]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)

    return slices.mapInArrow(made, ", ".join(f"{x} long" for x in names))


def _windows(slices: DataFrame) -> DataFrame:
    """(bucket, place, window, run, copies): the windows of the ``parts`` (near, far) of each class, by their place before the anchor."""
    names = ["bucket", "place", "window", "run", "copies"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, sums, anchor, c in _around(batch):
                parts = batch["parts"][rows].to_pylist()
                own = np.repeat(np.arange(len(parts)), [sum(p["far"] - p["near"] + 1 for p in x) for x in parts])
                place = np.concatenate([np.zeros(0, np.int64), *(np.arange(p["near"], p["far"] + 1) for x in parts for p in x)])
                begin = anchor[own] - place
                columns = [c["bucket"][own], place, refined(sums, begin, begin + WINDOW).view(np.int64), c["run"][own], c["copies"][own]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)

    return slices.mapInArrow(made, ", ".join(f"{x} long" for x in names))


def _repeated(docs: DataFrame, shelf: Shelf) -> DataFrame:
    """(name, start, end): spans of the text with this MD5 in which every byte goes; they may overlap."""
    # Each grouped side is written before its join: only a join of two plain exchanges can have its hot keys split.
    buckets = shelf.put(_runs(docs).groupBy("bucket").agg(F.sum("copies").alias("copies")).where("copies > 1").select("bucket"))
    runs = shelf.put(_runs(docs).join(buckets, "bucket"), "zstd")
    classes = shelf.put(
        runs.groupBy("bucket", "run").agg(
            F.sum("copies").alias("copies"), F.min(F.struct("name", "start")).alias("at"), F.first("reach").alias("reach"), F.first("n").alias("n")
        ).select("bucket", "run", "copies", "at.name", "at.start", "reach", "n")
    )
    several = shelf.put(classes.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("bucket"))
    slices = shelf.put(_slices(classes.join(several, "bucket"), docs, shelf), "zstd")
    settled = classes.where("copies > 1").select("bucket", "run", (F.col("reach") - F.col("n") + 1).alias("near"), F.col("reach").alias("far"))

    cores = _cores(slices)
    key = ["bucket", "core", "shared"]
    met = cores.groupBy(*key).agg(F.sum("copies").alias("all"), F.min("hull").alias("least"), F.max("hull").alias("most"))
    met = shelf.put(met.where("all > 1").select(*key, (F.col("least") == F.col("most")).alias("equal")))
    met = shelf.put(cores.join(met, key).select("bucket", "run", "copies", "near", "far", "equal"))
    by_core = met.where("equal and copies = 1").select("bucket", "run", "near", "far")

    parts = met.where("not equal").groupBy("bucket", "run").agg(F.collect_list(F.struct("near", "far")).alias("parts"))
    windows = shelf.put(_windows(slices.join(parts, ["bucket", "run"])))
    key = ["bucket", "place", "window"]
    more = shelf.put(windows.groupBy(*key).agg(F.sum("copies").alias("all")).where("all > 1").select(*key))
    by_window = windows.where("copies = 1").join(more, key).select("bucket", "run", F.col("place").alias("near"), F.col("place").alias("far"))

    gone = by_core.union(by_window).groupBy("bucket", "run").agg(F.collect_list(F.struct("near", "far")).alias("gone"))
    gone = shelf.put(gone.union(settled.select("bucket", "run", F.array(F.struct("near", "far")).alias("gone"))))
    hit = runs.join(gone, ["bucket", "run"]).select("name", (F.col("start") + F.col("reach")).alias("anchor"), F.explode("gone").alias("g"))
    return hit.select("name", (F.col("anchor") - F.col("g.far")).alias("start"), (F.col("anchor") - F.col("g.near") + WINDOW).alias("end"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed, kept) for each row of ``docs`` (doc_id, text; others are ignored).

    ``removed`` lists the maximal removed spans of the text's UTF-8 bytes as given, ``kept`` has the other bytes in order (which
    need not be whole code points). Null texts are empty. Texts under ``WINDOW`` bytes are kept whole. Of a string that repeats
    every occurrence goes, so two equal rows of at least ``WINDOW`` bytes are both left empty. Repeated and null ids are rows like
    any other. An empty table gives an empty one.
    """
    shelf = Shelf(docs.sparkSession, "suffixes")
    spans = shelf.put(_repeated(docs, shelf).groupBy("name").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    schema = "doc_id long, n_bytes long, n_removed long, removed array<struct<start: long, end: long>>, kept binary"
    names = ["doc_id", "n_bytes", "n_removed", "removed", "kept"]
    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            ids, out, size = batch["doc_id"].to_pylist(), [], 0
            for i, (body, spans) in enumerate(zip(batch["body"], batch["spans"])):
                data, merged, kept, done = press.decompress(body.as_py()), [], [], 0
                for start, end in sorted((s["start"], s["end"]) for s in spans.as_py() or ()):
                    if merged and start <= merged[-1]["end"]:
                        merged[-1]["end"] = max(end, merged[-1]["end"])
                    else:
                        merged.append({"start": start, "end": end})
                for s in merged:
                    kept.append(data[done : s["start"]])
                    done = s["end"]
                kept = b"".join([*kept, data[done:]])
                out.append((ids[i], len(data), len(data) - len(kept), merged, kept))
                size += len(kept)
                if size > 1 << 20 or i + 1 == len(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64()] * 3 + [pa.list_(pair), pa.binary()])], names)
                    out, size = [], 0

    return _packed(docs).join(spans, "name", "left").select("doc_id", "body", "spans").mapInArrow(cut, schema)
