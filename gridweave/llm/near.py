"""Near-duplicate documents by bottom-k sketches.

One hash function fingerprints the word shingles of a text; its sketch is the k smallest. Texts with the same
word sequence are one class.

1. Retained values are counted over all classes. Two sketches whose estimate is high enough share so many values that they also
   share one of their rarest: of a full sketch of 64, any two that share 36 meet within their 29 rarest values. Only these are
   indexed, so a passage that many texts contain makes a list of those texts alone that are mostly it.
2. Each inverted list is compared with one member, its pivot: the class whose values are the most frequent, which in a group of
   edited copies is the text they were made from. Copies are never expanded into pairs.
3. Candidates of similar size are estimated from the union of their sketches, and the likely ones verified on the full shingle sets,
   computed from the whole texts: all at once if they are few, else the likeliest partner of each class first, then the pairs that are
   still unconnected. A text goes to the verifier once for up to ``BLOCK`` of its partners.
4. Lists that still hold several components go on. With at most ``few`` members outside the largest component, these are compared
   with the list.
5. The members of the other lists are indexed once more by the rarest values of their whole sets, which is exact: with 0.8 of the
   values in common, two sets share one of the rarest fifth of each, and what follows it in both is enough for a link. Copies that
   each were edited beyond the threshold so meet only in an edit that they share. Pivots are taken from the lists that stay open, in
   rounds that grow 32-fold, until each member was one.

Two texts at similarity 0.8 or more have a sketch estimate under 0.55 (k = 64) with a chance of about 3e-7; nothing else is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.graph import components
from gridweave.llm.shelf import Shelf
from gridweave.llm.words import blocks, sequence_keys, shingles, words

SKETCH = "doc_id long, raw long, one long, two long, size int, sketch array<long>"

#: Partners of a text that one task verifies together.
BLOCK = 256
#: Texts whose shingle sets are held at a time.
TEXTS = 128
#: Up to so many pairs are verified at once, as another pass over the texts costs more than it saves.
AT_ONCE = 65_536


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, raw, text): raw is a digest of the text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("raw"), text.alias("text"))


def sketches(docs: DataFrame, shingle: int, k: int) -> DataFrame:
    """(doc_id, raw, one, two, size, sketch): text digest, class key, number of distinct shingles and the k smallest fingerprints."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                w = words(block)
                one, two = sequence_keys(w)
                sets = _sets(w, shingle)
                kept = [s[:k] for s in sets]
                lists = pa.ListArray.from_arrays(
                    np.cumsum([0, *map(len, kept)], dtype=np.int32),
                    np.concatenate(kept).view(np.int64),
                )
                own = [batch[c].slice(block.first, len(sets)) for c in ("doc_id", "raw")]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(one), pa.array(two), pa.array(list(map(len, sets)), pa.int32()), lists],
                    ["doc_id", "raw", "one", "two", "size", "sketch"],
                )

    return _rows(docs).mapInArrow(made, SKETCH)


def _sets(w, shingle: int) -> list[np.ndarray]:
    """The distinct shingle fingerprints of each text, rising."""
    found, bounds = shingles(w, shingle)
    return [np.unique(found[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def _near_sizes(one: str, other: str, percent: int) -> Column:
    return F.expr(f"100L * {one} >= {percent}L * {other} and 100L * {other} >= {percent}L * {one}")


def _padded(lists: pa.Array, k: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists as rows of k unsigned numbers, filled up with different numbers from ``pad`` on; and their lengths."""
    length = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.tile(np.arange(pad, pad + k, dtype=np.uint64), (len(length), 1))
    out[np.arange(k) < length[:, None]] = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32)
    return out, length


def estimates(pairs: DataFrame, k: int, least: float) -> DataFrame:
    """(a, b, score) of the pairs (a, b, sa, sb: leading 32 bits of their sketches) whose union sketch has a share of common
    values of at least ``least``. Equal leading bits of different values can only raise it."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, la), (b, lb) = _padded(batch["sa"], k, 1 << 33), _padded(batch["sb"], k, 1 << 34)
            merged = np.sort(np.concatenate([a, b], axis=1), axis=1)
            twice = merged[:, 1:] == merged[:, :-1]
            # The smallest values of the union: as many as the longer sketch has, or all.
            unions = 1 + np.cumsum(~twice, axis=1)
            real = la + lb - twice.sum(axis=1)
            full = np.minimum(np.maximum(la, lb), real)
            score = (twice & (unions <= full[:, None])).sum(axis=1) / np.maximum(full, 1)
            out = pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(score)], ["a", "b", "score"])
            yield out.filter(pa.array(score >= least))

    return pairs.mapInArrow(likely, "a long, b long, score double")


def verified(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b) with 100 * common shingles >= percent * shingles of either, from rows (b, block, a, text) that are sorted: those
    without ``a`` have the text of ``b``, those after them the texts it is compared with."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads = None, []
        for whole in batches:
            for at in range(0, len(whole), TEXTS):
                batch = whole.slice(at, TEXTS)
                sets = [s for block in blocks(batch["text"]) for s in _sets(words(block), shingle)]
                out = []
                for b, part, a, own in zip(batch["b"].to_pylist(), batch["block"].to_pylist(), batch["a"].to_pylist(), sets):
                    if key != (b, part):
                        key, heads = (b, part), []
                    if a is None:
                        heads.append(own)
                        continue
                    for head in heads:
                        common = len(np.intersect1d(head, own, assume_unique=True))
                        if 100 * common >= percent * (len(head) + len(own) - common):
                            out.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return texts.mapInArrow(linked, "a long, b long")


class _Links:
    """Components of the links found so far, as (node, label) for each node of the index."""

    def __init__(self, shelf: Shelf, index: DataFrame, bodies: DataFrame, labels: DataFrame, shingle: int, percent: int, k: int, least: float):
        self.shelf, self.index, self.bodies, self.labels = shelf, index.select("node", "sketch"), bodies, labels
        self.shingle, self.percent, self.k, self.least = shingle, percent, k, least

    def named(self, pairs: DataFrame) -> DataFrame:
        """The pairs with the labels la and lb of both sides."""
        side = lambda x: self.labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
        return pairs.join(side("a"), "a").join(side("b"), "b")

    def verify(self, pairs: DataFrame) -> None:
        """Compare the texts of the pairs (a, b) and join the labels of those that are linked."""
        sizes = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
        pairs = pairs.join(sizes, "b").select("b", F.expr("pmod(xxhash64(a), blocks)").alias("block"), "a")
        body = lambda x: self.bodies.select(F.col("node").alias(x), "text")
        heads = sizes.join(body("b"), "b").select("b", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), F.lit(None).cast("long").alias("a"), "text")
        texts = heads.union(pairs.join(body("a"), "a").select("b", "block", "a", "text"))
        texts = texts.repartition("b", "block").sortWithinPartitions("b", "block", F.col("a").asc_nulls_first())
        found = self.shelf.put(verified(texts, self.shingle, self.percent))
        if not found.isEmpty():
            # Labels stand for the links before them, so only they are connected by the new ones.
            new = components(self.named(found).select(F.col("la").alias("a"), F.col("lb").alias("b")), self.shelf)
            new = new.select(F.col("node").alias("label"), F.col("label").alias("new"))
            before = self.labels
            self.labels = self.shelf.put(before.join(new, "label", "left").select("node", F.coalesce("new", "label").alias("label")))
            self.shelf.drop(before)
        self.shelf.drop(found)

    def pivots(self, pairs: DataFrame) -> None:
        """Check the pairs (a, b) of members and pivots, which may repeat."""
        side = lambda x: self.index.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"))
        self.check(pairs.distinct().join(side("a"), "a").join(side("b"), "b"))

    def check(self, pairs: DataFrame) -> None:
        """Estimate the candidate pairs (a, b, sa, sb), which may repeat, and verify the likely ones as far as they are not connected."""
        likely = estimates(pairs.select("a", "b", "sa", "sb"), self.k, self.least)
        likely = self.shelf.put(likely.groupBy("a", "b").agg(F.max("score").alias("score")))
        count = likely.count()
        if count > AT_ONCE:
            first = likely.groupBy("a").agg(F.max(F.struct("score", "b")).alias("top")).select("a", "top.b")
            self.verify(first)
            rest = self.shelf.put(self.named(likely.join(first, ["a", "b"], "left_anti").select("a", "b")).where("la <> lb").select("a", "b"))
            if not rest.isEmpty():
                self.verify(rest)
            self.shelf.drop(rest)
        elif count:
            self.verify(likely.select("a", "b"))
        self.shelf.drop(likely)

    def open_lists(self, entries: DataFrame, few: int) -> DataFrame:
        """The entries of lists with two labels or more, with label, the list's largest label (main) and whether at most ``few`` are outside it."""
        own = entries.join(self.labels, "node")
        lists = (
            own.groupBy("value", "label")
            .agg(F.count(F.lit(1)).alias("c"))
            .groupBy("value")
            .agg(F.sum("c").alias("n"), F.max(F.struct("c", "label")).alias("top"))
            .where("n > top.c")
            .select("value", "n", (F.col("n") - F.col("top.c") <= few).alias("direct"), F.col("top.label").alias("main"))
        )
        return self.shelf.put(own.join(lists, "value"))

    def outside(self, own: DataFrame) -> None:
        """Compare the members outside the largest label with all of their list."""
        own = own.join(self.index, "node")
        side = lambda x: own.select("value", *(F.col(c).alias(y + x) for c, y in (("node", ""), ("label", "l"), ("size", "n"), ("main", "m"), ("sketch", "s"))))
        met = side("a").join(side("b").where("lb <> mb"), "value").where("la <> lb and (la = ma or a < b)")
        self.check(met.where(_near_sizes("na", "nb", self.percent)))

    def along(self, entries: DataFrame) -> None:
        """Rounds over the lists (value, node, size, at) of whole sets until none is open, or each of its members was a pivot."""
        low, high = 0, 32
        while True:
            table = self.open_lists(self.possible(entries), 0)
            if table.isEmpty():
                break
            own = table.withColumn("turn", F.expr("floor(pmod(xxhash64(node), 1048576) / 1048576 * n)")).withColumn("chosen", F.expr(f"turn >= {low} and turn < {high}"))
            own = own.join(self.index, "node")
            side = lambda x: [F.col(c).alias(y + x) for c, y in (("node", ""), ("label", "l"), ("size", "n"), ("at", "p"), ("sketch", "s"))]  # noqa: B023, E731
            left, right = own.select("value", *side("a"), F.col("chosen").alias("both")), own.where("chosen").select("value", *side("b"))
            # What is common from here on must be enough for a link.
            fit = F.expr(f"least(na - pa, nb - pb) * (100L + {self.percent}) >= {self.percent}L * (na + nb)")
            self.check(left.join(right, "value").where("la <> lb and (not both or a < b)").where(fit))
            entries = table.where(f"n > {high}").select("value", "node", "size", "at")
            low, high = high, high * 32
        self.shelf.drop(table)

    def possible(self, entries: DataFrame) -> DataFrame:
        """The entries that some member of their list can be linked by: it is not too short for what they still can have in common."""
        p = self.percent
        # Of sizes x and y, p (x + y) / (100 + p) must be in common, and size - at can be from this value on.
        reach = F.expr(f"(size - at) * (100L + {p}) - {p}L * size")
        own = entries.withColumn("reach", reach)
        ends = own.groupBy("value").agg(F.min("size").alias("least"), F.max("reach").alias("most"))
        return own.join(ends, "value").where(f"reach >= {p}L * least and most >= {p}L * size").select("value", "node", "size", "at")


def rarest(values: DataFrame, need: Column) -> DataFrame:
    """(value, node, size, at, weight) of rows (value, node, size): the rarest values of each node, one of which it shares with any other
    it has at least ``need`` values in common with. ``at`` is the number of rarer values of the node; weight is the mean number of nodes
    that have a value of it. Values of one node alone are left out."""
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return (
        values.join(counts, "value")
        .groupBy("node", "size", "held")
        .agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("list"), F.sum("n").alias("mass"))
        .withColumn("take", (F.size("list") - need + 1).cast("int"))
        .where("take > 0")
        .select("node", "size", F.floor(F.col("mass") / F.col("held")).alias("weight"), F.col("held") - F.size("list"), F.posexplode(F.expr("slice(list, 1, take)")).alias("at", "own"))
        .toDF("node", "size", "weight", "alone", "at", "own")
        .select("own.value", "node", "size", (F.col("alone") + F.col("at")).alias("at"), "weight")
    )


def whole_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, size, held, value): all shingle fingerprints of the texts (node, text)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                sets = _sets(words(block), shingle)
                sizes = np.array(list(map(len, sets)), np.int32)
                nodes = batch["node"].slice(block.first, len(sets)).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(nodes, sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets).view(np.int64))],
                    ["node", "size", "value"],
                )

    return texts.mapInArrow(made, "node long, size int, value long").withColumn("held", F.col("size"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, k: int = 64, margin: float = 0.25, few: int = 32) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A set holds the distinct ``shingle``-word shingles of the
    whole text; fewer words are one shingle; a null, empty or blank text has none and is linked with nothing. Texts are
    linked if 100 * common >= percent * union. ``component_id`` is the smallest doc_id that links reach, and ``kept`` says
    that it is the row's own. Rows that share a doc_id are one document; a null doc_id is never the smallest, such a row
    has kept null unless another id stands for it. An empty table gives an empty one.
    """
    shelf = Shelf(docs.sparkSession, "near")
    own = shelf.put(sketches(docs, shingle, k))
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw"))
    classes = own.where("size > 0").groupBy("one", "two").agg(lead.alias("lead"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    nodes = shelf.put(
        classes.select("one", "two", F.coalesce("lead.doc_id", "one").alias("node"), F.coalesce("lead.doc_id", F.lit(0)).alias("id"), "lead.raw", "size", "sketch")
    )
    length, size = F.least("size", F.lit(k)), F.col("size").cast("long")
    # A set of at most ``percent`` % of k shingles is in its sketch, with all that a partner can add to it.
    need = F.when(size * 100 <= percent * k, F.ceil(size * percent / 100)).otherwise(F.ceil(length * (percent / 100 - margin)))
    prefix = shelf.put(rarest(nodes.select("node", "size", length.alias("held"), F.explode("sketch").alias("value")), need))
    top = F.max(F.struct("weight", "node", "size")).alias("top")
    lists = prefix.groupBy("value").agg(F.count(F.lit(1)).alias("n"), top).where("n > 1")
    met = prefix.drop("weight", "at").join(lists, "value")
    entries = shelf.put(met.select("value", "node", "size", "n", F.col("top.node").alias("pivot"), F.col("top.size").alias("pivot_size")))
    shelf.drop(prefix)
    labels = shelf.put(entries.select("node").distinct().select("node", F.col("node").alias("label")))
    sketch = F.transform("sketch", lambda x: F.shiftright(x, 32).cast("int")).alias("sketch")
    index = shelf.put(nodes.join(labels, "node", "left_semi").select("node", "id", "raw", sketch))
    wanted = index.select("node", "id", "raw")
    # Rows with the same id and digest have one text, joined in partial sums before they are shuffled.
    texts = _rows(docs).groupBy(F.coalesce("doc_id", F.lit(0)).alias("id"), "raw").agg(F.first("text").alias("text"))
    bodies = shelf.put(texts.join(wanted.hint("shuffle_hash"), ["id", "raw"]).select("node", "text"), "zstd")

    links = _Links(shelf, index, bodies, labels, shingle, percent, k, percent / 100 - margin)
    pairs = entries.where("node <> pivot").where(_near_sizes("size", "pivot_size", percent))
    links.pivots(pairs.select(F.col("node").alias("a"), F.col("pivot").alias("b")))
    own_lists = links.open_lists(entries.where("n > 2").select("value", "node", "size"), few)
    if not own_lists.where("direct").isEmpty():
        links.outside(own_lists.where("direct"))
    crowded = links.open_lists(own_lists.where("not direct").select("value", "node", "size"), few)
    if not crowded.isEmpty():
        texts = bodies.join(crowded.select("node").distinct(), "node")
        least = F.ceil(size * percent / 100)
        links.along(shelf.put(rarest(whole_sets(texts, shingle), least)))

    names = nodes.select("one", "two", "node").join(links.labels, "node", "left").select("one", "two", F.coalesce("label", "node").alias("label"))
    rows = own.select("doc_id", "size", F.when(F.col("size") > 0, F.col("one")).alias("one"), "two").join(names, ["one", "two"], "left")
    rows = shelf.put(rows.select("doc_id", "size", "label"))
    split = rows.where("label is not null").groupBy("doc_id").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    split = split.where("doc_id is not null and low <> high")
    if not split.isEmpty():
        same = components(rows.join(split, "doc_id").select(F.col("label").alias("a"), F.col("low").alias("b")), shelf)
        same = same.select(F.col("node").alias("label"), F.col("label").alias("new"))
        rows = rows.join(same, "label", "left").select("doc_id", "size", F.coalesce("new", "label").alias("label"))
    least = rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    component = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = shelf.put(rows.join(least, "label", "left").select("doc_id", F.col("size").cast("long").alias("n_shingles"), component.alias("component_id")))
    shelf.keep(out)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
