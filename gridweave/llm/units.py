"""Substring deduplication by hashed units: lines, paragraphs, sentences or clauses.

1. A text is cut after line breaks or paragraph breaks, and for the finer units also after sentences, or after clauses of
   three words or more. A unit is normalised: words only, A-Z lower-cased.
2. A whole line or paragraph is digested by itself, whatever its length. A sentence or clause with fewer than ``least_words``
   words says little by itself, so its digest covers the units before it as well, back until there are that many words;
   without enough words before it, it goes only with its line.
3. A passage may repeat inside running text without such marks. A sentence or clause of more than ``LONG`` words is therefore
   cut in pieces as well, at places that depend on a word alone, so copies are cut alike whatever is around them. A piece's
   digest covers the words before it in the sentence or clause up to ``least_words``, if it has fewer.
4. Digests (128 bits) are grouped over all texts; the earliest occurrence by (doc_id, number of the unit) stays, the
   others are removed, each with its code point offsets in the text as given and the occurrence that stays.

Only digests, document numbers and offsets are shuffled, once, and the MD5 of the text joins the removed units at the end. A digest
with a third of all units does not meet in one task: units are counted in ``BUCKETS`` buckets by digest, and those of crowded buckets
are summed before the shuffle; the join that finds their occurrences can be split, as each has one row on the other side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b, md5
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.shelf import Shelf

#: Where a unit ends.
ENDS = {
    "line": re.compile(r"[\r\n]+"),
    "paragraph": re.compile(r"\r?\n[ \t]*\r?\n\s*"),
    "sentence": re.compile(r"(?<=[.!?])[\x20\t]+|[\r\n]+"),
    "clause": re.compile(r"(?<=[.!?,;:|])[\x20\t]+|[\r\n]+"),
}
#: Fewer words do not end a clause; this looks at the clause alone, so copies are cut alike.
LEAST_CLAUSE = 3
#: Without a mark for more words than this, a sentence or clause is also cut after words whose hash is 0 modulo ``CUT``.
LONG = 16
CUT = 4
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A word, or a code point of the scripts that put no blanks between words (Thai to Khmer, kana, Han and their punctuation).
_DENSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uf900-\ufaff\uff00-\uffef\U0001b000-\U0001b16f\U00020000-\U0003ffff"
TOKEN = re.compile(f"[{_DENSE}]|[^\\x20\\x09-\\x0D{_DENSE}]+")
DENSE = re.compile(f"[{_DENSE}]")
LOWER = {c: c + 32 for c in range(65, 91)}

UNIT = "doc long, doc_id long, raw binary, unit long, start long, end long, words long, one long, two long"

#: Buckets by digest; one with over ``CROWDED`` units and four times the mean is crowded, so at most a quarter of them are.
BUCKETS = 1 << 16
CROWDED = 10_000


def _runs(text: str, start: int, end: int, least_words: int) -> Iterator[tuple[int, int, int, bytes | None]]:
    """The pieces of a unit from start to end of a lower-cased text that has more than ``LONG`` words, where only the words say where to cut."""
    found = list(TOKEN.finditer(text, start, end))
    if len(found) <= LONG:
        return
    tokens = [m.group() for m in found]
    at = 0
    for i, token in enumerate(tokens, 1):
        if i < len(tokens) and crc32(token.encode("utf-8", "surrogatepass")) % CUT:
            continue
        if i - at < len(tokens):
            since = min(at, i - least_words)
            # The mark keeps a piece apart from units, so no unit is a copy of its own piece.
            yield found[at].start(), found[i - 1].end(), i - at, _digest("\r" + " ".join(tokens[since:i])) if since >= 0 else None
        at = i


def _digest(words: str) -> bytes:
    return blake2b(words.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def units_of(text: str, unit: str, least_words: int) -> Iterator[tuple[int, int, int, bytes | None]]:
    """(start, end, words, digest or None) of each unit that has a word; the offsets span the unit without its break.

    Units are nested or apart: a line follows the finer units that it consists of.
    """
    finer = unit in ("sentence", "clause")
    low = text.lower() if text.isascii() else text.translate(LOWER)  # as long as the text
    dense = DENSE.search(low) is not None
    at = mark = line_at = 0
    own: list[str] = []
    line: list[str] = []
    before, held = [], 0  # the latest units: number of words and normalised text
    ends = [*((m.start(), m.end()) for m in ENDS[unit].finditer(text)), (len(text), len(text))]
    for end, after in ends:
        words = WORD.findall(low, mark, end)
        own += words
        mark = after
        if unit == "clause" and len(words) < LEAST_CLAUSE and end < len(text) and text[end] in " \t":
            continue  # a short clause is the beginning of the next one
        if own and not finer:
            yield at, end, len(own), _digest(" ".join(own))
        elif own:
            before.append((len(own), " ".join(own)))
            held += len(own)
            while held - before[0][0] >= least_words:
                held -= before.pop(0)[0]
            if dense or len(own) > LONG:
                yield from _runs(low, at, end, least_words)
            yield at, end, len(own), _digest("\n".join(t for _, t in before)) if held >= least_words else None
            line += own
        if finer and (end == len(text) or text[end] in "\r\n"):
            if line and (len(line) > len(own) or len(own) < least_words):  # else its one unit has this digest
                yield line_at, end, len(line), _digest(" ".join(line))
            line_at, line = after, []
        at, own = after, []


def _cut(docs: DataFrame, unit: str, least_words: int) -> DataFrame:
    names = [x.split()[0] for x in UNIT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]

    def packed(out: list[tuple], digests: list[bytes]) -> pa.RecordBatch:
        halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
        columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(halves[:, 0]), pa.array(halves[:, 1])], names)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, digests = [], []
            for doc, doc_id, text in zip(batch["doc"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                raw = md5((text or "").encode("utf-8")).digest()
                for i, (start, end, words, digest) in enumerate(units_of(text or "", unit, least_words)):
                    if digest is not None:
                        out.append((doc, doc_id, raw, i, start, end, words))
                        digests.append(digest)
                if len(out) > 50_000:
                    yield packed(out, digests)
                    out, digests = [], []
            if out:
                yield packed(out, digests)

    own = docs.select(F.monotonically_increasing_id().alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(made, UNIT)


def repeated_units(docs: DataFrame, unit: str = "clause", least_words: int = 8) -> DataFrame:
    """(doc_id, unit, start, end, words, first_doc_id, first_unit, copies, raw): the units to remove from ``docs`` (doc_id, text).

    ``copies`` counts all occurrences; ``raw`` is the MD5 of the text as given, which with doc_id names a row. Texts without words, null or empty, have no units. Rows that repeat a doc_id and
    text have the same units twice, and the second time is removed like any other; a null doc_id comes after all others.
    A removed line is a row beside those of the finer units in it.
    Other columns are ignored; an empty table gives an empty one.
    """
    shelf = Shelf(docs.sparkSession, "units")
    rows = shelf.put(_cut(docs, unit, least_words))
    raws = rows.select("doc", "raw").distinct()
    rows = rows.drop("raw").withColumn("bucket", F.expr(f"cast(pmod(one, {BUCKETS}) as int)"))
    counts = shelf.put(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / BUCKETS
    crowded = F.broadcast(counts.where(F.col("n") > max(CROWDED, 4 * mean)).select("bucket"))

    same = Window.partitionBy("one", "two")
    order = same.orderBy(F.asc_nulls_last("doc_id"), "unit", "doc")
    few = rows.join(crowded, "bucket", "left_anti").withColumns(
        {"nth": F.row_number().over(order), "first_doc_id": F.first("doc_id").over(order), "first_unit": F.first("unit").over(order), "copies": F.count(F.lit(1)).over(same)}
    )
    columns = ["doc", "doc_id", "unit", "start", "end", "words", "first_doc_id", "first_unit", "copies"]
    hit = few.where("nth > 1").select(*columns)

    many = rows.join(crowded, "bucket", "left_semi")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "unit", "doc")
    first = many.groupBy("one", "two").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    later = many.join(first, ["one", "two"]).where("doc <> first.doc or unit <> first.unit")
    hit = hit.union(later.withColumns({"first_doc_id": F.col("first.doc_id"), "first_unit": F.col("first.unit")}).select(*columns))
    return hit.join(raws, "doc").select(*columns[1:], F.lower(F.hex("raw")).alias("raw"))


def without(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` with the removed spans cut from ``text``, and ``removed_spans`` with their offsets in the text as given.

    ``removed`` has doc_id, raw, start and end, as ``repeated_units`` gives them: a row is named by its doc_id (null is a name like any
    other) and its text. Of rows with the same name the first keeps what is listed fewer times than there are rows. Rows without
    a span are unchanged; a text that was removed whole is empty. A column ``removed_spans`` of ``docs`` is replaced.
    """
    name = ["id", "raw"]
    own = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("id"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("raw"))
    same = Window.partitionBy(*name)
    own = own.withColumns({"nth": F.row_number().over(same.orderBy(F.lit(0))), "rows": F.count(F.lit(1)).over(same)})
    times = removed.groupBy(F.col("doc_id").cast("long").alias("of"), F.col("raw").alias("text_of"), "start", "end").agg(F.count(F.lit(1)).alias("times"))
    spans = times.groupBy("of", "text_of").agg(F.collect_list(F.struct("start", (-F.col("end")).alias("minus"), "times")).alias("spans"))
    joined = own.join(spans, F.col("id").eqNullSafe(F.col("of")) & (F.col("raw") == F.col("text_of")), "left")
    here = F.array_sort(F.filter("spans", lambda s: F.col("nth") > F.col("rows") - s["times"]))
    # Units may be nested or overlap: what is cut begins where the cuts before it end.
    zero = F.struct(F.array().cast("array<struct<start: bigint, end: bigint>>").alias("list"), F.lit(0).cast("long").alias("done"))
    cut = lambda a, s: F.when(
        -s["minus"] > a["done"],
        F.struct(
            F.concat(a["list"], F.array(F.struct(F.greatest(s["start"], a["done"]).alias("start"), (-s["minus"]).alias("end")))).alias("list"), (-s["minus"]).alias("done")
        ),
    ).otherwise(a)
    joined = joined.withColumn("cuts", F.aggregate(here, zero, cut)["list"])
    text = F.col("doc.text")
    # What stays runs from the end of a span (or the start of the text) to the start of the next (or the end).
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("cuts", lambda s: s["end"]))
    ends = F.concat(F.transform("cuts", lambda s: s["start"]), F.array(F.length(text).cast("long")))
    kept = F.zip_with(starts, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")))
    changed = F.coalesce(F.size("cuts") > 0, F.lit(False))
    columns = [F.when(changed, F.array_join(kept, "")).otherwise(text).alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns if c != "removed_spans"]
    return joined.select(*columns, F.when(changed, F.col("cuts")).alias("removed_spans"))
