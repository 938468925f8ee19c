"""Removes every byte covered by a long string that also starts elsewhere: sparse distributed prefix doubling.

Doubling all positions of a corpus would sort each byte several times. Ranks are therefore kept for synchronised positions only: of
all 64-byte strings in a 200-byte window the one with the smallest hash is its anchor, so equal windows have equal anchors at equal
places, and about every seventieth byte is one. Ranks grow with their strings, as in prefix doubling, and Spark drops what is unique:

1. 64 bytes: anchors whose string no other place has are dropped.
2. All windows of an anchor (200 to 336 bytes): where the whole stretch occurs twice, all its windows are repeats.
3. 200 bytes: what is left are the ends of repeats. Their windows are ranked one by one, next to one witness of each stretch that
   step 2 has settled; a group with many members is split into pairs of blocks of bounded size.

Texts that occur more than once are repeats as a whole. Text leaves its place once at most for step 3 and once for the result, and only
where the ranges are too many to send them to the text. Strings are compared by 64-bit hashes: two of N different ones are taken for
one with probability N^2 / 2^65.

Defined cases: null and empty texts have no bytes; texts of fewer bytes than the length keep them all; repeated rows are repeats of
each other; a kept text may be cut inside a character, so it is binary; empty tables and null ids are fine; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwatch.llm.common import written
from batchwatch.llm.hashing import Rolling, mixed

LENGTH, SEED = 200, 64
#: Ranges up to this number are sent to the texts (a MB or two); beyond it the texts are shuffled to them.
MOST_BROADCAST_RANGES = 50_000
BLOCK = 1000


def bytes_of(text: pa.Scalar) -> np.ndarray:
    return np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)


def anchors(data: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(key, place, first window, last window, hash of the whole stretch) of each anchor of a text."""
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    rolling, at = Rolling(data), np.arange(len(data) - seed + 1)
    keys = mixed(rolling.of(at, at + seed))
    low = np.uint64(0xFFFFFFFF)
    best, width, span = (keys & ~low) | at.astype(np.uint64), 1, length - seed + 1  # smallest hash, leftmost of equals
    while width * 2 <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < span:
        best = np.minimum(best[:len(best) - (span - width)], best[span - width:])
    chosen = (best & low).astype(np.int64)
    lo = np.flatnonzero(np.concatenate([[True], np.diff(chosen) != 0]))
    hi = np.append(lo[1:], len(chosen)) - 1
    place = chosen[lo]
    stretch = mixed(rolling.of(lo, hi + length) + (hi - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return keys[place].view(np.int64), place, lo, hi, stretch.view(np.int64)


def anchor_rows(texts: DataFrame, length: int, only_keys: bool) -> DataFrame:
    """Anchors of each text, once for each text and task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            parts = []
            for tid, text in zip(batch.column("tid").to_pylist(), batch.column("text")):
                if tid in seen:
                    continue
                seen.add(tid)
                found = anchors(bytes_of(text), length)
                parts.append((np.full(len(found[0]), tid), *found))
            if parts:
                tids, key, a, lo, hi, stretch = (pa.array(np.concatenate(c)) for c in zip(*parts))
                if only_keys:
                    yield pa.RecordBatch.from_arrays([key], names=["key"])
                else:
                    small = [x.cast(pa.int32()) for x in (a, lo, hi)]
                    yield pa.RecordBatch.from_arrays([tids, key, *small, stretch], names=["tid", "key", "a", "lo", "hi", "stretch"])

    schema = "key bigint" if only_keys else "tid bigint, key bigint, a int, lo int, hi int, stretch bigint"
    return texts.mapInArrow(rows, schema)


def repeated_windows(members: DataFrame, length: int) -> DataFrame:
    """(tid, lo, hi) of repeated windows among members (key, tid, a, lo, hi, witness, part) that share a key."""
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("m")).filter("m > 1")
    sized = members.join(F.broadcast(written(sizes, "large-groups")), "key", "left")  # at most 1 / BLOCK of the members
    own = sized.withColumn("own", F.pmod(F.xxhash64("tid", "lo"), F.coalesce("m", F.lit(1))))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("m", F.lit(1)) - 1)))
    placed = spread.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "tid", "lo", "hi", "witness", "part")

    def compare(table: pa.Table) -> pa.RecordBatch:
        """Repeated windows of whole groups; a window counts within its own group only."""
        parts = [np.frombuffer(p, np.uint8) for p in table.column("part").to_pylist()]
        lo, hi, tid = (table.column(c).to_numpy() for c in ("lo", "hi", "tid"))
        key, i, j = (table.column(c).to_numpy() for c in ("key", "i", "j"))
        group = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])).astype(np.uint64)
        counts = (hi - lo + 1).astype(np.int64)
        starts = np.cumsum([0, *map(len, parts)])[:-1]
        member = np.repeat(np.arange(len(parts)), counts)
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = starts[member] + step
        windows = mixed(mixed(Rolling(np.concatenate(parts)).of(at, at + length)) + group[member] * np.uint64(0x9E3779B97F4A7C15))
        _, where, times = np.unique(windows, return_inverse=True, return_counts=True)
        twice = (times[where] > 1) & ~table.column("witness").to_numpy()[member]
        same = member[1:] == member[:-1]
        begins = np.flatnonzero(twice & ~np.concatenate([[False], twice[:-1] & same]))
        ends = np.flatnonzero(twice & ~np.concatenate([twice[1:] & same, [False]]))
        columns = [pa.array(tid[member[begins]]), *(pa.array((step + lo[member])[x], pa.int32()) for x in (begins, ends))]
        return pa.RecordBatch.from_arrays(columns, names=["tid", "lo", "hi"])

    def compare_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Collects rows up to the end of a group, then compares some thousand of them at once."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 2 * BLOCK:
                continue
            table = pa.Table.from_batches(held)
            last = [table.column(c)[-1].as_py() for c in ("key", "i", "j")]
            open_rows = np.logical_and.reduce([table.column(c).to_numpy() == x for c, x in zip(("key", "i", "j"), last)])
            whole = table.num_rows - int(open_rows.sum())
            if whole:
                yield compare(table.slice(0, whole))
            held = table.slice(whole).combine_chunks().to_batches()
        if held:
            yield compare(pa.Table.from_batches(held))

    grouped = placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return grouped.mapInArrow(compare_all, "tid bigint, lo int, hi int")


def sent_to(texts: DataFrame, ranges: DataFrame, how: str, number: int) -> DataFrame:
    return texts.join(F.broadcast(ranges) if number <= MOST_BROADCAST_RANGES else ranges, "tid", how)


def repeats(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(tid, lo, hi): first and last start of repeated windows, for ``texts`` (tid, text)."""
    shared = written(anchor_rows(texts, length, True).groupBy("key").count().filter("count > 1").select("key"), "shared-anchors")
    alive = written(anchor_rows(texts, length, False).join(shared, "key"), "anchors")
    place = F.struct(F.xxhash64("tid", "lo").alias("place"), "tid", "a", "lo", "hi")
    stretches = alive.groupBy("key", "stretch").agg(F.min(place).alias("one"), F.max(F.xxhash64("tid", "lo")).alias("last"))
    whole = written(stretches.filter("one.place < last").select("key", "stretch", "one"), "stretches")
    settled = alive.join(whole.select("key", "stretch"), ["key", "stretch"]).select("tid", "lo", "hi")
    ends = written(alive.join(whole.select("key", "stretch"), ["key", "stretch"], "left_anti").select("key", "tid", "a", "lo", "hi").distinct(), "ends")
    witnesses = whole.join(ends.select("key").distinct(), "key", "left_semi").select("key", "one.tid", "one.a", "one.lo", "one.hi")
    members = ends.withColumn("witness", F.lit(False)).union(witnesses.withColumn("witness", F.lit(True)))
    by_text = written(members.groupBy("tid").agg(F.collect_list(F.struct("key", "a", "lo", "hi", "witness")).alias("members")), "members")
    number = by_text.agg(F.sum(F.size("members"))).first()[0] or 0

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for tid, text, members in zip(batch.column("tid").to_pylist(), batch.column("text"), batch.column("members")):
                if tid in seen:
                    continue
                seen.add(tid)
                data = bytes_of(text).tobytes()
                for m in members.as_py():
                    row = m["key"], tid, m["lo"], m["hi"], m["witness"], data[m["lo"]:m["hi"] + length]
                    for column, value in zip(out, row):
                        column.append(value)
            types = pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["key", "tid", "lo", "hi", "witness", "part"])

    cut = sent_to(texts, by_text, "inner", number).mapInArrow(parts, "key bigint, tid bigint, lo int, hi int, witness boolean, part binary")
    cut = written(cut.dropDuplicates(["key", "tid", "lo"]), "parts")
    return settled.union(repeated_windows(cut, length))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes, one row for each row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tid"))
    size = F.octet_length("text")
    copies = texts.filter(size >= length).groupBy("tid").agg(F.min(size).alias("n"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    whole = copies.select("tid", F.lit(0).alias("lo"), (F.col("n") - length).cast("int").alias("hi"))
    found = repeats(texts.select("tid", "text"), length).union(whole)
    by_text = written(found.groupBy("tid").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("ranges")), "ranges")
    number = by_text.agg(F.sum(F.size("ranges"))).first()[0] or 0
    id_field = docs.select("doc_id").schema.fields[0].dataType.simpleString()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for text, ranges in zip(batch.column("text"), batch.column("ranges")):
                data = bytes_of(text)
                edge = np.zeros(len(data) + 1, np.int32)
                if ranges.is_valid:
                    np.add.at(edge, ranges.values.field("lo").to_numpy(), 1)
                    np.add.at(edge, ranges.values.field("hi").to_numpy() + length, -1)
                gone = np.cumsum(edge)[:-1] > 0
                spans = int(gone[:1].sum() + (np.diff(gone.astype(np.int8)) == 1).sum())
                for column, value in zip(out, (len(data), int(gone.sum()), spans, data[~gone].tobytes())):
                    column.append(value)
            types = pa.int64(), pa.int64(), pa.int64(), pa.binary()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(out, types)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    joined = sent_to(texts, by_text, "left", number).select("doc_id", "text", "ranges")
    return joined.mapInArrow(keep, f"doc_id {id_field}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
