"""Removes every word covered by a long run of words that also starts elsewhere: seed and extend.

1. *Seeds.* Of the 28 grams of 8 words in a window of 35 the one with the smallest hash is the window's anchor (winnowing), so equal windows
   have an equal anchor at the same place. An anchor stands for the windows that chose it, 28 neighbours at most; about every twelfth
   word is one. Grams with one place in the whole corpus are dropped.
2. *Join.* Places of an equal gram meet. Where all windows of an anchor, taken together, stand at two places, the match extends over all
   of them, and these places are settled.
3. *Extension.* The other places of a shared gram, and one witness of each settled stretch, are extended both ways: each window around the
   anchor is one extension, from all the way to the left to all the way to the right. Extensions that two places share are repeats. They
   are counted as hashes, combined before the shuffle; every window of the corpus belongs to one anchor, so a group of K places costs
   28 K rows at most and no pairs.
4. *Maximal repeats.* The overlapping extensions of a text are united; their words go.

Texts that occur more than once are settled as a whole. Words are hashed by a published 64-bit hash and joined by a mixer; a gram and
its stretch, or a gram and its extension, must both agree, so two different strings are taken for one with probability N^2 / 2^129
for N of them. Texts are known by 64 bits.

Memory: words are hashed in pieces of a million bytes and seeded in pieces of 2^18 windows; a task holds 8 bytes a word of
its current text beside that, whatever the text's length.

Defined cases: null, empty and blank texts have no words; texts of fewer words than the window keep them all; repeated rows are repeats
of each other; empty tables and null ids are fine; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwatch.llm.common import written
from batchwatch.llm.hashing import WordHashes, mixed

WINDOW, GRAM = 35, 8
#: Words of a piece, bytes that are split at once.
PIECE, BYTES = 1 << 18, 1_000_000
U = np.uint64


def parts_of(data: bytes, size: int = BYTES) -> Iterator[list[bytes]]:
    """The words of a text (bytes.split knows the same six separators), some at a time."""
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end].split()
        at = end


def hashes_of(text: str | None, known: WordHashes) -> np.ndarray:
    data = (text or "").encode("utf-8", "surrogatepass")
    return np.concatenate([np.zeros(0, U), *(np.fromiter(map(known.__getitem__, words), U, len(words)) for words in parts_of(data))])


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * U(0x9E3779B97F4A7C15) + b)


def powers_of_two(words: np.ndarray, longest: int) -> dict[int, np.ndarray]:
    """Hashes of all runs of 1, 2, 4 ... words, up to ``longest``."""
    runs = {1: words}
    width = 1
    while width * 2 <= longest:
        h = runs[width]
        runs[width * 2] = joined(h[:-width], h[width:]) if len(h) > width else h[:0]
        width *= 2
    return runs


def run_of(runs: dict[int, np.ndarray], start: np.ndarray, length: int | np.ndarray, width: int) -> np.ndarray:
    """Hash of the run of ``length`` words, from the two runs of ``width`` <= length <= 2 width that cover it."""
    return joined(runs[width][start], runs[width][start + length - width]) + np.asarray(length).astype(U)


def floor_power(n: int) -> int:
    return 1 << (n.bit_length() - 1)


def chosen_grams(keys: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` grams the place of the smallest, leftmost of equals."""
    low, step = U(0xFFFFFFFF), 1
    best = (keys & ~low) | np.arange(len(keys), dtype=U)
    while step * 2 <= width:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    if step < width:
        best = np.minimum(best[:len(best) - (width - step)], best[width - step:])
    return (best & low).astype(np.int64)


def seeds(words: np.ndarray, window: int, gram: int, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(gram hash, hash of the stretch, first window, last window) of the anchors of one text, ``size`` windows at a time."""
    for left in range(0, len(words) - window + 1, size):
        piece = words[left:left + size + window - 1]
        runs = powers_of_two(piece, window)
        keys = run_of(runs, np.arange(len(piece) - gram + 1), gram, floor_power(gram))
        chosen = chosen_grams(keys, window - gram + 1)
        lo = np.flatnonzero(np.diff(chosen, prepend=-1))
        hi = np.append(lo[1:], len(chosen)) - 1
        first, last = (run_of(runs, at, window, floor_power(window)) for at in (lo, hi))  # two windows cover the stretch
        yield keys[chosen[lo]], joined(first, last) + (hi - lo).astype(U), lo + left, hi + left


def anchors(texts: DataFrame, window: int, gram: int, size: int) -> DataFrame:
    """(tid, key, stretch, lo, hi), once for each text and task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = WordHashes(), set()
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

        def packed(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(c).view(np.int64)).cast(t) for c, t in zip(zip(*found), types)]
            return pa.RecordBatch.from_arrays(columns, names=["tid", "key", "stretch", "lo", "hi"])

        for batch in batches:
            found, held = [], 0
            for tid, text in zip(batch.column("tid").to_pylist(), batch.column("text")):
                if tid in seen:
                    continue
                seen.add(tid)
                for piece in seeds(hashes_of(text.as_py(), known), window, gram, size):
                    found.append((np.full(len(piece[0]), tid, np.int64), *piece))
                    held += len(piece[0])
                    if held > size:
                        yield packed(found)
                        found, held = [], 0
            if found:
                yield packed(found)

    return texts.mapInArrow(rows, "tid bigint, key bigint, stretch bigint, lo int, hi int")


def extensions(texts: DataFrame, wanted: DataFrame, window: int, size: int) -> DataFrame:
    """(key, extension, tid, lo): the windows of the ``wanted`` anchors (tid, places: key, lo, hi)."""
    step = max(1, size // (2 * window))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = WordHashes(), set()
        for batch in batches:
            for tid, text, places in zip(batch.column("tid").to_pylist(), batch.column("text"), batch.column("places")):
                if tid in seen:
                    continue
                seen.add(tid)
                words = hashes_of(text.as_py(), known)
                for k in range(0, len(places.values), step):
                    key, lo, hi = (places.values.field(c).to_numpy()[k:k + step].astype(np.int64) for c in ("key", "lo", "hi"))
                    length, number = hi - lo + window, hi - lo + 1
                    starts = np.cumsum(length) - length
                    member = np.repeat(np.arange(len(lo)), length)
                    around = words[np.arange(len(member)) - starts[member] + lo[member]]
                    owner = np.repeat(np.arange(len(lo)), number)
                    shift = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
                    found = run_of(powers_of_two(around, window), starts[owner] + shift, window, floor_power(window))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[owner]), pa.array(found.view(np.int64)), pa.array(np.full(len(owner), tid, np.int64)), pa.array((lo[owner] + shift).astype(np.int32))],
                        names=["key", "extension", "tid", "lo"],
                    )

    return texts.join(wanted, "tid").select("tid", "text", "places").mapInArrow(rows, "key bigint, extension bigint, tid bigint, lo int")


def repeats(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, size: int = PIECE) -> DataFrame:
    """(tid, lo, hi): first window and end of repeats, for ``texts`` (tid, text)."""
    every = written(anchors(texts, window, gram, size), "anchors")
    shared = written(every.groupBy("key").count().filter("count > 1").select("key"), "shared-grams")  # a table, so that Spark may split the join
    found = written(every.join(shared, "key"), "shared-anchors")
    one = [F.first(c).alias(c) for c in ("tid", "lo", "hi")]
    stretches = written(found.groupBy("key", "stretch").agg(F.count(F.lit(1)).alias("n"), *one), "stretches")
    settled = found.join(stretches.filter("n > 1").select("key", "stretch"), ["key", "stretch"])
    open_keys = stretches.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key")
    open_keys = written(open_keys, "open-grams")
    places = stretches.join(open_keys, "key").groupBy("tid").agg(F.collect_list(F.struct("key", "lo", "hi")).alias("places"))
    extended = written(extensions(texts, places, window, size), "extensions")
    spot = F.xxhash64("tid", "lo")
    twice = extended.groupBy("key", "extension").agg(F.min(spot).alias("one"), F.max(spot).alias("other")).filter("one <> other")
    ends = extended.join(written(twice.select("key", "extension"), "repeats"), ["key", "extension"])
    return settled.select("tid", "lo", (F.col("hi") + window).alias("hi")).union(ends.select("tid", "lo", (F.col("lo") + window).alias("hi")))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, size: int = PIECE) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space, one row for each row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tid"))
    copies = texts.filter(F.octet_length("text") >= 2 * window - 1).groupBy("tid").count().filter("count > 1")
    everything = copies.select("tid", F.lit(0).alias("lo"), F.lit(-1).alias("hi"))  # -1: up to the end of the text
    ranges = repeats(texts.select("tid", "text"), window, gram, size).union(everything)
    by_text = written(ranges.groupBy("tid").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), "ranges")
    id_field = docs.select("doc_id").schema.fields[0].dataType.simpleString()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_in, removed, kept = [], [], []
            for text, ranges in zip(batch.column("text"), batch.column("ranges")):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                gone = covered(len(words), ranges, window) if ranges.is_valid else None
                words_in.append(len(words))
                removed.append(0 if gone is None else int(gone.sum()))
                if gone is not None:
                    words = [words[i] for i in np.flatnonzero(~gone)]
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            columns = [batch.column("doc_id"), pa.array(words_in, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])

    joined_up = texts.join(by_text, "tid", "left").select("doc_id", "text", "ranges")
    return joined_up.mapInArrow(keep, f"doc_id {id_field}, n_words bigint, n_removed bigint, kept string")


def covered(n: int, ranges: pa.ListScalar, window: int) -> np.ndarray:
    """Marks the words of ``ranges``; a text shorter than the window has none."""
    edge = np.zeros(n + 1, np.int32)
    if n >= window:
        hi = ranges.values.field("hi").to_numpy()
        np.add.at(edge, ranges.values.field("lo").to_numpy(), 1)
        np.add.at(edge, np.where(hi < 0, n, hi), -1)
    return np.cumsum(edge)[:-1] > 0
