"""Collocations of two and three words, counted level by level in burst tries that spill sorted runs.

A task counts the phrases of its texts in one trie for each language. The trie is shallow: its root is keyed by the number of the first
word, and below it stand hash containers, keyed by the rest of the phrase. A container that grows over ``burst`` entries bursts into
a node keyed by the second word, with a container for each. When a task holds ``entries`` of them (or ``words`` different words), the
largest subtrees are spilled whole, as runs sorted by phrase, until half is left. Runs travel by the first two words of their phrases,
and each partition of prefixes merges its runs. So a phrase is a row for each spill, however often it occurs, a frequent word's
phrases are spread by their second words, and memory is bounded whatever the text holds.

Only phrases of at least ``LEAST`` occurrences go on, and the parts of a frequent phrase are as frequent. So phrases of one word are counted
first, then those of two whose words passed, then those of three whose pairs passed. What passed reaches the tasks as a filter of a fixed
number of bits: it lets all frequent parts through and some others, which the merge drops, so counts are exact however full it is.
Scores are exact, too (decimals of 38 digits).

Defined cases: null texts have no words; null languages count as ``und``, together with texts of that language; repeated rows count each
time; texts are counted in pieces of some megabytes, so very long ones are fine (a piece ends between words, and its phrases go on into
the next); empty tables give no phrases; other columns are not read.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchwatch.llm.common import written
from batchwatch.llm.hashing import mixed

LONGEST, LEAST, PERCENT, TOP, SCALE = 3, 10, 50, 2000, 1_000_000
#: A language's phrases are ranked in so many parts first.
DEALS = 64
BITS = 21  # a word's number: those of a task and of one piece stay below 2^21
SECOND, LOW = (1 << 2 * BITS) - 1, (1 << BITS) - 1
#: Characters that end a piece become a full stop, which no word can hold (fixed values).
ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"..........")
#: Bits of the filter, as a power of two: 16 MB. A phrase sets two.
FILTER = 27
U = np.uint64


class Limits(NamedTuple):
    """Entries of a container, entries and words of a task, bytes that are counted at once."""

    burst: int = 4096
    entries: int = 500_000
    words: int = 300_000
    bytes: int = 4_000_000


class Node(dict):
    """A burst container: second word -> container of third words."""


class Trie:
    """Counts of the phrases of one language: packed numbers of one to three words."""

    def __init__(self, burst: int):
        self.most = burst
        self.root: dict[int, dict] = {}
        self.sizes: dict[int, int] = {}

    def add(self, phrases: np.ndarray, counts: np.ndarray) -> int:
        """Adds distinct phrases in ascending order; returns how many of them are new."""
        firsts = phrases >> (2 * BITS)
        cuts = np.flatnonzero(np.diff(firsts, prepend=-1))
        rests, numbers = (phrases & SECOND).tolist(), counts.tolist()
        new = 0
        for first, lo, hi in zip(firsts[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(phrases)]):
            below = self.root.get(first)
            if isinstance(below, Node):
                grown = 0
                for rest, number in zip(rests[lo:hi], numbers[lo:hi]):
                    inner = below.get(rest >> BITS)
                    if inner is None:
                        inner = below[rest >> BITS] = {}
                    third = rest & LOW
                    grown += third not in inner
                    inner[third] = inner.get(third, 0) + number
            else:
                if below is None:
                    grown, below = hi - lo, dict(zip(rests[lo:hi], numbers[lo:hi]))
                    self.root[first] = below
                else:
                    grown = -len(below)
                    for rest, number in zip(rests[lo:hi], numbers[lo:hi]):
                        below[rest] = below.get(rest, 0) + number
                    grown += len(below)
                if len(below) > self.most:
                    self.burst(first)
            self.sizes[first] = self.sizes.get(first, 0) + grown
            new += grown
        return new

    def burst(self, first: int) -> None:
        node = Node()
        for rest, number in self.root[first].items():
            node.setdefault(rest >> BITS, {})[rest & LOW] = number
        self.root[first] = node

    def take(self, first: int) -> dict:
        """Removes a subtree: the rests of its phrases, with their counts."""
        below = self.root.pop(first)
        del self.sizes[first]
        if isinstance(below, Node):
            return {second << BITS | third: number for second, inner in below.items() for third, number in inner.items()}
        return below


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * U(0x9E3779B97F4A7C15) + b)


def hash_in(lang: str, hashes: np.ndarray) -> np.ndarray:
    """Hashes of words of one language."""
    return joined(hashes_of([lang.encode("utf-8", "surrogatepass")]), hashes)


def slots(hashes: np.ndarray) -> list[np.ndarray]:
    """The filter's bits of some phrases."""
    return [hashes >> U(64 - FILTER), hashes & U((1 << FILTER) - 1)]


def passes(filter_bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    ok = np.ones(len(hashes), bool)
    for slot in slots(hashes):
        ok &= (filter_bits[slot >> U(6)] >> (slot & U(63))) & U(1) == 1
    return ok


def split(data: bytes) -> pa.Array:
    """The words and full stops of ``data``, between spaces and tabs."""
    at = np.frombuffer(data, np.uint8)
    inside, stop = (at != 32) & (at != 9), at == 46
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | stop[:-1] | stop[1:]
    places = np.append(np.flatnonzero(starts[inside]), np.count_nonzero(inside)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(at[inside])])


def bytes_of(words: pa.Array) -> list[bytes]:
    """The values of a whole array without nulls, many times faster than its scalars."""
    _, places, data = words.buffers()
    if not len(words):
        return []
    at, held = np.frombuffer(places, np.int32)[:len(words) + 1].tolist(), data.to_pybytes()
    return [held[a:b] for a, b in zip(at, at[1:])]


class Counter:
    """The tries of one task, for phrases of ``level`` words."""

    def __init__(self, level: int, limits: Limits, filter_bits: np.ndarray | None):
        self.level, self.limits, self.filter = level, limits, filter_bits
        self.forget()

    def forget(self) -> None:
        """Starts a new numbering of words, once everything is spilled."""
        self.numbers: dict[bytes, int] = {b".": 0}
        self.words: list[bytes] = [b""]
        self.hashes = np.zeros(1, U)
        self.tries: dict[str, Trie] = {}
        self.totals: dict[str, int] = {}
        self.entries = 0

    def numbers_of(self, found: pa.Array) -> np.ndarray:
        """The number of each word; new words get the next ones."""
        coded = found.dictionary_encode()
        words = bytes_of(coded.dictionary)
        new = [w for w in words if w not in self.numbers]
        self.numbers.update(zip(new, range(len(self.words), len(self.words) + len(new))))
        self.words += new
        self.hashes = np.concatenate([self.hashes, hashes_of(new)])
        numbers = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        return numbers[coded.indices.to_numpy()]

    def count(self, lang: str, data: bytes) -> list[bytes]:
        """Counts the phrases of lower-cased ``data``, whose pieces end at full stops. Returns the last words, one less than a phrase has: with
        them in front, the rest of a long text can follow."""
        found, k = split(data), self.level
        ids = self.numbers_of(found)
        number = max(0, len(ids) - k + 1)
        columns = [ids[j:j + number] for j in range(k)]
        whole = np.logical_and.reduce([c > 0 for c in columns])
        if k > 1:
            hashes = hash_in(lang, self.hashes)[ids]
            parts = hashes if k == 2 else joined(hashes[:-1], hashes[1:])
            ok = passes(self.filter, parts)
            whole &= ok[:number] & ok[1:number + 1]
        if k == 1:  # all words are in one container
            counts = np.bincount(ids[whole])
            phrases = np.flatnonzero(counts)
            counts = counts[phrases]
            self.totals[lang] = self.totals.get(lang, 0) + int(counts.sum())
        else:
            phrases, counts = np.unique(sum(c << BITS * (2 - j) for j, c in enumerate(columns))[whole], return_counts=True)
        burst = self.limits.burst if k == 3 else len(phrases) + (1 << BITS)  # what has no third word never bursts
        self.entries += self.tries.setdefault(lang, Trie(burst)).add(phrases, counts)
        return found[max(len(found) - k + 1, 0):].to_pylist()

    def spilled(self, everything: bool) -> Iterator[pa.RecordBatch]:
        """Sorted runs of the largest subtrees, until half of the entries is left (or nothing)."""
        target = 0 if everything else self.limits.entries // 2
        langs = list(self.tries)
        owner = np.repeat(np.arange(len(langs)), [len(self.tries[x].sizes) for x in langs])
        firsts = [first for x in langs for first in self.tries[x].sizes]
        sizes = np.array([n for x in langs for n in self.tries[x].sizes.values()], np.int64)
        order = np.argsort(-sizes, kind="stable")
        order = order[:np.searchsorted(np.cumsum(sizes[order]), self.entries - target) + 1]
        self.entries -= int(sizes[order].sum())
        words = pa.array(self.words, pa.binary()).cast(pa.string())
        for k, lang in enumerate(langs):
            heads = [firsts[i] for i in order[owner[order] == k]]
            if heads:
                yield self.sorted_run(lang, words, heads, [self.tries[lang].take(first) for first in heads])
        if everything and self.totals:
            yield rows_of(list(self.totals), pa.array([""] * len(self.totals)), list(self.totals.values()))
            self.totals.clear()

    def sorted_run(self, lang: str, words: pa.Array, heads: list[int], subtrees: list[dict]) -> pa.RecordBatch:
        sizes = list(map(len, subtrees))
        rests = np.fromiter(chain.from_iterable(subtrees), np.int64, sum(sizes))
        counts = np.fromiter(chain.from_iterable(s.values() for s in subtrees), np.int64, sum(sizes))
        places = (rests & LOW,) if self.level == 1 else (np.repeat(heads, sizes), rests >> BITS, rests & LOW)[:self.level]
        columns = [words.take(pa.array(c)) for c in places]
        phrases = pc.binary_join_element_wise(*columns, " ") if self.level > 1 else columns[0]
        order = pc.sort_indices(phrases)
        return rows_of([lang] * len(order), phrases.take(order), pa.array(counts).take(order))


def rows_of(lang: list[str], phrase: pa.Array, f) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), phrase, pa.array(f, pa.int64())], names=["lang", "phrase", "f"])


def pieces(data: bytes, size: int) -> Iterator[bytes]:
    """A text's megabytes, cut before a space or the end of a piece."""
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data) and data[end] not in b" \t.":
            end += 1
        yield data[at:end]
        at = end


def runs_of(texts: DataFrame, level: int, limits: Limits = Limits(), filter_bits: Broadcast | None = None) -> DataFrame:
    """(lang, phrase, f): counts of the phrases of ``level`` words whose parts pass the filter, a row for each spill. The first level also
    counts the words of all texts, as the phrase of none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, held, size = Counter(level, limits, filter_bits and filter_bits.value), {}, {}

        def relieved() -> Iterator[pa.RecordBatch]:
            if len(counter.words) > limits.words:
                yield from counter.spilled(True)
                counter.forget()
            elif counter.entries > limits.entries:
                yield from counter.spilled(False)

        def counted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from counted_batch(batch)
            for lang, some in held.items():
                counter.count(lang, b".".join(some))
                yield from relieved()
            yield from counter.spilled(True)

        def counted_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().translate(ENDS)
                if len(data) > limits.bytes:
                    last: list[bytes] = []
                    for piece in pieces(data, limits.bytes):
                        last = counter.count(lang, b" ".join([*last, piece]))
                        yield from relieved()
                    continue
                held.setdefault(lang, []).append(data)
                size[lang] = size.get(lang, 0) + len(data)
                if size[lang] >= limits.bytes:
                    counter.count(lang, b".".join(held.pop(lang)))
                    size.pop(lang)
                    yield from relieved()

        gc.disable()  # tries hold no cycles, and searching their containers for some takes a tenth of the time
        try:
            yield from counted()
        finally:
            gc.enable()

    return texts.mapInArrow(rows, "lang string, phrase string, f bigint")


def filter_of(counts: DataFrame) -> Broadcast:
    """The filter that all of ``counts`` (lang, phrase) pass, as 64-bit words. At most 2^``FILTER`` / 64 rows reach the driver."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.zeros(batch.num_rows, U)
            for i, (lang, phrase) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())):
                words = hash_in(lang, hashes_of(phrase.encode("utf-8", "surrogatepass").split(b" ")))
                hashes[i] = (words if len(words) == 1 else joined(words[:1], words[1:]))[0]
            slot = np.unique(np.concatenate([np.zeros(0, U), *slots(hashes)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array((slot >> U(6)).astype(np.int64)), pa.array((U(1) << (slot & U(63))).view(np.int64))], names=["at", "bits"]
            )

    rows = counts.select("lang", "phrase").mapInArrow(bits, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << FILTER - 6, U)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(U)
    return counts.sparkSession.sparkContext.broadcast(out)


def frequent(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(lang, phrase, f) of the phrases of at least ``LEAST`` occurrences, and the number of words as the phrase of none."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    texts = docs.select(lang.alias("lang"), "text")
    found, passed = None, None
    for level in range(1, LONGEST + 1):
        runs, keys = runs_of(texts, level, limits, passed), ["lang", "phrase"]
        if level > 2:  # shorter phrases are their own prefixes
            runs, keys = runs.withColumn("prefix", F.substring_index("phrase", " ", 2)), ["lang", "prefix", "phrase"]
        merged = runs.repartition(*keys[:2]).groupBy(*keys).agg(F.sum("f").alias("f"))
        counts = written(merged.filter(f"f >= {LEAST} or phrase = ''").select("lang", "phrase", "f"), f"phrases-{level}")
        found = counts if found is None else found.union(counts)
        if level < LONGEST:
            passed = filter_of(counts.filter("phrase <> ''"))
    return found


def words_in(phrase: Column) -> Column:
    return F.split(phrase, " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates: each at the cut that scores lowest, ties at the first."""
    words = words_in(F.col("phrase"))
    candidates = counts.filter("instr(phrase, ' ') > 0").select("lang", "phrase", F.col("f").alias("a"), words.alias("words"))
    cut = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", "a", "words", cut)
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ").alias("rest"),
    )
    with_first = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    both = with_first.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    exact = F.expr(f"(cast(a as decimal(38,0)) * a * {SCALE}) div (cast(l as decimal(38,0)) * r)")
    lowest = F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("lowest")
    return both.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "lowest.l", "lowest.r", "lowest.score")


def covers(counts: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the highest count of a longer candidate that holds the phrase."""
    words = words_in(F.col("phrase"))
    longer = counts.filter(F.size(words) == LONGEST).select("lang", F.col("f").alias("longer"), words.alias("words"))
    inner = F.explode(F.array(*[F.array_join(F.slice("words", k, LONGEST - 1), " ") for k in (1, 2)])).alias("phrase")
    return longer.select("lang", inner, "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))


def collocations(docs: DataFrame, top: int = TOP, limits: Limits = Limits()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of each language."""
    counts = frequent(docs, limits)
    kept = scored(counts).join(covers(counts), ["lang", "phrase"], "left").filter(f"longer is null or 100 * longer < {PERCENT} * a")
    order = F.col("score").desc(), F.col("a").desc(), F.col("phrase")
    kept = kept.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(DEALS)))  # so that no task ranks all of a language
    best = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    total = counts.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
