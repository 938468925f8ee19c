"""Language identification by cross-parsing.

For every language a suffix automaton is built from labelled text. A document is cut greedily into the longest phrases that occur in
that text; a language that knows the document needs few phrases. The cross entropy estimate is ``phrases * log2(model bytes) /
document bytes`` and the lowest one wins, ties by name.

The labelled text is a bounded sample: about ``DOCS_PER_LANG`` documents by the lowest hash of their id, of which whole texts are taken
while they fit into ``BYTES_PER_LANG`` bytes, each different text once; what is then left of the bytes is shared out to pieces of the
texts that did not fit (of longer texts, the middle). It reaches the tasks as text (``BYTES_PER_LANG`` for each language) and is
compiled once in each Python worker, which keeps one model as flat tables of 32-bit numbers. Parsing is one table step for each byte
and language, with no shuffle; texts of similar length take their steps together, about ``TOGETHER`` bytes at a time, and texts
too long for that one by one.

Defined cases: a null text or one without a letter is ``und`` with score 0. With one language learned the score is 1; with
none every document is ``und``, and :func:`accepted` keeps all texts with a letter. Rows with null id, lang or text are never learned from. Repeated rows get equal results; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchwatch.llm.common import hash_limit, runs_of

DOCS_PER_LANG, BYTES_PER_LANG, LEAST_PIECE, UNKNOWN = 64, 24_000, 500, "und"
#: Bytes of the texts that are parsed together, byte positions of them looked at in one go, and the fewest texts worth it.
TOGETHER, POSITIONS, FEWEST = 1 << 21, 1 << 10, 24
ANY = "any"  # stands for all languages where none is learned
RESULT = pa.struct([("lang", pa.string()), ("score", pa.float64())])


def normal(text: str) -> bytes:
    """Lower-case bytes of the text; ASCII characters that are no letters become spaces, and runs of them one."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(LETTERS).split())


LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Arcs of each state of the smallest automaton that knows all substrings of ``data``; state 0 is the start."""
    arcs, link, length, last = [{}], [-1], [0], 0
    for byte in data:
        new = len(arcs)
        arcs.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and byte not in arcs[at]:
            arcs[at][byte] = new
            at = link[at]
        if at >= 0:
            known = arcs[at][byte]
            if length[known] == length[at] + 1:
                link[new] = known
            else:
                copy = len(arcs)
                arcs.append(dict(arcs[known]))
                length.append(length[at] + 1)
                link.append(link[known])
                link[known] = link[new] = copy
                while at >= 0 and arcs[at].get(byte) == known:
                    arcs[at][byte] = copy
                    at = link[at]
        last = new
    return arcs


class Parser:
    """``table[state + code]`` is the next state (times the number of codes). Where the automaton has no arc, the step
    starts a new phrase and leads to a twin of the start's successor; the twins have the lowest numbers, so counting
    phrases is counting states below ``twins``."""

    def __init__(self, data: bytes):
        used = sorted(set(data))
        self.codes, self.bytes = len(used) + 1, max(len(data), 2)
        code = {b: k for k, b in enumerate(used)}
        self.class_of = bytes(code.get(b, len(used)) for b in range(256))
        arcs = suffix_automaton(data)
        # rows: a twin for each code (the last one for unknown bytes), then the automaton's states
        table = np.tile(np.arange(self.codes, dtype=np.int32), (self.codes + len(arcs), 1))
        for k, row in enumerate(arcs):
            for byte, target in row.items():
                table[self.codes + k, code[byte]] = self.codes + target
        for byte, target in arcs[0].items():
            table[code[byte]] = table[self.codes + target]
        self.twins = self.codes * self.codes
        self.first = self.codes * self.codes
        table[self.codes] = np.arange(self.codes)  # a text starts with a phrase
        self.table = (table * np.int32(self.codes)).ravel()
        self.code_of = np.frombuffer(self.class_of, np.uint8).astype(np.int32)

    def phrases(self, data: bytes) -> int:
        table, twins, state, count = memoryview(self.table), self.twins, self.first, 0
        for c in data.translate(self.class_of):
            state = table[state + c]
            if state < twins:
                count += 1
        return count

    def phrases_of(self, bytes_at: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Phrases of many texts: ``bytes_at[i]`` holds byte ``i`` of each, of which the first ``active[i]`` are that long."""
        state = np.full(bytes_at.shape[1], self.first, np.int32)
        count = np.zeros(bytes_at.shape[1], np.int64)
        for low in range(0, len(bytes_at), POSITIONS):
            codes = self.code_of[bytes_at[low:low + POSITIONS]]
            for row, k in zip(codes, active[low:low + POSITIONS].tolist()):
                own = state[:k]
                self.table.take(row[:k] + own, out=own, mode="clip")  # never outside; other modes copy the result
                count[:k] += own < self.twins
        return count


@functools.lru_cache(maxsize=1)
def parsers(model: tuple[tuple[str, bytes], ...]) -> list[tuple[str, Parser]]:
    """Compiled once in each Python worker."""
    return [(lang, Parser(data)) for lang, data in model]


def side_by_side(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of the texts, bytes by position and text, texts that reach each position), longest text first."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    low = 0
    while low < len(order):
        longest = len(texts[order[low]])
        own = order[low:low + max(TOGETHER // longest, 1)]
        low += len(own)
        if len(own) < FEWEST:
            yield np.array(own), np.zeros((0, len(own)), np.uint8), np.zeros(0, np.int64)
            continue
        lengths = np.array([len(texts[k]) for k in own])
        padded = np.frombuffer(b"".join(texts[k].ljust(longest) for k in own), np.uint8).reshape(len(own), longest)
        yield np.array(own), np.ascontiguousarray(padded.T), len(own) - np.searchsorted(lengths[::-1], np.arange(longest), "right")


def phrases_by_language(texts: list[bytes], known: list[tuple[str, Parser]]) -> np.ndarray:
    """Number of phrases of each text (row) in each language (column)."""
    out = np.zeros((len(texts), len(known)), np.int64)
    for own, bytes_at, active in side_by_side(texts):
        for k, (_, parser) in enumerate(known):
            out[own, k] = parser.phrases_of(bytes_at, active) if len(bytes_at) else [parser.phrases(texts[i]) for i in own]
    return out


def predict(texts: list[str | None], model: tuple[tuple[str, bytes], ...]) -> list[tuple[str, float]]:
    """Language and score of each text. The score is how much lower the best entropy is than the second best one."""
    found = [(UNKNOWN, 0.0)] * len(texts)
    lettered = [k for k, text in enumerate(texts) if text and model and any(map(str.isalpha, text))]
    data = [normal(texts[k]) or b" " for k in lettered]
    known = parsers(model)
    for k, own, phrases in zip(lettered, data, phrases_by_language(data, known).tolist()):
        ranked = sorted((n * math.log2(parser.bytes) / len(own), lang) for n, (lang, parser) in zip(phrases, known))
        score = 1.0 if len(ranked) == 1 else (1.0 - ranked[0][0] / ranked[1][0] if ranked[1][0] > 0 else 0.0)
        found[k] = ranked[0][1], min(max(score, 0.0), 1.0)
    return found


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3; 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def learn(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, bytes_per_lang: int = BYTES_PER_LANG) -> tuple[tuple[str, bytes], ...]:
    """(language, sample text) for each language; what comes to the driver is bounded by the two parameters."""
    known = docs.select("doc_id", "text", "lang").filter((fold(F.col("doc_id")) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not totals:
        return ()
    order = F.xxhash64(F.col("doc_id"))
    limit = F.create_map(*[x for lang, n in sorted(totals.items()) for x in (F.lit(lang), F.lit(hash_limit(2.0 * docs_per_lang / n)).cast("long"))])
    drawn = known.withColumn("o", order).filter(F.col("o") <= F.element_at(limit, F.col("lang")))
    # longer texts are cut before they come to the driver; runs of ASCII characters that are no letters go first, as in normal()
    letters = F.regexp_replace("text", r"[\x00-@\[-`{-\x7f]+", " ").cast("binary")
    middle = letters.substr(F.greatest(F.lit(1), F.floor((F.octet_length(letters) - bytes_per_lang) / 2).cast("int") + 1), F.lit(bytes_per_lang))
    fits = F.octet_length("text") <= bytes_per_lang
    rows = drawn.select("lang", "o", fits.alias("fits"), F.when(fits, F.col("text").cast("binary")).otherwise(middle).alias("text")).collect()
    held: dict[str, tuple[dict, dict]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["o"], r["text"])):
        whole, cut = held.setdefault(row["lang"], ({}, {}))
        text = normal(bytes(row["text"]).decode("utf-8", "ignore"))
        if text and text not in whole:
            (whole if row["fits"] and sum(map(len, whole)) + len(whole) + len(text) <= bytes_per_lang else cut)[text] = None
    return tuple((lang, sample) for lang, (whole, cut) in sorted(held.items()) if (sample := filled(whole, cut, bytes_per_lang)))


def filled(whole: dict[bytes, None], cut: dict[bytes, None], size: int) -> bytes:
    """The whole texts, then equal pieces of the others in what is left of ``size`` bytes."""
    texts, rest = list(whole), size - sum(map(len, whole)) - len(whole)
    for k, text in enumerate(cut):
        piece = text[:min(max(rest // (len(cut) - k), LEAST_PIECE), max(rest, 0))].decode("utf-8", "ignore").strip().encode()
        if piece:
            texts.append(piece)
            rest -= len(piece) + 1
    return b" ".join(texts)


def languages_of(text: Column, model: tuple[tuple[str, bytes], ...]) -> Column:
    """struct(lang, score) for a text column."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def identify(texts: pa.Array) -> pa.Array:
        found = chain.from_iterable(predict(texts.slice(start, number).to_pylist(), model) for start, number in runs_of(texts, 2 * TOGETHER))
        return pa.array([{"lang": lang, "score": score} for lang, score in found], type=RESULT)

    return identify(text)


def identify(docs: DataFrame, model: tuple[tuple[str, bytes], ...]) -> DataFrame:
    """doc_id, held_out, lang_pred and score, one row for each row of ``docs``."""
    found = docs.select("doc_id", languages_of(F.col("text"), model).alias("found"))
    return found.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"),
    )


def accepted(docs: DataFrame, model: tuple[tuple[str, bytes], ...]) -> DataFrame:
    """The documents that have a language, or with no language learned those that have a letter; all columns stay as they are."""
    return docs.filter(languages_of(F.col("text"), model or ((ANY, b" "),))["lang"] != UNKNOWN)
