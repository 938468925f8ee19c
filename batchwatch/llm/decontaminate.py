"""Finds benchmark items in documents by latent semantic retrieval.

1. Document frequencies of hashed words over all documents give the IDF weights.
2. A randomised SVD of the TF-IDF passages (range finder with one power step, then Rayleigh-Ritz) gives one latent space for all
   benchmark passages of about the same length, with an eighth as many dimensions as passages (``LEAST_RANK`` to ``MOST_RANK``, none
   without weight). Its rows are all these passages and nothing else, so no document or sample of them shapes it; the products with
   the tall matrix are partial sums in the tasks, added up by Spark.
3. Every window of every document, about as long as the passages, is projected once. Its candidates are the passages whose latent
   cosine is at least ``NEAR``; the cosine of the whole TF-IDF vectors then confirms them (``MIN_COSINE``). Windows whose TF-IDF
   weight lies mostly outside the passages' words cannot reach that and are passed over, which is exact.
4. Every confirmed window is verified on words, best cosine first, until one passes: the longest common subsequence of passage and
   surrounding text, and for paraphrases also the item's answer, its closing words. An item is found if one of its passages is, or
   all of it in a looser form.

Copies word for word do not hang on the cosine: the first words of each passage are looked up at every word of every document.

Only the IDF table (``FEATURES`` numbers), the passages' sums and the benchmark reach driver and tasks; a benchmark of more than
``PART_BYTES`` of text is searched part by part. Documents are never shuffled. Texts are worked on together, about ``CHUNK``
characters at a time; a longer text is taken whole.

Words are runs of letters and digits, and single characters in scripts that are written without spaces; for cosine and common
order such a character counts together with the next one, as characters alone say little.

Defined cases: null or empty texts hold nothing; items without a word are passed over; items of fewer than ``MIN_ITEM_WORDS`` words
are found word for word only, so an item of one word is found in every document with this word; repeated items and documents each
give their rows; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchwatch.llm.common import free_name
from batchwatch.llm.hashing import Rolling, mixed

FEATURES, OVERSAMPLE, SEED = 1 << 16, 16, 7
#: Dimensions of a latent space: passages / ``RANK_SHARE``, within these bounds. Smallest latent cosine of a candidate.
RANK_SHARE, LEAST_RANK, MOST_RANK, NEAR = 8, 16, 64, 0.65
#: Share of the largest eigenvalue below which a dimension holds no passage and is only rounding.
NO_WEIGHT = 1e-9
#: Characters of the texts that are worked on together, windows and pairs looked at in one step, and text bytes of a benchmark part.
CHUNK, STEP, PAIRS, PART_BYTES = 1 << 19, 512, 1 << 14, 32 << 20
PASSAGE, MIN_ITEM_WORDS, HEAD = 48, 8, 4
#: Window for passages of at least so many words; windows start every quarter of their length.
WINDOWS = {24: 32, 12: 16, 0: 8}
#: Smallest cosine of a window; share of an item's words in common order for a copy, and for a paraphrase with its answer.
MIN_COSINE, COPY_SHARE, PARAPHRASE_SHARE, ANSWER_WORDS, ANSWER_SHARE = 0.45, 0.8, 0.6, 5, 0.6
INSIDE = np.zeros(256, bool)
INSIDE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


#: Code points of scripts written without spaces (Thai to Lao, Burmese, Khmer, Japanese, Chinese), and of marks between their words.
UNSPACED = np.array([(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3041, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF)])
BREAKS = np.array([(0x3000, 0x3004), (0x3008, 0x3040), (0x30FB, 0x30FB), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)])
CHAIN = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """Hashes of the words of some texts, one text after another, and place by place the terms they are compared by; see the top
    of the file. Text ``k`` has the places ``first[k]`` to ``first[k + 1]``."""

    words: np.ndarray
    terms: np.ndarray
    first: np.ndarray

    def stops(self) -> np.ndarray:
        """The end of its text for each place."""
        return np.repeat(self.first[1:], np.diff(self.first))

    def parts(self) -> list[Words]:
        """The texts one by one."""
        cut = list(zip(self.first[:-1].tolist(), self.first[1:].tolist()))
        return [Words(self.words[a:b], self.terms[a:b], np.array([0, b - a])) for a, b in cut]


def among(points: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ranges[:, 0], points, "right") - 1
    return (at >= 0) & (points <= ranges[at, 1])


def words_of(*texts: str | None) -> Words:
    """Words (lower case) of some texts."""
    encoded = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(encoded), np.uint8)  # no word holds a line break
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = INSIDE[data]
    lead = np.flatnonzero(data >= 0xE0)
    single = lead[:0]
    if len(lead):  # characters of three and four bytes
        long = data[lead] >= 0xF0
        tail = [(data[lead + k] & 63).astype(np.int64) for k in (1, 2)] + [(data[np.where(long, lead + 3, lead)] & 63).astype(np.int64)]
        head = data[lead].astype(np.int64)
        points = np.where(long, (head & 7) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2], (head & 15) << 12 | tail[0] << 6 | tail[1])
        own, size = among(points, UNSPACED), np.where(long, 4, 3)
        apart = own | among(points, BREAKS)
        for k in range(4):
            inside[1 + lead[apart & (size > k)] + k] = 0
        single, size = lead[own], size[own]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(single):
        start, end = np.concatenate([start, single]), np.concatenate([end, single + size])
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
    words = mixed(Rolling(data).of(start, end) + (end - start).astype(np.uint64))
    first = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in encoded)]))
    if not len(single):
        return Words(words, words, first)
    alone = np.isin(start, single)
    joined = np.flatnonzero(alone[:-1] & alone[1:] & (end[:-1] == start[1:]))
    terms = words.copy()
    terms[joined] = mixed(words[joined] * CHAIN + words[joined + 1])
    return Words(words, terms, first)


def chunks(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of about ``CHUNK`` characters."""
    own, size = [], 0
    for t in texts:
        own.append(t)
        size += len(t or "")
        if size >= CHUNK:
            yield own
            own, size = [], 0
    if own:
        yield own


def feature_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(48)).astype(np.int64)  # one of FEATURES


def document_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Number of documents with each feature, and of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for texts in chunks(t.as_py() for t in batch.column("text")):
                own = words_of(*texts)
                f = feature_of(own.terms)
                order = by_feature(f)
                ranked, text = f[order], np.repeat(np.arange(len(texts)), np.diff(own.first))[order]
                new = np.ones(len(f), bool)  # first place of a feature in a text
                new[1:] = (ranked[1:] != ranked[:-1]) | (text[1:] != text[:-1])
                df[:FEATURES] += np.bincount(ranked[new], minlength=FEATURES)
                df[FEATURES] += len(texts)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(df[used])], names=["feature", "df"])

    rows = docs.select("text").mapInArrow(count, "feature bigint, df bigint").groupBy("feature").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(FEATURES + 1, np.int64)
    for r in rows:
        df[r["feature"]] = r["df"]
    return df[:FEATURES], int(df[FEATURES])


def by_feature(f: np.ndarray) -> np.ndarray:
    """Places in the order of their features, equal ones as they stand."""
    return np.argsort(f.astype(np.uint16), kind="stable")


@dataclass
class Space:
    """Passages of some items and their latent space: ``column`` maps features to rows of ``basis`` (-1: none), ``latent`` holds a
    unit vector for each passage. ``keys`` and ``weights`` are the entries of the passages' unit TF-IDF vectors, ordered by passage
    and feature. ``item`` maps passages to items; ``closing`` tells which of them hold their item's closing words. Passages are
    terms, ``window`` is the length of the windows for them."""

    passages: list[np.ndarray]
    item: np.ndarray
    closing: np.ndarray
    window: int
    column: np.ndarray
    basis: np.ndarray
    latent: np.ndarray
    keys: np.ndarray
    weights: np.ndarray


def passages_of(items: list[tuple[object, Words]]) -> list[tuple[int, slice, bool]]:
    """(item, place in it, closing) of the passages of all items."""
    cut = []
    for k, (_, own) in enumerate(items):
        n = len(own.words)
        starts = range(0, max(1, n - PASSAGE // 2), PASSAGE // 2) if n > PASSAGE * 4 // 3 else [0]
        cut += [(k, slice(s, min(s + PASSAGE, n) if len(starts) > 1 else n), s == starts[-1]) for s in starts]
    return cut


def spaces_of(items: list[tuple[object, Words]], docs: DataFrame, idf: np.ndarray) -> list[Space]:
    """A latent space for each length of windows. Of ``docs`` only the session is used."""
    cut = [(k, items[k][1].terms[place], closing) for k, place, closing in passages_of(items)]
    out, longer = [], np.inf
    for least, window in WINDOWS.items():
        alike = [x for x in cut if max(least, MIN_ITEM_WORDS) <= len(x[1]) < longer]
        longer = least
        if alike:
            out.append(fit([w for _, w, _ in alike], np.array([k for k, _, _ in alike]), np.array([c for _, _, c in alike]), window, docs.sparkSession, idf))
    return out


def chained(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on."""
    n = max(len(words) - size + 1, 0)
    out = words[:n]
    for k in range(1, size):
        out = mixed(out * CHAIN + words[k:k + n])
    return out


class Runs:
    """Finds passages word for word, by the hash of their first words (at most ``HEAD``)."""

    def __init__(self, items: list[tuple[object, Words]]):
        self.heads: dict[int, tuple[np.ndarray, dict[int, list[tuple[int, np.ndarray, bool]]]]] = {}
        for k, place, closing in passages_of(items):
            words = items[k][1].words[place]
            size = min(len(words), HEAD)
            marks, known = self.heads.setdefault(size, (np.zeros(FEATURES, bool), {}))
            head = chained(words[:size], size)
            marks[feature_of(head)] = True
            known.setdefault(int(head[0]), []).append((k, words, closing))

    def of(self, text: Words) -> dict[int, dict[int, bool]]:
        """text -> item -> whether its closing words are in the copy, for all items with a passage in the text."""
        found: dict[int, dict[int, bool]] = {}
        words = text.words
        for size, (marks, known) in self.heads.items():
            head = chained(words, size)
            at = np.flatnonzero(marks[feature_of(head)])
            at = at[np.isin(head[at], np.fromiter(known, np.uint64, len(known)))]
            owner = np.searchsorted(text.first, at, "right") - 1
            for place, value, k in zip(at.tolist(), head[at].tolist(), owner.tolist()):
                for item, passage, closing in known[value]:
                    own = found.get(k, {})
                    if not own.get(item) and place + len(passage) <= text.first[k + 1] and np.array_equal(words[place:place + len(passage)], passage):
                        found.setdefault(k, own)[item] = closing
        return found


def length_of(f: np.ndarray, idf: np.ndarray) -> float:
    """Length of the TF-IDF vector of some words."""
    used, times = np.unique(f, return_counts=True)
    return max(float(np.sqrt(((idf[used] * times) ** 2).sum())), 1e-12)


def repeats(f: np.ndarray, size: int, stops: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(place, place) of all pairs of equal features less than ``size`` words apart, in one text if its ends are given."""
    order = by_feature(f)
    ranked, first, second = f[order], [order[:0]], [order[:0]]
    limit = np.arange(size, size + len(f))
    limit = (limit if stops is None else np.minimum(limit, stops))[order]
    alive = np.arange(len(f))
    for lag in range(1, size):  # places of a feature ascend, so what is too far away stays so
        alive = alive[:np.searchsorted(alive, len(f) - lag)]
        alive = alive[(ranked[alive + lag] == ranked[alive]) & (order[alive + lag] < limit[alive])]
        if not len(alive):
            break
        first.append(order[alive])
        second.append(order[alive + lag])
    return np.concatenate(first), np.concatenate(second)


def window_norms(weight2: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], starts: np.ndarray, size: int, firsts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
    """Squared length of the TF-IDF vector of each window: (sum of equal words)^2 is the squares and twice the pairs. ``firsts``
    are the places where the texts of the pairs start, ``ends`` those where the windows end."""
    energy = np.concatenate([[0.0], np.cumsum(weight2)])
    a, b = pairs
    twice = np.bincount(np.maximum(b - size + 1, 0 if firsts is None else firsts), 2 * weight2[a], len(weight2) + 1) - np.bincount(a + 1, 2 * weight2[a], len(weight2) + 1)
    ends = np.minimum(starts + size, len(weight2)) if ends is None else ends
    return energy[ends] - energy[starts] + np.cumsum(twice)[starts]


def tall_product(column: np.ndarray, idf: np.ndarray, passages: list[np.ndarray], right: np.ndarray) -> np.ndarray:
    """A^T (A right) for the TF-IDF rows of the passages, each of unit length."""
    out = np.zeros_like(right)
    for words in passages:
        f = feature_of(words)
        weight = idf[f] / length_of(f, idf)
        own = column[f] >= 0
        col, weight = column[f][own], weight[own]
        np.add.at(out, col, np.outer(weight, weight @ right[col]))
    return out


def fit(passages: list[np.ndarray], item: np.ndarray, closing: np.ndarray, window: int, spark: SparkSession, idf: np.ndarray) -> Space:
    """The latent space of the passages, all of which are its rows."""
    ends = np.cumsum([0, *map(len, passages)]).astype(np.int32)
    rows = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(passages).view(np.int64)))
    spread = spark.createDataFrame(pa.table({"words": rows}))
    used = np.unique(feature_of(np.concatenate(passages)))
    column = np.full(FEATURES, -1, np.int64)
    column[used] = np.arange(len(used))
    rank = min(max(LEAST_RANK, min(len(passages) // RANK_SHARE, MOST_RANK)), len(used))
    right = np.random.default_rng(SEED).standard_normal((len(used), min(rank + OVERSAMPLE, len(used))))

    def product(right: np.ndarray) -> np.ndarray:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(right)
            for batch in batches:
                total += tall_product(column, idf, [words.values.to_numpy().view(np.uint64) for words in batch.column("words")], right)
            used = np.flatnonzero(np.abs(total).sum(axis=1))
            rows = pa.FixedSizeListArray.from_arrays(pa.array(total[used].ravel()), right.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(used), rows], names=["col", "row"])

        def added(table: pa.Table) -> pa.Table:
            col, row = table.column("col").to_numpy(), table.column("row").combine_chunks().flatten().to_numpy().reshape(-1, right.shape[1])
            used, where = np.unique(col, return_inverse=True)
            total = np.zeros((len(used), right.shape[1]))
            np.add.at(total, where, row)
            return pa.table({"col": used, "row": pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), right.shape[1]).cast(pa.list_(pa.float64()))})

        parts = spread.mapInArrow(partial, "col bigint, row array<double>")
        out = np.zeros_like(right)
        for r in parts.groupBy(F.pmod("col", F.lit(64))).applyInArrow(added, "col bigint, row array<double>").collect():
            out[r["col"]] += np.array(r["row"])
        return out

    q, _ = np.linalg.qr(product(right))
    again = product(q)
    values, vectors = np.linalg.eigh((q.T @ again + again.T @ q) / 2)
    order = np.argsort(values)[::-1][:rank]
    basis = (q @ vectors[:, order[values[order] > NO_WEIGHT * values[order[0]]]]).astype(np.float32)
    latent, keys, weights = np.zeros((len(passages), basis.shape[1]), np.float32), [], []
    for k, words in enumerate(passages):
        f, times = np.unique(feature_of(words), return_counts=True)
        own = idf[f] * times
        own /= max(float(np.sqrt((own ** 2).sum())), 1e-12)
        projected = own @ basis[column[f]]
        latent[k] = projected / max(float(np.sqrt((projected ** 2).sum())), 1e-12)
        keys.append(k * FEATURES + f)
        weights.append(own)
    return Space(passages, item, closing, window, column, basis, latent, np.concatenate(keys), np.concatenate(weights))


def near_passages(space: Space, column: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, passage) of all pairs with a latent cosine of at least ``NEAR``, for windows of columns and weights."""
    projected = np.einsum("ij,ijk->ik", weight, space.basis[column])
    projected /= np.maximum(np.sqrt((projected ** 2).sum(axis=1, keepdims=True)), 1e-12)
    rows, passages = [], []
    for at in range(0, len(space.latent), 4096):
        row, passage = np.nonzero(projected @ space.latent[at:at + 4096].T >= NEAR)
        rows.append(row)
        passages.append(passage + at)
    return np.concatenate(rows), np.concatenate(passages)


def products(space: Space, passage: np.ndarray, f: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Product of each window's features and weights with the unit vector of its passage."""
    keys = passage[:, None] * FEATURES + f
    at = np.minimum(np.searchsorted(space.keys, keys), len(space.keys) - 1)
    return (np.where(space.keys[at] == keys, space.weights[at], 0) * weight).sum(axis=1)


def candidates(text: Words, spaces: list[Space], idf: np.ndarray) -> dict[tuple[int, int, int], list[tuple[float, int]]]:
    """(text, space, passage) -> (cosine, start in the text) of all its windows at or above ``MIN_COSINE``, best first."""
    found: dict[tuple[int, int, int], list[tuple[float, int]]] = {}
    if not len(text.terms) or not spaces:
        return found
    f, stops = feature_of(text.terms), text.stops()
    weight, number = idf[f], np.diff(text.first)
    all_pairs = repeats(f, max(space.window for space in spaces), stops)
    for b, space in enumerate(spaces):
        size, step = space.window, space.window // 4
        last = np.maximum(number - size, 0)
        many = np.where(number > 0, -(-last // step) + 1, 0)  # windows of a text: one every step, and the last one
        owner = np.repeat(np.arange(len(number)), many)
        starts = text.first[owner] + np.minimum((np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * step, last[owner])
        ends = np.minimum(starts + size, text.first[owner + 1])
        close = all_pairs[1] - all_pairs[0] < size
        pairs = all_pairs[0][close], all_pairs[1][close]
        firsts = np.maximum(pairs[1] - size + 1, text.first[np.searchsorted(text.first, pairs[0], "right") - 1])
        norm2 = np.maximum(window_norms(weight ** 2, pairs, starts, size, firsts, ends), 1e-12)
        column = space.column[f]
        inside = column >= 0
        own = window_norms(np.where(inside, weight ** 2, 0), pairs, starts, size, firsts, ends)
        near = np.flatnonzero(own >= MIN_COSINE ** 2 * norm2 * (1 - 1e-6))
        for part in (near[i:i + STEP] for i in range(0, len(near), STEP)):
            at = starts[part][:, None] + np.arange(size)
            known = at < ends[part][:, None]
            at = np.minimum(at, len(f) - 1)
            known &= inside[at]
            w = np.where(known, weight[at], 0).astype(np.float32)
            rows, passages = near_passages(space, np.where(known, column[at], 0), w)
            for i in range(0, len(rows), PAIRS):
                row, passage = rows[i:i + PAIRS], passages[i:i + PAIRS]
                cosine = products(space, passage, f[at[row]], w[row]) / np.sqrt(norm2[part[row]])
                for j in np.flatnonzero(cosine >= MIN_COSINE).tolist():
                    window = part[row[j]]
                    k = int(owner[window])
                    found.setdefault((k, b, int(passage[j])), []).append((float(cosine[j]), int(starts[window] - text.first[k])))
    return {key: sorted(own, key=lambda x: (-x[0], x[1])) for key, own in found.items()}


def common_words(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence; the item's words are the bits of one number."""
    places: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << k
    free = everything = (1 << len(item)) - 1
    for w in text.tolist():
        hit = free & places.get(w, 0)
        if hit:
            free = ((free + hit) | (free - hit)) & everything
    return len(item) - free.bit_count()


def leak(item: np.ndarray, words: np.ndarray, windows: list[tuple[float, int]], size: int, closing: bool = True) -> tuple[float, float, bool] | None:
    """(cosine, share of the item or passage in common order, answer present) of the first window whose surrounding text holds
    it. A passage that is not the closing one has no answer."""
    hits = np.flatnonzero(np.isin(words, item))  # other words are in no common subsequence
    tried = set()
    for cosine, start in windows:
        low, high = np.searchsorted(hits, (start - len(item), start + size + len(item))).tolist()
        if high - low < PARAPHRASE_SHARE * len(item) or (low, high) in tried:
            continue
        tried.add((low, high))
        near = words[hits[low:high]]
        share = common_words(item, near) / len(item)
        answer = closing and bool(np.isin(item[-ANSWER_WORDS:], near).mean() >= ANSWER_SHARE)
        if share >= COPY_SHARE or share >= PARAPHRASE_SHARE and answer:
            return cosine, share, answer
    return None


def leaks_of(text: Words, spaces: list[Space], items: list[tuple[object, Words]], runs: Runs, idf: np.ndarray) -> dict[int, dict[int, tuple[float, float, bool]]]:
    """text -> item -> (cosine, share, answer present) of the items found in the texts."""
    copied = runs.of(text)
    found: dict[int, dict[int, tuple[float, float, bool]]] = {}
    parted: dict[tuple[int, int], tuple[int, list[tuple[float, int]]]] = {}
    for (t, b, p), own in candidates(text, spaces, idf).items():
        space, k = spaces[b], int(spaces[b].item[p])
        if k in copied.get(t, ()):
            continue
        terms = text.terms[text.first[t]:text.first[t + 1]]
        one = leak(space.passages[p], terms, own, space.window, bool(space.closing[p]))
        if one and one > found.get(t, {}).get(k, ()):
            found.setdefault(t, {})[k] = one
        if len(space.passages[p]) < len(items[k][1].terms):
            parted.setdefault((t, k), (space.window, []))[1].extend(own)
    for (t, k), (window, own) in parted.items():
        if k not in found.get(t, ()):
            one = leak(items[k][1].terms, text.terms[text.first[t]:text.first[t + 1]], sorted(own, key=lambda x: (-x[0], x[1])), window)
            if one:
                found.setdefault(t, {})[k] = one
    for t, own in copied.items():
        found.setdefault(t, {}).update({k: (1.0, 1.0, closing) for k, closing in own.items()})
    return found


def search(docs: DataFrame, items: list[tuple[object, Words]], idf: np.ndarray, schema: str) -> DataFrame:
    """The items found in all documents; the benchmark's part, its spaces and one number for each feature reach the tasks."""
    model = docs.sparkSession.sparkContext.broadcast((spaces_of(items, docs, idf), items, Runs(items), idf))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces, items, runs, idf = model.value
        for batch in batches:
            out, before = [[] for _ in range(5)], 0
            for texts in chunks(t.as_py() for t in batch.column("text")):
                for k, own in sorted(leaks_of(words_of(*texts), spaces, items, runs, idf).items()):
                    for item, found in sorted(own.items()):
                        for column, value in zip(out, (batch.column("doc_id")[before + k].as_py(), items[item][0], *found)):
                            column.append(value)
                before += len(texts)
            types = [batch.schema.field("doc_id").type, pa.array([i for i, _ in items]).type, pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "item_id", "cosine", "common_share", "answer_found"])

    return docs.select("doc_id", "text").mapInArrow(look, schema)


def find(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, item_id, cosine, common_share and answer_found: a row for each item found in a document."""
    id_type, item_type = (t.select(c).schema.fields[0].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {id_type}, item_id {item_type}, cosine double, common_share double, answer_found boolean"
    own = benchmark.select("item_id", "text").filter("text is not null")
    parts = -(-(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes)
    idf, found = None, []
    for part in range(parts):
        rows = own.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).collect()
        items = [(r["item_id"], w) for r in rows if len((w := words_of(r["text"])).words)]
        if items:
            if idf is None:
                df, total = document_counts(docs)
                idf = np.log((total + 1) / (df + 1)) + 0.05
            found.append(search(docs, items, idf, schema))
    return functools.reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item was found, with all their columns. Rows without an id are judged by their text, too."""
    # rows are told apart by id and text, as a row number would not be stable behind a shuffle
    key = free_name(docs, "key")
    marked = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = find(marked.select(F.col(key).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(key)).distinct()
    return marked.join(found, key, "left_anti").drop(key)
