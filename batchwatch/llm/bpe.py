"""Byte-level BPE by a tokenization automaton.

The automaton's states are the tokens just read; an arc ``x -> y`` exists where ``y`` may stand right behind ``x`` in a correct
tokenization. It starts as one state with a loop for each byte, all bytes may follow each other, and every merge adds its gadget in
turn. The gadget of (u, v) -> w takes the arc v away behind u and adds arcs w that lead from every state with an arc u to where u v
led. So an arc of w is an arc of its half at the time of the merge, and :meth:`MergeAutomaton.arc` replays the gadgets from the last
one back. Arcs are entered into a table when first met: all of them would be |V|^2.

A word is encoded by walking the tokens' tree and those arcs from token to token until its bytes are spelled; the words of some texts
are counted first, so that each is looked up once. Arcs and word cache are emptied at a fixed size, which changes no result.
Decoding emits the byte label of each arc: the labels of a batch are gathered in one step and cut at the ends of its texts.

Defined cases: a null or empty text has no tokens and decodes to an empty text. Texts are independent, so repeated rows, an empty
table and other columns need no care. Special tokens in a text are taken whole, as the tokenizers library does by default.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchwatch.llm.common import runs_of

#: Most entries of the word cache and of the arc table (some 60 MB), the longest word that is cached, and the characters that are split
#: into words at once (a longer text is split alone).
MOST_WORDS, MOST_ARCS, LONGEST_CACHED, CHUNK = 200_000, 200_000, 40, 500_000
#: Text bytes that are encoded and decoded at a time, so that a worker holds one batch of texts and little more.
PIECE = 2 << 20
NEVER = 1 << 40


def pre_split(engine, letters: str, digits: str, spaces: str):
    """Pre-split of the published byte-level vocabulary (fixed value) for given classes of characters."""
    return engine.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{spaces}{letters}{digits}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


#: The second one is for ASCII texts, where the plain engine is faster.
UNICODE_WORDS = pre_split(regex, r"\p{L}", r"\p{N}", r"\p{White_Space}")
ASCII_WORDS = pre_split(re, "A-Za-z", "0-9", r"\x09-\x0d\x20")


def words(text: str) -> list[str]:
    return (ASCII_WORDS if text.isascii() else UNICODE_WORDS).findall(text)


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in published byte-level vocabularies: itself, or the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class MergeAutomaton:
    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        size = max(vocab.values()) + 1
        self.id_of = vocab
        self.made = [-1] * size  # the merge that made a token; -1 for bytes
        self.left, self.right = [0] * size, [0] * size
        self.merge: dict[int, int] = {}
        for rank, (u, v) in enumerate(merges):  # a gadget each
            w, u, v = vocab[u + v], vocab[u], vocab[v]
            self.merge.setdefault(u << 32 | v, rank)
            if self.made[w] < 0:
                self.made[w], self.left[w], self.right[w] = rank, u, v
        self.length, self.longest = [0] * size, max(map(len, vocab))
        self.next: dict[int, int] = {}  # the tokens' bytes as a tree: node * 256 + byte -> node
        self.token = [-1]
        for label, k in vocab.items():
            self.length[k], node = len(label), 0
            for byte in label:
                node = self.next.setdefault(node << 8 | byte, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
            self.token[node] = k
        self.arcs: dict[int, bool] = {}

    def arc(self, x: int, y: int) -> bool:
        key = x << 32 | y
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= MOST_ARCS:
                self.arcs.clear()
            known = self.arcs[key] = self._arc(x, y)
        return known

    def _arc(self, x: int, y: int) -> bool:
        before = NEVER
        while True:
            if self.merge.get(x << 32 | y, NEVER) < before:
                return False
            if self.made[x] < 0 and self.made[y] < 0:
                return True
            if self.made[y] >= self.made[x]:
                before, y = self.made[y] + 1, self.left[y]
            else:
                before, x = self.made[x], self.right[x]

    def encode(self, word: bytes) -> tuple[int, ...]:
        """The one path that spells ``word``: the longest token with an arc is taken, and taken back where no arc leads
        on. Bytes up to a place have one path only, so a place that was left once is never entered again."""
        path: list[int] = []
        at, size, limit, left = 0, len(word), len(word), set()
        step, token_at, length, longest, arcs = self.next.get, self.token, self.length, self.longest, self.arcs.get
        while at < size:
            node, options = 0, []
            for byte in word[at:min(limit, at + longest)]:
                node = step(node << 8 | byte)
                if node is None:
                    break
                if token_at[node] >= 0:
                    options.append(token_at[node])
            before = path[-1] << 32 if path else -1
            for token in reversed(options):
                if left and at + length[token] in left:
                    continue
                if before < 0:
                    break
                known = arcs(before | token)
                if known or known is None and self.arc(path[-1], token):
                    break
            else:
                if not path:
                    raise ValueError("a byte is not in the vocabulary")
                left.add(at)
                limit = at - 1
                at -= length[path.pop()]
                continue
            path.append(token)
            at += length[token]
            limit = size
        return tuple(path)


class Codec(dict):
    """Encodes and decodes texts; as a dict, the tokens of the words met lately."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, model = byte_letters(), spec["model"]
        to_bytes = lambda token: bytes(map(letters.__getitem__, token))
        vocab = {to_bytes(token): k for token, k in model["vocab"].items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = MergeAutomaton(vocab, [(to_bytes(u), to_bytes(v)) for u, v in pairs])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.labels = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for label, k in chain(vocab.items(), ((s.encode(), k) for s, k in self.special.items())):
            self.labels[k] = label
        self.before: dict[str, tuple[int, ...]] = {}
        self.arc_labels = pa.array(self.labels, pa.binary())

    def __missing__(self, word: str) -> tuple[int, ...]:
        if word in self.special:  # no word of the texts between special tokens is one
            return (self.special[word],)
        ids = self.before.get(word)
        if ids is not None:
            self.keep(word, ids)
            return ids
        ids = self.automaton.encode(word.encode("utf-8", "surrogatepass"))
        if len(word) <= LONGEST_CACHED:
            self.keep(word, ids)
        return ids

    def keep(self, word: str, ids: tuple[int, ...]) -> None:
        """Words met since the cache was last full stay for another round, so frequent words are not lost with the rare ones."""
        if len(self) >= MOST_WORDS // 2:
            self.before = dict(self)
            self.clear()
        self[word] = ids

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if not self.split or not any(s in text for s in self.special):
            return words(text)
        return [w for p in self.split.split(text) for w in ([p] if p in self.special else words(p))]

    def _encode(self, found: list[str], numbers: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of some texts, and the number of ids of each text (of ``numbers`` words)."""
        coded = pa.array(found, pa.string()).dictionary_encode()
        tokens = [self[w] for w in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter(chain.from_iterable(tokens), np.int32, int(sizes.sum()))
        at = coded.indices.to_numpy()
        n = sizes[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        starts = (np.cumsum(sizes) - sizes)[at]
        ids = flat[np.repeat(starts - ends[:-1], n) + np.arange(ends[-1])]
        return ids, np.diff(ends[np.cumsum([0, *numbers])])

    def encode_all(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each text begin and the last ones end."""
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        found: list[str] = []
        numbers: list[int] = []
        held = 0
        for text in texts:
            own = self.words(text)
            found += own
            numbers.append(len(own))
            held += len(text or "")
            if held >= CHUNK:
                for out, part in zip((ids, sizes), self._encode(found, numbers)):
                    out.append(part)
                found, numbers, held = [], [], 0
        for out, part in zip((ids, sizes), self._encode(found, numbers)):
            out.append(part)
        return np.concatenate(ids), np.cumsum(np.concatenate(sizes))

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts of ids cut at ``bounds``; broken UTF-8 becomes U+FFFD."""
        labels = self.arc_labels.take(pa.array(ids, pa.int32()))
        ends = np.frombuffer(labels.buffers()[1], np.int32)[:len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        data = labels.buffers()[2] if len(ids) else pa.py_buffer(b"")
        texts = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends[bounds].astype(np.int32)), data])
        try:
            return texts.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array((t.decode("utf-8", "replace") for t in texts.to_pylist()), type=pa.string())

    def decode(self, ids: list[int] | None) -> str:
        return self.decode_all(np.array(ids or [], np.int32), np.array([0, len(ids or [])]))[0].as_py()


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """Compiled once in each Python worker."""
    return Codec(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(text: Column, path: str | None = None) -> Column:
    """Array of token ids of a text column. ``path``: a vocabulary file that every executor has."""
    path = path or default_path()

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return listed(*codec(path).encode_all(t.as_py() for t in texts))

    return encode(text)


def listed(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))


def decoded(ids: Column, path: str | None = None) -> Column:
    """The text of a column of token ids; broken UTF-8 becomes U+FFFD."""
    path = path or default_path()

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        bounds = np.concatenate([[0], np.cumsum(rows.value_lengths().fill_null(0).to_numpy())]).astype(np.int64)
        return codec(path).decode_all(rows.flatten().to_numpy(), bounds)

    return decode(ids)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the text decoded from them, a row for each row of ``docs``. One Python worker a task does both."""
    path = path or default_path()
    id_field = docs.select("doc_id").schema.fields[0].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for start, number in runs_of(batch.column("text"), PIECE):
                part = batch.slice(start, number)
                ids, bounds = own.encode_all(t.as_py() for t in part.column("text"))
                columns = [part.column("doc_id"), listed(ids, bounds), own.decode_all(ids, bounds)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"])
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {id_field}, ids array<int>, decoded string")


def digests(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
