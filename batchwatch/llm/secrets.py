"""Secret scan with one combined deterministic automaton.

All rules are compiled (subset construction, then minimisation) into a single transition array. One pass over the bytes of
a text, from its end to its start, reports every place where a match of some rule starts. From the leftmost such place the
rule's own small automaton runs forward to the longest end, so spans are leftmost, longest and do not overlap within a rule.
Work is linear in the bytes of a text and needs no shuffle.

Defined cases: a null or empty text has no spans; rows are independent, so repeated rows give repeated results; an empty table
gives an empty result; other columns are neither read nor changed.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchwatch.llm.automaton import compile_dfa


@dataclass(frozen=True)
class Rule:
    """``min_tail`` counts the bytes from where the regex first matches, e.g. those of a value behind ``key =``."""

    kind: str
    pattern: str
    ignore_case: bool = False
    min_bytes: int = 1
    min_tail: int = 1
    #: What may follow the pattern and then belongs to the span; it has no part in where matches start.
    rest: str = ""


#: Rest of a private key: up to its END line, or where that is missing the base64 lines (line breaks may be written as \\n), the last
#: of them short, behind the two fields of encrypted keys.
_TO_END = r"(?:-?-?-?-?[^-])*-----END [A-Z ]*PRIVATE KEY-----"
_BREAK = r"(?:[\x20\t]*(?:\r|\n|\\r|\\n)[\x20\t]*)+"
_LINES = rf"(?:{_BREAK}(?:Proc-Type|DEK-Info): [A-Za-z0-9,\x20-]*)*(?:(?:{_BREAK}|[\x20\t]*)[A-Za-z0-9+/=]{{20,}})+(?:{_BREAK}[A-Za-z0-9+/=]{{1,19}})?"
#: Kinds and patterns (fixed values). The first three are the base rules.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, min_tail=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", min_bytes=40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", min_bytes=30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", rest=rf"(?:{_TO_END}|{_LINES})?"),
)
BASE_KINDS = ("assign", "access", "hex")
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SPANS_DDL = "array<struct<kind:string,start:bigint,end:bigint>>"


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.scan = compile_dfa([(r.pattern, r.ignore_case) for r in rules], backwards=True)
        self.each = [compile_dfa([(r.pattern + r.rest, r.ignore_case)], backwards=False) for r in rules]

    def starts(self, data: bytes) -> list[tuple[int, int]]:
        """(position, state) of all match starts, from the last to the first."""
        table, accepting, state, last = self.scan.table, self.scan.accepting, self.scan.first, len(data) - 1
        found = []
        for i, c in enumerate(data.translate(self.scan.class_of)[::-1]):
            state = table[state + c]
            if state >= accepting:
                found.append((last - i, state))
        return found

    def longest(self, rule: int, data: bytes, start: int) -> tuple[int, int]:
        """End of the longest match from ``start`` and the end of the shortest one."""
        dfa, state, first, end = self.each[rule], self.each[rule].first, -1, -1
        for i in range(start, len(data)):
            state = dfa.table[state + dfa.class_of[data[i]]]
            if state == dfa.dead:
                break
            if state >= dfa.accepting:
                end = i + 1
                first = end if first < 0 else first
        return end, first

    def spans(self, text: str | None) -> list[dict]:
        """Spans in code points, ordered by start, then by the order of the rules."""
        data = (text or "").encode("utf-8", "surrogatepass")
        found, done = [], [0] * len(self.rules)
        for start, state in reversed(self.starts(data)):
            for k in self.scan.marks[state // self.scan.classes]:
                if start < done[k]:
                    continue
                done[k], first = self.longest(k, data, start)
                if done[k] - start >= self.rules[k].min_bytes and done[k] - first + 1 >= self.rules[k].min_tail:
                    found.append((start, k, done[k]))
        found.sort()
        plain = len(data) == len(text or "")
        points = None if plain or not found else np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80, dtype=np.int32)  # code points up to each byte, itself included
        at = (lambda i: i) if plain else (lambda i: int(points[i - 1]) if i else 0)
        return [{"kind": self.rules[k].kind, "start": at(s), "end": at(e)} for s, k, e in found]


@functools.lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once in each Python worker."""
    return Scanner(rules)


def spans_of(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Array of (kind, start, end) with ends exclusive, for a text column."""

    @F.arrow_udf(SPANS_DDL)
    def scan(texts: pa.Array) -> pa.Array:
        own = scanner(rules)
        return pa.array((own.spans(t.as_py()) for t in texts), type=SPANS)

    return scan(text)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and its spans, one row for each row of ``docs``."""
    return docs.select("doc_id", spans_of(F.col("text"), rules).alias("spans"))


def redacted(text: str | None, spans: list[dict]) -> str | None:
    """The text with every maximal run of secret characters replaced by the kind that starts it."""
    if not spans:
        return text
    out, end = [], 0
    for s in spans:
        if s["start"] >= end:
            out += [text[end:s["start"]], f"[{s['kind'].upper()}]"]
        end = max(end, s["end"])
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced; all other columns and rows stay. Null texts stay null."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        own = scanner(rules)
        return pa.array((redacted(t, own.spans(t)) for t in (x.as_py() for x in texts)), type=pa.string())

    return docs.withColumn("text", clean(F.col("text")))


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans that :func:`scan` returns."""
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id", *map(count, BASE_KINDS), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )
