"""Query of the Merkle manifest, with the SQL that checks it: trees of up to five levels as lists, CRC-32 by its shift register."""

from batchwatch.llm import merkle
from batchwatch.llm.common import table


def op12_merkle_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


def framed(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


def leaf(text: str) -> str:
    return "sha256(" + " || ".join(framed(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


LEVELS = 5


def levels(first: str) -> str:
    """The lists l0 ... l5 of a tree; a level above the root repeats it."""
    def up(k: int) -> str:
        return f"CASE WHEN len(l{k}) > 1 THEN list_transform(range(0, len(l{k}), 16), lambda i: sha256(array_to_string(l{k}[i + 1:i + 16], ''))) ELSE l{k} END"
    out = f"SELECT *, {first} AS l0"
    for k in range(LEVELS):
        out = f"SELECT *, {up(k)} AS l{k + 1} FROM ({out}"
    return out


def around(k: int, place: str) -> tuple[str, str]:
    """Siblings before and after the ancestor of ``place`` on level k."""
    p = f"({place} // {16 ** k})"
    return f"array_to_string(l{k}[16 * ({p} // 16) + 1:{p}], '')", f"array_to_string(l{k}[{p} + 2:16 * ({p} // 16) + 16], '')"


def steps(start: str, place: str, table: str, out: str) -> str:
    """The root that follows from ``start`` and the siblings, one nested select for each level."""
    sql = f"SELECT *, {start} AS {out}0 FROM {table}"
    for k in range(LEVELS):
        left, right = around(k, place)
        sql = f"SELECT *, CASE WHEN len(l{k}) > 1 THEN sha256({left} || {out}{k} || {right}) ELSE {out}{k} END AS {out}{k + 1} FROM ({sql})"
    return sql


SIBLINGS = " || ".join(part for k in range(LEVELS) for part in around(k, "{place}"))
SOURCE_LISTS = levels("v") + " FROM (SELECT source, list(leaf ORDER BY doc_id NULLS FIRST, leaf) AS v FROM d GROUP BY source)" + ")" * LEVELS
ALL_LISTS = levels("v") + " FROM (SELECT list(subroot ORDER BY source NULLS FIRST) AS v FROM s)" + ")" * LEVELS
ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, {leaf('text')} AS leaf,
    CASE WHEN xor(list_reduce(
      list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))
    ), 4294967295::UBIGINT) % 5 = 0
    THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {leaf('text')} END AS other
  FROM documents
),
t AS ({SOURCE_LISTS}),
s AS (SELECT source, l{LEVELS}[1] AS subroot FROM t),
a AS (SELECT l0, l1, l2, l3, l4, l5 FROM ({ALL_LISTS})),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
low AS (
  SELECT doc_id, source, leaf, place, l{LEVELS}[1] AS subroot, {SIBLINGS.replace('{place}', 'place')} AS siblings, f{LEVELS} AS folded
  FROM ({steps('other', 'place', '(SELECT p.*, l0, l1, l2, l3, l4, l5 FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)', 'f')})
),
o AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS home FROM s),
high AS (
  SELECT *, l{LEVELS}[1] AS root, siblings || {SIBLINGS.replace('{place}', 'home')} AS whole
  FROM ({steps('folded', 'home', '(SELECT low.*, home, a.* FROM low JOIN o ON low.source IS NOT DISTINCT FROM o.source, a)', 'g')})
)
SELECT doc_id, leaf, subroot, root, sha256(whole) AS proof_sha256, g{LEVELS} AS folded_root, g{LEVELS} = root AS verified FROM high
"""
QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLES = {"op12_merkle_manifest": ORACLE}
