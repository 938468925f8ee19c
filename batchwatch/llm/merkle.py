"""Merkle manifest of a table, by time-forward processing: digests travel up the tree in label order, proofs travel back down.

A tree has ``FAN`` children a node; every ``FAN`` consecutive nodes of a level (the last run fewer, even one) have a parent while more
than one node remains. Spark's sort is the external priority queue between tasks: it delivers the nodes of each subtree of ``FAN^HEIGHT``
leaves, in label order, to one task. Inside a task a heap ordered by node label delivers child digests to their parents, and
holds at most ``FAN`` messages a level. The tops of the subtrees are the leaves of the next round, so n leaves take log(n) / log(4096) rounds
and a large source is many subtrees.

The reversed sweep starts at the root: parents come before their children, and each node hands its children the siblings on the way
up, so that a leaf has its whole proof when the sweep reaches it. Proofs exist inside tasks only, one path at a time for each open level;
a table holds them only for the tops of subtrees, one in 4,096 leaves.

Places of leaves are numbered in (source, doc_id) order by a range sort that is written once: the place is the row number in the sorted
part plus the totals of the parts before it. No group is in one task.

Defined cases: null and repeated ids, null sources and null texts are leaves like any other (null ids first; equal ids in the order of their
leaves); an empty table has no leaves; a lone leaf is its own root, with an empty proof; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from batchwatch.llm.common import written

FAN = 16
#: Levels that a task folds at once: subtrees of 4,096 leaves.
HEIGHT = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value: Column) -> Column:
    """``-`` for null, else the byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(text: Column) -> Column:
    return F.sha2(F.concat(*[framed(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], framed(text)).cast("binary"), 256)


def leaves_of(docs: DataFrame) -> DataFrame:
    """source, doc_id, leaf, and the leaf after tampering (null where nothing changed)."""
    lowered = F.translate("text", UPPER, LOWER)
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0) & F.col("text").rlike("[A-Z]")
    return docs.select("source", "doc_id", leaf_hash(F.col("text")).alias("leaf"), F.when(hit, leaf_hash(lowered)).alias("other"))


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``place`` (from 0, in the order of ``order`` within ``group``) and ``n``, the size of the group."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    stamped = rows.withColumn("_tie", F.monotonically_increasing_id())  # deals out rows that are equal in every column
    parts = stamped.repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    parts = written(parts.withColumn("_row", F.monotonically_increasing_id()), name)
    part = F.shiftright("_row", 33)
    sizes = parts.groupBy(F.col(group).alias("_g"), part.alias("_part")).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_m"))
    by_group = Window.partitionBy("_g")  # a row for each part of the sort and group
    before = F.sum("_m").over(by_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_m")
    starts = written(sizes.select("_g", "_part", "_first", before.alias("_before"), F.sum("_m").over(by_group).alias("n")), f"{name}-starts")
    same = parts[group].eqNullSafe(starts["_g"]) & (part == starts["_part"])
    return parts.join(starts, same).withColumn("place", F.col("_row") - F.col("_first") + F.col("_before")).drop("_row", "_g", "_part", "_first", "_before")


class Queue:
    """Messages to the nodes of one subtree, delivered in label order: (last leaf below the node, level)."""

    def __init__(self, size: int, height: int):
        self.size, self.height, self.heap = size, height, []

    def send(self, level: int, index: int, value: str) -> None:
        """To the parent of a node."""
        up, parent = level + 1, index // FAN
        last = min((parent + 1) * FAN**up, self.size) - 1
        heapq.heappush(self.heap, (last, up, parent, index, value))

    def take(self, leaf: int) -> Iterator[tuple[int, int, str]]:
        """The nodes whose children have all been sent once ``leaf`` has."""
        while self.heap and self.heap[0][0] <= leaf:
            last, level, index = self.heap[0][:3]
            children = []
            while self.heap and self.heap[0][:3] == (last, level, index):
                children.append(heapq.heappop(self.heap)[4])
            value = digest(*children)
            if level < self.height:
                self.send(level, index, value)
            yield level, index, value


def height_of(n: int) -> int:
    """Levels above ``n`` leaves."""
    height = 0
    while n > 1:
        n, height = -(-n // FAN), height + 1
    return height


def swept(nodes: DataFrame, height: int) -> DataFrame:
    """(g, chunk, n, level, place, value, top): the nodes above ``nodes`` (g, place, n, value) within subtrees of ``height`` levels; of a group
    of one node that node itself."""
    span = FAN**height

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, at = None, None
        for batch in batches:
            out: list[tuple] = []
            for g, chunk, n, place, value in zip(*(batch.column(c).to_pylist() for c in ("g", "chunk", "n", "place", "value"))):
                if at != (g, chunk):
                    at, queue = (g, chunk), Queue(min(span, n - chunk * span), height if n > span else height_of(n))
                leaf = place - chunk * span
                if queue.height:
                    queue.send(0, leaf, value)
                    out.extend((g, chunk, n, level, index, v, level == queue.height) for level, index, v in queue.take(leaf))
                else:
                    out.append((g, chunk, n, 0, leaf, value, True))
            if out:
                types = pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["g", "chunk", "n", "level", "place", "value", "top"])

    placed = nodes.select("g", F.expr(f"place div {span}").alias("chunk"), "n", "place", "value")
    sorted_rows = placed.repartition("g", "chunk").sortWithinPartitions("g", "chunk", "place")
    return sorted_rows.mapInArrow(rows, "g string, chunk bigint, n bigint, level int, place bigint, value string, top boolean")


def folded(leaves: DataFrame, height: int, name: str) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """The rounds (leaves of the round, nodes above them) and the root (g, value) of each group."""
    rounds, roots, todo, span = [], None, leaves, FAN**height
    while True:
        nodes = written(swept(todo, height), f"{name}-{len(rounds)}")
        rounds.append((todo, nodes))
        tops = nodes.filter("top")
        done = tops.filter(F.col("n") <= span).select("g", "value")
        roots = done if roots is None else roots.union(done)
        todo = tops.filter(F.col("n") > span).select("g", F.col("chunk").alias("place"), F.ceil(F.col("n") / span).alias("n"), "value")
        if todo.isEmpty():
            return rounds, roots


PATH = "array<struct<left: string, right: string>>"
HEADER = 99  # level of the rows that bring a subtree the path of its top
#: Siblings before and after a node, and the same of its parent; None at the root.
Path = tuple[str, str, "Path"] | None


def linked(path: list[dict]) -> Path:
    out = None
    for step in reversed(path):
        out = step["left"], step["right"], out
    return out


def unlinked(path: Path) -> list[dict]:
    out = []
    while path:
        left, right, path = path
        out.append({"left": left, "right": right})
    return out


def proof(leaf: str, path: Path) -> tuple[str, str]:
    """Hash of the siblings up to the root, and the root that follows from ``leaf`` and them."""
    siblings = []
    while path:
        left, right, path = path
        siblings += left, right
        leaf = digest(left, leaf, right)
    return digest(*siblings), leaf


def delivered(todo: DataFrame, nodes: DataFrame, headers: DataFrame, height: int, to_documents: bool) -> DataFrame:
    """The reversed sweep over one round: ``headers`` (g, chunk, path, subroot, root) come down to the leaves of each subtree.

    The result holds (doc_id, leaf, subroot, root, proof_sha256, folded_root), or else the headers of the round below."""
    span, id_type = FAN**height, dict(todo.dtypes).get("doc_id", "bigint")
    empty = {"n": "bigint", "doc_id": id_type, "other": "string", "path": PATH, "subroot": "string", "root": "string"}
    chunk, index = F.expr(f"place div {span}").alias("chunk"), F.expr(f"place % {span}").alias("index")

    def shaped(df: DataFrame, *columns: Column | str) -> DataFrame:
        df = df.select(*columns)
        return df.select("g", "chunk", "level", "index", "value", *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in empty.items()])

    leaf = shaped(todo, "g", chunk, F.lit(0).alias("level"), index, "value", "n", *(["doc_id", "other"] if to_documents else []))
    node = shaped(nodes.filter("not top"), "g", "chunk", "level", F.col("place").alias("index"), "value", "n")
    head = shaped(headers, "g", "chunk", F.lit(HEADER).alias("level"), F.lit(0).cast("bigint").alias("index"), F.lit("").alias("value"), "path", "subroot", "root")
    found = (
        f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string" if to_documents
        else f"g string, chunk bigint, path {PATH}, subroot string, root string"
    )
    schema = to_arrow_schema(StructType.fromDDL(found))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, top, paths, run = None, None, {}, []

        def handed_down() -> Iterator[tuple]:
            """Gives the path of their parent to the siblings in ``run``."""
            level, parent = run[0][0], run[0][1] // FAN
            above = paths.pop((level + 1, parent), top[0])  # the top itself is not among the rows
            values = [r[2] for r in run]
            for k, (_, index, value, n, doc_id, other) in enumerate(run):
                path = above if n == 1 else ("".join(values[:k]), "".join(values[k + 1:]), above)
                if level:
                    paths[level, index] = path
                elif to_documents:
                    yield (doc_id, value, *top[1:], *proof(other or value, path))
                else:
                    yield (*at[:1], at[1] * span + index, unlinked(path), *top[1:])
            run.clear()

        def packed(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        names = "g", "chunk", "level", "index", "value", "n", "doc_id", "other", "path", "subroot", "root"
        for batch in batches:
            out: list[tuple] = []
            for g, chunk, level, index, value, n, doc_id, other, path, subroot, root in zip(*(batch.column(c).to_pylist() for c in names)):
                if run and (at != (g, chunk) or run[0][0] != level or run[0][1] // FAN != index // FAN):
                    out += handed_down()
                if level == HEADER:
                    at, top, paths = (g, chunk), (linked(path), subroot, root), {}
                else:
                    run.append((level, index, value, n, doc_id, other))
            if out:
                yield packed(out)
        if run and (out := list(handed_down())):
            yield packed(out)

    ordered = head.union(leaf).union(node).repartition("g", "chunk").sortWithinPartitions("g", "chunk", F.col("level").desc(), "index")
    return ordered.mapInArrow(rows, found)


def unfolded(rounds: list[tuple[DataFrame, DataFrame]], tops: DataFrame, height: int, to_documents: bool, name: str) -> DataFrame:
    """Sends the headers of the groups' tops (g, path, subroot, root) down all rounds. A group enters in the round in which it was folded
    to its root; below that it is met through its subtrees."""
    below = None
    for k in range(len(rounds) - 1, -1, -1):
        todo, nodes = rounds[k]
        ended = nodes.filter(F.col("top") & (F.col("n") <= FAN**height)).select(F.col("g").alias("_g"))
        entering = tops.join(ended, F.col("g").eqNullSafe(F.col("_g")), "left_semi").select("g", F.lit(0).cast("bigint").alias("chunk"), "path", "subroot", "root")
        headers = entering if below is None else entering.union(below)
        below = delivered(todo, nodes, headers, height, to_documents and k == 0)
        if k:
            below = written(below, f"{name}-{k}")
    return below


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot (root of the source), root, proof_sha256, folded_root and verified of each row of ``docs``."""
    leaves = numbered(written(leaves_of(docs), "leaves"), "source", ["doc_id", "leaf"], "placed")
    leaves = leaves.select(F.col("source").alias("g"), "place", "n", F.col("leaf").alias("value"), "doc_id", "other")
    rounds, roots = folded(leaves, height, "sources")
    sources = written(roots, "subroots")
    ordered = numbered(sources.select(F.lit("").alias("all"), "g", "value"), "all", ["g"], "sources-placed")
    upper, root = folded(ordered.select(F.col("all").alias("g"), "place", "n", "value"), height, "dataset")
    start = root.select("g", F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("value").alias("root"))
    paths = unfolded(upper, start, height, False, "dataset-paths").withColumnRenamed("chunk", "place")
    tops = ordered.join(paths.drop("g", "subroot"), "place").select("g", "path", F.col("value").alias("subroot"), "root")
    proved = unfolded(rounds, written(tops, "source-paths"), height, True, "source-paths")
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))
