"""Exact Jaccard self-join of documents on word shingles, with adaptive multi-match prefixes.

Equal shingle sets are one node. A partner of a set of n shingles shares at least t = ceil(0.75 n) of them, so among the first
n - t + l shingles of both sets, in any common order, there are at least l common ones (l of the smaller demand).

1. *Alive nodes.* In the order of the hashes, prefixes lengthened by l ~ n / 32 are stored with the nodes and counted by shingle. A node with fewer than l
   shingles that a second node has in its prefix has no partner; most of a corpus ends here.
2. *Prefixes.* The shingles of the alive nodes are ordered by document frequency, rarest first (shingles travel once, as packed
   32-bit parts of their hashes by bucket, and their frequencies back). Each node picks the l that makes its estimated cost lowest: rows to match (sum of the frequencies in the prefix) plus candidates to verify (that sum over l).
3. *Candidates.* Pairs that share a prefix shingle of at most ``HOT`` nodes are joined, counted and verified if they share enough.
   A prefix reaches a hotter shingle only where nearly all of a set is common: these nodes are joined to hubs, and each pair of a hub's
   blocks (of bounded size) is verified in one task, which returns link counts and a spanning forest, never the pairs.
4. *Classes* are the connected components; each document gets its smallest document id and its number of links.

Shingles and nodes are 64-bit hashes of published word hashes: two of N different ones are taken for one with probability of about N^2 / 2^61.

Defined cases: null, empty or blank texts have no set and link with nothing; rows without an id are returned with the class of
their links, or null; repeated rows are copies like any other; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchwatch.llm.common import cut_runs, free_name, runs_of, small_batches, written
from batchwatch.llm.components import connected
from batchwatch.llm.hashing import U, mixed, shingles

WORDS, PERCENT = 5, 75
#: A prefix shingle of more nodes than this is matched through hubs.
HOT = 64
#: Largest block of a hub, in nodes and in shingles.
BLOCK_NODES, BLOCK_TOKENS = 1000, 2_000_000
#: Texts of so many bytes are cut into shingles at once.
TEXT_BYTES = 2_000_000
#: Shingles of one group of a shuffle by shingle, and of one step that fills the groups.
BUCKET_TOKENS, SLICE_TOKENS = 1_000_000, 500_000
#: Frequencies of shingles are counted up to this number.
MOST_DF = 1024
#: Text keys or ids up to this number are sent to all executors (tens of MB); beyond it the join shuffles.
MOST_BROADCAST_IDS = 500_000


def least_overlap(n, percent: int = PERCENT):
    return -(-n * percent // 100)


def node_of(tokens: np.ndarray) -> int:
    """Hash of a set, as a signed long."""
    with np.errstate(over="ignore"):
        return int(mixed(np.array([mixed(tokens).sum() + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def demand(n: int) -> int:
    """The lengthening of the first prefixes."""
    return max(1, n // 32)


def least_demand(n: Column, percent: int) -> Column:
    """The smallest demand of a partner of a set of ``n``, which has at least ``percent`` of its shingles."""
    return F.greatest(F.lit(1), F.floor(F.ceil(n * percent / 100) / 32)).cast("long")


def node_table(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, hash of the text, node (null without words), number of shingles and lengthened prefix in hash order of each row.
    So all texts are cut into shingles once."""
    id_field = docs.select("doc_id").schema.fields[0].dataType.simpleString()

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, number in runs_of(batch.column("text"), TEXT_BYTES):
                part = batch.slice(start, number)
                sets = [shingles(t.as_py(), words) for t in part.column("text")]
                sizes, keys = list(map(len, sets)), [node_of(s) if len(s) else None for s in sets]
                prefixes = [s[:n - least_overlap(n, percent) + demand(n)] if n else s for s, n in zip(sets, sizes)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), _lists(prefixes)],
                    names=["doc_id", "text_key", "node", "n", "prefix"],
                )

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return keyed.mapInArrow(nodes, f"doc_id {id_field}, text_key bigint, node bigint, n bigint, prefix array<bigint>")


def _lists(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))


def _rows(**columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in columns.values()], names=list(columns))


def buckets_for(tokens: int | None) -> int:
    """Number of groups by shingle: of ``BUCKET_TOKENS`` each, and so many that small inputs keep all cores busy."""
    tokens = tokens or 0
    return max(1, -(-tokens // BUCKET_TOKENS), min(64, tokens // 50_000))


def _starts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(x)))


def packed(rows: DataFrame, column: str, buckets: int, most: int) -> DataFrame:
    """The shingles in ``column`` by buckets of their hash, ``SLICE_TOKENS`` of them a step: each row holds nodes, how many shingles of
    each follow and 32 bits of these (``home`` fixes about as many as there are buckets). A shingle that more than ``most`` nodes of a step
    have is sent for ``most`` of them; for the others it is ``done`` and goes anywhere, so that no bucket gets all nodes.
    Two shingles of a bucket may share their 32 bits: they are counted together, which costs candidates but loses none."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, number in cut_runs(pc.list_value_length(batch.column(column)), SLICE_TOKENS):
                part = batch.slice(start, number)
                node, first = np.unique(part.column("node").to_numpy(), return_index=True)
                part = part.take(pa.array(first))
                sizes = pc.list_value_length(part.column(column)).to_numpy()
                n = part.column("n").to_numpy().astype(np.uint32)
                token = part.column(column).flatten().to_numpy().view(np.uint64)
                order = np.argsort(token, kind="stable")
                at, count = _starts(token[order])
                done = np.zeros(len(token), bool)
                done[order[np.arange(len(token)) - np.repeat(at, count) >= most]] = True
                # prefixes hold the low hashes, so the upper bits would not spread them
                home = ((token & U(0xFFFFFFFF)) * U(buckets) >> U(32)).astype(np.int64)
                key, owner = (token >> U(32)).astype(np.uint32), np.repeat(np.arange(len(node)), sizes)
                out: list[tuple] = []
                for over in (False, True):
                    mine = np.flatnonzero(done == over)
                    mine = mine[np.argsort(home[mine].astype(np.int32), kind="stable")]
                    for a, size in zip(*_starts(home[mine])):
                        own = mine[a:a + size]
                        begin, counts = _starts(owner[own])
                        who = owner[own[begin]]
                        place = int(home[own[0]])
                        out.append((
                            (place + int(node[who[0]] % buckets)) % buckets if over else place, place, over, node[who].tobytes(),
                            counts.astype(np.uint32).tobytes(), n[who].tobytes(), key[own].tobytes(),
                        ))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["bucket", "home", "done", "nodes", "counts", "sizes", "keys"])

    return rows.select("node", "n", column).mapInArrow(pack, "bucket bigint, home bigint, done boolean, nodes binary, counts binary, sizes binary, keys binary")


def _joined(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in table.column(column)), kind)


def alive_nodes(nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``nodes`` whose prefix has enough shingles that another node has, too."""
    total = (nodes.agg(F.sum("n")).first()[0] or 0) * (132 - percent) // 128  # a little more than the prefixes hold

    def shared(table: pa.Table) -> pa.Table:
        sent, over = (table.filter(pc.equal(table.column("done"), x)) for x in (False, True))
        node, at = np.unique(_joined(sent, "nodes", np.int64), return_inverse=True)
        pairs = _joined(sent, "keys", np.uint32).astype(np.uint64) << U(32) | np.repeat(at, _joined(sent, "counts", np.uint32)).astype(np.uint64)
        pairs.sort()
        begin, size = _starts(pairs >> U(32))
        different = np.add.reduceat(np.concatenate([[True], pairs[1:] != pairs[:-1]]).astype(np.int64), begin) if len(pairs) else size
        owner = (pairs & U(0xFFFFFFFF)).astype(np.int64)[np.repeat(different > 1, size)]
        k = np.bincount(owner, minlength=len(node))
        some = np.flatnonzero(k)
        return pa.table({
            "node": np.concatenate([node[some], _joined(over, "nodes", np.int64)]),
            "k": np.concatenate([k[some], _joined(over, "counts", np.uint32).astype(np.int64)]),
        })

    # with two nodes of each step, a shingle is known to be shared
    found = packed(nodes, "prefix", buckets_for(total), 2).drop("sizes", "home").groupBy("bucket").applyInArrow(shared, "node bigint, k bigint")
    enough = written(found.groupBy("node").agg(F.sum("k").alias("k")), "shared-shingles")
    return nodes.drop("prefix").join(enough, "node").filter(F.col("k") >= least_demand(F.col("n"), percent)).drop("k")


def alive_sets(docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, copies, n, tokens) of the nodes that may have partners of another node, each once, as a written table."""
    alive = alive_nodes(nodes, percent)
    # a node is fetched by one of its rows, whether or not that has an id
    members = written(alive.groupBy("node").agg(F.min(F.struct("text_key", "doc_id")).alias("f"), F.count(F.lit(1)).alias("copies")), "alive-nodes")
    keys, number = members.select(F.col("f.text_key").alias("k"), F.col("f.doc_id").alias("d"), "copies"), members.count()
    if number <= MOST_BROADCAST_IDS:
        keys = F.broadcast(keys)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, number in runs_of(batch.column("text"), TEXT_BYTES):
                part = batch.slice(start, number)
                found = [shingles(t.as_py(), words) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node_of(s) for s in found], pa.int64()), part.column("copies"), pa.array(list(map(len, found)), pa.int64()), _lists(found)],
                    names=["node", "copies", "n", "tokens"],
                )

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    same = (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))
    own = keyed.join(keys, same).select("text", "copies").mapInArrow(sets, "node bigint, copies bigint, n bigint, tokens array<bigint>")
    found = written(own, "sets")
    # only rows repeated as a whole are fetched more than once; without them the sets need no shuffle
    return found if found.count() == number else written(found.dropDuplicates(["node"]), "sets-once")


def choose_prefix(n: int, df: np.ndarray, percent: int) -> tuple[int, int]:
    """(length, l) for the ascending frequencies ``df`` of the shingles that several nodes have; the other n - len(df)
    stand before them. Length counts shingles of ``df``."""
    dead, base = n - len(df), n - least_overlap(n, percent)
    if base + 1 <= dead:  # no live shingle within the shortest prefix
        return 0, 1
    most = min(len(df) - (base + 1 - dead), max(1, n // 8)) + 1
    work = np.cumsum(df)[base + 1 - dead - 1:base - dead + most]
    cost = work + work / np.arange(1, most + 1) * (8 + n / 64)
    pick = int(np.argmin(cost)) + 1
    return base + pick - dead, pick


def prefix_rows(sets: DataFrame, percent: int) -> DataFrame:
    """(token, node, df, l, hot): prefixes in the order of frequency; ``hot`` counts a prefix's hot shingles. Frequencies end at ``MOST_DF``;
    a token is a shingle's bucket and its 32 bits there."""
    buckets = buckets_for(sets.agg(F.sum("n")).first()[0])
    kinds = {"nodes": np.int64, "counts": np.uint32, "sizes": np.uint32, "keys": np.uint32, "dfs": np.uint16}

    def frequencies(table: pa.Table) -> pa.Table:
        sent, over = (table.filter(pc.equal(table.column("done"), x)) for x in (False, True))
        counts, keys = _joined(sent, "counts", np.uint32), _joined(sent, "keys", np.uint32)
        order = np.argsort(keys, kind="stable")
        begin, size = _starts(keys[order])
        df = np.empty(len(keys), np.uint16)
        df[order] = np.repeat(np.minimum(size, MOST_DF), size)
        out = []
        if len(sent):
            live = df > 1
            left = np.add.reduceat(live.astype(np.int64), np.cumsum(counts, dtype=np.int64) - counts)
            out.append((sent.column("home")[0].as_py(), _joined(sent, "nodes", np.int64), left, _joined(sent, "sizes", np.uint32), keys[live], df[live]))
        for k in range(len(over)):
            row = over.slice(k, 1)
            keys = _joined(row, "keys", np.uint32)
            out.append((row.column("home")[0].as_py(), *(_joined(row, c, kinds[c]) for c in ("nodes", "counts", "sizes")), keys, np.full(len(keys), MOST_DF, np.uint16)))
        rows = []
        for home, nodes, counts, sizes, keys, dfs in out:
            to = (nodes.view(np.uint64) >> U(32)) * U(buckets) >> U(32)
            entry = np.argsort(np.repeat(to, counts), kind="stable")
            order = np.argsort(to, kind="stable")
            order = order[counts[order] > 0]
            ends = np.cumsum(counts[order], dtype=np.int64)
            for a, size in zip(*_starts(to[order])):
                who, part = order[a:a + size], entry[ends[a] - counts[order[a]]:ends[a + size - 1]]
                rows.append((int(to[who[0]]), home, *(x.tobytes() for x in (nodes[who], counts[who].astype(np.uint32), sizes[who], keys[part], dfs[part]))))
        names = ["to", "home", *kinds]
        types = [pa.int64(), pa.int64(), *[pa.binary()] * len(kinds)]
        return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(zip(names, types))})

    def prefixes(table: pa.Table) -> pa.Table:
        nodes, counts, sizes, keys, dfs = (_joined(table, c, t) for c, t in kinds.items())
        home = np.repeat(table.column("home").to_numpy(), [len(x.as_py()) // 4 for x in table.column("keys")])
        token, node = home << 32 | keys.astype(np.int64), np.repeat(nodes, counts)
        order = np.lexsort((token, dfs, node))
        token, df, n = token[order], dfs[order].astype(np.int64), np.repeat(sizes, counts)[order]
        out = {k: [np.zeros(0, np.int64)] for k in ("token", "node", "df", "l", "hot")}
        for a, size in zip(*_starts(node[order])):
            own = df[a:a + size]
            length, least = choose_prefix(int(n[a]), own, percent)
            if length:
                own, fill = own[:length], lambda x, k=length: np.full(k, x, np.int64)
                for k, v in zip(out, (token[a:a + length], fill(node[order[a]]), own, fill(least), fill(int((own > HOT).sum())))):
                    out[k].append(v)
        return pa.Table.from_batches([_rows(**out)])

    found = packed(sets, "tokens", buckets, MOST_DF).groupBy("bucket").applyInArrow(
        frequencies, "to bigint, home bigint, nodes binary, counts binary, sizes binary, keys binary, dfs binary"
    )
    return found.groupBy("to").applyInArrow(prefixes, "token bigint, node bigint, df bigint, l bigint, hot bigint")


def candidate_pairs(rows: DataFrame) -> DataFrame:
    """(a, b) with enough common prefix shingles, hot ones taken for common where both nodes have some."""
    few = rows.filter(F.col("df") <= HOT)
    one, two = (few.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "l", "hot")]) for s in "ab")
    pairs = one.join(two, "token").filter("node_a < node_b").groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(
        F.count(F.lit(1)).alias("k"), F.first(F.least("l_a", "l_b") - F.least("hot_a", "hot_b")).alias("least")
    )
    return pairs.filter("k >= least").select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b, copies_a, copies_b) among candidate pairs."""
    one, two = (sets.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "copies", "tokens")]) for s in "ab")
    own = pairs.join(one, "a").join(two, "b")
    both = own.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    common = both.withColumn("k", F.size(F.array_intersect("tokens_a", "tokens_b")))
    return common.filter(F.col("k") * 100 >= percent * (F.col("n_a") + F.col("n_b") - F.col("k"))).select("a", "b", "copies_a", "copies_b")


def block_links(hubs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, to, links): for each pair of a hub's blocks the links of its nodes, counted with copies, and a spanning
    forest as edges node - to. ``hubs`` is (node, label)."""
    members = written(hubs.join(sets, "node"), "hub-sets")
    sizes = members.groupBy("label").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_NODES, F.sum("n") / BLOCK_TOKENS)).cast("long").alias("m"))
    sized = members.join(F.broadcast(sizes) if sizes.count() <= MOST_BROADCAST_IDS // 8 else sizes, "label")
    own = F.pmod(F.xxhash64("node"), "m")
    spread = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    placed = spread.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "n", "tokens")

    def links(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        node, n, copies = (table.column(c).to_numpy() for c in ("node", "n", "copies"))
        own = table.column("own").to_numpy()
        sets_ = table.column("tokens").combine_chunks()
        values, ids = np.unique(sets_.flatten().to_numpy(), return_inverse=True)
        ends = np.cumsum(n)
        rows = np.arange(len(node)) if i == j else np.flatnonzero(own == i)
        others = np.arange(len(node)) if i == j else np.flatnonzero(own == j)
        total, root, marked = np.zeros(len(node), np.int64), np.arange(len(node)), np.zeros(len(values) + 1, bool)
        flat = np.concatenate([ids[ends[o] - n[o]:ends[o]] for o in others])
        cuts = np.concatenate([[0], np.cumsum(n[others])[:-1]])
        edges = []
        for r in rows:
            mine = ids[ends[r] - n[r]:ends[r]]
            marked[mine] = True
            common = np.add.reduceat(marked[flat].astype(np.int32), cuts)
            marked[mine] = False
            hit = others[(common * 100 >= percent * (n[r] + n[others] - common)) & (others != r)]
            if i == j:
                hit = hit[hit > r]
            total[r] += copies[hit].sum()
            total[hit] += copies[r]
            for h in hit[root[hit] != root[r]]:
                if root[h] != root[r]:
                    edges.append((r, h))
                    root[root == root[h]] = root[r]
        a, b = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
        linked = np.flatnonzero(total)
        return pa.table({
            "node": np.concatenate([node[linked], node[a]]), "to": pa.array([None] * len(linked) + node[b].tolist(), pa.int64()),
            "links": np.concatenate([total[linked], np.zeros(len(a), np.int64)]),
        })

    return placed.groupBy("label", "i", "j").applyInArrow(links, "node bigint, to bigint, links bigint")


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, label, n_shingles, component_id and n_links, one row for each row of ``docs``. ``label`` names the
    class, null without words."""
    small_batches(docs.sparkSession)
    nodes = written(node_table(docs, words, percent), "nodes")
    sets = alive_sets(docs, nodes.filter("node is not null"), words, percent)
    rows = written(prefix_rows(sets, percent), "prefixes")
    links = written(verified(candidate_pairs(rows), sets, percent), "links")
    edges = links.select("a", "b")
    counted = links.select(F.col("a").alias("node"), F.col("copies_b").alias("links")).union(links.select("b", "copies_a"))

    hot = rows.filter(F.col("df") > HOT)
    if hot.limit(1).count():
        leaders = hot.groupBy("token").agg(F.min("node").alias("b"))
        stars = hot.join(leaders, "token").select(F.col("node").alias("a"), "b").distinct()
        hubs = connected(stars)
        found = written(block_links(hubs, sets, percent), "hub-links")
        known = hubs.select(F.col("node").alias("a"), F.col("label").alias("x")), hubs.select(F.col("node").alias("b"), F.col("label").alias("y"))
        apart = links.join(known[0], "a", "left").join(known[1], "b", "left").filter("not coalesce(x = y, false)")  # the others are in the hub's counts
        counted = apart.select(F.col("a").alias("node"), F.col("copies_b").alias("links")).union(apart.select("b", "copies_a")).union(found.filter("links > 0").select("node", "links"))
        edges = edges.union(found.filter("to is not null").select("node", "to"))

    labels = connected(edges)
    totals = counted.groupBy("node").agg(F.sum("links").alias("links"))
    groups = nodes.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    placed = groups.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = placed.groupBy("label").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("k"))
    joined = placed.join(first, "label").filter("k > 1 or copies > 1").join(totals, "node", "left")
    known = written(joined.select("node", "label", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    return nodes.join(known, "node", "left").select(
        "doc_id", "text_key", F.coalesce("label", "node").alias("label"), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links, one row for each row of ``docs``."""
    return classes(docs, words, percent).select("doc_id", "n_shingles", "component_id", "n_links")


def first_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each class, one with its smallest id. Rows without words are classes of their own, but
    repeated rows stay once. Rows without an id stay."""
    key = free_name(docs, "key")
    own = classes(docs, words, percent).filter("doc_id = component_id").groupBy("doc_id", "label", "text_key").count()
    best = own.groupBy("doc_id", "label").agg(F.min(F.struct("text_key", "count")).alias("f"))
    kept = written(best.select("doc_id", F.col("f.text_key").alias(key), F.col("f.count").alias("rows")), "kept")
    once, more = kept.filter("rows = 1").drop("rows"), kept.filter("rows > 1").drop("rows")
    if kept.count() <= MOST_BROADCAST_IDS:
        once, more = F.broadcast(once), F.broadcast(more)
    marked, on = docs.withColumn(key, F.xxhash64("text")), ["doc_id", key]
    out = marked.join(once, on, "left_semi")
    if kept.filter("rows > 1").limit(1).count():
        out = out.unionByName(marked.join(more, on, "left_semi").dropDuplicates(on))
    return out.drop(key).unionByName(docs.filter("doc_id is null"))
