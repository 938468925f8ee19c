"""Operators that look at the whole corpus, against brute force."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchwatch.llm import decontaminate, host_rules, jaccard_join, ordinal, quality, shards, substrings, toxicity
from batchwatch.llm.common import hash_limit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(words)] if words and len(words) < 5 else (tuple(words[i:i + 5]) for i in range(len(words) - 4)))


def brute_join(rows):
    """(doc_id, n, component, links) of each row; rows are told apart by their number."""
    sets = [shingle_set(t) for _, t in rows]
    root, links = list(range(len(rows))), collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    first = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            first[find(k)] = min(first.get(find(k), i), i)
    return sorted(((i, len(sets[k]), first.get(find(k)), links[k]) for k, (i, _) in enumerate(rows)), key=str)


def joined(docs):
    return sorted((tuple(r) for r in jaccard_join.join(docs).collect()), key=str)


@pytest.mark.parametrize("source", ["edge", "docs", "empty"])
def test_join_equals_brute_force(request, source):
    docs = request.getfixturevalue(source)
    want = brute_join([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = joined(docs)
    if source == "edge":  # rows without words and without an id have no class
        assert [(a, b, c) for a, b, c, _ in got] == [(a, b, c) for a, b, c, _ in want]
    assert got == want


def test_join_through_hubs(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 1)
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 3)
    assert joined(docs) == brute_join([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_join_of_a_large_family(spark):
    words = [f"w{i}" for i in range(80)]
    rows = [(k, " ".join(words[:k % 70] + [f"u{k}"] + words[k % 70 + 1:])) for k in range(150)]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == brute_join(rows)


def test_texts_are_cut_into_shingles_once(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TEXT_BYTES", 100)  # a few texts at a time
    nodes = jaccard_join.node_table(docs).filter("node is not null").localCheckpoint()
    alive = jaccard_join.alive_nodes(nodes)
    assert "MapInArrow" not in alive._jdf.queryExecution().optimizedPlan().toString() and 0 < alive.count() < nodes.count()
    assert joined(docs) == brute_join([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_copies_alone_keep_no_node_alive(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([a, a, a, b])], "doc_id long, text string")
    assert jaccard_join.alive_nodes(jaccard_join.node_table(docs)).count() == 0
    assert joined(docs) == [(0, 56, 0, 2), (1, 56, 0, 2), (2, 56, 0, 2), (3, 56, 3, 0)]


@pytest.mark.parametrize("most", [2, 1024])
def test_shingles_in_small_buckets_and_steps(spark, docs, monkeypatch, most):
    """Common lines, families and copies over many buckets and steps; frequent shingles are not sent for every node."""
    monkeypatch.setattr(jaccard_join, "BUCKET_TOKENS", 300)
    monkeypatch.setattr(jaccard_join, "SLICE_TOKENS", 1000)
    monkeypatch.setattr(jaccard_join, "MOST_DF", most)
    monkeypatch.setattr(jaccard_join, "HOT", 3)
    rows = [(r["doc_id"], r["text"]) for r in docs.limit(60).collect()]
    line = " ".join(f"c{i}" for i in range(12))
    rows += [(1000 + k, f"{line} " + " ".join(f"w{k // 8}_{i}" for i in range(50)) + f" u{k % 8} u{k % 4}") for k in range(64)]
    found = spark.createDataFrame(rows + rows[-4:], "doc_id long, text string").repartition(5)
    assert joined(found) == brute_join(rows + rows[-4:])


def test_frequent_shingles_reach_no_bucket_for_every_node(spark):
    rows = [(n, 40, [5, 7, 100 + n]) for n in range(300)]
    packed = jaccard_join.packed(spark.createDataFrame(rows, "node long, n long, prefix array<long>").coalesce(1), "prefix", 50, 2)
    sent = packed.selectExpr("done", "length(keys) / 4 AS k").groupBy("done").sum("k").collect()
    assert dict(map(tuple, sent)) == {False: 300 + 2 * 2, True: 2 * 298}


def test_one_of_each_class_stays(edge):
    kept = jaccard_join.first_of_each(edge)
    ids = sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect())
    assert ids == [1, 4, 6, 7, 8, 9, 12, 13, 14, 15, 16] and kept.columns == edge.columns
    assert kept.filter("doc_id is null").count() == 2


def brute_removal(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(x[i:i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for x in data:
        edge = np.zeros(len(x) + 1, int)
        for i in range(len(x) - length + 1):
            if seen[x[i:i + length]] > 1:
                edge[i] += 1
                edge[i + length] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        out.append((len(x), int(gone.sum()), len(re.findall(b"1+", bytes(gone.astype(np.uint8) + 48))), kept))
    return sorted(out)


@pytest.mark.parametrize("source,ranges", [("edge", 10**6), ("docs", 10**6), ("docs", 0), ("empty", 10**6)])
def test_repeats_equal_brute_force(request, source, ranges, monkeypatch):
    monkeypatch.setattr(substrings, "MOST_BROADCAST_RANGES", ranges)
    monkeypatch.setattr(substrings, "BLOCK", 1000 if ranges else 3)
    docs = request.getfixturevalue(source)
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substrings.remove_repeats(docs).collect())
    assert got == brute_removal([r["text"] for r in docs.collect()], 200)


@pytest.mark.parametrize("source", ["edge", "docs", "empty"])
def test_shards_keep_all_rows(request, source):
    docs = request.getfixturevalue(source)
    out = shards.external_shuffle(docs, 7, seed=3, bucket_bytes=20_000)
    rows = out.collect()
    names = [c for c in docs.columns if c != "shard"]
    assert collections.Counter(tuple(r[c] for c in names) for r in rows) == collections.Counter(tuple(r[c] for c in names) for r in docs.collect())
    by_shard = collections.defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    sizes = [len(by_shard.get(s, ())) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_depend_on_seed_only(docs):
    order = lambda seed: [tuple(r) for r in shards.external_shuffle(docs, 5, seed=seed).select("place", "doc_id").orderBy("place").collect()]
    assert order(1) == order(1) != order(2)
    places = [i for _, i in order(1)]
    assert abs(np.corrcoef(places, np.arange(len(places)))[0, 1]) < 0.3


def test_host_rules_edges(edge, empty):
    got = {r["doc_id"]: r for r in host_rules.apply(edge).collect()}
    assert got[14]["n_repeat_words"] == 10 and got[9]["n_repeat_words"] == 0 and got[7]["n_words"] == got[6]["n_words"] == 0
    assert got[11]["host"] is None and got[11]["kept"] and not got[9]["kept"]
    assert host_rules.apply(edge).count() == edge.count() and host_rules.apply(empty).count() == 0


def test_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(k, good if k % 3 == 0 or k >= 60 else "spam spam", "bad" if k < 60 else f"h{k % 7}") for k in range(200)]
    out = host_rules.apply(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    verdict = {r["host"]: r["host_failed"] for r in out.select("host", "host_failed").distinct().collect()}
    assert verdict["bad"] and not any(v for h, v in verdict.items() if h != "bad")
    assert out.filter("host = 'bad' and kept").count() == 0 and out.filter("host <> 'bad' and not kept").count() == 0


def test_leaks_equal_shared_words(spark, docs, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = lambda t: re.findall(r"\w+", t.lower())
    items = {r["item_id"]: " ".join(words(r["text"])) for r in bench.collect()}
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in items.items() if f" {t} " in f" {' '.join(words(r['text']))} "}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, bench).collect()}
    assert got == want and want


def test_leaks_find_paraphrases_and_spare_the_rest(spark, edge, empty):
    item = " ".join(f"term{i}" for i in range(40))
    words = item.split()
    other = [f"plain{i} filler{i % 7}" for i in range(60)]
    para = " ".join([*other, *[w if k % 4 else f"swap{k}" for k, w in enumerate(words)], *other])
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short")], "item_id long, text string")
    rows = spark.createDataFrame([(1, para), (2, " ".join(other)), (3, item), (4, None), (5, ""), (None, item), *[(k, f"aside{k} " * 9) for k in range(10, 80)]], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in decontaminate.find(rows, bench).collect()) == [0, 1, 3]
    assert decontaminate.find(empty, bench).count() == 0 and decontaminate.find(rows, bench.filter("item_id > 1")).count() == 0
    assert decontaminate.clean(edge, bench).count() == edge.count() and decontaminate.clean(edge, bench).columns == edge.columns


def leaking(spark, rows, items):
    """(doc_id, item_id) of the items found, among a hundred other documents that share some words."""
    aside = [(1000 + k, " ".join(f"common{j} aside{k}x{j}" for j in range(60))) for k in range(100)]
    found = decontaminate.find(spark.createDataFrame([*rows, *aside], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    pairs = [(r["doc_id"], r["item_id"]) for r in found.collect()]
    assert len(pairs) == len(set(pairs))
    return sorted(pairs)


def test_leaks_are_looked_for_in_every_window(spark):
    words, short = [f"term{i}" for i in range(40)], [f"thing{i}" for i in range(20)]
    common = [f"common{i}" for i in range(60)]
    edited = [w if k % 10 < 7 else f"swap{k}" for k, w in enumerate(words[:-5])] + words[-5:]
    run = ["thing3"] * 64
    rows = [
        (1, " ".join([*common, *words[:20], *common, *edited])),  # half of it word for word, then all of it edited
        (2, " ".join([*run, *common, *short])), (3, " ".join([*words[:20], *common])), (4, " ".join(run)),
    ]
    assert leaking(spark, rows, [(1, " ".join(words)), (2, " ".join(short))]) == [(1, 1), (2, 2)]


def test_leaks_of_one_passage_of_a_long_item(spark):
    words, common = [f"term{i}" for i in range(300)], [f"common{i}" for i in range(60)]
    closing = [w if k % 3 else f"swap{k}" for k, w in enumerate(words[-40:])][:-5] + words[-5:]
    rows = [(k, " ".join([*common, *part, *common])) for k, part in enumerate((words[48:120], words[200:210], closing, [w if k % 3 else f"x{k}" for k, w in enumerate(words[48:120])]))]
    assert leaking(spark, rows, [(1, " ".join(words))]) == [(0, 1), (2, 1)]


def test_leaks_of_short_and_unspaced_items(spark):
    common = [f"common{i}" for i in range(60)]
    rare = [f"rare{i}" for i in range(60)]
    eight, ten, three = [f"common{i}" for i in range(0, 24, 3)], [f"term{i}" for i in range(10)], ["common9", "common2", "common5"]
    rng = np.random.default_rng(8)
    han, kana = ("".join(map(chr, rng.integers(low, high, n))) for low, high, n in ((0x4E00, 0x9FA0, 40), (0x3041, 0x3097, 30)))
    around = lambda low, high: "".join(map(chr, rng.integers(low, high, 200)))
    rows = [
        (1, " ".join([*rare, *eight, *rare])), (2, " ".join([*rare, *ten[:4], "swap", *ten[5:], *rare])), (3, " ".join([*common, *three])),
        (4, around(0x4E00, 0x9FA0) + han + "\u3002" + around(0x4E00, 0x9FA0)), (5, around(0x4E00, 0x9FA0) + han[:20] + "\u4e00" + han[21:] + around(0x4E00, 0x9FA0)),
        (6, around(0x3041, 0x3097) + kana + around(0x3041, 0x3097)), (7, around(0x3041, 0x3097) * 3), (8, " ".join(three[:2])),
    ]
    items = [" ".join(eight), " ".join(ten), " ".join(three), han, kana, "\u3002 !", ""]
    assert leaking(spark, rows, list(enumerate(items))) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 3), (6, 4)]


def planted(bench, docs):
    """(item, text) of items with a fifth or two fifths of their words changed, the answer kept, between words of documents."""
    rng = np.random.default_rng(4)
    around = [w for t in docs if t and len(w := re.findall(r"\w+", t)) > 100]
    out = []
    for k, item in enumerate(bench):
        for share in (0.2, 0.4):
            words, other, more = re.findall(r"\w+", item), *[around[i] for i in rng.integers(0, len(around), 2)]
            for i in rng.permutation(max(len(words) - 5, 0))[:int(share * len(words))]:
                words[i] = other[rng.integers(len(other))]
            out.append((k, " ".join([*other[:60], *words, *more[:60]])))
    return out


def test_latent_search_finds_what_a_search_of_all_passages_finds(spark, docs, sf_dir, monkeypatch):
    bench = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").collect()]
    bench += [" ".join(f"topic{k % 40}x{(k * j + j) % 97}" for j in range(40)) for k in range(200)]  # many passages, so that the rank is low
    texts = [r["text"] for r in docs.collect()]
    cases = planted(bench, texts)
    items = [(k, decontaminate.words_of(t)) for k, t in enumerate(bench)]
    df, total = decontaminate.document_counts(docs)
    assert total == len(texts)
    alone = [np.unique(decontaminate.feature_of(decontaminate.words_of(t).terms)) for t in texts]
    assert np.array_equal(df, np.bincount(np.concatenate(alone), minlength=decontaminate.FEATURES))
    idf = np.log((total + 1) / (df + 1)) + 0.05
    spaces = decontaminate.spaces_of(items, docs.select("text").limit(50), idf)
    assert all(space.basis.shape[1] <= max(decontaminate.LEAST_RANK, len(space.passages) // decontaminate.RANK_SHARE) for space in spaces)
    assert max(len(space.passages) for space in spaces) >= 5 * min(space.basis.shape[1] for space in spaces)
    runs, together = decontaminate.Runs(items), decontaminate.words_of(*[t for _, t in cases], None, "", *texts)
    found = decontaminate.leaks_of(together, spaces, items, runs, idf)
    one_by_one = [decontaminate.leaks_of(own, spaces, items, runs, idf).get(0, {}) for own in together.parts()]
    assert [set(own) for own in one_by_one] == [set(found.get(k, {})) for k in range(len(one_by_one))]
    monkeypatch.setattr(decontaminate, "NEAR", -2.0)
    brute = decontaminate.leaks_of(together, spaces, items, runs, idf)
    pairs = lambda f: {(k, i) for k, own in f.items() for i in own}
    assert pairs(found) <= pairs(brute) and len(pairs(found)) >= 0.99 * len(pairs(brute))
    assert sum(k in brute.get(n, ()) for n, (k, _) in enumerate(cases)) >= 0.8 * len(cases)


def test_latent_space_hangs_on_no_sample_of_documents(spark):
    rng = np.random.default_rng(5)
    items = [(k, decontaminate.words_of(" ".join(f"term{i}" for i in rng.integers(0, 400, 40)))) for k in range(3)]
    idf = np.ones(decontaminate.FEATURES)
    one, two = (decontaminate.spaces_of(items, spark.createDataFrame([(t,)], "text string"), idf) for t in ("term1 term2 " * 200, "term3 other " * 200))
    assert [s.basis.shape[1] for s in one] == [3]  # no dimension that holds no passage
    assert all(np.array_equal(a.basis, b.basis) and np.array_equal(a.latent, b.latent) for a, b in zip(one, two))


def test_benchmark_in_parts_gives_the_same_leaks(spark, docs, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = lambda part_bytes: sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, bench, part_bytes).collect())
    whole, size = key(1 << 20), sum(len((r["text"] or "").encode()) for r in bench.collect())
    assert key(size // 3) == whole and whole


@pytest.mark.parametrize("share", [1e-12, 0.25, 0.5, 1.0, 7.0])
def test_sample_limits_hold_for_any_share(share):
    limit = hash_limit(share)
    assert -2**63 <= limit < 2**63 and abs((limit + 2**63) / 2**64 - min(share, 1.0)) <= 1e-3 * share


def test_window_norms_are_those_of_word_counts():
    rng = np.random.default_rng(6)
    f, idf = rng.integers(0, 12, 100), rng.random(12)
    starts = np.arange(0, 69)
    got = decontaminate.window_norms(idf[f] ** 2, decontaminate.repeats(f, 32), starts, 32)
    assert np.allclose(got, [((idf * np.bincount(f[s:s + 32], minlength=12)) ** 2).sum() for s in starts])


def auc(score, positive):
    rank = np.argsort(np.argsort(score))
    n = positive.sum()
    return (rank[positive].sum() - n * (n - 1) / 2) / (n * (~positive).sum())


def test_models_on_held_out_labels(spark):
    rng = np.random.default_rng(4)
    plain, bad, junk = [f"word{i}" for i in range(300)], ["scum", "trash", "moron"], ["###", "$$$", "%%%"]
    texts, labels = [], []
    for k in range(900):
        toxic, quality_ = int(rng.random() < 0.2), int(rng.random() < 0.8)
        words = [*rng.choice(plain, 60), *(rng.choice(bad, 2) if toxic else []), *([] if quality_ else rng.choice(junk, 40))]
        texts.append((k, " ".join(rng.permutation(words))))
        labels.append((k, quality_, toxic))
    docs, all_labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality long, toxic long")
    held = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
    train = spark.createDataFrame([x for x in labels if not held(x[0])], all_labels.schema)
    for scored, truth in ((toxicity.grade(docs, train), lambda q, t: t == 1), (quality.select(docs, train), lambda q, t: q == 1 and t == 0)):
        value = {r[0]: r[1] for r in scored.collect()}
        test = [x for x in labels if held(x[0])]
        assert auc(np.array([value[k] for k, _, _ in test]), np.array([truth(q, t) for _, q, t in test])) > 0.9


def test_model_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None), (99, 1, 1)], "doc_id long, quality long, toxic long")
    out = quality.select(edge, labels)
    assert out.count() == edge.count() and out.filter("tail is null").count() == 0
    assert toxicity.grade(empty, labels).count() == 0
    assert toxicity.grade(edge, labels.limit(0)).filter("toxic is not null").count() == 0


def test_thresholds_are_ordered_and_chances_add_up():
    model = ordinal.fit_rows([(np.array([k % 3, ordinal.FEATURES]), np.ones(2)) for k in range(60)], np.arange(60) % 3, [0, 1, 2])
    assert (np.diff(model.thresholds) > 0).all()
    assert np.allclose(model.probabilities(np.linspace(-5, 5, 9)).sum(axis=1), 1)


def test_query_digests(spark, sf_dir):
    import __spark_entry__ as entry

    queries = entry.queries()
    names = [n for n in queries if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in queries
    shown = queries["op4_external_shuffle"](spark, sf_dir)
    own = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(r["size"] == len(own[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(own[r["doc_id"]]) for r in shown.collect())
    assert shown.filter(F.col("law") != "rows").count() == 0


def test_rows_without_an_id_link_others(spark):
    """A row without an id is the only bridge between two documents, which share less than the threshold themselves."""
    words = [f"w{i}" for i in range(100)]
    one, two = words[:86], words[14:]
    rows = [(1, " ".join(one)), (2, " ".join(two)), (None, " ".join(words)), (None, " ".join(f"x{i}" for i in range(20))), (7, "apart from all others in this table")]
    got = joined(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute_join(rows) and (2, 82, 1, 1) in got and (None, 96, 1, 2) in got


def test_structured_words_are_not_taken_for_each_other(spark):
    """Long words that collide under polynomial hashes modulo a power of two, whatever their base."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    rows = [(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits))]
    rows += [(3, " ".join(["x", rows[0][1]] * 4)), (4, " ".join(["x", rows[1][1]] * 4))]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == brute_join(rows)
