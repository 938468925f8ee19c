"""Repeated word windows, the Merkle manifest and collocations, against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from batchwatch.llm import merkle, phrases, q_merkle, q_phrases, q_seed, seed_extend
from conftest import SCHEMA, row

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def saved(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


# --- repeated windows


def brute_windows(rows, window):
    texts = [WORD.findall(t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i:i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), words in zip(rows, texts):
        gone = {i + k for i in range(len(words) - window + 1) if seen[tuple(words[i:i + window])] > 1 for k in range(window)}
        out.append((doc_id, len(words), len(gone), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    return sorted(out, key=str)


@pytest.mark.parametrize("source", ["edge", "docs", "empty"])
def test_windows_query(spark, request, tmp_path, source):
    docs = request.getfixturevalue(source)
    got = q_seed.op11_seed_extend(spark, saved(spark, docs, tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert rows_of(got) == brute_windows([(r["doc_id"], r["text"]) for r in docs.collect()], 35)


def windows(spark, texts, window, gram, size=seed_extend.PIECE):
    found = seed_extend.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), window, gram, size)
    return sorted(((r[0], r[1], r[2], sha(r[3])) for r in found.collect()), key=str)


def test_partial_overlaps_of_many_partners(spark):
    """Each text shares some stretch with others, none with all; cyclic and constant runs repeat within one text."""
    rng, words = random.Random(3), [f"w{i}" for i in range(60)]
    texts = []
    for k in range(60):
        a, b = sorted(rng.sample(range(61), 2))
        texts.append(" ".join([f"u{k}", *words[a:b], f"v{k}", *words[:rng.randrange(20)]]))
    texts += ["a " * 50, "a b " * 30, "a b c " * 9 + "\n" + "a b c " * 9, "x", "", None, "é ü " * 14]
    for window, gram in ((35, 8), (12, 5), (9, 8), (20, 3)):
        assert windows(spark, texts, window, gram) == brute_windows(list(enumerate(texts)), window)


def test_long_texts_are_seeded_in_pieces(spark):
    rng = random.Random(4)
    words = [rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(3000)]
    texts = [" ".join(words), " ".join([*words[500:1200], "cut", *words[1250:1290]]), " ".join(words[:30])]
    assert [w for part in seed_extend.parts_of(texts[0].encode(), 64) for w in part] == texts[0].encode().split()
    hashes = seed_extend.hashes_of(texts[0], seed_extend.WordHashes())
    whole, pieces = ([np.concatenate(c) for c in zip(*seed_extend.seeds(hashes, 35, 8, size))] for size in (10_000, 100))
    for _, _, lo, hi in (whole, pieces):  # every window belongs to one anchor
        assert sorted(i for a, b in zip(lo, hi) for i in range(a, b + 1)) == list(range(3000 - 34))
    assert windows(spark, texts, 35, 8, 100) == brute_windows(list(enumerate(texts)), 35)


def test_structured_words_do_not_collide(spark):
    """Words and runs that collide under polynomial hashes modulo a power of two."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    texts = [" ".join([one] * 40), " ".join([two] * 30), " ".join("ab"[b] for b in bits), " ".join("cd"[b] for b in bits)]
    assert windows(spark, texts, 35, 8) == brute_windows(list(enumerate(texts)), 35)


# --- Merkle manifest


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(leaves):
    """Root and, for each leaf, the siblings (left, right) level by level."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, place in enumerate(at):
            run = level[place // 16 * 16:place // 16 * 16 + 16]
            paths[k].append(("".join(run[:place % 16]), "".join(run[place % 16 + 1:])))
        level, at = [sha("".join(level[i:i + 16])) for i in range(0, len(level), 16)], [p // 16 for p in at]
    return level[0], paths


def brute_manifest(rows):
    """Rows are (doc_id, text, lang, source, n_chars)."""
    def leaf(r, text):
        return sha("".join(map(framed, (r[0], r[3], r[2], r[4], text))))

    by_source = collections.defaultdict(list)
    for r in rows:
        text, hit = r[1], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        lowered = None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)
        by_source[r[3]].append((r[0], leaf(r, text), leaf(r, lowered if hit else text)))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    folded = {}
    for s in order:
        by_source[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        folded[s] = climb([x[1] for x in by_source[s]])
    root, upper = climb([folded[s][0] for s in order]) if order else (None, [])
    out = []
    for s, above in zip(order, upper):
        subroot, paths = folded[s]
        for (doc_id, leaf_hash, other), path in zip(by_source[s], paths):
            for left, right in [*path, *above]:
                other = sha(left + other + right)
            out.append((doc_id, leaf_hash, subroot, root, sha("".join(a + b for a, b in [*path, *above])), other, other == root))
    return sorted(out, key=str)


def five(docs):
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect()]


@pytest.mark.parametrize("source", ["edge", "docs", "empty"])
def test_manifest_query(spark, request, tmp_path, source):
    docs = request.getfixturevalue(source)
    got = q_merkle.op12_merkle_manifest(spark, saved(spark, docs, tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert rows_of(got) == brute_manifest(five(docs))


@pytest.mark.parametrize("height", [1, 2])
def test_manifest_over_several_rounds(spark, height):
    """Sources of 1 to 700 leaves and 40 sources, folded in small subtrees, so that trees take up to four rounds."""
    sizes = [1, 2, 15, 16, 17, 255, 256, 257, 700] + [3] * 30
    rows = [row(1000 * k + i, f"Text {i % 50}", "en", None if k == 3 else f"s{k}é") for k, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = merkle.manifest(docs, height).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert rows_of(got) == brute_manifest(five(docs))


def test_queue_holds_few_messages():
    queue, most, nodes = merkle.Queue(4096, 3), 0, 0
    for leaf in range(4096):
        queue.send(0, leaf, "x")
        most = max(most, len(queue.heap))
        nodes += len(list(queue.take(leaf)))
    assert nodes == 256 + 16 + 1 and most <= 16 * 3


# --- collocations


def brute_phrases(rows, top=2000):
    f = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        found = []
        for p, a in counts.items():
            if len(p) == 1 or a < 10:
                continue
            if len(p) == 2 and any(c >= 10 and 100 * c >= 50 * a and p in (q[:2], q[1:]) for q, c in counts.items() if len(q) == 3):
                continue
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out, key=str)


@pytest.mark.parametrize("source", ["edge", "empty"])
def test_phrases_query(spark, request, tmp_path, source):
    docs = request.getfixturevalue(source)
    got = q_phrases.op13_phrase_collocations(spark, saved(spark, docs, tmp_path))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert rows_of(got) == brute_phrases([(r["text"], r["lang"]) for r in docs.collect()])


def phrase_rows():
    rng = random.Random(8)
    words = [f"{c}{d}" for c in "abcDÉ" for d in "xyz"] + ["the"] * 6
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "", ".", " ;", "\n", "\t", "!?"]) for _ in range(400)) for _ in range(12)]
    return [(t, rng.choice(["en", "fr", None, "und"])) for t in texts] + [(None, "en"), ("", None), ("one", "xx"), ("..,", "xx")]


def test_phrases_with_bursts_spills_and_cuts(spark):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "text string, lang string")
    want = brute_phrases(rows, 25)
    assert rows_of(phrases.collocations(docs, 25)) == want
    small = phrases.Limits(burst=4, entries=60, words=12, bytes=50)  # long texts are cut, containers burst, all spill
    runs = phrases.runs_of(docs.fillna("und", "lang"), 1, small)
    assert runs.count() > 1.5 * runs.select("lang", "phrase").distinct().count()
    assert rows_of(phrases.collocations(docs, 25, small)) == want


def test_tries_burst_and_spill_sorted():
    everything = np.full(1 << phrases.FILTER - 6, -1).view(np.uint64)
    counter = phrases.Counter(3, phrases.Limits(burst=3), everything)
    counter.count("en", b"a b c a b d a c e.a f g a b c")
    trie = counter.tries["en"]
    assert isinstance(trie.root[counter.numbers[b"a"]], phrases.Node) and sum(trie.sizes.values()) == counter.entries
    (run,) = counter.spilled(True)
    rows = list(zip(*(c.to_pylist() for c in run.columns)))
    assert rows == sorted(rows) and ("en", "a b c", 2) in rows and ("en", "c e a", 1) not in rows and not counter.entries


@pytest.mark.parametrize("data", [b"", b" \t", b".", b"a", b"..a b.\tc\xc3\xa9 \x01d . a", b"a.b.c  "])
def test_words_by_offsets(data):
    want = data.replace(b".", b" . ").split()
    found = phrases.split(data)
    assert phrases.bytes_of(found) == found.to_pylist() == want
    counter = phrases.Counter(1, phrases.Limits(), None)
    numbers = counter.numbers_of(found)
    assert [counter.words[k] or b"." for k in numbers] == want and len(counter.hashes) == len(counter.words)


def test_filter_drops_phrases_with_rare_parts(spark):
    docs = spark.createDataFrame([("a b c. " * 10 + "a b d. e b c. b c a", "en")], "text string, lang string")
    words = phrases.filter_of(spark.createDataFrame([("en", w) for w in "abc"], "lang string, phrase string"))
    assert {r["phrase"]: r["f"] for r in phrases.runs_of(docs, 2, filter_bits=words).collect()} == {"a b": 11, "b c": 12, "c a": 1}
    pairs = phrases.filter_of(spark.createDataFrame([("en", w) for w in ("a b", "b c")], "lang string, phrase string"))
    assert {r["phrase"]: r["f"] for r in phrases.runs_of(docs, 3, filter_bits=pairs).collect()} == {"a b c": 10}


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    rows = [("en", "a b", big), ("en", "a", big + 7), ("en", "b", big + 11), ("en", "", 9)]
    (found,) = phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, f long")).collect()
    assert found["score"] == 1_000_000 * big * big // ((big + 7) * (big + 11))
