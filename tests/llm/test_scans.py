"""Operators that work on each text alone: secrets, BPE, language."""

import random
import re
import zlib

import pyarrow as pa
import pytest

from batchwatch.llm import bpe, language, secrets
from batchwatch.llm.common import runs_of

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)


def base_spans(text):
    data, found = (text or "").encode(), []
    found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(rb"AKIA[A-Z0-9]+", data) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(rb"[0-9a-f]+", data) if len(m[0]) >= 24]
    return [(secrets.BASE_KINDS[k], len(data[:s].decode()), len(data[:e].decode())) for s, k, e in sorted(found)]


def of_scanner(text):
    return [(s["kind"], s["start"], s["end"]) for s in secrets.scanner(secrets.RULES).spans(text) if s["kind"] in secrets.BASE_KINDS]


def test_secrets_match_regexes_on_random_texts():
    rng = random.Random(1)
    parts = ["password", "PassWd", "secret", "token", "api_key", "apikey", ":", "=", " ", '"', "'", "AKIA", "ABCD1234", "deadbeef01", "é", "abc", "x=", "."]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert of_scanner(text) == base_spans(text), text


def test_secrets_added_kinds():
    text = "ghp_" + "a1B2" * 9 + " eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl -----BEGIN RSA PRIVATE KEY-----"
    assert [s["kind"] for s in secrets.scanner(secrets.RULES).spans(text)] == ["github", "jwt", "pem"]


def test_private_keys_are_spans_up_to_their_end():
    rng, of = random.Random(9), secrets.scanner(secrets.RULES)
    lines = ["".join(rng.choice("ABCDwxyz0189+/") for _ in range(64)) for _ in range(5)] + ["q9Zx+w=="]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    fields = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF", ""]
    for gap in ("\n", "\r\n", "\\n", "\n  "):
        for body in (lines, fields + lines):
            for key in (gap.join([begin, *body, end]), gap.join([begin, *body])):
                text = f"é before {key}\n-- after, all words stay"
                assert secrets.redacted(text, of.spans(text)) == "é before [PEM]\n-- after, all words stay"
    two = "\n".join([begin, *lines, end, "between", begin, *lines])
    assert secrets.redacted(two, of.spans(two)) == "[PEM]\nbetween\n[PEM]"
    assert secrets.redacted(f"{begin} is its first line", of.spans(f"{begin} is its first line")) == "[PEM] is its first line"


def test_secret_scan_and_redaction(edge, empty, edge_rows):
    assert secrets.digests(secrets.scan(empty)).count() == 0
    got = sorted((r["doc_id"] or 0, tuple(map(tuple, r["spans"]))) for r in secrets.scan(edge).collect())
    assert got == sorted((r[0] or 0, tuple(base_spans(r[1]))) for r in edge_rows)
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(edge).collect()}
    assert clean[13] == "[ASSIGN] [ACCESS] é <|endoftext|> [HEX]" and clean[6] is None


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe_matches_library_on_odd_texts(library):
    rng, codec = random.Random(2), bpe.codec(bpe.default_path())
    kinds = ["ab", "aé ", "the quick.,'s\n  ", "あx\t", "0123 ½²", "   a", "\x1c\x1da "]
    for _ in range(3000):
        kind = rng.choice([*kinds, None])
        text = "".join(rng.choice(kind or ["<|endoftext|>", " a", "<|", "it's"]) for _ in range(rng.randint(0, 40)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text).tolist() == ids, text
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert codec.decode([255, 128]) == library.decode([255, 128], skip_special_tokens=False)


@pytest.mark.parametrize("source", ["edge", "docs", "empty"])
def test_bpe_round_trip(request, source, library):
    rows = bpe.round_trip(request.getfixturevalue(source)).collect()
    texts = [r["text"] or "" for r in request.getfixturevalue(source).collect()]
    assert sorted((r["decoded"], tuple(r["ids"])) for r in rows) == sorted((t, tuple(library.encode(t, add_special_tokens=False).ids)) for t in texts)


def test_cross_parsing_counts_longest_phrases():
    rng = random.Random(3)
    for _ in range(500):
        known = bytes(rng.choice(b"abcd ") for _ in range(rng.randint(1, 60)))
        text = bytes(rng.choice(b"abcde ") for _ in range(rng.randint(1, 60)))
        count = at = 0
        while at < len(text):
            size = 1
            while at + size < len(text) and text[at:at + size + 1] in known:
                size += 1
            count, at = count + 1, at + size
        assert language.Parser(known).phrases(text) == count


def test_runs_of_texts_hold_all_of_them():
    texts = pa.array(["abc", None, "", "d" * 50, "é" * 4, *["xy"] * 30])
    for size in (1, 8, 1000):
        runs = runs_of(texts, size)
        assert [k for start, number in runs for k in range(start, start + number)] == list(range(len(texts)))
    assert len(runs_of(texts, 8)) > 5 and runs_of(texts, 1000) == [(0, len(texts))] and runs_of(texts[:0], 8) == []


def test_spans_count_code_points_in_long_texts():
    one = "é token = abcdef123 ж "
    spans = secrets.scanner(secrets.RULES).spans(one * 3000)
    starts = [s["start"] for s in spans if s["kind"] == "assign"]
    assert starts == [k * len(one) + 2 for k in range(3000)] and all((one * 3000)[s["start"]:s["end"]] == "token = abcdef123" for s in spans if s["kind"] == "assign")


def test_texts_parsed_together_are_parsed_alike(monkeypatch):
    rng = random.Random(9)
    texts = [bytes(rng.choice(b"abcde ") for _ in range(rng.choice([1, 2, 40, 41, 300]))) for _ in range(200)] + [bytes(rng.choice(b"abcdef") for _ in range(9000))]
    known = [(str(k), language.Parser(bytes(rng.choice(letters) for _ in range(500)))) for k, letters in enumerate((b"abc ", b"cde ", b"abcdef"))]
    want = [[p.phrases(t) for _, p in known] for t in texts]
    for together, positions, fewest in ((1 << 20, 1 << 10, 2), (12_000, 7, 2), (1000, 64, 5)):
        for name, value in (("TOGETHER", together), ("POSITIONS", positions), ("FEWEST", fewest)):
            monkeypatch.setattr(language, name, value)
        assert language.phrases_by_language(texts, known).tolist() == want
    assert language.phrases_by_language([], known).shape == (0, 3) and language.predict([], ()) == []


def test_language_is_right_on_held_out_documents(docs):
    found = language.identify(docs, language.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_edges(edge, empty):
    model = language.learn(edge)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(edge, model).collect()}
    assert all(got[k] == ("und", 0.0) for k in (6, 7, 8, 12)) and got[4][0] in dict(model)
    assert language.learn(empty) == () and language.identify(empty, ()).count() == 0
    assert language.accepted(edge, model).columns == edge.columns


def test_languages_of_long_texts_are_learned(spark):
    rng = random.Random(7)
    prose = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    digits = "1234 " * 30_000
    rows = [(k, prose("abcdefé", 6000), "long") for k in range(9)] + [(k, prose("uvwxyz", 40), "short") for k in range(20, 40)]
    rows += [(k, prose("ghijkl", 9000) + digits, "tail") for k in range(50, 59)] + [(60, digits, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs)
    assert [k for k, _ in model] == ["long", "short", "tail"]
    assert all(language.BYTES_PER_LANG * 0.98 < len(v) <= language.BYTES_PER_LANG for k, v in model if k != "short")
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model).collect()}
    assert all(found[i] == (lang if lang != "none" else "und") for i, _, lang in rows)


def test_texts_stay_where_no_language_is_learned(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (3, None, None), (4, "ж", None)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in language.accepted(docs, language.learn(docs)).collect()) == [1, 4]


def test_codec_query_digests(spark, edge, tmp_path):
    """The query's columns from the tokenizers library itself, over texts of all kinds."""
    import hashlib

    import public_tokenizers
    import tokenizers

    from batchwatch.llm import q_bpe

    library = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    library.no_truncation()
    library.no_padding()
    edge.write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for r in edge.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in q_bpe.op10_bpe_codec(spark, str(tmp_path)).collect())


def test_small_caches_and_chunks_change_nothing(edge_rows):
    from batchwatch.llm import bpe

    texts = [r[1] for r in edge_rows] + ["a" * 3000, "ü" * 500]
    whole = bpe.Codec(bpe.default_path())
    ids, bounds = whole.encode_all(texts)
    old = bpe.MOST_WORDS, bpe.CHUNK
    bpe.MOST_WORDS, bpe.CHUNK = 10, 50
    try:
        again, ends = bpe.Codec(bpe.default_path()).encode_all(texts)
    finally:
        bpe.MOST_WORDS, bpe.CHUNK = old
    assert again.tolist() == ids.tolist() and ends.tolist() == bounds.tolist()
    assert whole.decode_all(ids, bounds).to_pylist() == [t or "" for t in texts]
    assert whole.decode(ids[:1].tolist() + [whole.automaton.id_of[b"\xff"]]).endswith("�")
