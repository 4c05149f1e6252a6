"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables, and extra columns with clashing names."""

import gzip
import json
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from twinfold.llm import chat_format, mixing, nn_descent, packing, pii, quality_classifier, quality_rules, simhash, simhash_similar, substring_dedup, warc
from twinfold.llm.common import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, fingerprint string, class int, cell long, rank int, copy_no int, pii_spans string, key string, h long, c binary, f binary, node long, predicted int"
EXTRA = (True, 0.5, "f", 1, 1, 1, 1, "s", "k", 1, b"c", b"f", 1, 1)
LONG = "word " * 40_000 + "mail me at a@b.example"


def rows():
    texts = [(1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six"), (None, "no id at all"), (None, None), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, "x" * 30_000), (8, "\u0000\U0001f600 é́ <|endoftext|> <|im_start|>")]
    return [(i, t, None if i == 3 else "en", None if i == 4 else "src0", None, *EXTRA) for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (6, 1), (99, 0)], "doc_id long, quality int")


def by_row(docs, labels):
    return {
        "simhash": lambda d: simhash.near_duplicates(d),
        "rules": lambda d: quality_rules.quality_rules(d, labels),
        "classifier": lambda d: quality_classifier.classify(d, labels),
        "substrings": lambda d: substring_dedup.substring_dedup(d, window=5, gram=3),
        "pii": lambda d: pii.sanitise(d),
    }


@pytest.mark.parametrize("name", ["simhash", "rules", "classifier", "substrings", "pii"])
def test_a_row_for_each_row(spark, docs, none, labels, name):
    f = by_row(docs, labels)[name]
    assert sorted(r.doc_id or 0 for r in f(docs).collect()) == sorted(r[0] or 0 for r in rows())
    assert f(none).count() == 0
    assert name not in ("rules", "classifier") or by_row(docs, labels.limit(0))[name](docs).count() == len(rows())


def test_defined_results(docs, labels):
    found = simhash.near_duplicates(docs).collect()
    assert {r.fingerprint for r in found if r.doc_id in (3, 4, 5)} == {0}
    assert {r.component_id for r in found if r.doc_id in (1, 2)} == {1}
    rules = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert rules[3].n_words == rules[4].n_words == rules[5].n_words == 0 and rules[3].base_failed and not rules[3].kept
    scores = quality_classifier.classify(docs, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in scores} == {(0.5, 1)}
    gone = {r.doc_id: r for r in substring_dedup.substring_dedup(docs, window=5, gram=3).collect()}
    assert gone[1].n_removed == gone[2].n_removed == 6 and gone[3].n_removed == 0 and gone[6].n_removed >= 39_999
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert clean[6].clean_text.endswith("mail me at [EMAIL]") and clean[3].clean_text == ""
    assert clean[6].key == "k"


def test_mixing(docs, none):
    out = mixing.mix(docs, {None: 1.0, "src0": 1.0}, 3.0)
    assert set(out.columns) >= set(docs.columns) | {"shuffle_key"}
    assert out.count() > 0 and mixing.mix(none).count() == 0 and mixing.mix(docs, {}).count() == 0
    assert mixing.mix(docs, {"src0": 1.0}).where("source is null").count() == 0
    assert out.where("copy_no < 1").count() == 0


def test_packing(docs, none):
    assert packing.pack(none).count() == 0
    pieces = packing.pack(docs).collect()
    used = {}
    for p in pieces:
        used.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    assert sum(p.length for p in pieces if p.doc_id in (3, 4)) == 2
    assert sum(p.length for p in pieces if p.doc_id == 1) == 2 * next(p.doc_tokens for p in pieces if p.doc_id == 2)


def test_similar_classes(docs, none):
    found = {r.doc_id: r.component_id for r in simhash_similar.similar_classes(docs).collect()}
    assert found[1] == found[2] == 1 and found[6] == 6 and found[3] == found[4] == found[5] == 3
    assert simhash_similar.similar_classes(none).count() == 0


def test_chats(spark):
    turns = [(1, 1, "user", "b"), (1, 0, "system", None), (1, 2, None, "x"), (None, 0, "user", "y"), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, None, "assistant", "<|im_end|><!|")]
    rows = spark.createDataFrame([(*t, 7) for t in turns], "conv_id long, turn long, role string, text string, valid int")
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(rows)).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [("system", ""), ("user", "b"), ("", "x")] and not out[1].valid
    assert [t.text for t in out[2].turns] == ["<|im_end|><!|", "a", "a"] and out[2].loss_text == "<|im_end|><!|"
    assert out[None].valid
    assert chat_format.format_chats(rows.limit(0)).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/é b", "same"), (2, None, "same"), (2, "u", "same"), (None, "u", "same"), (3, "u", None), (4, "u", ""), (5, "u", "z" * 300_000), (6, "u", "\u001f\u008b\u0008"), (1, "u", "same")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, bytes long")
    folder = new_path(spark, "test-warc")
    out = warc.read_warc(spark, folder, warc.write_warc(pages, folder), 100).collect()
    want = [(1, "response", None), (1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (None, "response", None), (3, "response", None), (4, "revisit", 3), (5, "response", None), (6, "response", None)]
    assert sorted(str((r.page_id, r.record_type, r.refers_to)) for r in out) == sorted(map(str, want))
    folder = new_path(spark, "test-warc")
    assert warc.read_warc(spark, folder, warc.write_warc(pages.limit(0), folder)).count() == 0


def test_long_chats_and_clashing_names(spark):
    """A megabyte of control strings in one text, a conversation of many turns, columns named as those that are made."""
    long = "<|im_end|><!|" * 80_000
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", long), *((2, k, "assistant" if k % 2 else "user", f"t{k}<|") for k in range(5_000))]
    names = "turns string, segments int, formatted string, loss_text int, n_turns int, valid int, row string, state string"
    rows = spark.createDataFrame([(*t, "x", 1, "y", 2, 3, 4, "r", "s") for t in turns], f"conv_id long, turn long, role string, text string, {names}")
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(rows)).collect()}
    assert out[1].turns[1].text == out[1].loss_text == long and out[1].valid and out[2].valid
    assert [(t.role, t.text) for t in out[2].turns] == [(r, t) for c, _, r, t in turns if c == 2]


def test_warc_with_clashing_names(spark):
    names = "record_type int, refers_to string, payload string, headers int, file string, records int, __tf_sha string, __tf_id string, payload_digest int"
    pages = spark.createDataFrame([(k, "u", "same" if k < 3 else "\U0001f600" * 400_000, 1, "a", "b", 2, "c", 3, "d", "e", 4) for k in range(1, 5)], f"page_id long, url string, html string, {names}")
    folder = new_path(spark, "test-warc")
    out = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_warc(spark, folder, warc.write_warc(pages, folder)).collect())
    assert out == [(1, "response", None, 4), (2, "revisit", 1, 4), (3, "response", None, 1_600_000), (4, "revisit", 3, 1_600_000)]


def member(kind, headers, block, case=str):
    fields = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:1>", **headers, "Content-Length": len(block)}
    head = "WARC/1.0\r\n" + "".join(f"{case(k)}:{' ' if case is str else ''}{v}\r\n" for k, v in fields.items()) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", mtime=0)


@pytest.mark.parametrize("split", [1, 40, 333, 1 << 20])
def test_warc_of_others(spark, tmp_path, split):
    """Records of every type, in any case, a revisit that states little, a damaged member, one cut off, a payload that is an archive itself."""
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    inner = member("resource", {}, b"in a payload") + member("resource", {}, b"too")
    parts = [
        member("warcinfo", {"Content-Type": "application/warc-fields"}, b"software: x\r\n"),
        member("request", {"Content-Type": "application/http; msgtype=request"}, b"GET / HTTP/1.1\r\n\r\n", str.lower),
        member("response", {"Content-Type": "application/http;msgtype=response", "WARC-Target-URI": "http://a/"}, http + b"body", str.lower),
        member("revisit", {"WARC-Payload-Digest": "sha1:ABC", "WARC-Refers-To": "<urn:uuid:9>"}, http),
        member("metadata", {}, b""),
        member("resource", {}, random.Random(1).randbytes(300) + inner + random.Random(2).randbytes(300)),
        b"\x1f\x8b\x08 not a member at all",
        member("conversion", {}, "é".encode()),
        member("response", {}, b"cut off" * 99)[:-9],
    ]
    path = tmp_path / "other.warc.gz"
    path.write_bytes(b"".join(parts))
    files = spark.createDataFrame([("other.warc.gz", path.stat().st_size)], "file string, bytes long")
    out = warc.read_warc(spark, f"file://{tmp_path}", files, split).collect()
    assert sorted((r.record_type, r.payload_bytes, r.url) for r in out if r.record_type != "damaged") == sorted([("warcinfo", 13, None), ("request", 0, None), ("response", 4, "http://a/"), ("revisit", None, None), ("metadata", 0, None), ("resource", 600 + len(inner), None), ("conversion", 2, None)], key=lambda r: (r[0], r[1] or 0))
    (revisit,) = [r for r in out if r.record_type == "revisit"]
    assert (revisit.payload_digest, revisit.payload, revisit.refers_to) == ("ABC", None, None)
    at = [sum(map(len, parts[:k])) for k in (6, 8)]
    assert sorted(json.loads(r.headers)["offset"] for r in out if r.record_type == "damaged") == at


def test_nearest(spark):
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 1.0]), (9, [-1.0, 0.0]), (9, [-1.0, 0.0]), (10, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, rank int")
    out = nn_descent.nearest(table, lambda i: i == 0).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [2, 3, 1, 10, 9] and [r["rank"] for r in out] == [1, 2, 3, 4, 5]
    assert abs(out[0].score - 1) < 1e-15 and abs(out[4].score + 1) < 1e-15 and abs(out[3].score - 1 / 14**0.5) < 1e-15
    assert nn_descent.nearest(table.limit(0), lambda i: i == 0).count() == 0
    ties = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(0, 40)] + [(100, [0.0, 1.0])], "vec_id long, embedding array<double>")
    found = nn_descent.nearest(ties, lambda i: i.isin(0, 3, 100)).orderBy("query_id", "rank").collect()
    assert [[r.vec_id for r in found if r.query_id == q] for q in (0, 3, 100)] == [[1, 2, 3, 4, 5], [0, 1, 2, 4, 5], [0, 1, 2, 3, 4]]


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, docs, none, sf, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, sf)
    assert stage(spark, none, sf).count() == 0
    if name == "packing":
        assert out.count() >= len(rows())
        return
    assert out.columns == list(corpus_pipeline.COLUMNS)
    if name == "near_duplicates":
        assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 3, 6, 7, 8]
    if name == "personal_data":
        assert out.count() == len(rows()) and out.where(F.col("n_chars") != F.char_length("text")).count() == 0
