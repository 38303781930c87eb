"""Every corpus operator on awkward tables: nulls in any column, empty and very long texts, repeated rows, ties, empty tables, clashing columns."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from .test_brute import DOCS, LOW, WORD, public_tokenizers

CLASH = ["ids", "key", "n", "n_words", "words", "piece", "start", "length", "_part", "_rank", "_length", "_from", "spans0", "item_ids", "text_key", "component", "hash", "kept0", "value", "batch", "file"]
PASSAGE = "one two three four five six seven eight nine ten eleven"
RNG = random.Random(5)
LONG = " ".join(RNG.choice(["aa", "bb", "cc", "dd", "ee"]) + str(RNG.randrange(400)) for _ in range(120_000)) + " " + PASSAGE
ROWS = [
    (1, "a b c d e f g h", "en", "s", 15),
    (1, "a b c d e f g h", "en", "s", 15),
    (2, "some words with token = 'abcdef0123456789abcd' here", None, None, None),
    (2, "another text of the same id " + PASSAGE, "en", "s", 3),
    (3, None, "en", "s", None),
    (4, "", "en", "s", 0),
    (None, "a row without an id " + PASSAGE, None, "s", 9),
    (None, None, None, None, None),
    (5, LONG, "en", "s", len(LONG)),
    (6, "  \t\n ", "en", "s", 5),
]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("awkward") / "documents.parquet")
    spark.createDataFrame(ROWS, DOCS).withColumns({c: F.lit("x") for c in CLASH}).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("doc_id = -1")


def found(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def words(text):
    return WORD.findall(text or "")


def test_quality(docs, nothing):
    from plumbline.llm.repetition import keep_good, quality_report

    def base(text):
        w = words(text)
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        return len(w), sum(map(len, w)), len(hit)

    want = Counter((i, *base(t)) for i, t, *_ in ROWS)
    assert found(quality_report(docs), "doc_id", "n_words", "word_chars", "n_repeat_words") == want
    kept = keep_good(docs)
    assert kept.columns == docs.columns and kept.count() > 0
    assert quality_report(nothing).count() == keep_good(nothing).count() == 0


def test_token_files(docs, nothing, tmp_path):
    from tokenizers import Tokenizer

    from plumbline.llm.token_files import read_token_files, write_token_files

    path = public_tokenizers.path("byte_bpe_50k.json")
    ref = Tokenizer.from_file(path)
    crc = lambda t: zlib.crc32(np.array([*ref.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    out = read_token_files(write_token_files(docs, f"file://{tmp_path}/a", path, 0, sequence=512), f"file://{tmp_path}/a").select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).collect()
    assert Counter((r["doc_id"], r["crc"]) for r in out) == Counter((i, crc(t)) for i, t, *_ in ROWS)
    at = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert read_token_files(write_token_files(nothing, f"file://{tmp_path}/b", path, 0), f"file://{tmp_path}/b").count() == 0


def test_decontamination(spark, docs, nothing):
    from plumbline.llm.decontamination import contamination, remove_spans

    items = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, None), (None, "six seven"), (3, "")], "item_id long, text string").withColumns({c: F.lit("x") for c in CLASH})
    hit = lambda t: 11 if t and PASSAGE in t else 0
    got = contamination(docs, items)
    assert found(got, "doc_id", "n_hit") == Counter((i, hit(t)) for i, t, *_ in ROWS)
    none = items.where("item_id = 9")
    assert found(contamination(docs, none), "doc_id", "n_hit") == Counter((i, 0) for i, *_ in ROWS)
    assert contamination(nothing, items).count() == 0
    cleaned = remove_spans(docs, items)
    assert cleaned.columns == docs.columns and not any(PASSAGE in (r["text"] or "") for r in cleaned.collect())
    assert remove_spans(docs, none).count() == len(ROWS)


def test_chat(spark):
    from plumbline.llm.chat import format_conversations, read_back

    kind = "conv_id long, turn int, role string, text string"
    rows = [(1, 1, "user", "x"), (1, 1, "user", "x"), (1, 1, "assistant", "a"), (2, None, "user", None), (3, 1, None, "y"), (None, 1, "assistant", "z"), (4, 1, "assistant", "long " * 50_000)]
    out = {r["conv_id"]: r for r in read_back(format_conversations(spark.createDataFrame(rows, kind).withColumn("formatted", F.lit("x")))).collect()}
    assert {i: r["n_turns"] for i, r in out.items()} == {1: 3, 2: 1, 3: 1, None: 1, 4: 1}
    assert out[1]["loss_chars"] == 1 and out[4]["loss_chars"] == 250_000 and out[2]["loss_chars"] == 0
    assert read_back(format_conversations(spark.createDataFrame([], kind))).count() == 0


def test_toxicity(spark, docs, nothing):
    from plumbline.llm.toxicity import score, train

    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, None), (None, 1), (99, 0)], "doc_id long, toxic int")
    model = train(docs, labels)
    out = score(docs, model).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, *_ in ROWS)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] == 1}) == 1
    assert score(nothing, model).count() == 0
    assert all(0 <= r["score"] <= 1 for r in score(docs, train(nothing, labels)).collect())


def test_secrets(spark, docs, nothing):
    from plumbline.llm.secrets import labelled_samples, redact, train, with_spans

    model = train(labelled_samples(spark))
    got = with_spans(docs, model).select("doc_id", F.size("base_spans").alias("n")).collect()
    secret = lambda t: len(re.findall("abcdef0123456789abcd", t or "")) * 2
    assert Counter((r["doc_id"], r["n"]) for r in got) == Counter((i, secret(t)) for i, t, *_ in ROWS)
    clean = redact(docs, model)
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    assert with_spans(nothing, model).count() == redact(nothing, model).count() == 0


def test_near_duplicates(docs, nothing):
    from plumbline.llm.near_duplicates import keep_one, near_duplicates

    def size(text):
        w = words((text or "").translate(LOW))
        return len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0

    got = near_duplicates(docs).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add(r["n_shingles"])
    assert by_id[1] == {4} and by_id[3] == {0} and by_id[4] == {0} and by_id[5] == {size(LONG)}
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    texts = Counter(r["text"] for r in kept.select("text").collect())
    assert set(texts) >= {t for _, t, *_ in ROWS if size(t)} and texts[ROWS[0][1]] == 1
    assert near_duplicates(nothing).count() == keep_one(nothing).count() == 0


def test_scores(docs, nothing):
    from plumbline.llm.lm import build, score

    tokens = [[*words((t or "").translate(LOW)), None] for _, t, *_ in ROWS]
    counts = Counter(w for t in tokens for w in t)
    n, v = sum(counts.values()), len(counts)
    base = [round(float(sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)), 3) for t in tokens]
    trie = build(docs)
    out = score(docs, trie).collect()
    near = lambda x: round(x, 1)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], near(r["base_score"])) for r in out) == Counter((i, len(t), len(t), near(b)) for (i, *_), t, b in zip(ROWS, tokens, base))
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in out)
    assert score(nothing, trie).count() == 0


def test_packing(docs, nothing):
    from plumbline.llm.packing import pack, token_pieces

    path = public_tokenizers.path("word_bpe_49k.json")
    out = pack(token_pieces(docs, path, end_id=1)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out if r["piece"] == 0) == sorted((i is None, i or 0) for i, *_ in ROWS)
    used = {}
    for r in out:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert pack(token_pieces(nothing, path, end_id=1)).count() == 0


def test_pipeline_stages(spark, docs, nothing, tmp_path):
    cp = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in cp.STAGES:
        for table in (docs, nothing):
            out = stage(spark, table, str(tmp_path))
            assert (out.count() > 0) == (table is docs), name
