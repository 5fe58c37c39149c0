"""Empty tables, clashing columns, long texts and repeated rows for the corpus operators, and the
fingerprints' errors on both similarities."""

import hashlib
import random
from collections import Counter

import pytest

pytest.importorskip("atrisk.llm")

import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from atrisk.llm import bpe, chat, fingerprint, langid, media, packing, pii, substrings, urlfilter  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names of result or inner columns that a table may have, too.
CLASHES = ["score", "lang_pred", "ambiguous", "held_out", "root", "fingerprint", "n_tokens", "n_bytes", "payload_bytes", "feature", "sequence_id", "offset", "start", "length", "kept_rows", "kept_id", "cluster", "level", "id", "key", "value", "__n"]
WORD = "word_bpe_49k.json"


def docs(spark, texts, clashes=False):
    df = spark.createDataFrame([(i, t, "en" if i % 2 else "ca", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    return df.withColumns({c: F.lit("mine") for c in CLASHES}) if clashes else df


def operators():
    return {
        "language": lambda d: langid.predict(d, langid.train(d)),
        "personal": lambda d: pii.replace(d, "k"),
        "media": media.media_columns,
        "fingerprints": lambda d: fingerprint.fingerprints(d, 8),
        "bpe": lambda d: bpe.digests(d, public_tokenizers.path(WORD)),
        "packing": lambda d: packing.pack_documents(d, public_tokenizers.path("byte_bpe_50k.json")),
        "suffixes": substrings.remove_repeats,
    }


@pytest.mark.parametrize("name", list(operators()))
def test_empty_tables_and_clashing_columns(spark, name):
    run = operators()[name]
    empty = run(docs(spark, []))
    assert empty.count() == 0
    texts = ["Bon dia a tothom, com esteu avui", "the quick brown fox and the dog", None, "", "Write to ann.lee@example.org now"]
    plain, clashing = run(docs(spark, texts)), run(docs(spark, texts, clashes=True))
    own = [*(CLASHES if name == "personal" else []), *(["shard"] if name == "media" else [])]  # a run has its own shards
    shared = [c for c in plain.columns if c not in own]
    rows = lambda df: sorted((tuple(r) for r in df.select(shared).collect()), key=repr)
    assert rows(plain) == rows(clashing)


def test_empty_captures_and_calls(spark):
    captures = spark.createDataFrame([], "page_id long, url string, fetched_at timestamp")
    entries = spark.createDataFrame([], "list string, key string, at timestamp, action string")
    assert urlfilter.filter_captures(captures, entries).count() == 0
    some = spark.sql("select 1L as page_id, 'http://a.example/' as url, timestamp'2024-01-01' as fetched_at union all select 2L, null, null")
    assert {r["page_id"]: r["lists"] for r in urlfilter.filter_captures(some, entries).collect()} == {1: [], 2: []}
    assert urlfilter.filter_captures(some.withColumn("url", F.concat("url", F.lit("x" * 50_000))), entries).count() == 2
    calls = spark.createDataFrame([], "call_id string, conv_id long, turn long, tool string, arguments string, parent string")
    assert chat.link(calls, spark.createDataFrame([], "call_id string, content string")).count() == 0


def test_long_texts(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice(["aigua", "foc", "terra", "vent"]) for _ in range(120_000))
    table = docs(spark, [long, "the rain in the plain", long, "x" * 400_000])
    seen = {r["doc_id"]: r["lang_pred"] for r in langid.predict(table, langid.train(table)).collect()}
    assert seen[0] == seen[2] == "ca" and set(seen) == {0, 1, 2, 3}
    prints = {r["doc_id"]: r for r in fingerprint.fingerprints(table, 8).collect()}
    assert prints[0]["fingerprint"] == prints[2]["fingerprint"] != "" and prints[3]["n_chars"] == 400_000


def test_fingerprint_errors_of_both_similarities(spark):
    """64 samples of a similarity s have a standard error of sqrt(s(1-s)/64), at most 0.0625."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(150)]
    given, last = [], []
    for _ in range(60):  # neighbours share from none to all of their words
        keep = rng.random()
        last = [w for w in last if rng.random() < keep] + [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        last = last[:200]
        given.append(" ".join(last))
    got = sorted(fingerprint.fingerprints(docs(spark, given), 64).collect(), key=lambda r: r["doc_id"])
    bag = lambda t: Counter(t.split())
    exact = lambda a, b: sum((bag(a) & bag(b)).values()) / sum((bag(a) | bag(b)).values())
    errors = {"near_edited": [], "near_next": []}
    for i, text in enumerate(given):
        after = given[(i + 1) % len(given)]
        m = len(text) // 4
        edited = text[: len(text) - m] + after[:m]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors["near_edited"].append(got[i]["near_edited"] - exact(text, edited))
        errors["near_next"].append(got[i]["near_next"] - exact(text, after))
    for e in errors.values():
        assert sum(map(abs, e)) / len(e) < 0.075 and max(map(abs, e)) < 0.3 and abs(sum(e) / len(e)) < 0.03


@pytest.mark.parametrize("texts", [[], [None, "", "  "], ["el mateix text de sempre per a tothom"] * 7])
def test_pipeline_of_bare_tables(spark, tmp_path, texts):
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {r["doc_id"] for r in rows} == ({0} if texts and texts[0] else set())
