"""Removal of repeated substrings against a table of all windows."""

import hashlib
import random
from collections import Counter

import pytest

pytest.importorskip("atrisk.llm")

import numpy as np  # noqa: E402

from atrisk.llm import queries, substrings  # noqa: E402

SIZE = substrings.SIZE


def brute(rows):
    raws = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(r[i : i + SIZE] for _, r in raws for i in range(len(r) - SIZE + 1))
    out = []
    for d, r in raws:
        gone = np.zeros(len(r) + 1, np.int64)
        for i in range(len(r) - SIZE + 1):
            if seen[r[i : i + SIZE]] > 1:
                gone[i] += 1
                if i + SIZE < len(gone):
                    gone[i + SIZE] -= 1
        gone = np.cumsum(gone)[: len(r)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(r), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def got(df):
    return sorted((tuple(r[c.split()[0]] for c in substrings.RESULT.split(", ")) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, t1 int, key string")


def cases():
    rng = random.Random(11)
    words = [f"{''.join(rng.choice('abcdeé') for _ in range(rng.randint(2, 7)))}" for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [say(rng.choice([30, 100, 300, 900])) for _ in range(25)]
    out = list(base)
    for t in base:  # near copies: some words changed
        w = t.split()
        for _ in range(len(w) // 70):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    passage, short = say(90), say(60)
    exact = passage.encode()[:SIZE].decode("utf-8", "ignore")
    out += [say(20) + passage[:500] + say(rng.randint(5, 60)) for _ in range(40)]  # one passage in many
    out += [say(30) + exact + "xy" + say(10), say(9) + exact + "zz" + say(40), say(5) + exact[1:] + say(5)]
    out += [short * 3, "a" * 2000, "a" * 399, "a" * 400, "b" * 400, "c" * 401, "ab" * 900 + say(50), say(10) + "ab" * 300, "xyz" * 134 + "q"]
    out += [None, "", " ", base[3], base[3], base[4] + base[4]]
    return list(enumerate(out))


@pytest.mark.parametrize("stretches", [1024, 3])
def test_matches_brute_force(spark, monkeypatch, stretches):
    monkeypatch.setattr(substrings, "STRETCHES", stretches)
    rows = cases()
    assert got(substrings.remove_repeats(frame(spark, rows))) == sorted(brute(rows), key=repr)


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    result = queries.queries()["op11_suffix_dedup"](spark, "/root/testdata/sf0.001")
    assert got(result) == sorted(brute([(d.doc_id, d.text) for d in docs]), key=repr)


def test_null_and_repeated_ids_and_empty_table(spark):
    rows = [(None, "q" * 500), (1, "once " * 30), (1, "once " * 30), (2, None)]
    assert got(substrings.remove_repeats(frame(spark, rows))) == sorted(brute(rows), key=repr)
    assert got(substrings.remove_repeats(frame(spark, []))) == []


def test_a_very_long_text_is_scanned_in_pieces(spark):
    rng = np.random.default_rng(2)
    long = rng.integers(97, 123, (1 << 21) + 5000, np.uint8).tobytes().decode()
    at = (1 << 21) - 300
    rows = [(1, long), (2, long[at : at + 700] + "end"), (3, long[100:450])]
    removed = {d: n for d, _, n, _, _ in got(substrings.remove_repeats(frame(spark, rows)))}
    assert removed == {1: 700, 2: 700, 3: 0}


def test_suffix_array_and_prefixes():
    rng = random.Random(4)
    for _ in range(60):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 60))).encode() * rng.choice([1, 1, 3]) for _ in range(rng.randint(1, 8))]
        raw, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
        suffixes = [(t[i:], k, i) for k, t in enumerate(texts) for i in range(len(t))]
        place = {(k, i): int(ends[k]) - len(texts[k]) + i for k, t in enumerate(texts) for i in range(len(t))}
        order = substrings.suffix_array(raw, ends)
        want = sorted(suffixes)
        assert order.tolist() == [place[k, i] for _, k, i in want]
        common = [0] + [next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for (a, _, _), (b, _, _) in zip(want, want[1:], strict=False)]
        assert substrings.kasai(raw, ends, order, 20).tolist() == [min(c, 20) for c in common]


def test_what_is_left_is_given_beside_its_digest(spark):
    rows = cases()
    for r in substrings.remove_repeats(frame(spark, rows)).collect():
        assert len(r.kept) == r.n_bytes - r.n_removed and hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    given = {d.doc_id: d.text or "" for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    result = queries.queries()["op11_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert len(result) == len(given) and {r.n_removed > 0 for r in result} == {True, False}
    for r in result:
        assert r.text == given[r.doc_id] if not r.n_removed else len(r.text.encode()) <= r.n_bytes - r.n_removed + 4 * (r.n_spans + 1)
