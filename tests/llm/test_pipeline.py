"""The pipeline's stages, each on what its predecessor kept, against brute force."""

import re
import zlib
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from atrisk.llm import langid
from atrisk.llm.common import table, written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before the first stage and after each, as dicts."""
    docs = table(spark, SF, "documents")
    out = [("documents", docs.columns, [r.asDict() for r in docs.collect()])]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs.columns, [r.asDict() for r in docs.collect()]))
    return out


def rows(stages, name):
    return next(r for n, _, r in stages if n == name)


def same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


def test_order_and_columns(stages):
    assert [n for n, *_ in stages] == ["documents", "language", "near_duplicates", "personal_data", "packing"]
    assert all(columns == stages[0][1] for _, columns, _ in stages[:-1])


def test_language_keeps_rows_with_a_clear_language(spark, stages):
    docs = table(spark, SF, "documents")
    known = {r["doc_id"]: r for r in langid.predict(docs, langid.train(docs)).collect()}
    want = [r for r in rows(stages, "documents") if known[r["doc_id"]]["lang_pred"] != langid.UND and not known[r["doc_id"]]["ambiguous"]]
    assert same(rows(stages, "language"), want)
    lettered = [r for r in rows(stages, "documents") if r["text"] and any(c.isalpha() for c in r["text"])]
    assert len(want) >= 0.9 * len(lettered)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates_keeps_the_smallest_of_each_group(stages):
    before = rows(stages, "language")
    sets = [shingles(r["text"]) for r in before]
    root = list(range(len(before)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(before)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(before):
        groups.setdefault(find(i), []).append(r)
    assert any(len(g) > 1 for g in groups.values())
    assert same(rows(stages, "near_duplicates"), [min(g, key=lambda r: r["doc_id"]) for g in groups.values()])


def test_personal_data_changes_only_texts_that_hold_some(stages):
    before, after = ({r["doc_id"]: r for r in rows(stages, n)} for n in ("near_duplicates", "personal_data"))
    assert set(before) == set(after)
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z]")
    for i, r in before.items():
        assert {k: r[k] for k in ("lang", "source")} == {k: after[i][k] for k in ("lang", "source")}
        # n_chars follows a text whose surrogates are longer
        assert after[i]["n_chars"] == (r["n_chars"] if after[i]["text"] == r["text"] else len(after[i]["text"]))
        found = set(mail.findall(r["text"] or ""))
        assert not found & set(mail.findall(after[i]["text"] or "")) and len(found) == len(set(mail.findall(after[i]["text"] or "")))
        if not re.search(r"[@0-9]|\b[A-Z]\w+\.? [A-Z]", r["text"] or ""):
            assert after[i]["text"] == r["text"]


def test_packing_holds_every_id_once(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    packed = rows(stages, "packing")
    pieces, used = {}, {}
    for p in packed:
        pieces.setdefault(p["doc_id"], []).append(p)
        used.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    before = rows(stages, "personal_data")
    assert set(pieces) == {r["doc_id"] for r in before}
    for r in before:
        ids, at = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], 0
        for p in sorted(pieces[r["doc_id"]], key=lambda p: p["start"]):
            part = array("I", ids[at : at + p["length"]]).tobytes()
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(part)
            at += p["length"]
        assert at == len(ids)
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_gives_the_last_stage(spark, stages):
    got = [r.asDict() for r in corpus_pipeline.run(spark, SF).collect()]
    place = {"sequence_id", "offset", "start", "length", "ids_crc32", "loss_tokens"}  # depend on how the input is split
    plain = lambda rs: {tuple(sorted((k, v) for k, v in r.items() if k not in place)) for r in rs}
    assert plain(got) == plain(rows(stages, "packing"))
    assert sum(r["length"] for r in got) == sum(r["length"] for r in rows(stages, "packing"))
