"""Cross-tokenizer alignment against the libraries and loops over tokens."""

import hashlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("atrisk.llm")

import numpy as np  # noqa: E402
import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from atrisk.llm import align, queries  # noqa: E402
from atrisk.llm.packing import byte_letters  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n b \nc", "x\x00y", "▁ ▁a", "Ünï <|endoftext|> <s> don't  STOP", "日本語 текст 🙂🙂 é",
    "a  b", "a   b", "a " * 40, "\n\n", "tab\t \tx", "the quick brown fox " * 2000, "z" * 5000, "1234567 " * 9 + "9",
]


def brute(texts):
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    docs, held = [], Counter()
    for t in texts:
        groups = []
        if t:
            a, b = tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
            raw_a = [bytes(byte_of[c] for c in tok.id_to_token(i)) for i in a]
            raw_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [sp.id_to_piece(i)]]
            raw = (" " + t).encode()
            if b"".join(raw_a) == raw == b"".join(raw_b):
                ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
                at_a = at_b = 0
                for cut in sorted(set(ends_a) & set(ends_b)):
                    x, y = [], []
                    while at_a < len(a) and ends_a[at_a] <= cut:
                        x.append(a[at_a])
                        at_a += 1
                    while at_b < len(b) and ends_b[at_b] <= cut:
                        y.append(b[at_b])
                        at_b += 1
                    groups.append((x, y))
        links = Counter((i, j) for x, y in groups for i in x for j in y)
        held.update(links.keys())
        docs.append((groups, links))
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    out = []
    for k, (groups, links) in enumerate(docs):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((k, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == most[p[0]]),
                    sum(n * held[p] for p, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


def rows(df):
    names = [c.split()[0] for c in align.RESULT.split(", ")][:8]
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("block", [1 << 23, 300])
def test_odd_texts_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(align, "BLOCK", block)
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(ODD)], "doc_id long, text string, n_a int, block string")
    assert rows(align.alignments(docs, A, B)) == brute(ODD)


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    got = queries.queries()["op13_token_alignment"](spark, "/root/testdata/sf0.001")
    assert [r[1:] for r in rows(got)] == [r[1:] for r in brute([d.text for d in docs])]


def test_empty_table_null_and_repeated_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert align.alignments(empty, A, B).collect() == []
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one")], "doc_id long, text string")
    got = align.alignments(docs, A, B).collect()
    assert len(got) == 3 and len({r for r in got if r.doc_id == 1}) == 1 and [r.n_a for r in got if r.doc_id is None] == [1]


@pytest.mark.parametrize("products", [1, 5, 1 << 20])
def test_row_products_are_the_matrix_product(products):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 3, (7, 5)), rng.integers(0, 3, (5, 6))

    def sparse(m):
        i, j = np.nonzero(m)
        return align.Csr(np.concatenate([[0], np.cumsum(np.bincount(i, minlength=len(m)))]), j, m[i, j], m.shape[1])

    out = np.zeros((7, 6), int)
    for r, c, v in align.gustavson(sparse(x), sparse(y), products):
        out[r, c] = v
    assert (out == x @ y).all()


def test_overlap_links_share_bytes(spark):
    text = "Réorganisation of the unbelievable 12345"
    got = align.overlap_links(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), A, B).collect()
    assert sum(r.n_bytes for r in got) == len((" " + text).encode())
    total = align.alignments(spark.createDataFrame([(1, text)], "doc_id long, text string"), A, B).first()
    assert total.n_overlaps == len(got) and total.n_overlaps <= total.n_links
