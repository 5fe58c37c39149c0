"""Language identification with error-correcting output codes.

Every language gets a codeword; one binary n-gram classifier per bit predicts it. The
classifiers are log-odds of hashed character 1- to 3-grams between the languages whose
bit is set and the others. Decoding picks the codeword with the least weighted loss:
each bit's loss counts by how often its classifier was right for that language on the
training sample. A small gap between the two best codewords flags the text ambiguous.

Only a bounded sample of the labelled rows is used to fit (``per_language`` in
expectation, chosen by a hash of doc_id); its n-gram counts are summed by Spark and the
model (orders x buckets x bits) is of fixed size for a given set of languages.
Predictions read every whole text once, without a shuffle.
"""

from __future__ import annotations

import functools
import itertools
import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atrisk.llm.common import small_batches, written

ORDERS = 3
BITS = 15
BUCKETS = 1 << BITS
UND = "und"
#: Positions scored at once.
BLOCK = 1 << 19


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # orders x buckets x bits, float32
    scale: np.ndarray  # bits: the usual size of a margin
    trust: np.ndarray  # languages x bits, rows sum to 1


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts, runs of anything else as one blank, each text in
    blanks; and where each text starts. A text without a letter has length 0."""
    out, sizes = [], []
    for t in texts:
        x = np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[x]
        if not letter.any():
            sizes.append(0)
            continue
        x = np.where(letter, x, 32)
        x = x[letter | np.concatenate([[False], letter[:-1]])]
        x = np.concatenate([[32], x] if x[-1] == 32 else [[32], x, [32]]).astype(np.uint32)
        out.append(x)
        sizes.append(len(x))
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return np.concatenate(out) if out else np.zeros(0, np.uint32), starts


def _grams(x: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that ends at each position; the first order-1 have none."""
    h = np.zeros(len(x) - order + 1, np.uint32)
    for k in range(order):
        h = h * np.uint32(0x01000193) + x[k : len(x) - order + 1 + k] * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


def code_book(n: int) -> np.ndarray:
    """Codewords of n languages: the exhaustive code for up to five, else random dense
    words of about ten bits per doubling, the best of 200 draws by least distance."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:
        bits = [(1, *c) for c in itertools.product((-1, 1), repeat=n - 1)]
        return np.array([b for b in bits if -1 in b], float).T
    rng, best, width = np.random.default_rng(7), None, 10 * int(np.ceil(np.log2(n)))
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, width))
        code = code[:, (code.min(0) < 0) & (code.max(0) > 0)]
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * width
        if best is None or apart.min() > best[0]:
            best = (apart.min(), code)
    return best[1]


def train(docs: DataFrame, *, per_language: int = 1500, smoothing: float = 0.5) -> Model:
    """Fits on rows with text and lang. ``per_language`` bounds the expected sample of each
    language; without labelled rows the model knows no language and predicts ``und``."""
    spark = docs.sparkSession
    small_batches(spark)
    labelled = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    # one row per language
    counts = {r["lang"]: r["n"] for r in docs.filter("text is not null and lang is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    code = code_book(len(languages))
    if not languages:
        return Model([], code, np.zeros((ORDERS, BUCKETS, 0), np.float32), np.ones(0), np.ones((0, 0)))
    draw = F.xxhash64("doc_id", "text", F.lit("language sample")).cast("double") / 2.0**64 + 0.5
    keep = F.lit(False)
    for name in languages:
        share = min(1.0, per_language / counts[name])
        keep = keep | ((F.col("lang") == name) & (draw < share))
    sample = written(labelled.filter(keep).select("text", "lang"), "language-sample")
    place = {name: i for i, name in enumerate(languages)}

    def count(batches):
        total = np.zeros((len(place), ORDERS * BUCKETS), np.int64)
        for batch in batches:
            lang = np.array([place[v] for v in batch.column(1).to_pylist()], int)
            x, starts = _symbols(batch.column(0).to_pylist())
            owner = np.repeat(np.arange(len(lang)), np.diff(starts))
            for order in range(1, ORDERS + 1):
                if len(x) < order:
                    continue
                inside = owner[: len(x) - order + 1] == owner[order - 1 :]
                g = _grams(x, order)[inside].astype(np.int64)
                of = lang[owner[: len(inside)][inside]]
                total += np.pad(np.bincount(of * BUCKETS + g, minlength=len(place) * BUCKETS).reshape(len(place), BUCKETS), ((0, 0), ((order - 1) * BUCKETS, (ORDERS - order) * BUCKETS)))
        who, what = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(who.astype(np.int32)), pa.array(what.astype(np.int32)), pa.array(total[who, what])], names=["lang", "gram", "n"])

    # at most languages x orders x buckets rows, whatever the sample
    summed = sample.mapInArrow(count, "lang int, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((len(languages), ORDERS * BUCKETS))
    table[summed.column("lang").to_numpy(), summed.column("gram").to_numpy()] = summed.column("n").to_numpy()
    table = table.reshape(len(languages), ORDERS, BUCKETS) + smoothing
    chance = table / table.sum(2, keepdims=True)
    weights = np.zeros((ORDERS, BUCKETS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        weights[:, :, b] = np.log(chance[code[:, b] > 0].mean(0) / chance[code[:, b] < 0].mean(0))
    model = Model(languages, code, weights, np.ones(code.shape[1]), np.ones_like(code))
    if not code.shape[1]:
        return model
    shared = spark.sparkContext.broadcast(model)

    def judge(batches):
        n = np.zeros((len(place), 1))
        right, size = np.zeros((2, *code.shape))
        for batch in batches:
            margins, _ = _margins(batch.column(0).to_pylist(), shared.value)
            for m, v in zip(margins, batch.column(1).to_pylist(), strict=True):
                i = place[v]
                n[i] += 1
                right[i] += m * code[i] > 0
                size[i] += abs(m)
        who, bit = np.indices(code.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(who.astype(np.int32)), pa.array(bit.astype(np.int32)), *(pa.array(np.broadcast_to(v, code.shape).reshape(-1).astype(float)) for v in (n, right, size))], names=["lang", "bit", "n", "good", "size"])

    # languages x bits rows
    judged = sample.mapInArrow(judge, "lang int, bit int, n double, good double, size double").groupBy("lang", "bit").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("size").alias("size")).collect()
    n, good, size = np.zeros((3, *code.shape))
    for r in judged:
        n[r["lang"], r["bit"]], good[r["lang"], r["bit"]], size[r["lang"], r["bit"]] = r["n"], r["good"], r["size"]
    model.scale = np.maximum(size.sum(0) / np.maximum(n.sum(0), 1), 1e-6)
    trust = (good + 1) / (n + 2)
    model.trust = trust / trust.sum(1, keepdims=True)
    return model


def _margins(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The mean weight of each text's n-grams for every bit, and which texts have a letter."""
    x, starts = _symbols(texts)
    sizes = np.diff(starts)
    n, bits = len(texts), model.weights.shape[2]
    total, grams = np.zeros((n, bits)), np.zeros(n)
    owner = np.repeat(np.arange(n), sizes)
    for order in range(1, ORDERS + 1):
        for at in range(0, max(0, len(x) - order + 1), BLOCK):
            part = x[at : at + BLOCK + order - 1]
            own = owner[at : at + len(part) - order + 1]
            inside = own == owner[at + order - 1 : at + len(part)]
            g, own = _grams(part, order)[inside], own[inside]
            if not len(g):
                continue
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            w = model.weights[order - 1]
            for b in range(bits):
                total[own[first], b] += np.add.reduceat(w[:, b][g], first, dtype=np.float64)
            grams[own[first]] += np.diff(np.concatenate([first, [len(own)]]))
    return total / np.maximum(grams, 1)[:, None], sizes > 0


def decode(margins: np.ndarray, model: Model, ambiguity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest codeword of each row, its score (0 to 1) and whether it is ambiguous."""
    if len(model.languages) < 2:
        return np.zeros(len(margins), int), np.ones(len(margins)), np.zeros(len(margins), bool)
    f = margins / model.scale
    loss = np.stack([(np.log1p(np.exp(-2 * f * c)) * t).sum(1) for c, t in zip(model.code, model.trust, strict=True)], 1)
    near = np.exp(4 * (loss.min(1, keepdims=True) - loss))
    score = 1 / near.sum(1)
    two = np.sort(loss, 1)[:, :2]
    return loss.argmin(1), score, two[:, 1] - two[:, 0] < ambiguity


def predict(docs: DataFrame, model: Model, *, ambiguity: float = 0.02) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` of every row from its whole text alone.

    A null text, or one without a letter, is ``und`` with score 0. Repeated rows repeat;
    a null doc_id stays null; other columns are ignored. Equal texts give equal results.
    """
    return label(docs.select("doc_id", "text"), model, ambiguity=ambiguity).drop("text")


def label(docs: DataFrame, model: Model, *, ambiguity: float = 0.02, names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """All columns of ``docs`` and the prediction under ``names``, which may replace columns."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for batch in batches:
            margins, known = _margins(batch.column(at).to_pylist(), m)
            best, score, unsure = decode(margins, m, ambiguity)
            known = known & bool(m.languages)
            name = [m.languages[i] if k else UND for i, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(unsure | ~known)], names=[*batch.schema.names, *names])

    schema = T.StructType(list(docs.schema.fields))
    for name, kind in zip(names, ("string", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)
