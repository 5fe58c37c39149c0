"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A document is the multiset of its lower-cased words, a term's weight S its count. For
each of k samples a term draws r and c from Gamma(2, 1) and beta from [0, 1), all fixed
by the term and the sample's number; with t = floor(ln S / r + beta) the term offers

    ln a = ln c - r (t - beta) - r

and the smallest offer is the sample. Two documents agree in a sample with a chance of
their generalised Jaccard similarity, sum(min) / sum(max) of the term weights. An offer
depends on term, t and the sample alone, so the minimum itself stands for (term, t).
The gamma quantiles are read from tables made from the distribution by rule, with a
finer one for the tail that decides the minimum; beta keeps 40 bits, so offers differ.

Texts are shuffled once, by document; term counts and samples are aggregated within
that partitioning. The next document of each is found from ids alone, in buckets of
bounded size, and sends only the prefix its predecessor asks for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atrisk.llm.common import written

SAMPLES = 64
#: Quantiles in a table.
LEVELS = 256
#: Ids in a bucket, about, when the next of each is looked up.
BUCKET = 50_000
#: Stands for a null doc_id, which comes first in the order.
NO_ID = -(1 << 63)


def _gamma2_quantile(p: float) -> float:
    """x with 1 - (1 + x) exp(-x) = p, by bisection."""
    low, high = 0.0, 60.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if -math.expm1(-mid) - mid * math.exp(-mid) < p else (low, mid)
    return (low + high) / 2


def _tables() -> dict[str, Column]:
    """Mid-quantiles of r, and of ln c with the lowest step divided as finely again, as
    small draws of c decide the minimum."""
    mid = [(i + 0.5) / LEVELS for i in range(LEVELS)]
    return {"r": _lookup([_gamma2_quantile(p) for p in mid]), "c": _lookup([math.log(_gamma2_quantile(p)) for p in mid] + [math.log(_gamma2_quantile(p / LEVELS)) for p in mid])}


def _lookup(values: list[float]) -> Column:
    """A table as one foldable expression: the optimizer makes it a single literal."""
    return F.split(F.lit(",".join(f"{v:.7g}" for v in values)), ",").cast("array<double>")


def offer(term: Column, log_weight: Column, sample: int, tables: dict[str, Column]) -> Column:
    """ln a of a term (a 64-bit hash) with the logarithm of its weight."""
    z = F.xxhash64(term, F.lit(sample))
    byte = lambda shift: F.shiftrightunsigned(z, shift).bitwiseAND(F.lit(LEVELS - 1)).cast("int")
    beta = z.bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    c = F.get(tables["c"], F.when(byte(56) == 0, byte(48) + LEVELS).otherwise(byte(56)))
    r = F.get(tables["r"], byte(40))
    return c - r * (F.floor(log_weight / r + beta) - beta + 1)


def _counts(rows: DataFrame, key: str, kept: str, tail: str, replaced: str) -> DataFrame:
    """``key, __term, own, edit``: how often a term occurs in the text, kept + tail, and in
    the edited text, kept + replaced. What is kept is split into words once for both; its
    last word may go on in either, so it is counted with them. Words are lower-cased one by
    one, so that a word's form never depends on where a text was cut."""
    last = F.reverse(F.regexp_extract(F.reverse(kept), r"^[\p{L}\p{N}]*", 0))
    parts = F.array(
        F.struct(F.lit(1).alias("__own"), F.lit(1).alias("__edit"), F.expr(f"substring({kept}, 1, length({kept}) - length(__last))").alias("__text")),
        F.struct(F.lit(1).alias("__own"), F.lit(0).alias("__edit"), F.concat("__last", tail).alias("__text")),
        F.struct(F.lit(0).alias("__own"), F.lit(1).alias("__edit"), F.concat("__last", replaced).alias("__text")),
    )
    texts = rows.withColumn("__last", last).select(key, F.inline(parts))
    words = texts.select(key, "__own", "__edit", F.explode(F.split("__text", r"[^\p{L}\p{N}]+")).alias("__word")).filter("__word != ''")
    return words.groupBy(key, F.xxhash64(F.lower("__word")).alias("__term")).agg(F.sum("__own").alias("own"), F.sum("__edit").alias("edit"))


def signatures(rows: DataFrame, key: str, kept: str, tail: str, replaced: str, samples: int = SAMPLES) -> DataFrame:
    """``key, own, edit``: the signatures of the texts kept + tail and kept + replaced,
    arrays of ``samples`` ints.

    A text without words has a null signature, a key without any no row. Terms that both
    texts hold equally often make the same offer to both, which is computed once: offers
    are minimised within three classes (both, text, edited), then the classes are joined.
    Where ``rows`` is already partitioned by ``key``, nothing is shuffled.
    """
    tables = _tables()
    same = F.col("own") == F.col("edit")
    ways = F.array(
        F.struct(F.when(same, 0).otherwise(1).alias("__class"), F.col("own").alias("__n")),
        F.struct(F.lit(2).alias("__class"), F.when(same, 0).otherwise(F.col("edit")).alias("__n")),
    )
    weighted = _counts(rows, key, kept, tail, replaced).select(key, "__term", F.inline(ways)).filter("__n > 0").select(key, "__class", "__term", F.log(F.col("__n").cast("double")).alias("__log"))
    offers = [F.min(offer(F.col("__term"), F.col("__log"), i, tables)).alias(f"__a{i}") for i in range(samples)]
    least = weighted.groupBy(key, "__class").agg(*offers).select(key, "__class", F.array(*(f"__a{i}" for i in range(samples))).alias("__a"))
    by_class = least.groupBy(key).agg(*(F.max(F.when(F.col("__class") == i, F.col("__a"))).alias(f"__c{i}") for i in range(3)))
    return by_class.select(key, _smaller("__c0", "__c1").alias("own"), _smaller("__c0", "__c2").alias("edit"))


def _smaller(a: str, b: str) -> Column:
    """The hashes of the smaller offers of two arrays, of which one may be null."""
    return F.zip_with(F.coalesce(a, b), F.coalesce(b, a), lambda x, y: F.hash(F.least(x, y)))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples: 1 for two texts without words, 0 if only one has any."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(equal / F.lit(float(samples)))


def fingerprint(signature: Column) -> Column:
    """A signature as hex, 8 digits a sample; empty without words."""
    return F.coalesce(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""), F.lit(""))


def next_ids(ids: DataFrame) -> DataFrame:
    """``k, next``: the next larger key of each, and for the largest the smallest.

    ``ids`` holds distinct keys. They are dealt in ranges of about equal numbers, whatever
    their values, so that a window never holds more than about a bucket; only a range's
    first key meets the other ranges'.
    """
    low, n = ids.agg(F.min("k"), F.count("*")).first()
    if not n:
        return ids.select("k", F.col("k").alias("next"))
    b = written(ids.repartitionByRange(math.ceil(n / BUCKET), "k").withColumn("bucket", F.spark_partition_id()), "ranges")
    heads = b.groupBy("bucket").agg(F.min("k").alias("head"))
    heads = heads.select("bucket", F.lead("head").over(Window.orderBy("bucket")).alias("after"))
    inner = b.select("k", "bucket", F.lead("k").over(Window.partitionBy("bucket").orderBy("k")).alias("next"))
    return inner.join(heads, "bucket").select("k", F.coalesce("next", "after", F.lit(low)).alias("next"))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likenesses.

    The edited text has its last floor(n_chars / 4) code points replaced by as many of
    the next document's first (or all it has), in ascending order of doc_id; the first
    follows the last. A null text is empty. doc_id is the key: rows that repeat one count
    as one document, with the smallest text, a null doc_id is a key of its own and comes
    first, and other columns are ignored.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    one = rows.withColumn("__n", F.row_number().over(Window.partitionBy("k").orderBy("text"))).filter("__n = 1").drop("__n")
    order = next_ids(rows.select("k").distinct())
    texts = one.join(order, "k")
    # each text asks the next for a quarter of its own length
    asked = texts.select(F.col("next").alias("k"), F.col("k").alias("asker"), F.floor(F.length("text") / 4).cast("int").alias("m"))
    prefixes = asked.join(one, "k").select(F.col("asker").alias("k"), F.expr("substring(text, 1, m)").alias("prefix"))
    cut = one.select("k", "text", F.expr("length(text) - cast(floor(length(text) / 4) as int)").alias("m"))
    both = cut.join(prefixes, "k").select("k", F.length("text").cast("long").alias("n_chars"), F.expr("substring(text, 1, m)").alias("kept"), F.expr("substring(text, m + 1)").alias("tail"), "prefix")
    pair = signatures(both, "k", "kept", "tail", "prefix", samples)
    facts = both.select("k", "n_chars", F.sha2(F.concat("kept", "prefix").cast("binary"), 256).alias("edited_sha256"))
    # read twice below: each document meets its successor's signature
    done = written(facts.join(pair, "k", "left").join(order, "k"), "fingerprints")
    following = done.select(F.col("k").alias("next"), F.col("own").alias("following"))
    return done.join(following, "next").select(
        F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit"), samples).alias("near_edited"),
        likeness(F.col("own"), F.col("following"), samples).alias("near_next"),
    )
