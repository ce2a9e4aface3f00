"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of its bytes (A-Z lower-cased, a
blank before and after), hashed to a fixed number of buckets.  From labelled
training texts, p and q are the smoothed shares of toxic and clean texts that
have a feature, r = log(p/q) scales it, and a logistic regression is fitted on
the scaled features with an L2 penalty.  Rare or indifferent features get
weight zero.  Scoring reads every whole text, in blocks.

The classifier is fitted on a sample bounded by ``max_train`` texts for each
label, taken by a hash of the document id, and by ``max_train_bytes`` in all,
half of them for each label and what the other label doesn't need.  Texts over
1/128 of the bytes (125,000) come last in their label, the shortest first, so
that they don't crowd out the others; the first text of a label always stays.
Equal rows are learned once, and of several texts with one id one is.

Defined results: null text is scored like empty text; ties and repeated rows
are scored each by its text; without labelled texts of both kinds every score
is the share of toxic labels (0.5 where there is none); an empty table gives
no rows; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import freeing, hashed_sample, table

SIZES, BUCKET_BITS = (4, 5, 6), 22
MAX_TRAIN, MAX_TRAIN_BYTES, LONG_SHARE = 3000, 16_000_000, 128
SMOOTH, MIN_TEXTS, MIN_RATIO, L2, STEPS = 0.5, 6, 2.5, 3.0, 300
BLOCK = 1 << 20


def grams(data: bytes, sizes=SIZES, bits: int = BUCKET_BITS):
    """Yields arrays of bucket numbers of all n-grams of ``data``, in blocks."""
    data = b" " + data.lower() + b" "
    most = max(sizes)
    for at in range(0, len(data), BLOCK):
        c = np.frombuffer(data[at : at + BLOCK + most - 1], np.uint8).astype(np.uint64)
        h = np.zeros(0, np.uint64)
        for n in range(1, most + 1):
            if len(c) < n:
                break
            h = c + np.uint64(0) if n == 1 else h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :]
            if n in sizes:
                own = h[:BLOCK]
                yield (((own ^ (own >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)


def present(data: bytes, sizes=SIZES, bits: int = BUCKET_BITS) -> np.ndarray:
    seen = [np.unique(g) for g in grams(data, sizes, bits)]
    return np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)


def fit(texts: list[bytes], labels: list[int]) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias)."""
    size = 1 << BUCKET_BITS
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        share = min(max(y.mean() if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return np.zeros(size, np.float32), float(np.log(share / (1 - share)))
    rows = [present(t).astype(np.int32) for t in texts]
    has = np.zeros((2, size))
    for f, label in zip(rows, labels):
        has[label, f] += 1
    p, q = (has[1] + SMOOTH) / (y.sum() + 2 * SMOOTH), (has[0] + SMOOTH) / (len(y) - y.sum() + 2 * SMOOTH)
    r = np.log(p / q)
    r[(has.sum(0) < MIN_TEXTS) | (np.abs(r) < MIN_RATIO)] = 0
    rows = [f[r[f] != 0] for f in rows]
    sizes = np.array([len(f) for f in rows])
    flat, which = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
    used, flat = np.unique(flat, return_inverse=True)
    x = r[used][flat]
    # AdaGrad on the mean logistic loss, all rows at a time
    w, b = np.full(len(used), 0.01), 0.0
    gw, gb = np.full(len(used), 1e-8), 1e-8
    for _ in range(STEPS):
        z = np.bincount(which, x * w[flat], len(rows)) + b
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        dw, db = np.bincount(flat, x * e[which], len(used)) + L2 * w / len(y), e.sum()
        gw += dw * dw
        gb += db * db
        w -= 0.1 * dw / np.sqrt(gw)
        b -= 0.1 * db / np.sqrt(gb)
    weights = np.zeros(size, np.float32)
    weights[used] = r[used] * w
    return weights, float(b)


def training_rows(docs: DataFrame, labels: DataFrame, train, max_train: int, max_bytes: int) -> list:
    """(text, label) of at most ``max_train`` texts for each label and ``max_bytes`` in all; equal rows are taken once, and one text of an id."""
    own = labels.where(F.col("toxic").isin(0, 1) & train(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = hashed_sample(own.withColumn("key", F.xxhash64("doc_id")), "key", "toxic", max_train).select("doc_id", "toxic", F.col("__k").alias("k"))
    found = docs.select("doc_id", "text", F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("hash")).join(F.broadcast(own), "doc_id").where("bytes > 0")
    sizes = found.groupBy("doc_id", "toxic", "k").agg(F.min(F.struct("hash", "bytes")).alias("x")).select("doc_id", "toxic", "k", "x.*")  # at most max_train rows a label
    long = F.when(F.col("bytes") > max_bytes // LONG_SHARE, F.col("bytes")).otherwise(0)
    order = W.partitionBy("toxic").orderBy(long, "k", "bytes")
    sizes = sizes.withColumn("total", F.sum("bytes").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("place", F.row_number().over(order))
    sizes = sizes.withColumn("others", F.sum("bytes").over(W.partitionBy()) - F.sum("bytes").over(W.partitionBy("toxic")))
    sizes = sizes.where((F.col("total") <= F.greatest(F.lit(max_bytes // 2), F.lit(max_bytes) - F.col("others"))) | (F.col("place") == 1))
    chosen = found.join(F.broadcast(sizes.select("doc_id", "hash", "bytes")), ["doc_id", "hash", "bytes"], "left_semi")
    once = chosen.groupBy("doc_id", "hash").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))
    return once.orderBy("doc_id", "hash").select("text", "toxic").collect()


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row."""
    weights, bias = model
    used = np.flatnonzero(weights)
    sent = docs.sparkSession.sparkContext.broadcast((used.astype(np.int32), weights[used]))  # at most 4 MB
    parts, bits = grams, BUCKET_BITS

    def run(batches):
        import pyarrow as pa

        at, value = sent.value
        w, seen = np.zeros(1 << bits, np.float32), np.zeros(1 << bits, bool)
        w[at] = value
        live = w != 0

        def one(text: str | None) -> float:
            hit = [g[live[g]] for g in parts((text or "").encode("utf-8", "surrogatepass"))]
            f = np.unique(np.concatenate(hit)) if hit else ()
            return float(1 / (1 + np.exp(-np.clip(float(w[f].sum(dtype=np.float64)) + bias, -40, 40)))) if len(f) else float(1 / (1 + np.exp(-bias)))

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(t.as_py()) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(freeing(run), "doc_id long, score double")


def held_out(doc_id):
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "utf-8")), F.lit(5)) == 0


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = training_rows(docs, table(spark, sf_dir, "labels"), lambda i: ~held_out(i), MAX_TRAIN, MAX_TRAIN_BYTES)
    model = fit([r["text"].encode("utf-8", "surrogatepass") for r in rows], [r["toxic"] for r in rows])
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
