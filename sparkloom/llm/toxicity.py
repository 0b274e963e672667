"""Toxicity by bags of subwords: hashed character n-grams share embeddings, whose average goes through a linear softmax.

Embeddings and softmax are trained jointly in numpy on a bounded sample of labelled rows (``TRAIN_ROWS``), in
batches with Adagrad. N-grams keep the borders of words, so unseen forms and misspellings of a word share most of
their vectors with it. As softmax of an average is linear in the embeddings, scoring needs one number for each of
``BUCKETS`` buckets: a table of fixed size, which is broadcast, and whole texts are scored in numpy.

Defined cases: a null or empty text, or one without words, scores as the bias says; without labels of both
classes all scores are the share of label 1 (0.5 without any labels), and where no labelled text has a word, what
the bias learnt; repeated rows score alike and teach once; empty tables give empty results. Only id and text are read
of documents. Training takes at most ``TRAIN_ROWS`` texts and ``labelled.TRAIN_BYTES`` bytes, in whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import table
from sparkloom.llm.decontaminate import NORMAL
from sparkloom.llm.labelled import fold, sample
from sparkloom.llm.texthash import INVERSE, U, groups, powers, prefix_sums, text_groups

BITS = 20
BUCKETS = 1 << BITS
GRAMS = (3, 4, 5, 6)
DIM = 4
GAIN = 40.0
#: An average counts so many n-grams without weight besides its own, so a few words alone decide little.
CALM = 40
#: BATCH: at most 256, as a batch's documents are numbered in a byte.
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.25, 1e-6
THRESHOLD = 0.7
#: Fitted on at most so many labelled documents, the first by a hash of their ids.
TRAIN_ROWS = 8000


def subwords(texts: list[bytes]):
    """For each n: buckets of the n-grams at all places of the texts' words between spaces, which of them lie in one word, and each text's range."""
    normal = [b" " + b" ".join(t.translate(NORMAL).split()) + b" " for t in texts]
    data = np.frombuffer(b"".join(normal), np.uint8)
    ends = np.cumsum([len(t) for t in normal])
    sums, inverse = prefix_sums(data), powers(len(data), INVERSE)
    spaces = np.concatenate(([0], np.cumsum(data == 32, dtype=np.int32)))
    for n in GRAMS:
        places = max(0, len(data) - n + 1)
        bucket = (((sums[n:] - sums[:-n])[:places] * inverse[:places]) >> U(64 - BITS)).astype(np.int32)
        inside = spaces[n - 1 : n - 1 + places] == spaces[1 : 1 + places]
        yield bucket, inside, ends


def bags(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, their shares) of each text."""
    out = []
    for a, b in groups([len(t) for t in texts]):
        grams = [(bucket[inside], np.searchsorted(ends, np.flatnonzero(inside), "right")) for bucket, inside, ends in subwords(texts[a:b])]
        for k in range(b - a):
            own = np.concatenate([bucket[np.searchsorted(of, k) : np.searchsorted(of, k, "right")] for bucket, of in grams])
            bucket, n = np.unique(own, return_counts=True)
            out.append((bucket, (n / (CALM + n.sum())).astype(np.float32)))
    return out


def train(rows: list[tuple[bytes, int]], seed: int = 2) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias): the log odds of label 1 are the weights' average plus the bias."""
    y = np.array([label for _, label in rows], np.int64)
    if len(set(y.tolist())) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    y = y[order]
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft, bias = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    emb_sq, soft_sq, bias_sq = np.full(BUCKETS, 1e-4, np.float32), np.full_like(soft, 1e-4), np.full_like(bias, 1e-4)
    weigh = np.sqrt(len(y) / (2.0 * np.bincount(y, minlength=2)))[y].astype(np.float32)
    batches = []
    for a in range(0, len(y), BATCH):
        own = bags([rows[k][0] for k in order[a : a + BATCH]])
        bucket = np.concatenate([x for x, _ in own])
        share = np.concatenate([x for _, x in own])
        doc = np.repeat(np.arange(len(own)), [len(x) for x, _ in own])
        by = np.argsort(bucket, kind="stable")
        at = np.flatnonzero(np.concatenate(([True], bucket[by][1:] != bucket[by][:-1]))) if len(by) else np.zeros(0, np.int64)
        batches.append((a, len(own), bucket[by], share[by][:, None], doc[by].astype(np.uint8), at.astype(np.int32)))
    for _ in range(EPOCHS):
        for a, n, bucket, share, doc, at in batches:
            mean = np.zeros((n, DIM), np.float32)
            part = emb[bucket] * share
            for j in range(DIM):
                mean[:, j] = np.bincount(doc, part[:, j], n)
            logits = GAIN * mean @ soft + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), y[a : a + n]] -= 1
            p *= weigh[a : a + n, None] / n
            g_soft, g_bias, g_mean = GAIN * mean.T @ p, p.sum(0), GAIN * p @ soft.T
            if len(at):
                touched = bucket[at]
                g = np.add.reduceat(g_mean[doc] * share, at, axis=0) + DECAY * emb[touched]
                emb_sq[touched] += (g * g).mean(1)
                emb[touched] -= RATE * g / np.sqrt(emb_sq[touched])[:, None]
            soft_sq += g_soft * g_soft
            bias_sq += g_bias * g_bias
            soft -= RATE * g_soft / np.sqrt(soft_sq)
            bias -= RATE * g_bias / np.sqrt(bias_sq)
    seen = np.zeros(BUCKETS, bool)
    for _, _, bucket, _, _, _ in batches:
        seen[bucket] = True
    weight = GAIN * emb @ (soft[:, 1] - soft[:, 0])
    weight[~seen] = weight[seen].mean() if seen.any() else 0  # a bucket without rows says nothing
    return weight.astype(np.float32), float(bias[1] - bias[0])


def log_odds(texts: list[bytes], weight: np.ndarray, bias: float) -> np.ndarray:
    out = np.zeros(len(texts))
    for a, b in groups([len(t) for t in texts]):
        total, count = np.zeros(b - a), np.zeros(b - a)
        for bucket, inside, ends in subwords(texts[a:b]):
            at = np.flatnonzero(inside)
            sums = np.concatenate(([0.0], np.cumsum(weight[bucket[at]], dtype=np.float64)))
            edge = np.searchsorted(at, np.concatenate(([0], ends)))
            total += sums[edge[1:]] - sums[edge[:-1]]
            count += edge[1:] - edge[:-1]
        out[a:b] = total / (count + CALM)
    return out + bias


def scorer(spark, weight: np.ndarray, bias: float):
    shared = spark.sparkContext.broadcast((weight, bias))

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        odds = np.concatenate([np.zeros(0), *(log_odds(raw, *shared.value) for _, _, raw in text_groups(texts))])
        return pa.array(1 / (1 + np.exp(-np.clip(odds, -60, 60))))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted. Rows of the held fold teach nothing."""
    rows = sample(docs.select(id_col, F.col(text_col).alias("text")), labels, label, fold(F.col(id_col), folds) != held, TRAIN_ROWS, id_col)
    score = scorer(docs.sparkSession, *train(rows))
    scored = docs.select(id_col, (fold(F.col(id_col), folds) == held).alias("held_out"), score(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op2_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
