"""Document quality by a linear-chain conditional random field that labels every line good or bad.

A line's features are shares of character classes, word statistics and repetition, for itself and its two
neighbours; the chain adds weights for pairs of labels. Lines inherit their document's label in training, which is
maximum likelihood (each document's log likelihood over its number of lines, less a penalty of the weights) by the
exact gradient from forward-backward marginals of lines and pairs, in numpy on a bounded sample of labelled
rows (``labelled.TRAIN_ROWS``, ``labelled.TRAIN_BYTES``). A document's score is the average of its lines'
forward-backward marginals of "good", weighted by their lengths. Forward-backward goes in blocks of ``BLOCK`` lines, for
all blocks of all documents at once, so a document of very many lines takes few steps.

Defined cases: a null or empty text is one empty line; without labels of both classes all scores are the share
of label 1 (0.5 without any labels); repeated rows score alike; empty tables give empty results. Only id and text are
read of documents; long texts are scored whole, in time linear in their lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import table
from sparkloom.llm.labelled import fold, sample
from sparkloom.llm.texthash import INVERSE, SPACE, groups, powers, prefix_sums, text_groups, word_hashes

THRESHOLD = 0.3
STEPS, RATE, DECAY = 250, 0.1, 1e-3
#: Lines that forward-backward takes step by step; longer documents are cut in so many.
BLOCK = 64
_UPPER, _DIGIT, _SYMBOL = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SYMBOL[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[ord(c) for c in ".,;:'\"()-?"]] = True
CUTS = (0.02, 0.1, 0.3, 0.6)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts, the lines' lengths in bytes, and where each text's lines start (with the end)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    at = np.searchsorted(starts, first)
    size = (ends - starts).astype(np.float64)

    def per_line(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int32)))
        return (sums[ends] - sums[starts]).astype(np.float64)

    solid = np.maximum(size - per_line(SPACE[data]), 1)
    words, _ = word_hashes([data.tobytes()])
    space = np.concatenate(([True], SPACE[data]))
    word_at = np.flatnonzero(space[:-1] & ~space[1:])
    begin, end = np.searchsorted(word_at, starts), np.searchsorted(word_at, ends)
    n = np.maximum(end - begin, 1)

    def per_words(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int32)))
        return sums[end] - sums[begin]

    again = np.zeros(len(words), bool)
    line_of = np.searchsorted(starts, word_at, "right")
    for back in (1, 2, 3):
        again[back:] |= (words[back:] == words[:-back]) & (line_of[back:] == line_of[:-back])
    sums = prefix_sums(data)
    line_hash = (sums[ends] - sums[starts]) * powers(len(data), INVERSE)[starts]
    text_of = np.searchsorted(at, np.arange(len(starts)), "right")
    order = np.lexsort((line_hash, text_of))
    copy = np.zeros(len(starts), bool)
    copy[order[1:]] = (line_hash[order[1:]] == line_hash[order[:-1]]) & (text_of[order[1:]] == text_of[order[:-1]]) & (size[order[1:]] > 0)
    symbol = per_line(_SYMBOL[data] & ~_PLAIN[data]) / solid
    shares = [symbol, per_line(_PLAIN[data]) / solid, per_line(_UPPER[data]) / solid, per_line(_DIGIT[data]) / solid, per_words(again) / n]
    own = [*shares, *((s > cut).astype(np.float64) for s in (shares[0], shares[2], shares[4]) for cut in CUTS)]
    own += [np.minimum(solid / n, 20) / 20, np.log1p(size) / 10, (size == 0).astype(np.float64), copy.astype(np.float64)]
    x = np.stack(own, 1)
    before, behind = np.zeros_like(x), np.zeros_like(x)
    before[1:], behind[:-1] = x[:-1], x[1:]
    before[at[:-1]] = 0
    behind[at[1:] - 1] = 0
    edge = np.zeros((len(x), 2))
    edge[at[:-1], 0] = 1
    edge[at[1:] - 1, 1] = 1
    return np.concatenate((x, before, behind, edge, np.ones((len(x), 1))), 1), size, at


def _segments(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chains cut in blocks: where the blocks start (with the end), and the number of each chain's first block (with the end)."""
    blocks = -(-np.diff(at) // BLOCK)
    first = np.concatenate(([0], np.cumsum(blocks)))
    chain = np.repeat(np.arange(len(blocks)), blocks)
    return np.append(at[chain] + (np.arange(len(chain)) - first[chain]) * BLOCK, at[-1]), first


def _messages(step: np.ndarray, at: np.ndarray, init: np.ndarray) -> np.ndarray:
    """For each chain of 2 x 2 steps and each place the vector init @ step @ ... @ step up to it, with sum 1.

    Chains of more than a block are cut; the blocks' products make shorter chains, whose vectors are where the blocks start.
    """
    lengths = np.diff(at)
    if lengths.max(initial=0) > BLOCK:
        cut, first = _segments(at)
        product = np.repeat(np.eye(2)[None], len(cut) - 1, 0)
        for k, alive in _side_by_side(cut):
            product[alive] = product[alive] @ step[k]
            product[alive] /= product[alive].sum((1, 2), keepdims=True)
        ends = _messages(product, first, init)
        begin = np.empty((len(cut) - 1, 2))
        begin[1:] = ends[:-1]
        begin[first[:-1]] = init
        at, init = cut, begin
    out = np.empty((len(step), 2))
    for k, alive in _side_by_side(at):
        before = np.where((k == at[alive])[:, None], init[alive], out[k - 1])
        out[k] = (before[:, None, :] @ step[k])[:, 0]
        out[k] /= out[k].sum(1, keepdims=True)
    return out


def _side_by_side(at: np.ndarray):
    """The first place of each chain, then the second of those that have one, and so on, with the chains' numbers."""
    lengths = np.diff(at)
    order = np.argsort(-lengths, kind="stable")
    held = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), "left")
    for t, n in enumerate(held):
        yield at[:-1][order[:n]] + t, order[:n]


def marginals(unary: np.ndarray, pair: np.ndarray, at: np.ndarray, weigh: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward of all chains side by side: P(good) of each line, expected counts of label pairs, sum of log Z. unary: log odds of good; weigh: what each line's pairs with the line before count, and its part of log Z."""
    n = len(unary)
    weigh = np.ones(n) if weigh is None else weigh
    local = np.exp(np.stack((-unary / 2, unary / 2), 1).clip(-300, 300))
    local /= (scale := local.sum(1, keepdims=True))
    jump = np.exp(pair - pair.max())
    begins = np.zeros(n, bool)
    begins[at[:-1]] = True
    step = jump[None] * local[:, None, :]
    step[begins] = np.repeat(local[begins][:, None, :], 2, 1)
    chains = len(at) - 1
    forward = _messages(step, at, np.full((chains, 2), 0.5))
    # backward: from the end, the vector behind a line comes from the line behind it
    turned = np.empty((n, 2, 2))
    ends = np.zeros(n, bool)
    ends[at[1:] - 1] = True
    turned[:-1] = (jump[None] * local[1:, None, :]).transpose(0, 2, 1)
    turned[ends] = np.eye(2)
    back_at = n - at[::-1]
    backward = _messages(turned[::-1], back_at, np.full((chains, 2), 0.5))[::-1]
    both = forward * backward
    inner = np.flatnonzero(~begins)
    joint = forward[inner - 1][:, :, None] * jump[None] * (local[inner] * backward[inner])[:, None, :]
    pairs = (weigh[inner][:, None, None] * joint / joint.sum((1, 2), keepdims=True)).sum(0)
    before = np.full((n, 2), 0.5)
    before[inner] = forward[inner - 1]
    grown = (before[:, None, :] @ step)[:, 0].sum(1)
    log_z = float((weigh * (np.log(grown) + np.log(scale[:, 0]) + np.where(begins, 0.0, pair.max()))).sum())
    return both[:, 1] / both.sum(1), pairs, log_z


class Objective:
    """The documents' log likelihood and its gradient. Each document counts once, so long ones don't rule; label pairs within a document are equal."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray):
        self.x = np.concatenate([p[0] for p in parts])
        self.at = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))))
        lines = np.diff(self.at)
        self.y = np.repeat(labels, lines).astype(np.float64)
        self.weigh = np.repeat(1 / lines, lines)
        self.pairs = np.diag([np.sum((lines - 1) * (labels == c) / lines) for c in (0, 1)])
        self.total, self.width = len(labels), self.x.shape[1]

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        weight, pair = theta[: self.width], theta[self.width :].reshape(2, 2)
        unary = self.x @ weight
        good, expected, log_z = marginals(unary, pair, self.at, self.weigh)
        value = float((self.weigh * unary * (self.y - 0.5)).sum() + (self.pairs * pair).sum() - log_z) / self.total - DECAY * float(theta @ theta) / 2
        slope = np.concatenate((self.x.T @ (self.weigh * (self.y - good)), (self.pairs - expected).reshape(-1))) / self.total
        return value, slope - DECAY * theta


def train(rows: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(weights of the features, weights of label pairs), by gradient steps (Adam) on the log likelihood of the lines' labels."""
    width = line_features([b""])[0].shape[1]
    weight, pair = np.zeros(width), np.zeros((2, 2))
    labels = np.array([y for _, y in rows], np.int64)
    if len(set(labels.tolist())) < 2:
        share = min(max(float(labels.mean()) if len(labels) else 0.5, 0.01), 0.99)
        weight[-1] = np.log(share / (1 - share))
        return weight, pair
    objective = Objective([line_features([t for t, _ in rows[a:b]]) for a, b in groups([len(t) for t, _ in rows])], labels)
    theta, m, v = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for step in range(1, STEPS + 1):
        _, g = objective(theta)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:width], theta[width:].reshape(2, 2)


def scores(texts: list[bytes], weight: np.ndarray, pair: np.ndarray) -> np.ndarray:
    out = np.zeros(len(texts))
    for a, b in groups([len(t) for t in texts]):
        x, size, at = line_features(texts[a:b])
        good, _, _ = marginals(x @ weight, pair, at)
        size = size + 1e-9
        out[a:b] = np.add.reduceat(good * size, at[:-1]) / np.add.reduceat(size, at[:-1])
    return out.clip(0, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text"):
    """A UDF text -> score, trained on rows outside the held fold."""
    rows = sample(docs.select(id_col, F.col(text_col).alias("text")), labels, label, fold(F.col(id_col), folds) != held, id_col=id_col)
    shared = docs.sparkSession.sparkContext.broadcast(train(rows))

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(scores(raw, *shared.value) for _, _, raw in text_groups(texts))]))

    return score


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """id, held_out, score, predicted. Rows of the held fold teach nothing."""
    score = fit(docs, labels, folds=folds, held=held, id_col=id_col, text_col=text_col, **how)
    scored = docs.select(id_col, (fold(F.col(id_col), folds) == held).alias("held_out"), score(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The documents that the field does not reject."""
    return docs.where(fit(docs, labels, text_col=text_col, **how)(F.col(text_col)) >= THRESHOLD)


def op5_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
