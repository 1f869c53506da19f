"""Quality classifier by positive-unlabelled learning.

Trusted positives, unlabelled web text and an estimated class prior are enough: the risk over negatives is that over
unlabelled text less the positives' share of it, held at zero or above so that it can't be fitted below what any
classifier reaches. The model is linear in measures of the whole text and their squares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrack.llm.langid import fold
from lumentrack.llm.texts import flat, word_bounds
from lumentrack.session import cut

#: Bound of each of the two samples, positives and unlabelled, that the classifier is fitted on.
SAMPLE_ROWS = 20_000
CUTOFF = 0.3
#: Texts are measured in pieces of a batch of about so many bytes; the arrays over its bytes take some forty times that.
PIECE_BYTES = 2_000_000
STEPS, RATE, DECAY = 500, 0.05, 1e-4
#: The class prior is estimated with scorers of so many steps, each on all but one of so many folds of the samples.
PRIOR_STEPS, PRIOR_FOLDS = 200, 2

_CLASSES = ("other", "lower", "upper", "digit", "space", "line", "symbol", "exclaim", "stop", "comma", "beyond", "quote")
_CLASS_OF = np.zeros(256, np.uint8)
for _name, _bytes in {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": b" \t\x0b\x0c\r", "line": b"\n",
    "symbol": b"#*$%&|<>", "exclaim": b"!", "stop": b".?", "comma": b",;:", "beyond": range(128, 256), "quote": b"'\"",
}.items():
    _CLASS_OF[list(_bytes)] = _CLASSES.index(_name)

FEATURES = (
    "log_words", "word_length", "upper_share", "digit_share", "beyond_share", "other_share", "symbols_a_word", "exclaims_a_word", "stops_a_word", "commas_a_word", "quotes_a_word", "lines_a_word",
    "distinct_words", "distinct_runs", "same_as_before", "short_words", "long_words",
)
_ODD = np.uint64(0x9E3779B97F4A7C15)


_BYTE_VALUES = np.random.default_rng(3).integers(1, 2**63, 256, dtype=np.uint64)
_kept_powers: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd number and of its inverse, from 0 to n at least; kept for the next batch."""
    if not _kept_powers or len(_kept_powers[0]) <= n:
        _kept_powers.clear()
        for base in (int(_ODD), pow(int(_ODD), -1, 2**64)):
            p = np.full(max(n + 1, 1 << 20), np.uint64(base))
            p[0] = 1
            _kept_powers.append(np.multiply.accumulate(p, out=p))
    return _kept_powers[0], _kept_powers[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from running sums of the bytes' values x powers of an odd number."""
    n = len(data)
    if not n:
        return np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        power, inverse = _powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.multiply(_BYTE_VALUES[data], power[:n], out=total[1:])
        np.add.accumulate(total, out=total)
        h = (total[ends] - total[starts]) * inverse[starts]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def _distinct(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    return np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n_docs)


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each whole text; an empty text's are all 0."""
    data, at = flat(texts)
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    counts = np.bincount(doc * len(_CLASSES) + _CLASS_OF[data], minlength=n * len(_CLASSES)).reshape(n, len(_CLASSES)).astype(float)
    of = dict(zip(_CLASSES, counts.T, strict=True))
    starts, ends, word_at = word_bounds(data, at)
    words = np.diff(word_at)
    word_doc, length = np.repeat(np.arange(n), words), ends - starts
    h = word_hashes(data, starts, ends)
    with np.errstate(over="ignore"):
        run = h[:-3] + h[1:-2] * np.uint64(3) + h[2:-1] * np.uint64(9) + h[3:] * np.uint64(27) if len(h) > 3 else np.zeros(0, np.uint64)
    inside = word_doc[3:] == word_doc[:-3] if len(h) > 3 else np.zeros(0, bool)
    same = (h[1:] == h[:-1]) & (word_doc[1:] == word_doc[:-1])
    w, letters = np.maximum(words, 1), np.maximum(of["lower"] + of["upper"] + of["beyond"], 1)
    size = np.maximum(np.diff(at), 1)
    out = np.stack([
        np.log1p(words), np.bincount(word_doc, length, n) / w, of["upper"] / letters, of["digit"] / size, of["beyond"] / letters, of["other"] / size,
        of["symbol"] / w, of["exclaim"] / w, of["stop"] / w, of["comma"] / w, of["quote"] / w, of["line"] / w,
        _distinct(h, word_doc, n) / w, _distinct(run[inside], word_doc[3:][inside], n) / np.maximum(words - 3, 1), np.bincount(word_doc[1:][same], minlength=n) / w,
        np.bincount(word_doc[length <= 2], minlength=n) / w, np.bincount(word_doc[length >= 12], minlength=n) / w,
    ], axis=1)
    out[words == 0] = 0
    return out.astype(np.float32)


def feature_table(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``f``, its text's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            per = max(1, int(whole.num_rows * PIECE_BYTES / max(1, whole.nbytes)))
            for i in range(0, whole.num_rows, per):
                batch = whole.slice(i, per)
                f = features(batch.column(1))
                offsets = pa.array(np.arange(len(f) + 1, dtype=np.int32) * f.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(f.ravel()))], names=["doc_id", "f"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text).mapInArrow(run, f"doc_id {kind}, f array<float>")


@dataclass(frozen=True)
class Scorer:
    """logit = bias + weights . (z, z^2 - 1), where z is a feature less its centre over its spread, kept within 4."""

    centre: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float
    prior: float

    def expand(self, f: np.ndarray) -> np.ndarray:
        z = np.clip((f - np.array(self.centre)) / np.array(self.spread), -4, 4)
        return np.concatenate([z, z * z - 1], axis=1)

    def column(self, f: str = "f") -> Column:
        """The score as one expression over the feature array."""
        logit, n = F.lit(self.bias), len(self.centre)
        for i in range(n):
            z = F.least(F.greatest((F.get(F.col(f), F.lit(i)).cast("double") - self.centre[i]) / self.spread[i], F.lit(-4.0)), F.lit(4.0))
            logit = logit + z * self.weights[i] + (z * z - 1) * self.weights[n + i]
        return 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> Scorer:
    """Minimises prior x E_p[loss(+)] + max(0, E_u[loss(-)] - prior x E_p[loss(-)]) with the logistic loss, by Adam.

    Where the second term is below zero its gradient is followed upwards, so that it is brought back.
    """
    prior = min(max(prior, 0.05), 0.95)
    n = len(FEATURES)
    if not len(positive) or not len(unlabelled):
        return Scorer((0.0,) * n, (1.0,) * n, (0.0,) * (2 * n), float(np.log(prior / (1 - prior))), prior)
    centre = np.median(unlabelled, axis=0)
    spread = np.maximum(unlabelled.std(axis=0), 1e-3)
    scorer = Scorer(tuple(map(float, centre)), tuple(map(float, spread)), (0.0,) * (2 * n), 0.0, prior)
    p, u = (np.hstack([scorer.expand(x.astype(float)), np.ones((len(x), 1))]) for x in (positive, unlabelled))
    w = np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    softplus = lambda x: np.logaddexp(0, x)
    for k in range(1, steps + 1):
        fp, fu = p @ w, u @ w
        up = -prior * (sigmoid(-fp) @ p) / len(p)
        down = (sigmoid(fu) @ u) / len(u) - prior * (sigmoid(fp) @ p) / len(p)
        negative_risk = softplus(fu).mean() - prior * softplus(fp).mean()
        g = (up + down if negative_risk >= 0 else -down) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (1 - k / (steps + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Scorer(scorer.centre, scorer.spread, tuple(map(float, w[:-1])), float(w[-1]), prior)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = PRIOR_STEPS, folds: int = PRIOR_FOLDS) -> float:
    """The share of positives in the unlabelled rows, from the two samples alone.

    Above any threshold of a score lie at least prior x (share of positives above it) of the unlabelled rows, and no
    more than that where the score leaves all negatives below. So the prior is the least ratio of the two shares, over
    thresholds that leave a fifth of the positives or more above. Rows are scored by what was fitted on the other folds.
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    rows = [np.random.default_rng(seed).permutation(x[np.lexsort(x.T)]) for seed, x in enumerate((positive, unlabelled))]
    fold_of = [np.arange(len(x)) % folds for x in rows]
    scores = [np.zeros(len(x)) for x in rows]
    for k in range(folds):
        scorer = fit(*(x[f != k] for x, f in zip(rows, fold_of, strict=True)), 0.5, steps)
        for x, f, out in zip(rows, fold_of, scores, strict=True):
            out[f == k] = scorer.expand(x[f == k].astype(float)) @ np.array(scorer.weights) + scorer.bias
    p, u = np.sort(scores[0]), np.sort(scores[1])
    thresholds = np.quantile(p, np.linspace(0, 0.8, 41))
    above = [1 - np.searchsorted(x, thresholds) / len(x) for x in (p, u)]
    return float(np.clip((above[1] / np.maximum(above[0], 1e-9)).min(), 0.0, 1.0))


def scored(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS, cutoff: float = CUTOFF) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out (fold 0 of 5, never learnt from), score, predicted.

    Positives are the texts labelled 1 (of several labels of one id the mean decides; null labels are none); other
    labels aren't used. Both samples are drawn by a hash, up to ``sample_rows`` each, and the prior is estimated from
    them. Null texts are scored as empty ones, repeated rows alike. Without positives every score is the middle prior.
    An empty table gives an empty result; other columns aren't read.
    """
    held_out = fold("doc_id", 5) == 0
    table = cut(feature_table(docs, id_col=id_col, text=text))
    marks = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.avg(label).alias("mean")).filter(~held_out & (F.col("mean") >= 0.5))
    good = cut(marks.select("doc_id"))
    n_good, n_docs = good.count(), table.filter(~held_out).count()
    chance = F.xxhash64("doc_id", F.lit(5)) / float(2**64) + 0.5
    share = lambda n: min(1.0, sample_rows / max(n, 1))
    take = lambda df: np.array([r["f"] for r in df.select("f").limit(2 * sample_rows).collect()], float).reshape(-1, len(FEATURES))
    positive = take(table.join(good.filter(chance <= share(n_good)), "doc_id"))
    unlabelled = take(table.filter(~held_out & (chance <= share(n_docs))))
    scorer = fit(positive, unlabelled, estimated_prior(positive, unlabelled))
    score = scorer.column()
    return table.select("doc_id", held_out.alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= cutoff).cast("int"))
