"""A quality classifier from trusted positives and unlabelled text (positive-unlabelled learning).

A linear model over statistics of the text minimises the non-negative unbiased risk
    prior * E_P[loss(g)] + max(0, E_U[loss(-g)] - prior * E_P[loss(-g)])
with the logistic loss. Sums over rows are made in tasks and added up by Spark; only sums, whose
number depends on the number of features alone, reach the driver. All rows take part in each step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stage
from millrace.llm.text import slices, string_bytes, word_hashes, word_spans

PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
NAMES = [
    "log_words", "mean_length", "long_words", "short_words", "upper", "digit", "space", "other_bytes", "control", "lines", "distinct", "commonest", "capitals", "shouted", "line_copies", "log_bytes",
    *(f"punct_{c:02x}" for c in PUNCTUATION), *(f"ends_{c:02x}" for c in PUNCTUATION),
]
BINS = 512


def _per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return (total[offs[1:]] - total[offs[:-1]]).astype(float)


def _copies(keys: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's keys: how many are distinct, and how often the commonest occurs."""
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    runs, most = np.diff(np.append(at, len(k))), np.zeros(len(offs) - 1)
    np.maximum.at(most, r[at], runs)
    return np.bincount(r[at], minlength=len(offs) - 1).astype(float), most


def features(column: pa.Array) -> np.ndarray:
    """A row of statistics (NAMES) for each whole text; a null text is an empty one. Equal texts have equal statistics, whatever their ids."""
    buf, offs = string_bytes(column)
    out = np.zeros((len(offs) - 1, len(NAMES)), np.float32)
    for i, j in slices(offs):
        part, rel = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        s, e, w = word_spans(part, rel)
        words, size = np.diff(w).astype(float), np.diff(rel).astype(float)
        n, b = np.maximum(words, 1), np.maximum(size, 1)
        length = e - s
        upper, lower = (part >= 65) & (part <= 90), (part >= 97) & (part <= 122)
        up = np.zeros(len(part) + 1, np.int64)
        np.cumsum(upper, out=up[1:])
        caps = up[e] - up[s]
        hashes = word_hashes(part, s, e)
        distinct, most = _copies(hashes, w)
        is_line = np.zeros(len(s), bool)
        if len(s):
            newline = np.zeros(len(part) + 1, np.int64)
            np.cumsum(part == 10, out=newline[1:])
            is_line[1:] = newline[s[1:]] > newline[s[:-1]]
            is_line[w[:-1][words > 0]] = True
        first = np.flatnonzero(is_line)
        line_of = np.searchsorted(first, w)
        line_hash = np.add.reduceat(hashes * (np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s)))) * 1 + 1).astype(np.uint64), first) if len(first) else np.zeros(0, np.uint64)
        lines = np.diff(line_of).astype(float)
        own_lines, _ = _copies(line_hash, line_of)
        stat = [
            np.log1p(words), _per_word(length, w) / n, _per_row(length > 15, w) / n, _per_row(length < 3, w) / n, _per_row(upper, rel) / np.maximum(_per_row(upper | lower, rel), 1),
            _per_row((part >= 48) & (part <= 57), rel) / b, (size - _per_word(length, w)) / b, _per_row(part >= 128, rel) / b, _per_row((part < 32) & (part != 10) | (part == 127), rel) / b,
            lines / n, distinct / n, most / n, _per_row(upper[s] if len(s) else np.zeros(0, bool), w) / n, _per_row((caps > 1) & (caps * 2 > length), w) / n, 1 - own_lines / np.maximum(lines, 1), np.log1p(size),
        ]
        final = part[e - 1] if len(e) else np.zeros(0, np.uint8)
        stat += [np.minimum(_per_row(part == c, rel) / n, 3) for c in PUNCTUATION] + [_per_row(final == c, w) / n for c in PUNCTUATION]
        out[i:j] = np.stack(stat, axis=1)
    out[:, 2:] = np.where(out[:, 2:] > 0, np.sqrt(np.maximum(out[:, 2:], 0)), 0)
    out[:, 1] = np.minimum(out[:, 1], 50)
    return out


def _per_word(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return (total[offs[1:]] - total[offs[:-1]]).astype(float)


def with_features(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep and x, the features as packed floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch["_text"])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array([r.tobytes() for r in x], pa.binary())], [*keep, "x"])

    frame = docs.select(*keep, F.col(text).alias("_text"))
    return frame.mapInArrow(run, frame.select(*keep, F.lit(b"").alias("x")).schema)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch["x"].to_pylist()), np.float32).reshape(-1, len(NAMES)).astype(np.float64)


def _sums(rows: DataFrame, parts: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows (x, positive) of parts(x, positive), an array of `size` numbers for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += parts(_matrix(batch), batch["positive"].to_numpy(zero_copy_only=False).astype(bool))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["i", "v"])

    out = np.zeros(size)
    for r in rows.select("x", "positive").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # `size` rows at most
        out[r["i"]] = r["v"]
    return out


def _loss(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-_loss(z))


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(np.clip(self.design(x) @ self.weights, -30, 30))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 2.0) -> float:
    """The share of positives among unlabelled rows, from histograms of a score: the least ratio of the upper tails, each with an upper confidence bound."""
    p, u = positive[::-1].cumsum(), unlabelled[::-1].cumsum()
    p_rate, u_rate = p / max(p[-1], 1), u / max(u[-1], 1)
    wide = confidence * (np.sqrt(np.maximum(u_rate * (1 - u_rate), 0) / max(u[-1], 1)) + np.sqrt(np.maximum(p_rate * (1 - p_rate), 0) / max(p[-1], 1)))
    ok = p_rate > 0.05
    return float(np.clip(((u_rate + wide)[ok] / p_rate[ok]).min(initial=1.0), 0.01, 0.99))


def fit(rows: DataFrame, steps: int = 8, ridge: float = 1e-4, strength: float = 10.0, prior: float | None = None) -> QualityModel:
    """Fits a QualityModel to rows (x, positive): trusted positives and unlabelled texts; all rows count as a sample of the whole.

    First a logistic model tells positives from all rows; the class prior follows from its scores'
    tails, unless given. Then Newton steps with a search along the step lower the non-negative risk;
    where its second part is below 0, they follow the first part alone and, as a second try, raise
    the second one.
    Without any positive row the model scores 0.5 everywhere. Weights are drawn to 0 by `ridge`, or
    by strength / rows where rows are few; the strength was chosen on a split of training rows.
    """
    d = len(NAMES)
    m = _sums(rows, lambda x, p: np.concatenate([x.sum(0), (x * x).sum(0), [len(x), p.sum()]]), 2 * d + 2)
    n, n_pos = max(m[2 * d], 1), m[2 * d + 1]
    ridge = max(ridge, strength / n)
    mean = m[:d] / n
    deviation = np.sqrt(np.maximum(m[d : 2 * d] / n - mean**2, 0))
    model = QualityModel(mean, np.where(deviation > 1e-9, deviation, 1.0), np.zeros(d + 1), 0.5)
    if not n_pos:
        return model
    tries = np.array([1.0, 0.5, 0.25, 0.1, 0.02, 0.002])
    penalty = np.append(np.full(d, ridge), 1e-9)

    def search(w: np.ndarray, steps: list[np.ndarray], pi: float) -> tuple[np.ndarray, float, float]:
        """The best of w and of the points along the steps: the point, its risk and the part of it that may not be negative, and how much the risk fell. pi 1 without the bound: the first model's."""
        points = np.stack([w, *[w + t * step for step in steps for t in tries]], axis=1)

        def losses(x: np.ndarray, p: np.ndarray) -> np.ndarray:
            g = model.design(x) @ points
            return np.stack([_loss(-g).sum(0), _loss(-g[p]).sum(0), _loss(g[p]).sum(0)]).ravel()

        u_neg, p_neg, p_pos = _sums(rows, losses, 3 * points.shape[1]).reshape(3, -1) / np.array([[n], [n_pos], [n_pos]])
        negative = u_neg - pi * p_neg
        risk = (pi * p_pos + np.maximum(negative, 0)) if bounded else u_neg + p_pos
        risk = risk + (penalty[:, None] / 2 * points**2).sum(axis=0)
        at = int(risk.argmin())
        return points[:, at], float(negative[at]), float(risk[0] - risk[at])

    def newton(pi: float, steps: int) -> None:
        w, negative = model.weights, 0.0
        for _ in range(steps):

            def slopes(x: np.ndarray, p: np.ndarray, w: np.ndarray = w) -> np.ndarray:
                a = model.design(x)
                s = _sigmoid(a @ w)
                curve = lambda c: ((a * c[:, None]).T @ a).ravel()
                return np.concatenate([s @ a, (s * p) @ a, ((1 - s) * p) @ a, curve(s * (1 - s)), curve(s * (1 - s) * p)])

            q = _sums(rows, slopes, (d + 1) * (2 * d + 5))
            (u, pn, pp), (cu, cp) = q[: 3 * (d + 1)].reshape(3, -1), q[3 * (d + 1) :].reshape(2, d + 1, d + 1)
            # Gradients of E_U[loss(-g)] - pi E_P[loss(-g)] and of pi E_P[loss(g)], and their curvatures.
            below, above = u / n - pi * pn / n_pos, -pi * pp / n_pos
            down = lambda grad, curve: -np.linalg.solve(curve + np.diag(penalty + 1e-6), grad + penalty * w)  # noqa: B023, E731
            if not bounded:
                tried = [down(u / n - pp / n_pos, cu / n + cp / n_pos)]
            elif negative >= 0:
                tried = [down(below + above, cu / n)]
            else:  # the risk is pi E_P[loss(g)] alone; and a step that raises the negative part
                tried = [down(above, pi * cp / n_pos), down(-below, cu / n)]
            tried = [x * min(1.0, 10 / max(float(np.linalg.norm(x)), 1e-12)) for x in tried]
            w, negative, fell = search(w, tried, pi)
            model.weights = w
            if fell < 1e-7:
                break

    bounded = False
    if prior is None:
        newton(1.0, max(4, steps // 2))

        def tails(x: np.ndarray, p: np.ndarray) -> np.ndarray:
            at = np.minimum((model.score(x) * BINS).astype(int), BINS - 1)
            return np.concatenate([np.bincount(at[p], minlength=BINS), np.bincount(at, minlength=BINS)]).astype(float)

        both = _sums(rows, tails, 2 * BINS)
        prior = class_prior(both[:BINS], both[BINS:])
    model.prior, model.weights, bounded = prior, np.zeros(d + 1), True
    newton(prior, steps)
    return model


def score(rows: DataFrame, model: QualityModel) -> DataFrame:
    """Replaces x by score, from 0 to 1."""
    keep = [c for c in rows.columns if c != "x"]
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a few numbers per feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(shared.value.score(_matrix(batch)))], [*keep, "score"])

    return rows.mapInArrow(run, rows.select(*keep, F.lit(0.0).alias("score")).schema)


def classify(docs: DataFrame, labels: DataFrame, held_out: F.Column, text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs, learned from rows that aren't held out.

    Trusted positives are rows whose id is labelled 1 (by any label row); labels 0 and null are not
    used. A null or empty text has the features of an empty text and a score like any other.
    """
    rows = stage(with_features(docs.withColumn("held_out", held_out), text, ("doc_id", "held_out")), "features")
    trusted = labels.where("quality = 1").select("doc_id").distinct().withColumn("_good", F.lit(True))
    train = rows.where(~F.col("held_out")).join(trusted, "doc_id", "left").select("x", F.coalesce("_good", F.lit(False)).alias("positive"))
    model = fit(stage(train, "train"))
    return score(rows, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
