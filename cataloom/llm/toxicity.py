"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters as a learned vector, if the fit's sample has it often enough, beside the mean
of the vectors of its character trigrams. A document's score is the highest score of its
overlapping windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, extended, plain, rebuilt, release, slices, to_python
from .setjoin import mix
from .training import coded_texts, labelled, word_codes

WINDOW, STRIDE = 32, 24
WORDS, GRAMS, DIM, HIDDEN = 4096, 2048, 8, 8
THRESHOLD = 0.7
#: Labelled rows of each label in the fit.
FIT_ROWS = {1: 2000, 0: 3500}
_NAMES = ("word", "gram", "wx", "u", "b", "att", "out", "bias")


@dataclass
class Model:
    """Sorted word hashes and the network's arrays; ``wx``, ``u`` and ``b`` hold both directions.

    ``slope`` and ``shift`` turn a text's highest window logit into the log odds of its label.
    """

    words: np.ndarray
    arrays: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0


def trigrams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams, with word marks at both ends, of all words; and each one's word."""
    length = end - start
    word = np.repeat(np.arange(len(start)), length)
    base = np.cumsum(length) - length
    at = np.arange(len(word)) - base[word]
    here = data[start[word] + at].astype(np.uint64)
    left = np.where(at > 0, data[np.maximum(start[word] + at - 1, 0)], 1).astype(np.uint64)
    right = np.where(at < length[word] - 1, data[np.minimum(start[word] + at + 1, len(data) - 1)], 2).astype(np.uint64)
    return (mix(left << np.uint64(16) | here << np.uint64(8) | right) % np.uint64(GRAMS)).astype(np.int64), word


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _inputs(model: Model, data, start, end, hashed) -> tuple[np.ndarray, tuple]:
    """Vectors of distinct words (word vector, then mean of character vectors), and what made them."""
    p = model.arrays
    at = np.minimum(np.searchsorted(model.words, hashed), max(len(model.words) - 1, 0))
    known = model.words[at] == hashed if len(model.words) else np.zeros(len(hashed), bool)
    rows = np.where(known, at + 1, 0)  # row 0: any other word
    grams, owner = trigrams(data, start, end)
    count = np.maximum(np.bincount(owner, minlength=len(start)), 1)
    chars = np.empty((len(start), DIM), np.float32)
    for j in range(DIM):
        chars[:, j] = np.bincount(owner, weights=p["gram"][grams, j], minlength=len(start)) / count
    return np.concatenate([p["word"][rows], chars], 1), (rows, grams, owner, count)


def _run(p: dict, projected: np.ndarray, ids: np.ndarray, valid: np.ndarray, keep: bool = False):
    """States of both directions, (2, T, B, H), for windows ``ids`` (B, T) into ``projected``."""
    b, t = ids.shape
    states = np.zeros((2, t, b, HIDDEN), np.float32)
    memory = [[None] * t, [None] * t]
    for d in (0, 1):
        h = np.zeros((b, HIDDEN), np.float32)
        u_gate, u_new = p["u"][d][:, :2 * HIDDEN], p["u"][d][:, 2 * HIDDEN:]
        for step in range(t) if d == 0 else range(t - 1, -1, -1):
            x = projected[d][ids[:, step]]
            gates = _sigmoid(x[:, :2 * HIDDEN] + h @ u_gate)
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            held = r * h
            new = np.tanh(x[:, 2 * HIDDEN:] + held @ u_new)
            ok = valid[:, step, None]
            after = h + ok * z * (new - h)
            if keep:
                memory[d][step] = (h, z, r, new)
            h = after
            states[d, step] = h
    return states, memory


def _pool(p: dict, states: np.ndarray, valid: np.ndarray):
    """Attention weights, pooled states and window logits."""
    both = np.concatenate([states[0], states[1]], 2)  # T, B, 2H
    seen = np.tanh(both)
    logits = (seen @ p["att"]).T - 1e9 * (1 - valid)
    weights = np.exp(logits - logits.max(1, keepdims=True)) * valid
    weights /= np.maximum(weights.sum(1, keepdims=True), 1e-9)
    pooled = np.einsum("bt,tbh->bh", weights, both)
    return both, seen, weights, pooled, pooled @ p["out"] + p["bias"][0]


def _project(p: dict, vectors: np.ndarray) -> np.ndarray:
    return np.stack([vectors @ p["wx"][d] + p["b"][d] for d in (0, 1)]).astype(np.float32)


def _projected(model: Model, data, start, end, hashed, words: int = 16_384) -> np.ndarray:
    """Both directions' inputs of all distinct words, made for ``words`` of them at a time."""
    out = np.empty((2, len(start), 3 * HIDDEN), np.float32)
    for a in range(0, len(start), words):
        part = slice(a, a + words)
        out[:, part] = _project(model.arrays, _inputs(model, data, start[part], end[part], hashed[part])[0])
    return out


def windows_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and text of all overlapping windows of texts with words."""
    count = np.diff(offsets)
    many = np.where(count > WINDOW, -(-(count - WINDOW) // STRIDE) + 1, (count > 0).astype(np.int64))
    text = np.repeat(np.arange(len(count)), many)
    base = np.cumsum(many) - many
    begin = (np.arange(len(text)) - base[text]) * STRIDE
    begin = np.minimum(begin, np.maximum(count[text] - WINDOW, 0))
    return offsets[:-1][text] + begin, np.minimum(count[text], WINDOW), text


def _cut(codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(WINDOW)
    valid = at < length[:, None]
    return codes[np.where(valid, start[:, None] + at, start[:, None])], valid.astype(np.float32)


def _gradients(p: dict, vectors, projected, ids, valid, target, weight):
    """Loss gradients with respect to all arrays, and to ``vectors``."""
    states, memory = _run(p, projected, ids, valid, keep=True)
    both, seen, weights, pooled, logit = _pool(p, states, valid)
    score = _sigmoid(logit)
    g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "gram")}
    d_logit = (score - target) * weight / len(target)
    g["bias"][0] = d_logit.sum()
    g["out"] = pooled.T @ d_logit
    d_pooled = d_logit[:, None] * p["out"]
    d_both = weights.T[:, :, None] * d_pooled[None]
    d_weight = np.einsum("tbh,bh->bt", both, d_pooled)
    d_att = weights * (d_weight - (weights * d_weight).sum(1, keepdims=True))
    g["att"] = np.einsum("bt,tbh->h", d_att, seen)
    d_both = d_both + d_att.T[:, :, None] * p["att"] * (1 - seen ** 2)
    d_projected = np.zeros_like(projected)
    for d in (0, 1):
        own = d_both[:, :, d * HIDDEN:(d + 1) * HIDDEN]
        carry = np.zeros((len(target), HIDDEN), np.float32)
        u_gate, u_new = p["u"][d][:, :2 * HIDDEN], p["u"][d][:, 2 * HIDDEN:]
        steps = range(WINDOW - 1, -1, -1) if d == 0 else range(WINDOW)
        for step in steps:
            h, z, r, new = memory[d][step]
            total = carry + own[step]
            ok = valid[:, step, None]
            d_new = total * ok * z * (1 - new ** 2)
            d_z = total * ok * (new - h) * z * (1 - z)
            d_held = d_new @ u_new.T
            d_r = d_held * h * r * (1 - r)
            d_gate = np.concatenate([d_z, d_r], 1)
            g["u"][d][:, 2 * HIDDEN:] += (r * h).T @ d_new
            g["u"][d][:, :2 * HIDDEN] += h.T @ d_gate
            carry = total * (1 - ok * z) + d_held * r + d_gate @ u_gate.T
            np.add.at(d_projected[d], ids[:, step], np.concatenate([d_gate, d_new], 1))
        g["wx"][d] = vectors.T @ d_projected[d]
        g["b"][d] = d_projected[d].sum(0)
    d_vectors = d_projected[0] @ p["wx"][0].T + d_projected[1] @ p["wx"][1].T
    return g, d_vectors, score


def fit(rows: list[tuple[str, int]], share: float | None = None, epochs: int = 10, seed: int = 5) -> Model | float:
    """The network fitted to labelled texts, or their share of label 1 if only one label is there.

    A toxic text need not be toxic in every window: its windows to learn from are those with the
    words that most set the labels apart, and from the third pass those that the network scores highest.
    At last two numbers map the highest window of a text to a probability, for a corpus in which
    ``share`` of the texts are toxic (not given: as many as in ``rows``).
    """
    target = np.array([y for _, y in rows], np.int64)
    if len(set(target.tolist())) < 2:
        return float(target.mean()) if len(target) else 0.0
    data, start, end, hashed, codes, offsets = coded_texts([t for t, _ in rows])
    pairs = np.unique(np.repeat(np.arange(len(rows)), np.diff(offsets)) * len(hashed) + codes)
    in_text, word = pairs // len(hashed), pairs % len(hashed)
    del pairs
    positive = np.bincount(word, weights=target[in_text], minlength=len(hashed))
    seen = np.bincount(word, minlength=len(hashed))
    odds = np.log((positive + 0.5) / (target.sum() + 1)) - np.log((seen - positive + 0.5) / (len(target) - target.sum() + 1))
    often = np.flatnonzero(seen >= 8)
    often = np.sort(often[np.argsort(-np.abs(odds[often]) * np.sqrt(seen[often]), kind="stable")[:WORDS]])
    rng = np.random.default_rng(seed)
    normal = lambda *shape: (rng.standard_normal(shape) * 0.25).astype(np.float32)
    p = {"word": normal(WORDS + 1, DIM), "gram": normal(GRAMS, DIM), "wx": normal(2, 2 * DIM, 3 * HIDDEN), "u": normal(2, HIDDEN, 3 * HIDDEN),
         "b": np.zeros((2, 3 * HIDDEN), np.float32), "att": normal(2 * HIDDEN), "out": normal(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
    model = Model(hashed[often], p)
    first, length, owner = windows_of(offsets)
    ids, valid = _cut(codes, first, length)
    del in_text, word, codes
    odds = np.where(seen >= 8, np.maximum(odds, 0), 0)
    clue = np.concatenate([(odds[ids[a:a + 4096]] * valid[a:a + 4096]).max(1) for a in range(0, len(ids), 4096)]) if len(ids) else np.zeros(0)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    step = 0
    for epoch in range(epochs):
        rank = _scores(model, data, start, end, hashed, ids, valid) if epoch >= 2 else clue
        order = np.lexsort((-rank, owner))
        top = np.ones(len(order), bool)
        top[1:] = owner[order][1:] != owner[order][:-1]
        toxic = target[owner] == 1
        best = np.zeros(len(owner), bool)
        best[order[top]] = True
        clear = toxic & ~best & (clue >= 2.5)
        clean = np.flatnonzero(~toxic)
        hard = clean[np.argsort(-rank[clean], kind="stable")[:4000]]
        some = rng.choice(clean, min(len(clean), 4000), replace=False)
        use = rng.permutation(np.unique(np.concatenate([np.flatnonzero(toxic & best), np.flatnonzero(clear)[:4000], hard, some])))
        for a in range(0, len(use), 256):
            part = use[a:a + 256]
            distinct, local = np.unique(ids[part], return_inverse=True)
            local = local.reshape(len(part), WINDOW)
            vectors, made = _inputs(model, data, start[distinct], end[distinct], hashed[distinct])
            y = target[owner[part]].astype(np.float32)
            g, d_vectors, _ = _gradients(p, vectors, _project(p, vectors), local, valid[part], y, np.ones(len(part), np.float32))
            rows_, grams, of_word, count = made
            g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
            np.add.at(g["word"], rows_, d_vectors[:, :DIM])
            np.add.at(g["gram"], grams, (d_vectors[:, DIM:] / count[:, None])[of_word])
            step += 1
            for k in _NAMES:
                grad = np.clip(g[k], -1, 1)
                m, v = moment[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad ** 2 - v)
                p[k] -= (0.01 * (1 - 0.8 * epoch / epochs) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-7)).astype(np.float32)
    highest = np.full(len(rows), -20.0)
    np.maximum.at(highest, owner, _scores(model, data, start, end, hashed, ids, valid))
    share = float(target.mean()) if share is None else share
    weight = np.where(target == 1, share / max(target.sum(), 1), (1 - share) / max((1 - target).sum(), 1)) * len(target)
    model.slope, model.shift = _calibrated(highest, target, weight)
    release()
    return model


def _calibrated(logit: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic regression on one number, by Newton's steps with a small penalty."""
    x = np.stack([logit, np.ones(len(logit))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (weight * (p - target)) + 1e-2 * (w - [1.0, 0.0])
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-2 * np.eye(2)
        move = np.linalg.solve(curve, gradient)
        w = w - move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-9))
    return max(float(w[0]), 1e-3), float(w[1])


def _scores(model: Model, data, start, end, hashed, ids, valid, rows: int = 4096) -> np.ndarray:
    """Logits of windows, ``rows`` at a time."""
    projected = _projected(model, data, start, end, hashed)
    out = np.empty(len(ids), np.float32)
    for a in range(0, len(ids), rows):
        states, _ = _run(model.arrays, projected, ids[a:a + rows], valid[a:a + rows])
        out[a:a + rows] = _pool(model.arrays, states, valid[a:a + rows])[4]
    return out


def score_texts(model: Model | float, texts: pa.Array) -> np.ndarray:
    """Probability of each text by its highest window; a text without words scores 0."""
    if not isinstance(model, Model):
        return np.full(len(texts), model)
    data, start, end, hashed, codes, offsets = word_codes(texts)
    first, length, owner = windows_of(offsets)
    highest = np.full(len(texts), -np.inf)
    if not len(first):
        return np.zeros(len(texts))
    projected = _projected(model, data, start, end, hashed)
    for a in range(0, len(first), 4096):
        ids, valid = _cut(codes, first[a:a + 4096], length[a:a + 4096])
        states, _ = _run(model.arrays, projected, ids, valid)
        np.maximum.at(highest, owner[a:a + 4096], _pool(model.arrays, states, valid)[4].astype(float))
    return np.where(np.isfinite(highest), 1 / (1 + np.exp(-np.clip(model.slope * highest + model.shift, -40, 40))), 0.0)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, parts: int = 3, bucket: int = 1) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold``), whole texts scored.

    Fitted on a sample (see ``training``) of rows whose crc32(doc_id) modulo ``parts`` is not
    ``bucket``; only text enters a score. Null and empty texts score 0. With labels of one kind
    only, all texts score that kind's share. Columns named score or predicted are replaced.
    """
    counts = {r["toxic"]: r["count"] for r in labels.where(F.col("toxic").isin(0, 1) & (crc_bucket("doc_id", parts) != bucket)).groupBy("toxic").count().collect()}
    model = fit(labelled(docs, labels, "toxic", parts, bucket, FIT_ROWS), counts.get(1, 0) / max(sum(counts.values()), 1))
    shared = docs.sparkSession.sparkContext.broadcast(plain(model))  # about 0.3 MB
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    at = names.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = rebuilt(shared.value, Model)
        for batch in batches:
            for part in slices(batch, at):
                score = score_texts(model, part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*names, "score"])

    schema = extended(docs.select(*names).schema, score="double")
    return to_python(docs.select(*names)).mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def fingerprint(model: Model) -> str:
    """Digest of a fitted model, for tests of repeatability."""
    return hashlib.sha256(b"".join(model.arrays[k].tobytes() for k in _NAMES)).hexdigest()
