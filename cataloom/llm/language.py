"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Fitted by follow-the-regularised-leader with elastic-net penalties, then calibrated by one
temperature on rows left out of the fit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, extended, plain, rebuilt, slices, to_python
from .setjoin import mix
from .training import sampled

#: Features by hashing, orders of n-grams, labelled rows of each language in the fit, bytes of a text in the fit.
FEATURES, ORDERS = 1 << 16, (1, 2, 3)
FIT_ROWS, FIT_BYTES = 400, 32_768
UNKNOWN = "und"


@dataclass
class Model:
    classes: list[str]
    weights: np.ndarray  # features x classes, idf included
    bias: np.ndarray
    temperature: float


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed character n-grams of all texts, the offsets of each text's part, and whether it has a letter.

    Characters are lower-cased; white space counts as one blank. Null texts are empty.
    """
    values = [(t or "").lower() for t in texts.to_pylist()]
    letter = np.array([any(map(str.isalpha, t)) for t in values], bool)
    chars = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    chars = np.where((chars <= 32) | (chars == 160), np.uint64(32), chars)
    count = np.array([len(t) for t in values], np.int64)
    ends = np.cumsum(count)
    parts, kept = [], []
    text = np.repeat(np.arange(len(values)), count)
    for n in ORDERS:
        if len(chars) < n:
            continue
        code = np.full(len(chars) - n + 1, n, np.uint64)
        for j in range(n):
            code = code * np.uint64(1 << 21) + chars[j:len(chars) - n + 1 + j]
        inside = text[:len(code)] == text[n - 1:]
        parts.append((mix(code[inside]) >> np.uint64(48)).astype(np.int32))
        kept.append(np.bincount(text[:len(code)][inside], minlength=len(values)))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(len(values) + 1, np.int64), letter
    # order by text: the parts of each order are in text order already
    sizes = np.array(kept)
    owner = np.concatenate([np.repeat(np.arange(len(values)), k) for k in sizes])
    order = np.argsort(owner, kind="stable")
    del ends
    return np.concatenate(parts)[order], np.concatenate([[0], np.cumsum(sizes.sum(0))]), letter


def document_counts(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all ``texts`` (text) each feature occurs, and the number of texts."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, flags = np.zeros(FEATURES, np.int64), 0, np.zeros(FEATURES, bool)
        for batch in batches:
            for part in slices(batch, 0):
                grams, offsets, _ = ngrams(part.column(0))
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    flags[grams[a:b]] = True
                    total += flags
                    flags[grams[a:b]] = False
                rows += part.num_rows
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(total[used], rows))], names=["feature", "n"])

    # at most FEATURES + 1 rows reach the driver
    got = to_python(texts.select("text")).mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    counts, rows = np.zeros(FEATURES), 0
    for r in got:
        if r["feature"] < 0:
            rows = r["n"]
        else:
            counts[r["feature"]] = r["n"]
    return counts, rows


def fit(examples: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray, epochs: int = 4,
        alpha: float = 2.0, beta: float = 1.0, l1: float = 2e-5, l2: float = 1e-4, seed: int = 3) -> Model | None:
    """FTRL-proximal over (features, counts, language); every fifth example only sets the temperature."""
    classes = sorted({y for _, _, y in examples})
    if not classes:
        return None
    index = {c: i for i, c in enumerate(classes)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(examples))
    held, used = order[::5], [i for k, i in enumerate(order) if k % 5] or list(order)
    z, n = np.zeros((FEATURES + 1, len(classes))), np.zeros((FEATURES + 1, len(classes)))

    def weights(rows):
        zr, nr = z[rows], n[rows]
        return np.where(np.abs(zr) <= l1, 0.0, -(zr - np.sign(zr) * l1) / ((beta + np.sqrt(nr)) / alpha + l2))

    def inputs(i):
        features, counts, y = examples[i]
        return np.append(features, FEATURES), np.append(counts / max(counts.sum(), 1) * idf[features] * 10, 1.0), index[y]

    for _ in range(epochs):
        for i in rng.permutation(used):
            rows, x, y = inputs(i)
            w = weights(rows)
            logit = x @ w
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[rows] + g * g) - np.sqrt(n[rows])) / alpha
            z[rows] += g - sigma * w
            n[rows] += g * g
    full = weights(np.arange(FEATURES + 1))
    logits = np.array([inputs(i)[1] @ full[inputs(i)[0]] for i in held]).reshape(len(held), len(classes))
    truth = np.array([index[examples[i][2]] for i in held], np.int64)
    best = min(np.geomspace(0.05, 20, 121), key=lambda t: _loss(logits / t, truth)) if len(held) else 1.0
    return Model(classes, (full[:-1] * idf[:, None] * 10).astype(np.float32), full[-1].astype(np.float32), float(best))


def _loss(logits: np.ndarray, truth: np.ndarray) -> float:
    top = logits.max(1, keepdims=True)
    return float((np.log(np.exp(logits - top).sum(1)) + top[:, 0] - logits[np.arange(len(truth)), truth]).mean())


def predict(model: Model | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and calibrated probability of each text."""
    grams, offsets, letter = ngrams(texts)
    if model is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    count = np.diff(offsets)
    some = np.flatnonzero(count > 0)
    logits = np.zeros((len(texts), len(model.classes)))
    for c in range(len(model.classes)):
        if len(some):
            logits[some, c] = np.add.reduceat(model.weights[:, c][grams], offsets[:-1][some], dtype=np.float64) / count[some]
    logits = (logits + model.bias) / model.temperature
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    return ([model.classes[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letter.tolist())],
            np.where(letter, p[np.arange(len(best)), best], 0.0))


def train(docs: DataFrame, parts: int = 4, bucket: int = 2, most: int = FIT_ROWS) -> Model | None:
    """The model fitted on rows with text, a language and a crc32(doc_id) modulo ``parts`` other than ``bucket``.

    Document frequencies come from all these rows. The weights come from about ``most`` rows of
    each language, chosen by a hash of doc_id among texts of up to ``FIT_BYTES`` bytes.
    """
    known = docs.select("doc_id", "text", "lang").where((crc_bucket("doc_id", parts) != bucket) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts, rows = document_counts(known)
    idf = np.log((1 + rows) / (1 + counts)) + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                grams, offsets, _ = ngrams(part.column(1))
                got = [np.unique(grams[a:b], return_counts=True) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([f.astype("<i4").tobytes() for f, _ in got], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in got], pa.binary())],
                    names=["doc_id", "lang", "features", "counts"])

    sample = sampled(known.where(F.octet_length("text") <= FIT_BYTES), "lang", most)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", "text", "lang").mapInArrow(run, f"doc_id {kind}, lang string, features binary, counts binary").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["lang"]))
    return fit([(np.frombuffer(r["features"], "<i4"), np.frombuffer(r["counts"], "<i4"), r["lang"]) for r in rows], idf)


def language(docs: DataFrame, parts: int = 4, bucket: int = 2) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the calibrated probability, for every whole text.

    Texts that are null or have no letter get ``und`` and 0, as do all texts if no row teaches a
    language. Only text enters a prediction. Columns named lang_pred or score are replaced.
    """
    model = train(docs, parts, bucket)
    shared = docs.sparkSession.sparkContext.broadcast(plain(model))  # FEATURES floats a language
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = names.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = rebuilt(shared.value, Model)
        for batch in batches:
            for part in slices(batch, at):
                lang, score = predict(model, part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    schema = extended(docs.select(*names).schema, lang_pred="string", score="double")
    return to_python(docs.select(*names)).mapInArrow(run, schema)
