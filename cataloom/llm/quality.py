"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, plain, rebuilt, slices, to_python
from .training import labelled

TREES, DEPTH, BINS, RATE = 80, 4, 64, 0.15
FIT_ROWS, FIT_BYTES = 3000, 131_072
THRESHOLD = 0.3
#: Statistics of a text, in the order of ``statistics``.
NAMES = ("bytes", "words", "lines", "word_bytes", "line_words", "upper", "lower", "digit", "mark", "blank", "high", "odd_mark", "repeat_mark",
         "distinct_words", "distinct_lines", "top_word", "repeat_word", "longest_word", "entropy", "short_lines", "line_end_mark", "title_words")
_CLASS = np.zeros(256, np.int64)
for _codes, _k in (((65, 91), 1), ((97, 123), 2), ((48, 58), 3), ((33, 48), 4), ((58, 65), 4), ((91, 97), 4), ((123, 127), 4), ((128, 256), 6)):
    _CLASS[slice(*_codes)] = _k
_CLASS[[9, 10, 11, 12, 13, 32]] = 5
_ODD = np.zeros(256, bool)
_ODD[[ord(c) for c in "#$%&*@^_|~<>{}[]\\/=+!"]] = True
_TITLE = re.compile(rb"(?:^|\s)[A-Z][a-z]+")


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` for each text, over all its bytes, words and lines; all 0 for a null or empty one."""
    out = np.zeros((len(texts), len(NAMES)), np.float32)
    for i, text in enumerate(texts.to_pylist()):
        if not text:
            continue
        raw = text.encode("utf-8", "surrogatepass")
        data = np.frombuffer(raw, np.uint8)
        n = len(data)
        seen = np.bincount(data, minlength=256)
        kinds = np.bincount(_CLASS, weights=seen, minlength=7) / n
        words, lines = raw.split(), raw.split(b"\n")
        filled = [x for x in lines if x.strip()]
        count = max(len(words), 1)
        tally: dict[bytes, int] = {}
        for w in words:
            tally[w] = tally.get(w, 0) + 1
        same = (data[1:] == data[:-1]) & (_CLASS[data[1:]] == 4)
        share = seen[seen > 0] / n
        again = sum(a == b for a, b in zip(words, words[1:]))
        out[i] = (np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), sum(map(len, words)) / count, count / max(len(filled), 1),
                  kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], seen[_ODD].sum() / n, same.sum() / n,
                  len(tally) / count, len(set(filled)) / max(len(filled), 1), max(tally.values(), default=0) / count, again / count,
                  max(map(len, words), default=0), -(share * np.log2(share)).sum(), sum(len(x) < 20 for x in filled) / max(len(filled), 1),
                  sum(x.rstrip()[-1:] in b".!?" for x in filled) / max(len(filled), 1), len(_TITLE.findall(raw)) / count)
    return out


@dataclass
class Model:
    """All trees in flat arrays: node ``i`` has children ``child[i]`` and ``child[i] + 1``; a leaf has its own number."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, l2: float = 1.0) -> Model | float:
    """Trees of logistic loss on binned statistics, or the share of label 1 if only one label is there."""
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    flat = binned + np.arange(x.shape[1]) * BINS
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), base)
    feature, cut, child, value, roots = [], [], [], [], []

    def add(v: float) -> int:
        feature.append(0)
        cut.append(np.inf)
        child.append(len(child))
        value.append(v)
        return len(value) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        root = add(0.0)
        roots.append(root)
        level = [(root, np.arange(len(y)))]
        for deep in range(depth + 1):
            following = []
            for node, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                best = None
                if deep < depth and len(rows) >= 20:
                    cells = flat[rows].ravel()
                    width = x.shape[1] * BINS
                    gb = np.bincount(cells, weights=np.repeat(g[rows], x.shape[1]), minlength=width).reshape(-1, BINS).cumsum(1)
                    hb = np.bincount(cells, weights=np.repeat(h[rows], x.shape[1]), minlength=width).reshape(-1, BINS).cumsum(1)
                    gain = gb ** 2 / (hb + l2) + (gs - gb) ** 2 / (hs - hb + l2) - gs ** 2 / (hs + l2)
                    gain[(hb < 1) | (hs - hb < 1)] = -1
                    f, b = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[f, b] > 1e-3 and b < len(edges[f]):
                        best = (int(f), int(b))
                if best is None:
                    value[node] = -rate * gs / (hs + l2)
                    margin[rows] += value[node]
                    continue
                f, b = best
                left, right = add(0.0), add(0.0)
                feature[node], cut[node], child[node] = f, float(edges[f][b]), left
                under = binned[rows, f] <= b
                following += [(left, rows[under]), (right, rows[~under])]
            level = following
    return Model(np.array(feature), np.array(cut, np.float32), np.array(child), np.array(value), np.array(roots), base)


def predict(model: Model | float, x: np.ndarray) -> np.ndarray:
    """Probabilities of label 1: all rows walk all trees at once, level by level."""
    if not isinstance(model, Model):
        return np.full(len(x), model)
    at = np.broadcast_to(model.roots, (len(x), len(model.roots))).copy()
    rows = np.arange(len(x))[:, None]
    for _ in range(DEPTH):
        leaf = model.child[at] == at
        at = np.where(leaf, at, model.child[at] + (x[rows, model.feature[at]] > model.cut[at]))
    return 1 / (1 + np.exp(-(model.base + model.value[at].sum(1))))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, parts: int = 5, bucket: int = 0) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold``) for every whole text.

    Fitted on a sample (see ``training``; ``FIT_ROWS`` rows a label, texts of up to ``FIT_BYTES``)
    of rows whose crc32(doc_id) modulo ``parts`` is not ``bucket``; only text enters a score. Null
    and empty texts are scored by statistics of 0. With one label only, its share is every score;
    without labels 0.5. Columns named score or predicted are replaced.
    """
    rows = labelled(docs, labels, "quality", parts, bucket, FIT_ROWS, FIT_BYTES)
    model = fit(statistics(pa.array([t for t, _ in rows], pa.string())), np.array([y for _, y in rows], float))
    shared = docs.sparkSession.sparkContext.broadcast(plain(model))
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    at = names.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = rebuilt(shared.value, Model)
        for batch in batches:
            for part in slices(batch, at):
                score = predict(model, statistics(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*names, "score"])

    schema = extended(docs.select(*names).schema, score="double")
    return to_python(docs.select(*names)).mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
