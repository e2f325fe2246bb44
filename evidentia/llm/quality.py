"""Quality scores by a generalised additive model with pairwise interactions.

Shallow trees are boosted in turns: one feature after another, round by round,
each tree cutting one feature's bins into up to three parts, so that the trees
of a feature add up to one look-up table. Pairs of features are then ranked by
what a two-way cut of the residuals would gain, and the best pairs are boosted
in turns the same way. A score is the sigmoid of a sum of table entries.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import tidy

#: Bound of the labelled rows that a model is fitted on.
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS = 24, 12
ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 150, 60, 10, 0.15
RIDGE = 5.0

_ASCII_LETTERS = bytes([*range(65, 91), *range(97, 123)])
_DELETE = {
    "upper": bytes(range(65, 91)),
    "letters": _ASCII_LETTERS,
    "digits": bytes(range(48, 58)),
    "marks": b".,;:'\"()-?",
    "shouts": b"!",
    "pipes": b"|",
    "symbols": b"#$%&*@^~<>{}[]\\/_=+`",
    "space": b" \t\r\x0b\x0c",
    "lines": b"\n",
}
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "letters", "upper", "digits", "marks", "shouts", "pipes", "symbols",
    "space", "lines", "other", "distinct_words", "distinct_lines", "top_word", "marked_words", "repeated_marks",
)
_REPEATED = re.compile(rb"([^\w\s\x80-\xff])\1")


def features(text: str | None) -> list[float]:
    """Language-neutral measures of a whole text; an empty one gives zeros."""
    data = (text or "").encode()
    n = len(data)
    if not n:
        return [0.0] * len(FEATURES)
    count = {k: n - len(data.translate(None, v)) for k, v in _DELETE.items()}
    words = data.split()
    w = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    ends = b"".join([x[-1:] for x in words])
    high = n - len(data.translate(None, bytes(range(128, 256))))
    return [
        np.log1p(n), np.log1p(len(words)), (n - count["space"] - count["lines"]) / w,
        (count["letters"] + high) / n, count["upper"] / max(1, count["letters"]),
        *[count[k] / n for k in ("digits", "marks", "shouts", "pipes", "symbols", "space", "lines")],
        high / n, len(seen) / w, len(set(lines)) / max(1, len(lines)),
        max(seen.values(), default=0) / w, len(ends.translate(None, _ASCII_LETTERS + bytes(range(128, 256)))) / w,
        len(_REPEATED.findall(data)) / w,
    ]


@dataclass
class Gam:
    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_cuts: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, j], "right")]
        coarse = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.pair_cuts)]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[a], coarse[b]]
        return 1.0 / (1.0 + np.exp(-total))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Bin edges: quantiles of the rows and of the distinct values, so that rare
    values get bins too."""
    low = np.quantile(x, np.arange(1, bins) / bins, method="lower")
    values = np.unique(x)
    spread = values[np.linspace(0, len(values) - 1, bins).astype(int)[1:]]
    return np.unique(np.concatenate([low, spread]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Best step function with up to three parts over bins, in Newton steps."""
    cg, ch = np.cumsum(g), np.cumsum(h)
    n = len(g)
    if n < 2:
        return np.zeros(n)
    left = _gain(cg, ch)
    right = _gain(cg[-1] - cg, ch[-1] - ch)
    # Two cuts, after bins i < j; j at the last bin means one cut only.
    middle = _gain(cg[None, :] - cg[:, None], ch[None, :] - ch[:, None])
    gain = np.where(np.arange(n)[:, None] < np.arange(n)[None, :], left[:, None] + middle + np.append(right[:-1], 0)[None, :], -np.inf)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty(n)
    for part in (slice(0, i + 1), slice(i + 1, j + 1), slice(j + 1, n)):
        out[part] = g[part].sum() / (h[part].sum() + RIDGE)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Best cut of a grid into four quadrants, and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def quarters(c: np.ndarray) -> list[np.ndarray]:
        a = c[:-1, :-1]
        top, side, all_ = c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [a, top - a, side - a, all_ - top - side + a]

    if min(g.shape) < 2:
        return np.zeros_like(g), 0.0
    gs, hs = quarters(cg), quarters(ch)
    gain = sum(_gain(x, y) for x, y in zip(gs, hs, strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    places = [(slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))]
    for place, x, y in zip(places, gs, hs, strict=True):
        out[place] = x[i, j] / (y[i, j] + RIDGE)
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Fit the model; without rows or with one class only it is a constant."""
    rows, width = len(y), x.shape[1]
    rate = (y.sum() + 1) / (rows + 2)
    base = float(np.log(rate / (1 - rate)))
    cuts = [_cuts(x[:, j], BINS) if rows else np.empty(0) for j in range(width)]
    coarse_cuts = [_cuts(x[:, j], PAIR_BINS) if rows else np.empty(0) for j in range(width)]
    model = Gam(base, cuts, [np.zeros(len(c) + 1) for c in cuts], [], coarse_cuts, [])
    if rows == 0 or y.min() == y.max():
        return model
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
    total = np.full(rows, base)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(width):
            g, h = residuals()
            size = len(model.tables[j])
            step = RATE * _tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size))
            model.tables[j] += step
            total += step[bins[j]]
    coarse = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(coarse_cuts)]

    def grid(a: int, b: int, values: np.ndarray) -> np.ndarray:
        n, m = len(coarse_cuts[a]) + 1, len(coarse_cuts[b]) + 1
        return np.bincount(coarse[a] * m + coarse[b], values, n * m).reshape(n, m)

    g, h = residuals()
    ranked = sorted(
        ((_pair_tree(grid(a, b, g), grid(a, b, h))[1], a, b) for a in range(width) for b in range(a + 1, width)), reverse=True
    )
    model.pairs = [(a, b) for _, a, b in ranked[:PAIRS]]
    model.pair_tables = [np.zeros((len(coarse_cuts[a]) + 1, len(coarse_cuts[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = residuals()
            step = RATE * _pair_tree(grid(a, b, g), grid(a, b, h))[0]
            table += step
            total += step[coarse[a], coarse[b]]
    return model


def held_out(key: str = "doc_id"):
    """Whether a row's label is never learned from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def fit_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> Gam:
    """Fit on about ``sample_rows`` labelled rows at most, chosen by a hash of the key.

    Rows that are held out, or have a null key or label, are left out; of
    several labels of a key the smallest counts. The features of the sample,
    18 numbers a row, are what the driver gathers.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key))
    usable = usable.groupBy(F.col(key).alias("_key")).agg(F.min(label).cast("int").alias("_label"))
    share = min(1.0, sample_rows / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    rows = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text")).join(
        F.broadcast(chosen), F.col("_doc") == F.col("_key")
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_doc"), batch.column("_label"), pa.array(x, pa.list_(pa.float64()))], names=["doc", "y", "x"]
            )

    got = rows.select(F.col("_doc").cast("long").alias("_doc"), "_label", "_text").mapInArrow(
        tidy(measure), "doc long, y int, x array<double>"
    ).collect()
    got.sort(key=lambda r: (r["doc"], r["x"]))  # the same model whatever the order of tasks
    x = np.array([r["x"] for r in got], float).reshape(len(got), len(FEATURES))
    return fit(x, np.array([r["y"] for r in got], float))


def score_quality(docs: DataFrame, model: Gam, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every whole text, empty ones too. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column("text").to_pylist()], float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(model.scores(x))], names=[key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tidy(run), f"`{key}` {kind}, score double")


def quality_filter(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows of ``docs`` with a score of at least ``threshold``; all columns stay."""
    model = fit_quality(docs, labels, key, text)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = dict(zip(names, batch.columns, strict=True))
            x = np.array([features(t) for t in row[text].to_pylist()], float).reshape(batch.num_rows, len(FEATURES))
            yield batch.filter(pa.array(model.scores(x) >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
