"""Quality rules: gradient-boosted trees over document statistics, flattened into node arrays, with monotone constraints."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb

#: Statistic -> sign of its effect on quality: -1 more of it never raises the score, 1 never lowers it, 0 free.
STATISTICS = {
    "log_words": 0,
    "mean_word": 0,
    "letters": 1,
    "digits": 0,
    "capitals": -1,
    "symbols": -1,
    "shouts": -1,
    "ended_lines": 0,
    "repeated_lines": -1,
    "repeated_line_bytes": -1,
    "distinct_words": 0,
    "top_word": -1,
    "wordless": -1,
    "log_line": 0,
    "bars": -1,
    "repeated_runs": -1,
    "short_words": 0,
    "log_longest": 0,
}
NAMES, SIGNS = list(STATISTICS), np.array(list(STATISTICS.values()))


def _class(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


UPPER, LOWER, DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(bytes(range(48, 58)))
LETTER = UPPER | LOWER | _class(bytes(range(128, 256)))
SYMBOL, SHOUT, BAR, STOP = _class(b"#$%&*<>{}[]\\/@^~=+_`"), _class(b"!?"), _class(b"|"), _class(b".!?:;\"'")


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)


def _repeats(keys: np.ndarray, row: np.ndarray, n: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: items beyond the first of their kind, the weight of these, and the count of the commonest kind."""
    if not len(keys):
        return np.zeros(n), np.zeros(n), np.zeros(n)
    kind = (row.astype(np.uint64) << np.uint64(43)) | (keys >> np.uint64(21))  # texts of a chunk are fewer than 2**21
    order = np.argsort(kind, kind="stable")
    kind = kind[order]
    fresh = np.ones(len(kind), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    at = row[order]
    more = np.bincount(at[~fresh], minlength=n).astype(float)
    heavy = np.bincount(at[~fresh], weights=weight[order][~fresh], minlength=n) if weight is not None else more
    begins = np.flatnonzero(fresh)
    size = np.diff(np.append(begins, len(kind)))
    top = np.zeros(n)
    np.maximum.at(top, at[begins], size)
    return more, heavy, top


def statistics(texts: pa.Array) -> np.ndarray:
    """The statistics of each text, over the whole of it; all 0 for a null, an empty text or one without words."""
    out = np.zeros((len(texts), len(NAMES)))
    for w in tb.words(texts):
        n, data, b = len(w.rows), w.data, w.bounds
        words = np.diff(w.first).astype(float)
        share = np.maximum(words, 1)
        size = w.end - w.start
        dark = np.maximum(np.add.reduceat(np.append(size, 0), np.minimum(w.first[:-1], len(size))) * (words > 0), 1).astype(float)
        upper, letters = _per_text(UPPER[data], b), _per_text(LETTER[data], b)
        small = _per_text(LOWER[data], b)
        h = tb.span_hashes(data, w.start, w.end)
        more, _, top = _repeats(h, w.row, n)
        # Runs of five words.
        run = np.zeros(0, np.uint64)
        at = np.flatnonzero(np.arange(len(h)) + 5 <= w.first[1:][w.row]) if len(h) else np.zeros(0, np.int64)
        if len(at):
            run = h[at]
            for k in range(1, 5):
                run = tb.mix(run * np.uint64(31) + h[at + k])
        again, _, _ = _repeats(run, w.row[at], n)
        runs = np.maximum(np.bincount(w.row[at], minlength=n), 1)
        # Lines with a word.
        newline = data == 10
        line_of_byte = np.cumsum(newline)
        word_line = line_of_byte[w.start] if len(h) else np.zeros(0, np.int64)
        opens = np.ones(len(h), bool)
        if len(h):
            opens[1:] = (word_line[1:] != word_line[:-1]) | (w.row[1:] != w.row[:-1])
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(h)) - 1
        line_row = w.row[first]
        lines = np.bincount(line_row, minlength=n).astype(float)
        line_size = (w.end[last] - w.start[first]).astype(float) if len(h) else np.zeros(0)
        line_key = tb.span_hashes(data, w.start[first], w.end[last]) if len(h) else np.zeros(0, np.uint64)
        twice, twice_size, _ = _repeats(line_key, line_row, n, line_size)
        ended = np.bincount(line_row, weights=STOP[data[w.end[last] - 1]] if len(h) else None, minlength=n)
        line_bytes = np.bincount(line_row, weights=line_size, minlength=n)
        has_letter = np.concatenate([[0], np.cumsum(LETTER[data])])
        wordless = np.bincount(w.row, weights=has_letter[w.end] == has_letter[w.start], minlength=n)
        longest = np.zeros(n)
        np.maximum.at(longest, w.row, size)
        columns = [
            np.log1p(words),
            dark / share,
            letters / dark,
            _per_text(DIGIT[data], b) / dark,
            upper / np.maximum(upper + small, 1),
            _per_text(SYMBOL[data], b) / dark,
            _per_text(SHOUT[data], b) / dark,
            ended / np.maximum(lines, 1),
            twice / np.maximum(lines, 1),
            twice_size / np.maximum(line_bytes, 1),
            1 - more / share,
            top / share,
            wordless / share,
            np.log1p(line_bytes / np.maximum(lines, 1)),
            _per_text(BAR[data], b) / dark,
            again / runs,
            np.bincount(w.row, weights=size <= 3, minlength=n) / share,
            np.log1p(longest),
        ]
        out[w.rows] = np.where((words > 0)[:, None], np.stack(columns, 1), 0)
    return out


@dataclass
class Trees:
    """All trees in one set of node arrays. A leaf is its own child; roots has each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray = SIGNS, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Logistic boosting over quantile bins. A split against a feature's sign is refused, and the leaves below a split on a signed feature keep to its side of the two children's middle, so the score is monotone in it."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], 1)
    width = max(len(e) for e in edges) + 1
    flat = binned + np.arange(m) * width
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    raw = np.full(n, base)
    nodes: list[list[float]] = []
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        roots.append(len(nodes))
        nodes.append([0, 0, 0, 0, 0])
        work = [(roots[-1], np.arange(n), -np.inf, np.inf, 0)]
        while work:
            node, rows, low, high, level = work.pop()
            G, H = g[rows].sum(), h[rows].sum()
            weight = float(np.clip(G / (H + ridge), low, high))
            best = (1e-6, None)
            if level < depth and len(rows) > 1:
                where = flat[rows].ravel()
                gs = np.bincount(where, np.repeat(g[rows], m), m * width).reshape(m, width).cumsum(1)
                hs = np.bincount(where, np.repeat(h[rows], m), m * width).reshape(m, width).cumsum(1)
                gl, hl = gs[:, :-1], hs[:, :-1]
                gr, hr = G - gl, H - hl
                wl, wr = np.clip(gl / (hl + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
                gain = (wl * gl - 0.5 * wl**2 * (hl + ridge)) + (wr * gr - 0.5 * wr**2 * (hr + ridge)) - (weight * G - 0.5 * weight**2 * (H + ridge))
                wrong = (signs[:, None] * (wr - wl) < 0) | (hl < least) | (hr < least)
                wrong |= np.arange(width - 1)[None, :] >= np.array([len(e) for e in edges])[:, None]
                gain[wrong] = -1
                j, k = divmod(int(gain.argmax()), width - 1)
                if gain[j, k] > best[0]:
                    best = (gain[j, k], (j, k, wl[j, k], wr[j, k]))
            if best[1] is None:
                nodes[node] = [0, np.inf, node, node, rate * weight]
                raw[rows] += rate * weight
                continue
            j, k, wl, wr = best[1]
            left, right = len(nodes), len(nodes) + 1
            nodes += [[0] * 5, [0] * 5]
            nodes[node] = [j, edges[j][k], left, right, 0]
            goes = binned[rows, j] <= k
            middle = (wl + wr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(signs[j])]
            work += [(left, rows[goes], *bounds[0], level + 1), (right, rows[~goes], *bounds[1], level + 1)]
    f, t, left, right, v = (np.array(c) for c in zip(*nodes))
    return Trees(f.astype(np.int32), t.astype(float), left.astype(np.int32), right.astype(np.int32), v.astype(float), np.array(roots, np.int32), depth, base)


def train(docs: DataFrame, labels: DataFrame, rows: int = 12000) -> tuple[Trees, float] | None:
    """Trees and the least score of a kept document, from a bounded sample of labelled documents: the `rows` of least id hash. Three quarters train; on the rest the threshold makes the fewest errors, with a good document's loss counted five times. With so few labels that the rest has fewer than 8, or the training part only one class, all of them train and set the threshold too. Of several labels of one id the least counts, of several texts the one of least statistics; null ids, labels and texts are left out. None if a class is missing."""
    label = labels.select(F.col("doc_id").cast("long").alias("id"), "quality").where("id is not null and quality is not null").groupBy("id").agg(F.min("quality").alias("quality"))
    few = [(r.id, r.quality) for r in label.orderBy(F.xxhash64("id"), "id").limit(rows).collect()]
    if not few:
        return None
    # The bound is a parameter, so what is broadcast and collected doesn't grow with the corpus.
    chosen = docs.sparkSession.createDataFrame(few, "id long, quality int")
    found = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id").select("id", "quality", "text").mapInArrow(_labelled, "id long, quality int, x array<double>").toPandas()
    if found.empty:
        return None
    found = found.assign(order=found.x.map(tuple)).sort_values(["id", "order"], kind="stable").drop_duplicates("id")
    x, y = np.stack(found.x.to_numpy()), found.quality.to_numpy().astype(float)
    if y.min() == y.max():
        return None
    held = np.arange(len(y)) % 4 == 3
    if held.sum() < 8 or y[~held].min() == y[~held].max():
        held[:] = False
    trees = fit(x[~held], y[~held])
    check = held if held.any() else ~held
    p, good = trees.probability(x[check]), y[check] > 0
    grid = np.linspace(0.05, 0.95, 91)
    cost = [5 * (good & (p < t)).sum() + (~good & (p >= t)).sum() for t in grid]
    best = np.flatnonzero(np.array(cost) == min(cost))
    return trees, float(grid[best[len(best) // 2]])


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column(2))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "quality", "x"])


def _judge(model: tuple[Trees, float] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(batch.num_columns - 1))
            p = model[0].probability(x) if model else np.ones(len(x))
            keep = (p >= (model[1] if model else 0)) & (x[:, 0] > 0)
            p = np.where(x[:, 0] > 0, p, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p), pa.array(keep)], names=[*batch.schema.names[:-1], "score", "keep"])

    return run


def score(docs: DataFrame, model: tuple[Trees, float] | None) -> DataFrame:
    """(doc_id, score, keep): one row for each row of docs, from statistics of the whole text.

    A null or empty text, or one without words, has score 0 and isn't kept; without a model every other text is kept
    with score 1. Rows that repeat are each judged, and alike; a score equal to the threshold is kept; a null id stays null;
    an empty table stays empty; other columns aren't read.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_judge(model), "doc_id long, score double, keep boolean")


def good_documents(docs: DataFrame, labels: DataFrame, rows: int = 12000) -> DataFrame:
    """The rows of score() that are kept, by a model of docs and labels."""
    return score(docs, train(docs, labels, rows)).where("keep")


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = 12000) -> DataFrame:
    """docs without the rows that score() doesn't keep (null, empty and rejected texts), all columns as they were: judged in place, so nothing is joined or shuffled. Rows that repeat, ties and empty tables are as there."""
    from pyspark.sql import types as T

    model = train(docs, labels, rows)

    def run(batches):
        for batch in batches:
            at = batch.schema.names.index("text")
            x = statistics(batch.column(at))
            p = model[0].probability(x) if model else np.ones(len(x))
            yield batch.filter(pa.array((p >= (model[1] if model else 0)) & (x[:, 0] > 0)))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
