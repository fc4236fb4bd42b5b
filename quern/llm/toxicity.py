"""Toxic documents by compression distance: zstandard dictionaries of toxic and of ordinary text, compared window by window."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb

#: Characters of a word's first two beginnings; with the whole word they are its three parts of PART bytes each.
SHORT, STEM, PART = 4, 6, 8
WIDTH = 3 * PART
#: Longer words are cut into pieces of STEM characters, and those of scripts that are written without blanks into pieces of PAIR.
LONG, PAIR = 24, 2
WINDOW, STEP, BLOCK = 12, 9, 16
#: Sizes tried for each dictionary, as shares of the room that the different symbols of its samples take, and their least.
SHARES, LEAST, LEVEL = (1 / 160, 1 / 80, 1 / 40), 8192, 6
COMMON = 256
_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?\"'()[]{}|*#$%&<>")] = True


@dataclass(frozen=True)
class Model:
    """The two dictionaries, and the thresholds of a document's mean gain and of the mean gain of its densest run of BLOCK windows."""

    ordinary: bytes
    toxic: bytes
    mean: float
    block: float


def _inner(w: tb.Words) -> tuple[np.ndarray, np.ndarray]:
    """Where the words start and end without punctuation at their edges; of a word of nothing else the first mark stays."""
    solid = np.append(np.flatnonzero(~_EDGE[w.data]), len(w.data))
    start = solid[np.searchsorted(solid, w.start)]
    end = solid[np.maximum(np.searchsorted(solid, w.end) - 1, 0)] + 1
    bare = start >= w.end
    return np.where(bare, w.start, start), np.where(bare, w.start + 1, end)


def _unspaced(data: np.ndarray) -> np.ndarray:
    """Bytes that begin a character of a script written without blanks: Thai, Lao, Burmese, Khmer, and all from U+3000 to U+FFFF."""
    after = np.append(data[1:], 0) if len(data) else data
    south = (data == 0xE0) & (after >= 0xB8) & (after <= 0xBB) | (data == 0xE1) & ((after >= 0x80) & (after <= 0x82) | (after >= 0x9E) & (after <= 0x9F))
    return south | (data >= 0xE3) & (data <= 0xEF)


def _pieces(w: tb.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the pieces of the words start and end, as numbers of characters, the place of each character, and the index of each text's first piece. Most words are one piece."""
    start, end = _inner(w)
    opens = (w.data & 0xC0) != 0x80
    place = np.append(np.flatnonzero(opens), len(w.data))
    number = np.concatenate([[0], np.cumsum(opens)])
    a, b = number[start], number[end]
    unspaced = np.concatenate([[0], np.cumsum(_unspaced(w.data))])
    size = np.where(unspaced[end] > unspaced[start], PAIR, np.where(b - a > LONG, STEM, LONG))
    n = np.maximum(1, -(-(b - a) // size))
    before = np.concatenate([[0], np.cumsum(n)])
    size, last = np.repeat(size, n), np.repeat(b, n)
    first = np.repeat(a, n) + size * (np.arange(before[-1]) - np.repeat(before[:-1], n))
    return first, np.minimum(last, first + size), place, before[w.first]


def symbols(w: tb.Words) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of the texts' words and the index of each text's first. A symbol is WIDTH bytes: PART that depend on the word's first SHORT characters, PART on its first STEM and PART on all of it, without punctuation at its edges and with ASCII letters in lower case. A dictionary then matches whole beginnings of words, or whole words, and not a chance part of them."""
    first, last, place, index = _pieces(w)
    parts = [tb.span_hashes(w.data, place[first], place[np.minimum(last, first + n) if n else last]) for n in (SHORT, STEM, 0)]
    return np.stack([tb.mix(x + np.uint64(7 * k)) for k, x in enumerate(parts)], 1), index


def windows(text_symbols: np.ndarray) -> list[bytes]:
    """Windows of WINDOW symbols, each STEP symbols after the one before; together they hold every symbol. A text without words has none."""
    raw, n = text_symbols.tobytes(), len(text_symbols)
    return [raw[WIDTH * i : WIDTH * (i + WINDOW)] for i in range(0, max(1, n - WINDOW + STEP), STEP)] if n else []


def _with_common(dictionary: bytes, samples: list[bytes]) -> bytes:
    """The trainer may cut a very common symbol in two: those of the COMMON commonest that the dictionary lacks are put to its end, so that the commonest words never count as toxic."""
    seen = Counter(x[i : i + WIDTH] for x in samples for i in range(0, len(x), WIDTH))
    return dictionary + b"".join(s for s, _ in seen.most_common(COMMON) if s not in dictionary)


def _compressors(model: Model):
    def made(content: bytes):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    # The ordinary dictionary lies next to the window in both, so ordinary words cost the same in either, and only words of the toxic one make a difference.
    return made(model.ordinary), made(model.toxic + model.ordinary)


def gains(found: list[bytes], pair) -> np.ndarray:
    """Bytes that each window is shorter by with the toxic dictionary."""
    plain, toxic = pair[0].compress, pair[1].compress
    return np.fromiter((len(plain(x)) - len(toxic(x)) for x in found), np.int32, len(found))


def scores(gain: np.ndarray) -> tuple[float, float]:
    """Mean gain of a text's windows, and that of the densest BLOCK of them in a row."""
    if len(gain) <= BLOCK:
        return (float(gain.mean()),) * 2 if len(gain) else (0.0, 0.0)
    total = np.concatenate([[0], np.cumsum(gain)])
    return float(gain.mean()), float((total[BLOCK:] - total[:-BLOCK]).max() / BLOCK)


def _text_windows(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    for w in tb.words(texts):
        found, first = symbols(w)
        for i, row in enumerate(w.rows):
            yield int(row), windows(found[first[i] : first[i + 1]])


def _room(samples: list[bytes]) -> int:
    """Bytes that the different symbols of the samples take."""
    return WIDTH * len({x[i : i + WIDTH] for x in samples for i in range(0, len(x), WIDTH)})


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary of about `size` bytes, trained on the samples; where they are too few to choose from, all of their symbols."""
    try:
        return zstandard.train_dictionary(size, samples, k=WIDTH, d=PART, dict_id=1).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sorted({x[i : i + WIDTH] for x in samples for i in range(0, len(x), WIDTH)}))


def _sizes(samples: list[bytes]) -> list[int]:
    room = _room(samples)
    return sorted({min(max(LEAST, int(share * room)), 4 * room + 256) for share in SHARES})


def _calibrated(ordinary: bytes, toxic: bytes, held: dict[int, list[list[bytes]]]) -> tuple[float, Model]:
    """The model of two dictionaries with thresholds from the held documents of either class, and its F0.5 on these."""
    pair = _compressors(Model(ordinary, toxic, 0, 0))
    found = {kind: np.array([scores(gains(d, pair)) for d in held[kind] if d]).reshape(-1, 2) for kind in (0, 1)}
    best = (-1.0, 0.0)
    for t in np.unique(found[1][:, 0]):
        hit, false = (found[1][:, 0] >= t).sum(), (found[0][:, 0] >= t).sum()
        # A tie goes to the higher threshold.
        best = max(best, (1.25 * hit / (hit + false + 0.25 * len(found[1])), float(t)))
    # Half way to the next lower score, so that the threshold doesn't sit on one document's.
    lower = np.concatenate([found[1][:, 0], found[0][:, 0]])
    lower = lower[lower < best[1]]
    mean = max((best[1] + float(lower.max())) / 2 if len(lower) else best[1], 1e-6)
    block = max(float(np.quantile(found[0][:, 1], 0.995)) if len(found[0]) else 0.0, 2 * mean)
    return best[0], Model(ordinary, toxic, mean, block + 1e-9)


def fit(trained: dict[int, list[list[bytes]]], held: dict[int, list[list[bytes]]]) -> Model | None:
    """The model of the windows of toxic (1) and ordinary (0) documents: of the dictionaries of each pair of sizes, those with the best F0.5 on the held documents, of equals the smaller."""
    common = list(dict.fromkeys(x for d in trained[0] for x in d))
    known = set(common)
    own = [x for x in dict.fromkeys(x for d in trained[1] for x in d) if x not in known]
    if not own or not common:
        return None
    toxic = [_dictionary(own, size) for size in _sizes(own)]
    best: tuple[float, Model] | None = None
    for size in _sizes(common):
        ordinary = _with_common(_dictionary(common, size), common)
        for one in toxic:
            found = _calibrated(ordinary, one, held)
            best = found if best is None or found[0] > best[0] + 1e-9 else best
    return best[1]


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = 1500, ordinary_rows: int = 3000) -> Model | None:
    """Fits on a bounded sample of labelled documents, at most toxic_rows and ordinary_rows of them, those of least id hash. Three quarters train the dictionaries; the rest chooses their sizes and sets the thresholds: the mean's has the best F0.5, the block's lies above 99.5 % of ordinary documents and above the mean's. A class of fewer than four documents has none to hold back, so all of its documents train and set the thresholds too. None if one of the classes is missing."""
    label = labels.select(F.col("doc_id").cast("long").alias("id"), "toxic").where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("id"), F.col("id")]
    chosen = label.where("toxic = 1").orderBy(*order).limit(toxic_rows).unionByName(label.where("toxic = 0").orderBy(*order).limit(ordinary_rows))
    ids = {r.id: r.toxic for r in chosen.collect()}
    if not ids:
        return None
    # Both bounds are parameters, so what is broadcast and collected doesn't grow with the corpus.
    few = docs.sparkSession.createDataFrame([(i,) for i in ids], "id long")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("text is not null").join(F.broadcast(few), "id").groupBy("id").agg(F.min("text").alias("text")).orderBy(*order).toArrow()
    names = rows.column("id").to_pylist()
    found = {names[i]: w for i, w in _text_windows(rows.column("text").combine_chunks())} if names else {}
    sides = {(kind, half): [] for kind in (0, 1) for half in (0, 1)}
    seen = {0: 0, 1: 0}
    for i in names:
        kind = int(ids[i] == 1)
        sides[kind, int(seen[kind] % 4 == 3)].append(found.get(i, []))
        seen[kind] += 1
    if not sides[1, 0] or not sides[0, 0]:
        return None
    return fit({k: sides[k, 0] for k in (0, 1)}, {k: sides[k, 1] or sides[k, 0] for k in (0, 1)})


@lru_cache(2)
def _cached(model: Model):
    return _compressors(model)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _cached(model)
        for batch in batches:
            n = batch.num_rows
            mean, block, count = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
            for row, found in _text_windows(batch.column(1)):
                mean[row], block[row] = scores(gains(found, pair))
                count[row] = len(found)
            toxic = (mean >= model.mean) | (block >= model.block)
            yield pa.record_batch([batch.column(0), pa.array(count), pa.array(mean), pa.array(block), pa.array(toxic)], names=["doc_id", "n_windows", "gain", "densest_gain", "toxic"])

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, n_windows, gain, densest_gain, toxic): one row for each row of docs.

    Every window of the whole text counts, and every byte of every word. A null or empty text has no window, no gain and isn't toxic; so is every
    text where there is no model. Rows that repeat are each scored, and alike; a score equal to a
    threshold is toxic; a null id stays null; an empty table stays empty; other columns aren't read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return rows.select("doc_id", F.lit(0).cast("long").alias("n_windows"), F.lit(0.0).alias("gain"), F.lit(0.0).alias("densest_gain"), F.lit(False).alias("toxic"))
    return rows.mapInArrow(_score(model), "doc_id long, n_windows long, gain double, densest_gain double, toxic boolean")


def toxic_documents(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """The rows of score() that are toxic, by a model of docs and labels."""
    return score(docs, train(docs, labels, **bounds)).where("toxic")
