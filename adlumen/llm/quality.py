"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from every whole text, in Arrow batches.  The trees are fitted on at most ``FIT_ROWS`` labelled rows,
those with the smallest hash of their id: features are cut into ``BINS`` bins, and a level of a tree is grown from
histograms of gradients over them.  The fitted trees are flat arrays, traversed for all rows of a batch at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from adlumen.llm.common import small_batches, word_hashes

FIT_ROWS = 20_000
BINS, DEPTH, ROUNDS, RATE, LEAST, PENALTY = 64, 4, 120, 0.1, 10, 1.0
THRESHOLD = 0.7

FEATURES = [
    "log_bytes", "log_words", "bytes_per_word", "share_upper", "share_lower", "share_digit", "share_space", "share_control", "share_high",
    "share_period", "share_comma", "share_exclaim", "share_pipe", "share_signs", "share_quotes", "share_brackets", "share_other_marks",
    "share_commonest_byte", "distinct_bytes", "distinct_words", "share_commonest_word", "distinct_pairs", "lines_per_word", "share_repeated_lines",
    "share_short_lines", "log_longest_line", "share_lines_without_stop", "words_per_stop",
]


def _class_table() -> np.ndarray:
    """Byte classes in the order of the shares in :data:`FEATURES`."""
    classes = [
        range(65, 91), range(97, 123), range(48, 58), b" \t\n\v\f\r", [*range(9), *range(14, 32), 127], range(128, 256), b".", b",", b"!", b"|",
        b"#$%&*", b"'\"`", b"()[]{}<>", b"-/:;=?@\\^_~+",
    ]
    table = np.zeros((256, len(classes)))
    for i, members in enumerate(classes):
        table[list(members), i] = 1.0
    return table


_CLASSES = _class_table()


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of :data:`FEATURES` for every text; an empty text has zeros."""
    out = np.zeros((len(texts), len(FEATURES)), dtype=np.float32)
    for i, (text, words) in enumerate(zip(texts, word_hashes(texts))):
        if not len(words):
            continue
        n, w = len(text), len(words)
        counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
        times = np.unique(words, return_counts=True)[1]
        pairs = len(np.unique(words[1:] * np.uint64(31) + words[:-1])) / (w - 1) if w > 1 else 1.0
        lines = [x for x in text.split(b"\n") if x.strip()]
        lengths = np.array([len(x) for x in lines])
        stops = int(counts[[33, 46, 63]].sum())
        out[i] = [
            np.log1p(n), np.log1p(w), n / w, *(counts @ _CLASSES / n), counts.max() / n, np.count_nonzero(counts), len(times) / w,
            times.max() / w, pairs, len(lines) / w, 1 - len(set(lines)) / len(lines), float((lengths < 30).mean()), np.log1p(lengths.max()),
            sum(not x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / len(lines), w / (stops + 1),
        ]
    return out


# ---- trees ---------------------------------------------------------------------------------------------------------


def _edges(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]


def _grow(binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, edges: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """One tree of a full binary shape: feature (-1: leaf), threshold and value of node i with children 2i+1 and 2i+2."""
    size = (2 << DEPTH) - 1
    feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
    node = np.zeros(len(binned), dtype=np.int64)
    for level in range(DEPTH + 1):
        first, width = (1 << level) - 1, 1 << level
        inside = np.flatnonzero(node >= first)
        if not len(inside):
            break
        place = node[inside] - first
        g, h, n = (np.bincount(place, weights=v, minlength=width) for v in (gradient[inside], hessian[inside], np.ones(len(inside))))
        value[first : first + width] = -g / (h + PENALTY)
        if level == DEPTH:
            break
        best, choice, cut = np.full(width, 1e-6), np.full(width, -1), np.zeros(width, dtype=np.int64)
        for j, e in enumerate(edges):
            if not len(e):
                continue
            key = place * (BINS + 1) + binned[inside, j]
            sums = [np.bincount(key, weights=v, minlength=width * (BINS + 1)).reshape(width, -1)[:, : len(e)].cumsum(axis=1) for v in (gradient[inside], hessian[inside], np.ones(len(inside)))]
            gl, hl, nl = sums
            gain = gl**2 / (hl + PENALTY) + (g[:, None] - gl) ** 2 / (h[:, None] - hl + PENALTY) - (g**2 / (h + PENALTY))[:, None]
            gain[(nl < LEAST) | (n[:, None] - nl < LEAST)] = -1.0
            at = gain.argmax(axis=1)
            top = gain[np.arange(width), at]
            better = top > best
            best[better], choice[better], cut[better] = top[better], j, at[better]
        feature[first : first + width] = choice
        for k in np.flatnonzero(choice >= 0):
            threshold[first + k] = edges[choice[k]][cut[k]]
        split = choice[place] >= 0
        rows, where = inside[split], place[split]
        node[rows] = 2 * node[rows] + 1 + (binned[rows, choice[where]] > cut[where])
    return feature, threshold, value


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Boosted trees for the log odds of ``y`` (0 to 1).  Without rows, or with one class, the model is a constant."""
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    model = {"base": base, "trees": []}
    if not len(y) or y.min() == y.max():
        return model
    edges = _edges(x)
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    raw = np.full(len(y), base)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-raw))
        tree = _grow(binned, p - y, p * (1 - p), edges)
        model["trees"].append((tree[0], tree[1], RATE * tree[2]))
        raw += _walk(model["trees"][-1], x)
    return model


def _walk(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    feature, threshold, value = tree
    node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    for _ in range(DEPTH):
        f = feature[node]
        node = np.where(f < 0, node, 2 * node + 1 + (x[rows, f] > threshold[node]))
    return value[node]


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    raw = np.full(len(x), model["base"])
    for tree in model["trees"]:
        raw += _walk(tree, x)
    return 1 / (1 + np.exp(-raw))


# ---- Spark ---------------------------------------------------------------------------------------------------------


def held_out(doc: Column, modulus: int = 4, held: int = 2) -> Column:
    """Rows that labels are not learnt from; a null id is one of those learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc.cast("long").cast("string").cast("binary")), F.lit(modulus)) == held, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_column: str = "doc_id", text_column: str = "text", label: str = "quality") -> dict:
    """The model, from at most ``fit_rows`` labelled documents that are not held out.

    A document labelled several times counts with its mean label; null labels and null ids are passed over.
    """
    small_batches(docs.sparkSession)
    named = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).filter("doc_id is not null and y is not null")
    chosen = named.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)

    @F.pandas_udf("array<float>")
    def measured(text: pd.Series) -> pd.Series:
        return pd.Series(list(statistics([t.encode() for t in text])))

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    # At most ``fit_rows`` ids and numbers are broadcast; of rows that share an id the least text stands for it.
    one = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    sample = one.select("doc_id", "y", measured("text").alias("x")).toPandas()
    sample = sample.sort_values("doc_id")
    return fit(np.stack(sample["x"].to_numpy()).astype(float) if len(sample) else np.zeros((0, len(FEATURES))), sample["y"].to_numpy())


def score(model: dict, text: Column) -> Column:
    """The probability of label 1 for a text; null counts as empty."""

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(predict(model, statistics([t.encode() for t in texts]).astype(float)))

    return scores(F.coalesce(text.cast("string"), F.lit("")))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """Each row's ``doc_id, held_out, score, predicted``.

    Texts without words have statistics of zero and get the score the trees give these.  Rows are scored each for itself;
    extra columns are ignored; an empty table gives an empty result, and without labels every score is one half.
    """
    model = fitted(docs, labels, id_column=id_column, text_column=text_column, **options)
    doc = F.col(id_column).cast("long")
    rows = docs.select(doc.alias("doc_id"), held_out(doc).alias("held_out"), score(model, F.col(text_column)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more.

    Null and empty texts have statistics of zero; rows that repeat an id or a text are judged each for itself; other columns
    may have any names; an empty table gives an empty result, and without labels no row reaches a threshold over one half.
    """
    model = fitted(docs, labels, id_column=id_column, text_column=text_column, **options)
    return docs.filter(score(model, F.col(text_column)) >= threshold)
