"""Language of a text: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import bound_batches, map_text

SIZE = 1 << 15  # hashed n-gram features
ORDERS = (1, 2, 3)
CHUNK = 1 << 20  # characters whose n-grams are hashed at once
SAMPLE = 4000  # labelled rows that the regression is fitted on, about; shared evenly among the languages
UNKNOWN = "und"


class Settings(NamedTuple):
    """Follow-the-regularised-leader with elastic net."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.002
    epochs: int = 3
    sample: int = SAMPLE


class Model(NamedTuple):
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features and a constant, by label
    temperature: float


def letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def counts(text: bytes | None, letters: np.ndarray) -> np.ndarray | None:
    """Occurrences of each hashed n-gram of the lower-cased letters, other characters taken as one space; None without letters."""
    codes = np.frombuffer((text or b"").decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    is_letter = letters[np.minimum(codes, 0xFFFF)]
    if len(codes) and codes.max() > 0xFFFF:
        far = np.unique(codes[codes > 0xFFFF])
        is_letter[np.isin(codes, far[[chr(c).isalpha() for c in far]])] = True
    if not is_letter.any():
        return None
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    body = np.where(is_letter, codes, 32)[keep]
    codes = np.concatenate([[32], body, [32] if body[-1] != 32 else []]).astype(np.uint32)
    total = np.zeros(SIZE, dtype=np.int64)
    for i in range(0, len(codes), CHUNK):
        here = codes[i:i + CHUNK + max(ORDERS) - 1]
        h = np.zeros(len(here), dtype=np.uint32)
        for order in ORDERS:
            n = min(CHUNK, len(here) - order + 1)
            if n <= 0:
                break
            h = (h[:n] + here[order - 1:order - 1 + n]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            total += np.bincount(h & (SIZE - 1), minlength=SIZE)
    return total


def vector(total: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(total)
    x = (1 + np.log(total[at])) * idf[at]
    return np.append(at, SIZE), np.append(x / max(np.sqrt(x @ x), 1e-12), 1.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_labels: int, s: Settings) -> np.ndarray:
    z, n = np.zeros((SIZE + 1, n_labels)), np.zeros((SIZE + 1, n_labels))

    def weights(at):
        step = -(z[at] - np.sign(z[at]) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)
        return np.where(np.abs(z[at]) > s.l1, step, 0.0)

    for epoch in range(s.epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            p = softmax(x @ w)
            p[y[i]] -= 1
            g = np.outer(x, p)
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / s.alpha * w
            n[at] = grown
    return weights(slice(None))


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The scale that gives held-back rows the smallest log loss, where a share of 1 / (rows + 2) is taken as wrong, so that rows
    that are all told apart do not make the scale vanish."""
    n, k = z.shape
    if not n or k < 2:
        return 1.0
    target = np.full((n, k), 1 / (n + 2) / (k - 1))
    target[np.arange(n), y] = 1 - 1 / (n + 2)
    scales = np.geomspace(0.02, 50, 120)
    loss = [-(target * np.log(np.maximum(softmax(z / t), 1e-300))).sum() for t in scales]
    return float(scales[int(np.argmin(loss))])


def fit(rows: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "lang", settings: Settings = Settings()) -> Model:
    """Learn from ``rows``; rows of null label or id, and texts without letters, are left out.

    Document frequencies cover all rows. The regression is fitted on about ``settings.sample`` rows, which are drawn by a hash of the
    id at a rate that gives each label the same share; a fifth of these is held back for the temperature, but for labels that would have
    no others. What reaches the driver is one row per feature and at most ``SIZE`` numbers for each sampled row, whatever the input's size.
    """
    bound_batches(rows.sparkSession)
    rows = rows.where(F.col(label).isNotNull() & F.col(id_column).isNotNull())

    def presence(batches):
        letters, seen, docs = letter_table(), np.zeros(SIZE, dtype=np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                c = counts(t, letters)
                if c is not None:
                    seen += c > 0
                    docs += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, SIZE)), pa.array(np.append(seen[at], docs))], names=["f", "n"])

    schema = T.StructType([T.StructField("f", T.LongType()), T.StructField("n", T.LongType())])
    total = np.zeros(SIZE + 1)
    for f, n in rows.select(F.encode(text, "UTF-8")).mapInArrow(presence, schema).groupBy("f").agg(F.sum("n")).collect():
        total[f] = n
    idf = np.log((1 + total[SIZE]) / (1 + total[:SIZE])) + 1

    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    labels = sorted(sizes)
    if not labels:
        return Model([], idf, np.zeros((SIZE + 1, 0)), 1.0)
    rate = F.create_map(*[x for k in labels for x in (F.lit(k), F.lit(settings.sample / len(labels) / sizes[k]))])
    drawn = rows.where(F.pmod(F.xxhash64(id_column), F.lit(1 << 30)) < rate[F.col(label)] * (1 << 30))

    def make():
        letters = letter_table()

        def sparse(texts):
            got = [counts(t, letters) for t in texts]
            at = [np.flatnonzero(c) if c is not None else [] for c in got]
            return [pa.array(at, pa.list_(pa.int32())), pa.array([c[a] if c is not None else [] for c, a in zip(got, at)], pa.list_(pa.int32()))]

        return sparse

    held = "__held"
    ints = T.ArrayType(T.IntegerType())
    got = map_text(drawn.withColumn(held, F.pmod(F.xxhash64(id_column, F.lit(1)), F.lit(5)) == 0), [label, held], F.col(text), make,
                   [T.StructField("at", ints), T.StructField("n", ints)]).toArrow()
    rows_of, ys, back = [], [], []
    for lab, h, at, n in zip(*(got.column(i) for i in range(4))):
        if len(at):
            c = np.zeros(SIZE, dtype=np.int64)
            c[at.values.to_numpy()] = n.values.to_numpy()
            rows_of.append(vector(c, idf))
            ys.append(labels.index(lab.as_py()))
            back.append(h.as_py())
    order = sorted(range(len(ys)), key=lambda i: (ys[i], len(rows_of[i][0]), rows_of[i][0].tobytes(), rows_of[i][1].tobytes()))  # whatever order rows came in
    trained = {y for y, b in zip(ys, back) if not b}  # a label of which all rows would be held back is trained on them instead
    train = [i for i in order if not back[i] or ys[i] not in trained]
    kept = [i for i in order if back[i] and ys[i] in trained]
    w = follow_leader([rows_of[i] for i in train], np.array([ys[i] for i in train]), len(labels), settings)
    z = np.array([rows_of[i][1] @ w[rows_of[i][0]] for i in kept]).reshape(len(kept), len(labels))
    return Model(labels, idf, w, temperature(z, np.array([ys[i] for i in kept], dtype=int)))


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of all rows with ``lang_pred`` and ``score`` (its calibrated probability).

    Whole texts are read. Null texts and texts without a letter, and all texts if nothing was learned, give ``und`` and 0. Ties go
    to the label that sorts first. Columns of ``keep`` named like the results are replaced. An empty table gives no rows.
    """
    def make():
        letters = letter_table()

        def predict(texts):
            names, scores = [], []
            for t in texts:
                c = counts(t, letters) if model.labels else None
                if c is None:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                at, x = vector(c, model.idf)
                p = softmax(x @ model.weights[at] / model.temperature)
                names.append(model.labels[int(p.argmax())])
                scores.append(float(p.max()))
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return predict

    out = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_text(docs, [c for c in keep if c not in ("lang_pred", "score")], F.col(text), make, out)
