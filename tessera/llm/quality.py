"""Quality classifier over random-indexing word vectors (operator 4).

Each distinct word has a sparse ternary index vector, made from its hash. Its word vector is that plus the normalised sum of the
index vectors of the words found around it in the labelled sample, which is known for words of two labelled rows and more. Beside it
a word counts as its form: length, capitals, its last three bytes by class (punctuation as it is) and whether it repeats the word before
it, with vectors learned in the same way, so that invented, rare and new words share what is known of their form. A document is
the mean of its words' vectors and of their forms' vectors. A two-layer network in numpy gives the logit of
label 1, divided by a temperature fitted on rows that the network has not seen.

Training takes at most ``sample`` labelled rows, chosen by a hash of their ids, whole texts; only their form counts, their means
and the vectors of the sample's words reach the driver (at most sample x FORMS numbers and PARTS matrices of FORMS x FORMS, without zeros). Scoring reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._store import small_batches, unused
from tessera.llm._text import Words, mix64, pieces, utf8

FORMS, WIDTH, HIDDEN, NETS, NEIGHBOURS, PARTS = 1024, 96, 24, 5, 2, 8

_CLASS = np.full(256, 4, np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[0x80:] = 2
_TAIL = np.where(_CLASS == 4, np.arange(256), _CLASS)


def forms(words: Words) -> np.ndarray:
    """The form of each word, from 0 to FORMS - 1."""
    h, raw, start, end = words.hashes(), words.bytes, words.start, words.end
    size = end - start
    upper = np.concatenate([[0], np.cumsum(_CLASS[raw] == 1)])
    capitals = np.minimum(upper[end] - upper[start], 3)
    out = np.minimum(size, 15).astype(np.uint64) * np.uint64(4) + capitals.astype(np.uint64)
    for back in (1, 2, 3):
        tail = np.where(size >= back, _TAIL[raw[np.maximum(end - back, 0)]], 0)
        out = out * np.uint64(256) + tail.astype(np.uint64)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    firsts = words.of[:-1][np.diff(words.of) > 0]
    same[firsts] = False
    return (mix64(out * np.uint64(2) + same.astype(np.uint64)) % np.uint64(FORMS)).astype(np.int64)


def form_counts(words: Words, form: np.ndarray) -> np.ndarray:
    """For each row how often it has each form."""
    rows = len(words.of) - 1
    return np.bincount(words.rows() * FORMS + form, minlength=rows * FORMS).reshape(rows, FORMS).astype(np.float32)


SIGNS, UNIT = 8, 127  # signs of an index vector; word vectors are whole multiples of 1 / UNIT, so that sums do not depend on their order


def _signs(hashes: np.ndarray):
    """The places and signs of the words' index vectors, one in each of SIGNS equal parts."""
    part = WIDTH // SIGNS
    for k in range(SIGNS):
        told = mix64(hashes ^ (np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15 & (2**60 - 1))))
        yield ((told >> np.uint64(8)) % np.uint64(part)).astype(np.int64) + part * k, np.where(told & np.uint64(1), 1, -1)


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(hashes), WIDTH), np.int16)
    for place, sign in _signs(hashes):
        out[np.arange(len(hashes)), place] = sign
    return out


def _contexts(batches):
    """For each word of some labelled rows the sum of the index vectors around it and the number of rows that have it."""
    for batch in batches:
        for _, part in pieces(batch.column("text"), 1 << 20):
            words = Words(part)
            known, at = np.unique(words.hashes(), return_inverse=True)
            row = words.rows()
            rows = np.bincount(np.unique(at * np.int64(len(part)) + row) // len(part), minlength=len(known))
            around = np.zeros(len(known) * WIDTH)
            for place, sign in _signs(known):
                for step in range(1, NEIGHBOURS + 1):
                    ok = row[step:] == row[:-step]
                    a, b = at[:-step][ok], at[step:][ok]
                    around += np.bincount(a * WIDTH + place[b], sign[b], len(around)) + np.bincount(b * WIDTH + place[a], sign[a], len(around))
            around = around.reshape(-1, WIDTH)
            small = np.abs(around).max(axis=1, initial=0) < 128  # a byte a number, where that holds it
            told = [x.astype("i1" if b else "<i4").tobytes() for x, b in zip(around, small)]
            yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(rows, pa.int64()), pa.array(told, pa.binary())], names=["word", "n", "told"])


def _vocabulary(batches):
    """The context vectors of words that two rows and more have; the rows of a word are in one task."""
    words, rows, told = [], [], []
    for batch in batches:
        words.append(batch.column("word").to_numpy())
        rows.append(batch.column("n").to_numpy())
        raw = batch.column("told").to_pylist()
        small = np.array([len(x) == WIDTH for x in raw], bool)
        sums = np.empty((len(raw), WIDTH), np.int32)
        sums[small] = np.frombuffer(b"".join(x for x in raw if len(x) == WIDTH), "i1").reshape(-1, WIDTH)
        sums[~small] = np.frombuffer(b"".join(x for x in raw if len(x) > WIDTH), "<i4").reshape(-1, WIDTH)
        told.append(sums)
    if not words:
        return
    known, at = np.unique(np.concatenate(words), return_inverse=True)
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(len(known)))
    often = np.add.reduceat(np.concatenate(rows)[order], starts) > 1
    context = np.add.reduceat(np.concatenate(told)[order], starts, axis=0)[often].astype(np.float64)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    yield pa.RecordBatch.from_arrays([pa.array(known[often]), pa.array([x.tobytes() for x in np.rint(context * UNIT).astype("i1")], pa.binary())], names=["word", "told"])


def word_means(words: Words, known: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """For each row the mean of its words' vectors; ``vectors`` has the contexts of the ascending hashes ``known``."""
    out = np.zeros((len(words.of) - 1, WIDTH), np.int64)
    h, row = words.hashes(), words.rows()
    for at in range(0, len(h), 1 << 16):
        some, of = row[at : at + (1 << 16)], h[at : at + (1 << 16)]
        met, back = np.unique(of, return_inverse=True)
        each = index_vectors(met) * np.int16(UNIT)
        if len(known):
            place = np.minimum(np.searchsorted(known, met), len(known) - 1)
            learned = known[place] == met
            each[learned] += vectors[place[learned]]
        starts = np.flatnonzero(np.r_[True, some[1:] != some[:-1]])
        out[some[starts]] += np.add.reduceat(each[back], starts, axis=0, dtype=np.int32)
    return (out / (UNIT * np.maximum(np.diff(words.of), 1))[:, None]).astype(np.float32)


def _sparse(counts: np.ndarray) -> bytes:
    """The places and values that are not 0, four bytes each."""
    at = np.flatnonzero(counts)
    return at.astype("<u4").tobytes() + counts[at].astype("<f4").tobytes()


def _dense(told: bytes, size: int) -> np.ndarray:
    half = len(told) // 2
    out = np.zeros(size, np.float32)
    out[np.frombuffer(told[:half], "<u4")] = np.frombuffer(told[half:], "<f4")
    return out


def _training_rows(known: np.ndarray, vectors: np.ndarray):
    """A row of counts and a mean for each labelled document, and per task one matrix of which forms stand near which."""

    def run(batches):
        near = np.zeros(FORMS * FORMS, np.float32)
        seen = False
        for batch in batches:
            label = batch.column("label").to_numpy()
            for first, part in pieces(batch.column("text"), 1 << 20):
                words = Words(part)
                form, row = forms(words), words.rows()
                for step in range(1, NEIGHBOURS + 1):
                    ok = row[step:] == row[:-step]
                    near += np.bincount(form[:-step][ok] * FORMS + form[step:][ok], minlength=FORMS * FORMS)
                seen = True
                told = [_sparse(x) for x in form_counts(words, form)]
                means = [x.tobytes() for x in word_means(words, known, vectors)]
                yield pa.RecordBatch.from_arrays([pa.array(label[first : first + len(part)], pa.int32()), pa.array(told, pa.binary()), pa.array(means, pa.binary())], names=["label", "told", "mean"])
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int32()), pa.array([_sparse(near)], pa.binary()), pa.array([None], pa.binary())], names=["label", "told", "mean"])

    return run


@dataclass
class QualityModel:
    vectors: np.ndarray  # of each form
    known: np.ndarray  # ascending hashes of words, as unsigned numbers
    learned: np.ndarray  # their contexts
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    mean: np.ndarray
    scale: np.ndarray
    temperature: float

    def pooled(self, counts: np.ndarray, means: np.ndarray) -> np.ndarray:
        return np.hstack([counts @ self.vectors / np.maximum(counts.sum(axis=1, keepdims=True), 1), means])

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((pooled - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, counts: np.ndarray, means: np.ndarray) -> np.ndarray:
        z = self.logits(self.pooled(counts, means)).astype(np.float64) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def word_vectors(near: np.ndarray, seed: int) -> np.ndarray:
    """Index vectors (eight signs among WIDTH zeros) plus the normalised sums of the neighbours' index vectors."""
    rng = np.random.default_rng(seed)
    index = np.zeros((FORMS, WIDTH), np.float32)
    for row in index:
        row[rng.choice(WIDTH, 8, replace=False)] = rng.choice([-1.0, 1.0], 8)
    context = (near + near.T) @ index
    return index + context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)


def _network(x: np.ndarray, y: np.ndarray, seed: int, epochs: int = 60, batch: int = 128, rate: float = 0.01, decay: float = 1e-4):
    """A tanh layer and a linear one, fitted by Adam to the logistic loss."""
    rng = np.random.default_rng(seed)
    share = np.clip(y.mean(), 0.01, 0.99)
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array(np.log(share / (1 - share)))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            a, t = x[order[at : at + batch]], y[order[at : at + batch]]
            w1, b1, w2, b2 = params
            hidden = np.tanh(a @ w1 + b1)
            error = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -60, 60))) - t) / len(a)
            back = np.outer(error, w2) * (1 - hidden**2)
            grads = [a.T @ back + decay * w1, back.sum(axis=0), hidden.T @ error + decay * w2, error.sum()]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] = params[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return params[0].astype(np.float32), params[1].astype(np.float32), params[2].astype(np.float32), float(params[3])


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss among a fine grid, with half a count of doubt so that separable rows do not ask for 0."""
    if not len(z):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 71))
    t = (y * len(y) + 0.5) / (len(y) + 1)
    losses = []
    for g in grid:
        v = np.clip(z / g, -60, 60)
        losses.append(np.mean(np.logaddexp(0, v) - t * v))
    return float(grid[int(np.argmin(losses))])


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 8000, seed: int = 5,
) -> QualityModel:
    """Learns from at most ``sample`` labelled rows, of each id one, the least of its texts and labels. Without any the score is 0.5, with one
    label only that label's. Null texts count as empty; very long ones are read whole."""
    small_batches(docs.sparkSession)
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(sample)  # its size is bounded, so it may be broadcast
    texts = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(chosen), id_col)
    texts = texts.groupBy(id_col).agg(F.min("label").alias("label"), F.min("text").alias("text")).select("label", "text")
    found = texts.repartition(PARTS).mapInArrow(_contexts, "word long, n long, told binary").repartition(PARTS, "word").mapInArrow(_vocabulary, "word long, told binary").toArrow()
    known = found.column("word").to_numpy().astype(np.int64).view(np.uint64)
    learned = utf8(found.column("told").combine_chunks())[0].view(np.int8).reshape(-1, WIDTH)[np.argsort(known)]
    known = np.sort(known)
    del found
    told = texts.repartition(PARTS).mapInArrow(_training_rows(known, learned), "label int, told binary, mean binary").toArrow()
    told = list(zip(*(told.column(c).to_pylist() for c in ("label", "told", "mean"))))
    rows = sorted(x for x in told if x[0] is not None)  # the same order, wherever they came from
    y = np.array([x[0] for x in rows], np.float64)
    near = np.zeros((FORMS, FORMS), np.float32)
    for label, matrix, _ in told:
        if label is None:
            near += _dense(matrix, FORMS * FORMS).reshape(FORMS, FORMS)
    del told
    none = QualityModel(word_vectors(near, seed), known, learned, (np.zeros((2 * WIDTH, HIDDEN), np.float32), np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN, np.float32), 0.0), np.zeros(2 * WIDTH), np.ones(2 * WIDTH), 1.0)
    if len(set(y.tolist())) < 2:
        if len(y):
            none.layers = (*none.layers[:3], 4.0 if y[0] else -4.0)
        return none
    x = np.concatenate([none.pooled(np.stack([_dense(c, FORMS) for _, c, _ in rows[at : at + 256]]), np.stack([np.frombuffer(m, np.float32) for _, _, m in rows[at : at + 256]])) for at in range(0, len(rows), 256)])
    aside = np.arange(len(y)) % 5 == 0
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-4
    nets = [_network((x[~aside] - mean) / scale, y[~aside], seed + k) for k in range(NETS)]
    # the mean of their logits is one network with all their hidden units
    layers = (np.hstack([n[0] for n in nets]), np.concatenate([n[1] for n in nets]), np.concatenate([n[2] for n in nets]) / NETS, float(np.mean([n[3] for n in nets])))
    model = QualityModel(none.vectors, known, learned, layers, mean.astype(np.float32), scale.astype(np.float32), 1.0)
    model.temperature = _temperature(model.logits(x[aside]), y[aside])
    return model


def _scorer(model: QualityModel, own: str, score_col: str):
    def run(batches):
        for batch in batches:
            names = [c for c in batch.schema.names if c != own]
            for first, part in pieces(batch.column(own), 1 << 20):
                found = []
                for at in range(0, len(part), 512):
                    words = Words(part.slice(at, 512))
                    found.append(model.scores(form_counts(words, forms(words)), word_means(words, model.known, model.learned)))
                rows = batch.slice(first, len(part))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(np.concatenate(found))], names=[*names, score_col])

    return run


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns with ``score_col``, the calibrated probability of label 1 (an input column of that name is replaced).

    Only the text is an input of the score. Defined cases: null and empty texts have no words and get the network's value for the
    zero vector; repeated rows get the same score; a very long text is read whole, in parts of its own; an empty table gives an empty result; other
    columns pass unchanged.
    """
    small_batches(docs.sparkSession)
    own, rows = unused(docs.columns, "_text"), docs.drop(score_col)
    shape = rows.schema.add(score_col, "double")
    return rows.withColumn(own, F.col(text_col)).mapInArrow(_scorer(model, own, score_col), shape)
