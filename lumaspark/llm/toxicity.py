"""Toxicity by a small convolutional text classifier in numpy.

Words (runs of letters and digits, lower-cased) become sums of hashed embeddings: one for the word, one for each of a
few prefixes. Filters of several widths slide over them, each filter's maximum over the whole text is taken, and a
logistic layer gives the probability. Labels come in different languages at different rates and strengths, so a
threshold is calibrated for each language, recognised from the text itself, and the score is shifted until that
threshold stands at one half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import PUNCTUATION, Words, chunks, give_back, mix, small_batches, trimmed

SLOTS = 1 << 15
SIZE = 16
WIDTHS = (1, 2, 3)
FILTERS = 16
PREFIXES = (4, 5, 6, 7, 8)
PAD = max(WIDTHS) - 1


def features(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(from row, to row, slots of each distinct word, the distinct word at each place, first place of each text)."""
    for at, to, data, offsets in chunks(pc.utf8_lower(texts), limit):
        words = Words(data, offsets, space=PUNCTUATION)
        hashes = words.hashes()
        seen, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        start, end = words.start[where], words.end[where]
        slots = np.zeros((len(seen), 1 + len(PREFIXES)), dtype=np.int64)
        slots[:, 0] = (seen % np.uint64(SLOTS - 1)).astype(np.int64) + 1
        for k, size in enumerate(PREFIXES, 1):
            long = end - start > size
            cut = words.span_hash(start[long], start[long] + size)
            slots[long, k] = (mix(cut + np.uint64(k)) % np.uint64(SLOTS - 1)).astype(np.int64) + 1
        yield at, to, slots, which.reshape(-1), words.first


def _padded(which: np.ndarray, first: np.ndarray, empty: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts with PAD places of the word ``empty`` after each text, and the first place of each."""
    count = np.diff(first)
    starts = np.concatenate(([0], np.cumsum(count + PAD)))
    out = np.full(starts[-1], empty, dtype=np.int64)
    out[np.arange(len(which)) + np.repeat(starts[:-1] - first[:-1], count)] = which
    return out, starts


@dataclass
class Classifier:
    """Weights, and the thresholds by language with the word scores that recognise it."""

    table: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    intercept: float
    languages: list[str]
    thresholds: np.ndarray
    lang_slots: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 7) -> Classifier:
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.1, (SLOTS, SIZE)).astype(np.float32)
        table[0] = 0
        filters = [rng.normal(0, 0.4, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        out = rng.normal(0, 0.4, len(WIDTHS) * FILTERS).astype(np.float32)
        return cls(table, filters, np.zeros(len(out), np.float32), out, 0.0, [], np.zeros(0), np.zeros((SLOTS, 0), np.float32))

    def embed(self, slots: np.ndarray) -> np.ndarray:
        """Embeddings of distinct words; a last row of zeros stands for padding."""
        out = np.zeros((len(slots) + 1, SIZE), dtype=np.float32)
        out[:-1] = self.table[slots].sum(axis=1)
        return out

    def convolve(self, words: np.ndarray, places: np.ndarray) -> Iterator[np.ndarray]:
        """Filter outputs of each width at each place. Each distinct word is multiplied once."""
        for weights in self.filters:
            total = np.zeros((len(places), FILTERS), dtype=np.float32)
            for k in range(len(weights)):
                total[: len(places) - k] += (words @ weights[k])[places[k:]]
            yield total

    def logits(self, slots: np.ndarray, which: np.ndarray, first: np.ndarray) -> np.ndarray:
        result = np.full(len(first) - 1, np.float64(self.intercept))
        some = np.flatnonzero(np.diff(first))
        if len(some):
            places, starts = _padded(which, np.append(first[some], first[-1]), len(slots))
            pooled = [_pool(c, starts) for c in self.convolve(self.embed(slots), places)]
            result[some] += np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0) @ self.out
        return result

    def language(self, slots: np.ndarray, which: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The language that a text's words are most frequent in; the first for texts without words."""
        if not self.languages:
            return np.zeros(len(first) - 1, dtype=np.int64)
        scores = self.lang_slots[slots[:, 0]]
        sums = np.concatenate((np.zeros((1, scores.shape[1])), np.cumsum(scores[which], axis=0, dtype=np.float64)))
        return (sums[first[1:]] - sums[first[:-1]]).argmax(axis=1)

    def scores(self, slots: np.ndarray, which: np.ndarray, first: np.ndarray) -> np.ndarray:
        shift = self.thresholds[self.language(slots, which, first)] if self.languages else 0.0
        return 1 / (1 + np.exp(-np.clip(self.logits(slots, which, first) - shift, -30, 30)))


def _pool(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Maxima over each text's own places, without its padding."""
    edges = np.stack((starts[:-1], starts[1:] - PAD), axis=1).reshape(-1)
    return np.maximum.reduceat(values, edges, axis=0)[::2]


def _examples(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct words' slots and the words' order."""
    out = []
    for _, _, slots, which, first in features(pa.array([t or "" for t in texts], pa.large_string())):
        for a, b in zip(first[:-1], first[1:], strict=True):
            own, order = np.unique(which[a:b], return_inverse=True)
            out.append((slots[own].astype(np.uint16), order.reshape(-1).astype(np.int32)))
    return out


def _joined(examples: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.cumsum([0, *(len(s) for s, _ in examples)])
    first = np.cumsum([0, *(len(w) for _, w in examples)])
    return np.concatenate([s for s, _ in examples]).astype(np.int64), np.concatenate([w + a for (_, w), a in zip(examples, sizes[:-1], strict=True)]), first


def _step(model: Classifier, batch: list, labels: np.ndarray, sums: dict[str, np.ndarray], rate: float, drop: np.ndarray, decay: float) -> None:
    """One Adagrad step on the logistic loss; a maximum passes its gradient to the one place it came from."""
    slots, which, first = _joined(batch)
    places, starts = _padded(which, first, len(slots))
    words = model.embed(slots)
    pooled, where = [], []
    for values in model.convolve(words, places):
        top = _pool(values, starts)
        pooled.append(top)
        at = np.empty(top.shape, dtype=np.int64)
        for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            at[i] = a + values[a : b - PAD].argmax(axis=0)
        where.append(at)
    hidden = np.concatenate(pooled, axis=1) + model.bias
    active = (hidden > 0) * drop
    logit = (hidden * active) @ model.out + model.intercept
    error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30)))) - labels) / len(labels)
    back = error[:, None] * model.out * active
    grads = {"out": (hidden * active).T @ error + decay * model.out, "bias": back.sum(axis=0)}
    met, word_grads = [], []
    for k, (weights, at) in enumerate(zip(model.filters, where, strict=True)):
        own = back[:, k * FILTERS : (k + 1) * FILTERS].astype(np.float32)
        grad = np.zeros_like(weights)
        for j in range(len(weights)):
            here = places[np.minimum(at + j, len(places) - 1)]
            grad[j] = np.einsum("df,dfe->ef", own, words[here]) + decay * weights[j]
            met.append(here.reshape(-1))
            word_grads.append((own[:, :, None] * weights[j].T[None]).reshape(-1, SIZE))
        grads[f"filter{k}"] = grad
    met, word_grads = np.concatenate(met), np.concatenate(word_grads)
    real = met < len(slots)
    rows = slots[met[real]]
    touched, index = np.unique(rows, return_inverse=True)
    index = index.reshape(-1)
    spread = np.repeat(word_grads[real], rows.shape[1], axis=0)
    table_grad = np.stack([np.bincount(index, weights=spread[:, d], minlength=len(touched)) for d in range(SIZE)], axis=1).astype(np.float32)
    model.intercept -= rate * float(error.sum())
    for name, grad in grads.items():
        value = model.filters[int(name[6:])] if name.startswith("filter") else getattr(model, name)
        total = sums.setdefault(name, np.full_like(value, 1e-8))
        total += grad * grad
        value -= (rate * grad / np.sqrt(total)).astype(np.float32)
    total = sums.setdefault("table", np.full(model.table.shape, 1e-8, np.float32))
    total[touched] += table_grad * table_grad
    model.table[touched] -= rate * table_grad / np.sqrt(total[touched])
    model.table[0] = 0


def fit(texts: list[str], labels: list[int], languages: list[str | None], weights: tuple[float, float] = (1.0, 1.0), epochs: int = 6, rate: float = 0.05, seed: int = 7) -> Classifier:
    """Train on four fifths of the rows, calibrate thresholds on the last fifth.

    ``weights``: how many rows of each class a row stands for. Without rows of both classes the score is the share
    of toxic rows (one half without any)."""
    rng = np.random.default_rng(seed)
    model = Classifier.fresh(seed)
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        model.out[:] = 0
        model.intercept = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return model
    examples = _examples(texts)
    keep = [i for i, e in enumerate(examples) if len(e[1])]
    examples, y, langs = [examples[i] for i in keep], y[keep], [languages[i] for i in keep]
    order = rng.permutation(len(y))
    held, train = order[: len(y) // 5], order[len(y) // 5 :]
    steps = max(epochs, -(-250 * 32 // max(1, len(train))))
    sums: dict[str, np.ndarray] = {}
    for epoch in range(min(steps, 40)):
        shuffled = rng.permutation(train)
        step = rate * (1 - epoch / min(steps, 40)) + 0.003
        for at in range(0, len(shuffled), 32):
            rows = shuffled[at : at + 32]
            drop = (rng.random((len(rows), len(model.out))) < 0.8) / 0.8
            _step(model, [examples[i] for i in rows], y[rows], sums, step, drop, 1e-4)
    _calibrate(model, examples, y, langs, held if len(held) else train, weights)
    return model


def _calibrate(model: Classifier, examples: list, y: np.ndarray, langs: list[str | None], held: np.ndarray, weights: tuple[float, float], prior: int = 40) -> None:
    """For each language the logit that makes F1 largest on ``held``, pulled towards the common one when rows are few."""
    model.languages = sorted({x for x in langs if x is not None})
    logits = np.concatenate([model.logits(*_joined(examples[at : at + 64])) for at in range(0, len(examples), 64)])
    cost = np.where(y == 1, weights[1], weights[0])

    def best(rows: np.ndarray, default: float) -> float:
        if not len(rows) or not y[rows].any():
            return default
        order = rows[np.argsort(-logits[rows], kind="stable")]
        hit = np.cumsum(cost[order] * (y[order] == 1))
        f1 = 2 * hit / (np.cumsum(cost[order]) + hit[-1])
        top = np.flatnonzero(f1 >= f1.max() - 1e-9)[-1]
        after = logits[order[min(top + 1, len(order) - 1)]]
        return float((logits[order[top]] + after) / 2)

    common = best(held, 0.0)
    model.thresholds = np.full(max(1, len(model.languages)), common)
    for i, lang in enumerate(model.languages):
        rows = held[[langs[r] == lang for r in held]]
        share = y[rows].sum() / (y[rows].sum() + prior) if len(rows) else 0.0
        model.thresholds[i] = share * best(rows, common) + (1 - share) * common
    counts = np.full((SLOTS, len(model.languages)), 0.5)
    for (slots, order), lang in zip(examples, langs, strict=True):
        if lang is not None:
            np.add.at(counts[:, model.languages.index(lang)], slots[order, 0].astype(np.int64), 1)
    model.lang_slots = (np.log(counts) - np.log(counts.sum(axis=0))).astype(np.float32)
    model.lang_slots[0] = 0


def train(
    docs: DataFrame, labels: DataFrame, most_each: int = 3_000, most_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Classifier:
    """Fit on at most ``most_each`` labelled documents and ``most_bytes`` of text of each class, chosen by a hash of the id among all
    labelled ones (that bounded sample, whole texts, is what reaches the driver). ``lang_col`` only groups the calibration rows.

    A document marked both ways counts as toxic; of rows that share an id the smallest text counts; null ids and labels
    teach nothing; of equal F1 the lowest threshold is taken."""
    marked = labels.select(labels[id_col].alias("_id"), labels["toxic"].cast("int").alias("toxic")).where("toxic in (0, 1) and _id is not null")
    marked = marked.groupBy("_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for toxic in (0, 1):
        some = marked.where(F.col("toxic") == toxic).orderBy(F.xxhash64("_id"), "_id").limit(most_each)
        chosen = some if chosen is None else chosen.union(some)
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.join(F.broadcast(chosen), "_id").groupBy("_id", "toxic").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "lang")).alias("row"))
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("_id"), "_id")
    rows = rows.select("_id", "toxic", "row.*").withColumn("bytes", F.sum(F.octet_length("text")).over(order))
    found = rows.where(F.col("bytes") <= most_bytes).select("_id", "text", "lang", "toxic").collect()
    found.sort(key=lambda r: r["_id"])
    used = {t: max(1, sum(r.toxic == t for r in found)) for t in (0, 1)}
    model = fit([r.text for r in found], [r.toxic for r in found], [r.lang for r in found], tuple(sizes.get(t, 0) / used[t] for t in (0, 1)))
    del found
    give_back()
    return model


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [i for i, name in enumerate(batch.schema.names) if name != "_tox_text"]
            texts = batch.column("_tox_text")
            texts = texts.fill_null("") if texts.null_count else texts
            for at, to, slots, which, first in features(texts):
                scores = model.value.scores(slots, which, first)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, to - at) for i in rest), pa.array(scores)], names=[*(batch.schema.names[i] for i in rest), "score"])

    return run


def score(docs: DataFrame, model: Classifier, text_col: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``score`` (0 to 1) and ``predicted`` (1 if the score is at least one half) of every whole text.

    Null and empty texts, and texts without a letter or digit, score by the intercept alone. Repeated rows give
    repeated results, an empty table an empty table; long texts are scored whole, one at a time. Other columns are ignored;
    the model, whose size is fixed, is broadcast."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[docs[c] for c in keep], docs[text_col].cast("string").alias("_tox_text"))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "score double"])
    return rows.mapInArrow(trimmed(_score(shared)), schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
