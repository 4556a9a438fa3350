"""Toxicity by a classifier chain.

Method: the categories are predicted one after another by linear (logistic) models; each model reads the
text's words and the probabilities of the categories before it. While training, those earlier
probabilities are out-of-fold predictions, so that a later model learns from what it'll see in use.

Words are runs of letters, ASCII lower-cased. A text's features are its words and their first PREFIXES
bytes (inflected forms share these), hashed to 64 bits; the model keeps the FEATURES whose presence tells
most about some category. Only the fit is on a sample: at most SAMPLE labelled rows
(those with the smallest hash of doc_id, so every run takes the same). Every row is scored over its whole text.

Defined cases: a null or empty text has no word and gets the prior; null labels aren't learned from, nor is a doc_id whose label
rows contradict each other; of a repeated doc_id's texts the least is learned from;
repeated rows are scored each; columns called p_<category> or toxic give way to the operator's own, all others stay; without any labelled
row, no row is toxic. The probability from which
a text counts as toxic is the one that best parts the out-of-fold predictions of the last category (by F1).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.llm.shared import chunks, in_one_task, mixed, runs, prepare, string_column, word_hashes

#: The largest number of labelled rows that the chain is fitted on.
SAMPLE = 6000
FEATURES = 384
PREFIXES = (4, 5, 6)
FOLDS = 4
#: Bits of the table by which a word's hash finds its feature.
BITS = 20
#: Words a feature must occur in this many sampled rows.
LEAST_ROWS = 5
RIDGE = 1e-4
STEPS = 200

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def text_words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Hashes and row of the words of consecutive rows."""
    for lo, hi, data, offsets in chunks(texts):
        starts, ends, row = runs(_LETTER[data], offsets)
        found = [word_hashes(data, starts, ends)]
        for k in PREFIXES:
            long = ends - starts > k
            found.append(word_hashes(data, starts[long], starts[long] + k))
            row = np.concatenate((row, row[: len(starts)][long]))
        yield lo, hi, np.concatenate(found), row


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights and, last, the bias: accelerated gradient steps on the mean logistic loss with a ridge."""
    x = np.concatenate((x, np.ones((len(x), 1), np.float32)), 1)
    scale = weight / weight.sum()
    step = 1.0 / (0.25 * np.linalg.norm(x * np.sqrt(scale)[:, None], 2) ** 2 + RIDGE)
    w = ahead = np.zeros(x.shape[1], np.float32)
    step, t = np.float32(step), 1.0
    for _ in range(STEPS):
        slope = x.T @ ((_sigmoid(x @ ahead) - y) * scale) + RIDGE * np.append(ahead[:-1], np.float32(0))
        new, t_new = ahead - step * slope, (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + np.float32((t - 1) / t_new) * (new - w)
        w, t = new, t_new
    return w.astype(np.float64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class ToxicityChain:
    categories: list[str]
    hashes: np.ndarray  # of the features, sorted
    weights: list[np.ndarray]  # by category: features, earlier categories, bias
    threshold: float = 0.5

    @classmethod
    def fit(cls, texts: pa.Array, labels: np.ndarray, categories: Sequence[str], features: int = FEATURES) -> ToxicityChain:
        """labels: (rows, categories) of 0 and 1."""
        n = len(texts)
        words, rows = [], []
        for lo, _, h, row in text_words(texts):
            once = np.unique(mixed(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
            rows.append(row[once] + lo)
            words.append(h[once])
        word = np.concatenate(words) if words else np.zeros(0, np.uint64)
        row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        values, code, df = np.unique(word, return_inverse=True, return_counts=True)
        score = np.zeros(len(values))
        for k in range(labels.shape[1]):
            y = labels[:, k]
            with_ = np.bincount(code, y[row], len(values))
            pos = max(y.sum(), 1e-9)
            score = np.maximum(score, _gain(with_, df, pos, n))
        score[df < LEAST_ROWS] = -1
        top = np.sort(np.lexsort((values, -score))[:features])
        top = top[score[top] > 0]
        place = np.full(len(values), -1)
        place[top] = np.arange(len(top))
        x = np.zeros((n, len(top)), np.float32)
        held = place[code] >= 0
        x[row[held], place[code[held]]] = 1.0
        fold = np.arange(n) % FOLDS
        weights, earlier = [], np.zeros((n, 0), np.float32)
        for k in range(labels.shape[1]):
            y = labels[:, k].astype(np.float32)
            inputs = np.concatenate((x, earlier), 1)
            even = np.ones(n, np.float32)
            weights.append(_logistic(inputs, y, even))
            out = np.zeros(n)
            for f in range(FOLDS):
                if (fold == f).any() and (fold != f).any():
                    w = _logistic(inputs[fold != f], y[fold != f], even[fold != f])
                    out[fold == f] = _sigmoid(inputs[fold == f] @ w[:-1] + w[-1])
            earlier = np.concatenate((earlier, out[:, None].astype(np.float32)), 1)
        return cls(list(categories), values[top], weights, _parting(earlier[:, -1].astype(float), labels[:, -1]) if n else 0.5)

    def _finder(self) -> np.ndarray:
        table = np.zeros(1 << BITS, bool)
        table[self.hashes >> np.uint64(64 - BITS)] = True
        return table

    def predict(self, texts: pa.Array) -> np.ndarray:
        """(rows, categories) of probabilities."""
        out = np.zeros((len(texts), len(self.categories)))
        f, maybe = len(self.hashes), self._finder()
        for lo, hi, h, row in text_words(texts):
            rows = hi - lo
            near = np.flatnonzero(maybe[h >> np.uint64(64 - BITS)]) if f else np.zeros(0, np.int64)
            at = np.minimum(np.searchsorted(self.hashes, h[near]), max(f - 1, 0))
            hit = self.hashes[at] == h[near] if f else np.zeros(0, bool)
            pairs = np.unique(row[near][hit] * max(f, 1) + at[hit])
            r, c = pairs // max(f, 1), pairs % max(f, 1)
            chain: list[np.ndarray] = []
            for w in self.weights:
                z = np.bincount(r, w[c], rows) + w[-1] if len(r) else np.full(rows, w[-1])
                for k, p in enumerate(chain):
                    z = z + w[f + k] * p
                chain.append(_sigmoid(z))
            out[lo:hi] = np.stack(chain, 1)
        return out


def _parting(p: np.ndarray, y: np.ndarray) -> float:
    """The middle (in log-odds) of the gap of p at which the F1 of "p is above it" is best; 0.5 without both classes."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = -1  # no cut between equal values
    k = int(f1.argmax())
    a = np.clip(p[order][[k, min(k + 1, len(p) - 1)]], 1e-6, 1 - 1e-6)
    return float(_sigmoid(np.log(a / (1 - a)).mean()))


def _gain(with_: np.ndarray, df: np.ndarray, pos: float, n: int) -> np.ndarray:
    """Mutual information, in nats, of a word's presence and a category."""
    total = np.zeros(len(df))
    for a, b, joint in ((df, pos, with_), (df, n - pos, df - with_), (n - df, pos, pos - with_), (n - df, n - pos, n - pos - df + with_)):
        with np.errstate(divide="ignore", invalid="ignore"):
            total += np.where(joint > 0, joint / n * np.log(joint * n / np.maximum(a * b, 1e-300)), 0.0)
    return total


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample: int = SAMPLE) -> ToxicityChain:
    """A chain over categories {name: SQL condition on the columns of labels}, in this order."""
    prepare(docs.sparkSession)
    known = labels.select("doc_id", *(F.expr(c).cast("double").alias(f"_{k}") for k, c in enumerate(categories.values())))
    marks = [f"_{k}" for k in range(len(categories))]
    one = known.na.drop().groupBy("doc_id").agg(F.min(F.struct(*marks)).alias("least"), F.max(F.struct(*marks)).alias("most")).where("least = most")
    known = one.select("doc_id", "least.*").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` rows of a few numbers: broadcast, so that no text is shuffled to find them. A repeated doc_id brings the
    # least of its texts, so the task's rows are bounded by the sample.
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", *marks).agg(F.min("text").alias("text"))
    names = list(categories)

    def run(table: pa.Table) -> ToxicityChain:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        y = np.stack([table[f"_{k}"].to_numpy() for k in range(len(names))], 1)
        return ToxicityChain.fit(table["text"].combine_chunks(), y, names)

    return in_one_task(rows, run) or ToxicityChain(names, np.zeros(0, np.uint64), [np.append(np.zeros(k), -40.0) for k in range(len(names))])


def score(docs: DataFrame, chain: ToxicityChain, text: str = "text", threshold: float | None = None) -> DataFrame:
    """docs with p_<category> for each category and toxic (the last category's probability is at least the threshold, by default the chain's)."""
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(chain))
    prepare(docs.sparkSession)
    names = [f"p_{c}" for c in chain.categories]
    kept = docs.drop(*names, "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(held.value)
        for batch in batches:
            p = model.predict(string_column(batch, text))
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns |= {n: pa.array(p[:, k]) for k, n in enumerate(names)}
            columns["toxic"] = pa.array(p[:, -1] >= (model.threshold if threshold is None else threshold))
            yield pa.record_batch(columns)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, fields + "".join(f", `{n}` double" for n in names) + ", toxic boolean")
