"""Language identification of mixed-language text.

Method: script ranges narrow the candidate languages of each word, hashed byte n-grams score the word
under each candidate, and Viterbi with a switching penalty labels the spans of a text. The language of
most letters in the spans is the text's; its share of the letters is the score.

The model is counted over all rows given to fit(): n-gram counts by language (hashed to a fixed number
of bins, so that the model has a size bound) and letters by script and language.

Viterbi is exact. Texts for which one language provably wins throughout (no stretch of words gains more
from other languages than the switches into and out of it cost) skip the step-by-step recursion.

Defined cases: null, empty and letterless texts get `und`, score 0 and no span; words of a script that
no learned language uses give no evidence; ties go to the language that sorts first. A letter is a character of a Unicode category L:
signs such as U+00D7 and digits of any script are none. Repeated rows count and are labelled each; columns called lang_pred,
lang_score or spans give way to the operator's own, all others stay.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.llm.shared import chunks, runs, prepare, string_column

#: Bins of each n-gram order.
BINS = 1 << 15
ORDERS = (2, 3, 4)
#: Bytes handled at once: small arrays stay in the cache.
CHUNK = 1 << 18
#: Nats that a change of language costs.
SWITCH = 8.0
#: The evidence of overlapping n-grams is scaled by this.
WEIGHT = 0.5
#: Nats against a language that hardly uses a word's script.
OFF_SCRIPT = 20.0
#: A script is a candidate's if the language has at least this share of its own letters in it.
SCRIPT_SHARE = 0.002

#: Scripts by ranges of code points; the index is the script's number, 0 is any other.
SCRIPTS = (
    ("Latin", ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF))),
    ("Greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("Cyrillic", ((0x400, 0x52F),)),
    ("Armenian", ((0x530, 0x58F),)),
    ("Hebrew", ((0x590, 0x5FF),)),
    ("Arabic", ((0x600, 0x6FF), (0x750, 0x77F))),
    ("Devanagari", ((0x900, 0x97F),)),
    ("Thai", ((0xE00, 0xE7F),)),
    ("Kana", ((0x3040, 0x30FF),)),
    ("Han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF))),
    ("Hangul", ((0x1100, 0x11FF), (0xAC00, 0xD7AF))),
)


def _script_of_pair() -> np.ndarray:
    """Script by the first two bytes of a character in UTF-8 (the second matters from three bytes on)."""
    table = np.zeros((256, 256), np.int8)
    for number, (_, ranges) in enumerate(SCRIPTS, 1):
        for lo, hi in ranges:
            for code in range(lo, hi + 1, 1 if hi < 0x800 else 64):
                b = chr(code).encode()
                if len(b) < 3:
                    table[b[0], :] = number
                else:
                    table[b[0], b[1]] = number
    return table


_SCRIPT = _script_of_pair()
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Tokens:
    """Words (runs of letters) of lower-cased texts of one chunk."""

    data: np.ndarray  # bytes, with a blank for all that are no letters
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    script: np.ndarray
    letters: np.ndarray  # in the word; runs of signs or digits above ASCII have none


@cache
def _letter_table() -> np.ndarray:
    """Which code points are letters (of a Unicode category L)."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _letters(data: np.ndarray) -> np.ndarray:
    """Where in UTF-8 data a letter begins; data holds no ASCII but lower-case letters and blanks."""
    out = (data >= 97) & (data <= 122)
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        b = [np.append(data, [0] * 3)[at + i].astype(np.int64) for i in range(4)]
        low = [x & 63 for x in b[1:]]
        two, three = (b[0] & 31) << 6 | low[0], (b[0] & 15) << 12 | low[0] << 6 | low[1]
        four = (b[0] & 7) << 18 | low[0] << 12 | low[1] << 6 | low[2]
        out[at] = _letter_table()[np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, np.minimum(four, 0x10FFFF)))]
    return out


def tokens(texts: pa.Array) -> Iterator[tuple[int, int, Tokens]]:
    texts = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    # A blank ends each text, so that no n-gram spans two.
    texts = pc.binary_join_element_wise(texts, pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
    for lo, hi, data, offsets in chunks(texts, CHUNK):
        inside = _LETTER[data]
        starts, ends, row = runs(inside, offsets)
        data = np.where(inside, data, np.uint8(32))
        after = np.empty_like(data)
        after[:-1], after[-1:] = data[1:], 32
        count = np.concatenate(([0], np.cumsum(_letters(data))))
        yield lo, hi, Tokens(data, offsets, starts, ends, row, _SCRIPT[data[starts], after[starts]], count[ends] - count[starts])


def grams(t: Tokens) -> Iterator[np.ndarray]:
    """For each order the bin of the n-gram that ends behind each byte of data (bytes of words and the blank behind)."""
    code = t.data.astype(np.uint64)
    for k, n in enumerate(ORDERS):
        x = code.copy()
        for i in range(1, n):
            x[i:] += code[:-i] << np.uint64(8 * i)
        yield ((x * np.uint64(0x9E3779B97F4A7C15 + 2 * k)) >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int32) + k * BINS


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # (bins of all orders, languages): centred log-probabilities
    off: np.ndarray  # (scripts, languages): what is taken off a word's score
    switch: float = SWITCH

    @classmethod
    def from_counts(cls, langs: list[str], counts: np.ndarray, scripts: np.ndarray) -> LanguageModel:
        logs = []
        for k in range(len(ORDERS)):
            part = counts[:, k * BINS : (k + 1) * BINS] + 0.2
            logs.append(np.log(part / part.sum(1, keepdims=True)))
        table = np.concatenate(logs, 1).T * WEIGHT / len(ORDERS) * 2
        table = table - table.mean(1, keepdims=True)
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        uses = share.T >= SCRIPT_SHARE  # (scripts, languages)
        off = np.where(uses.any(1, keepdims=True) & ~uses, OFF_SCRIPT, 0.0)
        return cls(langs, table.astype(np.float32), off)

    def word_scores(self, t: Tokens) -> np.ndarray:
        if not len(t.starts):
            return np.zeros((0, len(self.langs)))
        # From a word's first byte to the blank behind it.
        gained = None
        for bins in grams(t):
            part = self.table.take(bins, axis=0)
            gained = part if gained is None else np.add(gained, part, out=gained)
        ends = np.minimum(t.ends + 1, len(t.data))
        scores = np.empty((len(t.starts), len(self.langs)))
        sums = np.zeros(len(t.data) + 1)
        for c in range(len(self.langs)):
            np.cumsum(gained[:, c], dtype=np.float64, out=sums[1:])
            scores[:, c] = sums[ends] - sums[t.starts]
        return scores - self.off[t.script]

    def viterbi(self, s: np.ndarray) -> np.ndarray:
        """The best labels of words with these scores."""
        switch = self.switch
        rows = s.tolist()
        best = rows[0]
        history = [best]
        for x in rows[1:]:
            floor = max(best) - switch
            best = [(b if b >= floor else floor) + y for b, y in zip(best, x, strict=True)]
            history.append(best)
        at = best.index(max(best))
        out = np.empty(len(rows), np.int64)
        out[-1] = at
        for i in range(len(rows) - 2, -1, -1):
            best = history[i]
            top = max(best)
            if best[at] < top - switch:
                at = best.index(top)
            out[i] = at
        return out

    def labels(self, s: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """The label of each word; each row's words are labelled by themselves."""
        out = np.empty(len(s), np.int64)
        bounds = np.searchsorted(row, np.arange(rows + 1))
        sums = np.concatenate((np.zeros((1, s.shape[1])), np.cumsum(s, 0)))
        total = sums[bounds[1:]] - sums[bounds[:-1]]
        top = total.argmax(1)
        base = s[np.arange(len(s)), top[row]]
        rest = s.copy()
        rest[np.arange(len(s)), top[row]] = -np.inf
        gain = rest.max(1) - base if s.shape[1] > 1 else np.full(len(s), -1.0)
        climb = np.concatenate((np.zeros(1), np.cumsum(gain)))
        out[:] = top[row]
        for d in range(rows):
            a, b = int(bounds[d]), int(bounds[d + 1])
            if b - a < 1:
                continue
            c = climb[a : b + 1] - climb[a]
            low = np.minimum.accumulate(c)
            # best gain of a stretch anywhere, from the start, to the end
            if (c - low).max() > 2 * self.switch or c.max() > self.switch or c[-1] - low[-1] > self.switch:
                out[a:b] = self.viterbi(s[a:b])
        return out

    def predict(self, texts: pa.Array) -> Iterator[tuple[str, float, list[tuple[str, int, int, float]]]]:
        """(language, score, spans of (language, first word, end word, share of the letters)) of each text."""
        for lo, hi, t in tokens(texts):
            s = self.word_scores(t)
            rows = hi - lo
            label = self.labels(s, t.row, rows) if len(s) else np.zeros(0, np.int64)
            weight = np.bincount(t.row * len(self.langs) + label, t.letters, rows * len(self.langs)).reshape(rows, -1)
            sums, top = weight.sum(1), weight.argmax(1)
            bounds = np.searchsorted(t.row, np.arange(rows + 1))
            for d in range(rows):
                if not sums[d] > 0:
                    yield "und", 0.0, []
                    continue
                a, b = int(bounds[d]), int(bounds[d + 1])
                x = label[a:b]
                cuts = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), b - a]
                held = np.concatenate(([0], np.cumsum(t.letters[a:b])))
                spans = [(self.langs[int(x[u])], u, v, float((held[v] - held[u]) / sums[d])) for u, v in zip(cuts, cuts[1:], strict=False)]
                yield self.langs[int(top[d])], float(weight[d, top[d]] / sums[d]), spans


def _counts(batches: Iterator[pa.RecordBatch], text: str, lang: str) -> Iterator[pa.RecordBatch]:
    """Sums of this task: one row for each language, kind and bin that occurs."""
    width = BINS * len(ORDERS) + len(SCRIPTS) + 1
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        names = pc.dictionary_encode(string_column(batch, lang))
        code = names.indices.to_numpy(zero_copy_only=False)
        for k, name in enumerate(names.dictionary.to_pylist()):
            total = sums.setdefault(name, np.zeros(width, np.int64))
            for _, _, t in tokens(string_column(batch, text).filter(pa.array(code == k))):
                if not len(t.starts):
                    continue
                inside = (t.data != 32) | np.concatenate(([False], t.data[:-1] != 32))
                for bins in grams(t):
                    total[: BINS * len(ORDERS)] += np.bincount(bins[inside], minlength=BINS * len(ORDERS))
                total[BINS * len(ORDERS) :] += np.bincount(t.script, t.letters, len(SCRIPTS) + 1).astype(np.int64)
    for name, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.record_batch({"lang": pa.array([name] * len(at), pa.string()), "bin": pa.array(at), "n": pa.array(total[at])})


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """A model of all rows with a language; what reaches the driver is one count for each language and bin."""
    prepare(labelled.sparkSession)
    rows = (
        labelled.where(F.col(lang).isNotNull())
        .select(text, lang)
        .mapInArrow(lambda it: _counts(it, text, lang), "lang string, bin long, n long")
        .groupBy("lang", "bin")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names = rows["lang"].to_pylist()
    langs = sorted(set(names))
    place = {x: i for i, x in enumerate(langs)}
    table = np.zeros((max(len(langs), 1), BINS * len(ORDERS) + len(SCRIPTS) + 1))
    table[[place[x] for x in names], rows["bin"].to_numpy()] = rows["n"].to_numpy()
    return LanguageModel.from_counts(langs or ["und"], table[:, : BINS * len(ORDERS)], table[:, BINS * len(ORDERS) :])


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", spans: bool = False) -> DataFrame:
    """docs with lang_pred, lang_score and, if asked for, spans; other columns stay."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    out_type = "struct<lang_pred:string,lang_score:double" + (",spans:array<struct<lang:string,first_word:int,end_word:int,share:double>>" if spans else "") + ">"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(held.value)
        for batch in batches:
            found = list(m.predict(string_column(batch, text)))
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns["lang_pred"] = pa.array([x[0] for x in found], pa.string())
            columns["lang_score"] = pa.array([x[1] for x in found], pa.float64())
            if spans:
                columns["spans"] = pa.array([[dict(zip(("lang", "first_word", "end_word", "share"), y, strict=True)) for y in x[2]] for x in found],
                    pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("share", pa.float64())])))
            yield pa.record_batch(columns)

    kept = docs.drop("lang_pred", "lang_score", "spans")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    added = out_type[len("struct<") : -1].replace("lang_pred:", "lang_pred ").replace("lang_score:", "lang_score ").replace(",spans:", ", spans ")
    return kept.mapInArrow(run, f"{fields}, {added}")
