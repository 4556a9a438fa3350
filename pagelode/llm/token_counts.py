"""Token counts without token ids.

Method: texts are taken about TOGETHER pre-tokens at a time. Their pre-tokens become a table of distinct ones and a table of
frequencies by document; pieces are counted once for each distinct pre-token (a cache of bounded size holds the counts of those
met before), joined to the frequencies and summed. No ids are made. The join stays where the documents are: a corpus-wide table of distinct
pre-tokens would need (document, pre-token, frequency) rows to move through a shuffle, which writes more than the input.

Defined cases: a null or empty text has 0 bytes and tokens; repeated rows are counted each; strings of special tokens inside a
text count as the library's default has it (one special token each); a null doc_id is kept; columns besides doc_id and text are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pagelode.llm.recent import PretokenEncoder
from pagelode.llm.shared import prepare, string_column

#: Tokens above which a text is over the limit.
LIMIT = 2048
#: Pre-tokens that are looked up together.
TOGETHER = 100_000


def counts(texts: pa.Array, encoder: PretokenEncoder) -> list[int]:
    out: list[int] = []
    held: list[str] = []
    sizes: list[int] = []

    def flush() -> None:
        distinct: dict[str, int] = {}
        code = np.array([distinct.setdefault(p, len(distinct)) for p in held], np.int64)
        document = np.repeat(np.arange(len(sizes)), sizes)
        pairs, frequency = np.unique(document * max(len(distinct), 1) + code, return_counts=True)
        pieces = np.array(encoder.count_all(list(distinct)), np.int64)
        total = np.zeros(len(sizes), np.int64)
        if len(pairs):
            np.add.at(total, pairs // len(distinct), frequency * pieces[pairs % len(distinct)])
        out.extend(total.tolist())
        held.clear()
        sizes.clear()

    for x in texts:
        parts = encoder.pretokens(x.as_py() or "")
        held.extend(parts)
        sizes.append(len(parts))
        if len(held) >= TOGETHER:
            flush()
    flush()
    return out


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PretokenEncoder.of(vocabulary)
        for batch in batches:
            texts = string_column(batch, text)
            n = counts(texts, encoder)
            yield pa.record_batch(
                {
                    "doc_id": string_column(batch, "doc_id"),
                    "n_bytes": pc.binary_length(texts.fill_null("")).cast(pa.int64()),
                    "n_tokens": pa.array(n, pa.int64()),
                    "over_limit": pa.array([x > limit for x in n], pa.bool_()),
                }
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
