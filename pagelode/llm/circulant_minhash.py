"""MinHash near-duplicates: documents whose sets of 5-word shingles have a Jaccard similarity of at least 0.85, one of each group kept.

Method: circulant MinHash. Two permutations of the 32-bit integers, sigma and pi, give all signature coordinates: coordinate k of a set is
the least pi(sigma(x) + k) over its shingles x, each known by 32 bits of its hash, so pi is shifted circularly by k places and no further permutation is drawn. BANDS bands of
ROWS coordinates are hashed; sets that agree in a band meet, and the exact join of jaccard_join confirms links on full sets there (classes
of equal sets, stars dealt into cells, DivideSkip), so that no pair is listed and no group is one task's.

A band of 5 rows agrees with probability s**5 at similarity s. A link at exactly 0.85 is missed by all 32 bands with probability
(1 - 0.85**5)**32 = 7e-9, one at 0.9 with 4e-13; of pairs at 0.3 one in thirteen meets and is turned down by the exact check. Shingles
that share 32 bits only make sets meet that the exact check, over 64 bits, then turns down.

Defined cases: null, empty or wordless texts have an empty set, are linked with nothing and are kept; a null doc_id is a document of its
own id null, takes no links and is kept (kept true, component_id null); repeated rows keep one output row each with the same values; rows of one doc_id
with different texts are documents of their own that link by their sets alone, and any of them is kept if its doc_id is its component's;
other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.llm.jaccard_join import BLOCK, jaccard_components
from pagelode.llm.shared import mixed

#: Links need 100 * intersection >= 85 * union, over shingles of so many words.
PERCENT, WIDTH = 85, 5
BANDS, ROWS = 32, 5
#: Shingles handled at once for all coordinates: they stay in a core's cache.
SLICE = 512

_BAND = np.uint64(0xD6E8FEB86659FD93)
#: Of both permutations: what is mixed in first, and the two odd factors.
_SIGMA = tuple(np.uint32(x) for x in (0xA24BAED5, 0x85EBCA6B, 0xC2B2AE35))
_PI = tuple(np.uint32(x) for x in (0x9FB21C65, 0x7FEB352D, 0x846CA68B))


def permuted(x: np.ndarray, by: tuple[np.uint32, ...]) -> np.ndarray:
    """A permutation of the 32-bit integers: each of its steps can be undone. x is overwritten."""
    x ^= by[0]
    x ^= x >> np.uint32(16)
    x *= by[1]
    x ^= x >> np.uint32(15)
    x *= by[2]
    return x


def signature(shingles: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """All coordinates of a set that isn't empty: of k = 1, 2, ... the least pi(sigma(x) + k), modulo 2**32."""
    shift = np.arange(1, coordinates + 1, dtype=np.uint32)[:, None]
    places = permuted(shingles.astype(np.uint32), _SIGMA)
    places ^= places >> np.uint32(16)
    least = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(shingles), SLICE):
        least = np.minimum(least, permuted(places[at : at + SLICE] + shift, _PI).min(1))
    return least


def bands(shingles: np.ndarray, n: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit hash of each band, marked with its number; none of an empty set."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    grid = signature(shingles, n * rows).astype(np.uint64).reshape(n, rows)
    joined = mixed(np.arange(n, dtype=np.uint64) * _BAND + np.uint64(1))
    for k in range(rows):
        joined = mixed(joined * _BAND + grid[:, k])
    return joined


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, n: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs."""
    found = jaccard_components(docs, percent, block, width, sign=lambda shingles: bands(shingles, n, rows))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
