"""Helpers of the text operators: bounded batches, byte views of texts, hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text bytes that one vectorised step works on; longer texts are a step of their own.
STEP_BYTES = 1 << 20

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = b" \t\n\x0b\x0c\r"


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``limit`` bytes of text at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(lengths, dtype=np.int64), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered while there are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


#: Shared by the tasks of a Python worker, one after the other.
WORD_HASHES = WordHashes()


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges ``start .. start + count - 1``."""
    total = int(counts.sum())
    out = np.ones(total, np.int64)
    keep = counts > 0
    starts, counts = starts[keep], counts[keep]
    if not len(counts):
        return out
    at = np.cumsum(counts) - counts
    out[at[0]] = starts[0]
    out[at[1:]] = starts[1:] - (starts[:-1] + counts[:-1] - 1)
    return np.cumsum(out)


def row_key(id_col: str, text_col: str) -> list[Column]:
    """``did`` (null ids as the smallest long) and ``rid``, a hash of the text."""
    return [F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63))).alias("did"), F.xxhash64(F.col(f"`{text_col}`")).alias("rid")]


def named(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ... and which of them stands for each name, so that a name can't clash with a helper's."""
    back = {name: f"c{k}" for k, name in enumerate(docs.columns)}
    return docs.toDF(*back.values()), back
