"""Arrow batches of texts: slices of a bounded size, and their words as numbers, without a Python object for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a slice: texts differ in length by a factor of 10,000.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, rows: int = 512, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most so many rows and bytes, a row at least."""
    at = 0
    while at < batch.num_rows:
        part = batch.slice(at, rows)
        while part.num_rows > 1 and part.nbytes > size:
            part = part.slice(0, part.num_rows // 2)
        yield part
        at += part.num_rows


def numbered(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code, words): of every word that isn't empty its row and its place among the distinct words. words: of each row a list, or null."""
    flat = words.flatten().dictionary_encode()
    row, code = pc.list_parent_indices(words).to_numpy().astype(np.int64), flat.indices.to_numpy().astype(np.int64)
    empty = pc.index(flat.dictionary, "").as_py()
    kept = code != empty
    return (row, code, flat.dictionary) if empty < 0 else (row[kept], code[kept], flat.dictionary)


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, code, n, words): how often each text has each of its word tokens in lower case, by row; texts and words as WORD_PATTERN has them, whose letters with case are those of ASCII."""
    spaced = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), "[^가-힣a-z0-9_]+", " ")
    row, code, words = numbered(pc.split_pattern(spaced, " "))
    pairs, n = np.unique(row * len(words) + code, return_counts=True)
    return pairs // max(len(words), 1), pairs % max(len(words), 1), n, words
