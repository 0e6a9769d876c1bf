"""Exact token counts by byte-level BPE, huge documents in overlapping chunks.

A long text is encoded in chunks that overlap. Two neighbouring encodings are
spliced at a boundary that both have and that is proven stable, so the result
is the encoding of the whole text, token for token:

The pre-tokenizer's expression knows no look-behind, and none of its
alternatives goes from a letter or digit on to a character of another kind:
``'s`` and the like start with the apostrophe, ``?\\p{L}+`` and ``?\\p{N}+`` have
white space at their start only. So right after a letter or digit that is
followed by something else a pre-token ends, wherever the scan began, and none
before that place looks beyond it (``\\s+(?!\\S)`` looks one character past
white space, which is before that place too). BPE works within pre-tokens.

Where the overlap has no such place it is doubled; where doubling reaches what
is settled already, the chunk itself grows until there is one or the text ends.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docparity.llm.common import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 16_384
OVERLAP = 256

_STABLE = re.compile(r"(?<=[^\W_])(?=[\W_])")


@lru_cache(maxsize=4)
def encoding(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The tokenizer of a rank file, and the length in bytes of each token."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("docparity", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def _cut_at(tokens: np.ndarray, ends: np.ndarray, text: str, p: int) -> int | None:
    """How many of the tokens end at character ``p``; None if ``p`` is inside one."""
    at = len(text[:p].encode())
    i = int(np.searchsorted(ends, at))
    return i + 1 if i < len(ends) and ends[i] == at else None


def encode_long(enc: tiktoken.Encoding, lengths: np.ndarray, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[list[np.ndarray], int]:
    """The encoding of a text of any length, in parts, and the number of chunks encoded."""

    def encode(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        nonlocal chunks
        chunks += 1
        tokens = np.array(enc.encode_ordinary(text[lo:hi]), np.int64)
        return tokens, lengths[tokens].cumsum()

    n, chunks, parts = len(text), 0, []
    lo, hi, settled = 0, min(len(text), chunk), 0  # the chunk at hand; tokens before character ``settled`` are in ``parts``
    tokens, ends = encode(lo, hi)
    skip, grow = 0, chunk
    while hi < n:
        width, spliced = overlap, False
        while not spliced and hi - width > settled:
            start = hi - width
            # the character after the place must be in both chunks, and so must the one before it
            places = [start + m.start() for m in _STABLE.finditer(text[start:hi])]
            if places:
                p = places[len(places) // 2]
                stop = min(n, start + chunk)
                if stop <= hi:
                    stop = min(n, hi + chunk)
                new, new_ends = encode(start, stop)
                i, j = _cut_at(tokens, ends, text[lo:hi], p - lo), _cut_at(new, new_ends, text[start:stop], p - start)
                if i is not None and j is not None:
                    parts.append(tokens[skip:i])
                    tokens, ends, skip, lo, hi, settled, spliced, grow = new, new_ends, j, start, stop, p, True, chunk
                    break
            width *= 2
        if not spliced:
            lo, hi, grow, skip = settled, min(n, hi + grow), grow * 2, 0
            tokens, ends = encode(lo, hi)
    parts.append(tokens[skip:])
    return parts, chunks


def _count_rows(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lengths = encoding(path)
        for batch in batches:
            for part in slices(batch, "text"):
                counts: list[int | None] = []
                chunks: list[int | None] = []
                for text in part.column("text").to_pylist():
                    if text is None:
                        counts.append(None)
                        chunks.append(None)
                    elif len(text) <= chunk:
                        counts.append(len(enc.encode_ordinary(text)))
                        chunks.append(min(1, len(text)))
                    else:
                        tokens, k = encode_long(enc, lengths, text, chunk, overlap)
                        counts.append(sum(map(len, tokens)))
                        chunks.append(k)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(chunks, pa.int32())], ["doc_id", "n_tokens", "n_chunks"])

    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """One row a document: ``doc_id``, ``n_tokens`` of the whole text and ``n_chunks`` encoded for it.

    Strings that look like special tokens count as ordinary text. A null text
    gives nulls, an empty one 0; a null ``doc_id`` stays null; repeated rows are
    counted one by one. Texts longer than ``chunk`` characters are encoded in
    chunks that overlap by ``overlap`` at first, so no encoding in memory is
    much larger than a chunk unless the text has no place to splice at. Other
    columns are not read. An empty table gives an empty result. No shuffle.
    """
    if not 0 < overlap < chunk:
        raise ValueError("the overlap must be shorter than the chunk")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(_count_rows(vocabulary, chunk, overlap), "doc_id long, n_tokens long, n_chunks int")
