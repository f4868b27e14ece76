"""Token counts with overlap resynchronisation for huge documents.

Ordinary documents go to the library in batches. A document longer than ``chunk`` characters is encoded in overlapping
chunks with offsets; two neighbours are spliced at a boundary that both of them have and that the text proves stable,
and the overlap is widened where the two do not align.

A null text counts as empty (no tokens, no bytes). Each row gives one row, whatever its id. Special strings inside
texts are handled as the library does by default. Other columns are ignored. Memory is that of an Arrow batch and one
chunk's encoding; a stretch without any stable place, such as a million letters in a row, is one pre-token to the library
too and is encoded in one piece.
"""

from __future__ import annotations

import os
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


SPACES = " \t\n\r"


def _class(char: str) -> str:
    """By an old version of Unicode, on which all libraries agree."""
    kind = unicodedata.ucd_3_2_0.category(char)
    return kind if kind == "Cn" else kind[0] if kind[0] in "LN" else "other"


def stable(text: str, at: int) -> bool:
    """Whether a pre-token ends at ``at`` whatever stands further left or right.

    No pre-token has white space after anything else, and none has characters of two of the classes letters, digits and
    others, but for a space at its beginning and contractions, which begin with an apostrophe.
    """
    if not 0 < at < len(text):
        return False
    a, b = text[at - 1], text[at]
    if a.isspace() or a == "'":
        return False
    if b in SPACES:
        return True
    kinds = _class(a), _class(b)
    return not b.isspace() and kinds[0] != kinds[1] and "Cn" not in kinds and "<" not in (a, b) and "|" not in (a, b)


def edges(text: str, chunk: int) -> Iterator[int]:
    """Stable places about ``chunk`` characters apart, farther only where there are none; the last one is the end."""
    at = 0
    while len(text) - at > chunk:
        end = at + chunk
        last = next((k for k in range(end, end - chunk // 2, -1) if stable(text, k)), None)
        at = last or next((k for k in range(end + 1, len(text)) if stable(text, k)), len(text))
        if at < len(text):
            yield at
    yield len(text)


def count_long(text: str, encode: Callable[[str], object], chunk: int, overlap: int) -> int:
    """Tokens of ``text``; ``encode`` returns an encoding with ``offsets``.

    Each chunk is encoded with ``overlap`` more characters on either side and its tokens are counted between two edges
    that are ends of tokens in both chunks that meet there. Where an edge is none, the overlap is widened, and at last
    the edge is given up and the chunks on its two sides are one.
    """
    total, left = 0, 0
    for right in edges(text, chunk):
        over = overlap
        while True:
            start, end = max(0, left - over), min(len(text), right + over)
            offsets = encode(text[start:end]).offsets
            first, last = upto(offsets, left - start), upto(offsets, right - start)
            if end == right == len(text):
                last = len(offsets)
            if first is not None and (last is not None or over > chunk):
                break
            if start == 0 and end == len(text):
                return len(offsets)
            over *= 4
        if last is not None:
            total, left = total + last - first, right
    return total


def upto(offsets: list[tuple[int, int]], at: int) -> int | None:
    """How many tokens there are up to one that ends at ``at``, or None if none does."""
    if at == 0:
        return 0
    k = bisect_right(offsets, at, key=lambda x: x[1])
    return k if k and offsets[k - 1][0] < offsets[k - 1][1] == at else None


def counts(docs: DataFrame, path: str, limit: int = 512, chunk: int = 65_536, overlap: int = 1_024) -> DataFrame:
    """One row per document: bytes of UTF-8, tokens, and whether they exceed ``limit``; ``path`` is a .json vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        encode = lambda s: made.encode(s, add_special_tokens=False)
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                short = [i for i, t in enumerate(texts) if len(t) <= chunk]
                n = [0] * len(texts)
                for i, e in zip(short, made.encode_batch_fast([texts[i] for i in short], add_special_tokens=False), strict=True):
                    n[i] = len(e)
                for i, t in enumerate(texts):
                    if len(t) > chunk:
                        n[i] = count_long(t, encode, chunk, overlap)
                size = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
