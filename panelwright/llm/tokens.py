"""Token counts of whole texts under a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("PANELWRIGHT_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# The pre-tokenizer of byte-level BPE vocabularies of this family (a fixed value of the public format).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE = 20_000  # characters handed to the tokenizer at once


def _coder(vocabulary: str) -> Callable[[str], Iterator[tuple[object, list[int]]]]:
    """Loaded once per Python worker: kept beside the tokenizer's own module, since this one may travel by value.  Gives
    the tokenizer with the tokens of one part of the text after the other."""
    import tiktoken

    loaded = vars(tiktoken).setdefault("_loaded_coders", {})
    if vocabulary not in loaded:
        import base64

        import regex

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        # A cut before white space that follows something else is a border of the pre-tokenizer too.
        border = regex.compile(r"(?<=\S)(?=\s\S)")

        def parts(text: str) -> Iterator[tuple[object, list[int]]]:
            at = 0
            while len(text) - at > PIECE:
                cut = border.search(text, at + PIECE)
                if cut is None:
                    break
                yield coder, coder.encode_ordinary(text[at : cut.start()])
                at = cut.start()
            yield coder, coder.encode_ordinary(text[at:])

        loaded[vocabulary] = parts
    return loaded[vocabulary]


def _counter(vocabulary: str) -> Callable[[str], int]:
    parts = _coder(vocabulary)
    return lambda text: sum(len(tokens) for _, tokens in parts(text))


def with_token_counts(df: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and ``n_tokens``: the number of tokens of the whole text; null and empty texts have 0.

    A very long text is counted piece by piece, cut where the pre-tokenizer cuts anyway, so the sum is exact.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(vocabulary)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([count(t) if t else 0 for t in texts], pa.int64())], [*keep, "n_tokens"])

    rows = df.select(*[F.col(c) for c in keep], F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]) + ", n_tokens long"
    return rows.mapInArrow(run, schema)


def piece_contents(df: DataFrame, key: str, text: str, capacity: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, piece, n_tokens, content`` of every piece of the texts that are longer than ``capacity`` tokens: pieces of
    ``capacity`` tokens and a rest, as :func:`panelwright.llm.packing.pack_items` counts them.

    ``content`` holds the bytes of these tokens.  Joined in order of ``piece`` they are the text in UTF-8, byte for byte; a
    piece by itself may begin or end within a character.  Null and short texts have no pieces; rows that repeat a key have
    theirs each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _coder(vocabulary)
        for batch in batches:
            for i, t in enumerate(batch.column(1).to_pylist()):
                tokens, coder = [], None
                for coder, more in parts(t or ""):
                    tokens += more
                if len(tokens) <= capacity:
                    continue
                pieces = [tokens[k : k + capacity] for k in range(0, len(tokens), capacity)]
                arrays = [pa.array(range(len(pieces)), pa.int64()), pa.array(map(len, pieces), pa.int64()), pa.array(map(coder.decode_bytes, pieces), pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(pieces))), *arrays], [key, "piece", "n_tokens", "content"])

    rows = df.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, piece long, n_tokens long, content binary")
