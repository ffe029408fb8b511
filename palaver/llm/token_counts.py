"""Token counts: batch encoding inside Arrow functions that return lengths only.

Texts are cut into pieces at safe boundaries, in any script that sets blanks between words, and
gathered into batches of about equal bytes, so neither a very long text nor a run of short ones
makes a batch large. A long text without such a blank goes to the library whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import worker_state

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
PIECE_CHARS = 1 << 15
BATCH_BYTES = 1 << 20
# A single blank between letters or digits of any script. No token crosses it; it is safe where
# normalising leaves both neighbours alone, as it then has nothing to join or drop beside the blank.
BETWEEN = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


def public_path(name: str) -> str:
    """Place of a public tokenizer file on the machine that calls it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _processor(model: str):
    import sentencepiece

    state = worker_state("sentencepiece")
    if model not in state:
        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
        crossing = any("▁" in p.lstrip("▁") for p in pieces)
        # The mark that the library puts before a text must stand for the blank that is cut out.
        marked = processor.encode("a b") == processor.encode("a") + processor.encode("b")
        state[model] = processor, marked and not crossing
    return state[model]


def _plain(char: str) -> bool:
    """Whether normalising leaves a character alone: it is its own compatibility form, and a letter or digit proper."""
    return char.isascii() or (unicodedata.is_normalized("NFKC", char) and unicodedata.combining(char) == 0)


def safe_blank(text: str, start: int) -> int:
    """Place of the first safe blank from `start` on, or -1."""
    for blank in BETWEEN.finditer(text, max(start, 1)):
        if _plain(text[blank.start() - 1]) and _plain(text[blank.end()]):
            return blank.start()
    return -1


def pieces_of(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text cut at safe blanks into pieces of `size` characters, or longer where no blank is safe."""
    start = 0
    while len(text) - start > size:
        cut = safe_blank(text, start + size)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut + 1
    yield text[start:]


def _bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def _batches(pieces: Iterator[tuple[int, str]], size: int):
    """Pieces in batches of about `size` bytes."""
    owners, texts, held = [], [], 0
    for owner, piece in pieces:
        owners.append(owner)
        texts.append(piece)
        held += _bytes(piece)
        if held >= size:
            yield owners, texts
            owners, texts, held = [], [], 0
    if texts:
        yield owners, texts


def count(batches: Iterator[pa.RecordBatch], locate) -> Iterator[pa.RecordBatch]:
    processor, splits = _processor(locate())
    for batch in batches:
        column = batch.column(1)
        counts = np.zeros(len(column), np.int64)
        texts = ((row, column[row].as_py()) for row in range(len(column)))
        cut = ((row, p) for row, text in texts if text for p in (pieces_of(text) if splits else [text]))
        for owners, some in _batches(cut, BATCH_BYTES):
            lengths = list(map(len, processor.encode(some, num_threads=1)))
            np.add.at(counts, owners, lengths)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(counts)], [batch.schema.names[0], "n_bytes", "n_tokens"]
        )


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens) of every row.

    A null text counts as empty (0 bytes, 0 tokens). Repeated rows get equal rows; an empty table
    gives none; other columns are not read. Special strings inside texts are what the library
    makes of them by default; nothing is added, cut off or padded.
    """
    kind = docs.schema[key].dataType.simpleString()
    sized = docs.select(key, text, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_n_bytes"))
    counted = sized.mapInArrow(
        lambda batches: count(batches, lambda: public_path(model)), f"`{key}` {kind}, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
