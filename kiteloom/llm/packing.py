"""Packing by power-of-two decomposition."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, releasing, schema_of, slices

#: Characters on which the two tokenizer libraries split alike: Latin letters and general punctuation.
_PLAIN = re.compile("[^\\x00-\\u024f\\u2010-\\u2027\\u2030-\\u205e]")
#: The split pattern of the vocabulary (fixed value).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of texts as the ``tokenizers`` library gives them for a byte-level BPE file.

    With ``ranks_file``, the same vocabulary as ranks, plain texts go through the
    faster library; texts with a special token's string or characters outside
    Latin and general punctuation go through ``tokenizers`` itself, and so do
    texts at which the faster one gives up: its pattern matcher fails on about a
    million white-space characters in a row.
    """

    def __init__(self, vocab_file: str, ranks_file: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(vocab_file)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_file:
            import tiktoken

            with open(ranks_file, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast and not any(s in text for s in self.special) and (text.isascii() or not _PLAIN.search(text)):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
            except ValueError:  # the matcher's stack is exhausted
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=4)
def encoder(vocab_file: str, ranks_file: str | None) -> Encoder:
    return Encoder(vocab_file, ranks_file)


def pieces_of(length: int, longest: int) -> list[int]:
    """A length as powers of two, the longest first: whole ``longest`` ones, then the bits of the rest."""
    return [longest] * (length // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if length % longest >> b & 1]


def pack(
    df: DataFrame, vocab_file: str, ranks_file: str | None = None, longest: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of all documents: (id, start, length, ids, doc_tokens, bucket, sequence_id, offset).

    A document is its ids and ``end_id``. It is cut by the binary form of its
    length into pieces of a power of two up to ``longest``, which must be one
    itself. Each piece is one sequence without padding, so no sequence crosses
    documents; bucket is the length's logarithm. ids holds little-endian unsigned
    32-bit ids. sequence_id is unique, the same again for the same files, and
    numbers bucket by bucket, so a range of it holds one length. Texts are read
    whole, in some 40 bytes of memory for each of their tokens. Null and empty texts are ``end_id`` alone;
    repeated rows are packed each; null ids pass through; an empty table gives
    no piece; other columns are ignored. The files must be on every executor.
    """
    if longest < 1 or longest & (longest - 1) or longest > 1 << 31:
        raise ValueError("longest must be a power of two, 2^31 at most")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocab_file, ranks_file).encode
        for batch in slices(batches, 2 << 20):
            row, start, length, total, ids = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                tokens = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                at, raw = 0, tokens.tobytes()
                for n in pieces_of(len(tokens), longest):
                    row.append(i)
                    start.append(at)
                    length.append(n)
                    total.append(len(tokens))
                    ids.append(raw[4 * at : 4 * (at + n)])
                    at += n
            columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length)), pa.array(ids, pa.binary()), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "start", "length", "ids", "doc_tokens"])

    cut = id_and_text(df, id_col, text_col).mapInArrow(releasing(run), schema_of(df, id_col, "start long, length long, ids binary, doc_tokens long"))
    bucket = F.round(F.log2("length")).cast("int")
    number = F.shiftleft(bucket.cast("long"), 58).bitwiseOR(F.monotonically_increasing_id())
    return cut.select("*", bucket.alias("bucket"), number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def gathered(pieces: DataFrame, id_col: str = "doc_id", spread: int = 1024) -> DataFrame:
    """The rows of ``pieces``, sequences of one length next to each other in every partition, in the order of sequence_id.

    A length's rows are dealt to ``spread`` places by their document and start,
    so the commonest length goes to many tasks. Nulls, repeated rows and empty
    tables pass through.
    """
    place = F.pmod(F.xxhash64(id_col, "start"), F.lit(spread))
    return pieces.repartition("bucket", place).sortWithinPartitions("sequence_id")


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes sequences in a folder for each length; every file then holds rows of one shape. Repeated rows are written each; an empty table makes no folder."""
    pieces.write.partitionBy("bucket").parquet(path)
