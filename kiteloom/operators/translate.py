"""Generation by a pluggable translator, resumable, with smaller batches when memory runs out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiteloom.functions import text as X

#: Texts to translations, each with whether it hit the limit of tokens.
Translator = Callable[[Sequence[str]], Sequence[tuple[str, bool]]]


def with_backoff(translator: Translator, texts: Sequence[str], out_of_memory: tuple[type[BaseException], ...] = (MemoryError,)) -> list[tuple[str, bool]]:
    """Translates a batch; when memory runs out, each half by itself, down to one text, whose error is raised. The order stays."""
    try:
        done = list(translator(texts))
    except out_of_memory:
        if len(texts) == 1:
            raise
        half = len(texts) // 2
        return with_backoff(translator, texts[:half], out_of_memory) + with_backoff(translator, texts[half:], out_of_memory)
    if len(done) != len(texts):
        raise ValueError(f"{len(texts)} texts gave {len(done)} translations")
    return done


def translate(df: DataFrame, make_translator: Callable[[], Translator], batch: int = 8, keep: Sequence[str] = ("record_id", "group_id", "source", "target"), by_length: bool = True) -> DataFrame:
    """Adds prediction and hit_token_limit.

    ``make_translator`` runs once in each task, on the executor. Rows are dealt
    by ranges of the source's length and sorted in their task, so batches hold
    texts of like length. The one boundary to Python is here.
    """
    rows = df.select(*keep)
    if by_length:
        size = F.length(X.text_of(F.col("source")))
        rows = rows.withColumn("_size", size).repartitionByRange("_size", keep[0]).sortWithinPartitions("_size", keep[0]).drop("_size")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        translator = make_translator()
        for frame in frames:
            texts = [t or "" for t in frame["source"]]
            done = [x for at in range(0, len(texts), batch) for x in with_backoff(translator, texts[at : at + batch])]
            yield frame.assign(prediction=[t for t, _ in done], hit_token_limit=[bool(h) for _, h in done])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, prediction string, hit_token_limit boolean")
