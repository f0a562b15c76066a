"""Training examples and prompts as token ids, by any tokenizer: chats are rendered in the JVM, encoded by tasks, checked and masked in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from importlib import import_module

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiteloom.functions import arrays as A
from kiteloom.functions import text as X

#: Texts to ids.
Encoder = Callable[[Sequence[str]], Sequence[Sequence[int]]]

TOO_LONG, NOTHING_TO_LEARN, NOT_A_PREFIX = "sequence_too_long", "no_supervised_tokens", "prompt_not_a_prefix"


@dataclass(frozen=True)
class Template:
    """How a chat is written: what begins it, what stands around each turn's text, and what asks for an answer.

    ``{role}`` in ``before`` is the turn's role, by the names in ``roles``.
    """

    begin: str = "<bos>"
    before: str = "<start_of_turn>{role}\n"
    after: str = "<end_of_turn>\n"
    answerer: str = "assistant"
    roles: Mapping[str, str] = field(default_factory=lambda: {"assistant": "model"})

    def _before(self, role: Column) -> Column:
        name = role
        for given, written in self.roles.items():
            name = F.when(role == given, F.lit(written)).otherwise(name)
        first, _, rest = self.before.partition("{role}")
        return F.concat(F.lit(first), name, F.lit(rest)) if "{role}" in self.before else F.lit(self.before)

    def render(self, messages: Column, ask: bool) -> Column:
        """The text of an array of (role, content), with the beginning of an answer if ``ask``. Null contents are empty, white space around contents goes."""
        each = F.transform(messages, lambda m: F.concat(self._before(m["role"]), X.collapse_ends(m["content"]), F.lit(self.after)))
        return F.concat(F.lit(self.begin), F.array_join(each, ""), self._before(F.lit(self.answerer)) if ask else F.lit(""))


def code_points() -> Encoder:
    """The default: a text's characters as numbers."""
    return lambda texts: [list(map(ord, t)) for t in texts]


def from_file(path: str) -> Callable[[], Encoder]:
    """A tokenizer's file of the ``tokenizers`` library, which must be on every executor; special tokens' strings count as these tokens, none are added."""

    def make() -> Encoder:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        return lambda texts: [e.ids for e in own.encode_batch(list(texts), add_special_tokens=False)]

    return make


def named(place: str) -> Callable[..., Encoder]:
    """What ``module:function`` names, or ``module:function:argument`` called with it. Anything else raises ``ValueError``."""
    module, _, rest = place.partition(":")
    name, _, argument = rest.partition(":")
    if not module or not name:
        raise ValueError(f"module:function is expected, not {place!r}")
    found = getattr(import_module(module), name, None)
    if not callable(found):
        raise ValueError(f"no function: {place}")
    return found(argument) if argument else found


def encoded(df: DataFrame, columns: Mapping[str, str], make_encoder: Callable[[], Encoder] | str = code_points) -> DataFrame:
    """``df`` with the ids of each text column in ``columns`` under the name it maps to.

    The encoder is made once in a task, on the executor, and gets all texts of
    a part of a batch at once, of about 4 MB. Null texts have no ids. Encoders
    that give another number of sequences than texts raise ``ValueError``.
    """
    make = named(make_encoder) if isinstance(make_encoder, str) else make_encoder
    kept = df.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        for whole in batches:
            step = max(1, int(whole.num_rows * (4 << 20) / max(whole.nbytes, 1)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                texts = [t or "" for c in columns for t in batch.column(kept.index(c)).to_pylist()]
                ids = list(encode(texts))
                if len(ids) != len(texts):
                    raise ValueError(f"{len(texts)} texts gave {len(ids)} sequences")
                n = batch.num_rows
                new = [pa.array([list(x) for x in ids[i * n : (i + 1) * n]], pa.list_(pa.int32())) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*kept, *columns.values()])

    fields = [T.StructField(name, T.ArrayType(T.IntegerType())) for name in columns.values()]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def training_examples(df: DataFrame, longest: int, make_encoder: Callable[[], Encoder] | str = code_points, template: Template | None = None, prompt: str = "prompt", target: str = "target", key: str = "record_id", strict: bool = True) -> DataFrame:
    """(key, input_ids, labels, prompt_tokens, full_tokens, supervised_tokens, skip_reason) of pairs of a prompt and its answer.

    The chat with the answer is encoded as a whole, and once more up to where
    the answer begins. Labels ignore what the two have in common, which must be
    all of the shorter: a tokenizer that merges across the border gives other
    ids there, and then no place of the whole sequence is where the answer
    begins. That raises an error, or if not ``strict`` is a reason to leave the
    example out, as are sequences over ``longest`` ids and answers without any.
    Rows left out have no ids and labels.
    """
    chat = template or Template()
    texts = df.select(
        key,
        chat.render(X.messages(F.col(prompt)), True).alias("prompt_text"),
        chat.render(X.messages(F.col(prompt), F.col(target)), False).alias("full_text"),
    )
    ids = encoded(texts, {"prompt_text": "prompt_ids", "full_text": "full_ids"}, make_encoder)
    p, f = F.col("prompt_ids"), F.col("full_ids")
    begins = F.slice(f, F.lit(1), F.size(p)) == p
    refused = F.lit(NOT_A_PREFIX) if not strict else F.raise_error(F.concat(F.lit("the prompt's ids don't begin the whole sequence's: "), F.col(key).cast("string"))).cast("string")
    reason = F.when(F.size(f) > longest, TOO_LONG).when(~begins, refused).when(F.size(f) <= F.size(p), NOTHING_TO_LEARN)
    judged = ids.withColumn("skip_reason", reason)
    kept = F.col("skip_reason").isNull()
    return judged.select(
        key,
        F.when(kept, f).alias("input_ids"),
        F.when(kept, A.label_mask(p, f)).alias("labels"),
        F.size(p).alias("prompt_tokens"),
        F.size(f).alias("full_tokens"),
        F.when(kept, F.size(f) - F.size(p)).alias("supervised_tokens"),
        "skip_reason",
    )


def encoded_prompts(df: DataFrame, make_encoder: Callable[[], Encoder] | str = code_points, template: Template | None = None, prompt: str = "prompt", key: str = "record_id") -> DataFrame:
    """(key, input_ids): prompts as a generating model gets them, up to where its answer begins."""
    texts = df.select(key, (template or Template()).render(X.messages(F.col(prompt)), True).alias("prompt_text"))
    return encoded(texts, {"prompt_text": "input_ids"}, make_encoder).drop("prompt_text")
