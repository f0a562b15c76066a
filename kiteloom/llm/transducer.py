"""BPE as a left-to-right transducer with bounded lookahead, and its incremental decoder."""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, releasing, schema_of, slices

#: The split pattern of vocabularies with word ends (fixed value), and the same for ASCII texts in lower case.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
#: Characters outside Latin letters and general punctuation: texts that hold one are split by the library's own parts.
_OTHER = re.compile("[^\\x00-\\u024f\\u2010-\\u2027\\u2030-\\u205e]")
_GAP = re.compile("[ \\t\\n\\r]")


def byte_names() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is printable Latin-1, else one from U+0100 on."""
    out, more = [], 256
    for b in range(256):
        plain = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b
        out.append(chr(b if plain else more))
        more += not plain
    return out


_NAMES = byte_names()
_TO_NAMES = dict(enumerate(_NAMES))
_TO_BYTE = {c: b for b, c in enumerate(_NAMES)}
#: Added to a character to mark it as a word's last one.
_END = 0x1000


def symbols(word: str) -> str:
    """A word's UTF-8 bytes, a character each."""
    return word.encode().decode("latin-1").translate(_TO_NAMES)


class Merges:
    """An ordered merge list, read from left to right.

    Each prefix of a text has one encoding, and it ends in one token, so a
    prefix is known by its last token alone: that of a longer prefix is the one
    token that ends there and may stand beside the last token before its start.
    Two tokens may stand side by side if undoing their merges, the latest first,
    never meets a pair at their border that would have been merged before.

    That holds for lists in which every part of a merge is a symbol or made by
    an earlier merge, and no token is made twice; others raise ``ValueError``.
    """

    def __init__(self, symbols: Iterable[str], merges: Iterable[tuple[str, str]]) -> None:
        self.rank = dict.fromkeys(symbols, -1)
        self.parts: dict[str, tuple[str, str]] = {}
        for rank, (a, b) in enumerate(merges):
            if a not in self.rank or b not in self.rank or a + b in self.rank:
                raise ValueError(f"merge {rank} has a part not made before, or makes a token again")
            self.rank[a + b], self.parts[a + b] = rank, (a, b)
        # A token whose own merges are overtaken inside it never comes out.
        self.sound = {t for t in self.rank if t not in self.parts or self.beside(*self.parts[t], self.rank[t])}
        for t in sorted(self.parts, key=self.rank.__getitem__):
            if not self.sound.issuperset(self.parts[t]):
                self.sound.discard(t)
        self.longest = max(map(len, self.rank), default=1)
        lengths: dict[str, set[int]] = {}
        for t in self.sound:
            if len(t) > 2:
                lengths.setdefault(t[-3:], set()).add(len(t))
        #: By a text's last three symbols the lengths of the tokens that may end there, the longest first.
        self.lengths = {end: tuple(sorted(own | {1, 2}, reverse=True)) for end, own in lengths.items()}
        self.known: dict[tuple[str, str], bool] = {}

    def beside(self, left: str, right: str, limit: float = float("inf")) -> bool:
        """Whether no merge before ``limit`` joins the two across their border."""
        rank, parts = self.rank, self.parts
        while True:
            whole = left + right
            if rank.get(whole, limit) < limit and parts.get(whole) == (left, right):
                return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, parts[left][1]
            else:  # of equal merges the left one is done first, so the right one is undone first
                limit, right = b + 1, parts[right][0]

    @cached_property
    def lookahead(self) -> int:
        """How many symbols after a place settle whether a token ends there.

        Let two texts agree up to some point, and a merge (a, b) of rank r be
        done across a place in one, not in the other. Then at that time a or b
        isn't whole there, or is part of something longer. So another merge, of
        a lower rank, differs between the texts: inside a, inside b, across the
        start of a, or across the end of b. (Of equal merges only one further
        left can be in the way.) Each such step moves the place by a part's
        length and lowers the rank; the last one ends in symbols that differ.
        The furthest that such a chain can reach to the right is found over
        merges by rank, parts being looked up by their common ends and starts.
        """
        reach: dict[str, int] = {}
        left_is: dict[str, int] = {}
        left_ends: dict[str, int] = {}
        right_is: dict[str, int] = {}
        right_starts: dict[str, int] = {}
        for token, (a, b) in self.parts.items():
            after = max([left_ends.get(b, 0), *(left_is.get(b[i:], 0) for i in range(len(b)))])
            before = max([right_starts.get(a, 0), *(right_is.get(a[:i], 0) for i in range(1, len(a) + 1))])
            far = max(len(b) + after, before - len(a))
            if a in self.parts:
                far = max(far, reach[a] - len(self.parts[a][1]))
            if b in self.parts:
                far = max(far, reach[b] + len(self.parts[b][0]))
            reach[token] = far
            for table, keys in ((left_is, [a]), (left_ends, [a[i:] for i in range(len(a))]), (right_is, [b]), (right_starts, [b[:i] for i in range(1, len(b) + 1)])):
                for key in keys:
                    if table.get(key, 0) < far:
                        table[key] = far
        return max(reach.values(), default=0)

    def tokens(self, parts: Iterable[str], block: int = 4096) -> Iterator[str]:
        """The tokens of a word given in parts, each as soon as no later symbol can change it, looked after every ``block`` symbols.

        Holds ``block`` + ``lookahead`` symbols and a part at most, however long the word is.
        """
        sound, known, lengths = self.sound, self.known, self.lengths
        held, last, before = "", [], None  # symbols not settled, the last token of each prefix, the token before
        for part in parts:
            held += part
            for end in range(len(last) + 1, len(held) + 1):
                for n in lengths.get(held[max(end - 3, 0) : end], (2, 1)):
                    if n > end or (token := held[end - n : end]) not in sound:
                        continue
                    previous = last[end - n - 1] if end > n else before
                    if previous is None:
                        break
                    pair = (previous, token)
                    fits = known.get(pair)
                    if fits is None:
                        if len(known) > 1 << 18:
                            known.clear()
                        fits = known[pair] = self.beside(previous, token)
                    if fits:
                        break
                else:
                    raise ValueError(f"a symbol that the vocabulary lacks: {held[end - 1]!r}")
                last.append(token)
            if len(held) > block + self.lookahead:
                path = self._path(last, len(held))
                cut = 0
                for token in path:
                    if cut + len(token) > len(held) - self.lookahead:
                        break
                    yield token
                    cut, before = cut + len(token), token
                held, last = held[cut:], last[cut:]
        yield from self._path(last, len(held))

    @staticmethod
    def _path(last: list[str], end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(last[end - 1])
            end -= len(out[-1])
        return out[::-1]


class Tokenizer:
    """Ids of texts as the ``tokenizers`` library gives them for a byte-level BPE file, with or without word ends.

    The library's own normalizer and splitter are used where a text has other
    characters than Latin letters and general punctuation; merging is done here.
    """

    def __init__(self, vocab_file: str, cache: int = 1 << 18) -> None:
        import regex
        from tokenizers import Tokenizer as Library

        with open(vocab_file, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.end = model.get("end_of_word_suffix") or ""
        own = {}
        for c in _NAMES:
            own[c] = c
            if self.end:
                own[c + self.end] = chr(ord(c) + _END)
        base = [own[t] for t in own if t in model["vocab"]]
        pairs = []
        for a, b in merges:
            pairs.append((own[a], own[b]))
            own[a + b] = own[a] + own[b]
        self.merges = Merges(base, pairs)
        self.ids = {own[t]: i for t, i in model["vocab"].items() if t in own}
        added = data.get("added_tokens") or []
        if model.get("unk_token") or model.get("byte_fallback") or model.get("ignore_merges") or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"a kind of vocabulary that isn't supported: {vocab_file}")
        self.special = {t["content"]: t["id"] for t in added}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        library = Library.from_file(vocab_file)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        split = (data.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.latin_words = regex.compile(_WORDS) if self.end and split[0].get("pattern") == {"Regex": _WORDS} else None
        self.decoder = (data.get("decoder") or {}).get("type")
        if self.decoder not in (None, "ByteLevel"):
            raise ValueError(f"a decoder that isn't supported: {self.decoder}")
        names = {i: t for t, i in [*model["vocab"].items(), *self.special.items()]}
        self.written = [self._bytes_of(names[i]) if i in names else b"" for i in range(max(names, default=-1) + 1)]
        self.cache, self.known = cache, {named: _Known(self, named) for named in (False, True)}

    def _bytes_of(self, token: str) -> bytes:
        """What a token adds to a decoded text: its bytes, or without a decoder its name behind a space."""
        if self.decoder is None:
            return b" " + token.encode()
        return bytes(map(_TO_BYTE.__getitem__, token)) if all(c in _TO_BYTE for c in token) else token.encode()

    def _names(self, word: str, step: int = 4096) -> Iterator[str]:
        """A word, in symbols, in parts; the last symbol says so where the vocabulary has word ends."""
        for at in range(0, len(word), step):
            part = word[at : at + step]
            yield part[:-1] + chr(ord(part[-1]) + _END) if self.end and at + step >= len(word) else part

    def ids_of(self, names: str) -> Iterator[int]:
        """The ids of one word's symbols, one after the other."""
        return map(self.ids.__getitem__, self.merges.tokens(self._names(names)))

    def chunks(self, text: str, size: int = 1 << 16) -> Iterator[str]:
        """A text in parts of about ``size`` characters, cut before white space: no token and no normalization crosses that."""
        if self.latin_words is None:
            yield text  # white space is part of tokens here
            return
        at = 0
        while len(text) - at > size and (gap := _GAP.search(text, at + size)):
            yield text[at : gap.start()]
            at = gap.start()
        yield text[at:] if at else text

    def words(self, text: str) -> tuple[list[str], bool]:
        """The words of a text without special tokens, and whether they are written in symbols already."""
        if self.latin_words:
            if text.isascii():
                return _ASCII_WORDS.findall(text.lower()), False
            if not _OTHER.search(text):
                return self.latin_words.findall(text.lower()), False
        if self.normalizer:
            text = self.normalizer.normalize_str(text)
        return [w for w, _ in self.splitter.pre_tokenize_str(text)] if text else [], True

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of a text as little-endian unsigned 32-bit integers, part by part."""
        for chunk in self.chunks(text):
            parts = self.split_special.split(chunk) if self.split_special and any(s in chunk for s in self.special) else [chunk]
            for i, part in enumerate(parts):
                if i % 2:
                    yield self.special[part].to_bytes(4, "little")
                elif part:
                    found, named = self.words(part)
                    known = self.known[named]
                    if len(known) > self.cache:
                        known.clear()
                    yield b"".join(map(known.__getitem__, found))


class _Known(dict):
    """Ids of words as bytes, found when first asked for; long words aren't kept."""

    def __init__(self, tokenizer: Tokenizer, named: bool, longest: int = 64) -> None:
        self.tokenizer, self.named, self.longest = tokenizer, named, longest

    def __missing__(self, word: str) -> bytes:
        ids = np.fromiter(self.tokenizer.ids_of(word if self.named else symbols(word)), "<u4").tobytes()
        if len(word) <= self.longest:
            self[word] = ids
        return ids


class Decoder:
    """Bytes of ids to text, fed part by part: what an unfinished character has so far is held back until it is whole or broken."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.written = tokenizer.written
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.spaced = tokenizer.decoder is None
        self.begun = False

    def feed(self, ids: bytes) -> str:
        """The text that further ids make certain; ids that the vocabulary lacks add nothing."""
        found = np.frombuffer(ids, "<u4")
        if len(found) and int(found.max()) >= len(self.written):
            found = found[found < len(self.written)]
        out = self.state.decode(b"".join(map(self.written.__getitem__, found.tolist())))
        if self.spaced and not self.begun and out:
            self.begun, out = True, out[1:]
        return out

    def finish(self) -> str:
        """What is left at the end: a replacement character for a broken one."""
        return self.state.decode(b"", final=True)


@lru_cache(maxsize=4)
def tokenizer(vocab_file: str) -> Tokenizer:
    return Tokenizer(vocab_file)


def _decoded(of: Tokenizer, parts: Iterable[bytes]) -> str:
    decoder = Decoder(of)
    return "".join([*map(decoder.feed, parts), decoder.finish()])


def encode(df: DataFrame, vocab_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) for every row: the ids of its whole text as little-endian unsigned 32-bit integers, without added special tokens.

    Special tokens' strings inside texts count as these tokens. Null and empty
    texts, and texts of white space alone, have none; repeated rows, null ids and
    empty tables pass through; other columns are ignored. Very long words go
    through the transducer in parts. ``vocab_file`` must be on every executor.
    """
    return round_trip(df, vocab_file, id_col, text_col, decoded=False)


def round_trip(df: DataFrame, vocab_file: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """As ``encode``, and decoded, the text of these ids as ``decode`` gives it, each part decoded when it is encoded."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = tokenizer(vocab_file)
        for batch in slices(batches, 2 << 20):
            ids, texts = [], []
            for text in batch.column(1).to_pylist():
                parts = list(of.encode(text))
                ids.append(b"".join(parts))
                if decoded:
                    texts.append(_decoded(of, parts))
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            names = [id_col, "n_tokens", "ids"]
            if decoded:
                columns, names = [*columns, pa.array(texts, pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = "n_tokens long, ids binary" + ", decoded string" * decoded
    return id_and_text(df, id_col, text_col).mapInArrow(releasing(run), schema_of(df, id_col, fields))


def decode(df: DataFrame, vocab_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the text of ids as little-endian unsigned 32-bit integers, special tokens included.

    Without a decoder in the vocabulary that is the tokens' names with spaces
    between, as the library does it. Ids that the vocabulary lacks add nothing;
    null ids give an empty text; repeated rows and empty tables pass through;
    bytes that aren't a multiple of four raise ``ValueError``.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = tokenizer(vocab_file)
        for batch in slices(batches, 2 << 20):
            texts = [_decoded(of, [ids or b""]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "decoded"])

    return df.select(id_col, ids_col).mapInArrow(releasing(run), schema_of(df, id_col, "decoded string"))
