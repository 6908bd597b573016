"""Byte-level BPE: encode whole texts to ids and back, over Arrow batches.

The ranks of a ``.tiktoken`` file are the vocabulary.  A rank is also the order of its
merge, so the driver turns the ranks (a fixed file) into vocabulary and merges of the
``tokenizers`` library, with each byte written as one printable character; the ids are that
library's.  A match that is a token whole is that token, as in the definition of the ids.
A text is cut where white space begins: no match of the pattern runs from other characters
into white space, so the chunks encode alike alone.  Equal chunks, and equal matches of the
pattern, are encoded once per task.

Ids travel as little-endian unsigned 32-bit binary.  Decoding joins the printable characters
of the tokens and reverses the byte table; text is made from whole byte strings only, so
characters split over tokens come back whole, and a cut through a character shows as U+FFFD.

Defined results: NULL and empty texts have no ids; NULL ids decode to no bytes; lone
surrogates cannot occur in a Spark string; an id outside the vocabulary is an error.  Very
long texts and matches are encoded whole; only chunks and matches of at most
``CACHE_LENGTH`` characters are kept, so what a task keeps is bounded.
"""

from __future__ import annotations

import base64
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from comarca.llm.common import map_slices

#: Chunks and matches that a task keeps; beyond, it starts anew (the result does not change).
CACHE_PIECES = 200_000
CACHE_LENGTH = 200


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_characters() -> list[str]:
    """One printable character per byte: itself where printable, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair each token was merged from: what is left of it with lower ranks only."""
    merges = []
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__):
        parts, own = [token[i:i + 1] for i in range(len(token))], ranks[token]
        while len(parts) > 2:
            best, at = own, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1], own)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            merges.append((parts[0], parts[1]))
    return merges


def _tokenizer(ranks: dict[bytes, int], merges: list[tuple[bytes, bytes]], pattern: str):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    shown = byte_characters()
    as_text = lambda b: "".join(shown[x] for x in b)
    out = Tokenizer(models.BPE({as_text(t): r for t, r in ranks.items()}, [(as_text(a), as_text(b)) for a, b in merges],
                               ignore_merges=True))  # a match that is a token needs no merges
    out.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


class _Encoder:
    """Encodes the texts of one task; equal chunks once, and equal matches of the pattern once."""

    def __init__(self, ranks, merges, pattern):
        import re

        import regex

        self.model, self.shown = _tokenizer(ranks, merges, pattern).model, byte_characters()
        self.matches = regex.compile(pattern).finditer
        self.chunks = re.compile(r"[ \n]*[^ \n]+|[ \n]+\Z").findall
        # other white space before a blank: the cut would not be where white space begins
        self.mixed = re.compile(r"[^\S \n][ \n]").search
        self.known: dict[str, bytes] = {}
        self.single: dict[str, bytes] = {}

    def match(self, piece: str) -> bytes:
        if (ids := self.single.get(piece)) is None:
            found = self.model.tokenize("".join(map(self.shown.__getitem__, piece.encode())))
            ids = np.array([t.id for t in found], "<u4").tobytes()
            if len(piece) <= CACHE_LENGTH:
                self.single[piece] = ids
        return ids

    def chunk(self, chunk: str) -> bytes:
        if (ids := self.known.get(chunk)) is None:
            ids = b"".join([self.match(m.group()) for m in self.matches(chunk)])
            if len(chunk) <= CACHE_LENGTH:
                self.known[chunk] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        chunks = [text] if self.mixed(text) else self.chunks(text)
        try:
            return b"".join(map(self.known.__getitem__, chunks))
        except KeyError:
            for cache in (self.known, self.single):
                if len(cache) > CACHE_PIECES:
                    cache.clear()
            return b"".join(map(self.chunk, chunks))


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """``ids`` instead of ``text``: the ids of every whole text as little-endian unsigned
    32-bit binary; with ``decoded`` also the bytes decoded from those ids, by the same task."""
    ranks = read_ranks(vocabulary)
    model = docs.sparkSession.sparkContext.broadcast((ranks, merges_of(ranks), pattern))  # a vocabulary: about 2 MB

    def start():
        encoder, back = _Encoder(*model.value), _Decoder(model.value[0])

        def make(texts: pa.Array) -> list[pa.Array]:
            ids = [encoder(t) for t in texts.to_pylist()]
            return [pa.array(ids, pa.binary()), *([pa.array(map(back, ids), pa.binary())] if decoded else [])]
        return make

    return map_slices(docs, [text], "ids binary" + ", decoded binary" * decoded, start)


class _Decoder:
    """From ids to bytes, by way of the printable characters of the tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        shown = byte_characters()
        self.tokens: list = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = "".join(map(shown.__getitem__, token))
        self.byte = np.zeros(512, np.uint8)  # the byte table reversed
        self.byte[[*map(ord, shown)]] = np.arange(256)

    def parts(self, ids: bytes | None) -> list[str]:
        """The tokens, a character for each byte."""
        return [*map(self.tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist())]

    def whole(self, parts: list[str]) -> np.ndarray:
        return self.byte[np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")]

    def __call__(self, ids: bytes | None) -> bytes:
        return self.whole(self.parts(ids)).tobytes()


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """``decoded`` and ``decoded_text`` instead of ``ids``: the bytes, and the text they make
    (a character cut in two shows as U+FFFD)."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def start():
        back = _Decoder(ranks.value)

        def make(column: pa.Array) -> list[pa.Array]:
            raw = [back(x) for x in column.to_pylist()]
            return [pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())]
        return make

    return map_slices(encoded, [ids], "decoded binary, decoded_text string", start)


def offsets(encoded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """``offsets`` instead of ``ids``: per token the characters [start, end) that its bytes touch.

    A character split over several tokens belongs to each of them.
    """
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def start():
        back = _Decoder(ranks.value)

        def spans(x: bytes | None) -> list[dict]:
            parts = back.parts(x)
            if not parts:
                return []
            whole = back.whole(parts)
            begun = np.concatenate([[0], np.cumsum((whole & 0xC0) != 0x80)])  # characters begun before a byte
            ends = np.cumsum([len(p) for p in parts])
            starts = ends - [len(p) for p in parts]
            return [{"start": int(begun[s + 1] - 1), "end": int(begun[e])} for s, e in zip(starts, ends)]

        def make(column: pa.Array) -> list[pa.Array]:
            return [pa.array(map(spans, column.to_pylist()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
        return make

    return map_slices(encoded, [ids], "offsets array<struct<start:int,end:int>>", start)
