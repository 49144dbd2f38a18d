"""Byte-level BPE with a sentencepiece model written directly from a rank file.

Every token of the vocabulary becomes a piece in which each byte is one printable
character; its score is its negative rank, so sentencepiece merges in rank order. The
model normalises nothing. Texts are cut by the vocabulary's pattern and each pre-token is
encoded by itself; decoding maps ids back to bytes.

The vocabulary is a fixed file: it is read on the driver and goes to tasks with the code.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame

from tieout.llm.common import blocks, text_or_empty

#: Distinct pre-tokens that a task remembers; when full, it starts anew.
REMEMBERED = 200_000


def byte_characters() -> str:
    """A printable character per byte: itself where it is printable Latin-1, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(other)) for b in range(256))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, f)))}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol buffer field: message or string, integer, or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialised(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model of the vocabulary: piece 0 is unknown, piece r + 1 the token of the r-th rank.

    Scores are exact as 32-bit floats up to 2^24 tokens.
    """
    char = byte_characters()
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    for i, (token, rank) in enumerate(sorted(ranks.items(), key=lambda x: x[1])):
        if i != rank:
            raise ValueError(f"ranks must run from 0 without gaps; {rank} stands at {i}")
        pieces.append(_field(1, _field(1, "".join(char[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, 1)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0)
    trainer += b"".join(_varint(n << 3) + b"\xff" * 9 + b"\x01" for n in (41, 42, 43))  # no begin, end or padding piece: -1
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes pre-tokens with the serialised model, decodes ids by the inverse mapping."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.whole = ranks
        self.char = byte_characters()
        self.find = regex.compile(pattern).findall
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=serialised(ranks))
        self.known: dict[str, tuple[int, ...]] = {}

    def _learn(self, pretokens: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = [p for p in pretokens if p not in self.known]
        spelled = []
        for p in new:
            raw = p.encode()
            if raw in self.whole:  # a token of the vocabulary is never taken apart
                self.known[p] = (self.whole[raw],)
            else:
                spelled.append((p, raw.decode("latin-1").translate(self.char)))
        for (p, _), ids in zip(spelled, self.pieces.encode([s for _, s in spelled], num_threads=1)):
            self.known[p] = tuple([i - 1 for i in ids])

    def encode(self, text: str) -> list[int]:
        found = self.find(text)
        try:
            return list(chain.from_iterable(map(self.known.__getitem__, found)))
        except KeyError:
            self._learn(set(found))  # all of them, also where the memory starts anew
            return list(chain.from_iterable(map(self.known.__getitem__, found)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _columns(vocabulary: bytes, pattern: str, keep_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, vocabulary.splitlines())}
        codec = Codec(ranks, pattern)
        digits = [str(i) for i in range(len(ranks))]
        names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep_ids else [])]
        for batch in batches:
            texts = [text_or_empty(t) for t in batch["text"]]
            for i, j in blocks(texts):
                rows = []
                for text in texts[i:j]:
                    ids = codec.encode(text)
                    back = codec.decode(ids)
                    row = (len(ids), hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(back).hexdigest())
                    rows.append((*row, ids, back.decode()) if keep_ids else row)
                out = pd.DataFrame(rows, columns=names)
                out.insert(0, "doc_id", batch["doc_id"].iloc[i:j].astype("Int64").to_numpy())
                yield out.astype({"doc_id": "Int64"})

    return run


def encoded(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """Token ids of every whole text, and the text decoded from them.

    Returns doc_id, n_tokens, the SHA-256 of the ids (decimal, joined by a space) and of
    the decoded bytes and, with ``keep_ids``, ids and decoded text. Null texts count as
    empty: no tokens. Special tokens are ordinary text.
    """
    vocabulary = b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in sorted(read_ranks(path).items(), key=lambda x: x[1]))
    more = ", ids array<int>, decoded string" if keep_ids else ""
    return docs.select("doc_id", "text").mapInPandas(_columns(vocabulary, pattern, keep_ids), f"doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
