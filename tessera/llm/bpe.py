"""Byte-level BPE with a sentencepiece model serialised from a rank file.

Each token's bytes are written as printable characters, one for each byte, and
become a piece whose score is its negative rank, so that merging the best
score first is merging the lowest rank first. Normalisation is the identity.
Texts are cut into pre-tokens by the vocabulary's pattern; a pre-token that is
a token stands for itself, the model merges any other. Decoding maps ids back
to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import id_out, id_text, raw, slices
from .pretokens import ChunkEncoder, mapped


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _piece(text: str, score: float, kind: int = 1) -> bytes:
    return _bytes(1, _bytes(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank from lines of base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: pieces by rank, then the unknown piece that the format asks for.

    Fields: 1 pieces (1 text, 2 score, 3 type; type 2 is unknown), 2 trainer
    (3 model type, 2 is BPE; 4 vocabulary size; 40 unknown id), 3 normaliser
    (1 name; 3 dummy prefix, 4 remove extra spaces, 5 escape spaces: all off).
    """
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks have to be 0, 1, 2 and so on")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a token: {missing}")
    return (
        b"".join(_piece(mapped(t), -i) for i, t in enumerate(tokens))
        + _piece("<unk>", 0.0, 2)
        + _bytes(2, _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens)))
        + _bytes(3, _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    )


class ByteBpe:
    """Encodes and decodes by a rank file, as a rank-merging encoder without special tokens does."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.tokens = [b""] * len(ranks)
        for token, rank in ranks.items():
            self.tokens[rank] = token

        def pretoken(text: str) -> bytes:
            data = text.encode()
            if (rank := ranks.get(data)) is not None:
                return struct.pack("<I", rank)
            ids = self.model.encode(mapped(data))
            return struct.pack(f"<{len(ids)}I", *ids)

        self._encode = ChunkEncoder(pattern, pretoken)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self._encode(text), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def coder(path: str, pattern: str) -> ByteBpe:
    """One for each worker and vocabulary."""
    return ByteBpe(read_ranks(path), pattern)


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and unless ``digests_only`` the ids and the decoded text.

    Whole texts; a null text is empty and has no ids. Ill-formed UTF-8 is read
    with replacement characters. Nothing is shuffled, other columns are
    ignored, repeated rows are encoded each.
    """
    more = [] if digests_only else [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary, pattern)
        for b in slices(batches, 256):
            n, ids_hash, text_hash, kept, texts = [], [], [], [], []
            for t in raw(b.column("text")):
                ids = c.encode(t.decode("utf-8", "replace"))
                back = c.decode(ids)
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_hash.append(hashlib.sha256(back).hexdigest())
                if more:
                    kept.append(ids.astype("<i4"))
                    texts.append(back.decode("utf-8", "replace"))
            data = [b.column("id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            if more:
                data += [pa.array(kept, more[0][1]), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(data, ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(k for k, _ in more)])

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ("" if digests_only else ", ids array<int>, decoded string")
    out = id_text(docs, id_col, text_col).mapInArrow(step, schema)
    return out.select(id_out(), *[c for c in out.columns if c != "id"])


def decode(tokens: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows with token ids; null ids give an empty text."""

    def step(batches):
        c = coder(vocabulary, pattern)
        for b in slices(batches, 256):
            texts = [c.decode(np.asarray(x or [], "<i8")).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.selectExpr(f"cast({id_col} as long) doc_id", f"{ids_col} ids").mapInArrow(step, "doc_id long, text string")
