"""Byte-level BPE on a sentencepiece model that is serialised from a vocabulary, and its inverse.

The model's pieces are the vocabulary's tokens with each byte mapped to one printable character; the score of a piece is
its negative rank, so that sentencepiece merges in the order of the ranks. Pre-tokens are encoded separately.

Rows: a null text is an empty one (no tokens); a text of any length is one row and is encoded whole; repeated rows, those that
repeat an id and those without one give a result each; an empty table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bound_batches

#: A space after white space and before more of it, or before the end: only there does a token hold a space after its start.
_SPANNING = re.compile(r"\s (?:\s|\Z)")
#: Fixed value: the public pattern of pre-tokens whose texts can be cut at single spaces.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries that a worker keeps, of so many characters at most; beyond that it starts anew, so that memory is bounded.
CACHE_ENTRIES, CACHE_CHARS = 600_000, 64


def byte_chars() -> list[str]:
    """A printable character for each byte: itself where it is printable in Latin-1, else the next one from U+0100 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | bytes | float) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised ModelProto: the id of a piece is the token's rank, the unknown piece comes last."""
    # Fixed values of the public sentencepiece_model.proto: field numbers and enums.
    piece_normal, piece_unknown, model_bpe = 1, 2, 2
    chars = byte_chars()
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[x] for x in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = [_field(1, "".join(chars[b] for b in x).encode()) + _field(2, -float(i)) + _field(3, piece_normal) for i, x in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, piece_unknown))
    trainer = _field(3, model_bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(k, -1) for k in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return b"".join(_field(1, x) for x in pieces) + _field(2, trainer) + _field(3, normalizer)


class ChunkCache(dict):
    """Chunk of text -> its ids as little-endian 32-bit integers."""

    def __init__(self, encode: Callable[[str], bytes], before: str):
        super().__init__()
        self.encode, self.before = encode, before

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids = self.encode(self.before + chunk)
        if len(chunk) <= CACHE_CHARS:
            self[chunk] = ids
        return ids


class TextEncoder:
    """Encodes texts through caches of space-separated chunks; `encode` maps any text to its ids' bytes.

    With the pattern SPACED a chunk with the space before it is pre-tokenised as in its text unless a run of white space spans the
    cut; texts with such runs go to `encode` whole, and with other patterns all do.
    """

    def __init__(self, encode: Callable[[str], bytes], pattern: str):
        self.encode, self.spaced = encode, pattern == SPACED
        self.first, self.rest = ChunkCache(encode, ""), ChunkCache(encode, " ")

    def __call__(self, text: str) -> bytes:
        if not self.spaced or _SPANNING.search(text):
            return self.encode(text)
        chunks = text.split(" ")
        return self.first[chunks[0]] + b"".join(map(self.rest.__getitem__, chunks[1:]))


def _codec(model: bytes, pattern: str) -> tuple[TextEncoder, list[bytes]]:
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    chars = byte_chars()
    back = {c: b for b, c in enumerate(chars)}
    table = dict(enumerate(chars))
    find = regex.compile(pattern).findall
    known: dict[str, bytes] = {}

    def encode(text: str) -> bytes:
        tokens = find(text)
        if len(known) + len(tokens) > CACHE_ENTRIES:
            known.clear()
        if new := [x for x in dict.fromkeys(tokens) if x not in known]:
            mapped = [x.encode().decode("latin-1").translate(table) for x in new]
            # a list starts a thread pool, which a few pre-tokens are not worth
            ids = processor.encode(mapped, num_threads=1) if len(mapped) > 200 else [*map(processor.encode, mapped)]
            own = {x: struct.pack(f"<{len(i)}I", *i) for x, i in zip(new, ids, strict=True)}
            known.update((x, i) for x, i in own.items() if len(x) <= CACHE_CHARS)
            return b"".join(own[x] if x in own else known[x] for x in tokens)
        return b"".join(map(known.__getitem__, tokens))

    pieces = [b"" if processor.is_unknown(i) else bytes(back[c] for c in processor.id_to_piece(i)) for i in range(processor.get_piece_size())]
    return TextEncoder(encode, pattern), pieces


def decode(ids: bytes, pieces: list[bytes]) -> bytes:
    return b"".join(map(pieces.__getitem__, memoryview(ids).cast("I")))


def encode_decode(documents: DataFrame, ranks_path: str, pattern: str, digests: bool = True) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the bytes decoded from them, or with digests=False `ids` and `decoded`.

    The vocabulary has a fixed size (about 1 MB), so its model is broadcast.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    model = spark.sparkContext.broadcast(sentencepiece_model(read_ranks(ranks_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pieces = _worker_codec(model, pattern)
        for batch in batches:
            ids = [encoder(x or "") for x in batch.column(1).to_pylist()]
            texts = [decode(x, pieces) for x in ids]
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
            if digests:
                columns |= {"ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())}
            else:
                columns |= {"ids": pa.array([list(memoryview(x).cast("I")) for x in ids], pa.list_(pa.int32())), "decoded": pa.array(texts, pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)

    more = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    return documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text")).mapInArrow(run, f"doc_id long, n_tokens long, {more}")


_codecs: dict[tuple, tuple] = {}


def _worker_codec(model, pattern: str) -> tuple:
    """One codec for each worker process, kept between its tasks."""
    key = (hash(model.value), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = _codec(model.value, pattern)
    return _codecs[key]
