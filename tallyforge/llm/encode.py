"""Token ids of whole corpora by a public byte-level vocabulary, run as a sentencepiece BPE model."""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary files lie; a parameter of every function that needs one.
TOKENIZER_FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: the published pre-token pattern of the byte-level vocabulary.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Most distinct pre-tokens a task remembers; beyond, it forgets them all and goes on.
CACHE = 200_000


def byte_letters() -> list[str]:
    """A printable character for each byte: visible Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Byte strings of a rank file in the order of their ids."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ordered = sorted((int(rank), base64.b64decode(piece)) for piece, rank in pairs)
    if [rank for rank, _ in ordered] != list(range(len(ordered))):
        raise ValueError("the ranks have gaps")
    return [piece for _, piece in ordered]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def build_model(pieces: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model of a byte-level vocabulary.

    Piece i keeps id i and has the score -i, so that merges happen in the order of ranks; the unknown
    piece that the format demands comes last and can't occur, as every byte is a piece. Normalisation is the identity.
    """
    letters = byte_letters()
    normal, unknown = 1, 2
    body = bytearray()
    for rank, piece in enumerate(pieces):
        text = "".join(letters[b] for b in piece).encode()
        body += _block(1, _block(1, text) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _number(3, normal))
    body += _block(1, _block(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, unknown))
    bpe = 2
    body += _block(2, _number(3, bpe) + _number(4, len(pieces) + 1) + _number(40, len(pieces)))
    body += _block(3, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(body)


class Codec:
    """Encoder and decoder of one task, from the serialised model."""

    def __init__(self, model: bytes, pattern: str = PRETOKEN):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        self.letters = byte_letters()
        self.table = {b: letter for b, letter in enumerate(self.letters)}
        self.bytes = {letter: b for b, letter in enumerate(self.letters)}
        self.known: dict[str, list[int]] = {}

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts have none. Lone surrogates count as U+FFFD."""
        split = [self.find(t) if t else [] for t in texts]
        if len(self.known) > CACHE:
            self.known = {}
        fresh = list({w for words in split for w in words if w not in self.known})
        if fresh:
            mapped = [w.encode("utf-8", "replace").decode("latin-1").translate(self.table) for w in fresh]
            self.known.update(zip(fresh, self.model.encode(mapped, out_type=int, num_threads=1)))
        known = self.known
        return [[i for w in words for i in known[w]] for words in split]

    def decode(self, ids: list[int]) -> str:
        """The text of ids."""
        mapped = "".join(self.model.id_to_piece(int(i)) for i in ids)
        return bytes(self.bytes[c] for c in mapped).decode("utf-8", "replace")


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", folder: str = TOKENIZER_FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids) of every row, without special tokens; their strings in a text are ordinary text.

    A null or empty text gives an empty list, rows with equal ids each come out. The model, under 1 MB
    for this vocabulary, is built once and sent to the executors, which need no vocabulary file.
    """
    model = docs.sparkSession.sparkContext.broadcast(build_model(read_ranks(os.path.join(folder, vocabulary))))
    source = docs.select(id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids = codec.encode_batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_column, "ids"])

    kind = source.schema[id_column].dataType.simpleString()
    return source.mapInArrow(run, f"{id_column} {kind}, ids array<int>")


def decode(tokens: DataFrame, id_column: str = "doc_id", folder: str = TOKENIZER_FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, text) from (id, ids); a null list gives a null text."""
    model = tokens.sparkSession.sparkContext.broadcast(build_model(read_ranks(os.path.join(folder, vocabulary))))
    source = tokens.select(id_column, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value)
        for batch in batches:
            texts = [None if ids is None else codec.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    kind = source.schema[id_column].dataType.simpleString()
    return source.mapInArrow(run, f"{id_column} {kind}, text string")
