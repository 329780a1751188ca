"""SentencePiece encoding with spans in the original bytes, and decoding.

A text is normalised by the compiled character map of the model (longest prefix first), its blanks are escaped and the dummy
prefix is set; for every byte of the result the place in the original is kept. Pieces are looked up, their byte lengths add
up to places in the normalised text, and those are projected to spans of the original bytes.

The merges of a piece model without pieces that run from a non-blank into a blank never cross the start of a blank run, so
each blank-led chunk is encoded on its own, by the library, and remembered in a bounded cache of the worker, with the spans of
its pieces, which come from the normalised chunks and the places of their sources like those of a whole text. A model that has such pieces, that maps characters or strips blanks, or that isn't BPE is encoded text by text,
and so is a text that holds the blank's mark itself.

Defined results: a null text counts as empty and has no ids; spans are half-open byte ranges of the UTF-8 text, in order, and
cover it from 0 to its length; each byte piece covers its part of the character, which is the whole character for the last;
rows, ties and repeats are independent of each other; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as model_pb

from cohortloom.llm.common import map_texts

BLANK = "▁"
_BLANK_BYTES = BLANK.encode()


class CharacterMap:
    """A compiled character map: a double-array trie of byte prefixes over a blob of replacements.

    Fixed values of the format: a 4-byte trie size, then 4-byte units (leaf flag in bit 8, offset from bit 10, scaled by 256
    if bit 9 is set, label in bits 0-7 and 31; in a leaf, the value in bits 0-30), then replacements that end in a zero byte.
    """

    def __init__(self, compiled: bytes) -> None:
        size = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
        self.blob = compiled[4 + size :]

    def longest(self, raw: bytes, start: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest mapped prefix of ``raw[start:]``."""
        units, found = self.units, None
        if not units:
            return None
        node = _offset(units[0])
        for at in range(start, len(raw)):
            node ^= raw[at]
            unit = units[node]
            if unit & 0x800000FF != raw[at]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                found = at + 1 - start, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.blob[found[1] : self.blob.index(b"\0", found[1])]


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 0x200) >> 6)


def _character_length(first: int) -> int:
    return 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


class Normalizer:
    """Normalised bytes with, for each of them, where its source starts and ends in the original."""

    def __init__(self, spec: model_pb.NormalizerSpec) -> None:
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.spec = spec

    def __call__(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        raw = text.encode()
        out, starts, ends = self._identity(raw) if not self.map.units else self._mapped(raw)
        if self.spec.remove_extra_whitespaces:
            out, starts, ends = self._single_blanks(out, starts, ends)
        if not len(out):
            return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        mark = _BLANK_BYTES if self.spec.escape_whitespaces else b" "
        if self.spec.add_dummy_prefix:
            out = b" " + out
            starts, ends = np.concatenate([starts[:1], starts]), np.concatenate([starts[:1], ends])
        width = np.where(np.frombuffer(out, np.uint8) == 32, len(mark), 1)
        return out.replace(b" ", mark), np.repeat(starts, width), np.repeat(ends, width)

    @staticmethod
    def _identity(raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        at = np.arange(len(raw), dtype=np.int64)
        return raw, at, at + 1

    def _mapped(self, raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        parts, sizes, starts, ends, at = [], [], [], [], 0
        while at < len(raw):
            found = self.map.longest(raw, at)
            step, piece = found if found else (n := _character_length(raw[at]), raw[at : at + n])
            parts.append(piece)
            sizes.append(len(piece))
            starts.append(at)
            at += step
            ends.append(at)
        sizes = np.array(sizes, np.int64)
        return b"".join(parts), np.repeat(np.array(starts, np.int64), sizes), np.repeat(np.array(ends, np.int64), sizes)

    @staticmethod
    def _single_blanks(out: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        codes = np.frombuffer(out, np.uint8)
        blank = codes == 32
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        if len(codes):
            last = np.flatnonzero(~blank)
            keep[(last[-1] + 1 if len(last) else 0) :] = False
        return codes[keep].tobytes(), starts[keep], ends[keep]


class PieceCodec:
    """Ids, original spans and decoded text by one model file."""

    #: Chunks that a worker remembers before it starts afresh, and the longest of them.
    CACHED, CACHED_LENGTH = 450_000, 64

    def __init__(self, path: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = model_pb.ModelProto()
        proto.ParseFromString(self.library.serialized_model_proto())
        spec, pieces = proto.normalizer_spec, proto.pieces
        self.normalize = Normalizer(spec)
        self.plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces
        own_chunks = (
            spec.add_dummy_prefix
            and spec.escape_whitespaces
            and not proto.trainer_spec.treat_whitespace_as_suffix
            and proto.trainer_spec.model_type == model_pb.TrainerSpec.BPE
            and not any(re.search(f"[^{BLANK}]{BLANK}", p.piece) for p in pieces)
            and not any(p.type == model_pb.ModelProto.SentencePiece.USER_DEFINED for p in pieces)
        )
        self.by_chunk = self.plain and own_chunks
        byte_type = model_pb.ModelProto.SentencePiece.BYTE
        self.lengths = np.array([1 if p.type == byte_type else len(p.piece.encode()) for p in pieces], np.int64)
        kinds = {p.type for p in pieces}
        self.surfaces = [
            bytes([int(p.piece[3:5], 16)]) if p.type == byte_type else p.piece.replace(BLANK, " ").encode() for p in pieces
        ]
        self.own_surfaces = kinds <= {1, 2, 3, 6}  # normal, unknown, control, byte
        self.blank_id = self.library.piece_to_id(BLANK)
        self.chunks: dict[str, tuple[str, bytes, int, int]] = {}
        self.odd: dict[str, str] = {}

    def _decode(self, ids: list[int]) -> str:
        """Decoded text of ids that start with a blank, which stays."""
        if self.own_surfaces and min(ids) > 2:
            try:
                return b"".join([self.surfaces[i] for i in ids]).decode()
            except UnicodeDecodeError:
                pass
        return " " + self.library.decode(ids)

    def _encode_chunks(self, chunks: list[str]) -> None:
        """Remember joined ids, ends of the pieces, bytes and number of pieces of chunks, by their text after the first blank."""
        if not chunks:
            return
        all_ids = [ids or [self.blank_id] for ids in self.library.encode(chunks, num_threads=1)]
        stops = list(accumulate([len(ids) for ids in all_ids], initial=0))
        ends, sizes = self._chunk_ends(chunks, all_ids, stops)
        for k, (chunk, ids) in enumerate(zip(chunks, all_ids)):
            self.chunks[chunk] = ",".join(map(str, ids)), ends[4 * stops[k] : 4 * stops[k + 1]], sizes[k], len(ids)
            surface = self._decode(ids)
            if surface != " " + chunk:
                self.odd[chunk] = surface

    def _chunk_ends(self, chunks: list[str], all_ids: list[list[int]], stops: list[int]) -> tuple[bytes, list[int]]:
        """Ends of the pieces of each chunk in its bytes (its first blank included), as 4-byte numbers, and these bytes' count.

        The chunks, joined by their blanks, are normalised together; the pieces' places in the result are projected to their sources.
        """
        sizes = [len(c.encode()) + 1 for c in chunks]
        normal, _, sources = self.normalize(" ".join(chunks))
        places = np.cumsum(self.lengths[np.fromiter(chain.from_iterable(all_ids), np.int64, stops[-1])])
        if places[-1] != len(normal):  # a lone blank, or unknown characters, which aren't as long as the piece of their id
            parts = [self.spans(c, np.array(ids, np.int64)) + 1 if c else np.ones(1, np.int64) for c, ids in zip(chunks, all_ids)]
            return np.concatenate(parts).astype(np.int32).tobytes(), sizes
        starts = np.cumsum([0, *sizes[:-1]])
        ends = sources[places - 1] + 1 - np.repeat(starts, np.diff(stops))
        return ends.astype(np.int32).tobytes(), sizes

    def encode(self, texts: list[str]) -> list[tuple[str, np.ndarray, str]]:
        """Of each text: ids joined by commas, ends of the pieces in its bytes, text decoded from the ids."""
        if len(self.chunks) > self.CACHED:
            self.chunks.clear()
            self.odd.clear()
        split = [self._split(t) for t in texts]
        missing = set(chain.from_iterable(s for s in split if s)).difference(self.chunks)
        self._encode_chunks(list(missing))
        out = [self._whole(t) if s is None else self._from_chunks(t, s) for t, s in zip(texts, split)]
        for c in missing:
            if len(c) > self.CACHED_LENGTH:
                del self.chunks[c]
                self.odd.pop(c, None)
        return out

    def _split(self, text: str) -> list[str] | None:
        """Chunks without their first blank; None where the text must be encoded whole."""
        if not self.by_chunk or BLANK in text:
            return None
        if not text:
            return []
        if "  " in text or text[0] == " ":
            return [c[1:] for c in _CHUNKS.findall(" " + text)]
        return text.split(" ")

    def _from_chunks(self, text: str, chunks: list[str]) -> tuple[str, np.ndarray, str]:
        if not chunks:
            return "", np.zeros(0, np.int64), ""
        ids, ends, sizes, counts = zip(*map(self.chunks.__getitem__, chunks))
        starts = np.cumsum((-1, *sizes[:-1]))
        ends = np.frombuffer(b"".join(ends), np.int32) + np.repeat(starts, counts)
        decoded = text
        if self.odd and not self.odd.keys().isdisjoint(chunks):
            decoded = "".join([self.odd.get(c, " " + c) for c in chunks])[1:]
        return ",".join(ids), ends, decoded

    def _whole(self, text: str) -> tuple[str, np.ndarray, str]:
        ids = self.library.encode(text)
        return ",".join(map(str, ids)), self.spans(text, np.array(ids, np.int64)), self.library.decode(ids)

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Ends of the pieces in the original bytes, through the alignment of the normalised text."""
        if not len(ids):
            return np.zeros(0, np.int64)
        normal, _, ends = self.normalize(text)
        places = np.cumsum(self.lengths[ids])
        if places[-1] != len(normal):  # unknown characters aren't as long as the piece of their id
            pieces = self.library.encode(text, out_type="immutable_proto").pieces
            places = np.minimum(np.cumsum([len(p.piece.encode()) for p in pieces]), len(normal))
        stops = ends[places - 1]
        stops[-1] = len(text.encode())
        return stops


_CHUNKS = re.compile(" +[^ ]*")


@lru_cache(maxsize=4)
def codec(path: str) -> PieceCodec:
    """The codec of a model file, once per Python worker."""
    return PieceCodec(path)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _begins(ends: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), ends[:-1]])[: len(ends)]


#: What an encoding can return, from ids joined by commas, ends of the byte spans, and decoded text.
COLUMNS: dict[str, tuple[str, pa.DataType, Callable]] = {
    "n_tokens": ("bigint", pa.int64(), lambda ids, ends, decoded: len(ends)),
    "ids": ("array<int>", pa.list_(pa.int32()), lambda ids, ends, decoded: [int(i) for i in ids.split(",") if i]),
    "begins": ("array<bigint>", pa.list_(pa.int64()), lambda ids, ends, decoded: _begins(ends)),
    "ends": ("array<bigint>", pa.list_(pa.int64()), lambda ids, ends, decoded: ends),
    "decoded": ("string", pa.string(), lambda ids, ends, decoded: decoded),
    "ids_sha256": ("string", pa.string(), lambda ids, ends, decoded: _sha256(ids)),
    "decoded_sha256": ("string", pa.string(), lambda ids, ends, decoded: _sha256(decoded)),
    "spans_sha256": ("string", pa.string(), lambda ids, ends, decoded: hashlib.sha256(ends.astype("<i8").tobytes()).hexdigest()),
}


def encode_pieces(docs: DataFrame, path: str, columns: tuple[str, ...] = ("ids", "begins", "ends", "decoded")) -> DataFrame:
    """``doc_id`` and the wanted columns: ids, byte spans of the pieces in the original, and the text decoded from the ids.

    Short forms: ``n_tokens``; SHA-256 of the decimal ids joined by commas, of the decoded text in UTF-8, and of the spans'
    ends as 8-byte little-endian numbers.
    """
    schema = ", ".join(f"{c} {COLUMNS[c][0]}" for c in columns)

    def per_task() -> Callable[[list[str]], list[pa.Array]]:
        model = codec(path)

        def work(texts: list[str]) -> list[pa.Array]:
            rows = model.encode(texts)
            return [pa.array([COLUMNS[c][2](*r) for r in rows], COLUMNS[c][1]) for c in columns]

        return work

    return map_texts(docs, per_task, schema)
