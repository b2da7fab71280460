"""SentencePiece encoding and decoding with offsets into the original text.

Normalisation takes, at each position, the longest key of the model's compiled character map (a
double-array trie followed by the replacements), else one character, and records for every byte of the
normalised text the original byte that it came from. The library gives the ids; the pieces' lengths,
added up, tile the normalised text, and the recorded alignment projects every piece to its span of
original bytes. A tiling that doesn't end where the normalised text ends is an error.

Defined results: null counts as empty (no ids, decoded as empty); rows that repeat give equal
results; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capforge.llm.common import task_memory, text_or_empty

# Fixed values of the model file: piece types and the visible space.
UNKNOWN, USER_DEFINED, BYTE = 2, 4, 6
VISIBLE = "▁".encode()


def character_map(blob: bytes) -> dict[bytes, bytes]:
    """All keys and replacements of a compiled character map."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
    texts = blob[4 + size:]
    out, todo = {}, [(0, b"")]
    while todo:
        node, key = todo.pop()
        unit = units[node]
        base = node ^ ((unit >> 10) << ((unit & 0x200) >> 6))
        if key and unit >> 8 & 1:
            at = units[base] & 0x7FFFFFFF
            out[key] = texts[at:texts.index(b"\0", at)]
        for c in range(1, 256):
            if (child := base ^ c) < len(units) and units[child] & 0x800000FF == c:
                todo.append((child, key + bytes([c])))
    return out


class Codec:
    """The library's processor with an aligned normaliser of its own."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.configure(proto)
        self.numbers = [str(i) for i in range(len(proto.pieces))]
        self.lengths = np.array([1 if p.type == BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN), -1)

    def configure(self, proto) -> None:
        spec = proto.normalizer_spec
        self.map = character_map(spec.precompiled_charsmap)
        self.map |= {p.piece.encode(): p.piece.encode() for p in proto.pieces if p.type == USER_DEFINED}
        self.collapse = spec.remove_extra_whitespaces
        self.space = VISIBLE if spec.escape_whitespaces else b" "
        self.prefix = spec.add_dummy_prefix and not proto.trainer_spec.treat_whitespace_as_suffix
        self.suffix = spec.add_dummy_prefix and proto.trainer_spec.treat_whitespace_as_suffix
        self.longest: dict[int, list[int]] = {}
        for key in self.map:
            self.longest.setdefault(key[0], []).append(len(key))
        self.longest = {c: sorted(set(n), reverse=True) for c, n in self.longest.items()}
        self.heads = re.compile(b"[" + b"".join(re.escape(bytes([c])) for c in self.longest) + b"]") if self.map else None

    def mapped(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """``raw`` with the longest keys replaced, and each byte's source."""
        if not self.map:
            return raw, np.arange(len(raw))
        out, source, done = [], [], 0
        at = 0
        while (hit := self.heads.search(raw, at)):
            at = hit.start()
            for n in self.longest[raw[at]]:
                if (to := self.map.get(raw[at:at + n])) is not None:
                    out += [raw[done:at], to]
                    source += [np.arange(done, at), np.full(len(to), at)]
                    done = at = at + n
                    break
            else:
                at += 1
                while at < len(raw) and raw[at] & 0xC0 == 0x80:  # keys start at characters
                    at += 1
        out.append(raw[done:])
        source.append(np.arange(done, len(raw)))
        return b"".join(out), np.concatenate(source)

    def leading(self, raw: bytes) -> int:
        """How many bytes of the characters and keys at the start stand for single spaces."""
        at = 0
        while at < len(raw):
            n = next((n for n in self.longest.get(raw[at], ()) if raw[at:at + n] in self.map), 1)
            if self.map.get(raw[at:at + n], raw[at:at + n]) != b" ":
                break
            at += n
        return at

    def normalise(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the original byte."""
        start, end = self.leading(raw) if self.collapse else 0, len(raw)
        if start == end:
            return b"", np.array([end])
        text, source = self.mapped(raw[start:])
        x, source = np.frombuffer(text, np.uint8), source + start
        if self.collapse:
            blank = x == 32
            keep = ~(blank & np.concatenate([[True], blank[:-1]])) if len(x) else blank
            x, source = x[keep], source[keep]
        source = np.repeat(source, np.where(x == 32, len(self.space), 1))
        text = x.tobytes().replace(b" ", self.space)
        if self.prefix:
            text, source = self.space + text, np.concatenate([np.full(len(self.space), start), source])
        if self.collapse:
            while text.endswith(self.space):
                text = text[:-len(self.space)]
                end = int(source[len(text)])
            source = source[:len(text)]
        if self.suffix:
            text, source = text + self.space, np.concatenate([source, np.full(len(self.space), end)])
        return text, np.append(source, end)

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids, and each piece's first byte and end in the original UTF-8 text."""
        ids = self.model.encode(text)
        normal, source = self.normalise(text.encode())
        at = np.array(ids, np.int64)
        sizes = self.lengths[at]
        if (at == self.unknown).any():  # an unknown piece is as long as what it covers
            sizes = np.array([len(p.encode()) for p in self.model.encode(text, out_type=str)], np.int64)
        ends = np.cumsum(sizes)
        if (int(ends[-1]) if len(ends) else 0) != len(normal):
            raise ValueError("the pieces do not tile the normalised text")
        return ids, source[ends - sizes], source[ends]

    def ids_text(self, ids: list[int]) -> str:
        numbers = self.numbers
        return ",".join([numbers[i] for i in ids])


def encode_pieces(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids, begins, ends (spans in bytes of the original text)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):  # few rows at once: three arrays a row
                part = batch.slice(i, 256)
                made = [codec.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0)] + [
                    pa.array([m[k] for m in made], pa.list_(pa.int32())) for k in range(3)], ["doc_id", "ids", "begins", "ends"])

    task_memory(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(F.col(text)).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"doc_id {kind}, ids array<int>, begins array<int>, ends array<int>")


def decode_pieces(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with the library's decoding of ``ids`` as column decoded."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(model)
        for batch in batches:
            yield batch.map(lambda x: codec.model.decode([int(i) for i in x]))

    return encoded.withColumn("decoded", decode(F.col(ids)))


def piece_digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode, project and decode like the two above in one pass, and keep digests: doc_id, n_tokens,
    ids_sha256 (decimal ids joined by commas), decoded_sha256, spans_sha256 (begins, then ends, as int64),
    and the ids where ``keep_ids``."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"] + ["ids"] * keep_ids

    def sha(x: bytes) -> str:
        return hashlib.sha256(x).hexdigest()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        types = [pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * keep_ids
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part, made = batch.slice(i, 512), []
                for t in part.column(1).to_pylist():
                    ids, begins, ends = codec.encode(t)
                    made.append((len(ids), sha(codec.ids_text(ids).encode()), sha(codec.model.decode(ids).encode()),
                                 sha(begins.tobytes() + ends.tobytes())) + ((np.array(ids, np.int32),) if keep_ids else ()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0)] + [pa.array(c, t) for c, t in zip(zip(*made), types)], names)

    task_memory(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(F.col(text)).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(digest, f"doc_id {kind}, n_tokens long, " + ", ".join(f"{c} string" for c in names[2:5])
                           + ", ids array<int>" * keep_ids)
