"""Fill-in-middle transformation over seekable compressed frames.

1. A text is stored once as independent zstandard frames of ``FRAME`` bytes (cut between code points) with a seek
   table: where each frame ends, and how many code points and units begin before it. Units are
   ``[A-Za-z]+|[^A-Za-z]``; a run of letters may go on in the next frame, it counts where it begins.
2. A cut after k units lies in the one frame in which unit k begins: only the (at most two) cut frames are
   decompressed to find their places.
3. The transformed text is written as frames too, section by section in its order, one decompressed frame at a time;
   its digest is taken on the way. Rebuilding reads that output alone: one ordered pass finds the
   marks, then prefix, middle and suffix are streamed in the text's order into the second digest.

So a task holds compressed texts and one frame of plain bytes, however long a text is.

Cuts and forms come from the first four 8-digit groups h1 to h4 of sha256("<seed>:<doc_id>"): the prefix ends after
min(h1 % (n+1), h2 % (n+1)) units, the middle after the larger. The form is plain for empty texts, for texts that
hold a mark and where h3 % 100 >= rate; else spm where h4 % 100 < spm_rate, else psm.

Defined results: null texts are empty, thus plain; a null id is hashed as an empty one; rows that repeat give
repeated rows; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from typing import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capforge.llm.common import stored, task_memory, text_or_empty

FRAME = 1 << 16
LEVEL = 1
MARKS = (b"<P>", b"<S>", b"<M>")


def unit_starts(part: np.ndarray, after_letter: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Of UTF-8 bytes: which begin a code point, which begin a unit, and whether the last one is a letter.
    ``after_letter``: a letter precedes them."""
    point = (part & 0xC0) != 0x80
    letter = ((part | 32) - 97).astype(np.uint8) < 26
    before = np.concatenate([[after_letter], letter[:-1]])
    return point, point & ~(letter & before), bool(letter[-1]) if len(letter) else after_letter


class Frames:
    """A byte string as zstandard frames with a seek table; ``write`` appends to it."""

    def __init__(self, size: int = FRAME, packer: zstandard.ZstdCompressor | None = None):
        self.size, self.frames = max(size, 4), []
        self.points, self.units = [0], [0]  # code points and units that begin before each frame, and in all
        self.letter, self.open = False, bytearray()
        self.packer = packer or zstandard.ZstdCompressor(level=LEVEL)

    def write(self, data: bytes) -> None:
        self.open += data
        while len(self.open) > self.size:
            self._close(next((c for c in range(self.size, self.size - 4, -1) if self.open[c] & 0xC0 != 0x80), self.size))

    def _close(self, n: int) -> None:
        part = bytes(self.open[:n])
        del self.open[:n]
        point, unit, self.letter = unit_starts(np.frombuffer(part, np.uint8), self.letter)
        self.frames.append(self.packer.compress(part))
        self.points.append(self.points[-1] + int(point.sum()))
        self.units.append(self.units[-1] + int(unit.sum()))

    def done(self) -> "Frames":
        if self.open:
            self._close(len(self.open))
        return self

    def read(self, i: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.frames[i])

    def place(self, k: int) -> tuple[int, int, int]:
        """(frame, byte in it, code points before) where unit ``k`` begins, or the end."""
        if k >= self.units[-1]:
            return len(self.frames), 0, self.points[-1]
        i = bisect_right(self.units, k) - 1
        part = np.frombuffer(self.read(i), np.uint8)
        goes_on = i > 0 and chr(self.read(i - 1)[-1]).isascii() and chr(self.read(i - 1)[-1]).isalpha()
        point, unit, _ = unit_starts(part, goes_on)
        at = int(np.flatnonzero(unit)[k - self.units[i]])
        return i, at, self.points[i] + int(point[:at].sum())

    def stream(self, begin: tuple[int, int], end: tuple[int, int]) -> Iterator[bytes]:
        """The bytes between two (frame, byte) places, frame by frame."""
        for i in range(begin[0], min(end[0] + 1, len(self.frames))):
            if i == end[0] and not end[1]:
                break
            part = self.read(i)
            yield part[begin[1] if i == begin[0] else 0:end[1] if i == end[0] else None]

    def find(self, marks: list[bytes]) -> list[tuple[int, int]]:
        """The (frame, byte) places of marks in this order, each searched behind the one before, in one pass."""
        out, tail, at, left = [], b"", (0, 0), list(marks)
        for i in range(len(self.frames)):
            text, offset = tail + self.read(i), len(tail)
            start = 0
            while left and (found := text.find(left[0], start)) >= 0:
                out.append(self._locate(i, found - offset))
                start = found + len(left[0])
                left.pop(0)
            if not left:
                return out
            tail = text[max(start, len(text) - len(left[0]) + 1):]
        raise ValueError(f"mark not found: {left[0]!r}")

    def _locate(self, frame: int, byte: int) -> tuple[int, int]:
        while byte < 0:
            frame -= 1
            byte += len(self.read(frame))
        return frame, byte

    def skip(self, at: tuple[int, int], n: int) -> tuple[int, int]:
        """The place ``n`` bytes after ``at``."""
        frame, byte = at[0], at[1] + n
        while frame < len(self.frames) and byte >= (size := len(self.read(frame))):
            frame, byte = frame + 1, byte - size
        return frame, byte


def has_mark(data: bytes) -> bool:
    return any(m in data for m in MARKS)


def transformed(text: Frames, form: str, cut: tuple[tuple, tuple]) -> tuple[Frames, str]:
    """The output's frames and its SHA-256; ``cut``: the places where the prefix and the middle end."""
    start, end = (0, 0), (len(text.frames), 0)
    prefix, middle, suffix = (start, cut[0]), (cut[0], cut[1]), (cut[1], end)
    p, s, m = MARKS
    plan = {"plain": [(b"", (start, end))], "psm": [(p, prefix), (s, suffix), (m, middle)],
            "spm": [(s, suffix), (p, prefix), (m, middle)]}[form]
    out, digest = Frames(text.size, text.packer), hashlib.sha256()
    for mark, part in plan:
        for piece in (mark, *([] if part[0] == part[1] else text.stream(*part))):
            out.write(piece)
            digest.update(piece)
    return out.done(), digest.hexdigest()


def restored(out: Frames, form: str) -> Iterator[bytes]:
    """The original text, rebuilt from the output and its form alone."""
    end = (len(out.frames), 0)
    if form == "plain":
        yield from out.stream((0, 0), end)
        return
    p, s, m = MARKS
    order = [p, s, m] if form == "psm" else [s, p, m]
    places = dict(zip(order, zip(found := out.find(order), [*found[1:], end])))
    for mark in (p, m, s):
        begin, stop = places[mark]
        begin = out.skip(begin, len(mark))
        if begin != stop:
            yield from out.stream(begin, stop)


def write_frames(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = FRAME) -> DataFrame:
    """The stored frame table, a row for each row of ``docs``: doc_id, frames (one after another), ends (bytes), points
    and units (begun before each frame, and in all), marked (holds a mark)."""
    task_memory(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_or_empty(F.col(f"`{text}`")).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "frames", "ends", "points", "units", "marked"]
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                cells: list[list] = [[] for _ in names[1:]]
                for t in part.column(1):
                    data = t.as_buffer().to_pybytes()
                    f = Frames(size, packer)
                    f.write(data)
                    f.done()
                    for c, v in zip(cells, (b"".join(f.frames), np.cumsum([len(x) for x in f.frames], dtype=np.int64), f.points,
                                            f.units, has_mark(data))):
                        c.append(v)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0)] + [pa.array(c, k) for c, k in zip(
                    cells, (pa.binary(), longs, longs, longs, pa.bool_()))], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return stored(rows.mapInArrow(pack, f"doc_id {kind}, frames binary, ends array<long>, points array<long>, units array<long>, "
                                        "marked boolean"), "frames")


def fill_in_middle(frames: DataFrame, seed: int = 1, rate: int = 90, spm_rate: int = 20, size: int = FRAME,
                   keep_output: bool = False) -> DataFrame:
    """Of a frame table: doc_id, n, form, prefix_chars, middle_chars (null if plain), output_sha256,
    restored_sha256, and with ``keep_output`` the output text."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    hs = [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"] + ["output"] * keep_output
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.string()] * keep_output

    def row(packer, blob: bytes, ends: list, points: list, units: list, marked: bool, h1: int, h2: int, h3: int, h4: int) -> tuple:
        text = Frames(size, packer)
        text.frames = [blob[a:b] for a, b in zip([0, *ends], ends)]
        text.points, text.units = points, units
        n = units[-1]
        form = "plain" if not ends or marked or h3 % 100 >= rate else "spm" if h4 % 100 < spm_rate else "psm"
        cut, chars = ((0, 0), (0, 0)), (None, None)
        if form != "plain":
            one, two = (text.place(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
            cut, chars = (one[:2], two[:2]), (one[2], two[2] - one[2])
        out, digest = transformed(text, form, cut)
        again = hashlib.sha256()
        for piece in restored(out, form):
            again.update(piece)
        whole = b"".join(out.read(i) for i in range(len(out.frames))).decode("utf-8", "replace") if keep_output else None
        return (n, form, *chars, digest, again.hexdigest()) + ((whole,) if keep_output else ())

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                columns = [part.column(i).to_pylist() for i in range(1, part.num_columns)]
                made = [row(packer, *cells) for cells in zip(*columns)]
                yield pa.RecordBatch.from_arrays([part.column(0)] + [pa.array([r[i] for r in made], k) for i, k in enumerate(types)], names)

    kind = frames.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, "
              "restored_sha256 string" + ", output string" * keep_output)
    return frames.select("doc_id", "frames", "ends", "points", "units", "marked", *hs).mapInArrow(transform, schema)
