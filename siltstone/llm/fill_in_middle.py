"""Fill-in-middle transformation over seekable compressed frames.

A document is stored as one row of independent zstandard frames of about FRAME_BYTES of text, each with the number of
units (lines, `[^\\n]*\\n|[^\\n]+`) and of code points that end before it. A cut after k units is found by bisecting the
counts and decompressing the one frame that holds it; nothing else is read for it. Output and restored text are ordered
streams over the frames: whoever consumes them (a digest, a file, a string) holds one frame at a time.

A frame closes at a line end where it can. A line longer than a frame goes on over several, cut between code points, so
no frame is larger than FRAME_BYTES and a few bytes. The stored rows are written to the shared folder and read again by
the transformation: a lost executor costs the rows of its tasks, and both passes are without a shuffle.

Nulls: a null text is empty; a null doc_id is drawn as the empty text. Empty texts and texts that hold a marker stay
plain. Repeated rows of one id are cut alike if their texts are alike. Ties do not arise. A very long text is one row of
many frames. An empty table gives an empty store. Other columns are not read; those of the results are only its own.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common

FRAME_BYTES = 1 << 16
LEVEL = 3
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED, RATE, SPM = 7, 100, 50

STORE = "doc_id bigint, n bigint, marked boolean, units array<bigint>, chars array<bigint>, frames array<binary>"
_STORE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("marked", pa.bool_()), ("units", pa.list_(pa.int64())), ("chars", pa.list_(pa.int64())), ("frames", pa.list_(pa.binary()))])


def code_points(text: bytes) -> int:
    """Code points of UTF-8: the bytes that do not continue one."""
    return len(text) if text.isascii() else int(np.count_nonzero(np.frombuffer(text, np.int8) >= -64))


def cut_frames(text: bytes, most: int) -> Iterator[bytes]:
    """The text in pieces of at most `most` bytes and a code point, ending at a line end where there is one."""
    at = 0
    while at < len(text):
        end = at + most
        if end < len(text):
            line = text.rfind(b"\n", at, end)
            if line >= 0:
                end = line + 1
            else:
                while end < len(text) and text[end] & 0xC0 == 0x80:
                    end += 1
        yield text[at:end]
        at = end


@dataclass
class Stored:
    """One document: `units` and `chars` that have ended with each frame, and the frames."""

    units: list[int]
    chars: list[int]
    frames: list[bytes]

    def frame(self, i: int) -> bytes:
        return _unpack.decompress(self.frames[i])

    def place(self, k: int) -> tuple[int, int]:
        """Frame and byte within it after k units; only that frame is decompressed."""
        if k == 0:
            return 0, 0
        if k == self.units[-1]:
            return len(self.frames), 0
        i = bisect_left(self.units, k)
        text, at = self.frame(i), -1
        for _ in range(k - (self.units[i - 1] if i else 0)):
            at = text.index(b"\n", at + 1)
        return i, at + 1

    def chars_before(self, place: tuple[int, int]) -> int:
        i, at = place
        return (self.chars[i - 1] if i else 0) + (code_points(self.frame(i)[:at]) if at else 0)

    def between(self, start: tuple[int, int], end: tuple[int, int]) -> Iterator[bytes]:
        """The text from one place to another, a frame at a time."""
        for i in range(start[0], min(end[0] + 1, len(self.frames))):
            if i == end[0] and not end[1]:
                break
            text = self.frame(i)
            yield text[start[1] if i == start[0] else 0 : end[1] if i == end[0] else None]


_unpack = zstandard.ZstdDecompressor()


def stored(text: bytes, most: int = FRAME_BYTES, pack: Callable[[bytes], bytes] | None = None) -> Stored:
    pack = pack or zstandard.ZstdCompressor(level=LEVEL).compress
    units, chars, frames, lines, points = [], [], [], 0, 0
    for piece in cut_frames(text, most):
        lines += piece.count(b"\n")
        points += code_points(piece)
        units.append(lines)
        chars.append(points)
        frames.append(pack(piece))
    if text and not text.endswith(b"\n"):
        units[-1] += 1  # the last line ends with the text
    return Stored(units, chars, frames)


@dataclass
class Cut:
    """What is drawn for a document: its form, and the places after the prefix and after the middle."""

    form: str
    first: tuple[int, int] = (0, 0)
    second: tuple[int, int] = (0, 0)


def drawn(doc_id: int | None, doc: Stored, marked: bool, seed: int, rate: int, spm: int) -> Cut:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not doc.frames or marked or h3 % 100 >= rate:
        return Cut("plain")
    n = doc.units[-1]
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    return Cut("spm" if h4 % 100 < spm else "psm", doc.place(first), doc.place(second))


def output(doc: Stored, cut: Cut) -> Iterator[bytes]:
    """The transformed text, a frame at a time."""
    start, end = (0, 0), (len(doc.frames), 0)
    if cut.form == "plain":
        yield from doc.between(start, end)
        return
    parts = {PREFIX: (start, cut.first), MIDDLE: (cut.first, cut.second), SUFFIX: (cut.second, end)}
    for marker in (PREFIX, SUFFIX, MIDDLE) if cut.form == "psm" else (SUFFIX, PREFIX, MIDDLE):
        yield marker
        yield from doc.between(*parts[marker])


def restored(chunks: Callable[[], Iterator[bytes]], form: str) -> Iterator[bytes]:
    """The text, rebuilt from an output that can be streamed again and its form alone.

    A text that is cut holds no marker, and no marker overlaps itself or another, so the first of each is the one that was
    put there. One pass finds them, one pass a part streams it."""
    if form == "plain":
        yield from chunks()
        return
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    found: list[int] = []
    tail, before = b"", 0
    for chunk in chunks():
        window = tail + chunk
        while len(found) < 3 and (at := window.find(order[len(found)], max(0, found[-1] + 3 - before) if found else 0)) >= 0:
            found.append(before + at)
        tail = window[-2:]
        before += len(window) - len(tail)
    if len(found) < 3:
        raise ValueError(f"not an output of form {form}")
    span = {m: (found[k] + 3, found[k + 1] if k < 2 else None) for k, m in enumerate(order)}
    for marker in (PREFIX, MIDDLE, SUFFIX):
        (start, end), at = span[marker], 0
        for chunk in chunks():
            piece = chunk[max(start - at, 0) : None if end is None else max(end - at, 0)]
            if piece:
                yield piece
            at += len(chunk)
            if end is not None and at >= end:
                break


def digest(chunks: Iterator[bytes]) -> str:
    sha = hashlib.sha256()
    for chunk in chunks:
        sha.update(chunk)
    return sha.hexdigest()


def store(docs: DataFrame, path: str, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write the documents as rows of frames and read them back: doc_id, n, marked (whether a marker occurs in the text),
    units, chars, frames."""
    spark = common.prepare(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                    text = value.as_py() or b""
                    doc = stored(text, frame_bytes, compress)
                    yield doc_id, doc.units[-1] if doc.units else 0, any(m in text for m in (PREFIX, SUFFIX, MIDDLE)), doc.units, doc.chars, doc.frames

        yield from common.emit(_STORE, rows(), lambda row: sum(map(len, row[5])))

    # The frames are compressed already.
    docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pack, STORE).write.option("compression", "none").parquet(path)
    return spark.read.schema(STORE).parquet(path)


RESULT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])


def transform(frames: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, with_output: bool = False) -> DataFrame:
    """From store()'s rows: doc_id, n, form, prefix_chars, middle_chars, digests of the output and of the text rebuilt from
    it; with_output adds the output itself. `rate` of 100 documents are cut, `spm` of 100 of them in suffix-first form."""
    common.prepare(frames.sparkSession)
    schema, kinds = (_RESULT.append(pa.field("output", pa.string())), f"{RESULT}, output string") if with_output else (_RESULT, RESULT)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                columns = [batch.column(c) for c in ("doc_id", "n", "marked", "units", "chars", "frames")]
                for i in range(batch.num_rows):
                    doc_id, n, marked, units, chars, packed = (c[i].as_py() for c in columns)
                    doc = Stored(units, chars, packed)
                    how = drawn(doc_id, doc, marked, seed, rate, spm)
                    head = doc.chars_before(how.first) if how.form != "plain" else None
                    middle = doc.chars_before(how.second) - head if head is not None else None
                    again = lambda d=doc, h=how: output(d, h)
                    row = doc_id, n, how.form, head, middle, digest(again()), digest(restored(again, how.form))
                    yield (*row, b"".join(again()).decode()) if with_output else row

        yield from common.emit(schema, rows(), lambda row: len(row[7]) if with_output else 0)

    return frames.mapInArrow(cut, kinds)


def restore(transformed: DataFrame) -> DataFrame:
    """doc_id and text, rebuilt from `output` and `form` alone, by expressions."""
    after = lambda marker: F.substring_index("output", marker, -1)
    between = lambda marker, end: F.substring_index(after(marker), end, 1)
    psm = F.concat(between("<P>", "<S>"), after("<M>"), between("<S>", "<M>"))
    spm = F.concat(between("<P>", "<M>"), after("<M>"), between("<S>", "<P>"))
    return transformed.select("doc_id", F.when(F.col("form") == "plain", F.col("output")).when(F.col("form") == "psm", psm).otherwise(spm).alias("text"))


def op13_frame_middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform(store(common.table(spark, sf_dir, "documents"), common.fresh_path(spark, "frames")))


OP13_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM docs
), cut AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s
  FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256 FROM cut
"""
