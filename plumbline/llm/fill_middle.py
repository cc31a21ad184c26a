"""Fill-in-middle transformation over seekable compressed frames.

A text is stored once as independent zstandard frames of at most ``FRAME_CHARS`` code points, with the code points and
line breaks before each frame.  A cut is looked up in these counts, so only the frame that holds it is decompressed; the
frames between the cuts go into the output as they are.  Digests stream over the ordered frames, one at a time, and the
text is rebuilt from the output alone, by finding the markers in it.

A document is cut into units: lines (``[^\\n]*\\n|[^\\n]+``) or code points.  h1 to h4 are the first four 8-digit groups
of the hexadecimal sha256 of ``seed:id``; the prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units and the
middle after the larger.  The form is plain for a document without units, with a marker in its text, or with h3 % 100 not
under ``rate``; otherwise suffix-prefix-middle (spm) for h4 % 100 under ``spm_rate`` and prefix-suffix-middle (psm) else.

Defined results: a null text is empty, an empty text is plain; a missing id counts as the empty text in the hash; repeated
rows are transformed one by one and alike; equal cuts give an empty middle; a text or line of any length is cut into frames
of bounded size; extra columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from plumbline.llm.text_blocks import row_slices, stored

FRAME_CHARS = 1 << 14
LEVEL = 3
SEED = 7
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
PLAIN, PSM, SPM = "plain", "psm", "spm"
# Order of the parts in the output, by form.
ORDERS = {PSM: MARKERS, SPM: (SUFFIX, PREFIX, MIDDLE)}


class Frames:
    """Ordered independent frames of one text, read one at a time; the last one read is kept."""

    def __init__(self, blob: bytes, sizes: list[int]):
        self.blob = memoryview(blob)
        self.ends = list(accumulate(sizes, initial=0))
        self.reader = zstandard.ZstdDecompressor()
        self.last: tuple[int, str] = (-1, "")

    def __len__(self) -> int:
        return len(self.ends) - 1

    def packed(self, k: int) -> bytes:
        return bytes(self.blob[self.ends[k] : self.ends[k + 1]])

    def raw(self, k: int) -> bytes:
        return self.reader.decompress(self.packed(k))

    def text(self, k: int) -> str:
        if self.last[0] != k:
            self.last = (k, self.raw(k).decode())
        return self.last[1]

    def pieces(self) -> Iterator[bytes]:
        return map(self.raw, range(len(self)))


class Stretch:
    """Seeks in frames by the code points and line breaks before each of them; the last entries are the totals."""

    def __init__(self, frames: Frames, chars: list[int], breaks: list[int]):
        self.frames, self.chars, self.breaks = frames, chars, breaks

    def units(self, unit: str) -> int:
        if unit == "chars" or not self.chars[-1]:
            return self.chars[-1]
        return self.breaks[-1] + (self.frames.text(len(self.frames) - 1)[-1] != "\n")

    def after(self, count: int, unit: str) -> int:
        """Code points in the first ``count`` units."""
        if unit == "chars" or not count:
            return count
        if count > self.breaks[-1]:  # the last line has no break
            return self.chars[-1]
        k = bisect_left(self.breaks, count) - 1
        at, text = -1, self.frames.text(k)
        for _ in range(count - self.breaks[k]):
            at = text.index("\n", at + 1)
        return self.chars[k] + at + 1

    def packed(self, a: int, b: int, pack: Callable[[bytes], bytes]) -> Iterator[bytes]:
        """Frames of the code points from ``a`` to ``b``; only frames that the borders cut are packed anew."""
        k = max(0, bisect_right(self.chars, a) - 1)
        while a < b:
            stop = min(b, self.chars[k + 1])
            if a == self.chars[k] and stop == self.chars[k + 1]:
                yield self.frames.packed(k)
            else:
                yield pack(self.frames.text(k)[a - self.chars[k] : stop - self.chars[k]].encode())
            a, k = stop, k + 1


def _marked(pieces: Iterator[str], markers: tuple[str, ...]) -> bool:
    """Whether a marker occurs in a text that comes in pieces, also across their borders."""
    keep, tail = max(map(len, markers)) - 1, ""
    for piece in pieces:
        tail += piece
        if any(m in tail for m in markers):
            return True
        tail = tail[-keep:] if keep else ""
    return False


def framed(docs: DataFrame, ident: str = "doc_id", text: str = "text", frame_chars: int = FRAME_CHARS) -> DataFrame:
    """(id, marked, chars, breaks, sizes, blob): the frames of each text, with what is before each and the totals."""
    id_type = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            for rows in row_slices(batch, text):
                marked, chars, breaks, sizes, blobs = [], [], [], [], []
                for t in rows.column(text).to_pylist():
                    pieces = [t[a : a + frame_chars] for a in range(0, len(t), frame_chars)] if t else []
                    frames = [pack(p.encode()) for p in pieces]
                    marked.append(_marked(iter(pieces), MARKERS))
                    chars.append(list(accumulate(map(len, pieces), initial=0)))
                    breaks.append(list(accumulate((p.count("\n") for p in pieces), initial=0)))
                    sizes.append(list(map(len, frames)))
                    blobs.append(b"".join(frames))
                longs = pa.list_(pa.int64())
                yield pa.record_batch({
                    "id": rows.column(ident), "marked": pa.array(marked), "chars": pa.array(chars, longs),
                    "breaks": pa.array(breaks, longs), "sizes": pa.array(sizes, longs), "blob": pa.array(blobs, pa.binary()),
                })

    schema = f"id {id_type}, marked boolean, chars array<long>, breaks array<long>, sizes array<long>, blob binary"
    return docs.select(ident, text).mapInArrow(run, schema)


def draws(seed: int, ident: object) -> list[int]:
    """h1 to h4 of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).digest()
    return [int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4)]


def transform(docs: DataFrame, ident: str = "doc_id", text: str = "text", unit: str = "lines", seed: int = SEED,
              rate: int = 100, spm_rate: int = 50, frame_chars: int = FRAME_CHARS) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, sizes, blob): each output as frames, see ``output_text``.

    The frames of the texts are stored first, so a lost executor costs neither texts nor earlier work.
    """
    if unit not in ("lines", "chars"):
        raise ValueError(f"unit must be lines or chars, not {unit!r}")
    store = stored(framed(docs, ident, text, frame_chars), "fill-middle")
    id_type = store.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        marks = {m: pack(m.encode()) for m in MARKERS}
        for batch in batches:
            for rows in row_slices(batch, "blob"):
                columns: dict[str, list] = {c: [] for c in ("n", "form", "prefix_chars", "middle_chars", "sizes", "blob")}
                for r in rows.to_pylist():
                    part = Stretch(Frames(r["blob"], r["sizes"]), r["chars"], r["breaks"])
                    n, (h1, h2, h3, h4) = part.units(unit), draws(seed, r["id"])
                    found = {"n": n, "form": PLAIN, "prefix_chars": None, "middle_chars": None, "sizes": r["sizes"], "blob": r["blob"]}
                    if n and not r["marked"] and h3 % 100 < rate:
                        a, b = (part.after(u, unit) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
                        spans = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, r["chars"][-1])}
                        form = SPM if h4 % 100 < spm_rate else PSM
                        out = list(chain.from_iterable([marks[m], *part.packed(*spans[m], pack)] for m in ORDERS[form]))
                        found = {"n": n, "form": form, "prefix_chars": a, "middle_chars": b - a,
                                 "sizes": list(map(len, out)), "blob": b"".join(out)}
                    for c, v in found.items():
                        columns[c].append(v)
                types = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(),
                         "sizes": pa.list_(pa.int64()), "blob": pa.binary()}
                yield pa.record_batch({"id": rows.column("id")} | {c: pa.array(v, types[c]) for c, v in columns.items()})

    schema = f"id {id_type}, n long, form string, prefix_chars long, middle_chars long, sizes array<long>, blob binary"
    return store.mapInArrow(run, schema)


def _parts(frames: Frames, form: str) -> list[tuple[int, int]]:
    """Byte ranges of the parts of an output, in its order, found by reading it for the markers."""
    wanted = [m.encode() for m in ORDERS[form]]
    places, before, tail = [], 0, b""
    for piece in frames.pieces():
        tail += piece
        while len(places) < len(wanted) and (at := tail.find(wanted[len(places)])) >= 0:
            stop = at + len(wanted[len(places)])
            places.append((before + at, before + stop))
            before, tail = before + stop, tail[stop:]
        drop = max(0, len(tail) - 2)  # a marker may go on in the next frame
        before, tail = before + drop, tail[drop:]
    end = before + len(tail)
    return list(zip([stop for _, stop in places], [*(at for at, _ in places[1:]), end], strict=True))


def _bytes(frames: Frames, a: int, b: int) -> Iterator[bytes]:
    """The bytes from ``a`` to ``b``, frame by frame; frame headers tell the sizes, so other frames stay packed."""
    at = 0
    for k in range(len(frames)):
        size = zstandard.frame_content_size(frames.packed(k))
        if at < b and at + size > a:
            yield frames.raw(k)[max(0, a - at) : b - at]
        at += size


def restored(frames: Frames, form: str) -> Iterator[bytes]:
    """The bytes of the text, from its output and form."""
    if form == PLAIN:
        return frames.pieces()
    parts = dict(zip(ORDERS[form], _parts(frames, form), strict=True))
    return chain.from_iterable(_bytes(frames, *parts[m]) for m in (PREFIX, MIDDLE, SUFFIX))


def _digest(pieces: Iterator[bytes]) -> str:
    h = hashlib.sha256()
    for piece in pieces:
        h.update(piece)
    return h.hexdigest()


def _mapped(outputs: DataFrame, added: dict[str, Callable[[Frames, str], str]]) -> DataFrame:
    """``outputs`` with strings made from the frames and the form, in place of the frames."""
    keep = [c for c in outputs.columns if c not in ("sizes", "blob")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, "blob"):
                triples = zip(*(rows.column(c).to_pylist() for c in ("blob", "sizes", "form")), strict=True)
                read = [(Frames(blob, sizes), form) for blob, sizes, form in triples]
                made = {c: pa.array([make(f, form) for f, form in read], pa.string()) for c, make in added.items()}
                yield pa.record_batch({c: rows.column(c) for c in keep} | made)

    fields = [f"`{c}` {outputs.schema[c].dataType.simpleString()}" for c in keep]
    return outputs.mapInArrow(run, ", ".join([*fields, *(f"{c} string" for c in added)]))


def with_digests(outputs: DataFrame) -> DataFrame:
    """sha256 of each output and of the text rebuilt from it, in place of the frames."""
    return _mapped(outputs, {
        "output_sha256": lambda frames, _: _digest(frames.pieces()),
        "restored_sha256": lambda frames, form: _digest(restored(frames, form)),
    })


def output_text(outputs: DataFrame) -> DataFrame:
    """The outputs as plain text (``output``), in place of the frames."""
    return _mapped(outputs, {"output": lambda frames, _: b"".join(frames.pieces()).decode()})
