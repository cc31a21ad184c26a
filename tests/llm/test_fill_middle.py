import hashlib
import re

import pytest

from plumbline.llm import fill_middle as fim
from plumbline.llm import queries
from tests.llm.conftest import DATA


def brute(ident, text, unit="lines", rate=100, spm_rate=50):
    """(n, form, prefix_chars, middle_chars, output) from plain string work."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "lines" else list(text)
    digest = hashlib.sha256(f"7:{'' if ident is None else ident}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in fim.MARKERS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    u, v = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(units[:u]), "".join(units[u:v]), "".join(units[v:])
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    return n, form, len(a), len(b), f"<S>{c}<P>{a}<M>{b}" if form == "spm" else f"<P>{a}<S>{c}<M>{b}"


ODD = ["a\nb\nc", "\n", "\n\n\n", "no break", "ends\n", "ü" * 50 + "\n" + "ß" * 7, "x<P>y\nz", "<", "<S\n<P\n<M", "S>\nP>\nM>\n", ">\n" * 40,
       "a<M", "<M>", "\r\n\r\n", "𝔘𝔫𝔦\n" * 9, "", None, "l" * 100 + "\n" + "m" * 100]


@pytest.mark.parametrize("frame_chars", [1, 2, 5, 1 << 14])
@pytest.mark.parametrize("unit", ["lines", "chars"])
def test_frames_of_any_size_equal_plain_strings(spark, frame_chars, unit):
    rows = [(k, t) for k, t in enumerate(ODD * 4)] + [(None, "a\nb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = fim.transform(docs, unit=unit, frame_chars=frame_chars, rate=80)
    wanted = sorted((str(i), *map(str, brute(i, t, unit, 80))) for i, t in rows)
    found = fim.output_text(made).select("id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    assert sorted(tuple(map(str, r)) for r in found) == wanted
    digests = {(r["id"], r["restored_sha256"]) for r in fim.with_digests(made).collect()}
    assert digests == {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_query_equals_plain_strings(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    wanted = {(d, *(b := brute(d, t))[:4], sha(b[4]), sha(t or "")) for d, t in docs}
    found = queries.op13_fill_middle(spark, DATA)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert set(map(tuple, found.collect())) == wanted


def test_only_cut_frames_are_read():
    """Copied frames stay packed: a cut at a frame border packs nothing anew, one inside a frame packs two pieces."""
    packed = []
    pack = fim.zstandard.ZstdCompressor().compress
    pieces = ["abcd", "efgh", "ijkl"]
    blobs = [pack(p.encode()) for p in pieces]
    frames = fim.Frames(b"".join(blobs), [len(b) for b in blobs])
    part = fim.Stretch(frames, [0, 4, 8, 12], [0, 0, 0, 0])

    def spy(raw):
        packed.append(raw)
        return pack(raw)

    assert list(part.packed(0, 8, spy)) == blobs[:2] and not packed and frames.last[0] == -1
    assert b"".join(map(fim.zstandard.decompress, part.packed(2, 10, spy))) == b"cdefghij" and packed == [b"cd", b"ij"]


def test_edge_cases(spark, edge, empty):
    rows = edge.select("doc_id", "text").collect()
    found = fim.with_digests(fim.transform(edge)).collect()
    assert sorted((str(r["id"]), r["form"], r["n"]) for r in found) == sorted((str(i), brute(i, t)[1], brute(i, t)[0]) for i, t in rows)
    assert fim.with_digests(fim.transform(empty)).count() == 0
    with pytest.raises(ValueError, match="unit"):
        fim.transform(edge, unit="words")
