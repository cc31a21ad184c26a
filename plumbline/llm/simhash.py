"""SimHash near-duplicates by exact tiled comparison.

A document's words are runs of bytes other than ASCII white space, lower-cased in ASCII.  Its fingerprint has bit b set
when b is set in over half of the XXH64 codes (seed 42) of its shingles of ``width`` words, repeats included; fewer
words are one shingle, no words give fingerprint zero.  Fingerprints that differ in at most ``radius`` bits are linked.

Copies collapse first: only distinct fingerprints are compared.  They are packed into tiles of one population count.
Two fingerprints within the radius differ by at most the radius in their population counts, so only tiles up to that
far apart meet.  Inside a pair of tiles, sub-tiles of equal counts in the four 16-bit words are compared by exclusive-or
and bit counts, again only where the counts leave a chance.  No pair within the radius is skipped.  A pair of tiles
returns a spanning forest of its links, never all of them, so a group of thousands of copies stays linear; the forests
are joined to components by rounds of star contraction.

The comparison is exact and therefore grows with the square of the number of distinct fingerprints; the two prunings
leave about a tenth of the pairs.  See the README for figures.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated documents fall together;
a document without id takes part in linking, and its component is the smallest id there is, or null if none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.text_blocks import appended, fresh, stored, with_fields

WIDTH = 4
RADIUS = 4
SEED = 42
TILE_ROWS = 1 << 16
CELLS = 1 << 22  # pairs compared at once
SHINGLES = 1 << 14  # codes unpacked to bits at once


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    n = max(1, len(words) - width + 1)
    ends = starts[min(width, len(words)) :]
    code = xxhash.xxh64_intdigest
    codes = np.array([code(joined[a : b - 1], SEED) for a, b in zip(starts[:n], ends, strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, n, SHINGLES):
        bits = np.unpackbits(codes[k : k + SHINGLES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = WIDTH) -> tuple[DataFrame, str]:
    """``docs`` plus the fingerprint as a signed long; the name of that column comes second."""
    name = fresh(docs, "simhash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.fromiter((fingerprint(t, width) for t in batch.column(text).to_pylist()), np.uint64, batch.num_rows)
            yield appended(batch, {name: pa.array(codes.view(np.int64))})

    return docs.mapInArrow(run, with_fields(docs, T.StructField(name, T.LongType()))), name


# --- comparison of tiles -------------------------------------------------------------------------------------


def sub_tiles(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the codes by the counts of their four 16-bit words; starts, ends and counts of the sub-tiles."""
    counts = np.bitwise_count(codes.view(np.uint16).reshape(-1, 4)).astype(np.int16)
    order = np.lexsort(counts.T)
    counts = counts[order]
    starts = np.flatnonzero(np.r_[True, (counts[1:] != counts[:-1]).any(axis=1)]) if len(codes) else np.zeros(0, int)
    return order, starts, np.r_[starts[1:], len(codes)], counts[starts]


def near(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of codes within the radius, in bounded blocks.  ``same``: both are one tile, each pair once."""
    l_order, l_start, l_end, l_counts = sub_tiles(left)
    r_order, r_start, r_end, r_counts = (l_order, l_start, l_end, l_counts) if same else sub_tiles(right)
    ordered, sizes = right[r_order], r_end - r_start
    for k, (a, b) in enumerate(zip(l_start.tolist(), l_end.tolist(), strict=True)):
        close = np.flatnonzero(np.abs(r_counts - l_counts[k]).sum(axis=1) <= radius)
        if same:
            close = close[close >= k]
        if not len(close):
            continue
        n = sizes[close]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(r_start[close], n)
        others = ordered[at]
        step = max(1, CELLS // len(others))
        for r in range(a, b, step):
            rows = l_order[r : min(b, r + step)]
            i, j = np.nonzero(np.bitwise_count(left[rows][:, None] ^ others[None, :]) <= radius)
            if same:
                once = r + i < at[j]
                i, j = i[once], j[once]
            if len(i):
                yield rows[i], r_order[at[j]]


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the classes of linked nodes; ``label`` always points at roots."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label != (up := label[label])).any():
            label = up


def forest(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected inside this pair of tiles: (code, code of the class)."""
    codes = left if same else np.concatenate([left, right])
    label = np.arange(len(codes))
    shift = 0 if same else len(left)
    for i, j in near(left, right, radius, same):
        label = _join(label, i, j + shift)
    linked = np.flatnonzero(label != np.arange(len(codes)))
    return codes[linked], codes[label[linked]]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, other, a, b in zip(*(batch.column(c) for c in ("tile", "other", "codes", "codes2")), strict=True):
                left, right = (np.array(x.values.to_numpy(zero_copy_only=False)).view(np.uint64) for x in (a, b))
                u, v = forest(left, right, radius, tile.as_py() == other.as_py())
                yield pa.record_batch({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    return run


def links(distinct: DataFrame, code: str, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Spanning links (u, v) between distinct codes.  The driver sees 65 counts and nothing else."""
    counted = distinct.select(F.col(code).alias("c"), F.bit_count(code).alias("p"))
    sizes = {r["p"]: r["n"] for r in counted.groupBy("p").agg(F.count("*").alias("n")).collect()}
    parts = [max(1, -(-sizes.get(p, 0) // tile_rows)) for p in range(65)]
    base = [0, *accumulate(parts)]

    def lookup(values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("p") + 1)

    tiles = (
        counted.withColumn("tile", lookup(base[:65]) + F.pmod(F.xxhash64("c"), lookup(parts)))
        .groupBy("tile", "p")
        .agg(F.collect_list("c").alias("codes"))
    )
    tiles = stored(tiles, "simhash-tiles")
    last = [base[min(65, p + radius + 1)] - 1 for p in range(65)]
    asked = tiles.select("tile", "codes", F.explode(F.sequence("tile", lookup(last))).alias("other"))
    met = asked.join(tiles.select(F.col("tile").alias("other"), F.col("codes").alias("codes2")), "other")
    return met.select("tile", "other", "codes", "codes2").mapInArrow(_compare(radius), "u long, v long")


# --- components ----------------------------------------------------------------------------------------------


def roots(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for all nodes of ``edges`` (u, v).

    Alternates two contractions: every node hands its larger neighbours to its smallest one, then its smaller ones.
    The number of links never grows, and each round is a partial aggregate, a join and a stored table.
    """

    def round_of(e: DataFrame, larger: bool) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else e.select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        )
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        met = both.join(low, "u")
        if larger:
            return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        moved = met.select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    def state(e: DataFrame) -> tuple:
        row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    edges = stored(edges.where("u <> v").distinct(), "links")
    before, now = None, state(edges)
    while now != before:
        edges = stored(round_of(round_of(edges, True), False), "links")
        before, now = now, state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def components(coded: DataFrame, ident: str = "doc_id", code: str = "simhash", radius: int = RADIUS,
               tile_rows: int = TILE_ROWS) -> DataFrame:
    """(code, root, component) for each distinct code: the smallest code and the smallest id that can be reached."""
    distinct = stored(coded.groupBy(F.col(code).alias("code")).agg(F.min(ident).alias("least_id")), "simhash-codes")
    found = roots(links(distinct, "code", radius, tile_rows))
    members = found.select(F.col("node").alias("code"), "root").union(found.select("root", "root").distinct())
    members = members.join(distinct, "code")
    lowest = members.groupBy("root").agg(F.min("least_id").alias("component"))
    linked = members.join(lowest, "root").select("code", "root", "component")
    return distinct.join(linked, "code", "left").select(
        "code", F.coalesce("root", "code").alias("root"), F.coalesce("component", "least_id").alias("component")
    )


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = WIDTH,
                    radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per document: id, simhash (signed long), component."""
    coded, name = with_fingerprint(docs.select(ident, text), text, width)
    coded = stored(coded.select(F.col(ident).alias("id"), F.col(name).alias("simhash")), "simhash-docs")
    groups = components(coded, "id", "simhash", radius, tile_rows)
    return coded.join(groups, coded["simhash"] == groups["code"]).select("id", "simhash", "component")


def keep_one(docs: DataFrame, ident: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id, the columns unchanged.

    Documents without id count as larger than any id; among repeated rows with the smallest id one stays.  Rows are
    chosen by numbers alone; texts are moved once, to meet the numbers of the rows that stay.
    """
    columns = docs.columns
    coded, name = with_fingerprint(docs, text)
    row = fresh(coded, "row_number")
    coded = stored(coded.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    slim = coded.select(F.col(row).alias("row"), F.col(ident).alias("id"), F.col(name).alias("code"))
    groups = components(slim, "id", "code", **options).select(F.col("code").alias("group_code"), "root")
    met = slim.join(groups, F.col("code") == F.col("group_code"))
    first = met.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("kept"))
    stays = first.select(F.col("kept.row").alias(fresh(coded, "kept_row")))
    return coded.join(stays, coded[row] == stays[stays.columns[0]], "left_semi").select(*columns)
