"""Document fingerprints by invertible Bloom lookup sketches.

A text is a multiset of paragraph digests. A sketch is a row of cells, each with a count, a sum of
digests and a sum of their checks; a digest goes into three cells. Sketches of two versions subtract
cell by cell, equal paragraphs cancel, and peeling cells that hold one digest recovers the paragraphs
that differ. When peeling gets stuck, both sketches are made again with twice the cells.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.tables import partitions
from fieldglass.llm.texthash import groups_of_texts, mix, run_hashes, seed_number

CELLS = 24  # cells of the fingerprint and of the first attempt
HASHES = 3
PIECE_WORDS = 6  # a paragraph without line or sentence ends is cut after so many words
BLOCKS = 4  # blocks of consecutive ids per partition
_BYTES = 1 << 20
_END = np.zeros(256, bool)
_END[[0x0A, 0x0D, 0x2E, 0x21, 0x3F]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit digests of the paragraphs of each text, and their places.

    A paragraph ends at a line end, at a sentence end before white space, or after PIECE_WORDS words;
    white space around it does not count. Digests of equal paragraphs of one text differ by how often
    they came before, so a text is a set of digests and two texts with equal sets have equal
    paragraphs with equal counts.
    """
    encoded = [t.encode() for t in texts]
    parts, places, total = [], [np.zeros(1, np.int64)], 0
    for lo, hi in groups_of_texts([len(e) for e in encoded], _BYTES):
        if hi - lo == 1:
            raw = np.concatenate([_paragraphs([piece])[0] for piece in _cut(encoded[lo])])
            place = np.array([0, len(raw)])
        else:
            raw, place = _paragraphs(encoded[lo:hi])
        parts.append(_numbered(raw, place))
        places.append(total + place[1:])
        total += int(place[-1])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(places)


def _cut(data: bytes) -> list[bytes]:
    """A very long text in parts of at most _BYTES, cut after a line end or else white space where there is one."""
    out, at = [], 0
    while len(data) - at > _BYTES:
        stop = max(data.rfind(b"\n", at, at + _BYTES), -1) + 1 or data.rfind(b" ", at, at + _BYTES) + 1 or at + _BYTES
        out.append(data[at:stop])
        at = stop
    return [*out, data[at:]]


def _paragraphs(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(pieces) + b"\n", np.uint8)
    space = _SPACE[data]
    before, after = np.ones_like(space), np.ones_like(space)
    before[1:], after[:-1] = space[:-1], space[1:]
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
    firsts = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(p) + 1 for p in pieces])])
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(pieces) + 1, np.int64)
    # Breaks before words: at each text, after a line end, after a word that ends a sentence.
    line = np.concatenate([np.zeros(1, np.int64), np.cumsum((data == 0x0A) | (data == 0x0D))])
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (line[starts[1:]] > line[ends[:-1]]) | _END[data[ends[:-1] - 1]]
    group = np.flatnonzero(fresh)
    index = np.arange(len(starts)) - group[np.cumsum(fresh) - 1]
    first = np.flatnonzero(index % PIECE_WORDS == 0)
    last = np.append(first[1:], len(starts)) - 1
    return run_hashes(data, starts[first], ends[last]), np.searchsorted(starts[first], firsts)


def _numbered(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    rows = np.repeat(np.arange(len(places) - 1), np.diff(places))
    order = np.lexsort((raw, rows))
    r, d = rows[order], raw[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1])
    start = np.flatnonzero(new)
    nth = np.arange(len(d)) - start[np.cumsum(new) - 1] if len(d) else np.zeros(0, np.int64)
    out = np.empty_like(raw)
    out[order] = mix(d + mix(nth.astype(np.uint64) + seed_number(11)))
    return out


class Sketches:
    """Sketches of many texts, `cells` cells each."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.counts = np.zeros(n * cells, np.int64)
        self.sums = np.zeros(n * cells, np.uint64)
        self.checks = np.zeros(n * cells, np.uint64)

    def spots(self, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """A cell in each third of the row's cells."""
        third = self.cells // HASHES
        out = np.empty((HASHES, len(values)), np.int64)
        for h in range(HASHES):
            out[h] = rows * self.cells + h * third + (mix(values + seed_number(21 + h)) % np.uint64(third)).astype(np.int64)
        return out

    def add(self, values: np.ndarray, rows: np.ndarray, sign: np.ndarray | int = 1) -> None:
        signs = np.broadcast_to(np.asarray(sign, np.int64), values.shape)
        signed = signs.astype(np.uint64)
        check = mix(values ^ seed_number(31))
        for spot in self.spots(values, rows):
            np.add.at(self.counts, spot, signs)
            np.add.at(self.sums, spot, values * signed)
            np.add.at(self.checks, spot, check * signed)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.n, self.cells)
        out.counts, out.sums, out.checks = self.counts - other.counts, self.sums - other.sums, self.checks - other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows, digests, signs, whether each row came out empty); consumes the sketches."""
        rows, values, signs = [], [], []
        live = np.flatnonzero(self.counts)
        while len(live):
            count = self.counts[live]
            pure = live[np.abs(count) == 1]
            sign = self.counts[pure]
            value = self.sums[pure] * sign.astype(np.uint64)
            good = self.checks[pure] * sign.astype(np.uint64) == mix(value ^ seed_number(31))
            pure, sign, value = pure[good], sign[good], value[good]
            if not len(pure):
                break
            row = pure // self.cells
            # A digest may be alone in several of its cells.
            order = np.lexsort((value, row))
            row, value, sign = row[order], value[order], sign[order]
            first = np.ones(len(row), bool)
            first[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
            row, value, sign = row[first], value[first], sign[first]
            self.add(value, row, -sign)
            rows.append(row)
            values.append(value)
            signs.append(sign)
            live = np.unique(self.spots(value, row))
        bad = (self.counts != 0) | (self.sums != 0) | (self.checks != 0)
        clean = ~bad.reshape(self.n, self.cells).any(axis=1)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return join(rows, np.int64), join(values, np.uint64), join(signs, np.int64), clean

    def text(self) -> list[str]:
        """Each sketch as base64 of its cells: count, digest sum, check sum."""
        cells = np.zeros((self.n, self.cells), np.dtype([("count", "<i4"), ("sum", "<u8"), ("check", "<u4")]))
        cells["count"] = self.counts.reshape(self.n, -1)
        cells["sum"] = self.sums.reshape(self.n, -1)
        cells["check"] = (self.checks & np.uint64(0xFFFFFFFF)).reshape(self.n, -1)
        return [base64.b64encode(row.tobytes()).decode() for row in cells]


def sketch(values: np.ndarray, places: np.ndarray, cells: int = CELLS) -> Sketches:
    out = Sketches(len(places) - 1, cells)
    out.add(values, np.repeat(np.arange(len(places) - 1), np.diff(places)))
    return out


def differences(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], cells: int = CELLS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each pair of texts, the digests only in the first and only in the second, by peeling, larger on failure."""
    n = len(a[1]) - 1
    only_a: list[np.ndarray] = [np.zeros(0, np.uint64)] * n
    only_b: list[np.ndarray] = [np.zeros(0, np.uint64)] * n
    size = np.full(n, cells)
    todo = np.ones(n, bool)
    while todo.any():
        now = size[todo].min()
        part = np.flatnonzero(todo & (size == now))
        left = sketch(*_rows_of(*a, part), now).minus(sketch(*_rows_of(*b, part), now))
        # Around their mean, cells' counts spread with the number of differences, which tells the next size to try.
        counts = left.counts.reshape(len(part), HASHES, -1)
        guess = ((counts - counts.mean(axis=2, keepdims=True)) ** 2).sum(axis=(1, 2)) / HASHES
        rows, values, signs, clean = left.peel()
        order = np.argsort(rows, kind="stable")
        rows, values, signs = rows[order], values[order], signs[order]
        bounds = np.searchsorted(rows, np.arange(len(part) + 1))
        for i in np.flatnonzero(clean):
            own, sign = values[bounds[i]: bounds[i + 1]], signs[bounds[i]: bounds[i + 1]]
            only_a[part[i]], only_b[part[i]] = own[sign > 0], own[sign < 0]
        todo[part[clean]] = False
        double = np.ceil(np.log2(np.maximum(2, 1.4 * guess / now))).astype(np.int64)
        size[part] = now << np.maximum(double, 1)
    return only_a, only_b


def _rows_of(values: np.ndarray, places: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(places)[rows]
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    index = np.repeat(places[:-1][rows] - at[:-1], sizes) + np.arange(at[-1])
    return values[index], at


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Shared paragraphs by all paragraphs of each pair, from the recovered differences; 1 for two empty texts."""
    only_a, only_b = differences(a, b)
    apart = np.array([len(x) + len(y) for x, y in zip(only_a, only_b, strict=True)], np.float64)
    total = (np.diff(a[1]) + np.diff(b[1])).astype(np.float64)
    return np.divide(total - apart, total + apart, out=np.ones(len(total)), where=total > 0)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the first characters of another."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def compare_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one after it by descending id, of the last one the first; null ids come
    last, and rows with one id follow a hash of their texts. Null text is empty. A document that is
    alone is its own next. Ids may be numbers, text or dates. Rows are cut into consecutive blocks by id
    and hash, so an id in very many rows is many blocks and texts are shuffled once; the first document
    of a block goes to the block before it as well.
    """
    n = partitions(docs.sparkSession)
    text = F.coalesce(F.col(text_column), F.lit(""))
    keys = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("tie"))
    ranged = keys.repartitionByRange(BLOCKS * n, F.col("id").desc_nulls_last(), F.desc("tie"))
    # One row per block: its greatest (id, hash of the text), which is its first document.
    heads = sorted(_key(r["h"]["id"], r["h"]["tie"]) for r in ranged.groupBy(
        F.spark_partition_id().alias("part")).agg(F.max(F.struct("id", "tie")).alias("h")).collect())
    some = next((id_ for known, id_, _ in heads if known), None)

    def place(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for known, ids, ties in batches:  # block 0 holds the greatest ids; odd numbers mark a block's first document
            out = []
            for row in zip(known.tolist(), ids.tolist(), ties.tolist(), strict=True):
                key = _key(row[1] if row[0] else None, row[2])
                at = bisect_left(heads, key)
                out.append(2 * (len(heads) - 1 - at) + (heads[at] == key))
            yield pd.Series(out, dtype=np.int64)

    id_type = docs.schema[id_column].dataType.simpleString()
    filled = F.coalesce(F.col("id"), F.lit(some).cast(id_type)) if some is not None else F.lit(0)
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    own = rows.withColumn("place", F.pandas_udf(place, "bigint")(F.col("id").isNotNull(), filled, F.col("tie"))).select(
        "id", "text", "tie", F.floor(F.col("place") / 2).cast("int").alias("block"), (F.col("place") % 2 == 1).alias("first"))
    before = F.pmod(F.col("block") - 1, F.lit(max(1, len(heads))))
    also = F.when(F.col("first"), F.array(F.struct(before.alias("block"), F.lit(1).alias("copy"))))
    placed = own.select("id", "text", "tie", F.explode(F.concat(
        F.array(F.struct("block", F.lit(0).alias("copy"))), F.coalesce(also, F.array().cast("array<struct<block:int,copy:int>>")))).alias("at"))
    ordered = placed.select("at.*", "id", "text", "tie").repartition(n, "block").sortWithinPartitions(
        "block", "copy", F.col("id").desc_nulls_last(), F.desc("tie")).select("block", "copy", F.col("id").cast("string").alias("id"), "text")
    out = ordered.mapInPandas(_compare, (
        "id string, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"))
    return out.withColumn("id", F.col("id").cast(id_type)).withColumnRenamed("id", id_column)


def _key(id_: object, tie: int) -> tuple:
    """Sorts like (id, tie) in Spark: null first, then values, then not-a-number."""
    if id_ is None:
        return 0, 0, tie
    return (2, 0, tie) if id_ != id_ else (1, id_, tie)


def _followed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str | None, str, str]]:
    """(id, text, next text) from rows in order; a block's last document is followed by a copy of the next block's first."""
    held = None
    for batch in batches:
        for block, copy, name, text in zip(batch["block"], batch["copy"], batch["id"], batch["text"], strict=True):
            if held and held[0] == block:
                yield held[1], held[2], text
            held = None if copy else (block, name, text)


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    chunk, size = [], 0
    for row in _followed(batches):
        chunk.append(row)
        size += len(row[1])
        if size >= _BYTES:
            yield _compared(chunk)
            chunk, size = [], 0
    if chunk:
        yield _compared(chunk)


def _compared(chunk: list[tuple[str | None, str, str]]) -> pd.DataFrame:
    names, texts, following = zip(*chunk, strict=True)
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    # Most texts are the next one of the row before.
    distinct = list(dict.fromkeys([*texts, *following]))
    where = {t: i for i, t in enumerate(distinct)}
    every = digests(distinct)
    own = _rows_of(*every, np.array([where[t] for t in texts]))
    following_digests = _rows_of(*every, np.array([where[t] for t in following]))
    of_edited = digests(changed)
    return pd.DataFrame({
        "id": pd.Series(names, dtype=object), "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        "fingerprint": sketch(*own).text(), "edited_fingerprint": sketch(*of_edited).text(),
        "near_edited": likeness(own, of_edited), "near_next": likeness(own, following_digests)})
