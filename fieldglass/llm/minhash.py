"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is a weighted set of word shingles. Darts fall on each element's region (weight by rank) as
a Poisson process seeded by the element's hash alone, so two documents that share an element share
its darts. Of the darts on each coordinate the one of least rank is kept: coordinates agree with the
weighted Jaccard similarity as chance. The work per document follows the number of coordinates, not
coordinates times elements (Christiani, DartMinHash, 2020).

Equal texts are one class before anything is joined. Classes meet in band buckets; each bucket first
compares its members with one leader, then only members of different components with each other, in
blocks, so a large group of near copies costs no square of its size. Each link is verified on the whole
shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.llm.components import connected_components
from fieldglass.llm.tables import IDENTITY, discard, keep_once, spare_names, with_identity
from fieldglass.llm.texthash import groups_of_texts, mix, seed_number, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 6  # a pair at 0.8 meets in one of 24 bands of 6 with probability 0.9993
_ARRIVALS = 4  # darts drawn together for one region
_UNIT = 2.0**-53
_ROUNDING = 1e-12
BLOCK = 256  # sets on each side of a comparison within a bucket


def shingles(words: np.ndarray, places: np.ndarray, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of `length` words in each text; a shorter text is one shingle, an empty one none."""
    counts = np.diff(places)
    per_text = np.where(counts >= length, counts - length + 1, (counts > 0).astype(np.int64))
    out_places = np.concatenate([np.zeros(1, np.int64), np.cumsum(per_text)])
    padded = np.concatenate([words, np.zeros(length, np.uint64)])
    rows = np.repeat(np.arange(len(counts)), per_text)
    starts = places[:-1][rows] + np.arange(len(rows)) - out_places[:-1][rows]
    have = np.minimum(counts, length)[rows]
    total = np.zeros(len(rows), np.uint64)
    for j in range(length):
        part = padded[starts + j] * (seed_number(101 + j) | np.uint64(1))
        total += np.where(j < have, part, np.uint64(0))
    return mix(total + have.astype(np.uint64)), out_places


def dart_signatures(elements: np.ndarray, weights: np.ndarray, places: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """(texts, k) dart hashes, the earliest dart on each coordinate; zeros for a set without weight.

    A set of total weight W is given darts up to rank (k ln k + 2k) / W, enough to fill all
    coordinates most of the time; where one stays empty the rank is doubled, which changes no dart.
    """
    n = len(places) - 1
    out = np.zeros((n, k), np.uint64)
    rows = np.repeat(np.arange(n), np.diff(places))
    # A weight of 2.5 covers three unit slabs, the last one half: darts beyond it do not count.
    slabs = np.ceil(weights).astype(np.int64)
    element = np.repeat(np.arange(len(elements)), slabs)
    level = np.arange(len(element)) - np.repeat(np.cumsum(slabs) - slabs, slabs)
    cover = np.minimum(1.0, weights[element] - level)
    region = mix(elements[element] ^ mix(level.astype(np.uint64) + seed_number(seed)))
    owner = rows[element]
    total = np.bincount(owner, cover, n)
    limit = np.divide(k * np.log(k) + 2 * k, total, out=np.zeros(n), where=total > 0)
    todo = total > 0
    while todo.any():
        pick = todo[owner]
        best = _earliest(region[pick], cover[pick], owner[pick], limit, n, k)
        filled = best.all(axis=1) & todo
        out[filled] = best[filled]
        todo &= ~filled
        limit = limit * 2
    return out


def _earliest(region: np.ndarray, cover: np.ndarray, owner: np.ndarray, limit: np.ndarray, n: int, k: int) -> np.ndarray:
    rank = np.full(n * k, np.inf)
    dart = np.zeros(n * k, np.uint64)
    reached = np.zeros(len(region))
    step = 0
    while len(region):
        number = np.uint64(step) + np.arange(1, _ARRIVALS + 1, dtype=np.uint64)
        raw = mix(region[:, None] + number[None, :] * np.uint64(0xD1B54A32D192ED03))
        at = reached[:, None] - np.cumsum(np.log(((raw >> np.uint64(11)).astype(np.float64) + 0.5) * _UNIT), axis=1)
        more = mix(raw)
        height = (more >> np.uint64(11)).astype(np.float64) * _UNIT
        keep = (at < limit[owner][:, None]) & (height < cover[:, None])
        spot = (owner[:, None] * k + (mix(more) % np.uint64(k)).astype(np.int64))[keep]
        found, names = at[keep], raw[keep] | np.uint64(1)
        np.minimum.at(rank, spot, found)
        won = rank[spot] == found
        dart[spot[won]] = names[won]
        reached = at[:, -1]
        go = reached < limit[owner]
        region, cover, owner, reached = region[go], cover[go], owner[go], reached[go]
        step += _ARRIVALS
    return dart.reshape(n, k)


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One bucket key per band."""
    factors = np.array([seed_number(301 + j) | np.uint64(1) for j in range(rows)], np.uint64)
    blocks = signatures.reshape(len(signatures), bands, rows) * factors
    return mix(blocks.sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def sequence_keys(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each text's whole word sequence."""
    rows = np.repeat(np.arange(len(places) - 1), np.diff(places))
    index = (np.arange(len(words)) - places[:-1][rows]).astype(np.uint64)
    out = []
    for seed in (401, 402):
        total = np.zeros(len(places) - 1, np.uint64)
        np.add.at(total, rows, mix(words ^ mix(index + seed_number(seed))))
        out.append(mix(total + np.diff(places).astype(np.uint64)).view(np.int64))
    return np.stack(out, axis=1)


def weighted(elements: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each text with their counts."""
    rows = np.repeat(np.arange(len(places) - 1), np.diff(places))
    order = np.lexsort((elements, rows))
    e, r = elements[order], rows[order]
    first = np.ones(len(e), bool)
    first[1:] = (e[1:] != e[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(e)))
    return e[at], counts.astype(np.float64), np.searchsorted(r[at], np.arange(len(places)))


_SKETCH = T.StructType([
    T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def _sketcher(length: int, bands: int, rows: int, by_count: bool):
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            keys, found = [], []
            values = list(texts)
            for lo, hi in groups_of_texts([len(t) for t in values]):
                words, places = word_hashes(values[lo:hi])
                keys.append(sequence_keys(words, places))
                elements, at = shingles(words, places, length)
                if by_count:
                    elements, weights, at = weighted(elements, at)
                else:
                    weights = np.ones(len(elements))  # a repeated shingle throws the same darts again
                signature = dart_signatures(elements, weights, at, bands * rows)
                empty = np.diff(at) == 0
                found += [None if none else row for row, none in zip(band_keys(signature, bands, rows), empty, strict=True)]
            both = np.concatenate(keys) if keys else np.zeros((0, 2), np.int64)
            yield pd.DataFrame({"k1": both[:, 0], "k2": both[:, 1], "bands": pd.Series(found, dtype=object)})
    return sketch


def _shingle_sets(length: int, by_count: bool):
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            values = list(texts)
            names, counts = [], []
            for lo, hi in groups_of_texts([len(t) for t in values]):
                elements, weights, at = weighted(*shingles(*word_hashes(values[lo:hi]), length))
                for i in range(hi - lo):
                    names.append(elements[at[i]: at[i + 1]].tobytes())
                    counts.append(weights[at[i]: at[i + 1]].astype(np.float32).tobytes() if by_count else b"")
            yield pd.DataFrame({"elements": names, "weights": counts}, dtype=object)
    return sets


def jaccard(a: bytes, b: bytes, wa: bytes = b"", wb: bytes = b"") -> float:
    """(Weighted) Jaccard similarity of two sorted sets of 64-bit elements."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) or not len(y):
        return 0.0
    both = np.concatenate([x, y])
    order = np.argsort(both, kind="stable")
    same = np.flatnonzero(both[order][1:] == both[order][:-1])
    if not wa:
        return len(same) / (len(both) - len(same))
    weights = np.concatenate([np.frombuffer(wa, np.float32), np.frombuffer(wb, np.float32)]).astype(np.float64)
    least = np.minimum(weights[order[same]], weights[order[same + 1]]).sum()
    return least / (weights.sum() - least)


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY,
    length: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, by_count: bool = False,
) -> DataFrame:
    """One row per row of `docs`: id, the identity hashes, component_id, kept, `_row`.

    Words are lower-cased runs of anything but ASCII white space; texts shorter than a shingle are
    one shingle. Texts with equal words are copies, empty and null texts among them. Different texts
    link at a Jaccard similarity of their shingle sets (multisets with `by_count`) of at least
    `similarity`. component_id is the smallest id reachable, null if all its ids are null; kept is
    true for one row of each component, one with that id. Repeated rows are copies of each other.
    """
    texts = F.coalesce(F.col(text_column), F.lit(""))
    sketch = F.pandas_udf(_sketcher(length, bands, rows, by_count), _SKETCH)
    sketched = keep_once(
        with_identity(docs.select(id_column, text_column), id_column, text_column)
        .select(F.col(id_column).alias("id"), *IDENTITY, F.monotonically_increasing_id().alias("_row"), sketch(texts).alias("s"))
        .select("id", *IDENTITY, "_row", "s.*"), "sketches")
    classes = keep_once(sketched.groupBy("k1", "k2").agg(
        F.min("id").alias("least_id"), F.coalesce(F.min_by("_row", "id"), F.min("_row")).alias("node")), "classes")
    filed = sketched.join(classes.select(F.col("node").alias("_row")), "_row", "left_semi").select(
        F.col("_row").alias("node"), F.explode("bands").alias("bucket"))
    shared = filed.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("last")).where("least < last")
    members = keep_once(filed.join(shared.select("bucket"), "bucket", "left_semi"), "bucket-members")

    # Shingle sets only of texts that share a bucket.
    wanted = members.select("node").distinct()
    of_text = sketched.select(F.col("_row").alias("node"), *IDENTITY).join(wanted, "node", "left_semi")
    make_sets = F.pandas_udf(_shingle_sets(length, by_count), "elements binary, weights binary")
    named = with_identity(docs.select(id_column, text_column), id_column, text_column)
    repeated = keep_once(_repeated(sketched), "repeated-rows")
    whole = named.join(of_text.join(repeated, IDENTITY, "left_anti"), IDENTITY).select("node", text_column).unionByName(
        named.join(of_text.join(repeated, IDENTITY, "left_semi"), IDENTITY).groupBy("node").agg(F.first(text_column).alias(text_column)))
    sets = keep_once(whole.select("node", make_sets(F.coalesce(F.col(text_column), F.lit(""))).alias("s")).select("node", "s.*"), "shingle-sets")

    # A bucket's leader is the member with most shareable weight: whatever links there, most likely links with it.
    able = keep_once(members.join(_shareable(sets, similarity), "node"), "able-members")
    merit = F.floor(F.col("shareable") / F.col("weight") * 1000) + F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / float(1 << 20)
    heads = able.groupBy("bucket").agg(F.max_by("node", merit).alias("x"), F.max_by("weight", merit).alias("wx"), F.max_by("shareable", merit).alias("sx"))
    stars = able.join(heads, "bucket").where((F.col("node") != F.col("x")) & _may_reach(similarity)).select(F.col("x").alias("a"), F.col("node").alias("b")).distinct()
    links = keep_once(compare(stars, sets).where(F.col("similarity") >= similarity - _ROUNDING).select("a", "b"), "links")
    more = keep_once(_crossing_links(able, connected_components(links), sets, similarity), "more-links")
    components = connected_components(links.unionByName(more))

    labelled = classes.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = labelled.groupBy("component").agg(
        F.min("least_id").alias("component_id"), F.coalesce(F.min_by("node", "least_id"), F.min("node")).alias("winner"))
    resolved = labelled.join(best, "component").select("k1", "k2", "component_id", "winner")
    out = sketched.select("id", *IDENTITY, "_row", "k1", "k2").join(resolved, ["k1", "k2"]).select(
        F.col("id").alias(id_column), *IDENTITY, "_row", "component_id", (F.col("_row") == F.col("winner")).alias("kept"))
    out = keep_once(out, "near-duplicates")
    for table in (sets, members):
        discard(table)
    return out


def _may_reach(similarity: float) -> Column:
    """Whether sets of weights wx and weight, of which sx and shareable can be shared at most, may reach the similarity."""
    return F.least("sx", "shareable") >= similarity / (1 + similarity) * (1 - 1e-9) * (F.col("wx") + F.col("weight"))


def _crossing_links(able: DataFrame, components: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between members of a bucket that are not yet in one component.

    In each bucket the component with most members is left whole; the others' members are compared
    with all members of other components. A bucket of one component, however large, has nothing to
    compare. The comparison runs in blocks of about BLOCK sets a side, so a bucket of any
    size is no single task, and gives one link per set and other component of a block.
    """
    labelled = keep_once(
        able.join(components, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component")), "labelled-members")
    counts = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("bucket").agg(
        F.max_by("component", "n").alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"), F.count("*").alias("components"),
    ).where("components > 1").select("bucket", "main", F.ceil((F.col("all") - F.col("most")) / BLOCK).alias("rows"), F.ceil(F.col("all") / BLOCK).alias("columns"))
    inside = labelled.join(mixed, "bucket")

    def of_block(n: str, role: int) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(role)), F.col(n))

    def every_block(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    rows = inside.where("component <> main").withColumns({"i": of_block("rows", 0), "j": every_block("columns"), "role": F.lit(0)})
    columns = inside.withColumns({"j": of_block("columns", 1), "i": every_block("rows"), "role": F.lit(1)})
    names = ["bucket", "i", "j", "role", "node", "component"]
    dealt = rows.select(*names).unionByName(columns.select(*names)).join(sets, "node")

    key = ["bucket", "i", "j"]
    ordered = dealt.repartition(*key).sortWithinPartitions(*key).select(*key, "role", "node", "component", "elements", "weights")

    def compare_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _runs(batches, 3):
            a, b = _block_links(block, similarity)
            if a:
                yield pd.DataFrame({"a": a, "b": b})

    return ordered.mapInPandas(compare_blocks, "a bigint, b bigint").distinct()


def _runs(batches: Iterator[pd.DataFrame], width: int) -> Iterator[list[tuple]]:
    """Rows with the same first columns, which lie together."""
    held, at = [], None
    for batch in batches:
        for row in batch.itertuples(index=False, name=None):
            if row[:width] != at:
                if held:
                    yield held
                held, at = [], row[:width]
            held.append(row[width:])
    if held:
        yield held


def _block_links(block: list[tuple], similarity: float) -> tuple[list[int], list[int]]:
    """Links from each set asked to one set of each other component that has one, by counting shared elements along posting lists."""
    asks, others = [r for r in block if r[0] == 0], [r for r in block if r[0] == 1]
    nodes, component = np.array([r[1] for r in others]), np.array([r[2] for r in others])
    sets = [_decoded(*r[3:]) for r in others]
    total = np.array([w.sum() for _, w in sets])
    elements, weights = np.concatenate([e for e, _ in sets]), np.concatenate([w for _, w in sets])
    owner = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
    order = np.argsort(elements, kind="stable")
    elements, weights, owner = elements[order], weights[order], owner[order]
    a, b = [], []
    for _, node, own, *packed in asks:
        e, w = _decoded(*packed)
        lo, hi = np.searchsorted(elements, e), np.searchsorted(elements, e, "right")
        size = hi - lo
        at = np.repeat(lo - np.concatenate([np.zeros(1, np.int64), np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        both = np.bincount(owner[at], np.minimum(weights[at], np.repeat(w, size)), len(others))
        good = np.flatnonzero((both >= (similarity - _ROUNDING) * (total + w.sum() - both)) & (component != own))
        if len(good):
            _, first = np.unique(component[good], return_index=True)
            a += [node] * len(first)
            b += nodes[good[first]].tolist()
    return a, b


def _decoded(elements: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    e = np.frombuffer(elements, np.uint64)
    return e, np.frombuffer(weights, np.float32).astype(np.float64) if weights else np.ones(len(e))


def _shareable(sets: DataFrame, similarity: float) -> DataFrame:
    """(node, weight, shareable) of the sets that can reach the similarity with another.

    shareable is the weight without elements that no other set has. A pair shares the lesser of its
    two at most, so a pair or set that this bound rules out has no link.
    """
    def parts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for elements, weights in batches:
            e = [np.frombuffer(x, np.int64) for x in elements]
            w = [np.frombuffer(y, np.float32).astype(np.float64) if y else np.ones(len(x)) for x, y in zip(e, weights, strict=True)]
            yield pd.DataFrame({"e": pd.Series(e, dtype=object), "w": pd.Series(w, dtype=object)})

    split = sets.select("node", F.pandas_udf(parts, "e array<bigint>, w array<double>")("elements", "weights").alias("p"))
    flat = split.select("node", F.explode(F.arrays_zip("p.e", "p.w")).alias("x")).select("node", F.col("x.e").alias("e"), F.col("x.w").alias("w"))
    alone = flat.groupBy("e").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("w").alias("w")).where("n = 1")
    own = alone.groupBy("node").agg(F.sum("w").alias("own"))
    total = split.select("node", F.aggregate("p.w", F.lit(0.0), lambda a, x: a + x).alias("weight"))
    return total.join(own, "node", "left").select("node", "weight", (F.col("weight") - F.coalesce("own", F.lit(0.0))).alias("shareable")).where(
        F.col("shareable") >= similarity * F.col("weight") - 1e-6)


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with their similarity, computed on the whole sets."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("ea"), F.col("weights").alias("wa"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"), F.col("weights").alias("wb"))

    def of_sets(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for ea, eb, wa, wb in batches:
            yield pd.Series([jaccard(*x) for x in zip(ea, eb, wa, wb, strict=True)], dtype=float)

    measure = F.pandas_udf(of_sets, "double")
    return pairs.join(right, "b").join(left, "a").select("a", "b", measure("ea", "eb", "wa", "wb").alias("similarity"))


def _repeated(rows: DataFrame) -> DataFrame:
    """Identities of more than one row."""
    return rows.groupBy(*IDENTITY).agg(F.count("*").alias("n")).where("n > 1").select(*IDENTITY)


def keep_one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of `docs` that are kept, one of each group of near copies; columns unchanged, whatever their names."""
    found = near_duplicates(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), "id", "text", **options)
    names = spare_names(docs, *IDENTITY)
    repeated = keep_once(_repeated(found), "repeated-rows").toDF(*names)
    kept = found.where("kept").select(*IDENTITY).toDF(*names)
    # Equal rows share their identity: those are set apart, and of each kept one an aggregate picks a row.
    gone = keep_once(found.where("not kept").select(*IDENTITY).toDF(*names).unionByName(repeated).distinct(), "rows-set-apart")
    named = with_identity(docs, id_column, text_column, names)
    single = named.join(gone, names, "left_anti")
    again = named.join(repeated.join(kept, names, "left_semi"), names, "left_semi")
    one = again.groupBy(*names).agg(*[F.first(c).alias(c) for c in docs.columns])
    return single.select(*docs.columns).unionByName(one.select(*docs.columns))
