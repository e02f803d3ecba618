"""Large quotas, ids of any type, hot ids and bins of any fill."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldglass.llm import fingerprints, mixing, packing


@pytest.mark.parametrize(("n", "k", "m"), [(10, 4, 5), (60, 1, 30), (60, 59, 30), (400, 100, 200), (7, 7, 3), (9, 0, 4), (9, 5, 0), (50, 30, 45)])
def test_draws_follow_the_hypergeometric_law(spark, n, k, m):
    tries = 20_000
    df = spark.range(tries).select(mixing.hypergeometric(
        F.lit(n).cast("long"), F.lit(k).cast("long"), F.lit(m).cast("long"), (F.col("id") + 0.5) / tries).alias("x"))
    seen = {r["x"]: r["count"] for r in df.groupBy("x").count().collect()}
    for x in range(m + 1):
        chance = math.comb(k, x) * math.comb(n - k, m - x) / math.comb(n, m) if m - x <= n - k else 0
        assert abs(seen.get(x, 0) - tries * chance) <= 2, x
    assert sum(seen.values()) == tries and min(seen) >= 0


def test_quotas_of_a_billion_are_split(spark):
    quotas = [1_000_000_000, 0, 300_000_000, 100_000_000, 7]
    runs = mixing.split_quotas(spark.createDataFrame([(quotas,)], "quotas array<bigint>"), 2).toPandas()
    runs["n"] = runs["last"] - runs["first"] + 1
    assert runs.groupby("position")["n"].sum().to_dict() == {i: q for i, q in enumerate(quotas) if q}
    per_shard = runs.groupby("shard")["n"].sum()
    assert per_shard.max() - per_shard.min() <= 2
    big = runs[runs["position"] == 0]["n"].to_numpy()
    expected = quotas[0] / 4
    deviation = math.sqrt(sum(quotas) / 4 * (quotas[0] / sum(quotas)) * (1 - quotas[0] / sum(quotas)) * 0.75)
    assert (abs(big - expected) < 6 * deviation).all() and big.std() > deviation / 50


def test_blocks_of_one_source_are_summed_in_runs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(n)), "one" if i % 3 else None) for i, n in enumerate(rng.integers(0, 60, 400))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    plans = []
    for run in (1, 4096):
        monkeypatch.setattr(mixing, "RUN", run)
        plans.append(mixing.allocate(df, block_words=100).toPandas().sort_values("id").reset_index(drop=True))
    a, b = plans
    assert a["copies"].tolist() == b["copies"].tolist() and a["shards"].map(list).tolist() == b["shards"].map(list).tolist()
    assert (a["shards"].map(len) == a["copies"]).all()


IDS = {
    "string": ["b", "a", "é", "zz", None, "10", "9", "", "a"],
    "bigint": [2**60 + 1, 2**60, -5, None, None, 7, 7, 0, 3],
    "double": [1.5, float("nan"), None, -2.0, float("inf"), 0.0, 9.0, 9.0, 4.0],
    "date": [*pd.date_range("2024-01-01", periods=8).date, None],
}


@pytest.mark.parametrize("kind", IDS)
def test_next_documents_for_ids_of_any_type(spark, kind):
    texts = [f"text {i} of all. And more {i * 7}." for i in range(9)]
    df = spark.createDataFrame(list(zip(IDS[kind], texts, strict=True)), f"doc_id {kind}, text string")
    order = [r["text"] for r in df.orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc()).collect()]
    expected = sorted(
        hashlib.sha256(fingerprints.edited(t, f).encode()).hexdigest() for t, f in zip(order, order[1:] + order[:1], strict=True))
    out = fingerprints.compare_edits(df)
    assert out.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    assert sorted(r["edited_sha256"] for r in out.collect()) == expected


def test_one_id_in_most_rows_is_many_blocks(spark):
    rows = [(7 if i % 4 else i, f"text {i} of all. And more {i * 7}.") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    order = [r["text"] for r in df.orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc()).collect()]
    expected = sorted(
        hashlib.sha256(fingerprints.edited(t, f).encode()).hexdigest() for t, f in zip(order, order[1:] + order[:1], strict=True))
    assert sorted(r["edited_sha256"] for r in fingerprints.compare_edits(df).collect()) == expected


def test_emptier_bins_take_pieces_too():
    """Ninety fuller bins have room for nothing; only the emptiest taker can give its place."""
    sizes = [*[95] * 90, 60, 30, 40]
    bins, loads = [[i] for i in range(91)] + [[91, 92]], [*[95] * 90, 60, 70]
    packing.local_search(bins, loads, sizes, list(range(92)), 100, 1)
    assert sorted(i for b in bins for i in b) == list(range(93)) and loads == [sum(sizes[i] for i in b) for b in bins]
    assert sorted(loads[90:]) == [30, 100]
    rng = np.random.default_rng(2)
    for _ in range(10):
        sizes = np.sort(rng.integers(20, 70, 300))[::-1]
        found = packing.pack_bins(sizes, 100)
        assert sorted(i for b in found for i in b) == list(range(300)) and all(sizes[b].sum() <= 100 for b in found)


def test_rounds_go_on_while_they_save(spark):
    """Pieces that never combine settle after one round; others come together over groups."""
    lone = spark.createDataFrame([(i, 3000) for i in range(120)], "id int, length bigint")
    assert packing.pack(lone, group=20).select("sequence_id").distinct().count() == 120
    rng = np.random.default_rng(6)
    lengths = rng.integers(1, 4000, 500).tolist()
    packed = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "id int, length bigint"), group=25).toPandas()
    assert (packed.groupby("sequence_id")["length"].sum() <= 4096).all() and len(packed) == 500
    found = packed["sequence_id"].nunique()
    # One round only: the groups as dealt at level 0, each packed alone.
    first = packing.keep_once(packed_input(spark, lengths), "t")
    alone = first.withColumn("group", F.pmod(F.xxhash64("_piece", F.lit(0)), F.lit(20))).toPandas()
    one_round = sum(len(packing.pack_bins(np.sort(g["length"])[::-1], 4096)) for _, g in alone.groupby("group"))
    together = len(packing.pack_bins(np.sort(lengths)[::-1], 4096))
    assert together <= found < one_round and found <= 1.06 * together


def packed_input(spark, lengths):
    """Pieces numbered as `pack` numbers them."""
    return spark.createDataFrame(list(enumerate(lengths)), "id int, length bigint").withColumn("_piece", F.monotonically_increasing_id())
