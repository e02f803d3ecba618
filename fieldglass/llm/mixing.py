"""Mixing sources to target weights, with Spark expressions only.

Targets come from water filling over the sources. A source's documents fall into hashed blocks; the
mix takes whole passes over a source and then blocks in hashed order up to its target, the block at
the edge by document. Which output shard gets how many block draws of each source is decided by a
splitting tree: each node parts its quotas between two children by drawing without replacement, so a
child's quotas follow the multivariate hypergeometric law and add up exactly. Shards then take
disjoint runs of the source's permuted draws and order their documents by a hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm.tables import code_point_order, keep_once, spare_names

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 20_000  # target words of a block
RUN = 4_096  # blocks whose sizes are summed in one go
DEPTH = 4  # the tree has 2^DEPTH leaves, one per output shard
WORD = r"[^\x20\x09-\x0D]+"


def hashed_number(*parts: Column | str) -> Column:
    """A whole number below 2^48 from the MD5 of the parts; any engine with MD5 gives the same."""
    text = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """One row per source: source_size, weight, target.

    Sources in code point order, null last, weigh `weights` in turn. Targets share the sum of all
    sizes by weight; one that passes `most_repeats` times its source is cut there and the excess is
    shared again by weight, until none is above. That is a water level: cut the sources with the
    least ratio of cap to weight first, and divide what is left among the others. The windows run
    over one row per source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(code_point_order("source"))) - 1
    ranked = sources.withColumn("weight", F.array(*map(F.lit, weights))[turn % len(weights)].cast("double"))
    capped = ranked.withColumn("cap", F.col("source_size") * most_repeats).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", code_point_order("source"))
    sums = capped.withColumns({
        "total": F.sum("source_size").over(Window.partitionBy()),
        "all_weights": F.sum("weight").over(Window.partitionBy()),
        "caps_before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "weights_before": F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
    })
    # The level if this source and those after it are not cut; the first such source that stays under its cap fixes it.
    level = (F.col("total") - F.col("caps_before")) / (F.col("all_weights") - F.col("weights_before"))
    levels = sums.withColumn("level", F.when(level <= F.col("ratio"), level))
    return levels.withColumn("level", F.max("level").over(Window.partitionBy())).select(
        "source", "source_size", "weight",
        F.when(F.col("level").isNull() | (F.col("level") >= F.col("ratio")), F.col("cap").cast("double"))
        .otherwise(F.col("level") * F.col("weight")).alias("target"))


def split_quotas(quotas: DataFrame, depth: int = DEPTH, seed: int = 11) -> DataFrame:
    """(position, shard, first, last): the draws of each source that each leaf gets; `quotas` has one row with an array.

    Every level doubles the nodes. At a node half of the draws go left: source by source, the number
    that goes left is drawn from the hypergeometric law of the draws and places still open.
    """
    nodes = quotas.select(F.lit(0).cast("long").alias("shard"), "quotas")
    for level in range(depth):
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x)
        nodes = nodes.withColumn("total", total).withColumn(
            "left", _left_share(F.col("quotas"), F.col("total"), F.lit(seed * 64 + level), F.col("shard")))
        right = F.zip_with("quotas", "left", lambda q, x: q - x)
        nodes = nodes.select(F.explode(F.array(
            F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("quotas")),
            F.struct((F.col("shard") * 2 + 1).alias("shard"), right.alias("quotas")),
        )).alias("n")).select("n.shard", "n.quotas")
    counts = nodes.select("shard", F.posexplode("quotas").alias("position", "draws"))
    run = Window.partitionBy("position").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("last", F.sum("draws").over(run)).where("draws > 0").select(
        "position", "shard", (F.col("last") - F.col("draws")).alias("first"), (F.col("last") - 1).alias("last"))


def _left_share(quotas: Column, total: Column, seed: Column, shard: Column) -> Column:
    """How many of each source's draws go left, source by source: the rest of the node is what the next one draws from."""
    start = F.struct(
        total.alias("open"), F.floor((total + shard % 2) / 2).alias("places"), F.array().cast("array<bigint>").alias("left"))

    def of_source(state: Column, quota: Column) -> Column:
        chance = F.shiftrightunsigned(F.xxhash64(seed, shard, F.size(state["left"])), 11) / F.lit(2.0**53)
        drawn = hypergeometric(state["open"], quota, state["places"], chance)
        return _once(drawn, lambda d: F.struct(
            (state["open"] - quota).alias("open"), (state["places"] - d).alias("places"),
            F.concat(state["left"], F.array(d)).alias("left")))

    return F.aggregate(quotas, start, of_source, lambda s: s["left"])


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(everything: Column, marked: Column, taken: Column, chance: Column) -> Column:
    """How many of `taken` places, out of `everything`, hold one of the `marked`, at a uniform `chance` from 0 to 1.

    Inversion from the mode outwards: neighbouring probabilities have a simple ratio, so weights are
    relative to the mode's and are summed first. Steps go twelve standard deviations to both sides,
    where weights end below the resolution of a double; time and memory grow with the square root of
    the places, not with them.
    """
    n, k, m = (c.cast("double") for c in (everything, marked, taken))
    least, most = F.greatest(F.lit(0.0), m + k - n), F.least(m, k)
    spread = F.sqrt(F.greatest(F.lit(0.0), m * (k / n) * (1 - k / n) * (n - m) / F.greatest(n - 1, F.lit(1.0))))
    mode = F.least(most, F.greatest(least, F.floor((m + 1) * ((k + 1) / (n + 2))).cast("double")))
    reach = F.least(most - least, F.ceil(12 * spread) + 30).cast("long")

    def draw(fixed: Column) -> Column:
        n, k, m, mode, chance = (fixed[c] for c in ("n", "k", "m", "mode", "chance"))
        steps = F.sequence(F.lit(1).cast("long"), fixed["reach"])

        def up(weight: Column, at: Column) -> Column:  # weight of at + 1, from that of at
            return weight * ((k - at) / (at + 1)) * ((m - at) / (n - k - m + at + 1))

        def down(weight: Column, at: Column) -> Column:
            return weight * (at / (k - at + 1)) * ((n - k - m + at) / (m - at + 1))

        def ahead(s: Column, j: Column) -> tuple[Column, Column]:
            return up(s["up"], mode + j - 1), down(s["down"], mode - j + 1)

        def add(s: Column, j: Column) -> Column:
            higher, lower = ahead(s, j)
            return _once(F.struct(higher.alias("up"), lower.alias("down")), lambda w: F.struct(
                (s["sum"] + w["up"] + w["down"]).alias("sum"), w["up"].alias("up"), w["down"].alias("down")))

        one = F.lit(1.0)
        total = F.aggregate(steps, F.struct(one.alias("sum"), one.alias("up"), one.alias("down")), add, lambda s: s["sum"])

        def walk(wanted: Column) -> Column:
            def pick(s: Column, j: Column) -> Column:
                higher, lower = ahead(s, j)
                return _once(F.struct(higher.alias("up"), lower.alias("down")), lambda w: F.struct(
                    F.coalesce(s["at"], F.when(wanted < s["sum"] + w["up"], mode + j).when(
                        wanted < s["sum"] + w["up"] + w["down"], mode - j)).alias("at"),
                    (s["sum"] + w["up"] + w["down"]).alias("sum"), w["up"].alias("up"), w["down"].alias("down")))

            begin = F.struct(F.when(wanted < 1, mode).alias("at"), one.alias("sum"), one.alias("up"), one.alias("down"))
            return F.coalesce(F.aggregate(steps, begin, pick, lambda s: s["at"]), mode)

        return F.when(fixed["reach"] < 1, mode).otherwise(_once(chance * total, walk)).cast("long")

    parts = F.struct(*[c.alias(name) for c, name in (
        (n, "n"), (k, "k"), (m, "m"), (mode, "mode"), (reach, "reach"), (chance, "chance"))])
    return F.when(everything > 0, _once(parts, draw)).otherwise(F.lit(0).cast("long"))


def allocate(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    weights: tuple = WEIGHTS, most_repeats: int = MOST_REPEATS, block_words: int = BLOCK_WORDS, depth: int = DEPTH,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, shards (one output shard per copy).

    Size is the number of words, 0 for null or empty text. Rows with the same id and source share a
    block; a row of size 0 is taken with its block. Null sources are one source, the last. Repeated
    rows are documents of their own. Only ids, sources and sizes are shuffled, and joins are by
    (source, block), so a source with a third of all rows is dealt over many tasks.
    """
    sized = keep_once(docs.select(
        F.col(id_column).alias("id"), F.col(source_column).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ), "mix-sizes")
    blocks, draws = draw_plan(sized, weights, most_repeats, block_words, depth)
    placed = _with_block(sized, blocks["targets"])
    same = ["key", "block"]
    joined = placed.join(draws, same, "left")
    edge = joined.where("edge_words is not null")
    # Only the one block of each source at its target's edge is cut by document.
    order = Window.partitionBy("key").orderBy(hashed_number(F.lit("edge"), "id"), "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    cut = edge.withColumn("through", F.sum("size").over(order)).withColumn(
        "in_edge", (F.col("through") - F.col("size") / 2.0 <= F.col("edge_words")) & (F.col("size") > 0))
    rest = joined.where("edge_words is null").withColumn("in_edge", F.lit(False))
    shards = F.coalesce("shards", F.array().cast("array<bigint>"))
    whole = F.coalesce("whole", F.lit(0))
    out = rest.unionByName(cut.drop("through")).withColumn("copies", whole + F.col("in_edge").cast("int"))
    return out.select("id", "source", "size", "source_size", "target", "copies", F.slice(shards, 1, F.col("copies")).alias("shards"))


def _with_block(sized: DataFrame, targets: DataFrame) -> DataFrame:
    named = targets.select("key", F.col("source").alias("of"), "source_size", "target", "n_blocks")
    return sized.join(named, sized["source"].eqNullSafe(named["of"])).drop("of").withColumn(
        "block", F.pmod(hashed_number(F.lit("block"), "id"), F.col("n_blocks")))


def draw_plan(sized: DataFrame, weights: tuple, most_repeats: int, block_words: int, depth: int) -> tuple[dict, DataFrame]:
    """Targets per source, and per (source, block): whole copies, words wanted from an edge block, shards of the draws."""
    by_source = Window.orderBy(code_point_order("source"))
    targets = keep_once(source_targets(sized, weights, most_repeats).withColumns({
        "key": F.row_number().over(by_source) - 1,
        "n_blocks": F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)),
        "passes": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0),
    }), "mix-targets")
    sizes = _with_block(sized, targets).groupBy("key", "block").agg(F.sum("size").alias("words"))
    # Running sums in two levels: over runs of blocks, then inside a run, so a large source is summed by many tasks.
    sizes = sizes.withColumn("run", F.floor(F.col("block") / RUN))
    runs_of = sizes.groupBy("key", "run").agg(F.sum("words").alias("run_words"), F.count("*").alias("run_blocks"))
    earlier = Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = runs_of.select(
        "key", "run", F.coalesce(F.sum("run_words").over(earlier), F.lit(0)).alias("words_before"),
        F.coalesce(F.sum("run_blocks").over(earlier), F.lit(0)).alias("blocks_before"),
        F.sum("run_blocks").over(Window.partitionBy("key")).alias("found"))
    inside = Window.partitionBy("key", "run").orderBy("block")
    placed = sizes.join(before, ["key", "run"]).join(targets.select("key", "source_size", "target", "passes"), "key")
    blocks = placed.withColumns({
        "through": F.col("words_before") + F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        "place": F.col("blocks_before") + F.row_number().over(inside) - 1,
        "left_over": F.col("target") - F.col("passes") * F.col("source_size"),
    })
    full = (F.col("through") <= F.col("left_over")) & (F.col("left_over") > 0)
    at_edge = ~full & (F.col("through") - F.col("words") < F.col("left_over"))
    blocks = keep_once(blocks.select(
        "key", "block", "place", "found", "passes",
        (F.col("passes") + full.cast("int")).cast("int").alias("whole"),
        F.when(at_edge, F.col("left_over") - (F.col("through") - F.col("words"))).alias("edge_words"),
    ), "mix-blocks")
    # A source's draws are numbered pass by pass, in the order of its blocks, which is a hashed order of documents.
    times = F.col("whole") + F.col("edge_words").isNotNull().cast("int")
    draws_of = blocks.select("key", "block", "place", "found", F.explode(
        F.when(times > 0, F.sequence(F.lit(0), times - 1))).alias("pass_no"))
    numbered = draws_of.select("key", "block", (F.col("pass_no") * F.col("found") + F.col("place")).alias("draw"))
    per_source = targets.join(numbered.groupBy("key").agg(F.count("*").alias("n")), "key", "left")
    quotas = per_source.agg(F.transform(
        F.sort_array(F.collect_list(F.struct("key", F.coalesce("n", F.lit(0)).alias("n")))), lambda s: s["n"].cast("long")).alias("quotas"))
    leaves = split_quotas(quotas, depth).groupBy(F.col("position").cast("long").alias("key")).agg(
        F.collect_list(F.struct("first", "last", "shard")).alias("leaves"))
    leaf = F.element_at(F.filter("leaves", lambda x: F.col("draw").between(x["first"], x["last"])), 1)["shard"]
    dealt = numbered.join(leaves, "key").select("key", "block", "draw", leaf.alias("shard"))
    shards = dealt.groupBy("key", "block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("draw", "shard"))), lambda s: s["shard"]).alias("shards"))
    return {"targets": targets}, blocks.select("key", "block", "whole", "edge_words").join(shards, ["key", "block"], "left")


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """The mixed rows: each document as often as the mix takes it, with `_shard` and `_order`, its place in a local shuffle.

    Rows with the same id and source are taken alike. Writing with `partitionBy("_shard")` after
    `sortWithinPartitions("_shard", "_order")` gives the shuffled shards. Columns of `docs` are kept
    whatever their names: if one is called `_shard` or `_order`, the new one gets an underscore more.
    """
    plan = allocate(docs, id_column, text_column, source_column, **options)
    shard, order, copy, key_id, key_source, key_words, shards = spare_names(docs, "_shard", "_order", "_copy", "_id", "_of", "_words", "_shards")
    alike = keep_once(plan.groupBy("id", "source", "size").agg(F.max("shards").alias("shards")), "mix-plan").toDF(key_id, key_source, key_words, shards)
    words = F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long")
    joined = docs.join(alike, F.col(id_column).eqNullSafe(F.col(key_id)) & F.col(source_column).eqNullSafe(F.col(key_source)) & (words == F.col(key_words)))
    copies = joined.select(*docs.columns, F.posexplode(shards).alias(copy, shard))
    return copies.withColumn(order, F.xxhash64(F.col(id_column), F.col(text_column), F.col(copy), F.col(shard)))
