"""Registry and the shared bindings, each as Spark columns and as the same SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where SQL can say the same."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise KeyError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# Expressions both engines read the same way.
TEAM = "concat('T', lpad(cast({} as string), 2, '0'))"
PERIOD = {"season": "cast(year(o_orderdate) as int)", "week": "cast(month(o_orderdate) as int)"}
RESULT = (
    "case when o_orderdate < timestamp '2001-01-01 00:00:00' "
    "then cast(floor((o_totalprice - 250000) / 10000) as double) end"
)

# Order lines as plays: customer nation attacks, supplier nation defends. Values are whole numbers,
# so sums are exact in any order. Nulls are put where the operators must handle them.
PLAY_COLUMNS = {
    "game_id": "l_orderkey",
    **PERIOD,
    "posteam": f"case when c_nationkey <> 24 then {TEAM.format('c_nationkey')} end",
    "defteam": TEAM.format("s_nationkey"),
    "play_type": (
        "case when l_returnflag = 'R' then 'pass' when l_returnflag = 'A' then 'run' "
        "when l_tax = 0 then 'no_play' end"
    ),
    "pass_attempt": "cast(case l_returnflag when 'R' then 1 when 'A' then 0 end as double)",
    "rush_attempt": "cast(case l_returnflag when 'A' then 1 else 0 end as double)",
    "down": "cast(nullif(l_linenumber % 5, 0) as double)",
    "wp": "nullif(l_discount, 0) * 10",
    "qb_kneel": "cast(case l_linenumber when 7 then 1 when 6 then null else 0 end as double)",
    "qb_spike": "cast(case when l_quantity = 50 then 1 when l_quantity = 49 then null else 0 end as double)",
    "epa": "case when l_quantity <> 13 then cast(floor(l_extendedprice / 1000) - 50 as double) end",
    "cpoe": "case when l_tax > 0 then round(l_tax * 100) - 4 end",
    "success": "cast(case l_linestatus when 'F' then 1 else 0 end as double)",
    "sack": "cast(case when l_linestatus = 'O' and l_returnflag = 'R' and l_linenumber <= 3 then 1 else 0 end as double)",
    "passing_yards": "case when l_quantity <> 20 then l_quantity end",
    "rushing_yards": "l_quantity",
    "passer_player_id": "case when l_suppkey % 10 <> 9 then cast(l_suppkey as string) end",
    "passer_player_name": "concat('P', cast(l_suppkey as string))",
    "qtr": "cast(l_linenumber % 4 + 1 as int)",
    "ydstogo": "l_quantity",
    "yardline_100": "cast(l_partkey % 100 as double)",
    "score_differential": "case when l_suppkey % 11 <> 0 then l_quantity - 25 end",
    "half_seconds_remaining": "cast(l_orderkey % 1800 as double)",
    "game_seconds_remaining": "cast(l_orderkey % 3600 as double)",
    "posteam_timeouts_remaining": "cast(l_partkey % 4 as double)",
    "defteam_timeouts_remaining": "cast(l_suppkey % 4 as double)",
    "posteam_type": "case when l_orderkey % 2 = 0 then 'home' else 'away' end",
    "result": RESULT,
    "line": "l_linenumber",
    "part": "l_partkey",
}

# Orders as games: home is the customer's nation, away the nation of the first supplier.
GAME_COLUMNS = {
    "game_id": "o_orderkey",
    **PERIOD,
    "home_team": TEAM.format("c_nationkey"),
    "away_team": TEAM.format("s_nationkey"),
    "result": RESULT,
    "home_score": "cast(floor(o_totalprice / 10000) as double)",
    "away_score": "cast(floor(o_totalprice / 10000) - floor((o_totalprice - 250000) / 10000) as double)",
    "home_rest": "cast(o_orderkey % 10 + 4 as int)",
    "away_rest": "cast(o_custkey % 10 + 4 as int)",
    "roof": "case o_orderpriority when '1-URGENT' then 'dome' when '2-HIGH' then 'closed' when '3-MEDIUM' then null else 'outdoors' end",
    "temp": "cast(case when o_orderkey % 7 <> 0 then o_orderkey % 100 end as double)",
    "wind": "cast(case when o_orderkey % 5 <> 0 then o_custkey % 25 end as double)",
}

# Orders as injury reports: priority is the status, order status the position.
INJURY_COLUMNS = {
    **PERIOD,
    "team": TEAM.format("c_nationkey"),
    "gsis_id": "cast(o_custkey % 100 as string)",
    "position": "case o_orderstatus when 'F' then 'QB' else 'WR' end",
    "report_status": (
        "case o_orderpriority when '1-URGENT' then 'Out' when '2-HIGH' then 'Doubtful' "
        "when '3-MEDIUM' then 'Questionable' when '5-LOW' then 'Probable' end"
    ),
}


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} as {n}" for n, e in columns.items()])


def _sql(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {source}"


def plays(spark: SparkSession, folder: str) -> DataFrame:
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    customers, suppliers = table(spark, folder, "customer"), table(spark, folder, "supplier")
    # Orders get their customer before they meet the lines: the lines are dealt by order once, not by customer again.
    bought = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    joined = (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
    )
    return _select(joined, PLAY_COLUMNS)


def games(spark: SparkSession, folder: str) -> DataFrame:
    first = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("first_supp"))
    orders, customers = table(spark, folder, "orders"), table(spark, folder, "customer")
    suppliers = table(spark, folder, "supplier")
    joined = (
        orders.join(first, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers, F.col("first_supp") == F.col("s_suppkey"))
    )
    return _select(joined, GAME_COLUMNS)


def injuries(spark: SparkSession, folder: str) -> DataFrame:
    joined = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"),
    )
    return _select(joined, INJURY_COLUMNS)


PLAYS_SQL = _sql(
    PLAY_COLUMNS,
    "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
    "JOIN supplier ON l_suppkey = s_suppkey",
)
GAMES_SQL = _sql(
    GAME_COLUMNS,
    "orders JOIN (SELECT l_orderkey, min(l_suppkey) AS first_supp FROM lineitem GROUP BY 1) "
    "ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON first_supp = s_suppkey",
)
INJURIES_SQL = _sql(INJURY_COLUMNS, "orders JOIN customer ON o_custkey = c_custkey")
CLEAN_FILTER = (
    "wp > 0.05::DOUBLE AND wp < 0.95::DOUBLE AND qb_kneel IS DISTINCT FROM 1 "
    "AND qb_spike IS DISTINCT FROM 1 AND play_type IS DISTINCT FROM 'no_play'"
)
WITH_PLAYS = f"WITH plays AS ({PLAYS_SQL})"
WITH_CLEAN = f"{WITH_PLAYS}, clean AS (SELECT * FROM plays WHERE {CLEAN_FILTER})"
WITH_GAMES = f"WITH games AS ({GAMES_SQL})"
WITH_INJURIES = f"WITH injuries AS ({INJURIES_SQL})"

# Events as a signal: one stream per event type, 300 seconds of real time as one second of clip.
ORIGIN_MICROS = 1_704_067_200_000_000
STREAM_UNIT = 3e8
# Per user the events are sparser: 20,000 seconds of real time as one second of clip.
USER_UNIT = 2e10


# Whole hundredths over a power of two: sums and squares are exact in any order.
def amplitude():
    return F.round(F.col("value") * 100) / 8192


def event_seconds(unit: float):
    origin = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return (F.unix_micros(F.col("ts").cast("timestamp")) - origin) / F.lit(unit)


def signal(spark: SparkSession, folder: str) -> DataFrame:
    """(stream, t, id, rms): amplitude of every event."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("stream"), event_seconds(STREAM_UNIT).alias("t"),
        F.col("event_id").alias("id"), amplitude().alias("rms"),
    )


def clip_energy(spark: SparkSession, folder: str) -> DataFrame:
    """(clip_id, timestamp_sec, id, rms): a user's clicks, views and errors."""
    return table(spark, folder, "events").where(F.col("event_type").isin("click", "view", "error")).select(
        F.col("user_id").alias("clip_id"), event_seconds(USER_UNIT).alias("t"),
        F.col("event_id").alias("id"), amplitude().alias("rms"),
    )


def clip_scores(spark: SparkSession, folder: str) -> DataFrame:
    """(clip_id, t, id, away_score, home_score): a user's purchases and signups; small values hide the score."""
    tens = F.floor(F.col("value") / 10).cast("int")
    return table(spark, folder, "events").where(F.col("event_type").isin("purchase", "signup")).select(
        F.col("user_id").alias("clip_id"), event_seconds(USER_UNIT).alias("t"), F.col("event_id").alias("id"),
        F.when(tens > 0, tens).alias("away_score"), (tens % 3).alias("home_score"),
    )


SIGNAL_SQL = (
    f"SELECT event_type AS stream, (epoch_us(ts) - {ORIGIN_MICROS}) / {STREAM_UNIT:.1f}::DOUBLE AS t, "
    "event_id AS id, round(value * 100) / 8192 AS rms FROM events"
)
CLIP_ENERGY_SQL = (
    f"SELECT user_id AS clip_id, (epoch_us(ts) - {ORIGIN_MICROS}) / {USER_UNIT:.1f}::DOUBLE AS t, "
    "event_id AS id, round(value * 100) / 8192 AS rms FROM events WHERE event_type IN ('click', 'view', 'error')"
)
CLIP_SCORES_SQL = (
    f"SELECT user_id AS clip_id, (epoch_us(ts) - {ORIGIN_MICROS}) / {USER_UNIT:.1f}::DOUBLE AS t, "
    "event_id AS id, nullif(CAST(floor(value / 10) AS INTEGER), 0) AS away_score, "
    "CAST(floor(value / 10) AS INTEGER) % 3 AS home_score "
    "FROM events WHERE event_type IN ('purchase', 'signup')"
)
