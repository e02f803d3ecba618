"""Boxes, hues and field positions on the vector table, colours on parts and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.catalog.base import query, rounded, table
from fieldglass.functions import colour as cl, geometry as ge
from fieldglass.functions.labels import side_label
from fieldglass.operators import vision as vi
from fieldglass.session import scratch_path
from fieldglass.sources.tables import read_csv_dimension


def boxes(spark, folder):
    """Vectors as boxes: the first components place the box, the label is frame and clip."""
    e = [F.col("embedding")[i].cast("double") for i in range(5)]
    x1, y1 = F.abs(e[0]) * 1280, F.abs(e[1]) * 1440
    return table(spark, folder, "embeddings").select(
        "vec_id", "label",
        F.array(x1, y1, x1 + F.abs(e[2]) * 200, y1 + F.abs(e[3]) * 400).alias("bbox"),
        (F.abs(e[4]) * 3).alias("confidence"), (F.col("label") % 2).alias("class"),
        F.when(F.col("label") < 5, 480).otherwise(720).alias("frame_height"),
        (F.floor(F.abs(e[4]) * 1000) % 180).alias("hue"),
    )


BOXES_SQL = """SELECT vec_id, label, abs(CAST(embedding[1] AS DOUBLE)) * 1280 AS x1, abs(CAST(embedding[2] AS DOUBLE)) * 1440 AS y1,
  abs(CAST(embedding[1] AS DOUBLE)) * 1280 + abs(CAST(embedding[3] AS DOUBLE)) * 200 AS x2,
  abs(CAST(embedding[2] AS DOUBLE)) * 1440 + abs(CAST(embedding[4] AS DOUBLE)) * 400 AS y2,
  abs(CAST(embedding[5] AS DOUBLE)) * 3 AS confidence, label % 2 AS class, CASE WHEN label < 5 THEN 480 ELSE 720 END AS frame_height,
  CAST(floor(abs(CAST(embedding[5] AS DOUBLE)) * 1000) AS BIGINT) % 180 AS hue FROM embeddings"""
WITH_BOXES = f"WITH boxes AS ({BOXES_SQL})"
HEX_SPARK = "format_string('#%06X', ({} * 791977) % 16777216)"
HEX_SQL = "printf('#%06X', ({} * 791977) % 16777216)"


@query("b25_kept_boxes", f"""{WITH_BOXES} SELECT vec_id, round(confidence, 6) AS confidence FROM boxes
WHERE (y1 + y2) / 2 >= 195::DOUBLE * (frame_height / 720::DOUBLE) AND class = 0 AND confidence >= 0.25::DOUBLE""")
def b25(spark, folder):
    return rounded(vi.filter_boxes(boxes(spark, folder)).select("vec_id", "confidence"), "confidence")


def channel_sql(start: int) -> str:
    return f"CAST(('0x' || substr(hex, {start}, 2)) AS INTEGER)"


@query("b26_hex_to_rgb", f"""WITH h AS (SELECT p_partkey, {HEX_SQL.format('p_partkey')} AS hex FROM part)
SELECT p_partkey, {channel_sql(2)} AS r, {channel_sql(4)} AS g, {channel_sql(6)} AS b FROM h""")
def b26(spark, folder):
    rows = table(spark, folder, "part").selectExpr("p_partkey", f"{HEX_SPARK.format('p_partkey')} AS hex")
    return rows.select("p_partkey", cl.hex_to_rgb(F.col("hex")).alias("c")).select("p_partkey", "c.r", "c.g", "c.b")


def hue_cte(source: str, keys: str) -> str:
    """Hue of column hex, from the usual formula, as table hued."""
    return f"""rgb AS (SELECT {keys}, hex, {channel_sql(2)}::DOUBLE AS r, {channel_sql(4)}::DOUBLE AS g, {channel_sql(6)}::DOUBLE AS b FROM {source}),
mx AS (SELECT *, greatest(r, g, b) AS top, greatest(r, g, b) - least(r, g, b) AS spread FROM rgb),
deg AS (SELECT *, CASE WHEN spread = 0 THEN 0 WHEN top = r THEN 60 * (g - b) / spread WHEN top = g THEN 120 + 60 * (b - r) / spread
  ELSE 240 + 60 * (r - g) / spread END AS d FROM mx),
hued AS (SELECT {keys}, hex, CAST(round((CASE WHEN d < 0 THEN d + 360 ELSE d END) / 2) AS INTEGER) % 180 AS hue FROM deg)"""


@query("b27_rgb_to_hue", f"""WITH h AS (SELECT p_partkey, {HEX_SQL.format('p_partkey')} AS hex FROM part), {hue_cte('h', 'p_partkey')}
SELECT p_partkey, hue FROM hued""")
def b27(spark, folder):
    rows = table(spark, folder, "part").selectExpr("p_partkey", f"{HEX_SPARK.format('p_partkey')} AS hex")
    rgb = cl.hex_to_rgb(F.col("hex"))
    return rows.select("p_partkey", cl.rgb_to_hue(rgb["r"], rgb["g"], rgb["b"]).alias("hue"))


@query("b28_hue_distance", """SELECT p_partkey, least(abs(p_size * 3 - p_partkey % 180), 180 - abs(p_size * 3 - p_partkey % 180)) AS dist FROM part""")
def b28(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", cl.hue_distance(F.col("p_size") * 3, F.col("p_partkey") % 180).alias("dist"),
    )


@query("b29_side_label", """SELECT o_orderkey, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
  WHEN o_orderpriority = '1-URGENT' THEN 'offense' ELSE 'defense' END AS side FROM orders""")
def b29(spark, folder):
    team = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority"))
    return table(spark, folder, "orders").select("o_orderkey", side_label(team, F.lit("1-URGENT")).alias("side"))


MATRIX_EXPRESSIONS = {
    "m11": "cast(1 + r_regionkey as double)", "m12": "cast(r_regionkey as double) / 8", "m13": "cast(5 - r_regionkey as double)",
    "m21": "cast(r_regionkey as double) / 16", "m22": "cast(2 + r_regionkey as double)", "m23": "cast(3 as double)",
    "m31": "cast(r_regionkey as double) / 4096", "m32": "cast(1 as double) / 2048", "m33": "cast(1 as double)",
}


@query("b30_field_position", f"""{WITH_BOXES}, m AS (SELECT r_regionkey AS clip_id, {', '.join(f'{e} AS {n}' for n, e in MATRIX_EXPRESSIONS.items())} FROM region),
foot AS (SELECT vec_id, label, (x1 + x2) / 2 AS x, y2 AS y FROM boxes)
SELECT vec_id, round((m11 * x + m12 * y + m13) / (m31 * x + m32 * y + m33), 6) AS field_x,
  round((m21 * x + m22 * y + m23) / (m31 * x + m32 * y + m33), 6) AS field_y FROM foot LEFT JOIN m ON m.clip_id = foot.label""")
def b30(spark, folder):
    matrices = table(spark, folder, "region").selectExpr(
        "r_regionkey as clip_id", *[f"{e} as {n}" for n, e in MATRIX_EXPRESSIONS.items()],
    )
    placed = vi.field_position(boxes(spark, folder).withColumn("clip_id", F.col("label")), matrices)
    return rounded(placed.select("vec_id", "field_x", "field_y"), "field_x", "field_y")


@query("b31_scaled_rectangle", f"""{WITH_BOXES}, s AS (SELECT vec_id, greatest(0, CAST(trunc(x1 * (854 / 1280::DOUBLE)) AS INTEGER)) AS l,
  greatest(0, CAST(trunc(y1 * (frame_height / 720::DOUBLE)) AS INTEGER)) AS t, least(854, CAST(trunc(x2 * (854 / 1280::DOUBLE)) AS INTEGER)) AS r,
  least(frame_height, CAST(trunc(y2 * (frame_height / 720::DOUBLE)) AS INTEGER)) AS b FROM boxes)
SELECT vec_id, CASE WHEN r > l AND b > t THEN l END AS "left", CASE WHEN r > l AND b > t THEN t END AS top,
  CASE WHEN r > l AND b > t THEN r END AS "right", CASE WHEN r > l AND b > t THEN b END AS bottom FROM s""")
def b31(spark, folder):
    box = F.col("bbox")
    scaled = ge.scale_rectangle(box[0], box[1], box[2], box[3], F.lit(854), F.col("frame_height"))
    rows = boxes(spark, folder).select("vec_id", scaled.alias("r"))
    return rows.select("vec_id", "r.left", "r.top", "r.right", "r.bottom")


def colours(spark, folder):
    """Nations as teams with one or two colours."""
    return table(spark, folder, "nation").selectExpr(
        "n_name AS team_abbr", f"{HEX_SPARK.format('(n_nationkey + 1)')} AS team_color",
        f"case when n_nationkey % 3 <> 0 then {HEX_SPARK.format('(n_nationkey + 40)')} end AS team_color2", "n_nationkey",
    )


SWATCH_CTE = f"""raw AS (SELECT n_name AS team, n_nationkey AS k, {HEX_SQL.format('(n_nationkey + 1)')} AS c1,
  CASE WHEN n_nationkey % 3 <> 0 THEN {HEX_SQL.format('(n_nationkey + 40)')} END AS c2 FROM nation),
listed AS (SELECT team, k, 0 AS ord, c1 AS hex FROM raw UNION ALL SELECT team, k, 1, c2 FROM raw WHERE c2 IS NOT NULL),
{hue_cte('listed', 'team, k, ord')}"""


@query("a5_csv_dimension", f"""WITH {SWATCH_CTE} SELECT team AS team_abbr, c1 AS team_color, c2 AS team_color2 FROM raw""")
def a5(spark, folder):
    columns = ["team_abbr", "team_color", "team_color2"]
    path = scratch_path(spark, "colours-csv")
    colours(spark, folder).select(*columns).write.csv(path, header=True)
    return read_csv_dimension(spark, path, columns)


@query("c13_team_swatches", f"WITH {SWATCH_CTE} SELECT team, ord, hex, hue FROM hued")
def c13(spark, folder):
    return vi.team_swatches(colours(spark, folder))


@query("c14_nearest_swatch", f"""{WITH_BOXES}, {SWATCH_CTE},
pairs AS (SELECT b.vec_id, b.hue, h.team, CASE WHEN h.k = b.label THEN h.ord ELSE h.ord + 100 END AS place,
    least(abs(b.hue - h.hue), 180 - abs(b.hue - h.hue)) AS dist FROM boxes b JOIN hued h ON h.k = b.label OR h.k = b.label + 10),
best AS (SELECT vec_id, min(dist) AS dist, arg_min(team, {{'d': dist, 'p': place}}) AS team FROM pairs GROUP BY vec_id)
SELECT vec_id, CASE WHEN dist <= 20 THEN team END AS team FROM best""")
def c14(spark, folder):
    named = boxes(spark, folder).withColumns({
        "away_team": F.concat(F.lit("NATION_"), F.col("label")), "home_team": F.concat(F.lit("NATION_"), F.col("label") + 10),
    })
    with_swatches = vi.game_swatches(named, vi.team_swatches(colours(spark, folder)))
    return vi.classify_team(with_swatches).select("vec_id", "team")


SIDED_CTE = f"""{WITH_BOXES}, players AS (SELECT label AS frame_id, vec_id, CASE WHEN hue < 60 THEN 'offense' WHEN hue < 120 THEN 'defense' END AS side FROM boxes)"""


def _players(spark, folder):
    team = F.when(F.col("hue") < 60, "A").when(F.col("hue") < 120, "B")
    named = boxes(spark, folder).withColumns({"frame_id": F.col("label"), "team": team, "posteam": F.lit("A")})
    return vi.assign_side(named)


@query("d14_frame_counts", f"""{SIDED_CTE} SELECT frame_id, count(*) AS num_players, count(*) FILTER (WHERE side = 'offense') AS offense_count,
  count(*) FILTER (WHERE side = 'defense') AS defense_count, count(*) FILTER (WHERE side IS NULL) AS unassigned_count FROM players GROUP BY frame_id""")
def d14(spark, folder):
    return vi.frame_counts(_players(spark, folder), ["frame_id"])


@query("d14_frame_record", f"""{SIDED_CTE}, listed AS (SELECT frame_id, vec_id, side, row_number() OVER (PARTITION BY frame_id ORDER BY vec_id) AS place,
  count(*) OVER f AS num_players, count(*) FILTER (WHERE side = 'offense') OVER f AS offense_count,
  count(*) FILTER (WHERE side = 'defense') OVER f AS defense_count FROM players WINDOW f AS (PARTITION BY frame_id))
SELECT frame_id, num_players, offense_count, defense_count, place, vec_id, side FROM listed""")
def d14_record(spark, folder):
    """The published record of each frame, its players listed in order."""
    record = vi.frame_detections(_players(spark, folder), ["frame_id"], ["vec_id", "side"])
    return record.select("frame_id", "num_players", "offense_count", "defense_count", F.posexplode(F.sort_array("players")).alias("place", "p")).select(
        "frame_id", "num_players", "offense_count", "defense_count", (F.col("place") + 1).alias("place"), "p.vec_id", "p.side")


@query("d15_dominant_hue", """WITH c AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
px AS (SELECT vec_id, CAST(floor(abs(x) * 1000) AS INTEGER) % 180 AS h, CAST(floor(abs(x) * 3000) AS INTEGER) % 256 AS s FROM c),
k AS (SELECT vec_id, median(h) FILTER (WHERE s > 60 AND NOT (h > 30 AND h < 95)) AS m,
  count(*) FILTER (WHERE s > 60 AND NOT (h > 30 AND h < 95)) AS n_pixels FROM px GROUP BY vec_id)
SELECT vec_id, CASE WHEN n_pixels >= 5 THEN CAST(m AS DOUBLE) END AS hue, n_pixels FROM k""")
def d15(spark, folder):
    parts = table(spark, folder, "embeddings").select("vec_id", F.explode("embedding").alias("v"))
    pixels = parts.withColumn("x", F.col("v").cast("double")).select(
        "vec_id", (F.floor(F.abs("x") * 1000) % 180).cast("int").alias("h"), (F.floor(F.abs("x") * 3000) % 256).cast("int").alias("s"),
    )
    return vi.dominant_hue(pixels, ["vec_id"])
