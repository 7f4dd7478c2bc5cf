"""Pixel relations made from the tables, for both engines: every row of embeddings is an 8x8 picture, users' events are animations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

W = H = 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _value(e: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(e.cast("double") * 128) + 128)).cast("int")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    return rows.withColumns({"x": F.col("i").bitwiseAND(F.lit(7)), "y": F.shiftright("i", 3)})


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, i, x, y, v: 0..255."""
    return _placed(spark, sf_dir).select("img", "i", "x", "y", _value(F.get("embedding", F.col("i"))).alias("v"))


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, i, x, y, a, r, g, b; some pixels are translucent."""
    at = lambda k: _value(F.get("embedding", k))
    i = F.col("i")
    return _placed(spark, sf_dir).select("img", "i", "x", "y", F.when(i % 7 == 0, 0).when(i % 5 == 0, 128).otherwise(255).alias("a"), at(i).alias("r"), at(63 - i).alias("g"), at(i * 5 % 64).alias("b"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, bx, by, c0..c15: the four 4x4 blocks of a picture, around zero."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img"), "embedding", F.explode(F.array(*[F.struct(F.lit(k % 2).alias("bx"), F.lit(k // 2).alias("by")) for k in range(4)])).alias("p"))
    at = lambda k: (F.col("p.by") * 4 + k // 4) * 8 + F.col("p.bx") * 4 + k % 4
    return rows.select("img", "p.bx", "p.by", *[(_value(F.get("embedding", at(k))) - 128).cast("int").alias(f"c{k}") for k in range(16)])


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anim, frame_no, x, y, w, h, duration_ms, dispose, blend, shade: a user's events in order, on an 8x8 canvas."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    odd = F.col("event_id")
    return e.select(
        F.col("user_id").alias("anim"), n.alias("frame_no"), (odd % 3 * 2).cast("int").alias("x"), (odd % 5).cast("int").alias("y"), (odd % 4 + 1).cast("int").alias("w"), (odd % 6 + 1).cast("int").alias("h"),
        F.greatest(F.lit(0), F.least(F.lit(16777215), F.floor("value"))).cast("long").alias("duration_ms"), F.when(F.col("event_type").isin("error", "signup"), 1).otherwise(0).alias("dispose"),
        F.when(F.col("event_type").isin("click", "error"), 1).otherwise(0).alias("blend"), (odd * 37 % 256).cast("int").alias("shade"),
    )


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of the frames on their canvas: anim, frame_no, x, y, a, r, g, b, dispose, blend."""
    f = frames(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1)).alias("k"))
    x, y = F.col("x") + F.col("k") % F.col("w"), F.col("y") + F.floor(F.col("k") / F.col("w"))
    s = F.col("shade")
    out = f.select("anim", "frame_no", x.cast("int").alias("x"), y.cast("int").alias("y"), ((s * 3 + F.col("k") * 50) % 256).cast("int").alias("a"), s.alias("r"), (255 - s).alias("g"), ((s + F.col("k")) % 256).cast("int").alias("b"), "dispose", "blend")
    return out.where((F.col("x") < W) & (F.col("y") < H))


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grp, sym, len: code lengths of a complete code for each group of 16 parts: 1, 2, 3 .. 15, 15, dealt by a hash of the key."""
    from pyspark.sql import Window

    p = read(spark, sf_dir, "part").where(F.col("p_partkey") >= 16)
    grp = F.floor(F.col("p_partkey") / 16)
    n = F.row_number().over(Window.partitionBy(grp).orderBy(F.col("p_partkey") * 7919 % 101, "p_partkey"))
    full = F.count("*").over(Window.partitionBy(grp)) == 16
    return p.select(grp.alias("grp"), (F.col("p_partkey") % 16).cast("int").alias("sym"), F.least(n, F.lit(15)).cast("int").alias("len"), full.alias("full")).where("full").drop("full")


# The same relations in DuckDB's SQL, as common table expressions.
_V = "CAST(least(255, greatest(0, floor(CAST({} AS DOUBLE) * 128) + 128)) AS BIGINT)"
PLANES = f"pl AS (SELECT vec_id AS img, i, i % 8 AS x, i // 8 AS y, {_V.format('embedding[i + 1]')} AS v FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings))"
PX = (
    "px AS (SELECT vec_id AS img, i, i % 8 AS x, i // 8 AS y, CAST(CASE WHEN i % 7 = 0 THEN 0 WHEN i % 5 = 0 THEN 128 ELSE 255 END AS BIGINT) AS a, "
    f"{_V.format('embedding[i + 1]')} AS r, {_V.format('embedding[64 - i]')} AS g, {_V.format('embedding[(i * 5) % 64 + 1]')} AS b FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings))"
)
BLOCKS = "bl AS (SELECT vec_id AS img, k % 2 AS bx, k // 2 AS \"by\", " + ", ".join(f"{_V.format(f'embedding[(k // 2 * 4 + {n // 4}) * 8 + (k % 2) * 4 + {n % 4} + 1]')} - 128 AS c{n}" for n in range(16)) + " FROM (SELECT vec_id, embedding, unnest(range(4)) AS k FROM embeddings))"
FRAMES = (
    "fr AS (SELECT user_id AS anim, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no, event_id % 3 * 2 AS x, event_id % 5 AS y, event_id % 4 + 1 AS w, event_id % 6 + 1 AS h, "
    "CAST(greatest(0, least(16777215, floor(value))) AS BIGINT) AS duration_ms, CASE WHEN event_type IN ('error', 'signup') THEN 1 ELSE 0 END AS dispose, CASE WHEN event_type IN ('click', 'error') THEN 1 ELSE 0 END AS blend, event_id * 37 % 256 AS shade FROM events)"
)
LAYERS = FRAMES + (
    ", la AS (SELECT * FROM (SELECT anim, frame_no, x + k % w AS x, y + k // w AS y, (shade * 3 + k * 50) % 256 AS a, shade AS r, 255 - shade AS g, (shade + k) % 256 AS b, dispose, blend FROM (SELECT *, unnest(range(w * h)) AS k FROM fr)) WHERE x < 8 AND y < 8)"
)
LENGTHS = (
    "le AS (SELECT grp, sym, least(n, 15) AS len FROM (SELECT p_partkey // 16 AS grp, p_partkey % 16 AS sym, row_number() OVER (PARTITION BY p_partkey // 16 ORDER BY p_partkey * 7919 % 101, p_partkey) AS n, count(*) OVER (PARTITION BY p_partkey // 16) AS c FROM part WHERE p_partkey >= 16) WHERE c = 16)"
)
