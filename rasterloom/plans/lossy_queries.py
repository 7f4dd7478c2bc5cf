"""Queries over lossy coding steps and animations, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import pixels as P
from ..operators import animation as N
from ..operators import lossy as Y
from .fixtures import BLOCKS, FRAMES, H, LAYERS, PLANES, PX, W, blocks, frames, layers, planes, px, read
from .lossless_queries import longs, out

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = lambda spark, sf_dir: longs(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return put


KEYS = out(img="img", i="i")
BLOCK = 'CAST(img AS BIGINT) AS img, CAST(bx AS BIGINT) AS bx, CAST("by" AS BIGINT) AS "by"'
KEEP = ["img", "bx", "by"]
O16 = [f"o{k}" for k in range(16)]

# Animation


def _blend(d: str, s: str) -> dict[str, str]:
    """Names of dst and src columns are prefixes."""
    rest = f"(({d}a * (255 - {s}a)) // 255)"
    alpha = f"({s}a + {rest})"
    one = lambda c: f"CASE WHEN {s}a = 255 THEN {s}{c} WHEN {alpha} = 0 THEN 0 WHEN {s}a = 0 THEN {d}{c} ELSE ({s}{c} * {s}a + {d}{c} * {rest}) // {alpha} END"
    return {"a": f"CASE WHEN {s}a = 255 THEN 255 WHEN {alpha} = 0 THEN 0 WHEN {s}a = 0 THEN {d}a ELSE {alpha} END", "r": one("r"), "g": one("g"), "b": one("b")}


@query("blend_pixel", f"WITH {PX}, n AS (SELECT img, i, (a + i * 3) % 256 AS sa, r AS sr, g AS sg, b AS sb, (r * 7 + i) % 256 AS da, g AS dr, b AS dg, r AS db FROM px) SELECT {KEYS}, {out(**_blend('d', 's'))} FROM n")
def _(spark, sf):
    p = px(spark, sf)
    i, r, g, b = (F.col(c) for c in "irgb")
    shown = P.blend(P.Pixel((r * 7 + i) % 256, g, b, r), P.Pixel((F.col("a") + i * 3) % 256, r, g, b))
    return p.select("img", "i", *[v.alias(c) for c, v in zip("argb", shown)])


_STEP = _blend("d", "s")
_COMPOSE = (
    f"WITH RECURSIVE {LAYERS}, o AS (SELECT *, row_number() OVER (PARTITION BY anim, x, y ORDER BY frame_no) AS k FROM la), "
    "s AS (SELECT anim, x, y, k, frame_no, dispose, a AS sa, r AS sr, g AS sg, b AS sb, blend FROM o), "
    "c AS (SELECT anim, x, y, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS frame_no, CAST(0 AS BIGINT) AS pa, CAST(0 AS BIGINT) AS pr, CAST(0 AS BIGINT) AS pg, CAST(0 AS BIGINT) AS pb, CAST(0 AS BIGINT) AS da, CAST(0 AS BIGINT) AS dr, CAST(0 AS BIGINT) AS dg, CAST(0 AS BIGINT) AS db FROM (SELECT DISTINCT anim, x, y FROM la) "
    "UNION ALL SELECT anim, x, y, k, frame_no, " + ", ".join(f"CAST(p{c} AS BIGINT)" for c in "argb") + ", " + ", ".join(f"CAST(CASE WHEN dispose = 1 THEN 0 ELSE p{c} END AS BIGINT)" for c in "argb")
    + " FROM (SELECT s.anim, s.x, s.y, s.k, s.frame_no, dispose, " + ", ".join(f"CASE WHEN blend = 0 THEN {_STEP[c]} ELSE s{c} END AS p{c}" for c in "argb") + " FROM c JOIN s ON s.anim = c.anim AND s.x = c.x AND s.y = c.y AND s.k = c.k + 1)) "
    "SELECT " + out(anim="anim", frame_no="frame_no", x="x", y="y", a="pa", r="pr", g="pg", b="pb") + " FROM c WHERE k > 0"
)


@query("compose_frames", _COMPOSE)
def _(spark, sf):
    return N.compose(layers(spark, sf))


@query("is_keyframe", f"WITH {FRAMES} SELECT anim, CAST(frame_no AS BIGINT) AS frame_no, frame_no = 0 OR (blend = 1 AND dispose = 1 AND w >= 3 AND h >= 4) AS keyframe FROM fr")
def _(spark, sf):
    return frames(spark, sf).select("anim", "frame_no", N.keyframe(*(F.col(c) for c in ("frame_no", "blend", "dispose", "w", "h")), F.lit(3), F.lit(4)).alias("keyframe"))


@query("frame_geometry_check", f"WITH {FRAMES} SELECT anim, CAST(frame_no AS BIGINT) AS frame_no, x >= 0 AND y >= 0 AND x % 2 = 0 AND y % 2 = 0 AND w > 0 AND h > 0 AND x + w <= 6 AND y + h <= 7 AS fits FROM fr")
def _(spark, sf):
    f = frames(spark, sf)
    return f.select("anim", "frame_no", N.frame_fits({c: F.col(c) for c in "xywh"}, F.lit(6), F.lit(7)).alias("fits"))


@query("frame_durations", f"WITH {FRAMES} SELECT anim, {out(duration_ms='sum(duration_ms)', frames='count(*)')} FROM fr GROUP BY anim")
def _(spark, sf):
    return frames(spark, sf).groupBy("anim").agg(F.sum("duration_ms").alias("duration_ms"), F.count("*").alias("frames"))


@query("canvas_check", "SELECT o_orderkey, w > 0 AND h > 0 AND w <= 16777216 AND h <= 16777216 AND w * h <= 4294967295 AS fits FROM (SELECT o_orderkey, o_orderkey * 1009 % 20000000 AS w, o_orderkey * 31 % 70000 AS h FROM orders)")
def _(spark, sf):
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").select("o_orderkey", N.canvas_fits(k * 1009 % 20000000, k * 31 % 70000).alias("fits"))


# Color


_YCC = "(19595 * r + 38470 * g + 7471 * b + 32768) >> 16 AS yy, least(255, greatest(0, (-11056 * r - 21712 * g + 32768 * b + 8421376) >> 16)) AS cb, least(255, greatest(0, (32768 * r - 27440 * g - 5328 * b + 8421376) >> 16)) AS cr"


@query("rgb_to_yuv", f"WITH {PX}, t AS (SELECT img, x, y, {_YCC} FROM px) SELECT {out(img='img', x='x', y='y', yy='yy', cb='cb', cr='cr')} FROM t")
def _(spark, sf):
    return Y.luma_chroma(px(spark, sf))


@query("chroma_subsample", f"WITH {PX}, t AS (SELECT img, x, y, {_YCC} FROM px) SELECT {out(img='img', x='x // 2', y='y // 2', cb='cb', cr='cr')} FROM t WHERE x % 2 = 0 AND y % 2 = 0")
def _(spark, sf):
    return Y.chroma(Y.luma_chroma(px(spark, sf)))


@query("yuv_to_rgb", f"WITH {PLANES}, t AS (SELECT img, i, v * 65793 AS yy, (v * 3) % 256 - 128 AS u, (v * 5) % 256 - 128 AS w FROM pl) SELECT {KEYS}, {out(r='least(255, greatest(0, (yy + 91881 * w) >> 16))', g='least(255, greatest(0, (yy - 22554 * u - 46802 * w) >> 16))', b='least(255, greatest(0, (yy + 116130 * u) >> 16))')} FROM t")
def _(spark, sf):
    v = F.col("v")
    r, g, b = P.ycc_to_rgb(v, v * 3 % 256, v * 5 % 256)
    return planes(spark, sf).select("img", "i", r.alias("r"), g.alias("g"), b.alias("b"))


@query("pad_to_macroblock", f"WITH {PX}, g AS (SELECT img, x, y FROM (SELECT DISTINCT img FROM px), (SELECT range AS x FROM range(16)), (SELECT range AS y FROM range(16))) SELECT {out(img='g.img', x='g.x', y='g.y', i='g.y * 16 + g.x', r='r', b='b')} FROM g JOIN px ON px.img = g.img AND px.x = least(g.x, 6) AND px.y = least(g.y, 4)")
def _(spark, sf):
    return Y.padded(px(spark, sf).where("x < 7 AND y < 5"), 7, 5).select("img", "x", "y", "i", "r", "b")


# Transforms


def _names(prefix: str, values: list[str]) -> str:
    return ", ".join(f"{v} AS {prefix}{k}" for k, v in enumerate(values))


def _sql_stages(*stages: list[str]) -> str:
    """CTEs that apply lists of 16 expressions one after another; the last is s."""
    cte, last = [], "bl"
    for n, values in enumerate(stages):
        name = "s" if n == len(stages) - 1 else f"s{n}"
        prefix = "o" if name == "s" else f"t{n}_"
        cte.append(f'{name} AS (SELECT img, bx, "by", {_names(prefix, values)} FROM {last})')
        last = name
    return ", ".join(cte)


def _fd_rows(p):
    o = []
    for r in range(4):
        x = [f"{p}{4 * r + k}" for k in range(4)]
        a, b, c, d = f"(({x[0]} + {x[3]}) * 8)", f"(({x[1]} + {x[2]}) * 8)", f"(({x[1]} - {x[2]}) * 8)", f"(({x[0]} - {x[3]}) * 8)"
        o += [f"{a} + {b}", f"({c} * 2217 + {d} * 5352 + 14500) >> 12", f"{a} - {b}", f"({d} * 2217 - {c} * 5352 + 7500) >> 12"]
    return o


def _fd_cols(p):
    o = [""] * 16
    for k in range(4):
        x = [f"{p}{4 * r + k}" for r in range(4)]
        a, b, c, d = f"({x[0]} + {x[3]})", f"({x[1]} + {x[2]})", f"({x[1]} - {x[2]})", f"({x[0]} - {x[3]})"
        o[k], o[8 + k] = f"({a} + {b} + 7) >> 4", f"({a} - {b} + 7) >> 4"
        o[4 + k] = f"(({c} * 2217 + {d} * 5352 + 12000) >> 16) + CASE WHEN {d} <> 0 THEN 1 ELSE 0 END"
        o[12 + k] = f"({d} * 2217 - {c} * 5352 + 51000) >> 16"
    return o


def _id(p, rows):
    o = []
    for k in range(4):
        x = [f"{p}{4 * r + k}" for r in range(4)]
        dc = f"({x[0]} + 4)" if rows else x[0]
        a, b = f"({dc} + {x[2]})", f"({dc} - {x[2]})"
        c, d = f"((({x[1]} * 35468) >> 16) - (({x[3]} * 85627) >> 16))", f"((({x[1]} * 85627) >> 16) + (({x[3]} * 35468) >> 16))"
        v = [f"{a} + {d}", f"{b} + {c}", f"{b} - {c}", f"{a} - {d}"]
        o += [f"({e}) >> 3" for e in v] if rows else v
    return o


def _had(p, by_rows, shift, bias=0):
    o = [""] * 16
    for k in range(4):
        at = [4 * k + j if by_rows else 4 * j + k for j in range(4)]
        x = [f"{p}{n}" for n in at]
        x[0] = f"({x[0]} + {bias})" if bias else x[0]
        a, b, c, d = f"({x[0]} + {x[3]})", f"({x[1]} + {x[2]})", f"({x[1]} - {x[2]})", f"({x[0]} - {x[3]})"
        for n, e in zip(at, (f"{a} + {b}", f"{d} + {c}", f"{a} - {b}", f"{d} - {c}")):
            o[n] = f"({e}) >> {shift}" if shift else e
    return o


for _name, _f, _stages in (
    ("fdct4x4", Y.fdct, (_fd_rows("c"), _fd_cols("t0_"))),
    ("idct4x4", Y.idct, (_id("c", False), _id("t0_", True))),
    ("fwht4x4", Y.fwht, (_had("c", True, 0), _had("t0_", False, 1))),
    ("iwht4x4", Y.iwht, (_had("c", False, 0), _had("t0_", True, 3, 3))),
):

    @query(_name, f"WITH {BLOCKS}, {_sql_stages(*_stages)} SELECT {BLOCK}, {out(**{o: o for o in O16})} FROM s")
    def _(spark, sf, f=_f):
        return f(blocks(spark, sf), KEEP)


@query("dct_roundtrip_error", f'WITH {BLOCKS}, {_sql_stages(_fd_rows("c"), _fd_cols("t0_"), _id("t1_", False), _id("t2_", True))} SELECT {BLOCK}, CAST(greatest({", ".join(f"abs(o{k} - c{k})" for k in range(16))}) AS BIGINT) AS worst FROM s JOIN bl USING (img, bx, "by")')
def _(spark, sf):
    b = blocks(spark, sf)
    back = Y.idct(Y.fdct(b, [*KEEP, *[f"c{k}" for k in range(16)]]), [*KEEP, *[f"c{k}" for k in range(16)]], "o")
    return back.select(*KEEP, F.greatest(*[F.abs(F.col(f"o{k}") - F.col(f"c{k}")) for k in range(16)]).alias("worst"))


@query("idct_dc_only", f"WITH {BLOCKS} SELECT {BLOCK}, {out(v='(c0 + 4) >> 3')} FROM bl")
def _(spark, sf):
    return blocks(spark, sf).select(*KEEP, B.idct_dc(F.col("c0")).alias("v"))


def _q(v, q):
    return f"CASE WHEN {v} < 0 THEN -((-({v}) + {q} // 2) // {q}) ELSE ({v} + {q} // 2) // {q} END"


@query("quantize_block", f"WITH {BLOCKS} SELECT {BLOCK}, " + out(**{f"o{k}": _q(f"c{k}", "(img % 20 + 4)" if k else "(img % 9 + 3)") for k in range(16)}) + " FROM bl")
def _(spark, sf):
    return Y.quantized(blocks(spark, sf), KEEP, F.col("img") % 9 + 3, F.col("img") % 20 + 4)


@query("dequantize_block", f"WITH {BLOCKS} SELECT {BLOCK}, " + out(**{f"o{k}": f"c{k} * " + ("(img % 20 + 4)" if k else "(img % 9 + 3)") for k in range(16)}) + " FROM bl")
def _(spark, sf):
    return Y.dequantized(blocks(spark, sf), KEEP, F.col("img") % 9 + 3, F.col("img") % 20 + 4)


@query("quality_to_qp", "SELECT p_partkey, CAST(least(127, greatest(0, trunc((CAST(100 AS FLOAT) - least(CAST(100 AS FLOAT), greatest(CAST(0 AS FLOAT), CAST((p_partkey * 7 % 1300 - 100) / 10 AS FLOAT)))) * CAST(127 AS FLOAT) / CAST(100 AS FLOAT)))) AS BIGINT) AS qp FROM part")
def _(spark, sf):
    return read(spark, sf, "part").select("p_partkey", P.quality_to_qp(F.expr("(p_partkey * 7 % 1300 - 100) / 10D")).alias("qp"))


_DC, _AC = (f"[{', '.join(map(str, t))}]" for t in (B.DC_STEPS, B.AC_STEPS))
_CL = "least(127, greatest(0, q + {}))"


@query(
    "quant_tables",
    f"WITH t AS (SELECT p_partkey, p_partkey % 160 - 16 AS q0, {_DC} AS dc, {_AC} AS ac FROM part), u AS (SELECT *, least(127, greatest(0, q0)) AS q FROM t) SELECT "
    + out(p_partkey="p_partkey", y_dc=f"dc[{_CL.format(2)} + 1]", y_ac="ac[q + 1]", y2_dc=f"dc[{_CL.format(-3)} + 1] * 2", y2_ac=f"greatest(8, ac[{_CL.format(1)} + 1] * 155 // 100)", uv_dc=f"dc[least(117, {_CL.format(4)}) + 1]", uv_ac=f"ac[{_CL.format(-1)} + 1]")
    + " FROM u",
)
def _(spark, sf):
    q = Y.quantizers(F.col("p_partkey") % 160 - 16, (2, -3, 1, 4, -1))
    return read(spark, sf, "part").select("p_partkey", *[v.alias(k) for k, v in q.items()])


# Prediction: a picture's own last row stands for the row above, its last column for the column to the left.
_BORDER = f"bo AS (SELECT pl.img, pl.i, pl.x, pl.y, pl.v, u.v AS above, l.v AS lef, c.v AS corner, sum(u.v) OVER (PARTITION BY pl.img, pl.y) AS sa, sum(l.v) OVER (PARTITION BY pl.img, pl.x) AS sl, pl.img % 3 <> 0 AS va, pl.img % 2 = 0 AS vl FROM pl JOIN pl u ON u.img = pl.img AND u.y = 7 AND u.x = pl.x JOIN pl l ON l.img = pl.img AND l.x = 7 AND l.y = pl.y JOIN pl c ON c.img = pl.img AND c.i = 63)"
_DCP = "CASE WHEN va AND vl THEN (sa + sl + {n}) >> {n2} WHEN va THEN (sa + {h}) >> {n1} WHEN vl THEN (sl + {h}) >> {n1} ELSE 128 END"
_DC8, _DC16 = _DCP.format(n=8, n2=4, h=4, n1=3), _DCP.format(n=16, n2=5, h=8, n1=4)


def _bordered(spark, sf):
    """planes with border columns, from the picture's array: nothing is joined."""
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("img"), F.transform("embedding", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v.cast("double") * 128) + 128)).cast("int")).alias("vs"))
    at = lambda k: F.get("vs", k)
    rows = e.select("img", "vs", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).withColumns({"x": F.col("i").bitwiseAND(F.lit(7)), "y": F.shiftright("i", 3)})
    total = lambda ks: sum((at(F.lit(k)) for k in ks), F.lit(0))
    return rows.select(
        "img", "i", "x", "y", at(F.col("i")).alias("v"), at(56 + F.col("x")).alias("above"), at(8 * F.col("y") + 7).alias("left"), at(F.lit(63)).alias("corner"), total(range(56, 64)).alias("sum_above"),
        total(range(7, 64, 8)).alias("sum_left"), (F.col("img") % 3 != 0).alias("have_above"), (F.col("img") % 2 == 0).alias("have_left"),
    )


@query("dc_prediction", f"WITH {PLANES}, {_BORDER} SELECT DISTINCT img, {out(v=_DC8)} FROM bo")
def _(spark, sf):
    b = _bordered(spark, sf).where("i = 0")
    return b.select("img", B.dc_prediction(F.col("sum_above"), F.col("sum_left"), 8, F.col("have_above"), F.col("have_left")).alias("v"))


@query("tm_prediction", f"WITH {PLANES}, {_BORDER} SELECT {KEYS}, {out(v='least(255, greatest(0, lef + above - corner))')} FROM bo")
def _(spark, sf):
    return _bordered(spark, sf).select("img", "i", P.gradient(F.col("left"), F.col("above"), F.col("corner")).alias("v"))


def _sad(dc: str) -> str:
    s = {0: (dc, "true"), 1: ("above", "va"), 2: ("lef", "vl"), 3: ("least(255, greatest(0, lef + above - corner))", "va AND vl")}
    sums = ", ".join(f"coalesce(sum(CASE WHEN {ok} THEN abs(v - ({g})) END), 1000000000) AS s{k}" for k, (g, ok) in s.items())
    return f"sd AS (SELECT img, {sums} FROM bo GROUP BY img) SELECT img, {out(mode='CASE least(s0, s1, s2, s3) WHEN s0 THEN 0 WHEN s1 THEN 1 WHEN s2 THEN 2 ELSE 3 END', sad='least(s0, s1, s2, s3)')} FROM sd"


@query("uv_best_mode", f"WITH {PLANES}, {_BORDER}, {_sad(_DC8)}")
def _(spark, sf):
    return Y.best_mode(_bordered(spark, sf), ["img"], 8)


_UP = "bo AS (SELECT b0.img, v, above, lef, corner, sa * 2 AS sa, sl * 2 AS sl, va, vl FROM b0, range(4))"


@query("sad16_best_mode", f"WITH {PLANES}, {_BORDER.replace('bo AS', 'b0 AS', 1)}, {_UP}, {_sad(_DC16)}")
def _(spark, sf):
    big = _bordered(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumns({"sum_above": F.col("sum_above") * 2, "sum_left": F.col("sum_left") * 2})
    return Y.best_mode(big, ["img"], 16)


def _dir_sql(mode):
    v = lambda k: f"c{k}"
    low = mode in ("LD", "VL")
    names = {c: v(12 + k) for k, c in enumerate("pqrs")} | ({c: v(k) for k, c in enumerate("abcdefgh")} if low else {"a": v(15)} | {c: v(k) for k, c in enumerate("bcdefghi")})
    o = []
    for t in (t for row in B.DIRECTIONS[mode] for t in row.split()):
        n = [f"({names[c]} + 128)" for c in t]
        o.append(n[0] if len(n) == 1 else f"({n[0]} + {n[1]} + 1) >> 1" if len(n) == 2 else f"({n[0]} + 2 * {n[1]} + {n[2]} + 2) >> 2")
    return o


_DIR = " UNION ALL ".join(f"SELECT {BLOCK}, '{m}' AS mode, {out(**dict(zip(O16, _dir_sql(m))))} FROM bl" for m in B.DIRECTIONS)


@query("intra4_directional", f"WITH {BLOCKS} {_DIR}")
def _(spark, sf):
    b = [F.col(f"c{k}") + 128 for k in range(16)]
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), *[v.cast("int").alias(f"o{k}") for k, v in enumerate(B.directional(m, b[:8], b[12:], b[15]))]) for m in B.DIRECTIONS])
    return blocks(spark, sf).select(*KEEP, F.explode(modes).alias("m")).select(*KEEP, "m.*")


_LEVEL = "least(63, lv)"
_SHARP = f"CASE WHEN sh > 4 THEN {_LEVEL} >> 2 WHEN sh > 0 THEN {_LEVEL} >> 1 ELSE {_LEVEL} END"
_INNER = f"greatest(1, CASE WHEN sh > 0 THEN least({_SHARP}, 9 - sh) ELSE {_SHARP} END)"


@query("loop_filter_params", "WITH t AS (SELECT p_partkey, p_partkey % 90 - 10 AS lv, p_size % 8 AS sh, p_partkey % 2 = 0 AS kf FROM part) SELECT " + out(p_partkey="p_partkey", level=f"CASE WHEN lv <= 0 THEN 0 ELSE 2 * {_LEVEL} + {_INNER} END", ilevel=f"CASE WHEN lv <= 0 THEN 0 ELSE {_INNER} END", hlevel=f"CASE WHEN lv < 15 THEN 0 WHEN kf THEN CASE WHEN lv < 40 THEN 1 ELSE 2 END WHEN lv < 20 THEN 1 WHEN lv < 40 THEN 2 ELSE 3 END") + " FROM t")
def _(spark, sf):
    f = Y.filter_limits(F.col("p_partkey") % 90 - 10, F.col("p_size") % 8, F.col("p_partkey") % 2 == 0)
    return read(spark, sf, "part").select("p_partkey", *[v.alias(k) for k, v in f.items()])


_E8 = "e AS (SELECT img, i // 8 AS row, " + ", ".join(f"max(CASE WHEN x = {k} THEN v END) AS {n}" for k, n in enumerate(("p3", "p2", "p1", "p0", "q0", "q1", "q2", "q3"))) + " FROM pl GROUP BY img, i // 8)"
_C15 = lambda v: f"least(15, greatest(-16, {v}))"
_C127 = lambda v: f"least(127, greatest(-128, {v}))"
_C255 = lambda v: f"least(255, greatest(0, {v}))"
_A2 = f"(3 * (q0 - p0) + {_C127('p1 - q1')})"
_WEAK = "abs(p0 - q0) * 2 + (abs(p1 - q1) >> 1) <= 40"


def _edges(spark, sf):
    """img, row, p3..p0, q0..q3: each row of a picture as the eight pixels across an edge in its middle."""
    return planes(spark, sf).groupBy("img", F.col("y").alias("row")).agg(*[F.max(F.when(F.col("x") == k, F.col("v"))).alias(n) for k, n in enumerate(("p3", "p2", "p1", "p0", "q0", "q1", "q2", "q3"))])


_ROW = 'CAST(img AS BIGINT) AS img, CAST(row AS BIGINT) AS "row"'


@query("edge_filter_simple", f"WITH {PLANES}, {_E8} SELECT {_ROW}, {out(p0=f'CASE WHEN {_WEAK} THEN ' + _C255('p0 + ' + _C15(f'({_A2} + 3) >> 3')) + ' ELSE p0 END', q0=f'CASE WHEN {_WEAK} THEN ' + _C255('q0 - ' + _C15(f'({_A2} + 4) >> 3')) + ' ELSE q0 END')} FROM e")
def _(spark, sf):
    p1, p0, q0, q1 = (F.col(c) for c in ("p1", "p0", "q0", "q1"))
    weak = B.edge_flat(p1, p0, q0, q1, F.lit(40))
    a, b = B.edge_two(p1, p0, q0, q1)
    return _edges(spark, sf).select("img", "row", F.when(weak, a).otherwise(p0).alias("p0"), F.when(weak, b).otherwise(q0).alias("q0"))


_FLAT = _WEAK + " AND greatest(abs(p3 - p2), abs(p2 - p1), abs(p1 - p0), abs(q1 - q0), abs(q2 - q1), abs(q3 - q2)) <= 12"
_HIGH = "greatest(abs(p1 - p0), abs(q1 - q0)) > 4"
_W = f"({_C127('3 * (q0 - p0) + ' + _C127('p1 - q1'))})"
_A4 = "(3 * (q0 - p0))"
_FAR = _C15(f"({_A4} + 4) >> 3")


def _normal(name, two, four, six):
    return f"CASE WHEN NOT ({_FLAT}) THEN {name} WHEN {_HIGH} THEN {two} WHEN img % 2 = 0 THEN {four} ELSE {six} END"


@query(
    "edge_filter_normal",
    f"WITH {PLANES}, {_E8} SELECT {_ROW}, "
    + out(
        p2=_normal("p2", "p2", "p2", _C255(f"p2 + ((9 * {_W} + 63) >> 7)")),
        p1=_normal("p1", "p1", _C255(f"p1 + (({_FAR} + 1) >> 1)"), _C255(f"p1 + ((18 * {_W} + 63) >> 7)")),
        p0=_normal("p0", _C255("p0 + " + _C15(f"({_A2} + 3) >> 3")), _C255("p0 + " + _C15(f"({_A4} + 3) >> 3")), _C255(f"p0 + ((27 * {_W} + 63) >> 7)")),
        q0=_normal("q0", _C255("q0 - " + _C15(f"({_A2} + 4) >> 3")), _C255(f"q0 - {_FAR}"), _C255(f"q0 - ((27 * {_W} + 63) >> 7)")),
        q1=_normal("q1", "q1", _C255(f"q1 - (({_FAR} + 1) >> 1)"), _C255(f"q1 - ((18 * {_W} + 63) >> 7)")),
        q2=_normal("q2", "q2", "q2", _C255(f"q2 - ((9 * {_W} + 63) >> 7)")),
    )
    + " FROM e",
)
def _(spark, sf):
    p3, p2, p1, p0, q0, q1, q2, q3 = (F.col(c) for c in ("p3", "p2", "p1", "p0", "q0", "q1", "q2", "q3"))
    steps = F.greatest(*[F.abs(a - b) for a, b in ((p3, p2), (p2, p1), (p1, p0), (q1, q0), (q2, q1), (q3, q2))])
    flat = B.edge_flat(p1, p0, q0, q1, F.lit(40)) & (steps <= 12)
    high = F.greatest(F.abs(p1 - p0), F.abs(q1 - q0)) > 4
    two, four, six = B.edge_two(p1, p0, q0, q1), B.edge_four(p1, p0, q0, q1), B.edge_six(p2, p1, p0, q0, q1, q2)
    old = dict(p2=p2, p1=p1, p0=p0, q0=q0, q1=q1, q2=q2)
    t = old | dict(p0=two[0], q0=two[1])
    f = old | dict(zip(("p1", "p0", "q0", "q1"), four))
    s = dict(zip(old, six))
    pick = lambda n: F.when(~flat, old[n]).when(high, t[n]).when(F.col("img") % 2 == 0, f[n]).otherwise(s[n])
    return _edges(spark, sf).select("img", "row", *[pick(n).alias(n) for n in old])


_TOKENS = ((1, "zero"), (2, "one"), (3, "two"), (4, "three"), (5, "four"), (7, "cat1"), (11, "cat2"), (19, "cat3"), (35, "cat4"), (67, "cat5"))


@query("token_category", f"WITH {PLANES} SELECT img, CASE " + " ".join(f"WHEN abs(v - 128) < {n} THEN '{t}'" for n, t in _TOKENS) + " ELSE 'cat6' END AS token, count(*) AS n FROM pl GROUP BY ALL")
def _(spark, sf):
    return planes(spark, sf).groupBy("img", Y.token_category(F.col("v") - 128).alias("token")).agg(F.count("*").alias("n"))


@query("nz_context", f"WITH {PLANES} SELECT {KEYS}, {out(ctx='CASE WHEN lag(v, 1, 128) OVER w > 130 THEN 1 ELSE 0 END + CASE WHEN lag(v, 8, 128) OVER w > 130 THEN 1 ELSE 0 END')} FROM pl WINDOW w AS (PARTITION BY img ORDER BY i)")
def _(spark, sf):
    from ..operators.alpha import in_order

    one = lambda n: F.when(F.lag("v", n, 128).over(in_order()) > 130, 1).otherwise(0)
    return planes(spark, sf).select("img", "i", (one(1) + one(W)).alias("ctx"))


@query("zigzag_order", f"WITH {BLOCKS} SELECT {BLOCK}, array_to_string([{', '.join(f'CAST(c{k} AS BIGINT)' for k in B.ZIGZAG)}], ',') AS scan, list_has_any([true], [{', '.join(f'abs(c{k}) > 60' for k in B.ZIGZAG[1:])}]) AS any_ac FROM bl")
def _(spark, sf):
    scan = F.array(*[F.col(f"c{k}").cast("long") for k in B.ZIGZAG])
    return blocks(spark, sf).select(*KEEP, F.array_join(scan.cast("array<string>"), ",").alias("scan"), F.exists(F.slice(scan, 2, 15), lambda c: F.abs(c) > 60).alias("any_ac"))


# A 4x4 block: the upper left quarter of a picture, with the borders as above.
_QUARTER = "bo AS (SELECT img, i, x, y, v, above, lef, corner, sum(above) OVER (PARTITION BY img, y) AS sa, sum(lef) OVER (PARTITION BY img, x) AS sl, va, vl FROM b0 WHERE x < 4 AND y < 4)"
_DC4 = _DCP.format(n=4, n2=3, h=2, n1=2)


def _quarter(spark, sf):
    four = lambda side, along: F.sum(side).over(Window.partitionBy("img", along))
    rows = _bordered(spark, sf).where("x < 4 AND y < 4")
    return rows.withColumns({"sum_above": four("above", "y"), "sum_left": four("left", "x")})


@query("intra4_best_mode", f"WITH {PLANES}, {_BORDER.replace('bo AS', 'b0 AS', 1)}, {_QUARTER}, {_sad(_DC4)}")
def _(spark, sf):
    return Y.best_mode(_quarter(spark, sf), ["img"], 4)


@query("intra4_lines", f"WITH {PLANES}, {_BORDER.replace('bo AS', 'b0 AS', 1)}, {_QUARTER} SELECT {KEYS}, {out(vertical='above', horizontal='lef')} FROM bo")
def _(spark, sf):
    return Y.line_predictions(_quarter(spark, sf)).select("img", "i", "vertical", "horizontal")
