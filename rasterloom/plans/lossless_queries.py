"""Queries over lossless transforms and alpha planes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codecs.lossless import NEAR
from ..functions import pixels as P
from ..operators import alpha as A
from ..operators import lossless as L
from ..operators import metrics as M
from .fixtures import LENGTHS, PLANES, PX, W, lengths, planes, px, read

QUERIES: dict = {}
SQL: dict[str, str] = {}
BITS = 2


def longs(df: DataFrame) -> DataFrame:
    """All whole numbers as BIGINT, as the SQL gives them."""
    return df.select(*[F.col(f.name).cast("long").alias(f.name) if f.dataType.simpleString() in ("int", "smallint", "tinyint") else F.col(f.name) for f in df.schema.fields])


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = lambda spark, sf_dir: longs(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return put


def out(**columns: str) -> str:
    return ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in columns.items())


KEYS = out(img="img", i="i")


@query("subtract_green", f"WITH {PX} SELECT {KEYS}, {out(a='a', r='(r - g) & 255', g='g', b='(b - g) & 255')} FROM px")
def _(spark, sf):
    return L.subtract_green(px(spark, sf)).select("img", "i", "a", "r", "g", "b")


@query("inverse_subtract_green", f"WITH {PX} SELECT {KEYS}, {out(a='a', r='(r + g) & 255', g='g', b='(b + g) & 255')} FROM px")
def _(spark, sf):
    return L.add_green(px(spark, sf)).select("img", "i", "a", "r", "g", "b")


@query("argb_pack_unpack", f"WITH {PX} SELECT {KEYS}, {out(argb='a * 16777216 + r * 65536 + g * 256 + b', r2='r', b2='b')} FROM px")
def _(spark, sf):
    rows = px(spark, sf).select("img", "i", P.pack(P.pixel()).alias("argb"))
    back = P.unpack(F.col("argb"))
    return rows.select("img", "i", "argb", back.r.alias("r2"), back.b.alias("b2"))


@query("argb_arithmetic", f"WITH {PX}, n AS (SELECT *, lag(a, 1, 0) OVER w AS pa, lag(r, 1, 0) OVER w AS pr, lag(g, 1, 0) OVER w AS pg, lag(b, 1, 0) OVER w AS pb FROM px WINDOW w AS (PARTITION BY img ORDER BY i)) SELECT {KEYS}, " + out(sum_r="(r + pr) & 255", dif_r="(r - pr) & 255", dist="abs(a - pa) + abs(r - pr) + abs(g - pg) + abs(b - pb)", avg_g="(g + pg) // 2", total="a + r + g + b", cost="least((a - pa) & 255, 256 - ((a - pa) & 255)) + least((r - pr) & 255, 256 - ((r - pr) & 255)) + least((g - pg) & 255, 256 - ((g - pg) & 255)) + least((b - pb) & 255, 256 - ((b - pb) & 255))") + " FROM n")
def _(spark, sf):
    near = px(spark, sf).withColumns({"p" + c: F.lag(c, 1, 0).over(L.in_order()) for c in "argb"})
    p, q = P.pixel(), P.pixel("p")
    return near.select("img", "i", P.add(p, q).r.alias("sum_r"), P.subtract(p, q).r.alias("dif_r"), P.distance(p, q).alias("dist"), P.average(p, q).g.alias("avg_g"), P.channel_sum(p).alias("total"), P.residual_cost(P.subtract(p, q)).alias("cost"))


_FILTER = {
    "none": "0",
    "horizontal": "CASE WHEN x = 0 AND y = 0 THEN 0 WHEN x = 0 THEN t ELSE l END",
    "vertical": "CASE WHEN x = 0 AND y = 0 THEN 0 WHEN y = 0 THEN l ELSE t END",
    "gradient": "CASE WHEN x = 0 AND y = 0 THEN 0 WHEN y = 0 THEN l WHEN x = 0 THEN t ELSE least(255, greatest(0, l + t - c)) END",
}
for _kind, _guess in _FILTER.items():

    @query(f"alpha_filter_{_kind}", f"WITH {PLANES} SELECT {KEYS}, {out(v=f'(v - ({_guess})) & 255')} FROM (SELECT *, lag(v, 1, 0) OVER w AS l, lag(v, {W}, 0) OVER w AS t, lag(v, {W + 1}, 0) OVER w AS c FROM pl WINDOW w AS (PARTITION BY img ORDER BY i))")
    def _(spark, sf, kind=_kind):
        return A.apply_filter(planes(spark, sf), W, kind).select("img", "i", "v")

    if _kind != "none":

        @query(f"alpha_reverse_{_kind}", f"WITH {PLANES} SELECT {KEYS}, {out(v='v')} FROM pl")
        def _(spark, sf, kind=_kind):
            return A.reverse_filter(A.apply_filter(planes(spark, sf), W, kind), W, kind).select("img", "i", "v")


@query("alpha_quantize", f"WITH {PLANES} SELECT {KEYS}, {out(v4='floor(least(3, floor(v / 64.0)) * 64.0 + 32)', v6='floor(least(5, floor(v / (256.0 / 6))) * (256.0 / 6) + (256.0 / 6) / 2)', v256='v')} FROM pl")
def _(spark, sf):
    return planes(spark, sf).select("img", "i", P.quantize_level(F.col("v"), 4).alias("v4"), P.quantize_level(F.col("v"), 6).alias("v6"), P.quantize_level(F.col("v"), 256).alias("v256"))


@query("alpha_extract", f"WITH {PX} SELECT {KEYS}, {out(v='a')} FROM px")
def _(spark, sf):
    return A.extract(px(spark, sf)).select("img", "i", "v")


@query("alpha_apply_left_join", f"WITH {PX}, {PLANES} SELECT px.img AS img, CAST(px.i AS BIGINT) AS i, {out(a='coalesce(v, 255)', r='r', g='g', b='b')} FROM px LEFT JOIN (SELECT * FROM pl WHERE i < 40) p ON p.img = px.img AND p.i = px.i")
def _(spark, sf):
    return A.attach(px(spark, sf), planes(spark, sf).where("i < 40")).select("img", "i", "a", "r", "g", "b")


@query("has_alpha", f"WITH {PX} SELECT img, bool_or(CASE WHEN img % 2 = 0 THEN 255 ELSE a END <> 255) AS has_alpha FROM px GROUP BY img")
def _(spark, sf):
    return A.has_alpha(px(spark, sf).withColumn("a", F.when(F.col("img") % 2 == 0, 255).otherwise(F.col("a"))))


_ARGB = "a * 16777216 + r * 65536 + g * 256 + b"
_FEW = f"few AS (SELECT img, i, x, y, CAST(255 AS BIGINT) AS a, r // 64 * 64 AS r, 0 AS g, 0 AS b FROM px), cl AS (SELECT img, argb, row_number() OVER (PARTITION BY img ORDER BY f) - 1 AS idx FROM (SELECT img, {_ARGB} AS argb, min(i) AS f FROM few GROUP BY ALL))"


def _few(spark, sf):
    """At most four colors in a picture."""
    return px(spark, sf).withColumns({"a": F.lit(255), "r": F.shiftright("r", 6) * 64, "g": F.lit(0), "b": F.lit(0)})


@query("palette_build", f"WITH {PX} SELECT img, {out(argb='argb', idx='row_number() OVER (PARTITION BY img ORDER BY f) - 1')} FROM (SELECT img, {_ARGB} AS argb, min(i) AS f FROM px GROUP BY ALL)")
def _(spark, sf):
    return L.palette(px(spark, sf))


@query("palette_index", f"WITH {PX}, {_FEW} SELECT {out(img='few.img', x='x', y='y', idx='idx')} FROM few JOIN cl ON few.img = cl.img AND {_ARGB} = argb")
def _(spark, sf):
    rows = _few(spark, sf)
    return L.palette_indices(rows, L.palette(rows))


_PACKED = f"pk AS (SELECT few.img, x // 4 AS x, y, sum(idx << ((x % 4) * 2)) AS packed FROM few JOIN cl ON few.img = cl.img AND {_ARGB} = argb GROUP BY few.img, x // 4, y)"


@query("palette_pack", f"WITH {PX}, {_FEW}, {_PACKED} SELECT {out(img='img', x='x', y='y', packed='packed')} FROM pk")
def _(spark, sf):
    rows = _few(spark, sf)
    return L.pack_indices(L.palette_indices(rows, L.palette(rows)), 2)


@query("palette_expand", f"WITH {PX}, {_FEW} SELECT {out(img='few.img', x='x', y='y', argb='CASE WHEN idx < 2 THEN argb ELSE 0 END')} FROM few JOIN cl ON few.img = cl.img AND {_ARGB} = argb")
def _(spark, sf):
    rows = _few(spark, sf)
    colors = L.palette(rows)
    back = L.unpack_indices(L.pack_indices(L.palette_indices(rows, colors), 2), 2, W)
    return L.palette_expand(back, colors.where("idx < 2"))


@query("palette_delta_roundtrip", f"WITH {PX} SELECT img, {out(idx='row_number() OVER (PARTITION BY img ORDER BY f) - 1', argb='argb')} FROM (SELECT img, {_ARGB} AS argb, min(i) AS f FROM px GROUP BY ALL)")
def _(spark, sf):
    return L.palette_from_deltas(L.palette_deltas(L.palette(px(spark, sf))))


@query("palette_sum_order", f"WITH {PX} SELECT img, {out(argb='argb', rank='row_number() OVER (PARTITION BY img ORDER BY s, argb)')} FROM (SELECT DISTINCT img, {_ARGB} AS argb, a + r + g + b AS s FROM px)")
def _(spark, sf):
    from pyspark.sql import Window

    rows = L.palette(px(spark, sf)).withColumn("s", P.channel_sum(P.unpack(F.col("argb"))))
    return rows.select("img", "argb", F.row_number().over(Window.partitionBy("img").orderBy("s", "argb")).alias("rank"))


@query("color_cache_hash", f"WITH {PX} SELECT {KEYS}, {out(s4=f'((({_ARGB}) * 506832829) % 4294967296) >> 28', s10=f'((({_ARGB}) * 506832829) % 4294967296) >> 22')} FROM px")
def _(spark, sf):
    argb = P.pack(P.pixel())
    return px(spark, sf).select("img", "i", P.cache_slot(argb, 4).alias("s4"), P.cache_slot(argb, 10).alias("s10"))


@query("color_cache_asof", f"WITH {PX}, s AS (SELECT img, i, {_ARGB} AS argb, ((({_ARGB}) * 506832829) % 4294967296) >> 28 AS slot FROM px) SELECT {KEYS}, {out(argb='argb', slot='slot', cached='coalesce(last_value(argb) OVER (PARTITION BY img, slot ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} FROM s")
def _(spark, sf):
    return L.cache_reads(px(spark, sf), 4)


def _sql_modes() -> tuple[str, list[list[str]]]:
    """(CTE nb with neighbours, for each mode the four channels' predictions) in SQL."""
    near = ", ".join(f"lag({c}, {n}) OVER w AS {p}{c}" for p, n in (("l", 1), ("t", W), ("c", W + 1), ("e", W - 1)) for c in "argb")
    nb = f"n0 AS (SELECT *, {near} FROM px WINDOW w AS (PARTITION BY img ORDER BY i)), nb AS (SELECT *, " + ", ".join(f"CASE WHEN x = {W - 1} THEN t{c} ELSE e{c} END AS d{c}" for c in "argb") + " FROM n0)"
    avg = lambda p, q: f"(({p}) + ({q})) // 2"
    dist = lambda p: " + ".join(f"abs(c{k} - {p}{k})" for k in "argb")
    clip = lambda v: f"least(255, greatest(0, {v}))"
    modes = [
        ["255", "0", "0", "0"],
        *[[f"{p}{c}" for c in "argb"] for p in "ltdc"],
        [avg(avg(f"l{c}", f"d{c}"), f"t{c}") for c in "argb"],
        *[[avg(f"{p}{c}", f"{q}{c}") for c in "argb"] for p, q in ("lc", "lt", "ct", "td")],
        [avg(avg(f"l{c}", f"c{c}"), avg(f"t{c}", f"d{c}")) for c in "argb"],
        [f"CASE WHEN {dist('l')} < {dist('t')} THEN l{c} ELSE t{c} END" for c in "argb"],
        [clip(f"l{c} + t{c} - c{c}") for c in "argb"],
        [clip(f"{avg(f'l{c}', f't{c}')} + ({avg(f'l{c}', f't{c}')} - c{c}) // 2") for c in "argb"],
    ]
    border = lambda c, v: f"CASE WHEN y = 0 THEN l{c} WHEN x = 0 THEN t{c} ELSE {v} END"
    return nb, [[border(c, v) for c, v in zip("argb", m)] for m in modes]


_NB, _MODES = _sql_modes()
_COST = lambda m: "CASE WHEN i = 0 THEN 0 ELSE " + " + ".join(f"least(({c} - ({v})) & 255, 256 - (({c} - ({v})) & 255))" for c, v in zip("argb", m)) + " END"
_COSTS = "co AS (SELECT img, x >> 2 AS bx, y >> 2 AS \"by\", " + ", ".join(f"sum({_COST(m)}) AS k{n}" for n, m in enumerate(_MODES)) + " FROM nb GROUP BY ALL)"
_LEAST = "least(" + ", ".join(f"k{n}" for n in range(14)) + ")"
_BEST = f"be AS (SELECT img, bx, \"by\", CASE " + " ".join(f"WHEN k{n} = {_LEAST} THEN {n}" for n in range(14)) + f" END AS mode, {_LEAST} AS cost FROM co)"


@query("predict_modes_14", f"WITH {PX}, {_NB} SELECT {KEYS}, " + out(**{f"p{n}": "CASE WHEN i = 0 THEN 0 ELSE " + " + ".join(f"({v}) * {k}" for v, k in zip(m, (1, 3, 5, 7))) + " END" for n, m in enumerate(_MODES)}) + " FROM nb")
def _(spark, sf):
    near = L.neighbours(px(spark, sf), W)
    return near.select("img", "i", *[(p.a + 3 * p.r + 5 * p.g + 7 * p.b).alias(f"p{n}") for n, p in enumerate(L._predicted())])


@query("predictor_best_mode", f"WITH {PX}, {_NB}, {_COSTS}, {_BEST} SELECT img, {out(bx='bx', by='\"by\"', mode='mode', cost='cost')} FROM be".replace("AS by", 'AS "by"'))
def _(spark, sf):
    return L.predictor_modes(px(spark, sf), W, BITS)


@query("predictor_residual", f"WITH {PX}, {_NB}, {_COSTS}, {_BEST} SELECT nb.img AS img, CAST(i AS BIGINT) AS i, " + out(**{c: f"CASE WHEN i = 0 THEN {c} ELSE ({c} - (CASE " + " ".join(f"WHEN mode = {n} THEN {m[k]}" for n, m in enumerate(_MODES)) + " END)) & 255 END" for k, c in enumerate("argb")}) + ' FROM nb JOIN be ON be.img = nb.img AND be.bx = nb.x >> 2 AND be."by" = nb.y >> 2')
def _(spark, sf):
    rows = px(spark, sf)
    return L.predictor_residual(rows, L.predictor_modes(rows, W, BITS), W, BITS).select("img", "i", "a", "r", "g", "b")


_I8 = "least(127, greatest(-128, {}))"
_COLOR = (
    'c1 AS (SELECT *, x >> 2 AS bx, y >> 2 AS "by" FROM px), c2 AS (SELECT img, bx, "by", sum(g * g) AS gg, sum(g * r) AS gr, sum(g * b) AS gb FROM c1 GROUP BY ALL), '
    f"c3 AS (SELECT img, bx, \"by\", CASE WHEN gg > 0 THEN {_I8.format('(32 * gr) // gg')} ELSE 0 END AS g_to_r, CASE WHEN gg > 0 THEN {_I8.format('(32 * gb) // gg')} ELSE 0 END AS g_to_b FROM c2), "
    'c4 AS (SELECT c1.*, CAST(g_to_r AS BIGINT) AS g_to_r, CAST(g_to_b AS BIGINT) AS g_to_b, ((r - ((CAST(g_to_r AS BIGINT) * g) >> 5)) & 255) + ((CAST(g_to_r AS BIGINT) * g) >> 5) AS red FROM c1 JOIN c3 USING (img, bx, "by")), '
    'c5 AS (SELECT img, bx, "by", g_to_r, g_to_b, sum(red * red) AS rr, sum(red * (b - ((g_to_b * g) >> 5))) AS rb FROM c4 GROUP BY ALL), '
    f"c6 AS (SELECT img, bx, \"by\", g_to_r, g_to_b, CAST(CASE WHEN rr > 0 THEN {_I8.format('(32 * rb) // rr')} ELSE 0 END AS BIGINT) AS r_to_b FROM c5)"
)


@query("color_transform_coeffs", f'WITH {PX}, {_COLOR} SELECT img, CAST(bx AS BIGINT) AS bx, CAST("by" AS BIGINT) AS "by", {out(g_to_r="g_to_r", g_to_b="g_to_b", r_to_b="r_to_b")} FROM c6')
def _(spark, sf):
    return L.color_coefficients(px(spark, sf), BITS)


@query("color_transform_apply", f'WITH {PX}, {_COLOR} SELECT {KEYS}, {out(a="a", r="(r - ((c4.g_to_r * g) >> 5)) & 255", g="g", b="(b - ((c4.g_to_b * g) >> 5) - ((r_to_b * red) >> 5)) & 255")} FROM c4 JOIN c6 USING (img, bx, "by")')
def _(spark, sf):
    rows = px(spark, sf)
    return L.color_transform(rows, L.color_coefficients(rows, BITS), BITS).select("img", "i", "a", "r", "g", "b")


@query("color_transform_roundtrip", f"WITH {PX} SELECT {KEYS}, {out(a='a', r='r', g='g', b='b')} FROM px")
def _(spark, sf):
    rows = px(spark, sf)
    own = L.color_coefficients(rows, BITS)
    return L.color_transform(L.color_transform(rows, own, BITS), own, BITS, inverse=True).select("img", "i", "a", "r", "g", "b")


@query("channel_histogram", f"WITH {PX} SELECT img, channel, {out(sym='sym', n='count(*)')} FROM (SELECT img, unnest(['a', 'r', 'g', 'b']) AS channel, unnest([a, (r - g) & 255, g, (b - g) & 255]) AS sym FROM px) GROUP BY img, channel, sym")
def _(spark, sf):
    return L.histograms(L.subtract_green(px(spark, sf)))


_REVERSED = "(" + " + ".join(f"((code >> {k}) & 1) << (len - 1 - {k})" for k in range(1)) + ")"


@query(
    "canonical_codes",
    f"WITH {LENGTHS}, k AS (SELECT *, coalesce(sum(CAST(1 AS BIGINT) << (15 - len)) OVER (PARTITION BY grp ORDER BY len RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS space, row_number() OVER (PARTITION BY grp, len ORDER BY sym) AS nth FROM le), "
    "c AS (SELECT grp, sym, len, (CAST(space AS BIGINT) >> (15 - len)) + nth - 1 AS code FROM k) SELECT " + out(grp="grp", sym="sym", len="len", code="code", reversed="(SELECT sum(((code >> j) & 1) << (len - 1 - j)) FROM range(len) t(j))") + " FROM c",
)
def _(spark, sf):
    return L.canonical_codes(lengths(spark, sf))


@query("kraft_sum", f"WITH {LENGTHS} SELECT CAST(grp AS BIGINT) AS grp, sum(pow(2.0, -len)) AS kraft FROM le GROUP BY grp")
def _(spark, sf):
    return M.kraft(lengths(spark, sf))


def _bases(codes: int) -> str:
    return "(VALUES " + ", ".join(f"({k}, {b}, {e})" for k, (b, e) in enumerate(L.prefix_bases(codes))) + ") t(code, base, bits)"


_RANGE = "SELECT {key} AS p_partkey, {v} AS value, arg_max(code, base) + {first} AS code, arg_max(bits, base) AS extra_bits, {v} - max(base) AS extra FROM part JOIN {bases} ON base <= {v} GROUP BY {key}, {v}"


def _prefix(name: str, expr: str, codes: int, first: int) -> None:
    inner = _RANGE.format(key="p_partkey", v=f"({expr})", first=first, bases=_bases(codes))
    columns = out(p_partkey="p_partkey", value="value", code="code", extra_bits="extra_bits", extra="extra")

    @query(name, f"SELECT {columns} FROM ({inner})")
    def _(spark, sf):
        return L.prefix_codes(read(spark, sf, "part").select("p_partkey", F.expr(expr).alias("value")), "value", codes, first)


_prefix("length_code_range_join", "p_partkey * 37 % 4096 + 1", 24, 256)
_prefix("distance_code_range_join", "p_partkey * 7919 % 1048576 + 1", 40, 0)


@query("distance_to_plane", f"WITH n AS (SELECT [{', '.join(map(str, NEAR))}] AS t) SELECT " + out(p_partkey="p_partkey", pixels="CASE WHEN c > 120 THEN c - 120 ELSE greatest(1, (t[least(c, 120)] >> 4) * w + 8 - (t[least(c, 120)] & 15)) END") + " FROM (SELECT p_partkey, p_partkey % 200 + 1 AS c, p_size * 4 AS w FROM part), n")
def _(spark, sf):
    return read(spark, sf, "part").select("p_partkey", L.plane_distance(F.col("p_partkey") % 200 + 1, F.col("p_size") * 4).alias("pixels"))


_RLE = f"{LENGTHS}, q AS (SELECT grp, sym, len // 4 AS len FROM le), s AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY sym) - row_number() OVER (PARTITION BY grp, len ORDER BY sym) AS island FROM q)"


@query("code_length_rle", f"WITH {_RLE} SELECT {out(grp='grp', start='min(sym)', value='len', n='count(*)')} FROM s GROUP BY grp, len, island")
def _(spark, sf):
    return L.run_lengths(lengths(spark, sf).withColumn("len", F.shiftright("len", 2)))


@query("distinct_levels", f"WITH {PLANES} SELECT img, count(DISTINCT v) AS levels FROM pl GROUP BY img")
def _(spark, sf):
    return M.distinct_levels(planes(spark, sf))


_OTHER = f"o AS (SELECT img, i, r & 240 AS r, g & 240 AS g, CASE WHEN img % 3 = 0 THEN b ELSE b & 240 END AS b FROM px)"
_ERR = "(px.r - o.r) * (px.r - o.r) + (px.g - o.g) * (px.g - o.g) + (px.b - o.b) * (px.b - o.b)"


def _coarse(rows: DataFrame) -> DataFrame:
    low = lambda c: F.col(c).bitwiseAND(F.lit(240))
    return rows.withColumns({"r": low("r"), "g": low("g"), "b": F.when(F.col("img") % 3 == 0, F.col("b")).otherwise(low("b"))})


@query("psnr", f"WITH {PX}, {_OTHER} SELECT img, round(mse, 6) AS mse, round(CASE WHEN mse = 0 THEN 999.0 ELSE 10 * log10(65025.0 / mse) END, 6) AS psnr FROM (SELECT px.img AS img, sum({_ERR})::DOUBLE / (count(*) * 3) AS mse FROM px JOIN o ON px.img = o.img AND px.i = o.i GROUP BY px.img)")
def _(spark, sf):
    rows = px(spark, sf)
    return M.psnr(rows, _coarse(rows)).select("img", F.round("mse", 6).alias("mse"), F.round("psnr", 6).alias("psnr"))


@query("max_abs_error", f"WITH {PX}, {_OTHER} SELECT px.img AS img, {out(max_error='max(greatest(abs(px.r - o.r), abs(px.g - o.g), abs(px.b - o.b)))')} FROM px JOIN o ON px.img = o.img AND px.i = o.i GROUP BY px.img")
def _(spark, sf):
    rows = px(spark, sf)
    return M.max_abs_error(rows, _coarse(rows))


@query("pixel_identical", f"WITH {PX} SELECT img, bool_and(b = CASE WHEN img % 2 = 0 THEN b ELSE b & 240 END) AS identical FROM px GROUP BY img")
def _(spark, sf):
    rows = px(spark, sf)
    return M.identical(rows, rows.withColumn("b", F.when(F.col("img") % 2 == 0, F.col("b")).otherwise(F.col("b").bitwiseAND(F.lit(240)))))


@query("lz77_hash", f"WITH {PX} SELECT {KEYS}, {out(slot=f'(({_ARGB}) * 506832829) % 4294967296 // 16384')} FROM px")
def _(spark, sf):
    return px(spark, sf).select("img", "i", L.lz77_hash(P.pack(P.pixel())).alias("slot"))


_NEAR = f"[{', '.join(map(str, NEAR))}]"
_REFERENCES = f"re AS (SELECT l_orderkey AS img, l_linenumber AS n, l_partkey % 300 AS distance, l_orderkey % 40 + 1 AS width, list_position(list_transform({_NEAR}, lambda k: greatest(1, (k >> 4) * (l_orderkey % 40 + 1) + 8 - (k & 15))), greatest(1, l_partkey % 300)) AS place FROM lineitem), pd AS (SELECT img, n, distance, CASE WHEN distance <= 0 THEN 1 WHEN coalesce(place, 0) > 0 THEN place ELSE distance + 120 END AS value FROM re)"


def _references(spark, sf):
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("img"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 300).alias("distance"), (F.col("l_orderkey") % 40 + 1).alias("width"))


@query("distance_value", f"WITH {_REFERENCES} SELECT {out(img='img', n='n', value='value')} FROM pd")
def _(spark, sf):
    return _references(spark, sf).select("img", "n", L.distance_value(F.col("distance"), F.col("width")).alias("value"))


_FIRSTS = f"[{', '.join(str(first) for first, _ in L.prefix_bases(40))}]"


@query("distance_histogram", f"WITH {_REFERENCES}, co AS (SELECT img, len(list_filter({_FIRSTS}, lambda k: k <= value)) - 1 AS code, 1 AS one FROM pd UNION ALL SELECT DISTINCT img, 0, 0 FROM pd) SELECT {out(img='img', code='code', n='CASE WHEN code = 0 THEN greatest(1, sum(one)) ELSE sum(one) END')} FROM co GROUP BY img, code")
def _(spark, sf):
    return L.distance_histogram(_references(spark, sf))


@query("lossless_limits", "SELECT p_partkey, w > 0 AND h > 0 AS stream, w > 0 AND h > 0 AND w <= 16384 AND h <= 16384 AS header, p_partkey % 14 BETWEEN 1 AND 11 AS cache FROM (SELECT p_partkey, p_partkey * 37 % 20000 - 100 AS w, p_partkey * 53 % 20000 - 100 AS h FROM part)")
def _(spark, sf):
    w, h = F.col("p_partkey") * 37 % 20000 - 100, F.col("p_partkey") * 53 % 20000 - 100
    return read(spark, sf, "part").select("p_partkey", L.stream_fits(w, h).alias("stream"), L.header_fits(w, h).alias("header"), L.cache_fits(F.col("p_partkey") % 14).alias("cache"))


@query("psnr_luma", f"WITH {PLANES} SELECT img, round(mse, 6) AS mse, CASE WHEN mse = 0 THEN 'inf (lossless)' ELSE printf('%.2f dB', 10 * log10(65025.0 / mse)) END AS said FROM (SELECT img, avg((v - w) * (v - w))::DOUBLE AS mse FROM (SELECT img, v, least(255, v + (img + i) % (img % 4 + 1)) AS w FROM pl) GROUP BY img)")
def _(spark, sf):
    one = planes(spark, sf)
    two = one.withColumn("v", F.least(F.lit(255), F.col("v") + (F.col("img") + F.col("i")) % (F.col("img") % 4 + 1)))
    return M.psnr(one, two, "v").select("img", F.round("mse", 6).alias("mse"), M.psnr_text(F.col("mse")).alias("said"))
