"""Queries over containers, bits and whole codecs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codecs import alpha, image, lossless, lossy, prefix, riff
from ..functions import bytes as Y
from ..operators import images as I
from ..operators import lossless as L
from ..operators import metrics as M
from .fixtures import FRAMES, H, PLANES, W, frames, planes, px, read
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


_BYTE = lambda v, k: f"lpad(upper(to_hex((CAST({v} AS BIGINT) >> {8 * k}) & 255)), 2, '0')"
_LE = lambda v, n: " || ".join(_BYTE(v, k) for k in range(n))
_PAY = "encode(coalesce(text, ''))"
_HEX = f"hex({_PAY})"
_SIZE = f"octet_length({_PAY})"
_DOC = "doc_id"


@query("riff_chunk_write", f"SELECT {_DOC}, sha256(unhex('54455854' || {_LE(_SIZE, 4)} || {_HEX} || CASE WHEN {_SIZE} % 2 = 1 THEN '00' ELSE '' END)) AS digest, CAST(8 + {_SIZE} + {_SIZE} % 2 AS BIGINT) AS size FROM documents")
def _(spark, sf):
    p = F.coalesce("text", F.lit("")).cast("binary")
    return read(spark, sf, "documents").select("doc_id", F.sha2(Y.chunk("TEXT", p), 256).alias("digest"), Y.chunk_size(F.octet_length(p)).alias("size"))


@query("riff_header", f"SELECT {_DOC}, '52494646' || {_LE(f'{_SIZE} + 4', 4)} || '57454250' AS header, {_DOC} % 3 <> 0 AS valid FROM documents")
def _(spark, sf):
    d = read(spark, sf, "documents")
    head = Y.file_header(F.octet_length(F.coalesce("text", F.lit(""))) + 4)
    broken = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(b"RIFX"), F.substring(head, 5, 8))).otherwise(head)
    return d.select("doc_id", F.hex(head).alias("header"), Y.is_webp(broken).alias("valid"))


@query("vp8x_flags", "SELECT o_orderkey, " + " || ".join((_LE("o_orderkey % 64", 4), _LE("o_orderkey * 7 % 9999", 3), _LE("o_custkey * 31 % 16777216", 3))) + " AS payload, " + ", ".join(f"((o_orderkey % 64) >> {b}) & 1 = 1 AS {n}" for n, b in Y.FLAGS.items()) + ", CAST(o_orderkey * 7 % 9999 + 1 AS BIGINT) AS width, CAST(o_custkey * 31 % 16777216 + 1 AS BIGINT) AS height FROM orders")
def _(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = read(spark, sf, "orders").select("o_orderkey", Y.extended_payload(k % 64, k * 7 % 9999 + 1, c * 31 % 16777216 + 1).alias("p"))
    e = Y.parse_extended(F.col("p"))
    return rows.select("o_orderkey", F.hex("p").alias("payload"), *[Y.has_flag(e["flags"], n).alias(n) for n in Y.FLAGS], e["width"].alias("width"), e["height"].alias("height"))


@query("anim_header", "SELECT o_orderkey, " + " || ".join((_LE("o_orderkey % 256", 1), _LE("o_orderkey * 3 % 256", 1), _LE("o_orderkey * 5 % 256", 1), _LE("o_orderkey * 7 % 256", 1), _LE("greatest(0, least(65535, o_orderkey - 100))", 2))) + " AS payload, CAST(o_orderkey * 5 % 256 AS BIGINT) AS red, CAST(greatest(0, least(65535, o_orderkey - 100)) AS BIGINT) AS loops FROM orders")
def _(spark, sf):
    k = F.col("o_orderkey")
    rows = read(spark, sf, "orders").select("o_orderkey", Y.animation_payload(k % 256, k * 3 % 256, k * 5 % 256, k * 7 % 256, k - 100).alias("p"))
    a = Y.parse_animation(F.col("p"))
    return rows.select("o_orderkey", F.hex("p").alias("payload"), a["red"].alias("red"), a["loops"].alias("loops"))


@query("anmf_header", f"WITH {FRAMES} SELECT anim, {out(frame_no='frame_no')}, " + " || ".join((_LE("x // 2", 3), _LE("y // 2", 3), _LE("w - 1", 3), _LE("h - 1", 3), _LE("duration_ms", 3), _LE("dispose + 2 * blend", 1))) + " AS header, " + out(x="x", y="y // 2 * 2", w="w", h="h", duration_ms="duration_ms", dispose="dispose", blend="blend") + " FROM fr")
def _(spark, sf):
    rows = frames(spark, sf).select("anim", "frame_no", Y.frame_header(*(F.col(c) for c in ("x", "y", "w", "h", "duration_ms", "dispose", "blend"))).alias("p"))
    return rows.select("anim", "frame_no", F.hex("p").alias("header"), *[v.alias(k) for k, v in Y.parse_frame(F.col("p")).items()])


@query("alph_header", "SELECT p_partkey, " + _LE("p_partkey % 64", 1) + " AS header, " + out(method="p_partkey % 4", filter="(p_partkey % 64) // 4 % 4", preprocessing="(p_partkey % 64) // 16") + " FROM part")
def _(spark, sf):
    k = F.col("p_partkey") % 64
    rows = read(spark, sf, "part").select("p_partkey", Y.alpha_header(k % 4, F.shiftright(k, 2) % 4, F.shiftright(k, 4)).alias("p"))
    return rows.select("p_partkey", F.hex("p").alias("header"), *[v.alias(n) for n, v in Y.parse_alpha_header(Y.byte_at(F.col("p"), 0)).items()])


@query("vp8_frame_header", "SELECT o_orderkey, " + _LE("((o_orderkey % 524288) << 5) | 16", 3) + " || '9D012A' || " + _LE("o_orderkey % 16384", 2) + " || " + _LE("o_custkey % 16384", 2) + " AS header, true AS key_frame, true AS show, true AS valid, " + out(version="0", part_size="o_orderkey % 524288", width="o_orderkey % 16384", height="o_custkey % 16384") + " FROM orders")
def _(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = read(spark, sf, "orders").select("o_orderkey", Y.lossy_header(k % 524288, k % 16384, c % 16384).alias("p"))
    g = Y.lossy_config(F.col("p"))
    return rows.select("o_orderkey", F.hex("p").alias("header"), *[g[n].alias(n) for n in ("key_frame", "show", "valid", "version", "part_size", "width", "height")])


@query("vp8l_header", "SELECT o_orderkey, " + out(width="o_orderkey * 11 % 16384 + 1", height="o_custkey * 13 % 16384 + 1") + ", o_orderkey % 2 = 1 AS has_alpha, o_orderkey % 5 <> 0 AS valid FROM orders")
def _(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    bits = k * 11 % 16384 + (c * 13 % 16384) * (1 << 14) + (k % 2) * (1 << 28) + F.when(k % 5 == 0, 1 << 29).otherwise(0).cast("long")
    g = Y.lossless_config(F.concat(F.lit(b"\x2f"), Y.number(bits, 4)))
    return read(spark, sf, "orders").select("o_orderkey", *[v.alias(n) for n, v in g.items()])


@query("bit_reading", "SELECT p_partkey, " + out(n5="(v >> 3) & 31", n3="((v & 1) << 2) | (v & 2) | ((v >> 2) & 1)", bit="(v >> 7) & 1") + " FROM (SELECT p_partkey, p_partkey * 37 % 256 AS v FROM part)")
def _(spark, sf):
    bits = Y.bits_of(Y.number(F.col("p_partkey") * 37 % 256, 1))
    return read(spark, sf, "part").select("p_partkey", Y.read_bits(bits, F.lit(0), 5).alias("n5"), Y.read_bits_low_first(bits, F.lit(5), 3).alias("n3"), Y.read_bits(bits, F.lit(0), 1).alias("bit"))


@query("bit_writing", "SELECT p_partkey, " + _LE("((p_partkey % 32) << 3) | (((p_partkey % 8) & 1) << 2) | ((p_partkey % 8) & 2) | (((p_partkey % 8) >> 2) & 1)", 1) + " || " + _LE("(p_partkey % 16) << 4", 1) + " AS packed FROM part")
def _(spark, sf):
    k = F.col("p_partkey")
    bits = F.concat(Y.write_bits(k % 32, 5), Y.write_bits_low_first(k % 8, 3), Y.write_bits(k % 16, 4))
    return read(spark, sf, "part").select("p_partkey", F.hex(Y.flushed(bits)).alias("packed"))


# Whole codecs: what comes back is compared with SQL over the same pixels.


def _files(spark, sf, **options) -> DataFrame:
    """img, content, error of the table's pictures as files."""
    return I.encode(I.gathered(px(spark, sf), W, H), **options)


@query("riff_chunks_udtf", "SELECT vec_id AS img, CAST(0 AS BIGINT) AS idx, 'VP8L' AS name, true AS framed FROM embeddings")
def _(spark, sf):
    rows = I.chunks(_files(spark, sf).withColumn("whole", F.octet_length("content")).select("img", "whole", "content"))
    return rows.select("img", "idx", "name", (F.col("whole") == 12 + Y.chunk_size(F.col("size"))).alias("framed"))


@query("decode_config", f"WITH {PLANES} SELECT DISTINCT img, 'VP8L' AS codec, {out(width='8', height='8')}, true AS alpha FROM pl")
def _(spark, sf):
    return _files(spark, sf).select("img", *[v.alias(k) for k, v in Y.image_config(F.col("content")).items()])


@query("lossless_roundtrip", None)
def _(spark, sf):
    return I.exploded(I.decode(_files(spark, sf).select("img", "content"))).select("img", "i", "a", "r", "g", "b")


SQL["lossless_roundtrip"] = "WITH {px} SELECT img, CAST(i AS BIGINT) AS i, CAST(a AS BIGINT) AS a, " + ", ".join(f"CAST(CASE WHEN a = 0 THEN 0 ELSE {c} END AS BIGINT) AS {c}" for c in "rgb") + " FROM px"


@query("lossy_roundtrip_psnr")
def _(spark, sf):
    """Smooth pictures, so that a quality has a meaning: each row's values are spread over a gradient."""
    p = px(spark, sf)
    grey = (F.col("x") * 12 + F.col("y") * 10 + F.col("img") % 50).cast("int")
    p = p.withColumns({"a": F.lit(255), "r": grey, "g": grey, "b": grey})
    back = I.exploded(I.decode(I.encode(I.gathered(p, W, H), lossy=True, quality=75.0).select("img", "content")))
    return M.psnr(p, back).select("img", (F.col("psnr") >= 25).alias("good"))


SQL["lossy_roundtrip_psnr"] = "SELECT vec_id AS img, true AS good FROM embeddings"


def _planes_through(df: DataFrame, f) -> DataFrame:
    """img, i, v of planes that went through f, a function of an 8x8 array."""
    rows = df.groupBy("img").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("vs")).select("img", F.transform("vs", lambda s: s["v"]).alias("vs"))  # one plane's values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [f(np.array(v, np.uint8).reshape(H, W), int(k)).ravel().tolist() for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.record_batch([b.column(0), pa.array(done, pa.list_(pa.int32()))], ["img", "vs"])

    return rows.mapInArrow(run, "img long, vs array<int>").select("img", F.posexplode("vs").alias("i", "v"))


@query("alph_roundtrip", f"WITH {PLANES} SELECT img, CAST(i AS BIGINT) AS i, CAST(v AS BIGINT) AS v FROM pl")
def _(spark, sf):
    def both(plane, k):
        from rasterloom.codecs import alpha as codec

        return codec.decode(codec.encode(plane, k % 2, k // 2 % 4), W, H)

    return _planes_through(planes(spark, sf), both)


@query("package_merge_lengths")
def _(spark, sf):
    """Kraft sums of length-limited codes over each picture's red histogram: 1, or 1/2 for a single symbol."""
    counts = L.histograms(px(spark, sf)).where("channel = 'r'").groupBy("img").agg(F.collect_list(F.struct("sym", "n")).alias("c"))  # at most 256 symbols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums, most = [], []
            for c in b.column(1).to_pylist():
                n = np.zeros(256, np.int64)
                for x in c:
                    n[x["sym"]] = x["n"]
                lengths = prefix.limited_lengths(n, 7)
                sums.append(float((2.0 ** -lengths[lengths > 0]).sum()))
                most.append(int(lengths.max()))
            yield pa.record_batch([b.column(0), pa.array(sums), pa.array([m <= 7 for m in most])], ["img", "kraft", "limited"])

    return counts.mapInArrow(run, "img long, kraft double, limited boolean")


SQL["package_merge_lengths"] = "WITH {px} SELECT img, CASE WHEN count(DISTINCT r) = 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS kraft, true AS limited FROM px GROUP BY img"


@query("lz77_tokens")
def _(spark, sf):
    """Pixels that tokens (literals and back references) stand for, for each picture with few colors: all of them."""
    rows = planes(spark, sf).withColumn("v", F.shiftright("v", 5)).groupBy("img").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("vs")).select("img", F.transform("vs", lambda s: s["v"]).alias("vs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [lossless._references(v, W) for v in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([sum(max(1, n) for _, n, _ in t) for t in tokens], pa.int64())], ["img", "pixels"])

    return rows.mapInArrow(run, "img long, pixels long")


SQL["lz77_tokens"] = "SELECT vec_id AS img, CAST(64 AS BIGINT) AS pixels FROM embeddings"


@query("metadata_roundtrip", "SELECT vec_id AS img, CASE WHEN vec_id % 2 = 0 THEN 'icc' || vec_id END AS icc, CASE WHEN vec_id % 3 = 0 THEN 'exif' || vec_id END AS exif, CASE WHEN vec_id % 5 <> 0 THEN 'xmp' || vec_id END AS xmp FROM embeddings")
def _(spark, sf):
    rows = I.gathered(px(spark, sf), W, H)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = []
            for k, rgba in zip(b.column("img").to_pylist(), b.column("rgba").to_pylist()):
                own = riff.Metadata(*(f"{n}{k}".encode() if ok else None for n, ok in (("icc", k % 2 == 0), ("exif", k % 3 == 0), ("xmp", k % 5 != 0))))
                files.append(image.encode(np.frombuffer(rgba, np.uint8).reshape(H, W, 4), metadata=own))
            yield pa.record_batch([b.column("img"), pa.array(files, pa.binary())], ["img", "content"])

    found = I.metadata(I.chunks(rows.mapInArrow(run, "img long, content binary")), "img")
    return found.select("img", *[F.col(c).cast("string").alias(c) for c in ("icc", "exif", "xmp")])


@query("anim_roundtrip", f"WITH {FRAMES} SELECT anim, {out(frame_no='frame_no', x='x', y='y // 2 * 2', w='w', h='h', duration_ms='duration_ms', dispose='dispose', blend='blend', shade='shade')} FROM fr")
def _(spark, sf):
    rows = frames(spark, sf).withColumn("y", F.shiftright("y", 1) * 2)
    own = rows.groupBy("anim").agg(F.sort_array(F.collect_list(F.struct("frame_no", "x", "y", "w", "h", "duration_ms", "dispose", "blend", "shade"))).alias("frames"))  # one animation

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, fs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a = image.Animation(16, 16, [image.Frame(np.full((f["h"], f["w"], 4), f["shade"], np.uint8) | np.array([0, 0, 0, 255], np.uint8), f["x"], f["y"], f["duration_ms"], bool(f["dispose"]), bool(f["blend"])) for f in fs])
                back = image.decode_animation(image.encode_animation(a))
                out += [(k, n, f.x, f.y, f.pixels.shape[1], f.pixels.shape[0], f.duration_ms, int(f.dispose_background), int(f.replace), int(f.pixels[0, 0, 0])) for n, f in enumerate(back.frames)]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 10, ["anim", "frame_no", "x", "y", "w", "h", "duration_ms", "dispose", "blend", "shade"])

    return own.mapInArrow(run, "anim long, frame_no long, x long, y long, w long, h long, duration_ms long, dispose long, blend long, shade long")


@query("bit_align", "SELECT p_partkey, " + out(at="(p_partkey % 25 + 7) // 8 * 8", n5="((p_partkey * 2654435 % 4294967296) >> ((p_partkey % 25 + 7) // 8 * 8)) % 256 // 8") + " FROM part")
def _(spark, sf):
    at = Y.aligned(F.col("p_partkey") % 25)
    return read(spark, sf, "part").select("p_partkey", at.alias("at"), Y.read_bits(Y.bits_of(Y.number(F.col("p_partkey") * 2654435 % (1 << 32), 4)), at.cast("int"), 5).alias("n5"))


def _each_picture(spark, sf, f, schema: str) -> DataFrame:
    """Rows that f makes of (img, pixels as h x w x 4) of every picture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for k, rgba in zip(b.column("img").to_pylist(), b.column("rgba").to_pylist()) for r in f(k, np.frombuffer(rgba, np.uint8).reshape(H, W, 4))]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=arrow)

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    arrow = pa.schema([(n, kinds[t]) for n, t in zip(names, types)])
    return I.gathered(px(spark, sf), W, H).mapInArrow(run, schema)


_KINDS = ("VP8L", "VP8", "VP8 with alpha", "VP8L with metadata", "animation")


@query("decode_config_kinds", "SELECT vec_id AS img, kind, CAST(8 AS BIGINT) AS width, CAST(8 AS BIGINT) AS height, kind <> 'VP8' AS alpha FROM embeddings, (VALUES " + ", ".join(f"('{k}')" for k in _KINDS) + ") k(kind)")
def _(spark, sf):
    """What each kind of file says of its size and alpha without being decoded; every picture here has some translucent pixels."""

    def made(k, p):
        opaque = p | np.array([0, 0, 0, 255], np.uint8)
        files = (image.encode(p), image.encode(opaque, True, 75.0), image.encode(p, True, 75.0), image.encode(p, metadata=riff.Metadata(None, b"x", None)), image.encode_animation(image.Animation(W, H, [image.Frame(p), image.Frame(opaque)])))
        return [(k, kind, *image.config(f)) for kind, f in zip(_KINDS, files)]

    return _each_picture(spark, sf, made, "img long, kind string, width long, height long, alpha boolean")


@query("lossy_alpha_roundtrip")
def _(spark, sf):
    """Alpha of lossy pictures is exact: it goes by its own chunk in front of the image."""
    return I.exploded(I.decode(_files(spark, sf, lossy=True, quality=50.0).select("img", "content"))).select("img", "i", "a")


SQL["lossy_alpha_roundtrip"] = "WITH {px} SELECT img, CAST(i AS BIGINT) AS i, CAST(a AS BIGINT) AS a FROM px"


@query("decode_with_metadata")
def _(spark, sf):
    """Pixels and metadata of one call, of lossless files with and without metadata."""

    def made(k, p):
        own = riff.Metadata(f"icc{k}".encode() if k % 2 == 0 else None, None, f"xmp{k}".encode()) if k % 3 else None
        back, found = image.decode_with_metadata(image.encode(p, metadata=own))
        return [(k, found is not None, found and found.icc and found.icc.decode(), found and found.xmp and found.xmp.decode(), int(back[..., 3].astype(int).sum()))]

    return _each_picture(spark, sf, made, "img long, extended boolean, icc string, xmp string, alpha long")


SQL["decode_with_metadata"] = "WITH {px} SELECT img, img % 3 <> 0 AS extended, CASE WHEN img % 3 <> 0 AND img % 2 = 0 THEN 'icc' || img END AS icc, CASE WHEN img % 3 <> 0 THEN 'xmp' || img END AS xmp, CAST(sum(a) AS BIGINT) AS alpha FROM px GROUP BY img"


@query("frames_have_alpha", "SELECT vec_id AS img, vec_id % 2 = 0 AS alpha FROM embeddings")
def _(spark, sf):
    """The alpha flag of an animation whose second frame is translucent, or isn't."""

    def made(k, p):
        opaque = p | np.array([0, 0, 0, 255], np.uint8)
        return [(k, image.encode_animation(image.Animation(W, H, [image.Frame(opaque), image.Frame(p if k % 2 == 0 else opaque)])))]

    rows = _each_picture(spark, sf, made, "img long, content binary")
    return rows.select("img", Y.has_flag(Y.parse_extended(F.substring("content", 21, 10))["flags"], "alpha").alias("alpha"))


@query("size_by_quality", "SELECT vec_id AS img, true AS grows FROM embeddings")
def _(spark, sf):
    """Files of a picture don't shrink as the quality rises."""

    def made(k, p):
        sizes = [len(image.encode(p | np.array([0, 0, 0, 255], np.uint8), True, q)) for q in (25.0, 50.0, 75.0, 95.0)]
        return [(k, sizes == sorted(sizes))]

    return _each_picture(spark, sf, made, "img long, grows boolean")


def _fill() -> None:
    from .fixtures import PX

    for k, v in SQL.items():
        SQL[k] = v.replace("{px}", PX)


_fill()
del _fill, alpha, lossy
