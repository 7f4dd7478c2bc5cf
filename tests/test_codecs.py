"""Codecs on formula pictures: exact round trips, quality floors, known values, bad input."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.codecs import alpha, image, lossless, lossy, prefix, riff
from rasterloom.codecs.bits import BitReader, BitWriter
from rasterloom.codecs.riff import BadFile, Metadata


def grid(n, m=None):
    y, x = np.mgrid[0 : (m or n), 0:n]
    return x, y


def rgba(r, g, b, a=None):
    return np.dstack([np.broadcast_to(c, r.shape) % 256 for c in (r, g, b, np.full(r.shape, 255) if a is None else a)]).astype(np.uint8)


def grey(v):
    return rgba(v, v, v)


def psnr(a, b):
    mse = ((a[..., :3].astype(float) - b[..., :3].astype(float)) ** 2).mean()
    return 999.0 if mse == 0 else 10 * math.log10(255**2 / mse)


def pictures():
    for n in (1, 2, 16, 17, 33, 64):
        x, y = grid(n)
        yield f"solid{n}", rgba(np.full((n, n), 200), 30, 77)
        yield f"gradient{n}", rgba(3 * x, 3 * y, x + y)
    x, y = grid(64)
    for k in (2, 3, 16, 17, 256):
        c = (y * 64 + x) % k
        yield f"palette{k}", rgba(37 * c, 71 * c, 113 * c)
    yield "tile", rgba(40 * (x % 4), 40 * (y % 4), 20 * (x % 4 + y % 4))
    x, y = grid(32)
    yield "checker", rgba(np.full((32, 32), 255), 0, 0, np.where((x + y) % 2 == 0, 255, 0))
    h = (x * 2654435761 + y * 40503) >> 3
    yield "noise", rgba(h % 251, (h >> 7) % 256, (h >> 11) % 253, (h >> 5) % 256)
    x, y = grid(50, 21)
    yield "odd", rgba(5 * x + y, x * y, 255 - x, (x + 7 * y) % 256)


PICTURES = dict(pictures())


@pytest.mark.parametrize("name", PICTURES)
@pytest.mark.parametrize("published", [False, True])
@pytest.mark.parametrize("references", [False, True])
def test_lossless_is_exact(name, published, references):
    p = PICTURES[name]
    want = p.copy()
    want[p[..., 3] == 0] = 0
    data = lossless.encode_rgba(p, lossless.Options(published=published, references=references))
    assert (lossless.decode_rgba(data, published) == want).all()
    assert lossless.config(data) == (p.shape[1], p.shape[0], bool((p[..., 3] != 255).any()))


@pytest.mark.parametrize("options", [dict(palette=False, predictor=a, color=b, subtract_green=c, predictor_bits=d, color_bits=d) for a in (False, True) for b in (False, True) for c in (False, True) for d in (2, 5)])
def test_each_transform(options):
    p = PICTURES["odd"].copy()
    p[..., 3] |= 1
    for published in (False, True):
        data = lossless.encode_rgba(p, lossless.Options(published=published, **options))
        assert (lossless.decode_rgba(data, published) == p).all()


def test_every_prediction_mode():
    img = lossless.channels(lossless.joined(np.random.default_rng(2).integers(0, 256, (9, 13, 4))))
    for published in (False, True):
        for m in range(14):
            modes = np.full((3, 4), m)
            res = (img - lossless.predicted(img, modes, 2, published)) & 255
            assert (lossless.unpredict(res, modes, 2, published) == img).all(), m


def test_references_pay():
    x, y = grid(64)
    p = rgba(40 * (x % 4), 40 * (y % 4), 20 * (x % 4 + y % 4))
    sizes = [len(lossless.encode_rgba(p, lossless.Options(palette=False, predictor=False, color=False, references=r))) for r in (False, True)]
    assert sizes[1] < sizes[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=60), st.sampled_from([7, 15]))
def test_code_lengths(counts, most):
    lengths = prefix.limited_lengths(np.array(counts), most)
    used = [n for n in lengths if n]
    assert len(used) == sum(c > 0 for c in counts) and all(n <= most for n in used)
    if len(used) > 1:
        assert sum(2.0**-n for n in used) == 1
        w = BitWriter()
        prefix.write_lengths(w, np.pad(lengths, (0, 280 - len(lengths))))
        for keep in (False, True):
            assert (prefix.read_lengths(BitReader(w.bytes() + b"\0" * 8), 280, keep)[: len(lengths)] == lengths).all()


def test_shortest_codes():
    assert prefix.limited_lengths(np.array([100, 50, 25, 10, 5, 1])).tolist() == [1, 2, 3, 4, 5, 5]
    assert prefix.limited_lengths(np.array([8, 4, 2, 1, 1])).tolist() == [1, 2, 3, 4, 4]
    assert prefix.limited_lengths(np.array([0, 9])).tolist() == [0, 1] and not prefix.limited_lengths(np.zeros(3, int)).any()


@pytest.mark.parametrize("bad", [b"", b"\x2f", b"\x30" + bytes(20), b"\x2f" + bytes([0, 0, 0, 0xE0]) + bytes(9), b"\x2f" + bytes(4), b"\x2f" + bytes([255]) * 30])
def test_bad_lossless_streams(bad):
    with pytest.raises(BadFile):
        lossless.decode_pixels(bad)


@pytest.mark.parametrize(("quality", "floor"), [(25, 25), (50, 25), (75, 30), (95, 30)])
@pytest.mark.parametrize("n", [16, 40, 64])
def test_lossy_quality(quality, floor, n):
    x, y = grid(n)
    for p in (grey(np.full((n, n), 90)), grey(x * 255 // (n - 1)), grey(y * 255 // (n - 1)), grey((x + y) * 255 // (2 * n - 2))):
        assert psnr(lossy.decode_rgb(lossy.encode_rgb(p[..., :3], quality)), p) >= floor


def test_lossy_size_and_quality_grow_together():
    x, y = grid(64)
    p = grey((x + y) * 255 // 126)
    data = [lossy.encode_rgb(p[..., :3], q) for q in (25, 50, 75, 95)]
    assert [len(d) for d in data] == sorted(len(d) for d in data)
    quality = [psnr(lossy.decode_rgb(d), p) for d in data]
    assert all(b >= a - 2 for a, b in zip(quality, quality[1:]))


def test_lossy_stripes():
    x, y = grid(64)
    for v in (x // 8 * 32, y // 8 * 32):
        assert psnr(lossy.decode_rgb(lossy.encode_rgb(grey(v)[..., :3], 75)), grey(v)) >= 25


def test_lossy_tables_are_a_parameter():
    t = lossy.Tables(coefficients=np.full((4, 8, 3, 11), 128), updates=np.full((4, 8, 3, 11), 200), modes=np.full((10, 10, 9), 100))
    p = PICTURES["gradient33"][..., :3]
    assert (lossy.decode_rgb(lossy.encode_rgb(p, 60, t), t) == lossy.decode_rgb(lossy.encode_rgb(p, 60))).all()


def four_by_four_stream(modes, level, simple, segments, partitions, skip, sharpness=0):
    """A stream of 4x4 modes with segments, partitions, deltas and filters, written with the coder alone."""
    t = lossy.Tables()
    rows, cols = 3, 2
    head, bodies = lossy.BoolWriter(), [lossy.BoolWriter() for _ in range(partitions)]
    head.number(0, 2)
    head.number(int(segments), 1)
    if segments:
        head.number(3, 2)
        head.number(1, 1)
        for q in (20, 40, 60, 80):
            head.number(1, 1)
            head.number(q, 7)
            head.number(0, 1)
        for f in (5, 20, 45, 63):
            head.number(1, 1)
            head.number(f, 6)
            head.number(0, 1)
        for p in (100, 120, 140):
            head.number(1, 1)
            head.number(p, 8)
    head.number(int(simple), 1)
    head.number(level, 6)
    head.number(sharpness, 3)
    head.number(3, 2)
    for k in range(8):
        head.number(1, 1)
        head.number(k, 6)
        head.number(k & 1, 1)
    head.number(partitions.bit_length() - 1, 2)
    head.number(30, 7)
    for d in (2, 0, 1, 0, 3):
        head.number(int(d > 0), 1)
        if d:
            head.number(d, 4)
            head.number(d & 1, 1)
    head.number(1, 1)
    for p in t.updates.ravel().tolist():
        head.put(0, p)
    head.number(int(skip), 1)
    if skip:
        head.number(90, 8)
    rng, n = np.random.default_rng(7), 0
    above, up = [[0] * (4 * cols), [0] * (2 * cols), [0] * (2 * cols)], [0] * (4 * cols)
    for my in range(rows):
        left, left_modes, body = [[0] * 4, [0] * 2, [0] * 2], [0] * 4, bodies[my % partitions]
        for mx in range(cols):
            if segments:
                s = (my + mx) % 4
                head.put(s >> 1, 100)
                head.put(s & 1, (120, 140)[s >> 1])
            skipped = skip and (my + mx) % 3 == 0
            if skip:
                head.put(int(skipped), 90)
            head.put(0, lossy.Y_MODE[0])
            for k in range(16):
                m = modes[n % len(modes)]
                n += 1
                p = t.modes[up[4 * mx + k % 4], left_modes[k // 4]]
                put_mode(head, m, p)
                up[4 * mx + k % 4] = left_modes[k // 4] = m
            head.put(0, lossy.UV_MODE[0])
            for plane, many, at in ((3, 4, 0), (2, 2, 1), (2, 2, 2)):
                for k in range(many * many):
                    j, i = k // many, many * mx + k % many
                    if skipped:
                        above[at][i] = left[at][j] = 0
                        continue
                    c = np.where(rng.random(16) < 0.3, rng.integers(-90, 90, 16), 0) * (rng.random() < 0.7)
                    above[at][i] = left[at][j] = lossy.put_tokens(body, c.tolist(), t.coefficients[plane].tolist(), above[at][i] + left[at][j], 0)
    one, parts = head.bytes(), [b.bytes() for b in bodies]
    sizes = b"".join(len(p).to_bytes(3, "little") for p in parts[:-1])
    return (len(one) << 5 | 1 << 4).to_bytes(3, "little") + b"\x9d\x01\x2a" + (30).to_bytes(2, "little") + (45).to_bytes(2, "little") + one + sizes + b"".join(parts)


def put_mode(w, mode, probs):
    """Walks to a leaf of the 4x4 mode tree."""
    def path(n, trail):
        for bit in (0, 1):
            v = lossy.TREE4[n + bit]
            if v <= 0:
                if -v == mode:
                    return [*trail, (n, bit)]
            elif found := path(v, [*trail, (n, bit)]):
                return found
        return None

    for n, bit in path(0, []):
        w.put(bit, int(probs[n >> 1]))


@pytest.mark.parametrize("simple", [False, True])
@pytest.mark.parametrize(("segments", "partitions", "skip", "level", "sharpness"), [(False, 1, False, 0, 0), (True, 1, True, 10, 3), (True, 4, True, 40, 6), (False, 8, False, 63, 0), (True, 2, False, 0, 1)])
def test_lossy_decoder_reads_all_of_the_format(simple, segments, partitions, skip, level, sharpness):
    data = four_by_four_stream(list(range(10)), level, simple, segments, partitions, skip, sharpness)
    y, cb, cr = lossy.decode_planes(data)
    assert y.shape == (45, 30) and cb.shape == cr.shape == (23, 15) and y.min() >= 0 and y.max() <= 255
    plain = lossy.decode_planes(four_by_four_stream(list(range(10)), 0, simple, segments, partitions, skip, sharpness))
    assert (level == 0) == all((a == b).all() for a, b in zip((y, cb, cr), plain))
    assert not simple or (cb == plain[1]).all()


def test_directional_modes_of_flat_borders_are_flat():
    for m in range(10):
        assert (lossy.small(m, np.full(8, 77), np.full(4, 77), 77) == 77).all()


@pytest.mark.parametrize("bad", [b"", bytes(10), b"\x01" + bytes(12), b"\x10\0\0\x9d\x01\x2a" + bytes(4), b"\xf0\xff\xff\x9d\x01\x2a\x10\0\x10\0"])
def test_bad_lossy_streams(bad):
    with pytest.raises(BadFile):
        lossy.decode_rgb(bad)


def test_boolean_coder():
    w = lossy.BoolWriter()
    items = [(max(1, (37 * i + 13) % 256), int((53 * i + 7) % 3 != 0)) for i in range(1000)]
    for p, b in items:
        w.put(b, p)
    w.number(0b1011001, 7)
    r = lossy.BoolReader(w.bytes())
    assert [r.get(p) for p, _ in items] == [b for _, b in items] and r.number(7) == 0b1011001


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(-2000, 2000), min_size=16, max_size=16), st.integers(0, 3), st.integers(0, 2))
def test_tokens(values, plane, ctx):
    first = int(plane == 0)
    probs, w = lossy.Tables().coefficients.tolist()[plane], lossy.BoolWriter()
    lossy.put_tokens(w, values, probs, ctx, first)
    back, nz = lossy.get_tokens(lossy.BoolReader(w.bytes()), probs, ctx, first)
    want = values if not first else [0, *values[1:]]
    assert back.ravel()[list(lossy.ZIGZAG)].tolist() == want and nz == int(any(values[first:]))


def test_block_transforms():
    rng = np.random.default_rng(5)
    x = rng.integers(-255, 256, (200, 4, 4))
    assert np.abs(lossy.idct(lossy.fdct(x)) - x).max() <= 2
    assert np.abs(lossy.iwht(lossy.fwht(x)) - x).max() <= 2
    q = lossy.steps(lossy.index_of_quality(75))
    back = lossy.idct(lossy.scaled(lossy.quantized(lossy.fdct(x), *q["y"]), *q["y"]))
    assert np.abs(back - x).mean() < 20
    assert [lossy.index_of_quality(v) for v in (-5, 0, 50, 75, 100, 200)] == [127, 127, 63, 31, 0, 0]


@pytest.mark.parametrize("kind", range(4))
@pytest.mark.parametrize("method", [0, 1])
@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (7, 1), (10, 12), (16, 16)])
def test_alpha_planes(kind, method, shape):
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]]
    for plane in ((17 * x + 31 * y) % 256, np.minimum(255, (x + y) * 255 // 30)):
        plane = plane.astype(np.uint8)
        assert (alpha.reverse_filter(alpha.apply_filter(plane, kind), kind) == plane).all()
        assert (alpha.decode(alpha.encode(plane, method, kind), shape[1], shape[0]) == plane).all()
        few = alpha.decode(alpha.encode(plane, method, kind, reduce=True), shape[1], shape[0])
        assert len(np.unique(few)) <= 64 and (few == alpha.quantize(plane, 64)).all()


def test_alpha_values():
    assert alpha.quantize(np.array([0, 63, 64, 127, 128, 191, 192, 255]), 4).tolist() == [32, 32, 96, 96, 160, 160, 224, 224]
    for bad in (b"", b"\x40\0", b"\x20\0", b"\x02\0", b"\x00\0\0"):
        with pytest.raises(BadFile):
            alpha.decode(bad, 1, 1)


@pytest.mark.parametrize("name", PICTURES)
def test_files(name):
    p = PICTURES[name]
    data = image.encode(p)
    want = p.copy()
    want[p[..., 3] == 0] = 0
    assert (image.decode(data) == want).all() and image.config(data) == (p.shape[1], p.shape[0], bool((p[..., 3] != 255).any()))
    loss = image.encode(p, True, 90.0)
    back = image.decode(loss)
    assert (back[..., 3] == p[..., 3]).all() and image.config(loss)[:2] == (p.shape[1], p.shape[0])
    assert [n for n, _ in riff.chunks(loss)] == ([b"VP8X", b"ALPH", b"VP8 "] if (p[..., 3] != 255).any() else [b"VP8 "])


@pytest.mark.parametrize("lossy_", [False, True])
@pytest.mark.parametrize("own", [Metadata(), Metadata(b"icc!"), Metadata(exif=b"e"), Metadata(xmp=b"xmp data"), Metadata(b"i", b"ee", b"xxx")])
def test_metadata(own, lossy_):
    x, y = grid(12, 10)
    p = rgba(10 * x, 10 * y, np.full(x.shape, 128))
    data = image.encode(p, lossy_, 80.0, own)
    pixels, got = image.decode_with_metadata(data)
    assert (pixels == image.decode(data)).all() and (got == own if own else got is None)
    names = [n for n, _ in riff.chunks(data)]
    body = b"VP8 " if lossy_ else b"VP8L"
    assert names == [*([b"VP8X"] if own else []), *([b"ICCP"] if own.icc else []), body, *([b"EXIF"] if own.exif else []), *([b"XMP "] if own.xmp else [])]


def test_alpha_chunk_positions():
    """decode takes the last alpha chunk anywhere, decode_with_metadata only one in front of the picture."""
    p = rgba(np.full((4, 4), 90), 90, 90)
    body = riff.chunk(b"VP8 ", lossy.encode_rgb(p[..., :3], 90))
    late = riff.file(riff.extended(riff.ALPHA, 4, 4), body, riff.chunk(b"ALPH", alpha.encode(np.full((4, 4), 9, np.uint8))))
    assert (image.decode(late)[..., 3] == 9).all() and (image.decode_with_metadata(late)[0][..., 3] == 255).all()


def test_container():
    data = riff.file(riff.chunk(b"AAAA", b"odd"), riff.chunk(b"BBBB", b"even"))
    assert riff.chunks(data) == [(b"AAAA", b"odd"), (b"BBBB", b"even")] and len(data) == 12 + 12 + 12
    assert riff.chunks(data[:-1]) == [(b"AAAA", b"odd")]
    for bad in (b"", b"RIFX" + data[4:], data[:8] + b"WEBQ"):
        with pytest.raises(BadFile):
            riff.chunks(bad)
    assert riff.parse_extended(riff.chunks(riff.file(riff.extended(18, 1, 1 << 24)))[0][1]) == (18, 1, 1 << 24)


def animation():
    red, green, blue = ([255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255])
    full = lambda n, c: np.tile(np.array(c, np.uint8), (n, n, 1))
    return image.Animation(4, 4, [image.Frame(full(4, red), duration_ms=100), image.Frame(full(2, green), duration_ms=50, dispose_background=True), image.Frame(full(2, blue), 2, 2, 1 << 25, False, True)], loops=70000, background=(9, 8, 7, 6))


@pytest.mark.parametrize("lossy_", [False, True])
def test_animation(lossy_):
    a = animation()
    b = image.decode_animation(image.encode_animation(a, lossy_, 90.0))
    assert (b.width, b.height, b.loops, b.background) == (4, 4, 65535, (9, 8, 7, 6))
    assert [(f.x, f.y, f.duration_ms, f.dispose_background, f.replace) for f in b.frames] == [(0, 0, 100, False, False), (0, 0, 50, True, False), (2, 2, (1 << 24) - 1, False, True)]
    if not lossy_:
        assert all((f.pixels == g.pixels).all() for f, g in zip(a.frames, b.frames))
        shown = image.compose(b)
        assert shown[1][0, 0].tolist() == [0, 255, 0, 255] and shown[1][3, 3].tolist() == [255, 0, 0, 255]
        assert shown[2][0, 0].tolist() == [9, 8, 7, 6] and shown[2][3, 3].tolist() == [0, 0, 255, 255] and shown[2][0, 3].tolist() == [255, 0, 0, 255]
        assert (image.decode(image.encode_animation(a)) == shown[0]).all()


def test_keyframes():
    a = animation()
    a.frames.append(image.Frame(np.zeros((4, 4, 4), np.uint8), dispose_background=True, replace=True))
    assert [image.is_keyframe(a, k) for k in (-1, 0, 1, 2, 3, 4)] == [False, True, False, False, True, False]


@pytest.mark.parametrize("change", [dict(x=1), dict(y=3), dict(x=-2), dict(x=4), dict(y=2, x=2), dict(pixels=np.zeros((0, 0, 4), np.uint8)), dict(pixels=None)])
def test_bad_frames(change):
    a = animation()
    for k, v in change.items():
        setattr(a.frames[0], k, v)
    with pytest.raises(BadFile):
        image.encode_animation(a)


def test_bad_animations():
    a = animation()
    for bad in (image.Animation(4, 4), image.Animation(0, 4, a.frames), image.Animation(1 << 25, 4, a.frames)):
        with pytest.raises(BadFile):
            image.encode_animation(bad)
    a.frames[0].pixels = a.frames[0].pixels.copy()
    a.frames[0].pixels[0, 0, 3] = 5
    with pytest.raises(BadFile):
        image.encode_animation(a, True)
    data = image.encode_animation(animation())
    parts = riff.chunks(data)
    again = lambda ps: riff.file(*(riff.chunk(*p) for p in ps))
    for bad in (again([parts[0], parts[2], parts[1]]), again([parts[0], *parts[2:]]), again([parts[0]]), image.encode(PICTURES["solid2"])):
        with pytest.raises(BadFile):
            image.decode_animation(bad)
    p = bytearray(parts[2][1])
    p[15] |= 0x10
    with pytest.raises(BadFile):
        image.decode_animation(again([*parts[:2], (b"ANMF", bytes(p))]))


def test_blending():
    one = lambda d, s: image.blend(np.array([[d]], np.uint8), np.array([[s]], np.uint8))[0, 0].tolist()
    assert one([1, 2, 3, 4], [9, 9, 9, 255]) == [9, 9, 9, 255] and one([1, 2, 3, 4], [9, 9, 9, 0]) == [1, 2, 3, 4] and one([1, 2, 3, 0], [9, 9, 9, 0]) == [0, 0, 0, 0]
    r = one([100, 100, 100, 255], [200, 200, 200, 128])
    assert abs(r[0] - 150) <= 1 and r[3] == 255


def test_tables_are_read_from_the_specification(tmp_path):
    """C listings with comments and page breaks between their lines; a saved file gives the same tables."""
    from rasterloom.codecs.lossy import Tables

    rng = np.random.default_rng(8)
    want = Tables(rng.integers(0, 256, (4, 8, 3, 11)), rng.integers(0, 256, (4, 8, 3, 11)), rng.integers(0, 256, (10, 10, 9)))
    braces = lambda x: "{ " + ", ".join(braces(v) for v in x) + "}" if isinstance(x, list) else str(x)
    page = "\n\nSomeone, et al.        Informational      [Page 70]\n\x0c\nRFC 6386   Title 3   November 2011\n\n"
    text = f"   const Prob default_coeff_probs [num_types] [3]\n =\n {braces(want.coefficients.tolist()).replace('}, {', '},' + page + '/* block type 1 */ {', 3)};\n"
    text += f"const Prob coeff_update_probs[4][8] = {braces(want.updates.tolist())};\n const Prob kf_bmode_probs [a] [b]\n [c-1] =\n{braces(want.modes.tolist())};"
    got = Tables.of_specification(text)
    got.save(f"{tmp_path}/tables.json")
    for t in (got, Tables.load(f"{tmp_path}/tables.json")):
        assert (t.coefficients == want.coefficients).all() and (t.updates == want.updates).all() and (t.modes == want.modes).all()
    with pytest.raises(ValueError):
        Tables.of_specification(text[:5000])


def test_a_large_plane_and_picture(spark):
    """A million values through the gradient filter and back, and pixels of a picture in several batches."""
    from pyspark.sql import functions as F

    from rasterloom.operators import alpha as A
    from rasterloom.operators import images as I

    n = 1 << 20
    plane = spark.range(n).select(F.lit(1).alias("img"), F.col("id").cast("int").alias("i"), (F.col("id") % 1024).cast("int").alias("x"), F.floor(F.col("id") / 1024).cast("int").alias("y"), (F.xxhash64("id") % 128 + 128).cast("int").alias("v"))
    back = A.reverse_filter(A.apply_filter(plane, 1024, "gradient"), 1024, "gradient")
    assert back.columns == plane.columns and back.join(plane.withColumnRenamed("v", "w"), ["img", "i"]).where("v = w").count() == n
    rgba = np.random.default_rng(2).integers(0, 256, (700, 500, 4)).astype(np.uint8)
    got = I.exploded(spark.createDataFrame([(7, 500, 700, bytearray(rgba.tobytes()))], "img long, width int, height int, rgba binary")).orderBy("i").toPandas()
    assert len(got) == 350_000 and (got[["r", "g", "b", "a"]].to_numpy() == rgba.reshape(-1, 4)).all() and (got.x + got.y * 500 == got.i).all()


def test_a_long_animation_on_one_pixel(spark):
    """Five thousand frames that touch a pixel, against the codec."""
    from rasterloom.operators import animation as N

    rng, n = np.random.default_rng(6), 5000
    frames = [image.Frame(rng.integers(0, 256, (1, 2, 4)).astype(np.uint8), 0, 0, 1, bool(rng.integers(0, 5) == 0), bool(rng.integers(0, 2))) for _ in range(n)]
    want = image.compose(image.Animation(2, 2, frames))
    rows = [(1, k, x, 0, *(int(f.pixels[0, x, c]) for c in (3, 0, 1, 2)), int(f.dispose_background), int(f.replace)) for k, f in enumerate(frames) for x in (0, 1)]
    got = N.compose(spark.createDataFrame(rows, "anim long, frame_no int, x int, y int, a int, r int, g int, b int, dispose int, blend int")).collect()
    assert len(got) == 2 * n and all((r.r, r.g, r.b, r.a) == tuple(want[r.frame_no][0, r.x].tolist()) for r in got)
