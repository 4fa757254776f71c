import struct
import zlib

import numpy as np
import pytest

from leafmill.sources import images as im
from leafmill.sources import pdf

rng = np.random.default_rng(1)


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(w, h, depth, color, raw, *more, interlace=0):
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, interlace)) + b"".join(more) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def filtered(rows, step):
    """Rows under each filter in turn."""
    out, above = b"", bytes(len(rows[0]))
    for y, row in enumerate(rows):
        kind = y % 5
        line = []
        for i, x in enumerate(row):
            a, c = (row[i - step], above[i - step]) if i >= step else (0, 0)
            b = above[i]
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((x - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        out += bytes([kind]) + bytes(line)
        above = row
    return out


@pytest.mark.parametrize("color,channels", [(0, 1), (4, 2), (2, 3), (6, 4)])
def test_png_filters(color, channels):
    pixels = rng.integers(0, 256, (10, 7 * channels), np.uint8)
    got = im.read_png(png(7, 10, 8, color, filtered([bytes(r) for r in pixels], channels)))
    assert got == (7, 10, channels, pixels.tobytes())


def test_png_palettes_depths_keys_and_passes():
    got = im.read_png(png(3, 1, 2, 3, b"\0" + bytes([0b00011000]), chunk(b"PLTE", bytes(range(9))), chunk(b"tRNS", b"\x07")))
    assert got == (3, 1, 4, bytes([0, 1, 2, 7, 3, 4, 5, 255, 6, 7, 8, 255]))
    assert im.read_png(png(2, 1, 1, 0, b"\0\x40")).pixels == b"\0\xff"
    assert im.read_png(png(2, 1, 8, 0, b"\0\x05\x06", chunk(b"tRNS", b"\0\x05"))).pixels == b"\x05\0\x06\xff"
    full = rng.integers(0, 256, (5, 6), np.uint8)
    raw = b"".join(b"\0" + bytes(full[y, x::dx]) for x, y0, dx, dy in [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)] for y in range(y0, 5, dy) if x < 6)
    assert im.read_png(png(6, 5, 8, 0, raw, interlace=1)).pixels == full.tobytes()


def bmp(pixels, bits, top=False):
    h, w, n = pixels.shape
    rows = pixels[..., [2, 1, 0, 3][:n]] if top else pixels[::-1][..., [2, 1, 0, 3][:n]]
    body = b"".join(r.tobytes().ljust(w * n + 3 & ~3, b"\0") for r in rows)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(body), 0, 0, 54, 40, w, -h if top else h, 1, bits, 0, len(body), 0, 0, 0, 0) + body


@pytest.mark.parametrize("n,top", [(3, False), (4, True)])
def test_bmp(n, top):
    pixels = rng.integers(0, 256, (4, 5, n), np.uint8)
    assert im.read_bmp(bmp(pixels, 8 * n, top)) == (5, 4, n, pixels.tobytes())


def test_written_images_read_back():
    pixels = rng.integers(0, 256, (4, 5, 3), np.uint8).tobytes()
    assert im.read_png(im.write_image(5, 4, pixels, "png")) == im.read_bmp(im.write_image(5, 4, pixels, "bmp")) == (5, 4, 3, pixels)
    with pytest.raises(im.ImageError):
        im.write_image(5, 4, pixels, "webp")


def gif(index, w, h, extra=b"", twice=False, interlaced=False):
    """Every code literal: the table is wiped before it grows."""
    bits = "".join(f"{4:03b}"[::-1] + f"{x:03b}"[::-1] for x in index) + f"{5:03b}"[::-1]
    body = bytes(int(bits[i : i + 8][::-1].rjust(8, "0") if len(bits[i : i + 8]) == 8 else bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    frame = b"," + struct.pack("<4HB", 0, 0, w, h, 0x40 if interlaced else 0) + b"\x02" + bytes([len(body)]) + body + b"\0"
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + bytes(range(12)) + extra + frame * (2 if twice else 1) + b";"


def test_gif():
    got = im.read_gif(gif([0, 1, 2, 3], 2, 2, b"!\xf9\x04\x01\0\0\x02\0"))
    assert got == (2, 2, 4, bytes([0, 1, 2, 255, 3, 4, 5, 255, 6, 7, 8, 0, 9, 10, 11, 255]))
    rows = np.frombuffer(im.read_gif(gif([0, 1, 2, 3, 0], 1, 5, interlaced=True)).pixels, np.uint8).reshape(5, 4)[:, 0]
    assert [int(x) // 3 for x in rows] == [0, 3, 2, 0, 1]  # stored in the order 0, 4, 2, 1, 3


def test_gif_grows_its_table():
    """A run of one colour: codes 0, 6, 7, ... each one longer than the last."""
    codes, n, width, size = [4, 0], 1, 3, 6
    bits = "".join(f"{c:03b}"[::-1] for c in codes)
    while n < 60:
        bits += f"{size:0{width}b}"[::-1]
        n += size - 4
        size += 1
        if size == 1 << width:
            width += 1
    bits += f"{5:0{width}b}"[::-1]
    body = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    assert im._unpacked(body, 2, n) == bytes(n)


def tiff(w, h, samples, raw, extra=(), color=2, packing=1, more=()):
    tags = [(256, 4, w), (257, 4, h), (258, 3, 8), (259, 3, packing), (262, 3, color), (273, 4, 8), (277, 3, samples), (279, 4, len(raw)), *[(338, 3, x) for x in extra], *more]
    out = b"II*\0" + struct.pack("<I", 8 + len(raw)) + raw + struct.pack("<H", len(tags))
    return out + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in sorted(tags)) + bytes(4)


def test_tiff_and_alpha():
    raw = bytes([10, 20, 30, 128, 9, 9, 9, 0])
    assert im.read_tiff(tiff(2, 1, 4, raw, (2,))).pixels == raw
    assert im.read_tiff(tiff(2, 1, 4, zlib.compress(raw), (1,), packing=8)).pixels == bytes([20, 40, 60, 128, 0, 0, 0, 0])
    assert im.read_tiff(tiff(2, 1, 1, b"\x01\x02", color=1)).pixels == b"\x01\x02"
    assert im.read_tiff(tiff(2, 1, 1, b"\x01\x02", color=1, packing=5)).pixels is None


def seg(kind, body):
    return b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body


def jpeg(w=16, h=8, n=1, coded=b"\x12\x34", more=b"", kind=0xC0, depth=8):
    factors = b"".join(bytes([i + 1, 0x11, 0]) for i in range(n))
    scan = seg(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + b"\0\x3f\0")
    return b"\xff\xd8" + more + seg(0xDB, bytes(65)) + seg(kind, struct.pack(">BHHB", depth, h, w, n) + factors) + scan + coded + b"\xff\xd9"


def exif(value, e=">"):
    return b"Exif\0\0" + (b"MM" if e == ">" else b"II") + struct.pack(e + "HIHHHIHH", 42, 8, 1, 0x0112, 3, 1, value, 0)


def test_jpeg():
    assert im.inspect_jpeg(jpeg()) == (16, 8, 1, 1) and im.inspect_jpeg(jpeg(n=3, coded=b"\xff\0" * 9 + b"\xff\xd0ab", more=seg(0xEE, b"Adobe" + bytes(7)))) == (16, 8, 3, 0)
    assert im.inspect_jpeg(jpeg(more=seg(0xE1, exif(1, "<")))).width == 16 and im.exif_orientation(exif(6)) == 6 and im.exif_orientation(b"Exif\0\0II*\0\x08\0\0\0\0\0") == 1


vp8 = b"VP8 " + struct.pack("<I", 10) + b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 4, 3)


def webp(*chunks):
    body = b"WEBP" + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_webp():
    assert im.read_webp(webp(vp8))[:3] == (4, 3, 3)
    assert im.read_webp(webp(b"VP8L" + struct.pack("<I", 5) + b"\x2f" + struct.pack("<I", 3 | 2 << 14 | 1 << 28) + b"\0"))[:3] == (4, 3, 4)


rgb = rng.integers(0, 256, (1, 1, 3), np.uint8)
BAD = [
    ("png", b"", "INVALID_IMAGE"), ("png", b"x", "INVALID_IMAGE"), ("svg", b"x", "INVALID_IMAGE"), ("png", png(1, 1, 16, 0, b"\0\0\0"), "UNSUPPORTED_IMAGE"), ("png", png(1, 1, 8, 0, b"\0\0", chunk(b"acTL", b"")), "UNSUPPORTED_IMAGE"), ("png", png(1, 1, 8, 0, b"\0\0", chunk(b"iCCP", b"")), "UNSUPPORTED_IMAGE"),
    ("png", png(20001, 1, 8, 0, b""), "IMAGE_TOO_LARGE"), ("png", png(4000, 4000, 8, 0, b""), "IMAGE_TOO_LARGE"), ("png", png(1, 1, 8, 0, b"\0"), "INVALID_IMAGE"), ("png", png(1, 1, 8, 0, b"\x09\0"), "INVALID_IMAGE"), ("png", png(1, 1, 8, 0, b"\0\0")[:-3], "INVALID_IMAGE"), ("png", png(1, 1, 8, 3, b"\0\x05", chunk(b"PLTE", bytes(3))), "INVALID_IMAGE"),
    ("bmp", bmp(rgb, 24)[:-1], "INVALID_IMAGE"), ("bmp", bmp(rgb, 16), "UNSUPPORTED_IMAGE"), ("gif", gif([0], 1, 1, twice=True), "UNSUPPORTED_IMAGE"), ("gif", gif([0], 1, 2), "INVALID_IMAGE"), ("gif", gif([0], 1, 1)[:-6], "INVALID_IMAGE"),
    ("tiff", tiff(1, 1, 3, b"abc", color=6), "UNSUPPORTED_IMAGE"), ("tif", tiff(1, 1, 3, b"abc", more=[(274, 3, 6)]), "UNSUPPORTED_IMAGE"), ("tif", tiff(1, 1, 3, b"ab"), "INVALID_IMAGE"), ("tif", b"II*\0" + bytes(12), "INVALID_IMAGE"),
    ("webp", webp(vp8, b"ANIM" + bytes(4)), "UNSUPPORTED_IMAGE"), ("webp", webp(b"VP8 " + bytes(14)), "INVALID_IMAGE"),
    ("jpg", jpeg(coded=b""), "INVALID_IMAGE"), ("jpg", jpeg(more=seg(0xE1, exif(6))), "UNSUPPORTED_IMAGE"), ("jpeg", jpeg(more=seg(0xE2, b"ICC_PROFILE\0..")), "UNSUPPORTED_IMAGE"), ("jpg", jpeg(kind=0xC1), "UNSUPPORTED_IMAGE"), ("jpg", jpeg(depth=12), "UNSUPPORTED_IMAGE"), ("jpg", jpeg() + b"x", "INVALID_IMAGE"), ("jpg", jpeg(w=0), "IMAGE_TOO_LARGE"),
]


@pytest.mark.parametrize("case", range(len(BAD)))
def test_refused(case):
    form, data, want = BAD[case]
    with pytest.raises(im.ImageError) as e:
        im.read_image(data, form)
    assert e.value.args == (want,)


def test_pages_of_images(spark):
    rgba = png(2, 1, 8, 6, b"\0" + bytes(range(8)))
    data = im.images_pdf([(rgba, "PNG"), (jpeg(n=3, coded=b"a" * 9), "jpg"), (im.write_png(20000, 1, bytes(60000)), "png")])
    doc = pdf.Document(data)
    assert [doc.size(p) for p in doc.pages()] == [(2, 1), (16, 8), (2000, 1)] and pdf.check_pdf(data)
    shown = [o for o in doc.objects.values() if pdf._type(o.dict, "Subtype") == "Image"]
    assert pdf.decoded(shown[0]) == bytes([0, 1, 2, 4, 5, 6]) and pdf.decoded(shown[1]) == bytes([3, 7]) and shown[2].stream.startswith(b"\xff\xd8")
    files = spark.createDataFrame([(1, 0, bytearray(rgba), "png"), (1, 1, bytearray(jpeg()), "jpg"), (2, 0, bytearray(b"x"), "png"), (3, 0, None, None)], "doc_id long, position int, content binary, format string")
    assert sorted((r.doc_id, r.width or 0, r.error_code or "") for r in im.inspected(files).collect()) == [(1, 2, ""), (1, 16, ""), (2, 0, "INVALID_IMAGE"), (3, 0, "INVALID_IMAGE")]
    assert sorted((r.doc_id, r.error_code or "") for r in im.image_pdf(files).collect()) == [(1, ""), (1, ""), (2, "INVALID_IMAGE"), (3, "INVALID_IMAGE")]
    merged = {r.doc_id: r for r in im.merged_pdf(files, "doc_id", "position").collect()}
    assert len(pdf.Document(bytes(merged[1].content)).pages()) == 2 and merged[2].error_code == "INVALID_IMAGE"
