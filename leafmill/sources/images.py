"""Images: what the decoders accept, pixels of PNG, BMP and GIF, and images as PDF pages. Pure Python and numpy."""

from __future__ import annotations

import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import rows_from
from .pdf import assembled

# Limits, fixed values.
MAX_INPUT, MAX_SIDE, MAX_PIXELS, MAX_DECODED, MAX_PAGE_SIDE, MAX_MERGED, MAX_MERGED_BYTES = 64 << 20, 20_000, 12_000_000, 64 << 20, 14_400.0, 200, 512 << 20


class ImageError(Exception):
    """INVALID_IMAGE, UNSUPPORTED_IMAGE or IMAGE_TOO_LARGE."""


class Raster(NamedTuple):
    """Rows of 8-bit samples: 1 gray, 2 gray and alpha, 3 RGB, 4 RGBA."""

    width: int
    height: int
    channels: int
    pixels: bytes | None


def _need(fact: bool, code: str = "INVALID_IMAGE") -> None:
    if not fact:
        raise ImageError(code)


def _fits(width: int, height: int) -> None:
    _need(0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE and width * height <= MAX_PIXELS, "IMAGE_TOO_LARGE")


# ---- PNG -----------------------------------------------------------------------


def read_png(data: bytes) -> Raster:
    """An 8-bit image; palettes, low depths and transparency keys are expanded. No 16-bit, animation or profile."""
    _need(data.startswith(b"\x89PNG\r\n\x1a\n"))
    at, packed, palette, clear, head, ended = 8, [], None, None, None, False
    while at < len(data) and not ended:
        _need(at + 12 <= len(data))
        size, kind = struct.unpack_from(">I4s", data, at)
        _need(at + 12 + size <= len(data))
        body = data[at + 8 : at + 8 + size]
        _need(zlib.crc32(kind + body) == struct.unpack_from(">I", data, at + 8 + size)[0])
        at += 12 + size
        if head is None:
            _need(kind == b"IHDR" and size == 13)
            head = struct.unpack(">IIBBBBB", body)
            _fits(*head[:2])
        elif kind == b"PLTE":
            palette = body
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            packed.append(body)
        elif kind in (b"acTL", b"iCCP"):
            raise ImageError("UNSUPPORTED_IMAGE")
        ended = kind == b"IEND"
    _need(ended and head is not None and bool(packed))
    width, height, depth, color, method, filtering, interlace = head
    _need(color in (0, 2, 3, 4, 6) and method == filtering == 0 and interlace < 2 and depth in ((1, 2, 4, 8, 16) if color == 0 else (1, 2, 4, 8) if color == 3 else (8, 16)))
    _need(depth < 16, "UNSUPPORTED_IMAGE")
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    passes = [(0, 0, 1, 1)] if not interlace else [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
    boxes = [(x, y, dx, dy, -(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in passes if x < width and y < height]
    total = sum(h * (1 + -(-w * samples * depth // 8)) for *_, w, h in boxes)
    try:
        raw = zlib.decompressobj().decompress(b"".join(packed), total + 1)
    except zlib.error:
        raise ImageError("INVALID_IMAGE") from None
    _need(len(raw) == total)
    out, at = np.zeros((height, width, samples), np.uint8), 0
    for x, y, dx, dy, w, h in boxes:
        row = -(-w * samples * depth // 8)
        lines = _unfiltered(raw[at : at + h * (row + 1)], h, row, max(1, samples * depth // 8))
        at += h * (row + 1)
        if depth < 8:
            bits = np.unpackbits(lines, axis=1).reshape(h, -1, depth)
            lines = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, :w]
        out[y::dy, x::dx] = lines.reshape(h, w, samples)
    if color == 3:
        _need(palette is not None and len(palette) % 3 == 0)
        table = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        _need(int(out.max()) < len(table))
        alpha = np.full(len(table), 255, np.uint8)
        if clear is not None:
            alpha[: len(clear)] = np.frombuffer(clear[: len(table)], np.uint8)
        out = np.concatenate([table[out[..., 0]], alpha[out]], axis=2) if clear is not None else table[out[..., 0]]
    elif color in (0, 2):
        shown = out * (255 // ((1 << depth) - 1)) if depth < 8 else out
        if clear is not None:
            key = np.array(struct.unpack(f">{samples}H", clear[: 2 * samples]), np.int64)
            shown = np.concatenate([shown, np.where((out == key).all(axis=2, keepdims=True), 0, 255).astype(np.uint8)], axis=2)
        out = shown
    return Raster(width, height, out.shape[2], out.astype(np.uint8).tobytes())


def _unfiltered(raw: bytes, height: int, row: int, step: int) -> np.ndarray:
    """Rows of bytes after the line filters; sums along a row go by its samples."""
    lines = np.frombuffer(raw, np.uint8).reshape(height, row + 1)
    out = np.zeros((height, row), np.uint8)
    above = np.zeros(row, np.uint8)
    for y in range(height):
        kind, line = lines[y, 0], lines[y, 1:]
        _need(kind < 5)
        if kind == 0:
            now = line
        elif kind == 1:
            pad = np.concatenate([line, np.zeros(-row % step, np.uint8)]).reshape(-1, step)
            now = np.cumsum(pad, axis=0, dtype=np.uint8).reshape(-1)[:row]
        elif kind == 2:
            now = line + above
        else:
            now = np.array(_by_neighbours(bytearray(line), above.tobytes(), step, kind == 4), np.uint8)
        out[y] = above = now
    return out


def _by_neighbours(line: bytearray, above: bytes, step: int, paeth: bool) -> bytearray:
    for i in range(len(line)):
        a, c = (line[i - step], above[i - step]) if i >= step else (0, 0)
        b = above[i]
        if not paeth:
            guess = (a + b) >> 1
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        line[i] = (line[i] + guess) & 255
    return line


def write_png(width: int, height: int, pixels: bytes) -> bytes:
    """An 8-bit RGB image."""
    rows = np.frombuffer(pixels, np.uint8).reshape(height, width * 3)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


# ---- BMP and GIF ---------------------------------------------------------------


def read_bmp(data: bytes) -> Raster:
    """24 or 32 bits, uncompressed, of exactly the declared length."""
    _need(len(data) >= 54 and data[:2] == b"BM")
    size, r1, r2, offset, dib, width, height, planes, bits, packing, declared, _, _, used, vital = struct.unpack_from("<IHHIIiiHHIIiiII", data, 2)
    _need(size == len(data) and not r1 and not r2)
    _need(dib == 40, "UNSUPPORTED_IMAGE")
    _need(offset >= 54)
    _need(offset == 54, "UNSUPPORTED_IMAGE")
    _need(width > 0 and height not in (0, -(1 << 31)))
    _fits(width, abs(height))
    _need(planes == 1 and bits in (24, 32) and not packing and not used and not vital, "UNSUPPORTED_IMAGE")
    n = bits // 8
    stride = width * n + 3 & ~3
    _need(len(data) == 54 + stride * abs(height) and declared in (0, stride * abs(height)))
    rows = np.frombuffer(data, np.uint8, offset=54).reshape(abs(height), stride)[:, : width * n].reshape(abs(height), width, n)
    rows = rows if height < 0 else rows[::-1]
    order = [2, 1, 0, 3][:n]
    return Raster(width, abs(height), n, rows[..., order].tobytes())


def write_bmp(width: int, height: int, pixels: bytes) -> bytes:
    """24 bits, rows from the bottom, padded to four bytes."""
    stride = width * 3 + 3 & ~3
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = np.frombuffer(pixels, np.uint8).reshape(height, width, 3)[::-1, :, ::-1].reshape(height, -1)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + stride * height, 0, 0, 54, 40, width, height, 1, 24, 0, stride * height, 2835, 2835, 0, 0)
    return head + rows.tobytes()


def read_gif(data: bytes) -> Raster:
    """One frame that fills the canvas; expanded to RGBA."""
    _need(data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 13)
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    _fits(width, height)
    at, palette, clear, frame = 13, None, None, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        palette, at = data[at : at + n], at + n

    def blocks(at: int) -> tuple[bytes, int]:
        out = []
        while True:
            _need(at < len(data))
            n = data[at]
            if not n:
                return b"".join(out), at + 1
            _need(at + 1 + n <= len(data))
            out.append(data[at + 1 : at + 1 + n])
            at += 1 + n

    while True:
        _need(at < len(data))
        kind = data[at]
        if kind == 0x3B:
            break
        if kind == 0x21:
            _need(at + 2 < len(data))
            label = data[at + 1]
            body, at = blocks(at + 2)
            if label == 0xF9 and len(body) == 4 and body[0] & 1:
                clear = body[3]
            _need(not (label == 0xFF and body[:11] == b"ICCRGBG1012"), "UNSUPPORTED_IMAGE")
            continue
        _need(kind == 0x2C and at + 10 < len(data))
        _need(frame is None, "UNSUPPORTED_IMAGE")
        left, top, w, h, own = struct.unpack_from("<4HB", data, at + 1)
        _need((left, top, w, h) == (0, 0, width, height), "UNSUPPORTED_IMAGE")
        at += 10
        if own & 0x80:
            n = 3 << ((own & 7) + 1)
            palette, at = data[at : at + n], at + n
        _need(at < len(data))
        least = data[at]
        body, at = blocks(at + 1)
        frame = (_unpacked(body, least, width * height), bool(own & 0x40))
    _need(frame is not None and bool(palette))
    index = np.frombuffer(frame[0], np.uint8).reshape(height, width)
    if frame[1]:
        order = [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, height, step)]
        index = index[np.argsort(order)]
    table = np.frombuffer(palette, np.uint8).reshape(-1, 3)
    _need(int(index.max()) < len(table))
    alpha = np.where(index == clear, 0, 255).astype(np.uint8) if clear is not None else np.full(index.shape, 255, np.uint8)
    return Raster(width, height, 4, np.concatenate([table[index], alpha[..., None]], axis=2).tobytes())


def _unpacked(data: bytes, least: int, size: int) -> bytes:
    """LZW codes of growing width, least significant bits first, up to the end code."""
    _need(2 <= least <= 8)
    wipe, end = 1 << least, (1 << least) + 1
    table, width, last, out, n, bits, have = [], 0, None, [], 0, 0, 0
    for byte in data:
        bits |= byte << have
        have += 8
        while have >= (width or least + 1):
            width = width or least + 1
            code, bits, have = bits & ((1 << width) - 1), bits >> width, have - width
            if code == wipe:
                table, width, last = [bytes([i]) for i in range(wipe)] + [b"", b""], least + 1, None
                continue
            if code == end:
                _need(n == size)
                return b"".join(out)
            if not table:
                table = [bytes([i]) for i in range(wipe)] + [b"", b""]
            _need(code < len(table) or (code == len(table) and last is not None and len(table) < 4096))
            piece = table[code] if code < len(table) else last + last[:1]
            _need(bool(piece))
            if last is not None and len(table) < 4096:
                table.append(last + piece[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            out.append(piece)
            n += len(piece)
            _need(n <= size)
            last = piece
    raise ImageError("INVALID_IMAGE")


# ---- headers only --------------------------------------------------------------


def read_webp(data: bytes) -> Raster:
    """Size and alpha of a still image; animation, profile and metadata are refused. Pixels are not decoded."""
    _need(data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 20)
    chunks, at = {}, 12
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        _need(at + 8 + size <= len(data))
        chunks.setdefault(kind, data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    _need(not {b"ANIM", b"ANMF", b"ICCP", b"EXIF"} & chunks.keys(), "UNSUPPORTED_IMAGE")
    if b"VP8 " in chunks:
        body = chunks[b"VP8 "]
        _need(len(body) >= 10 and body[3:6] == b"\x9d\x01\x2a")
        width, height = (x & 0x3FFF for x in struct.unpack_from("<HH", body, 6))
        channels = 4 if b"ALPH" in chunks else 3
    else:
        body = chunks.get(b"VP8L", b"")
        _need(len(body) >= 5 and body[0] == 0x2F)
        word = int.from_bytes(body[1:5], "little")
        width, height, channels = (word & 0x3FFF) + 1, (word >> 14 & 0x3FFF) + 1, 4 if word >> 28 & 1 else 3
    if b"VP8X" in chunks:
        x = chunks[b"VP8X"]
        _need(len(x) >= 10 and (int.from_bytes(x[4:7], "little") + 1, int.from_bytes(x[7:10], "little") + 1) == (width, height))
    _fits(width, height)
    return Raster(width, height, channels, None)


def read_tiff(data: bytes) -> Raster:
    """One directory of 8-bit gray or RGB with or without alpha, chunky, upright; uncompressed or deflated strips are decoded."""
    _need(data[:4] in (b"II*\0", b"MM\0*") and len(data) >= 14)
    e = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(e + "I", data, 4)[0]
    try:
        count = struct.unpack_from(e + "H", data, at)[0]
        _need(count > 0)
        tags = {}
        for i in range(count):
            tag, kind, n = struct.unpack_from(e + "HHI", data, at + 2 + 12 * i)
            form, size = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}.get(kind, ("", 0))
            if not size or n > 1 << 20:
                tags[tag] = ()
                continue
            where = at + 10 + 12 * i if n * size <= 4 else struct.unpack_from(e + "I", data, at + 10 + 12 * i)[0]
            tags[tag] = struct.unpack_from(f"{e}{n}{form}", data, where)
        following = struct.unpack_from(e + "I", data, at + 2 + 12 * count)[0]
    except struct.error:
        raise ImageError("INVALID_IMAGE") from None
    one = lambda tag, default=0: (tags.get(tag) or (default,))[0]
    _need(not following, "UNSUPPORTED_IMAGE")
    width, height, samples = one(256), one(257), one(277, 1)
    _fits(width, height)
    extra, color = tags.get(338, ()), one(262, -1)
    base = {1: 1, 2: 3}.get(color, 0)
    _need(base > 0 and set(tags.get(258, (1,))) == {8} and one(284, 1) == 1 and one(274, 1) == 1 and not {34675, 330} & tags.keys(), "UNSUPPORTED_IMAGE")
    _need((samples == base and not extra) or (samples == base + 1 and extra in ((1,), (2,))), "UNSUPPORTED_IMAGE")
    if one(259, 1) not in (1, 8, 32946) or one(317, 1) not in (1, 2) or 273 not in tags:
        return Raster(width, height, samples, None)
    parts = []
    for start, size in zip(tags[273], tags.get(279, ()), strict=False):
        part = data[start : start + size]
        _need(len(part) == size)
        try:
            parts.append(part if one(259, 1) == 1 else zlib.decompressobj().decompress(part, MAX_DECODED))
        except zlib.error:
            raise ImageError("INVALID_IMAGE") from None
    raw = b"".join(parts)
    _need(len(raw) == width * height * samples)
    pixels = np.frombuffer(raw, np.uint8).reshape(height, width, samples)
    if one(317, 1) == 2:
        pixels = np.cumsum(pixels, axis=1, dtype=np.uint8)
    if extra == (1,):
        pixels = unpremultiplied(pixels)
    return Raster(width, height, samples, pixels.tobytes())


def unpremultiplied(pixels: np.ndarray) -> np.ndarray:
    """Colours divided by their alpha (the last sample), to the nearest; 0 where nothing is seen."""
    alpha = pixels[..., -1:].astype(np.int64)
    colour = np.where(alpha == 0, 0, np.minimum((pixels[..., :-1].astype(np.int64) * 255 + alpha // 2) // np.maximum(alpha, 1), 255))
    return np.concatenate([colour, alpha], axis=-1).astype(np.uint8)


def exif_orientation(segment: bytes) -> int:
    """The orientation that an EXIF segment gives; 1 without one."""
    tiff = segment[6:]
    e = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    _need(e is not None)
    try:
        magic, at = struct.unpack_from(e + "HI", tiff, 2)
        _need(magic == 42)
        for i in range(struct.unpack_from(e + "H", tiff, at)[0]):
            tag, kind, n, value = struct.unpack_from(e + "HHIH", tiff, at + 2 + 12 * i)
            if tag == 0x0112:
                _need((kind, n) == (3, 1))
                return value
    except struct.error:
        raise ImageError("INVALID_IMAGE") from None
    return 1


class Jpeg(NamedTuple):
    width: int
    height: int
    components: int
    transform: int


_OTHER_FRAMES = set(range(0xC1, 0xD0)) - {0xC2, 0xC4}


def inspect_jpeg(data: bytes) -> Jpeg:
    """Markers of a baseline or progressive 8-bit image, gray or of three components, upright, without profile.

    The coded data must be at least a bit a block (two in a sequential one). Pixels are not decoded.
    """
    _need(data[:2] == b"\xff\xd8")
    at, frame, scans, tables, scanning, coded, least, transform = 2, None, 0, False, False, 0, 0, 1
    while True:
        while scanning or data[at : at + 1] == b"\xff":
            mark = data.find(b"\xff", at)
            _need(mark >= 0)
            coded += mark - at
            at = mark + 1
            while data[at : at + 1] == b"\xff":
                at += 1
            _need(at < len(data))
            kind = data[at]
            at += 1
            if not scanning or not (kind == 0 or 0xD0 <= kind <= 0xD7):
                break
            coded += kind == 0
        else:
            raise ImageError("INVALID_IMAGE")
        if kind == 0xD9:
            _need(frame is not None and scans > 0 and tables and at == len(data) and coded >= (least + 7) // 8)
            return Jpeg(*frame, transform)
        _need(kind not in (0, 1, 0xD8) and not 0xD0 <= kind <= 0xD7 and at + 2 <= len(data))
        size = int.from_bytes(data[at : at + 2], "big")
        _need(size >= 2 and at + size <= len(data))
        body = data[at + 2 : at + size]
        if kind in (0xC0, 0xC2):
            _need(frame is None and size >= 11)
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            _need(depth == 8 and n in (1, 3) and size == 8 + 3 * n, "UNSUPPORTED_IMAGE")
            _fits(width, height)
            factors = [(b >> 4, b & 15) for b in body[7::3]]
            _need(all(1 <= h <= 4 and 1 <= v <= 4 for h, v in factors))
            wide, tall = max(h for h, _ in factors), max(v for _, v in factors)
            blocks = sum(-(-width * h // (8 * wide)) * -(-height * v // (8 * tall)) for h, v in factors)
            frame, least = (width, height, n), blocks * (2 if kind == 0xC0 else 1)
        elif kind == 0xDA:
            _need(frame is not None and len(body) > 0 and 0 < body[0] <= frame[2] and size == 6 + 2 * body[0] and tables)
            scans += 1
        elif kind == 0xDB:
            tables = True
        elif kind == 0xE1 and body[:6] == b"Exif\0\0":
            _need(exif_orientation(body) == 1, "UNSUPPORTED_IMAGE")
        elif kind == 0xE2:
            _need(body[:12] != b"ICC_PROFILE\0", "UNSUPPORTED_IMAGE")
        elif kind == 0xEE and len(body) >= 12 and body[:5] == b"Adobe":
            _need(body[11] <= 1, "UNSUPPORTED_IMAGE")
            transform = body[11]
        elif kind in _OTHER_FRAMES:
            raise ImageError("UNSUPPORTED_IMAGE")
        scanning = kind == 0xDA
        at += size


_READERS = {"png": read_png, "bmp": read_bmp, "gif": read_gif, "webp": read_webp, "tif": read_tiff, "tiff": read_tiff}


def read_image(data: bytes | None, form: str) -> Raster | Jpeg:
    """An image by its extension. Raises ``ImageError``."""
    _need(bool(data) and (form in _READERS or form in ("jpg", "jpeg")))
    _need(len(data) <= MAX_INPUT, "IMAGE_TOO_LARGE")
    return _READERS[form](data) if form in _READERS else inspect_jpeg(data)


# ---- PDF -----------------------------------------------------------------------


def _image_objects(first: int, image: Raster | Jpeg, data: bytes) -> list[bytes]:
    """Page, content, image and (for alpha) mask; objects from ``first`` on. JPEG bytes go as they are."""
    w, h = image.width, image.height
    scale = min(1.0, MAX_PAGE_SIDE / max(w, h))
    pw, ph = f"{w * scale:.4f}", f"{h * scale:.4f}"
    mask, extra = None, ""
    if isinstance(image, Jpeg):
        n, body, how = image.components, data, "/DCTDecode"
        extra = f" /DecodeParms << /ColorTransform {image.transform} >>" if n == 3 else ""
    else:
        _need(image.pixels is not None, "UNSUPPORTED_IMAGE")
        samples = np.frombuffer(image.pixels, np.uint8).reshape(h, w, image.channels)
        n, how = (1 if image.channels < 3 else 3), "/FlateDecode"
        body = zlib.compress(samples[..., :n].tobytes())
        if image.channels in (2, 4):
            mask = zlib.compress(samples[..., -1].tobytes())
            extra = f" /SMask {first + 3} 0 R"
    picture = lambda space, more, how, raw: f"<< /Type /XObject /Subtype /Image /Width {w} /Height {h} /ColorSpace {space} /BitsPerComponent 8 /Filter {how}{more} /Length {len(raw)} >>\nstream\n".encode() + raw + b"\nendstream"
    draw = f"q\n{pw} 0 0 {ph} 0 0 cm\n/Im0 Do\nQ\n".encode()
    out = [
        f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {pw} {ph}] /Resources << /XObject << /Im0 {first + 2} 0 R >> >> /Contents {first + 1} 0 R >>".encode(),
        b"<< /Length %d >>\nstream\n%s\nendstream" % (len(draw), draw),
        picture("/DeviceGray" if n == 1 else "/DeviceRGB", extra, how, body),
    ]
    return out + ([picture("/DeviceGray", "", "/FlateDecode", mask)] if mask is not None else [])


def images_pdf(images: list[tuple[bytes, str]]) -> bytes:
    """One page per image, in order; at most 200 of 512 MiB together. Raises ``ImageError``."""
    _need(0 < len(images) <= MAX_MERGED and sum(len(d or b"") for d, _ in images) <= MAX_MERGED_BYTES, "IMAGE_TOO_LARGE")
    bodies, kids = [b"<< /Type /Catalog /Pages 2 0 R >>", b""], []
    for data, form in images:
        kids.append(f"{len(bodies) + 1} 0 R")
        bodies += _image_objects(len(bodies) + 1, read_image(data, (form or "").lower()), data)
    bodies[1] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>".encode()
    return assembled(bodies, "1.4")


_WRITERS = {"png": write_png, "bmp": write_bmp}


def write_image(width: int, height: int, pixels: bytes, form: str) -> bytes:
    """RGB pixels as PNG or BMP; other formats have no encoder here."""
    _need(form in _WRITERS and len(pixels) == width * height * 3, "UNSUPPORTED_IMAGE")
    return _WRITERS[form](width, height, pixels)


# ---- frames --------------------------------------------------------------------


def inspected(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, width, height, channels, decoded, error_code) of (key, content, format): a row per image."""

    def made(k, data, form):
        try:
            image = read_image(data, (form or "").lower())
            channels = image.components if isinstance(image, Jpeg) else image.channels
            yield k, image.width, image.height, channels, isinstance(image, Raster) and image.pixels is not None, None
        except ImageError as e:
            yield k, None, None, None, None, e.args[0]

    return rows_from(files, [key, "content", "format"], f"{key} {dict(files.dtypes)[key]}, width int, height int, channels int, decoded boolean, error_code string", made)


def image_pdf(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, content, error_code): each image of (key, content, format) as a PDF of one page."""

    def made(k, data, form):
        try:
            yield k, images_pdf([(data, form or "")]), None
        except ImageError as e:
            yield k, None, e.args[0]

    return rows_from(files, [key, "content", "format"], f"{key} {dict(files.dtypes)[key]}, content binary, error_code string", made)


def merged_pdf(files: DataFrame, batch: str, position: str) -> DataFrame:
    """(batch, content, error_code): the images of a batch, by position, as one PDF; one bad image fails its batch.

    A batch is one file and is put together in one task; more than 200 images are an error.
    """
    kind = dict(files.dtypes)[batch]

    def merged(table: pa.Table) -> pa.Table:
        table = table.sort_by(position)
        try:
            content, error = images_pdf(list(zip(table.column("content").to_pylist(), table.column("format").to_pylist(), strict=True))), None
        except ImageError as e:
            content, error = None, e.args[0]
        return pa.table([table.column(batch)[:1], pa.array([content], pa.binary()), pa.array([error], pa.string())], [batch, "content", "error_code"])

    return files.select(batch, position, "content", "format").groupBy(batch).applyInArrow(merged, f"{batch} {kind}, content binary, error_code string")
