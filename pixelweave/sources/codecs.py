"""Small encoders and decoders of image files: bytes to (width, height, rgba) and back.

A decoder takes bytes and returns an (h, w, 4) uint8 array, or None for what it does not support;
an encoder takes such an array. They run inside tasks, an image at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np

from . import jpeg

Image = np.ndarray
MAGIC = b"\x89PNG\r\n\x1a\n"


def _opaque(rgb: Image) -> Image:
    return np.dstack([rgb, np.full(rgb.shape[:2], 255, np.uint8)])


# ------------------------------------------------------------------ PNG


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(kind, bytes) of the chunks; one whose checksum is wrong, or that is cut off, is a ValueError."""
    out, at = [], len(MAGIC)
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body, check = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if check != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise ValueError(f"the {kind.decode('latin-1')} chunk is damaged")
        out.append((kind, body))
        at += 12 + n
        if kind == b"IEND":
            break
    return out


def png_notes(data: bytes) -> list[tuple[str, str | None, bytes]]:
    """(kind, name, bytes) of the chunks that carry no pixels, compressed ones inflated; texts as UTF-8, kind "text"."""
    out: list[tuple[str, str | None, bytes]] = []
    try:
        chunks = png_chunks(data) if data.startswith(MAGIC) else []
    except ValueError:
        return out
    for kind, body in chunks:
        try:
            if kind in (b"tEXt", b"zTXt", b"iCCP"):
                name, _, rest = body.partition(b"\0")
                plain = rest if kind == b"tEXt" else zlib.decompress(rest[1:])
                out.append(("iCCP", name.decode("latin-1"), plain) if kind == b"iCCP" else ("text", name.decode("latin-1"), plain.decode("latin-1").encode()))
            elif kind == b"iTXt":
                name, _, rest = body.partition(b"\0")
                plain = rest[2:].split(b"\0", 2)[2]
                out.append(("text", name.decode("latin-1"), (zlib.decompress(plain) if rest[0] else plain).decode("utf-8", "replace").encode()))
            elif kind != b"IDAT":
                out.append((kind.decode("latin-1"), None, body))
        except (zlib.error, IndexError):  # a broken note does not cost the others
            continue
    return out


def png_lines(rows: np.ndarray, above: np.ndarray, n: int) -> bytes:
    """Filtered lines of (h, w * n) bytes below the line `above`: each with the filter of least absolute sum."""
    rows, h = rows.astype(np.int16), len(rows)
    whole = np.vstack([above.astype(np.int16)[None], rows])
    up = whole[:-1]
    shifted = np.hstack([np.zeros((h + 1, n), np.int16), whole[:, :-n]])
    left, corner = shifted[1:], shifted[:-1]
    p = left + up - corner
    pa, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
    paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
    kinds = [(rows - guess) & 255 for guess in (0, left, up, (left + up) >> 1, paeth)]
    cost = np.array([np.minimum(k, 256 - k).sum(axis=1) for k in kinds])
    best = cost.argmin(axis=0)
    return b"".join(bytes([best[y]]) + kinds[best[y]][y].astype(np.uint8).tobytes() for y in range(h))


def encode_png(image: Image, alpha: bool = True, level: int = 6) -> bytes:
    """True colour, with alpha if asked."""
    h, w = image.shape[:2]
    n = 4 if alpha else 3
    lines = png_lines(image[:, :, :n].reshape(h, w * n), np.zeros(w * n, np.uint8), n)
    head = struct.pack(">IIBBBBB", w, h, 8, 6 if alpha else 2, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, level)) + _chunk(b"IEND", b"")


def png_band(rows: np.ndarray, above: np.ndarray, n: int, first: bool, last: bool, level: int = 6) -> tuple[bytes, int, int]:
    """(an IDAT chunk, checksum of its filtered lines, their length) of a band of lines: a piece of one deflate stream that needs
    nothing of the pieces before it."""
    lines = png_lines(rows, above, n)
    coder = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = coder.compress(lines) + coder.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)
    return _chunk(b"IDAT", (b"\x78\x9c" if first else b"") + body), zlib.adler32(lines), len(lines)


def _unfilter(raw: bytes, at: int, h: int, row: int, step: int) -> tuple[np.ndarray, int]:
    out = np.zeros((h, row), np.uint8)
    before = np.zeros(row, np.uint8)
    for y in range(h):
        kind, line = raw[at], np.frombuffer(raw, np.uint8, row, at + 1).copy()
        at += 1 + row
        if kind == 2:
            line += before
        elif kind:
            for i in range(row):  # each byte needs the one `step` before it
                a = int(line[i - step]) if i >= step else 0
                b = int(before[i])
                c = int(before[i - step]) if i >= step else 0
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + b) >> 1
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                line[i] = (int(line[i]) + guess) & 255
        out[y] = before = line
    return out, at


#: First column, first row, column step, row step of the interlacing passes.
_ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def decode_png(data: bytes) -> Image | None:
    """Colour types 0, 2, 3, 4, 6 at all depths, interlaced or not; 16-bit samples keep their high byte."""
    if not data.startswith(MAGIC):
        return None
    chunks = png_chunks(data)
    found = dict(reversed(chunks))
    w, h, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", found[b"IHDR"])
    raw = zlib.decompress(b"".join(d for k, d in chunks if k == b"IDAT"))
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    out, at = np.zeros((h, w, samples), np.uint8), 0
    for x0, y0, dx, dy in _ADAM7 if interlace else ((0, 0, 1, 1),):
        pw, ph = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if pw <= 0 or ph <= 0:
            continue
        rows, at = _unfilter(raw, at, ph, -(-pw * samples * depth // 8), max(1, samples * depth // 8))
        if depth == 16:
            values = rows[:, ::2]
        elif depth == 8:
            values = rows
        else:
            values = np.unpackbits(rows, axis=1).reshape(ph, -1, depth) @ (1 << np.arange(depth - 1, -1, -1))
            values = (values if kind == 3 else values * 255 // ((1 << depth) - 1)).astype(np.uint8)
        out[y0::dy, x0::dx] = values[:, : pw * samples].reshape(ph, pw, samples)
    if kind == 3:
        palette = np.frombuffer(found[b"PLTE"], np.uint8).reshape(-1, 3)
        alpha = np.full(len(palette), 255, np.uint8)
        given = np.frombuffer(found.get(b"tRNS", b""), np.uint8)[: len(palette)]
        alpha[: len(given)] = given
        return np.dstack([palette[out[:, :, 0]], alpha[out[:, :, 0]]])
    if kind in (0, 4):
        gray = np.repeat(out[:, :, :1], 3, axis=2)
        return np.dstack([gray, out[:, :, 1]]) if kind == 4 else _opaque(gray)
    return out if kind == 6 else _opaque(out)


# ------------------------------------------------------------------ BMP


def encode_bmp(image: Image, alpha: bool = True) -> bytes:
    """Bottom-up 24 bits, or 32 bits with a V4 header."""
    h, w = image.shape[:2]
    if alpha:
        body = image[::-1, :, [2, 1, 0, 3]].tobytes()
        head = struct.pack("<IiiHHIIiiII4I", 108, w, h, 1, 32, 3, len(body), 2835, 2835, 0, 0, 0xFF0000, 0xFF00, 0xFF, 0xFF000000) + b"BGRs" + bytes(48)
    else:
        row = np.zeros((h, -(-w * 3 // 4) * 4), np.uint8)
        row[:, : w * 3] = image[::-1, :, [2, 1, 0]].reshape(h, w * 3)
        body = row.tobytes()
        head = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0)
    return b"BM" + struct.pack("<IHHI", 14 + len(head) + len(body), 0, 0, 14 + len(head)) + head + body


def decode_bmp(data: bytes) -> Image | None:
    """1, 4, 8, 24 and 32 bits and bit fields, without run-length coding; a negative height means lines from the top."""
    if data[:2] != b"BM":
        return None
    at = struct.unpack_from("<I", data, 10)[0]
    size, w, h, _, depth, coding = struct.unpack_from("<IiiHHI", data, 14)
    if not h or w <= 0 or coding not in (0, 3):
        return None
    down, h = h < 0, abs(h)
    row = -(-w * depth // 32) * 4
    lines = np.frombuffer(data, np.uint8, row * h, at).reshape(h, row)
    lines = lines if down else lines[::-1]
    if depth <= 8:
        used = struct.unpack_from("<I", data, 46)[0] or 1 << depth
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(-1, 4)[:, [2, 1, 0]]
        bits = np.unpackbits(lines, axis=1)[:, : w * depth].reshape(h, w, depth)
        return _opaque(palette[bits @ (1 << np.arange(depth - 1, -1, -1))])
    if depth == 24:
        return _opaque(lines[:, : w * 3].reshape(h, w, 3)[:, :, ::-1])
    words = lines[:, : w * depth // 8].reshape(h, w, depth // 8).copy().view("<u4" if depth == 32 else "<u2")[:, :, 0].astype(np.uint64)
    masks = struct.unpack_from("<4I", data, 54) if coding == 3 and size >= 56 else (*struct.unpack_from("<3I", data, 54), 0) if coding == 3 else (0xFF0000, 0xFF00, 0xFF, 0) if depth == 32 else (0x7C00, 0x3E0, 0x1F, 0)
    out = np.full((h, w, 4), 255, np.uint8)
    for i, m in enumerate(masks):
        if m:
            shift = (m & -m).bit_length() - 1
            out[:, :, i] = ((words & np.uint64(m)) >> np.uint64(shift)) * 255 // (m >> shift)
    return out


# ------------------------------------------------------------------ Targa


def encode_targa(image: Image, alpha: bool = True) -> bytes:
    h, w = image.shape[:2]
    order = [2, 1, 0, 3] if alpha else [2, 1, 0]
    return struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, w, h, 8 * len(order), 8 if alpha else 0) + image[::-1][:, :, order].tobytes()


def decode_targa(data: bytes) -> Image | None:
    """Uncompressed paletted, true-colour and gray files, any origin."""
    if len(data) < 18:
        return None
    n_id, _, kind, first, count, bits, _, _, w, h, depth, flags = struct.unpack_from("<BBBHHBHHHHBB", data)
    if kind not in (1, 2, 3) or not w or not h:
        return None
    at = 18 + n_id

    def colors(raw: np.ndarray, size: int) -> np.ndarray:
        if size in (15, 16):
            v = raw.reshape(-1, 2).copy().view("<u2")[:, 0].astype(np.int64)
            five = np.stack([v >> 10 & 31, v >> 5 & 31, v & 31], axis=1)
            return np.hstack([(five << 3 | five >> 2), np.full((len(v), 1), 255)]).astype(np.uint8)
        part = raw.reshape(-1, size // 8)
        return part[:, [2, 1, 0, 3]] if size == 32 else np.hstack([part[:, [2, 1, 0]], np.full((len(part), 1), 255, np.uint8)])

    step = -(-bits // 8)
    palette = colors(np.frombuffer(data, np.uint8, count * step, at), bits) if count else None
    at += count * step
    raw = np.frombuffer(data, np.uint8, w * h * -(-depth // 8), at)
    if kind == 1:
        index = raw.astype(np.int64) if depth == 8 else raw.reshape(-1, 2).copy().view("<u2")[:, 0].astype(np.int64)
        flat = palette[index - first]
    elif kind == 3:
        flat = np.hstack([np.repeat(raw.reshape(-1, 1), 3, axis=1), np.full((w * h, 1), 255, np.uint8)])
    else:
        flat = colors(raw, depth)
    image = flat.reshape(h, w, 4)
    image = image if flags & 32 else image[::-1]
    return image[:, ::-1] if flags & 16 else image


# ------------------------------------------------------------------ GIF


def _lzw_encode(index: bytes, bits: int) -> bytes:
    clear, size = 1 << bits, bits + 1
    table, out, held, n = {bytes([i]): i for i in range(clear)}, bytearray(), 0, 0

    def put(code: int) -> None:
        nonlocal held, n
        held |= code << n
        n += size
        while n >= 8:
            out.append(held & 255)
            held >>= 8
            n -= 8

    put(clear)
    run = b""
    for b in index:
        more = run + bytes([b])
        if more in table:
            run = more
            continue
        put(table[run])
        table[more] = len(table) + 2
        if len(table) + 1 == 1 << size and size < 12:
            size += 1
        elif len(table) + 2 > 4095:
            put(clear)
            table, size = {bytes([i]): i for i in range(clear)}, bits + 1
        run = bytes([b])
    if run:
        put(table[run])
    put(clear + 1)
    if n:
        out.append(held & 255)
    return bytes(out)


def _lzw_decode(data: bytes, bits: int, n: int) -> bytes:
    clear = 1 << bits
    out, table, size, before = bytearray(), [], bits + 1, b""
    held = have = 0
    for byte in data:
        held |= byte << have
        have += 8
        while have >= size:
            code, held, have = held & ((1 << size) - 1), held >> size, have - size
            if code == clear:
                table, size, before = [bytes([i]) for i in range(clear)] + [b"", b""], bits + 1, b""
                continue
            if code == clear + 1 or len(out) >= n:
                return bytes(out[:n])
            if not before:
                entry = table[code]
            else:
                entry = table[code] if code < len(table) else before + before[:1]
                if len(table) < 4096:
                    table.append(before + entry[:1])
            out += entry
            before = entry
            if len(table) == 1 << size and size < 12:
                size += 1
    return bytes(out[:n])


def encode_gif(frames: list[tuple], repeat: int | None = 0, comment: str | None = None) -> bytes:
    """An animation of (rgba image, delay in 1/100 s[, left, top, disposal]) with at most 256 colours a frame; alpha 0 is
    transparent. The canvas holds all frames; `repeat` (0: for ever) is said for more than one frame, None never."""
    frames = [(*f, *(0, 0, 0)[len(f) - 2 :]) for f in frames]
    w, h = (max(f[2 + k] + f[0].shape[1 - k] for f in frames) for k in (0, 1))
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0, 0, 0)
    if len(frames) > 1 and repeat is not None:
        out += b"!\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", repeat) + b"\0"
    if comment:
        said = comment.encode("latin-1", "replace")
        out += b"!\xfe" + b"".join(bytes([len(said[i : i + 255])]) + said[i : i + 255] for i in range(0, len(said), 255)) + b"\0"
    for image, delay, left, top, disposal in frames:
        shown = image.copy()
        shown[shown[:, :, 3] == 0] = 0
        colors, index = np.unique(shown.reshape(-1, 4), axis=0, return_inverse=True)
        if len(colors) > 256:
            raise ValueError("a GIF frame has at most 256 colours: map it to a palette first")
        clear = np.flatnonzero(colors[:, 3] == 0)
        bits = max(2, int(len(colors) - 1).bit_length())
        palette = np.zeros((1 << bits, 3), np.uint8)
        palette[: len(colors)] = colors[:, :3]
        fh, fw = image.shape[:2]
        out += b"!\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (1 if len(clear) else 0), delay, int(clear[0]) if len(clear) else 0, 0)
        out += b"," + struct.pack("<HHHHB", left, top, fw, fh, 0x80 | (bits - 1)) + palette.tobytes() + bytes([bits])
        body = _lzw_encode(index.astype(np.uint8).tobytes(), bits)
        out += b"".join(bytes([len(body[i : i + 255])]) + body[i : i + 255] for i in range(0, len(body), 255)) + b"\0"
    return out + b";"


class Animation(NamedTuple):
    """A GIF file: canvas, repeat count and comment where it says them, and its frames as (rgba image, x, y, delay in 1/100 s,
    disposal, whether it waits for a key, whether it has a palette of its own)."""

    width: int
    height: int
    repeat: int | None
    comment: str | None
    frames: list[tuple[Image, int, int, int, int, bool, bool]]


def decode_gif_frames(data: bytes) -> list[tuple[Image, int, int, int]]:
    """(rgba image, x, y, delay in 1/100 s) of every frame."""
    return [f[:4] for f in gif_animation(data).frames] if data[:6] in (b"GIF87a", b"GIF89a") else []


def gif_animation(data: bytes) -> Animation:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF file")
    width, height = struct.unpack_from("<HH", data, 6)
    flags = data[10]
    at, shared = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3), at + 3 * n
    frames: list[tuple[Image, int, int, int, int, bool, bool]] = []
    clear, delay, disposal, waits = -1, 0, 0, False
    repeat: int | None = None
    comment: str | None = None

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            body, at = blocks(at + 2)
            if kind == 0xF9:
                clear, delay = (body[3] if body[0] & 1 else -1), struct.unpack_from("<H", body, 1)[0]
                disposal, waits = body[0] >> 2 & 7, bool(body[0] & 2)
            elif kind == 0xFE:
                comment = body.decode("latin-1")
            elif kind == 0xFF and body[:11] == b"NETSCAPE2.0" and body[11:12] == b"\x01" and len(body) >= 14:
                repeat = struct.unpack_from("<H", body, 12)[0]
        elif data[at] == 0x2C:
            x, y, w, h, f = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = shared
            if f & 0x80:
                n = 2 << (f & 7)
                palette, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3), at + 3 * n
            if palette is None:
                palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
            bits = data[at]
            body, at = blocks(at + 1)
            index = np.frombuffer(_lzw_decode(body, bits, w * h), np.uint8).reshape(h, w)
            if f & 0x40:
                order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
                placed = np.empty_like(index)
                placed[order] = index
                index = placed
            image = _opaque(palette[index])
            image[index == clear] = 0
            frames.append((image, x, y, delay, disposal, waits, bool(f & 0x80)))
            clear, delay, disposal, waits = -1, 0, 0, False
        else:
            break
    return Animation(width, height, repeat, comment, frames)


def decode_gif(data: bytes) -> Image | None:
    frames = decode_gif_frames(data)
    return frames[0][0] if frames else None


def gif_of(image: Image) -> bytes:
    return encode_gif([(image, 0)])


#: (decoder, encoder) by format; register() adds, replaces or removes.
LOADERS: dict[str, Callable[[bytes], Image | None]] = {"png": decode_png, "bmp": decode_bmp, "targa": decode_targa, "gif": decode_gif}
SAVERS: dict[str, Callable[[Image], bytes]] = {"png": encode_png, "bmp": encode_bmp, "targa": encode_targa, "gif": gif_of, "jpeg": jpeg.encode}


def register(name: str, loader: Callable | None, saver: Callable | None) -> None:
    """Add or replace a format; None removes that direction."""
    for table, f in ((LOADERS, loader), (SAVERS, saver)):
        if f is None:
            table.pop(name, None)
        else:
            table[name] = f
