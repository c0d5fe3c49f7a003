"""Baseline JPEG, written in bands of eight lines: Spark deals the bands, these helpers code one band each.

Every band ends with a restart, so no band needs another one, and a large image spreads over many tasks.
Colours are not subsampled. One Huffman table for direct and one for alternating coefficients serve all
images; both follow from assumed frequencies, so no pass over the data has to count symbols.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

# The quantization tables that the standard gives as examples (brightness, colour), row by row.
BRIGHTNESS = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
COLOUR = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]
# Red, green, blue to brightness and two colour differences.
TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.299 / 1.772, -0.587 / 1.772, 0.5], [0.5, -0.587 / 1.402, -0.114 / 1.402]])
COSINES = np.array([[(np.sqrt(0.5) if u == 0 else 1.0) / 2 * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: Diagonals in turn, odd ones downwards.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
LONGEST = 65_535
_SKIP, _END = 0xF0, 0x00


def quantizers(quality: int) -> np.ndarray:
    """(2, 64) divisors for a quality of 1 to 100: 50 takes the tables as they are, 100 divides by one."""
    quality = min(100, max(1, quality))
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array([BRIGHTNESS, COLOUR]) * scale + 50) // 100, 1, 255)


def coefficients(rgb: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(blocks, 3, 64) whole numbers of a band (up to 8 lines, width, 3); missing places repeat the edge. Ties go up."""
    h, w = rgb.shape[:2]
    full = np.pad(rgb, ((0, 8 - h), (0, -w % 8), (0, 0)), "edge").astype(float) @ TO_YCC.T
    full[:, :, 0] -= 128
    blocks = full.reshape(8, -1, 8, 3).transpose(1, 3, 0, 2)
    waves = (COSINES @ blocks @ COSINES.T).reshape(-1, 3, 64)
    found = np.floor(waves / tables[[0, 1, 1]] + 0.5 + 1e-6).astype(np.int64)
    return np.clip(found, [[-1024] + [-1023] * 63] * 3, 1023)


def _code(weights: dict[int, float]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """Symbols a length (1 to 16), symbols in order, and (code, length) of each, for a Huffman code by weight. Code
    words of ones only stay free; the least weight rises until no word is longer than 16."""
    least = 0.0
    while True:
        heap = [(max(w, least), s, [s]) for s, w in weights.items()] + [(0.0, 256, [256])]  # 256 takes the word of ones
        heapq.heapify(heap)
        depth = dict.fromkeys([*weights, 256], 0)
        while len(heap) > 1:
            (a, _, left), (b, key, right) = heapq.heappop(heap), heapq.heappop(heap)
            for s in left + right:
                depth[s] += 1
            heapq.heappush(heap, (a + b, key, left + right))
        if max(depth.values()) <= 16:
            break
        least = max(2 * least, min(weights.values()))
    depth[256] = max(depth.values())
    order = sorted(weights, key=lambda s: (depth[s], s))
    words, at, last = {}, 0, depth[order[0]]
    for s in order:
        at <<= depth[s] - last
        last = depth[s]
        words[s] = (at, last)
        at += 1
    return [sum(depth[s] == n for s in order) for n in range(1, 17)], order, words


_DIRECT = _code({size: 2.0 ** -abs(size - 3) for size in range(12)})
_OTHERS = _code({_END: 0.3, _SKIP: 2.0**-9} | {run << 4 | size: 2.0 ** -(0.6 * run + 1.1 * size) for run in range(16) for size in range(1, 11)})


def _table(words: dict[int, tuple[int, int]]) -> np.ndarray:
    out = np.zeros((256, 2), np.int64)
    for s, pair in words.items():
        out[s] = pair
    return out


_DIRECT_WORDS, _OTHER_WORDS = _table(_DIRECT[2]), _table(_OTHERS[2])


def band(found: np.ndarray) -> bytes:
    """The coded bytes of a band's coefficients, without a restart mark."""
    v = found[:, :, ZIGZAG].reshape(-1, 64)
    v[:, 0] = np.diff(found[:, :, 0], axis=0, prepend=0).reshape(-1)
    size = np.frexp(np.abs(v))[1].astype(np.int64)
    extra = np.where(v < 0, v + (1 << size) - 1, v)
    block, place = np.nonzero(v[:, 1:])
    place += 1
    before = np.where(np.diff(block, prepend=-1) == 0, np.roll(place, 1), 0)
    run = place - before - 1
    all_blocks = np.arange(len(v))
    last = np.zeros(len(v), np.int64)
    np.maximum.at(last, block, place)
    ended, skips = all_blocks[last < 63], np.repeat(np.arange(len(block)), run // 16)
    symbol = (run % 16) << 4 | size[block, place]
    at = [all_blocks * 132, block * 132 + place * 2 + 1, block[skips] * 132 + place[skips] * 2, ended * 132 + 131]
    words = [_DIRECT_WORDS[size[:, 0]], _OTHER_WORDS[symbol], np.tile(_OTHER_WORDS[_SKIP], (len(skips), 1)), np.tile(_OTHER_WORDS[_END], (len(ended), 1))]
    none = np.zeros(len(skips) + len(ended), np.int64)
    more, wide = np.concatenate([extra[:, 0], extra[block, place], none]), np.concatenate([size[:, 0], size[block, place], none])
    order = np.argsort(np.concatenate(at), kind="stable")
    word = np.concatenate(words)[order]
    value, length = word[:, 0] << wide[order] | more[order], word[:, 1] + wide[order]
    which = np.repeat(np.arange(len(value)), length)
    behind = np.cumsum(length)[which] - 1 - np.arange(len(which))
    bits = (value[which] >> behind & 1).astype(np.uint8)
    return np.packbits(np.append(bits, np.ones(-len(bits) % 8, np.uint8))).tobytes().replace(b"\xff", b"\xff\0")


def heads(quality: int) -> tuple[bytes, bytes, bytes]:
    """The file head in three parts; height and width (two bytes each, high first) stand between the first two, and the
    blocks of a band (two bytes) between the last two."""
    tables = b"".join(bytes([i]) + bytes(t[ZIGZAG].tolist()) for i, t in enumerate(quantizers(quality)))
    codes = b"".join(bytes([kind, *counts, *order]) for kind, (counts, order, _) in ((0x00, _DIRECT), (0x10, _OTHERS)))
    mark = lambda kind, body: struct.pack(">BBH", 255, kind, 2 + len(body)) + body
    first = b"\xff\xd8" + mark(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + mark(0xDB, tables) + mark(0xC4, codes) + b"\xff\xc0\0\x11\x08"
    return first, bytes([3, 1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1]) + b"\xff\xdd\0\4", mark(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))


def encode(image: np.ndarray, quality: int = 85) -> bytes:
    """A whole image in one go; alpha is left out."""
    h, w = image.shape[:2]
    tables, (first, second, third) = quantizers(quality), heads(quality)
    lines = [band(coefficients(image[y : y + 8, :, :3], tables)) for y in range(0, h, 8)]
    body = b"".join(line + (bytes([255, 0xD0 + i % 8]) if i + 1 < len(lines) else b"") for i, line in enumerate(lines))
    return first + struct.pack(">HH", h, w) + second + struct.pack(">H", -(-w // 8)) + third + body + b"\xff\xd9"
