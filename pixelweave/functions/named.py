"""Named colours and built-in palettes."""

from __future__ import annotations

# Name and red, green, blue in hexadecimal, in list order; all opaque but `transparent`.
NAMES = """
transparent 000000, antiquewhite faebd7, aqua 00ffff, aquamarine 7fffd4, azure f0ffff, beige f5f5dc, bisque ffe4c4, black 000000,
blanchedalmond ffebcd, blue 0000ff, blueviolet 8a2be2, brown a52a2a, burlywood deb887, cadetblue 5f9ea0, chartreuse 7fff00, chocolate d2691e,
coral ff7f50, cornflowerblue 6495ed, cornsilk fff8dc, crimson dc143c, cyan 00ffff, darkblue 00008b, darkcyan 008b8b, darkgoldenrod b8860b,
darkgray a9a9a9, darkgreen 006400, darkgrey a9a9a9, darkkhaki bdb76b, darkmagenta 8b008b, darkolivegreen 556b2f, darkorange ff8c00, darkorchid 9932cc,
darkred 8b0000, darksalmon e9967a, darkseagreen 8fbc8f, darkslateblue 483d8b, darkslategray 2f4f4f, darkslategrey 2f4f4f, darkturquoise 00ced1,
darkviolet 9400d3, deeppink ff1493, deepskyblue 00bfff, dimgray 696969, dimgrey 696969, dodgerblue 1e90ff, firebrick b22222, floralwhite fffaf0,
forestgreen 228b22, fuchsia ff00ff, gainsboro dcdcdc, ghostwhite f8f8ff, gold ffd700, goldenrod daa520, gray 808080, green 008000, greenyellow adff2f,
grey 808080, honeydew f0fff0, hotpink ff69b4, indianred cd5c5c, indigo 4b0082, ivory fffff0, khaki f0e68c, lavender e6e6fa, lavenderblush fff0f5,
lawngreen 7cfc00, lemonchiffon fffacd, lightblue add8e6, lightcoral f08080, lightcyan e0ffff, lightgoldenrodyellow fafad2, lightgray d3d3d3,
lightgreen 90ee90, lightgrey d3d3d3, lightpink ffb6c1, lightsalmon ffa07a, lightseagreen 20b2aa, lightskyblue 87cefa, lightslategray 778899,
lightslategrey 778899, lightsteelblue b0c4de, lightyellow ffffe0, lime 00ff00, limegreen 32cd32, linen faf0e6, magenta ff00ff, maroon 800000,
mediumaquamarine 66cdaa, mediumblue 0000cd, mediumorchid ba55d3, mediumpurple 9370db, mediumseagreen 3cb371, mediumslateblue 7b68ee,
mediumspringgreen 00fa9a, mediumturquoise 48d1cc, mediumvioletred c71585, midnightblue 191970, mintcream f5fffa, mistyrose ffe4e1, moccasin ffe4b5,
navajowhite ffdead, navy 000080, oldlace fdf5e6, olive 808000, olivedrab 6b8e23, orange ffa500, orangered ff4500, orchid da70d6, palegoldenrod eee8aa,
palegreen 98fb98, paleturquoise afeeee, palevioletred db7093, papayawhip ffefd5, peach ffc080, peachpuff ffdab9, peru cd853f, pink ffc0cb, plum dda0dd,
powderblue b0e0e6, purple 800080, rebeccapurple 663399, red ff0000, rosybrown bc8f8f, royalblue 4169e1, saddlebrown 8b4513, salmon fa8072,
sandybrown f4a460, seagreen 2e8b57, seashell fff5ee, sienna a0522d, silver c0c0c0, skyblue 87ceeb, slateblue 6a5acd, slategray 708090, snow fffafa,
springgreen 00ff7f, steelblue 4682b4, tan d2b48c, tea 008080, thistle d8bfd8, tomato ff6347, turquoise 40e0d0, violet ee82ee, wheat f5deb3,
white ffffff, whitesmoke f5f5f5, yellow ffff00, yellowgreen 9acd32
"""


def named_colors() -> list[tuple[int, str, int, int, int, int]]:
    """(ord, name, r, g, b, a) of every named colour."""
    rows = []
    for i, item in enumerate(NAMES.replace("\n", "").split(",")):
        name, value = item.split()
        rows.append((i, name, *bytes.fromhex(value), 0 if name == "transparent" else 255))
    return rows


def _gray(bits: int, mirror: bool) -> list[tuple[int, int, int]]:
    """A gray ramp of 2^bits steps; `mirror` repeats the bits downwards so that the last step is 255."""
    steps = []
    for i in range(1 << bits):
        v = i << (8 - bits)
        if mirror:
            shift = 8 - 2 * bits
            while shift > -bits:
                v |= i << shift if shift >= 0 else i >> -shift
                shift -= bits
        steps.append((v & 255,) * 3)
    return steps


def _hex(text: str) -> list[tuple[int, int, int]]:
    return [tuple(bytes.fromhex(x)) for x in text.split()]


# Fixed values of historical palettes.
CGA16 = "000000 0000aa 00aa00 00aaaa aa0000 aa00aa aa5500 aaaaaa 555555 5555ff 55ff55 55ffff ff5555 ff55ff ffff55 ffffff"
COMMODORE16 = "000000 ffffff 880000 aaffee cc44cc 00cc55 0000aa eeee77 dd8855 664400 ff7777 333333 777777 aaff66 0088ff bbbbbb"
WEB16 = "ffffff c0c0c0 808080 000000 ff0000 800000 ffff00 808000 00ff00 008000 00ffff 008080 0000ff 000080 ff00ff 800080"
NES54 = """
6a6d6a 001380 1e008a 39007a 550056 5a0018 4f1000 3d1c00 253200 003d00 004000 003924 002e55 000000
b9bcb9 1850c7 4b30e3 7322d6 951fa9 9d285c 983700 7f4c00 5e6400 227700 027e02 007645 006e8a
ffffff 68a6ff 8c9cff b586ff d975fd e377b9 e58d68 d49d29 b3af0c 7bc211 55ca47 46cb81 47c1c5 4a4d4a
cceaff dddeff ecdaff f8d7fe fcd6f5 fddbcf f9e7b5 f1f0aa dafaa9 c9ffbc c3fbd7 c4f6f6 bec1be
"""


#: The same machine's full table of 64, as it is addressed.
NES64 = """
6a6d6a 001380 1e008a 39007a 550056 5a0018 4f1000 3d1c00 253200 003d00 004000 003924 002e55 000000 000000 000000
b9bcb9 1850c7 4b30e3 7322d6 951fa9 9d285c 983700 7f4c00 5e6400 227700 027e02 007645 006e8a 000000 000000 000000
ffffff 68a6ff 8c9cff b586ff d975fd e377b9 e58d68 d49d29 b3af0c 7bc211 55ca47 46cb81 47c1c5 4a4d4a 000000 000000
ffffff cceaff dddeff ecdaff f8d7fe fcd6f5 fddbcf f9e7b5 f1f0aa dafaa9 c9ffbc c3fbd7 c4f6f6 bec1be 000000 000000
"""


def _ega64() -> list[tuple[int, int, int]]:
    """High bits of blue, green, red count slowest, then their low bits."""
    level = (0x00, 0x55, 0xAA, 0xFF)
    bits = [[i >> s & 1 for s in (5, 4, 3, 2, 1, 0)] for i in range(64)]
    return [(level[2 * R + r], level[2 * G + g], level[2 * B + b]) for B, G, R, b, g, r in bits]


def palettes() -> dict[str, list[tuple[int, int, int]]]:
    """Built-in palettes by name, each a list of (r, g, b)."""
    found = {"grayscale256": _gray(8, False), "grayscale65536": [(i >> 8,) * 3 for i in range(65_536)], "black_and_white": [(0, 0, 0), (255, 255, 255)]}
    for bits in range(2, 8):
        found[f"grayscale{1 << bits}a"], found[f"grayscale{1 << bits}b"] = _gray(bits, True), _gray(bits, False)
    web = (0x00, 0x33, 0x66, 0x99, 0xCC, 0xFF)
    cga = _hex(CGA16)
    found |= {
        "cga16": cga, "cga16_alt": [(170, 170, 0) if c == (170, 85, 0) else c for c in cga], "ega64": _ega64(),
        "commodore64_16": _hex(COMMODORE16), "nes64": _hex(NES64), "nes54": _hex(NES54),
        "web_basic16": _hex(WEB16), "windows16": _hex(WEB16), "web216": [(r, g, b) for b in web for g in web for r in web],
    }
    return found
