"""Decoders behind previews: text, movie headers, audio headers, palette images, block-compressed images, formulas.

Each takes bytes (and a name) and gives a tuple or None; the registry applies the first that claims a blob.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np

from ..sources.formats import Malformed, need

# What counts as text by its extension; bytes looked at; the share that must be printable; bytes shown.
TEXT_EXTENSIONS = frozenset(
    "txt md rst log readme ini cfg conf config toml yaml yml properties xml json json5 csv tsv html htm svg lua py sh bash zsh fish "
    "bat cmd ps1 js mjs ts tsx jsx po pot strings stringtable stl rs c cc cpp cxx h hpp hxx java cs go kt swift m mm rb pl php scala "
    "dart glsl hlsl fx vert frag shader build info buildinfo manifest product".split()
)
SAMPLE, PRINTABLE, SHOWN = 4096, 0.90, 64 << 10
_PLAIN = np.zeros(256, bool)
_PLAIN[[9, 10, 13, *range(0x20, 0x7F), *range(0x80, 0x100)]] = True


def looks_like_text(data: bytes) -> bool:
    """UTF-8 but for at most three bytes at the sample's end, and mostly printable."""
    sample = data[:SAMPLE]
    if not sample:
        return False
    for cut in range(4):
        try:
            sample[: len(sample) - cut].decode()
            break
        except UnicodeDecodeError:
            continue
    else:
        return False
    return float(_PLAIN[np.frombuffer(sample, np.uint8)].mean()) >= PRINTABLE


def text(data: bytes, name: str | None = None) -> str | None:
    """Text by extension or by its bytes: no byte order mark, line feeds only, a note where it was cut; else None."""
    extension = name.rpartition(".")[2].lower() if name else ""
    if not data or extension not in TEXT_EXTENSIONS and not looks_like_text(data):
        return None
    out = data[:SHOWN].decode("utf-8", "replace").removeprefix("﻿").replace("\r\n", "\n").rstrip("\0")
    return out + (f"\n\n… (truncated — {SHOWN} of {len(data)} bytes shown)" if len(data) > SHOWN else "")


#: The movie's and the child stub's magic, and their sizes.
MOVIE, MOVIE_HEADER, STUB_BYTES = b"MOVI", 128, 52


def movie(data: bytes) -> dict | None:
    """The fields of a movie's header."""
    if len(data) < MOVIE_HEADER or data[:4] not in (MOVIE, MOVIE[::-1]):
        return None
    names = ("version", "unknown1", "flags", "width", "height", "depth", "master_audio_guid", "extra_audio_guid")
    return dict(zip(names, struct.unpack_from("<IHHIIIQQ", data, 4), strict=True)) | {"file_size": len(data), "payload": len(data) - MOVIE_HEADER}


def movie_payload(data: bytes) -> bytes:
    return data[MOVIE_HEADER:]


# Audio.

_CODECS = {1: "PCM", 3: "IEEE float", 6: "A-law", 7: "µ-law", 17: "IMA ADPCM", 85: "MP3"}
#: Fixed values of the published frame header: layer-III rates in kbit/s, and sample rates by version.
_RATES = {True: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), False: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
_SAMPLE_RATES = (44100, 48000, 32000)


def wav(data: bytes) -> dict | None:
    if len(data) < 44 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, found, size = 12, None, None
    while at + 8 <= len(data):
        kind, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + n]
        if len(body) < n:
            break
        if kind == b"fmt " and n >= 16:
            found = struct.unpack_from("<HHIIHH", body)
        elif kind == b"data":
            size = n
        at += 8 + n + n % 2
    if not found:
        return None
    tag, channels, rate, per_second, _, depth = found
    return {"codec": f"WAV / {_CODECS[tag]}" if tag in _CODECS else f"WAV (unknown codec 0x{tag:04X})", "rate": rate, "channels": channels, "bits": depth, "kbps": None, "seconds": size / per_second if size is not None and per_second else None}


def mp3(data: bytes) -> dict | None:
    start = 0
    if data[:3] == b"ID3" and len(data) >= 10:
        start = 10 + sum((b & 0x7F) << 7 * (3 - k) for k, b in enumerate(data[6:10]))
    m = re.compile(rb"\xff[\xe0-\xff]", re.S).search(data, start)
    if not m or m.start() + 4 > len(data):
        return None
    a, b, c = data[m.start() + 1 : m.start() + 4]
    version = {0: "2.5", 2: "2", 3: "1"}.get(a >> 3 & 3)
    layer = {1: "III", 2: "II", 3: "I"}.get(a >> 1 & 3)
    rate, sample = b >> 4, b >> 2 & 3
    if version is None or layer is None or rate == 15 or sample == 3:
        return None
    return {"codec": f"MP3 (MPEG {version} Layer {layer})", "rate": _SAMPLE_RATES[sample] // {"1": 1, "2": 2, "2.5": 4}[version], "channels": 1 if c >> 6 == 3 else 2, "bits": None, "kbps": _RATES[version == "1"][rate], "seconds": None}


def ogg(data: bytes) -> dict | None:
    if len(data) < 58 or data[:4] != b"OggS":
        return None
    packet = data[27 + data[26] :]
    if len(packet) < 30:
        return None
    if packet[:7] != b"\x01vorbis":
        return {"codec": "OGG (non-Vorbis)", "rate": None, "channels": None, "bits": None, "kbps": None, "seconds": None}
    rate, _, nominal = struct.unpack_from("<Iii", packet, 12)
    return {"codec": "OGG Vorbis", "rate": rate, "channels": packet[11], "bits": None, "kbps": nominal // 1000 if nominal > 0 else None, "seconds": None}


def audio(data: bytes, name: str | None = None) -> dict | None:
    return wav(data) or ogg(data) or (mp3(data) if not name or name.lower().endswith(".mp3") or data[:3] == b"ID3" else None)


# Images: (RGBA bytes, width, height).

#: Most bytes that an image may take, and the longest side of a PCX one.
IMAGE_BYTES, PCX_SIDE = 256 << 20, 8192
Image = tuple[bytes, int, int]


def rgba(indices: np.ndarray, palette: np.ndarray, alpha: np.ndarray | None = None) -> bytes:
    out = np.empty((len(indices), 4), np.uint8)
    out[:, :3] = palette[indices]
    out[:, 3] = 255 if alpha is None else alpha
    return out.tobytes()


def palette_file(data: bytes) -> bytes | None:
    """768 bytes of a palette in text form, of three or four bytes a colour, or of a longer file's start."""
    if data[:8] == b"JASC-PAL":
        rows = data.decode("ascii", "replace").splitlines()
        try:
            n = min(256, int(rows[2]))
            out = bytes(v for row in rows[3 : 3 + n] for v in [int(x) for x in row.split()[:3]])
        except (IndexError, ValueError):
            return None
        return out.ljust(768, b"\0") if len(out) == 3 * n else None
    if len(data) == 1024:
        return np.frombuffer(data, np.uint8).reshape(256, 4)[:, :3].tobytes()
    return data[:768] if len(data) >= 768 else None


def pcx(data: bytes, palette: bytes | None = None) -> Image:
    """An 8-bit one-plane run-length image with its own palette, the one given, or greys."""
    need(len(data) >= 128 and data[0] == 0x0A, "not a PCX image")
    x0, y0, x1, y1 = struct.unpack_from("<4H", data, 4)
    (line,) = struct.unpack_from("<H", data, 66)
    need(data[2] == 1 and data[3] == 8 and data[65] == 1, "only run-length images of 8 bits and one plane")
    width, height = x1 - x0 + 1, y1 - y0 + 1
    need(0 < width <= PCX_SIDE and 0 < height <= PCX_SIDE and line >= width, "dimensions")
    raw, at = bytearray(), 128
    while len(raw) < line * height:
        need(at < len(data), "the runs end early")
        b = data[at]
        if b >= 0xC0:
            need(at + 1 < len(data), "a run without a value")
            raw += data[at + 1 : at + 2] * (b & 0x3F)
            at += 2
        else:
            raw.append(b)
            at += 1
    own = palette[:768] if palette and len(palette) >= 768 else data[-768:] if len(data) >= 769 and data[-769] == 0x0C else bytes(v for k in range(256) for v in (k, k, k))
    rows = np.frombuffer(bytes(raw[: line * height]), np.uint8).reshape(height, line)[:, :width]
    return rgba(rows.ravel(), np.frombuffer(own, np.uint8).reshape(256, 3)), width, height


def _colours(c: np.ndarray) -> np.ndarray:
    """RGB of 5-6-5 colours."""
    r, g, b = c >> 11 & 31, c >> 5 & 63, c & 31
    return np.stack([r << 3 | r >> 2, g << 2 | g >> 4, b << 3 | b >> 2], -1).astype(np.int32)


def dxt(data: bytes, width: int, height: int, kind: int) -> bytes:
    """RGBA of DXT1, 3 or 5 blocks; blocks that the data doesn't hold whole stay zero."""
    need(width * height * 4 <= IMAGE_BYTES, "too large")
    size, bw, bh = 8 if kind == 1 else 16, -(-width // 4), -(-height // 4)
    have = min(len(data) // size, bw * bh)
    out = np.zeros((bw * bh, 16, 4), np.uint8)
    raw = np.frombuffer(data, np.uint8, have * size).reshape(have, size)
    colour = raw[:, size - 8 :]
    ends = np.ascontiguousarray(colour[:, :4]).view("<u2").astype(np.int32)
    first, second = _colours(ends[:, 0]), _colours(ends[:, 1])
    four = (ends[:, 0] > ends[:, 1])[:, None] if kind == 1 else np.ones((have, 1), bool)
    third = np.where(four, (2 * first + second) // 3, (first + second) // 2)
    fourth = np.where(four, (first + 2 * second) // 3, 0)
    table = np.stack([first, second, third, fourth], 1)
    pick = np.ascontiguousarray(colour[:, 4:]).view("<u4") >> (2 * np.arange(16, dtype=np.uint32)) & 3
    out[:have, :, :3] = np.take_along_axis(table, pick[:, :, None].astype(np.int64), 1)
    alpha = np.full((have, 16), 255, np.int32)
    if kind == 1:
        alpha[(pick == 3) & ~four] = 0
    elif kind == 3:
        nibble = np.stack([raw[:, :8] & 15, raw[:, :8] >> 4], -1).reshape(have, 16)
        alpha = nibble.astype(np.int32) * 17
    else:
        a, b = raw[:, 0].astype(np.int32)[:, None], raw[:, 1].astype(np.int32)[:, None]
        k = np.arange(1, 7)
        wide = ((7 - k) * a + k * b) // 7
        narrow = np.concatenate([((5 - k[:4]) * a + k[:4] * b) // 5, np.zeros_like(a), np.full_like(a, 255)], 1)
        steps = np.concatenate([a, b, np.where(a > b, wide, narrow)], 1)
        packed = raw[:, 2:8].astype(np.uint64) @ (np.uint64(1) << np.arange(0, 48, 8, dtype=np.uint64))
        which = packed[:, None] >> (3 * np.arange(16, dtype=np.uint64)) & np.uint64(7)
        alpha = np.take_along_axis(steps, which.astype(np.int64), 1)
    out[:have, :, 3] = alpha
    grid = out.reshape(bh, bw, 4, 4, 4).transpose(0, 2, 1, 3, 4).reshape(bh * 4, bw * 4, 4)
    return np.ascontiguousarray(grid[:height, :width]).tobytes()


def blp_header(data: bytes) -> dict:
    """The header of a texture of any of the three magics."""
    need(len(data) >= 4 and data[:3] == b"BLP" and data[3:4] in b"012", "not a texture")
    if data[3:4] == b"2":
        need(len(data) >= 20, "header")
        version, kind, alpha, form, _, width, height = struct.unpack_from("<IBBBBii", data, 4)
        need(version == 1, f"version {version}")
        at = 20
    else:
        need(len(data) >= 28, "header")
        kind, alpha, width, height, form, _ = struct.unpack_from("<6i", data, 4)
        kind, alpha, form, at = kind & 0xFF, alpha & 0xFF, form & 0xFF, 28
    need(kind in (0, 1, 2, 3, 4), f"encoding {kind}")
    need(len(data) >= at + 128, "mip table")
    offsets, sizes = struct.unpack_from("<16I", data, at), struct.unpack_from("<16I", data, at + 64)
    mips = next((k for k, o in enumerate(offsets) if not o), 16)
    return {"encoding": kind, "alpha": alpha, "format": form, "width": width & 0xFFFFFFFF, "height": height & 0xFFFFFFFF, "offsets": offsets, "sizes": sizes, "mips": mips, "at": at + 128}


def blp(data: bytes, level: int = 0) -> Image:
    """One mip level, the last for a level beyond it. JPEG textures give their JPEG file's dimensions only if an image
    library is there; without one they are told as unsupported."""
    h = blp_header(data)
    need(h["mips"] > 0, "no mip levels")
    level = min(level, h["mips"] - 1)
    width, height = max(1, h["width"] >> level), max(1, h["height"] >> level)
    need(width * height * 4 <= IMAGE_BYTES, "too large")
    start, size = h["offsets"][level], h["sizes"][level]
    need(start + size <= len(data), "a mip level lies outside")
    body, n = data[start : start + size], width * height
    if h["encoding"] == 1:
        need(len(data) >= h["at"] + 1024, "palette")
        colours = np.frombuffer(data, np.uint8, 1024, h["at"]).reshape(256, 4)[:, 2::-1]
        bits = h["alpha"] if h["alpha"] in (1, 4, 8) else 0
        need(len(body) >= n + -(-n * bits // 8), "pixels are missing")
        rest = np.frombuffer(body, np.uint8)[n:]
        alpha = {
            0: lambda: None,
            1: lambda: np.unpackbits(rest, bitorder="little")[:n] * 255,
            4: lambda: (np.stack([rest & 15, rest >> 4], -1).ravel()[:n] << 4),
            8: lambda: rest[:n],
        }[bits]()
        return rgba(np.frombuffer(body, np.uint8, n), colours, alpha), width, height
    if h["encoding"] == 2:
        return dxt(body, width, height, 1 if h["alpha"] <= 1 else 5 if h["format"] == 7 else 3), width, height
    if h["encoding"] in (3, 4):
        need(len(body) >= 4 * n, "pixels are missing")
        return np.ascontiguousarray(np.frombuffer(body, np.uint8, 4 * n).reshape(n, 4)[:, [2, 1, 0, 3]]).tobytes(), width, height
    need(len(data) >= h["at"] + 4, "JPEG header")
    head = int.from_bytes(data[h["at"] : h["at"] + 4], "little")
    need(head <= 64 << 10 and h["at"] + 4 + head <= len(data), "JPEG header")
    raise Malformed("JPEG pixels aren't decoded here")


def png(pixels: bytes, width: int, height: int) -> bytes:
    """An RGBA image as a PNG file."""
    rows = np.zeros((height, 1 + 4 * width), np.uint8)
    rows[:, 1:] = np.frombuffer(pixels, np.uint8, 4 * width * height).reshape(height, 4 * width)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def plausible(pixels: bytes, width: int, share: float = 0.45, near: int = 48) -> bool:
    """Whether an image looks decoded rather than random: enough neighbours alike, and three distinct samples at least."""
    p = np.frombuffer(pixels, np.uint8).reshape(-1, 4).astype(np.int16)
    if len(p) < 4 or len(np.unique(p[:: max(1, len(p) // 256)], axis=0)) < 3:
        return False
    rows = p[: len(p) // width * width].reshape(-1, width, 4)
    alike = np.abs(np.diff(rows[..., :3], axis=1)).sum(axis=2) < near
    return bool(alike.mean() > share)


def sides(pixels: int, least: int = 64) -> list[tuple[int, int]]:
    """Power-of-two dimensions of so many pixels, at most twice as long as high, squares first."""
    powers = [1 << k for k in range(least.bit_length() - 1, 15)]
    found = [(w, h) for w in powers for h in powers if w * h == pixels and max(w, h) <= 2 * min(w, h)]
    return sorted(found, key=lambda d: (d[0] != d[1], -d[0]))


def normal_z(pixels: bytes) -> bytes:
    """Blue from red and green of a two-channel normal map."""
    p = np.frombuffer(pixels, np.uint8).reshape(-1, 4).copy()
    xy = p[:, :2].astype(np.float32) / 127.5 - 1
    p[:, 2] = np.clip((np.sqrt(np.clip(1 - (xy**2).sum(axis=1), 0, 1)) * 0.5 + 0.5) * 255, 0, 255).astype(np.uint8)
    return p.tobytes()


# Power files: sections of strings.

#: The magic, where the id and the section table are, sections.
POWER, POWER_ID, SECTIONS, N_SECTIONS = 0xDEADBEEF, 0x10, 0x80, 4
#: What makes a string a formula.
INDICATORS = ("SF_", "Table(", "Affix", "Attacks_Per_Second", "Owner.", "Min(", "Max(", "Chance_For_", "AoE_Size", " * ", " / ")
Match = tuple[str, int | None, str]


def c_strings(data: bytes) -> list[str]:
    """The printable ASCII strings between zero bytes."""
    return [s.decode("ascii") for s in data.split(b"\0") if s and all(0x20 <= b <= 0x7E for b in s)]


def power_sections(data: bytes) -> list[tuple[int, bytes]]:
    need(len(data) >= SECTIONS + 8 * N_SECTIONS and int.from_bytes(data[:4], "little") == POWER, "not a power file")
    table = struct.unpack_from(f"<{2 * N_SECTIONS}I", data, SECTIONS)
    return [(o, data[o : o + s] if o and s and o + s <= len(data) else b"") for o, s in zip(table[::2], table[1::2], strict=True)]


def search_power(data: bytes, query: str = "") -> Iterator[Match]:
    """(inner path, offset, kind) of the id, definitions and formulas that hold the query in either case."""
    sections = power_sections(data)
    number, needle = str(int.from_bytes(data[POWER_ID : POWER_ID + 4], "little")), query.lower()
    if needle in number:
        yield f"power/{number}", POWER_ID, "power id"
    for (offset, body), place in zip(sections, ("sf_def", "formula"), strict=False):
        for s in c_strings(body):
            if needle in s.lower():
                kind = "SF definition" if place == "sf_def" else next((k for t, k in (("Table(34,", "damage formula"), ("Table(35,", "cooldown formula")) if t in s), "formula")
                yield f"{place}/{s}", offset, kind


def formulas(data: bytes) -> Iterator[tuple[int, str, list[str]]]:
    """(offset, formula, typed values behind it) of printable runs of four characters and more."""
    for m in re.finditer(rb"[\x20-\x7e]{4,}", data):
        s = m[0].decode("ascii")
        if any(i in s for i in INDICATORS):
            at = (m.end() + 4) // 4 * 4
            yield m.start(), s, typed_values(data, at)


def typed_values(data: bytes, at: int, most: int = 8) -> list[str]:
    """Tagged values from a place on: 6 a float, 5 a reference whose first six indices are reserved; others end them."""
    out = []
    for tag, raw in struct.iter_unpack("<I4s", data[at : at + (min(8 * most, max(0, len(data) - at)) // 8 * 8)]):
        if tag == 6:
            out.append(f"{struct.unpack('<f', raw)[0]:.6f}")
        elif tag == 5:
            index = int.from_bytes(raw, "little")
            out.append(f"SF_{index - 6 if index >= 6 else index} (idx={index})")
        else:
            break
    return out


#: Fixed values of the block of scaling factors: where the record starts and its length stands, where in the record the
#: first formula's place stands, the tags that end an entry, bytes behind its text, entries and failures at most.
RECORD, RECORD_SIZE, FIRST_FORMULA, ENTRY_TAGS, ENTRY_TAIL, MOST_FACTORS, MOST_BAD = 0x10, 0x78, 0x258, (0, 5, 6), 12, 80, 3


def scaling_factors(data: bytes) -> Iterator[tuple[int, str]]:
    """(index, text) of the run of entries that the first formula begins: a printable text that a zero byte ends, filled
    up to four bytes, a tag and its values. What isn't one takes an index and 16 bytes; three of those in a row end the run.
    """
    if len(data) < RECORD + FIRST_FORMULA + 8:
        return
    (size,), (at,) = (struct.unpack_from("<I", data, o) for o in (RECORD_SIZE, RECORD + FIRST_FORMULA))
    if not 0 < size <= len(data) or at < RECORD + size:
        return
    entry, bad = re.compile(rb"([\x20-\x7e]*)\0"), 0
    for index in range(MOST_FACTORS):
        if bad == MOST_BAD or at + 16 > len(data):
            return
        found = entry.match(data, at)
        tag = (found.end() + 3) // 4 * 4 if found else 0
        if found and tag + ENTRY_TAIL > len(data):
            return
        if found and int.from_bytes(data[tag : tag + 4], "little") in ENTRY_TAGS:
            yield index, found[1].decode("ascii")
            at, bad = tag + ENTRY_TAIL, 0
        else:
            at, bad = at + 16, bad + 1


def chunks(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(name, offset, size) of reversed four-letter chunks, as terrain and world models have them."""
    at = 0
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        need(at + 8 + size <= len(data), f"the chunk at {at} runs over")
        yield data[at : at + 4][::-1].decode("latin-1"), at + 8, size
        at += 8 + size


def obj(positions: np.ndarray, uvs: np.ndarray | None, triangles: np.ndarray, flip: bool = True) -> str:
    """A mesh as an OBJ file: indices from 1, v of the texture turned over unless told otherwise."""
    rows = [f"v {x:.6f} {y:.6f} {z:.6f}" for x, y, z in positions.tolist()]
    if uvs is not None and len(uvs):
        rows += [f"vt {u:.6f} {(1 - v if flip else v):.6f}" for u, v in uvs.tolist()]
    face = (lambda k: f"{k + 1}/{k + 1}") if uvs is not None and len(uvs) else (lambda k: str(k + 1))
    rows += ["f " + " ".join(map(face, t)) for t in triangles.tolist()]
    return "\n".join(rows) + "\n"


def half(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<f2").astype(np.float32)


def normalised(data: bytes, kind: str) -> np.ndarray:
    """Integers as fractions: i1/127, u1/255, i2/32767, u2/65535."""
    return np.frombuffer(data, f"<{kind}").astype(np.float32) / {"i1": 127, "u1": 255, "i2": 32767, "u2": 65535}[kind]


def _steps(raw: np.ndarray) -> np.ndarray:
    """The 16 values of each block of 8 bytes: two ends, steps between, three bits per pixel."""
    a, b = raw[:, 0].astype(np.int32)[:, None], raw[:, 1].astype(np.int32)[:, None]
    k = np.arange(1, 7)
    wide = ((7 - k) * a + k * b) // 7
    narrow = np.concatenate([((5 - k[:4]) * a + k[:4] * b) // 5, np.zeros_like(a), np.full_like(a, 255)], 1)
    table = np.concatenate([a, b, np.where(a > b, wide, narrow)], 1)
    packed = raw[:, 2:8].astype(np.uint64) @ (np.uint64(1) << np.arange(0, 48, 8, dtype=np.uint64))
    which = packed[:, None] >> (3 * np.arange(16, dtype=np.uint64)) & np.uint64(7)
    return np.take_along_axis(table, which.astype(np.int64), 1)


def channels(data: bytes, width: int, height: int, n: int) -> bytes:
    """RGBA of one-channel blocks (as grey) or two-channel ones (red and green, blue as a normal's z)."""
    need(width * height * 4 <= IMAGE_BYTES, "too large")
    bw, bh, size = -(-width // 4), -(-height // 4), 8 * n
    have = min(len(data) // size, bw * bh)
    raw = np.frombuffer(data, np.uint8, have * size).reshape(have, size)
    out = np.zeros((bw * bh, 16, 4), np.uint8)
    out[:have, :, 3] = 255
    for k in range(n):
        out[:have, :, k] = _steps(raw[:, 8 * k : 8 * k + 8])
    if n == 1:
        out[:have, :, 1:3] = out[:have, :, :1]
    grid = out.reshape(bh, bw, 4, 4, 4).transpose(0, 2, 1, 3, 4).reshape(bh * 4, bw * 4, 4)[:height, :width]
    return np.ascontiguousarray(grid).tobytes() if n == 1 else normal_z(np.ascontiguousarray(grid).tobytes())


#: Block forms with bytes per block; BC7 isn't decoded here.
BLOCKS: dict[str, tuple[int, Callable[[bytes, int, int], bytes] | None]] = {
    "BC1": (8, lambda d, w, h: dxt(d, w, h, 1)),
    "BC3": (16, lambda d, w, h: dxt(d, w, h, 5)),
    "BC4": (8, lambda d, w, h: channels(d, w, h, 1)),
    "BC5": (16, lambda d, w, h: channels(d, w, h, 2)),
    "BC7": (16, None),
}
#: The container's magic, and which form its codes stand for (code, 16 bytes a block): the first is right.
DE_MAGIC, DE_FORMS = b"<DE(", {(0x3E, True): "BC3", (0x3D, True): "BC3", (0x39, False): "BC1", (0x3A, False): "BC4", (0x3F, False): "BC4"}


def texture_header(data: bytes) -> dict | None:
    """Dimensions, mips and the largest mip's place in a container whose mip offsets count from their own field."""
    if len(data) < 0x2C or data[:4] != DE_MAGIC:
        return None
    width, height = struct.unpack_from("<II", data, 8)
    (mips,) = struct.unpack_from("<I", data, 0x1C)
    if not (0 < width <= 16384 and 0 < height <= 16384 and 0 < mips <= 16) or len(data) < 0x24 + 8 * mips:
        return None
    size, offset = struct.unpack_from("<II", data, 0x24)
    start = 0x28 + offset
    if not size or start + size > len(data):
        return None
    blocks = (max(4, width) // 4) * (max(4, height) // 4)
    return {"code": data[4], "width": width, "height": height, "mips": mips, "start": start, "size": size, "block": size // blocks}


def texture(data: bytes) -> tuple[bytes, int, int, str]:
    """RGBA, dimensions and form of a container's largest mip: by its code, or the first form that looks decoded."""
    h = texture_header(data)
    need(h is not None, "not a texture container")
    body, w, t = data[h["start"] : h["start"] + h["size"]], h["width"], h["height"]
    form = DE_FORMS.get((h["code"], h["block"] == 16))
    if form:
        return BLOCKS[form][1](body, w, t), w, t, form
    for form in ("BC3", "BC5") if h["block"] == 16 else ("BC1", "BC4"):
        pixels = BLOCKS[form][1](body, w, t)
        if plausible(pixels, w):
            return pixels, w, t, form
    raise Malformed("no form of blocks looks right; BC7 isn't decoded")


def bare_texture(data: bytes, name: str) -> tuple[bytes, int, int, str] | None:
    """Blocks without a header: forms in an order that the name suggests, power-of-two sides, the first that looks
    decoded; None for 64 zero bytes at the start (encrypted) or if nothing does."""
    low = name.lower()
    if len(data) < 64 or not any(data[:64]):
        return None
    masks = any(k in low for k in ("_rough", "_metallic", "_ao", "_alpha", "_opacity", "_mask"))
    for form in ("BC5", "BC3", "BC1", "BC4") if "_normal" in low else ("BC4", "BC1", "BC5", "BC3") if masks else ("BC3", "BC1", "BC5", "BC4"):
        size, make = BLOCKS[form]
        for w, h in sides(len(data) * 16 // size):
            pixels = make(data, w, h)
            if plausible(pixels, w):
                return pixels, w, h, form
    return None


def world_model(data: bytes) -> dict:
    """Counts and bounds of a world model's root, from its header chunk."""
    found = {name: (at, size) for name, at, size in chunks(data)}
    need("MVER" in found and "MOHD" in found and found["MOHD"][1] >= 60, "no header chunk")
    at = found["MOHD"][0]
    names = ("materials", "groups", "portals", "lights", "doodad_names", "doodads", "doodad_sets")
    out = dict(zip(names, struct.unpack_from("<7I", data, at), strict=True))
    box = struct.unpack_from("<6f", data, at + 36)
    textures = found.get("MOTX", (0, 0))
    return out | {"version": int.from_bytes(data[found["MVER"][0] : found["MVER"][0] + 4], "little"), "textures": len(c_strings(data[textures[0] : sum(textures)])), "low": list(box[:3]), "high": list(box[3:])}


def creature_model(data: bytes) -> dict:
    """Version, name and counts of a creature model's header, in its own chunk or at the file's start."""
    if data[:4] == b"MD21":
        need(len(data) >= 8, "header")
        data = data[8 : 8 + int.from_bytes(data[4:8], "little")]
    need(data[:4] == b"MD20" and len(data) >= 0x60, "not a creature model")
    version, n, at = struct.unpack_from("<III", data, 4)
    need(at + n <= len(data), "name")
    pair = lambda o: struct.unpack_from("<I", data, o)[0]
    return {"version": version, "name": data[at : at + n].split(b"\0")[0].decode("latin-1"), "animations": pair(0x1C), "bones": pair(0x2C), "vertices": pair(0x3C), "views": pair(0x44), "textures": pair(0x50)}


def terrain(data: bytes) -> dict:
    """Chunks, vertices (145 a chunk) and triangles (256) of a terrain tile's root, with the lowest and highest of heights."""
    n, low, high = 0, np.inf, -np.inf
    for name, at, size in chunks(data):
        if name == "MCNK" and size >= 128:
            n += 1
            (base,) = struct.unpack_from("<f", data, at + 112)
            inner = at + 128
            while inner + 8 <= at + size:
                kind, length = data[inner : inner + 4][::-1], int.from_bytes(data[inner + 4 : inner + 8], "little")
                if kind == b"MCVT" and length >= 580 and inner + 588 <= at + size:
                    heights = np.frombuffer(data, "<f4", 145, inner + 8) + base
                    low, high = min(low, float(heights.min())), max(high, float(heights.max()))
                inner += 8 + length
    need(n > 0, "no terrain chunks")
    return {"chunks": n, "vertices": 145 * n, "triangles": 256 * n, "low": None if np.isinf(low) else low, "high": None if np.isinf(high) else high}


TERRAIN_PARTS = ("_tex0.adt", "_tex1.adt", "_obj0.adt", "_obj1.adt", "_lod.adt")
#: Plug-ins in the order in which they are asked: name, whether it claims (name, data), what it makes.
REGISTRY: list[tuple[str, Callable[[str, bytes], bool], Callable[[bytes, str], str | None]]] = [
    ("blp", lambda n, d: d[:3] == b"BLP" and d[3:4] in (b"0", b"1", b"2"), lambda d, n: "{}x{}".format(*blp(d)[1:])),
    ("pcx", lambda n, d: n.lower().endswith(".pcx") and d[:1] == b"\x0a", lambda d, n: "{}x{}".format(*pcx(d)[1:])),
    ("power", lambda n, d: n.lower().endswith(".pow"), lambda d, n: f"{sum(1 for _ in search_power(d))} matches"),
    ("texture", lambda n, d: texture_header(d) is not None, lambda d, n: "{}x{} {}".format(*texture(d)[1:])),
    ("bare texture", lambda n, d: n.lower().endswith(".tex"), lambda d, n: "{}x{} {}".format(*t[1:]) if (t := bare_texture(d, n)) else None),
    ("creature", lambda n, d: n.lower().endswith(".m2") and d[:4] in (b"MD20", b"MD21"), lambda d, n: "{name}: {vertices} vertices, {bones} bones".format(**creature_model(d))),
    ("world model", lambda n, d: n.lower().endswith(".wmo") and d[:4] == b"REVM", lambda d, n: "{groups} groups, {materials} materials".format(**world_model(d))),
    ("terrain", lambda n, d: n.lower().endswith(".adt") and not n.lower().endswith(TERRAIN_PARTS), lambda d, n: "{chunks} chunks, {triangles} triangles".format(**terrain(d))),
    ("movie", lambda n, d: movie(d) is not None, lambda d, n: "{width}x{height}".format(**movie(d))),
    ("chunked", lambda n, d: d[:4] == b"REVM", lambda d, n: " ".join(c[0] for c in chunks(d))),
    ("audio", lambda n, d: d[:4] in (b"RIFF", b"OggS") or d[:3] == b"ID3" or n.lower().endswith(".mp3"), lambda d, n: (audio(d, n) or {}).get("codec")),
    ("text", lambda n, d: text(d, n) is not None, text),
]


def preview(name: str, data: bytes, forced: str | None = None) -> tuple[str | None, str | None, str | None]:
    """(plug-in, what it made, error) of the first plug-in that claims a blob, or of a forced one."""
    for plug, claims, make in REGISTRY:
        if plug == forced if forced else claims(name, data):
            try:
                return plug, make(data, name), None
            except (Malformed, struct.error, ValueError) as e:
                return plug, None, str(e)
    return None, None, None


def plugin_names() -> list[str]:
    return [p[0] for p in REGISTRY]
