"""Self-describing model files: sections, pointers between them, and a tree of typed elements, flattened to rows.

A file describes its own types; the walk here is a table of scalar kinds and a handful of shapes (one child, a counted run
of children, a counted run of pointers), each of which says where the children's data and types are. Sections are
plain or coded by functions.bitknit; older kinds of compression are told as unsupported.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bitknit
from ..functions.preview import obj
from .binary import table_function
from .formats import Malformed, need

#: The magics with byte order and pointer width.
MAGICS = {
    bytes.fromhex("B867B0CAF86DB10F84728C7E5E19001E"): ("<", 4),
    bytes.fromhex("CAB067B60FB1DBF87E8C72841E00195E"): (">", 4),
    bytes.fromhex("29DE6CC0BAA4532B25F5B7A5F666E2EE"): ("<", 4),
    bytes.fromhex("E59B495E6F631F141E13EBA990BEEDC4"): ("<", 8),
    bytes.fromhex("B595110E4BB5A56A502828EB04B37825"): (">", 4),
    bytes.fromhex("E3D49531624FDC203AD036CC89FF82B1"): (">", 8),
}
#: Scalar type ids with their struct code and, for fractions, what they are divided by.
SCALARS = {10: ("f", 0), 11: ("b", 0), 12: ("B", 0), 13: ("b", 127), 14: ("B", 255), 15: ("h", 0), 16: ("H", 0), 17: ("h", 32767), 18: ("H", 65535), 19: ("i", 0), 20: ("I", 0), 21: ("e", 0)}
#: Type ids that are pointers whose target isn't followed, with the number of pointers; the transform; text.
OPAQUE, TRANSFORM, TEXT, LAST_TYPE = {1: 1, 5: 2, 6: 1, 22: 1}, 9, 8, 22
DEEPEST, MOST_ELEMENTS = 64, 5_000_000
#: Fixed value: the kind of compression that is read.
BITKNIT = 4

Row = tuple[str, list[int], str, str | None, float | None, int | None]
COLUMNS = "path string, ord array<int>, kind string, str_v string, f32_v float, i32_v bigint"


@dataclass
class Section:
    data: bytes
    pointers: dict[int, tuple[int, int]] = field(default_factory=dict)


@dataclass
class Model:
    order: str
    width: int
    sections: list[Section]
    types: tuple[int, int]
    root: tuple[int, int]
    plain_bytes: int

    def at(self, section: int, offset: int, size: int) -> bytes:
        need(0 <= section < len(self.sections), f"section {section}")
        data = self.sections[section].data
        need(0 <= offset and offset + size <= len(data), "an element lies outside")
        return data[offset : offset + size]

    def number(self, code: str, section: int, offset: int):
        return struct.unpack(self.order + code, self.at(section, offset, struct.calcsize(code)))[0]

    def pointer(self, section: int, offset: int) -> tuple[int, int] | None:
        need(0 <= section < len(self.sections), f"section {section}")
        return self.sections[section].pointers.get(offset)

    def text(self, place: tuple[int, int] | None) -> str:
        if place is None:
            return ""
        self.at(*place, 1)
        return self.sections[place[0]].data[place[1] :].split(b"\0", 1)[0].decode("utf-8", "replace")


def load(data: bytes) -> Model:
    need(len(data) >= 72 and data[:16] in MAGICS, "not a model")
    order, width = MAGICS[data[:16]]
    _, _, _, info, count, ts, tp, rs, rp, _ = struct.unpack_from(f"{order}i9I", data, 32)
    need(info >= 40 and 32 + info + 44 * count <= len(data), "section table")
    sections, plain = [], 0
    for k in range(count):
        packed, start, stored, size, _, _, _, fix, fixes, _, _ = struct.unpack_from(f"{order}11I", data, 32 + info + 44 * k)
        need(start + stored <= len(data), f"section {k}")
        if stored and packed not in (0, BITKNIT):
            raise Malformed(f"section {k} is compressed (kind {packed})")
        body = data[start : start + stored]
        table = data[fix : fix + 12 * fixes]
        if packed == BITKNIT:
            body = bitknit.decode(body, size) if stored else b""
            if fixes:  # the pointers are coded too, behind their coded size
                need(fix + 4 <= len(data), f"pointers of section {k}")
                (coded,) = struct.unpack_from(f"{order}I", data, fix)
                table = bitknit.decode(data[fix + 4 : fix + 4 + coded], 12 * fixes)
        need(len(table) == 12 * fixes, f"pointers of section {k}")
        sections.append(Section(body, {a: (b, c) for a, b, c in struct.iter_unpack(f"{order}3I", table)}))
        plain += size
    return Model(order, width, sections, (ts, tp), (rs, rp), plain)


class Walk:
    """Rows of the tree, depth first; a child's rows follow their parent's."""

    def __init__(self, model: Model):
        self.m, self.seen = model, 0

    def fields(self, types: tuple[int, int]) -> Iterator[tuple[int, str, tuple[int, int] | None, int]]:
        """(type id, name, where the children's types are, array size) of a type list."""
        m, (section, at) = self.m, types
        stride = 4 + 2 * m.width + 4 + 3 * 4 + m.width
        while True:
            kind = m.number("I", section, at)
            if not 0 < kind <= LAST_TYPE:
                return
            self.at_most()
            yield kind, m.text(m.pointer(section, at + 4)), m.pointer(section, at + 4 + m.width), m.number("i", section, at + 4 + 2 * m.width)
            at += stride

    def at_most(self) -> None:
        self.seen += 1
        need(self.seen <= MOST_ELEMENTS, "too many elements")

    def tree(self, data: tuple[int, int], types: tuple[int, int], path: str, place: list[int], depth: int) -> Iterator[Row]:
        """Rows of one structure; returns where its data ends."""
        need(depth <= DEEPEST, "elements are nested too deeply")
        section, at = data
        for k, (kind, name, inner, times) in enumerate(self.fields(types)):
            for n in range(max(times, 1)):
                here = [*place, k, n] if times > 0 else [*place, k]
                at = yield from self.value(kind, section, at, inner, f"{path}/{name}" if path else name, here, depth)
        return at

    def value(self, kind: int, section: int, at: int, inner: tuple[int, int] | None, path: str, place: list[int], depth: int) -> Iterator[Row]:
        m, w = self.m, self.m.width
        self.at_most()
        if kind in SCALARS:
            code, per = SCALARS[kind]
            v = m.number(code, section, at)
            whole = code not in "fe" and not per
            yield path, place, "i32" if whole else "f32", None, None if whole else float(v) / (per or 1), v if whole else None
            return at + struct.calcsize(code)
        if kind == TEXT:
            yield path, place, "string", m.text(m.pointer(section, at)), None, None
            m.at(section, at, w)
            return at + w
        if kind == TRANSFORM:
            numbers = struct.unpack(f"{m.order}I16f", m.at(section, at, 68))
            yield path, place, "transform", " ".join(f"{v:g}" for v in numbers[1:]), None, numbers[0]
            return at + 68
        if kind in OPAQUE:
            m.at(section, at, OPAQUE[kind] * w)
            yield path, place, "opaque", None, None, kind
            return at + OPAQUE[kind] * w
        # what is left has children: where their types, data and number are
        if kind == 2:
            count, target, types, size = 1, m.pointer(section, at), inner, w
        elif kind in (3, 4):
            count, target, types, size = m.number("I", section, at), m.pointer(section, at + 4), inner, 4 + w
        else:
            count, target, types, size = m.number("I", section, at + w), m.pointer(section, at + w + 4), m.pointer(section, at), 4 + 2 * w
        m.at(section, at, size)
        known = target is not None and types is not None
        yield path, place, "reference" if kind == 2 else "array", None, None, count if known else 0
        spot = target
        for n in range(count if known else 0):
            if kind == 4:  # each child by a pointer of its own
                spot = m.pointer(target[0], target[1] + n * w)
                if spot is None:
                    continue
            end = yield from self.tree(spot, types, path, [*place, n], depth + 1)
            spot = (spot[0], end)
        return at + size


def elements(data: bytes) -> Iterator[Row]:
    """(path, ord, kind, str_v, f32_v, i32_v) of every element; ord tells siblings and array places apart and orders rows."""
    model = load(data)
    walk = Walk(model).tree(model.root, model.types, "", [], 0)
    yield from walk


def flattened(files: DataFrame, strict: bool = False) -> DataFrame:
    """The elements of model blobs (file, blob)."""
    return table_function(files, elements, COLUMNS, strict=strict)


def summary(rows: DataFrame) -> DataFrame:
    """(name, elements, children) over flattened rows: how often a name occurs, and how many children its arrays hold."""
    return rows.filter("error is null").groupBy(F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.count("*").alias("elements"), F.sum(F.when(F.col("kind") == "array", F.col("i32_v"))).alias("children"))


def texture_names(rows: DataFrame) -> DataFrame:
    """(file, texture) of the models' texture files."""
    return rows.filter(F.col("path") == "Textures/FromFileName").select("file", F.col("str_v").alias("texture")).distinct()


@dataclass
class Mesh:
    name: str
    positions: np.ndarray
    normals: np.ndarray
    uvs: np.ndarray
    indices: np.ndarray
    material: int | None

    @property
    def bounds(self) -> tuple[list[float], list[float]]:
        return self.positions.min(axis=0).tolist(), self.positions.max(axis=0).tolist()

    def obj(self, flip: bool = True) -> str:
        return obj(self.positions, self.uvs, self.indices.reshape(-1, 3), flip)


def meshes(data: bytes) -> Iterator[Mesh]:
    """The meshes of a model that have vertices and indices."""
    by: dict[int, dict] = {}
    for path, place, _, s, f, i in elements(data):
        parts = path.split("/")
        if parts[0] != "Meshes" or len(place) < 3:
            continue
        own = by.setdefault(place[1], {"name": "mesh", "vertices": {}, "short": [], "long": [], "material": None})
        tail = parts[1:]
        if tail == ["Name"]:
            own["name"] = s or "mesh"
        elif tail[:2] == ["PrimaryVertexData", "Vertices"] and len(tail) == 3 and f is not None:
            own["vertices"].setdefault(tuple(place[:-2]), {}).setdefault(tail[2], []).append(f)
        elif tail[:2] == ["PrimaryTopology", "Indices16"] and i is not None and len(tail) == 3:
            own["short"].append(i)
        elif tail[:2] == ["PrimaryTopology", "Indices"] and i is not None and len(tail) == 3:
            own["long"].append(i)
        elif tail == ["PrimaryTopology", "Groups", "MaterialIndex"] and own["material"] is None:
            own["material"] = i
    for _, own in sorted(by.items()):
        indices = own["short"] or own["long"]
        if not own["vertices"] or not indices:
            continue
        rows = [v for _, v in sorted(own["vertices"].items())]
        pick = lambda name, n, default, rows=rows: np.array([(r.get(name, default) + default)[:n] for r in rows], np.float32)
        yield Mesh(own["name"], pick("Position", 3, [0.0] * 3), pick("Normal", 3, [0.0, 0.0, 1.0]), pick("TextureCoordinates0", 2, [0.0] * 2), np.array(indices[: len(indices) // 3 * 3], np.int64), own["material"])


def mesh_rows(data: bytes) -> Iterator[tuple]:
    for m in meshes(data):
        low, high = m.bounds
        yield m.name, len(m.positions), len(m.indices) // 3, low, high, m.material, m.obj()


def mesh_table(files: DataFrame, strict: bool = False) -> DataFrame:
    """(file, name, vertices, triangles, low, high, material, obj, error) of every mesh of model blobs."""
    return table_function(files, mesh_rows, "name string, vertices int, triangles int, low array<float>, high array<float>, material bigint, obj string", strict=strict)


class Writer:
    """One section of data and one of types, for tests: build() takes (name, type id, value) trees."""

    def __init__(self, width: int = 4, order: str = "<"):
        self.w, self.o = width, order
        self.data, self.types = bytearray(), bytearray()
        self.fix: list[list[tuple[int, int, int]]] = [[], []]

    def string(self, text: str) -> tuple[int, int]:
        at = len(self.types)
        self.types += text.encode() + b"\0" + b"\0" * (-(len(text.encode()) + 1) % 4)
        return 1, at

    def type_list(self, fields: list[tuple]) -> tuple[int, int]:
        """fields: (name, type id, child fields or None, array size)."""
        made = [(self.string(n), kind, self.type_list(c) if c else None, size) for n, kind, c, size in fields]
        at = len(self.types)
        for name, kind, child, size in made:
            base = len(self.types)
            self.types += struct.pack(f"{self.o}I", kind) + bytes(2 * self.w) + struct.pack(f"{self.o}i", size) + bytes(12 + self.w)
            self.fix[1].append((base + 4, *name))
            if child:
                self.fix[1].append((base + 4 + self.w, *child))
        self.types += bytes(4 + 3 * self.w + 16)
        return 1, at

    def put(self, raw: bytes) -> int:
        self.data += raw
        return len(self.data) - len(raw)

    def file(self, types: tuple[int, int], root: int, coded: bool = False) -> bytes:
        magic = next(m for m, v in MAGICS.items() if v == (self.o, self.w))
        parts, at = [bytes(self.data), bytes(self.types)], 32 + 40 + 88
        table, body = b"", b""
        for part, fixes in zip(parts, self.fix, strict=True):
            rows = b"".join(struct.pack(f"{self.o}3I", *f) for f in fixes)
            size = len(part)
            if coded:
                part, rows = bitknit.encode(part), bitknit.encode(rows)
                rows = struct.pack(f"{self.o}I", len(rows)) + rows
            table += struct.pack(f"{self.o}11I", BITKNIT * coded, at + len(body), len(part), size, 4, 0, 0, at + len(body) + len(part), len(fixes), 0, 0)
            body += part + rows
        head = struct.pack(f"{self.o}IIII", 0, 0, 0, 0)
        info = struct.pack(f"{self.o}i9I", 7, 0, 0, 40, 2, *types, 0, root, 0)
        return magic + head + info + table + body
