"""Looking into blobs: content search and previews as table functions with a registry each, and the small joins around them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import preview
from ..sources import model
from ..sources.binary import table_function
from ..sources.formats import Malformed
from .unique import first_wins

Searcher = Callable[[bytes, str], Iterator[tuple[str, int | None, str]]]
#: Searchers by the file names that they claim, in the order in which they are asked.
SEARCHERS: list[tuple[str, Searcher]] = [(r"(?i)\.pow$", preview.search_power)]


def register(pattern: str, searcher: Searcher) -> None:
    """Add a searcher for names that match; it comes after those that are there."""
    SEARCHERS.append((pattern, searcher))


def content_search(blobs: DataFrame, query: str = "", path: str = "path", blob: str = "blob") -> DataFrame:
    """(path, inner_path, offset, kind, error): matches within every blob whose name some searcher claims.

    Names are filtered before a blob is handed to Python; a blob that can't be read is a row with an error.
    """
    own, out = SEARCHERS.copy(), None
    taken = F.lit(False)
    for pattern, searcher in own:
        claimed = blobs.filter(F.col(path).rlike(pattern) & ~taken).select(path, F.col(blob).alias("_blob"))
        taken = taken | F.col(path).rlike(pattern)

        def rows(data: bytes, searcher: Searcher = searcher) -> Iterator[tuple]:
            yield from searcher(data, query)

        found = table_function(claimed, rows, "inner_path string, offset bigint, kind string", "_blob")
        out = found if out is None else out.unionByName(found)
    return out


def searchable(path: Column) -> Column:
    return F.coalesce(*[F.when(path.rlike(p), F.lit(True)) for p, _ in SEARCHERS], F.lit(False))


def previews(blobs: DataFrame, path: str = "path", blob: str = "blob", forced: str | None = None) -> DataFrame:
    """(path, plugin, made, error) of every blob by the first plug-in that claims it, or by a forced one."""
    both = blobs.select(path, F.concat(F.encode(F.col(path), "UTF-8"), F.lit(bytearray(b"\0")), F.coalesce(F.col(blob), F.lit(bytearray()))).alias("_both"))

    def rows(data: bytes) -> Iterator[tuple]:
        name, _, body = data.partition(b"\0")
        plug, made, error = preview.preview(name.decode("utf-8", "replace"), body, forced)
        yield plug, made, error

    return table_function(both, rows, "plugin string, made string, problem string", "_both").select(path, "plugin", "made", F.coalesce("problem", "error").alias("error"))


def factors(blobs: DataFrame, path: str = "path", blob: str = "blob") -> DataFrame:
    """(path, index, text, error): the scaling factors of every power file, by their names; see preview.scaling_factors."""
    claimed = blobs.filter(F.col(path).rlike(r"(?i)\.pow$")).select(path, F.col(blob).alias("_blob"))
    return table_function(claimed, preview.scaling_factors, "index int, text string", "_blob")


#: What a file's first bytes tell, in the order in which it is asked, and how such a file is summed up.
INSPECTORS: list[tuple[str, tuple[bytes, ...], Callable[[bytes], str]]] = [
    ("model", tuple(model.MAGICS), lambda d: f"{len(model.load(d).sections)} sections, {sum(1 for _ in model.meshes(d))} meshes"),
    ("creature", (b"MD20", b"MD21"), lambda d: "{name}: {vertices} vertices, {bones} bones".format(**preview.creature_model(d))),
    ("world model", (b"REVM",), lambda d: "{groups} groups, {materials} materials".format(**preview.world_model(d))),
    ("blp", (b"BLP2",), lambda d: "{}x{}".format(*preview.blp(d)[1:])),
    ("texture", (preview.DE_MAGIC,), lambda d: "{}x{} {}".format(*preview.texture(d)[1:])),
]


def kind_of(blob: Column) -> Column:
    """The kind of a file by its first bytes, whatever its name: `empty` without any, `unknown` if they tell nothing; null
    for null."""
    found = F.when(blob.isNull(), F.lit(None).cast("string")).when(F.octet_length(blob) == 0, "empty")
    for kind, magics, _ in INSPECTORS:
        for m in magics:
            found = found.when(F.substring(blob, 1, len(m)) == F.lit(bytearray(m)), kind)
    return found.otherwise("unknown")


def inspected(blobs: DataFrame, path: str = "path", blob: str = "blob") -> DataFrame:
    """(path, kind, summary, error) of every blob, be it read from a disk or from an archive; no summary if the kind is
    unknown, and an error for what its kind's reader refuses. Only blobs of a known kind go to Python."""
    known = blobs.select(path, F.col(blob).alias("_blob"), kind_of(F.col(blob)).alias("kind"))
    plain = known.filter("kind is null or kind in ('empty', 'unknown')").select(path, "kind", F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("error"))

    def rows(data: bytes) -> Iterator[tuple]:
        yield (next(made for _, magics, made in INSPECTORS if data.startswith(magics))(data),)

    done = table_function(known.filter("kind not in ('empty', 'unknown')"), rows, "summary string", "_blob")
    return done.select(path, "kind", "summary", "error").unionByName(plain)


def images(blobs: DataFrame, blob: str = "blob") -> DataFrame:
    """(other columns, width, height, png, error) of textures and palette images."""

    def rows(data: bytes) -> Iterator[tuple]:
        if data[:3] == b"BLP":
            pixels, w, h = preview.blp(data)
        elif data[:4] == preview.DE_MAGIC:
            pixels, w, h, _ = preview.texture(data)
        elif data[:1] == b"\x0a":
            pixels, w, h = preview.pcx(data)
        else:
            raise Malformed("no image")
        yield w, h, preview.png(pixels, w, h)

    return table_function(blobs, rows, "width int, height int, png binary", blob)


def siblings(wanted: DataFrame, blobs: DataFrame, key: str = "key", by: str = "file_data_id", content: str = "blob") -> DataFrame:
    """wanted with the blob of each sibling, by id or by lower-cased name; null where there is none."""
    have = first_wins(blobs.select((F.lower(by) if by == "path" else F.col(by)).alias("_by"), F.col(content).alias("sibling")), ["_by"], ["sibling"])
    return wanted.join(have, (F.lower(by) if by == "path" else F.col(by)) == have["_by"], "left").drop("_by")


def batch_materials(units: Column, lookup: Column, n_materials: Column) -> Column:
    """Of texture units (layer, section, combo) those of layer 0, each with its material: what the lookup table holds for
    its combo if that is a material, else its section."""

    def made(u: Column) -> Column:
        texture = F.try_element_at(lookup, u["combo"] + 1)
        return F.struct(u["section"].alias("section"), F.when((texture >= 0) & (texture < n_materials), texture).otherwise(u["section"]).alias("material"))

    return F.transform(F.filter(units, lambda u: u["layer"] == 0), made)


def material_files(stem: str, mesh: str, images: dict[int, bytes], groups: list[tuple[int, int, int]]) -> dict[str, bytes]:
    """An OBJ file of a mesh in groups (material, first face, faces), its MTL file and a PNG per material with an image."""
    lines = mesh.splitlines()
    faces, rest = [x for x in lines if x.startswith("f ")], [x for x in lines if not x.startswith("f ")]
    out, library, files = [f"mtllib {stem}.mtl", *rest], [], {}
    for material, first, n in groups:
        out += [f"usemtl material_{material}", *faces[first : first + n]]
    for material in sorted({g[0] for g in groups}):
        library += [f"newmtl material_{material}", "Kd 1 1 1"]
        if material in images:
            files[f"{stem}_{material}.png"] = images[material]
            library.append(f"map_Kd {stem}_{material}.png")
    return {f"{stem}.obj": ("\n".join(out) + "\n").encode(), f"{stem}.mtl": ("\n".join(library) + "\n").encode()} | files
