import random
import struct

import pytest

from stowage.sources import formats, model


def example(width, order, coded=False):
    w = model.Writer(width, order)
    pack = lambda code, *v: struct.pack(order + code, *v)
    vertex = [("Position", 10, None, 3), ("Normal", 13, None, 3), ("TextureCoordinates0", 21, None, 2)]
    mesh = [("Name", 8, None, 0), ("PrimaryVertexData", 2, [("Vertices", 3, vertex, 0)], 0), ("PrimaryTopology", 2, [("Indices16", 3, [("Int16", 16, None, 0)], 0), ("Groups", 3, [("MaterialIndex", 19, None, 0)], 0)], 0)]
    types = w.type_list([("Tag", 19, None, 0), ("Where", 9, None, 0), ("Textures", 4, [("FromFileName", 8, None, 0)], 0), ("Meshes", 4, mesh, 0), ("Raw", 22, None, 0)])
    vertices = w.put(b"".join(pack("3f3b2e", *p, 127, 0, -127, 0.5, 0.25) for p in ((0, 0, 0), (1, 2, 3), (-1, 0, 5))))
    indices, group = w.put(pack("3H", 0, 1, 2) + b"\0\0"), w.put(pack("i", 4))
    pointer = bytes(width)

    def spot(raw, *targets):
        """raw at a new place, its pointers (offset, target) fixed up."""
        at = w.put(raw)
        w.fix[0].extend((at + o, *t) for o, t in targets)
        return at

    data = spot(pack("I", 3) + pointer, (4, (0, vertices)))
    topology = spot(pack("I", 3) + pointer + pack("I", 1) + pointer, (4, (0, indices)), (8 + width, (0, group)))
    one = spot(pointer * 3, (0, w.string("tri")), (width, (0, data)), (2 * width, (0, topology)))
    file = spot(pointer, (0, w.string("skin.dds")))
    files, all_meshes = spot(pointer, (0, (0, file))), spot(pointer, (0, (0, one)))
    root = spot(
        pack("i", -7) + pack("I16f", 1, *range(16)) + pack("I", 1) + pointer + pack("I", 1) + pointer + pointer,
        (72 + 4, (0, files)), (72 + 4 + width + 4, (0, all_meshes)),
    )
    return w.file(types, root, coded)


@pytest.mark.parametrize(("width", "order"), [(4, "<"), (8, "<"), (4, ">"), (8, ">")])
def test_elements_and_meshes(width, order):
    rows = list(model.elements(example(width, order)))
    by = {r[0]: r for r in rows}
    assert by["Tag"][5] == -7 and by["Textures/FromFileName"][3] == "skin.dds" and by["Where"][2] == "transform" and by["Raw"][2] == "opaque"
    assert by["Meshes"][5] == 1 and by["Meshes/PrimaryVertexData/Vertices"][5] == 3
    (mesh,) = model.meshes(example(width, order))
    assert mesh.name == "tri" and mesh.positions.tolist() == [[0, 0, 0], [1, 2, 3], [-1, 0, 5]] and mesh.normals[0].tolist() == [1, 0, -1]
    assert mesh.uvs[0].tolist() == [0.5, 0.25] and mesh.indices.tolist() == [0, 1, 2] and mesh.material == 4 and mesh.bounds == ([-1, 0, 0], [1, 2, 5])
    assert "f 1/1 2/2 3/3" in mesh.obj() and "vt 0.500000 0.750000" in mesh.obj()


def test_coded_sections_are_the_same():
    assert list(model.elements(example(4, "<", True))) == list(model.elements(example(4, "<")))


def test_model_tables(spark):
    files = spark.createDataFrame([("m", bytearray(example(8, "<"))), ("bad", bytearray(b"junk" * 40))], "file string, blob binary")
    rows = model.flattened(files).cache()
    assert {r.file for r in rows.filter("error is not null").collect()} == {"bad"}
    assert [tuple(r) for r in model.texture_names(rows).collect()] == [("m", "skin.dds")]
    assert {r.name: r.children for r in model.summary(rows).collect()}["Vertices"] == 3
    mesh = model.mesh_table(files).filter("error is null").first()
    assert (mesh.name, mesh.vertices, mesh.triangles, mesh.high) == ("tri", 3, 1, [1, 2, 5])


def test_hostile_models_are_malformed():
    good, rng = example(4, "<"), random.Random(1)
    for bad in (b"", good[:40], b"x" * 200, good[: len(good) // 2]):
        with pytest.raises(formats.Malformed):
            list(model.elements(bad))
    at = 32 + 40
    with pytest.raises(formats.Malformed, match="compressed"):
        list(model.elements(good[:at] + struct.pack("<I", 2) + good[at + 4 :]))
    for _ in range(400):
        data = bytearray(good)
        for _ in range(rng.randrange(1, 4)):
            data[rng.randrange(32, len(data))] = rng.choice([0, 1, 255, rng.randrange(256)])
        try:
            for _ in zip(model.elements(bytes(data)), range(3000), strict=False):
                pass
        except formats.Malformed:
            pass
