"""Export of a random forest to ONNX, written as protocol-buffer fields, since no ONNX library is needed to read it back."""

from __future__ import annotations

import struct
from collections.abc import Iterable

# Field numbers of the ONNX messages that are used here, element types, attribute types, versions.
MODEL = {"ir_version": 1, "producer": 2, "graph": 7, "opset": 8}
OPSET = {"domain": 1, "version": 2}
GRAPH = {"node": 1, "name": 2, "initializer": 5, "input": 11, "output": 12}
NODE = {"input": 1, "output": 2, "name": 3, "op": 4, "attribute": 5, "domain": 7}
ATTRIBUTE = {"name": 1, "f": 2, "i": 3, "s": 4, "floats": 7, "ints": 8, "strings": 9, "type": 20}
KINDS = {"f": 1, "i": 2, "s": 3, "floats": 6, "ints": 7, "strings": 8}
FLOAT, IR_VERSION, OPSETS = 1, 7, (("", 12), ("ai.onnx.ml", 1))


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number: int, value: int | float | str | bytes) -> bytes:
    """A varint, a float, or a length-delimited field."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def attribute(name: str, kind: str, value) -> bytes:
    values = value if kind in ("floats", "ints", "strings") else [value]
    return field(ATTRIBUTE["name"], name) + b"".join(field(ATTRIBUTE[kind], v) for v in values) + field(ATTRIBUTE["type"], KINDS[kind])


def node(op: str, inputs: Iterable[str], outputs: Iterable[str], attributes: Iterable[bytes] = (), domain: str = "") -> bytes:
    out = b"".join(field(NODE["input"], x) for x in inputs) + b"".join(field(NODE["output"], x) for x in outputs)
    return out + field(NODE["name"], op) + field(NODE["op"], op) + b"".join(field(NODE["attribute"], a) for a in attributes) + field(NODE["domain"], domain)


def tensor(name: str, dims: Iterable[int], values: Iterable[float]) -> bytes:
    """An initializer of floats: dims 1, data type 2, name 8, raw data 9."""
    data = b"".join(struct.pack("<f", v) for v in values)
    return b"".join(field(1, d) for d in dims) + field(2, FLOAT) + field(8, name) + field(9, data)


def value_info(name: str, width: int) -> bytes:
    """A float tensor of any number of rows: name 1, type 2, tensor type 1, element type 1, shape 2, dimension 1, value 1 or name 2."""
    shape = field(1, field(2, "rows")) + field(1, field(1, width))
    return field(1, name) + field(2, field(1, field(1, FLOAT) + field(2, shape)))


def model_bytes(nodes: list[bytes], width: int, outputs: int, initializers: list[bytes] = ()) -> bytes:
    """A model with one input ``input`` [rows, width] and one output ``variable`` [rows, outputs]."""
    graph = b"".join(field(GRAPH["node"], n) for n in nodes) + field(GRAPH["name"], "peakforge") + b"".join(field(GRAPH["initializer"], t) for t in initializers)
    graph += field(GRAPH["input"], value_info("input", width)) + field(GRAPH["output"], value_info("variable", outputs))
    sets = b"".join(field(MODEL["opset"], field(OPSET["domain"], d) + field(OPSET["version"], v)) for d, v in OPSETS)
    return field(MODEL["ir_version"], IR_VERSION) + field(MODEL["producer"], "peakforge") + field(MODEL["graph"], graph) + sets


def float_below(x: float) -> float:
    """The largest float32 that is not above ``x``: for float32 values v, v <= x exactly if v <= float_below(x)."""
    f = struct.unpack("<f", struct.pack("<f", x))[0]
    if f <= x:
        return f
    bits = struct.unpack("<i", struct.pack("<f", f))[0]
    return struct.unpack("<f", struct.pack("<i", bits - 1 if bits > 0 else bits + 1 if bits < 0 else -0x7FFFFFFF))[0]


def forest_bytes(model, width: int) -> bytes:
    """An MLlib random forest regression as a TreeEnsembleRegressor: the mean of its trees."""
    cols: dict[str, list] = {k: [] for k in ("tree", "id", "feature", "value", "mode", "true", "false", "t_tree", "t_id", "t_weight")}
    trees = model.trees

    def add(tree: int, jnode, number: int) -> int:
        """Append a node and those below it; returns the next free number."""
        leaf = jnode.subtreeDepth() == 0
        at = len(cols["id"])
        split = None if leaf else jnode.split()
        for k, v in (("tree", tree), ("id", number), ("feature", 0 if leaf else split.featureIndex()), ("value", 0.0 if leaf else float_below(split.threshold())), ("mode", "LEAF" if leaf else "BRANCH_LEQ"), ("true", 0), ("false", 0)):
            cols[k].append(v)
        if leaf:
            for k, v in (("t_tree", tree), ("t_id", number), ("t_weight", jnode.prediction() / len(trees))):
                cols[k].append(v)
            return number + 1
        cols["true"][at] = number + 1
        after = add(tree, jnode.leftChild(), number + 1)
        cols["false"][at] = after
        return add(tree, jnode.rightChild(), after)

    for i, t in enumerate(trees):
        add(i, t._java_obj.rootNode(), 0)
    attributes = [
        attribute("n_targets", "i", 1), attribute("nodes_treeids", "ints", cols["tree"]), attribute("nodes_nodeids", "ints", cols["id"]), attribute("nodes_featureids", "ints", cols["feature"]),
        attribute("nodes_values", "floats", [float(v) for v in cols["value"]]), attribute("nodes_modes", "strings", cols["mode"]), attribute("nodes_truenodeids", "ints", cols["true"]), attribute("nodes_falsenodeids", "ints", cols["false"]),
        attribute("target_treeids", "ints", cols["t_tree"]), attribute("target_nodeids", "ints", cols["t_id"]), attribute("target_ids", "ints", [0] * len(cols["t_id"])), attribute("target_weights", "floats", [float(v) for v in cols["t_weight"]]),
    ]
    return model_bytes([node("TreeEnsembleRegressor", ["input"], ["variable"], attributes, "ai.onnx.ml")], width, 1)


def export_forest(model, path: str, width: int) -> None:
    """Write the forest as .onnx; fails if the file exists."""
    if not path.lower().endswith(".onnx"):
        raise ValueError(f"an ONNX model's file name ends in .onnx: {path}")
    with open(path, "xb") as f:
        f.write(forest_bytes(model, width))
