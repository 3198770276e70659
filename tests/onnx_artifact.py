"""Write a tiny ONNX model (matmul, add, sigmoid) without the onnx package.

``python tests/onnx_artifact.py FILE`` rebuilds the artifact of the catalog.
"""

import struct
import sys
from pathlib import Path


def varint(number):
    out = b""
    while number > 127:
        out += bytes([number & 127 | 128])
        number >>= 7
    return out + bytes([number])


def integer(field, number):
    return varint(field << 3) + varint(number)


def block(field, content):
    content = content.encode() if isinstance(content, str) else content
    return varint(field << 3 | 2) + varint(len(content)) + content


def tensor(name, dims, values):
    raw = struct.pack(f"<{len(values)}f", *values)
    return b"".join(integer(1, d) for d in dims) + integer(2, 1) + block(8, name) + block(9, raw)


def node(kind, inputs, output):
    return b"".join(block(1, i) for i in inputs) + block(2, output) + block(4, kind)


def value(name, width):
    shape = block(1, block(2, "n")) + block(1, integer(1, width))
    return block(1, name) + block(2, block(1, integer(1, 1) + block(2, shape)))


def linear_model(weights, intercept):
    graph = (
        block(1, node("MatMul", ["features", "weights"], "linear"))
        + block(1, node("Add", ["linear", "intercept"], "margin"))
        + block(1, node("Sigmoid", ["margin"], "probabilities"))
        + block(2, "linear_score")
        + block(5, tensor("weights", [len(weights), 1], weights))
        + block(5, tensor("intercept", [1], [intercept]))
        + block(11, value("features", len(weights)))
        + block(12, value("probabilities", 1))
    )
    return integer(1, 8) + block(8, block(1, "") + integer(2, 17)) + block(7, graph)


if __name__ == "__main__":
    Path(sys.argv[1]).write_bytes(linear_model([0.02, -0.05], -0.5))
