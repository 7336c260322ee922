"""A tiny ONNX model to stand in for a real encoder in tests and benchmarks.

The graph is one ``Gather`` over a float matrix (row = token id), so its
per-token hidden states equal the static vector table and both encoders
must agree. The optional task matrix adds a per-task row, so a v3-style
model (``task_id`` input) gives task-dependent outputs. The ``onnx`` package
is not needed: the protobuf bytes are written directly.
"""

from __future__ import annotations

import numpy as np

# ONNX protobuf enum values (fixed by the ONNX format).
FLOAT, INT64 = 1, 7


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while True:
        b = n & 0x7F
        n >>= 7
        if n:
            out.append(b | 0x80)
        else:
            out.append(b)
            return bytes(out)


def _key(field: int, wire: int) -> bytes:
    return _varint((field << 3) | wire)


def _int(field: int, v: int) -> bytes:
    return _key(field, 0) + _varint(v)


def _bytes(field: int, b: bytes) -> bytes:
    return _key(field, 2) + _varint(len(b)) + b


def _str(field: int, s: str) -> bytes:
    return _bytes(field, s.encode())


def _tensor(name: str, arr: np.ndarray) -> bytes:
    dt = FLOAT if arr.dtype == np.float32 else INT64
    body = b"".join(_int(1, d) for d in arr.shape) + _int(2, dt) + _str(8, name)
    return body + _bytes(9, np.ascontiguousarray(arr).tobytes())


def _value_info(name: str, elem: int, dims: list) -> bytes:
    shape = b"".join(
        _bytes(1, _int(1, d) if isinstance(d, int) else _str(2, d)) for d in dims
    )
    tensor_type = _int(1, elem) + _bytes(2, shape)
    return _str(1, name) + _bytes(2, _bytes(1, tensor_type))


def _node(op: str, inputs: list[str], outputs: list[str], name: str, attrs: bytes = b"") -> bytes:
    return b"".join(_str(1, i) for i in inputs) + b"".join(_str(2, o) for o in outputs) + _str(3, name) + _str(4, op) + attrs


def _attr_int(name: str, v: int) -> bytes:
    # AttributeProto: name=1, i=3, type=20 (INT = 2)
    return _bytes(5, _str(1, name) + _int(3, v) + _int(20, 2))


def gather_model(
    matrix: np.ndarray,
    input_names: tuple[str, ...] = ("input_ids", "attention_mask", "token_type_ids"),
    output_name: str = "last_hidden_state",
    task_matrix: np.ndarray | None = None,
) -> bytes:
    """ONNX bytes: output[b, s, :] = matrix[input_ids[b, s]] (+ task_matrix[task_id])."""
    w = np.asarray(matrix, dtype=np.float32)
    dim = w.shape[1]
    nodes = []
    inits = [_tensor("W", w)]
    if task_matrix is None:
        nodes.append(_node("Gather", ["W", "input_ids"], [output_name], "lookup", _attr_int("axis", 0)))
    else:
        inits.append(_tensor("T", np.asarray(task_matrix, dtype=np.float32)))
        nodes.append(_node("Gather", ["W", "input_ids"], ["tok"], "lookup", _attr_int("axis", 0)))
        nodes.append(_node("Gather", ["T", "task_id"], ["task_row"], "task_lookup", _attr_int("axis", 0)))
        nodes.append(_node("Add", ["tok", "task_row"], [output_name], "shift"))
    inputs = []
    for n in input_names:
        dims = [1] if n == "task_id" else ["batch", "seq"]
        inputs.append(_value_info(n, INT64, dims))
    graph = b"".join(_bytes(1, n) for n in nodes) + _str(2, "gather_encoder")
    graph += b"".join(_bytes(5, t) for t in inits)
    graph += b"".join(_bytes(11, i) for i in inputs)
    graph += _bytes(12, _value_info(output_name, FLOAT, ["batch", "seq", dim]))
    opset = _str(1, "") + _int(2, 13)
    return _int(1, 8) + _str(2, "lumenvec") + _bytes(7, graph) + _bytes(8, opset)


def static_matrix(n_ids: int, dim: int) -> np.ndarray:
    """The fixture vectors of ``functions.vectors.static_vector`` as a matrix."""
    i = np.arange(n_ids, dtype=np.int64)[:, None]
    d = np.arange(dim, dtype=np.int64)[None, :]
    return ((((i * 31 + d * 17) % 129) - 64) / 64.0).astype(np.float32)

