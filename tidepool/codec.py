"""Bytes of queries, mutations and view changes, in protocol buffers' wire format.

Field numbers are the format's; everything else is a small reader and writer of
tagged fields.  Fields that aren't known are skipped, operations that aren't
known are counted, so that a mutation with one can be refused.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

from .errors import DecodeError, UnsupportedOps
from .operators import view
from .plans import ir

VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5
#: Levels of messages that are read; deeper ones are refused.
MOST_DEPTH = 64

# The comparison numbers of the format.
OPS = {1: "=", 2: "!=", 3: "<", 4: "<=", 5: ">", 6: ">="}


# -- fields


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, kind: int, body: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(body)) + body if kind == BYTES else body)


def _uint(number: int, n: int, always: bool = False) -> bytes:
    return _field(number, VARINT, _varint(n)) if n or always else b""


def _text(number: int, s: str, always: bool = False) -> bytes:
    return _field(number, BYTES, s.encode()) if s or always else b""


def _message(number: int, body: bytes) -> bytes:
    return _field(number, BYTES, body)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise DecodeError("a number is cut off or too long")
        n |= (data[at] & 127) << shift
        at += 1
        if data[at - 1] < 128:
            return n & (1 << 64) - 1, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int, Any]]:
    at = 0
    while at < len(data):
        tag, at = _read_varint(data, at)
        number, kind = tag >> 3, tag & 7
        if not number:
            raise DecodeError("field number 0")
        if kind == VARINT:
            value, at = _read_varint(data, at)
        elif kind == BYTES:
            size, at = _read_varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (FIXED64, FIXED32):
            size = 8 if kind == FIXED64 else 4
            value, at = data[at : at + size], at + size
        else:
            raise DecodeError(f"wire type {kind}")
        if at > len(data):
            raise DecodeError("a field is cut off")
        yield number, kind, value


def _expect(kind: int, want: int) -> None:
    if kind != want:
        raise DecodeError(f"wire type {kind} where {want} belongs")


def _str(value: bytes) -> str:
    try:
        return value.decode()
    except UnicodeDecodeError as e:
        raise DecodeError("text that isn't UTF-8") from e


# -- values; null is the empty message


def encode_value(v: Any) -> bytes:
    if v is None:
        return b""
    if isinstance(v, bool):
        v = int(v)
    if isinstance(v, int):
        return _uint(1, (v << 1 ^ v >> 63) & (1 << 64) - 1, always=True)
    if isinstance(v, float):
        return _field(2, FIXED64, struct.pack("<d", v))
    if isinstance(v, str):
        return _text(3, v, always=True)
    if isinstance(v, (bytes, bytearray)):
        return _field(4, BYTES, bytes(v))
    if isinstance(v, (list, tuple)):
        return _message(5, b"".join(_message(1, encode_row(r)) for r in v))
    raise TypeError(f"no value of the format: {v!r}")


def decode_value(data: bytes, depth: int = 0) -> Any:
    if depth > MOST_DEPTH:
        raise DecodeError("values are nested too deep")
    out = None
    for number, kind, value in _fields(data):
        if number == 1:
            _expect(kind, VARINT)
            out = value >> 1 ^ -(value & 1)
        elif number == 2:
            _expect(kind, FIXED64)
            out = struct.unpack("<d", value)[0]
        elif number == 3:
            _expect(kind, BYTES)
            out = _str(value)
        elif number == 4:
            _expect(kind, BYTES)
            out = bytes(value)
        elif number == 5:
            _expect(kind, BYTES)
            out = [decode_row(v, depth + 1) for n, _, v in _fields(value) if n == 1]
    return out


def encode_row(row: tuple) -> bytes:
    return b"".join(_message(1, encode_value(v)) for v in row)


def decode_row(data: bytes, depth: int = 0) -> tuple:
    return tuple(decode_value(v, depth + 1) for n, k, v in _fields(data) if n == 1 and (_expect(k, BYTES) or True))


# -- queries


def _encode_expr(e: ir.Expr) -> bytes:
    match e:
        case ir.Col(name):
            return _text(1, name, always=True)
        case ir.Lit(value):
            return _message(2, encode_value(value))
        case ir.Param(index):
            return _uint(3, index, always=True)
    raise TypeError(e)


def _decode_expr(data: bytes) -> ir.Expr:
    out = None
    for number, kind, value in _fields(data):
        if number == 1:
            _expect(kind, BYTES)
            out = ir.Col(_str(value))
        elif number == 2:
            _expect(kind, BYTES)
            out = ir.Lit(decode_value(value))
        elif number == 3:
            _expect(kind, VARINT)
            out = ir.Param(value)
    if out is None:
        raise DecodeError("an expression says nothing")
    return out


def _encode_predicate(p: ir.Predicate) -> bytes:
    match p:
        case ir.Always():
            return _message(1, b"")
        case ir.Cmp(left, op, right):
            number = next(n for n, x in OPS.items() if x == op)
            return _message(2, _message(1, _encode_expr(left)) + _uint(2, number) + _message(3, _encode_expr(right)))
        case ir.In(left, values):
            return _message(3, _message(1, _encode_expr(left)) + b"".join(_message(2, encode_value(v)) for v in values))
        case ir.Between(left, low, high):
            return _message(4, b"".join(_message(i, _encode_expr(e)) for i, e in enumerate((left, low, high), 1)))
        case ir.IsNull(e):
            return _message(5, _encode_expr(e))
        case ir.IsNotNull(e):
            return _message(6, _encode_expr(e))
        case ir.Prefix(left, prefix):
            return _message(7, _message(1, _encode_expr(left)) + _text(2, prefix))
        case ir.And(parts):
            return _message(8, b"".join(_message(1, _encode_predicate(x)) for x in parts))
        case ir.Or(parts):
            return _message(9, b"".join(_message(1, _encode_predicate(x)) for x in parts))
        case ir.Not(part):
            return _message(10, _encode_predicate(part))
    raise TypeError(p)


def _one(fields: dict[int, list], number: int) -> Any:
    if number not in fields:
        raise DecodeError(f"field {number} is missing")
    return fields[number][-1]


def _grouped(data: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for number, _, value in _fields(data):
        out.setdefault(number, []).append(value)
    return out


def _bytes(value: Any) -> bytes:
    if not isinstance(value, (bytes, bytearray)):
        raise DecodeError("a number where a message belongs")
    return bytes(value)


def _decode_predicate(data: bytes, depth: int = 0) -> ir.Predicate:
    if depth > MOST_DEPTH:
        raise DecodeError("predicates are nested too deep")
    out: ir.Predicate = ir.Always()
    for number, kind, value in _fields(data):
        if not 1 <= number <= 10:
            continue
        _expect(kind, BYTES)
        if number == 1:
            out = ir.Always()
        elif number in (5, 6):
            out = (ir.IsNull if number == 5 else ir.IsNotNull)(_decode_expr(value))
        elif number in (8, 9):
            parts = tuple(_decode_predicate(_bytes(v), depth + 1) for n, _, v in _fields(value) if n == 1)
            out = (ir.And if number == 8 else ir.Or)(parts)
        elif number == 10:
            out = ir.Not(_decode_predicate(value, depth + 1))
        else:
            f = _grouped(value)
            left = _decode_expr(_bytes(_one(f, 1)))
            if number == 2:
                op = _one(f, 2)
                if op not in OPS:
                    raise DecodeError(f"comparison {op}")
                out = ir.Cmp(left, OPS[op], _decode_expr(_bytes(_one(f, 3))))
            elif number == 3:
                out = ir.In(left, tuple(decode_value(_bytes(v)) for v in f.get(2, [])))
            elif number == 4:
                out = ir.Between(left, _decode_expr(_bytes(_one(f, 2))), _decode_expr(_bytes(_one(f, 3))))
            else:
                out = ir.Prefix(left, _str(_bytes(f[2][-1])) if 2 in f else "")
    return out


def encode_query(q: ir.Query) -> bytes:
    if q.select is not None or q.start_after is not None:
        raise TypeError("select and start_after have no place in the format")
    out = _text(1, q.table)
    if q.where != ir.Always():
        out += _message(2, _encode_predicate(q.where))
    out += b"".join(_message(3, _text(1, o.column) + _uint(2, o.desc)) for o in q.order)
    out += _uint(4, q.limit)
    out += b"".join(_message(6, _text(1, r.relation) + _message(2, encode_query(r.query)) + _text(3, r.name or "")) for r in q.related)
    return out + _uint(9, q.allow_unbounded) + b"".join(_message(10, encode_value(v)) for v in q.params)


def decode_query(data: bytes, depth: int = 0) -> ir.Query:
    if depth > MOST_DEPTH:
        raise DecodeError("queries are nested too deep")
    f = _grouped(data)
    where = _decode_predicate(_bytes(f[2][-1])) if 2 in f else ir.Always()
    order = tuple(ir.Order(_str(_bytes(o.get(1, [b""])[-1])), bool(o.get(2, [0])[-1])) for o in (_grouped(_bytes(v)) for v in f.get(3, [])))
    related = []
    for r in (_grouped(_bytes(v)) for v in f.get(6, [])):
        related.append(ir.Related(_str(_bytes(r.get(1, [b""])[-1])), decode_query(_bytes(_one(r, 2)), depth + 1), _str(_bytes(r[3][-1])) or None if 3 in r else None))
    limit = f.get(4, [0])[-1]
    if isinstance(limit, bytes) or limit >= 1 << 32:
        raise DecodeError("a limit out of range")
    params = tuple(decode_value(_bytes(v)) for v in f.get(10, []))
    return ir.Query(_str(_bytes(f.get(1, [b""])[-1])), where, order, limit, tuple(related), bool(f.get(9, [0])[-1]), params)


# -- mutations


def encode_mutation(ops: list[ir.Op], client_id: bytes = b"", mutation_id: int = 0, timestamp_ms: int = 0) -> bytes:
    body = b""
    for op in ops:
        match op:
            case ir.Insert(table, row):
                one = _message(1, _text(1, table) + _message(2, encode_row(row)))
            case ir.Update(table, key, values):
                one = _message(2, _text(1, table) + _message(2, encode_value(key)) + b"".join(_message(3, _text(1, c) + _message(2, encode_value(v))) for c, v in values))
            case ir.Delete(table, key):
                one = _message(3, _text(1, table) + _message(2, encode_value(key)))
        body += _message(1, one)
    head = (_field(2, BYTES, client_id) if client_id else b"") + _uint(3, mutation_id) + _uint(4, timestamp_ms & (1 << 64) - 1)
    return head + _message(5, body)


def decode_mutation(data: bytes) -> tuple[list[ir.Op], bytes, int, int]:
    """Operations, client, number, time; a body with an operation that isn't known is refused whole."""
    f = _grouped(data)
    ops: list[ir.Op] = []
    unknown = 0
    for body in f.get(5, []):
        for op in _grouped(_bytes(body)).get(1, []):
            found = _grouped(_bytes(op))
            known = [n for n in (1, 2, 3) if n in found]
            if not known:
                unknown += 1
                continue
            n = known[-1]
            x = _grouped(_bytes(found[n][-1]))
            table = _str(_bytes(x.get(1, [b""])[-1]))
            if n == 1:
                ops.append(ir.Insert(table, decode_row(_bytes(x.get(2, [b""])[-1]))))
            elif n == 3:
                ops.append(ir.Delete(table, decode_value(_bytes(x.get(2, [b""])[-1]))))
            else:
                pairs = (_grouped(_bytes(v)) for v in x.get(3, []))
                ops.append(ir.Update(table, decode_value(_bytes(x.get(2, [b""])[-1])), tuple((_str(_bytes(p.get(1, [b""])[-1])), decode_value(_bytes(p.get(2, [b""])[-1]))) for p in pairs)))
    if unknown:
        raise UnsupportedOps(unknown)
    time = f.get(4, [0])[-1]
    return ops, _bytes(f.get(2, [b""])[-1]), f.get(3, [0])[-1], time - (1 << 64) if time >= 1 << 63 else time


# -- view changes


def encode_delta(d: view.ViewDelta) -> bytes:
    out = _uint(1, d.subscription) + _uint(2, d.version)
    for c in d.changes:
        match c:
            case view.Added(index, row):
                one = _message(1, _uint(1, index) + _message(2, encode_row(row)))
            case view.Removed(index, key):
                one = _message(2, _uint(1, index) + _message(2, encode_value(key)))
            case view.Changed(index, row, columns):
                one = _message(3, _uint(1, index) + _message(2, encode_row(row)) + (_field(3, BYTES, b"".join(map(_varint, columns))) if columns else b""))
            case view.Moved(start, to):
                one = _message(4, _uint(1, start) + _uint(2, to))
        out += _message(3, one)
    return out


def decode_delta(data: bytes) -> view.ViewDelta:
    f = _grouped(data)
    changes: list[view.Change] = []
    for c in f.get(3, []):
        for n, kind, body in _fields(_bytes(c)):
            if not 1 <= n <= 4:
                continue
            _expect(kind, BYTES)
            x = _grouped(body)
            index = x.get(1, [0])[-1]
            second = _bytes(x.get(2, [b""])[-1]) if n != 4 else b""
            if n == 1:
                changes.append(view.Added(index, decode_row(second)))
            elif n == 2:
                changes.append(view.Removed(index, decode_value(second)))
            elif n == 4:
                changes.append(view.Moved(index, x.get(2, [0])[-1]))
            else:
                columns: list[int] = []
                for part in x.get(3, []):
                    if isinstance(part, int):
                        columns.append(part)
                        continue
                    at = 0
                    while at < len(part):
                        m, at = _read_varint(part, at)
                        columns.append(m)
                changes.append(view.Changed(index, decode_row(second), tuple(columns)))
    return view.ViewDelta(f.get(1, [0])[-1], f.get(2, [0])[-1], tuple(changes))
