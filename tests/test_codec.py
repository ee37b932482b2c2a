"""Round trips of all messages, and refusal of anything else."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidepool import codec
from tidepool.errors import DecodeError, UnsupportedOps
from tidepool.operators import view
from tidepool.plans import ir

scalars = st.none() | st.integers(-(2**63), 2**63 - 1) | st.floats(allow_nan=False) | st.text(max_size=5) | st.binary(max_size=5)
rows = st.lists(scalars, max_size=4).map(tuple)
names = st.text(min_size=1, max_size=5)
exprs = names.map(ir.Col) | scalars.map(ir.Lit) | st.integers(0, 9).map(ir.Param)
leaves = (
    st.just(ir.Always())
    | st.builds(ir.Cmp, exprs, st.sampled_from(["=", "!=", "<", "<=", ">", ">="]), exprs)
    | st.builds(ir.In, exprs, st.lists(scalars, max_size=3).map(tuple))
    | st.builds(ir.Between, exprs, exprs, exprs)
    | exprs.map(ir.IsNull)
    | exprs.map(ir.IsNotNull)
    | st.builds(ir.Prefix, exprs, st.text(max_size=4))
)
predicates = st.recursive(leaves, lambda p: st.lists(p, max_size=2).map(tuple).map(ir.And) | st.lists(p, max_size=2).map(tuple).map(ir.Or) | p.map(ir.Not), max_leaves=6)
orders = st.lists(st.builds(ir.Order, names, st.booleans()), max_size=3).map(tuple)
plain = st.builds(ir.Query, table=names, where=predicates, order=orders, limit=st.integers(0, 2**32 - 1), allow_unbounded=st.booleans(), params=st.lists(scalars, max_size=3).map(tuple))
queries = st.builds(lambda q, subs: ir.Query(q.table, q.where, q.order, q.limit, tuple(subs), q.allow_unbounded, q.params), plain, st.lists(st.builds(ir.Related, names, plain, st.none() | names), max_size=2))
ops = st.builds(ir.Insert, names, rows) | st.builds(ir.Update, names, scalars, st.lists(st.tuples(names, scalars), max_size=3).map(tuple)) | st.builds(ir.Delete, names, scalars)
index = st.integers(0, 2**32 - 1)
nested = st.lists(scalars | st.lists(rows, max_size=2), max_size=3).map(tuple)
changes = st.builds(view.Added, index, nested) | st.builds(view.Removed, index, scalars) | st.builds(view.Changed, index, nested, st.lists(index, max_size=3).map(tuple)) | st.builds(view.Moved, index, index)


@settings(max_examples=200, deadline=None)
@given(queries)
def test_query(q):
    assert codec.decode_query(codec.encode_query(q)) == q


@settings(max_examples=100, deadline=None)
@given(st.lists(ops, max_size=4), st.binary(max_size=4), st.integers(0, 2**64 - 1), st.integers(-(2**63), 2**63 - 1))
def test_mutation(body, client, number, time):
    assert codec.decode_mutation(codec.encode_mutation(body, client, number, time)) == (body, client, number, time)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1), st.lists(changes, max_size=4).map(tuple))
def test_delta(sub, version, body):
    d = view.ViewDelta(sub, version, body)
    assert codec.decode_delta(codec.encode_delta(d)) == d


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40))
def test_garbage_is_read_or_refused(data):
    for read in (codec.decode_query, codec.decode_mutation, codec.decode_delta):
        try:
            read(data)
        except (DecodeError, UnsupportedOps):
            pass


@settings(max_examples=60, deadline=None)
@given(queries, st.data())
def test_cut_off_and_flipped_bytes(q, data):
    raw = codec.encode_query(q)
    at = data.draw(st.integers(0, len(raw)))
    flipped = bytearray(raw)
    if raw:
        flipped[at % len(raw)] ^= 1 << data.draw(st.integers(0, 7))
    for x in (raw[:at], bytes(flipped)):
        try:
            codec.decode_query(x)
        except DecodeError:
            pass


def test_unknown_fields_and_operations():
    raw = codec.encode_query(ir.Query("t", limit=3)) + codec._text(15, "later")
    assert codec.decode_query(raw) == ir.Query("t", limit=3)
    body = codec._message(5, codec._message(1, codec._message(4, b"")))
    with pytest.raises(UnsupportedOps):
        codec.decode_mutation(body)
    with pytest.raises(DecodeError):
        codec.decode_query(codec._message(2, codec._message(2, codec._message(1, codec._text(1, "c")) + codec._uint(2, 9) + codec._message(3, codec._text(1, "d")))))
