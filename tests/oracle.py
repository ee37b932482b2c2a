"""The query language in plain Python, written for clarity: what every lowering must equal."""

from __future__ import annotations

import functools
import math

from tidepool.plans import ir

RANK = {bool: 0, int: 0, float: 0, str: 1, bytes: 2}


def sql_cmp(a, b):
    """-1, 0, 1, or None if unknown."""
    if a is None or b is None:
        return None
    ra, rb = RANK[type(a)], RANK[type(b)]
    if ra != rb:
        return -1 if ra < rb else 1
    if ra == 0:
        nan_a, nan_b = isinstance(a, float) and math.isnan(a), isinstance(b, float) and math.isnan(b)
        if nan_a or nan_b:
            return (nan_a > nan_b) - (nan_a < nan_b)
    if isinstance(a, str):
        a, b = a.encode(), b.encode()
    return (a > b) - (a < b)  # Python compares ints and floats exactly


def value(expr, row, params):
    match expr:
        case ir.Col(name):
            return row.get(name)
        case ir.Lit(v):
            return v
        case ir.Param(i):
            return params[i] if i < len(params) else None


def test3(p, row, params=()):
    """True, False or None."""
    get = lambda e: value(e, row, params)
    match p:
        case ir.Always():
            return True
        case ir.Cmp(a, op, b):
            c = sql_cmp(get(a), get(b))
            return None if c is None else {"=": c == 0, "!=": c != 0, "<": c < 0, "<=": c <= 0, ">": c > 0, ">=": c >= 0}[op]
        case ir.In(a, values):
            x = get(a)
            if x is None:
                return None
            found = [sql_cmp(x, v) for v in values]
            return True if 0 in found else None if None in found else False
        case ir.Between(a, lo, hi):
            return test3(ir.And((ir.Cmp(a, ">=", lo), ir.Cmp(a, "<=", hi))), row, params)
        case ir.IsNull(e):
            return get(e) is None
        case ir.IsNotNull(e):
            return get(e) is not None
        case ir.Prefix(a, prefix):
            x = get(a)
            return None if x is None else isinstance(x, str) and x.encode().startswith(prefix.encode())
        case ir.And(parts):
            r = [test3(x, row, params) for x in parts]
            return False if False in r else None if None in r else True
        case ir.Or(parts):
            r = [test3(x, row, params) for x in parts]
            return True if True in r else None if None in r else False
        case ir.Not(x):
            r = test3(x, row, params)
            return None if r is None else not r


def order_key(order, key):
    def cmp(a, b):
        for o in order:
            x, y = a[o.column], b[o.column]
            c = (x is not None) - (y is not None) if x is None or y is None else sql_cmp(x, y)
            if c:
                return -c if o.desc else c
        return sql_cmp(a[key], b[key]) or 0

    return functools.cmp_to_key(cmp)


def evaluate(query: ir.Query, tables: dict, keys: dict, relations: dict, root_params=None):
    """Ordered rows as dicts; children as lists of dicts."""
    params = query.params or root_params or ()
    rows = [dict(r) for r in tables[query.table] if test3(query.where, r, params) is True]
    rows.sort(key=order_key(query.order, keys[query.table]))
    if query.limit:
        rows = rows[: query.limit]
    for rel in query.related:
        parent_column, child_column = relations[query.table, rel.relation]
        for r in rows:
            mine = {**tables, rel.query.table: [k for k in tables[rel.query.table] if sql_cmp(k[child_column], r[parent_column]) == 0]}
            r[rel.name or rel.relation] = evaluate(rel.query, mine, keys, relations, params)
    return rows
