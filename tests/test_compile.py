"""Every way in which a query is refused, and what a compiled one says."""

import pytest
from pyspark.sql import types as T

from tidepool import errors as E
from tidepool.plans import ir
from tidepool.plans.compile import compile_query
from tidepool.schema import Catalog, Relation, Table


def catalog():
    issues = T.StructType([T.StructField("id", T.LongType()), T.StructField("project_id", T.LongType()), T.StructField("priority", T.LongType())])
    comments = T.StructType([T.StructField("id", T.LongType()), T.StructField("issue_id", T.LongType()), T.StructField("created_at", T.LongType())])
    c = Catalog().add(Table("issues", issues, "id")).add(Table("comments", comments, "id"))
    return c.relate(Relation("comments", "issues", "comments", "id", "issue_id")).relate(Relation("replies", "comments", "comments", "id", "issue_id"))


O = (ir.Order("priority"),)
SUB = ir.Query("comments", order=(ir.Order("created_at", True),), limit=3)


@pytest.mark.parametrize(
    "query,error",
    [
        (ir.Query("nowhere", order=O, limit=5), E.UnknownTable),
        (ir.Query("issues", ir.Cmp(ir.Col("x"), "=", ir.Lit(1)), O, 5), E.UnknownColumn),
        (ir.Query("issues", order=(ir.Order("x"),), limit=5), E.UnknownColumn),
        (ir.Query("issues", order=O, limit=5, select=("x",)), E.UnknownColumn),
        (ir.Query("issues", order=O, limit=5, related=(ir.Related("x", SUB),)), E.UnknownRelation),
        (ir.Query("issues", order=O, limit=5, related=(ir.Related("comments", ir.Query("issues", order=O, limit=1)),)), E.RelationTable),
        (ir.Query("issues", order=O), E.Unbounded),
        (ir.Query("issues", order=O, limit=5, related=(ir.Related("comments", ir.Query("comments", allow_unbounded=True)),)), E.Unbounded),
        (ir.Query("issues", limit=5), E.UnorderedWindow),
        (ir.Query("issues", order=O * 4, limit=5), E.TooManyOrderColumns),
        (ir.Query("issues", ir.Cmp(ir.Col("id"), "=", ir.Param(1)), O, 5, params=(1,)), E.UnboundParam),
        (ir.Query("issues", order=O, limit=5, related=(ir.Related("comments", ir.Query("comments", order=SUB.order, limit=1, related=(ir.Related("replies", SUB),))),)), E.NotYet),
    ],
)
def test_rejections(query, error):
    with pytest.raises(error):
        compile_query(query, catalog())


def test_compiled():
    q = ir.Query("issues", ir.Cmp(ir.Col("project_id"), "=", ir.Param(0)), O, 5, (ir.Related("comments", SUB, "latest"),), params=(7,))
    c = compile_query(q, catalog())
    assert (c.limit, c.params, c.tables, c.children[0].name, c.children[0].query.limit) == (5, (7,), {"issues", "comments"}, "latest", 3)
    assert compile_query(ir.Query("issues", allow_unbounded=True), catalog()).limit is None
    assert ir.shape_hash(q) == ir.shape_hash(ir.Query(**{**q.__dict__, "params": (8,)})) and ir.view_hash(q) != ir.view_hash(ir.Query(**{**q.__dict__, "params": (8,)}))


def test_nested_switch():
    q = ir.Query("issues", order=O, limit=5, related=(ir.Related("comments", ir.Query("comments", order=SUB.order, limit=1, related=(ir.Related("replies", SUB),))),))
    assert compile_query(q, catalog(), nested=True).children[0].query.children[0].name == "replies"
