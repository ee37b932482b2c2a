"""What can go wrong, by what the caller can do about it."""

from __future__ import annotations


class TidepoolError(Exception):
    """Base of all errors raised here."""


class DecodeError(TidepoolError):
    """Bytes that no message of ours has."""


class CompileError(TidepoolError):
    """A query that can't run; its author has to change it."""


class UnknownTable(CompileError):
    def __init__(self, table: str):
        super().__init__(f"there is no table {table!r}")


class UnknownColumn(CompileError):
    def __init__(self, table: str, column: str):
        super().__init__(f"table {table!r} has no column {column!r}")


class UnknownRelation(CompileError):
    def __init__(self, table: str, relation: str):
        super().__init__(f"table {table!r} has no relation {relation!r}")


class RelationTable(CompileError):
    def __init__(self, relation: str, expected: str, got: str):
        super().__init__(f"relation {relation!r} leads to {expected!r}, not to {got!r}")


class Unbounded(CompileError):
    def __init__(self, table: str):
        super().__init__(f"the list over {table!r} needs a limit, or at the root allow_unbounded")


class UnorderedWindow(CompileError):
    def __init__(self, table: str):
        super().__init__(f"the list over {table!r} has a limit but no order, so its rows are undefined")


class TooManyOrderColumns(CompileError):
    def __init__(self, table: str, n: int):
        super().__init__(f"the list over {table!r} is ordered by {n} columns; three are allowed")


class UnboundParam(CompileError):
    def __init__(self, index: int, bound: int):
        super().__init__(f"parameter {index} is read, but only {bound} are bound")


class NotYet(CompileError):
    """In the language, but switched off."""


class MutationError(TidepoolError):
    """A mutation that can't be applied; nothing of it was."""


class UnsupportedOps(MutationError):
    """A body with operations this version doesn't know."""

    def __init__(self, count: int):
        super().__init__(f"{count} operations are unknown to this version")
        self.count = count


class StoreError(TidepoolError):
    """Storage refused."""


class Closed(TidepoolError):
    """The engine or the subscription has been closed."""
