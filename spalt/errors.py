"""Errors of the library, with the messages that callers match on and a code for each class."""


class SpaltError(Exception):
    """Anything that a statement's text or data makes impossible."""

    code = "query_error"


class AnalysisError(SpaltError):
    """Found before anything runs: names, types, grouping, positions."""


class TypeMismatch(AnalysisError):
    """Values that can't meet: comparisons of different families, an order that a type doesn't have."""


class NotFound(AnalysisError):
    """A table or domain that isn't there."""

    code = "not_found"


class ConstraintError(SpaltError):
    """A write that the declared table does not allow."""


class Conflict(SpaltError):
    """A write on a state that another write has replaced."""

    code = "serialization_failure"


def error_code(error: Exception) -> str:
    """The code of an error, of this library or of Spark."""
    return getattr(error, "code", "query_error") if isinstance(error, SpaltError) else "query_error"
