"""Errors of the dialect, all of them ValueErrors."""


class DialectError(ValueError):
    """The text isn't in the dialect."""


class ResolutionError(ValueError):
    """A name is unknown or ambiguous, or a predicate fits no input."""


class TypeMismatch(ValueError):
    """Operand types don't fit the operation."""
