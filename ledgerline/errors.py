"""Typed failures, where a caller would otherwise see an empty result."""


class LedgerError(Exception):
    pass


class SourceError(LedgerError):
    """Input that can't be read as what it should be."""


class NameCollision(LedgerError):
    """Two columns get the same sanitised name."""


class InvalidTablePath(LedgerError, ValueError):
    """Not three non-empty parts with dots between them."""
