"""Errors raised on the driver before an action, each with a hint for the caller."""

from __future__ import annotations


class EngineError(Exception):
    def __init__(self, message: str, hint: str | None = None):
        super().__init__(message)
        self.hint = hint

    def to_dict(self) -> dict:
        out = {"error": type(self).__name__, "message": str(self)}
        return out | {"hint": self.hint} if self.hint else out


class CatalogError(EngineError):
    """A listing or catalog document can't be read."""


class SchemaVersionError(EngineError):
    """A stored catalog is newer than this code."""


class AssetNotFound(EngineError):
    """An acquisition has no such asset."""


class UnsupportedMeasurement(EngineError):
    """A product lacks the metadata that a measurement needs."""


class UnreadableProduct(EngineError):
    """A product's header can't be read."""


class PlanError(EngineError, ValueError):
    """Parameters of a query are missing, of a wrong type or contradictory."""


class ProvenanceMismatch(EngineError):
    """Sources that must agree were made in different ways."""
