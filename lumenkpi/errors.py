"""Errors that callers can tell apart."""

from __future__ import annotations


class EngineError(Exception):
    """Anything this library rejects; ``details`` says what."""

    code = "ENGINE_ERROR"

    def __init__(self, message: str, **details: object):
        super().__init__(message)
        self.message, self.details = message, details

    def as_dict(self) -> dict[str, object]:
        return {"error": {"code": self.code, "message": self.message, "details": self.details}}


class InvalidInput(EngineError, ValueError):
    code = "INVALID_INPUT"


class NotFound(EngineError, LookupError):
    code = "NOT_FOUND"


class Conflict(EngineError):
    """A uniqueness rule is broken."""

    code = "CONFLICT"
