"""Errors and the HTTP status that a surface answers with. Of several that fit, the most special one counts."""

from quillon.operators.models import ModelError
from quillon.sources.extract import ExtractionError


class EngineError(Exception):
    status = 500


class InvalidInput(EngineError):
    status = 422


class WrongType(InvalidInput):
    status = 415


class TooLarge(InvalidInput):
    status = 413


class NotFound(EngineError):
    status = 404


class UpstreamError(EngineError):
    status = 502


class Misconfigured(EngineError):
    status = 500


def status_of(error: Exception) -> int:
    if isinstance(error, EngineError):
        return error.status
    return 502 if isinstance(error, ModelError) else 422 if isinstance(error, ExtractionError) else 500
