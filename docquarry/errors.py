"""Errors of the engine; each is what the served interface would report as the named status."""


class EngineError(Exception):
    status = "INTERNAL"


class NotFound(EngineError):
    status = "NOT_FOUND"


class KeyNotFound(NotFound):
    pass


class AlreadyExists(EngineError):
    status = "ALREADY_EXISTS"


class DuplicateKey(AlreadyExists):
    pass


class UniqueViolation(AlreadyExists):
    pass


class InvalidArgument(EngineError, ValueError):
    status = "INVALID_ARGUMENT"


class InvalidPageToken(InvalidArgument):
    pass


class ReservedField(InvalidArgument):
    pass


class RecordTooLarge(InvalidArgument):
    pass


class MalformedRecord(InvalidArgument):
    """A bad line of a bulk load; ``line`` counts from 1."""

    def __init__(self, line: int, why: str):
        super().__init__(f"line {line}: {why}")
        self.line = line


class QuotaExceeded(EngineError):
    status = "RESOURCE_EXHAUSTED"


class ReadOnly(EngineError):
    status = "FAILED_PRECONDITION"


class Conflict(EngineError):
    status = "ABORTED"


class IntegrityError(EngineError):
    status = "DATA_LOSS"


class OpaqueField(InvalidArgument):
    """A filter, sort, group or index on an encrypted field."""
