"""Error kinds, byte spans and the codes that callers act on."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Kind(Enum):
    LEX = "lex"
    PARSE = "parse"
    BIND = "bind"
    TYPE = "type"
    CONSTRAINT = "constraint"
    UNSUPPORTED = "unsupported"


@dataclass(frozen=True)
class Span:
    """A half-open range of UTF-8 bytes of the statement text."""

    start: int
    end: int

    def join(self, other: Span) -> Span:
        return Span(min(self.start, other.start), max(self.end, other.end))


class EngineError(Exception):
    """Base of all errors; code and retryable tell a client what to do."""

    code = "internal"
    retryable = False


class SqlError(EngineError):
    """A statement was rejected before it ran, with the place in its text."""

    def __init__(self, kind: Kind, message: str, span: Span) -> None:
        super().__init__(f"{kind.value} error at bytes {span.start}..{span.end}: {message}")
        self.kind, self.message, self.span = kind, message, span

    @property
    def code(self) -> str:  # type: ignore[override]
        return {Kind.UNSUPPORTED: "unsupported", Kind.CONSTRAINT: "constraint"}.get(self.kind, "invalid_request")


class ConstraintError(EngineError):
    """Data breaks a table's rules: key, nullability, type, arity."""

    code = "constraint"


class CatalogError(EngineError):
    code = "invalid_request"


class TransactionAborted(EngineError):
    """Another transaction has committed first; a new attempt may succeed."""

    code = "conflict"
    retryable = True


class SchemaChanged(TransactionAborted):
    """The catalog has changed since the transaction began."""


class SequenceError(EngineError):
    """A client's request sequence is not the one that follows; verdict names why."""

    code = "conflict"

    def __init__(self, verdict: str, message: str) -> None:
        super().__init__(message)
        self.verdict = verdict


class SnapshotUnavailable(EngineError):
    """A read below the vacuum floor or beyond the last commit."""

    code = "snapshot_unavailable"


class ApplyError(EngineError):
    """A replayed commit does not fit its index."""

    code = "conflict"


class LimitExceeded(EngineError):
    code = "resource_limit"


class TransactionStateError(EngineError):
    code = "invalid_request"
