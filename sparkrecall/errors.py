"""Errors, each also a built-in error, so that either can be caught."""

from __future__ import annotations


class RecallError(Exception):
    """Base of all errors of this package."""


class ConfigError(RecallError, ValueError):
    """A setting that cannot be used."""


class DimensionError(RecallError, ValueError):
    """A vector of another length; ``index`` is its row, if known."""

    def __init__(self, expected: int, got: int, index: int | None = None):
        super().__init__(f"expected {expected} dimensions, got {got}" + (f" at row {index}" if index is not None else ""))
        self.expected, self.got, self.index = expected, got, index


class InputTooLong(RecallError, ValueError):
    """A text beyond the model's context; the caller's error, not the backend's."""

    def __init__(self, tokens: int, limit: int, index: int | None = None):
        super().__init__(f"{tokens} tokens, at most {limit}")
        self.tokens, self.limit, self.index = tokens, limit, index


class BackendError(RecallError, RuntimeError):
    """The model failed or is refused by its breaker."""


class StoreError(RecallError, OSError):
    """A file or table cannot be read or written."""
