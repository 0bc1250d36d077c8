"""Errors raised by the toolkit; each carries the details a caller may want to show."""

from __future__ import annotations


class TableError(ValueError):
    """Base error. ``details`` holds structured facts such as row and column."""

    def __init__(self, message: str, **details: object) -> None:
        super().__init__(message)
        self.details = details


class DatasetSchemaError(TableError):
    """Confirmed fields do not match the source, or a cell cannot be converted."""


class FileEncodingError(TableError):
    """The text encoding of a file cannot be established."""


class ArchiveError(TableError):
    """An archive breaks a safety limit or cannot be opened."""


class ParameterError(TableError):
    """An algorithm id, parameter or column role is not acceptable."""


class ChartSpecError(TableError):
    """A chart asks for columns that are missing."""
