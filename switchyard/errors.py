"""Errors of the engine; each names the stage that refused its input."""

from __future__ import annotations


class SourceError(ValueError):
    """A pinned source file, its manifest or its schema is not as declared."""


class SourceDependencyError(RuntimeError):
    """Something that reading a source needs is not installed."""


class CanonicalDataError(ValueError):
    """Canonical tables break a key, value or relationship rule."""


class DeduplicationError(ValueError):
    """Queries or settings that cannot be deduplicated."""


class SplitError(ValueError):
    """A split that cannot be built from its input."""


class SplitValidationError(SplitError):
    """A split that breaks a boundary it promises."""


class SplitIOError(ValueError):
    """A split input or output that cannot be read or written."""


class StorageConfigurationError(ValueError):
    """A storage path that is missing or unsafe."""
