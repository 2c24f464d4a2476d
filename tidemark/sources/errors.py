"""What can be wrong with a source; the names are the values of ``error_type`` in issues."""

from __future__ import annotations


class SourceError(Exception):
    """A source lacks what the query needs."""


class RootError(SourceError):
    """The variable that names the root folder is unset or empty."""


class FolderNotFoundError(SourceError):
    """A folder that must exist doesn't."""


class InvalidSubjectIDError(SourceError):
    """A subject's id is empty, padded or unsafe in a path."""


class EDFFileNotFoundError(SourceError):
    """A subject has no recording."""


class ChannelResolutionError(SourceError):
    """A wanted channel has no label in the recording, or is no known name."""


class DataLoadError(SourceError):
    """A recording can't be read, or not as one array."""


class AnnotationLoadError(SourceError):
    """A subject's stages can't be read."""
