"""Errors by what went wrong; their texts begin with the kind."""

from __future__ import annotations


class EngineError(RuntimeError):
    kind = ""

    def __init__(self, message: str):
        super().__init__(f"{self.kind}: {message}" if self.kind else message)


class ConfigError(EngineError):
    kind = "configuration error"


class ValidationError(EngineError):
    kind = "validation error"


class ControlError(EngineError):
    kind = "control error"


class CaptureError(EngineError):
    kind = "capture error"


class ExportError(EngineError):
    kind = "export error"


class CleanupError(EngineError):
    """The operation failed, and cleaning up after it too."""

    def __init__(self, operation: BaseException, cleanup: BaseException):
        self.operation, self.cleanup = operation, cleanup
        super().__init__(f"persistence failed ({operation}); cleanup also failed ({cleanup})")


class IndeterminatePublication(EngineError):
    """Whether the files are out can't be told; nothing goes on until recovery settles it."""

    def __init__(self, operation: BaseException | str):
        self.operation = operation
        super().__init__(f"publication outcome is indeterminate after: {operation}")


class UnidentifiedStaging(EngineError):
    def __init__(self, path: str):
        self.path = path
        super().__init__(f"unidentified staging at {path} requires manual removal or recovery")


class Busy(ControlError):
    """The lane, the export or the ring is taken."""
