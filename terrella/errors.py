"""Failures by category; the command line turns each into an exit code."""

from __future__ import annotations


class TerrellaError(Exception):
    exit_code = 5


class InputError(TerrellaError):
    exit_code = 2


class ShapeError(TerrellaError):
    exit_code = 3


class FileError(TerrellaError):
    exit_code = 4


class InternalError(TerrellaError):
    exit_code = 5


def categorised(error: Exception) -> TerrellaError:
    """The failure itself, or its category: what the system refuses is a matter of files, all else of this program."""
    if isinstance(error, TerrellaError):
        return error
    return FileError(str(error)) if isinstance(error, OSError) else InternalError(str(error) or type(error).__name__)
