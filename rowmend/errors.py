"""One exception class with a stable code, for everything that is wrong with data or arguments."""

from __future__ import annotations

from typing import Any

# The error codes a caller may see.
INVALID_INPUT = "INVALID_INPUT"
FILE_NOT_FOUND = "FILE_NOT_FOUND"
CSV_READ_FAILED = "CSV_READ_FAILED"
INVALID_TARGET_COLUMN = "INVALID_TARGET_COLUMN"
UNSUPPORTED_TARGET_TYPE = "UNSUPPORTED_TARGET_TYPE"
TRAINING_FAILED = "TRAINING_FAILED"
MODEL_STATE_LOAD_FAILED = "MODEL_STATE_LOAD_FAILED"
REPAIR_FAILED = "REPAIR_FAILED"


class DataError(Exception):
    """Raised with a code, a message for people and a details mapping for programs."""

    def __init__(self, code: str, message: str, **details: Any):
        super().__init__(f"{code}: {message}")
        self.code = code
        self.message = message
        self.details = details


def checked_int(name: str, value: Any, minimum: int, maximum: int | None = None) -> int:
    """Return ``value`` as an int inside the range, or raise before any job is planned."""
    try:
        number = int(value)
    except (TypeError, ValueError):
        raise DataError(INVALID_INPUT, f"{name} must be an integer", field=name, value=value) from None
    if number < minimum or (maximum is not None and number > maximum):
        raise DataError(
            INVALID_INPUT,
            f"{name} is outside its range",
            field=name, value=number, minimum=minimum, maximum=maximum,
        )
    return number
