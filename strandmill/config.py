"""Options and constants."""

from __future__ import annotations

from dataclasses import dataclass

#: Distance that stands for no match.
NO_MATCH_DISTANCE = 2_147_483_647

_DEFAULTS = {"blocksize": 65535, "container_compress_level": 3, "zstd_compress_level": 3, "gzip_compress_level": 6}
_RANGES = {"blocksize": (1, 65535), "container_compress_level": (1, 22), "zstd_compress_level": (1, 22), "gzip_compress_level": (1, 9)}
_values = dict(_DEFAULTS)


def options(option: str, value: int | None = None) -> int:
    """An option's value; with ``value``, set it and return the one before."""
    if option not in _values:
        raise ValueError(f"unknown option: {option}")
    before = _values[option]
    if value is not None:
        low, high = _RANGES[option]
        if isinstance(value, bool) or int(value) != value or not low <= value <= high:
            raise ValueError(f"{option} must be a whole number from {low} to {high}")
        _values[option] = int(value)
    return before


@dataclass(frozen=True)
class RunConfig:
    """What a run is built with; taken from the options when a plan is made."""

    blocksize: int = 65535
    container_level: int = 3
    zstd_level: int = 3
    gzip_level: int = 6
    limit: int | None = None
    serial_kernel: bool = False

    @classmethod
    def current(cls, **changes) -> RunConfig:
        own = {"blocksize": _values["blocksize"], "container_level": _values["container_compress_level"], "zstd_level": _values["zstd_compress_level"], "gzip_level": _values["gzip_compress_level"]}
        return cls(**(own | changes))

    def __post_init__(self):
        if not 1 <= self.blocksize <= 65535:
            raise ValueError("blocksize must be from 1 to 65535")
        if self.limit is not None and (self.limit != int(self.limit) or self.limit < 0):
            raise ValueError("limit must be a whole number of at least 0")
