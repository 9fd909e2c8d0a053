"""Settings of a grid and of paging, checked on construction."""

from __future__ import annotations

from dataclasses import dataclass


def power_of_two(name: str, value: int, least: int = 1) -> int:
    if not isinstance(value, int) or value < least or value & (value - 1):
        raise ValueError(f"{name} must be a power of two of at least {least}, not {value!r}")
    return value


@dataclass(frozen=True)
class GridConfig:
    """tag_width and time_width (ms) of a cell; tolerance in cells; disks of one shard set."""

    # fixed values: with these defaults, cells, paths and workers are those of other writers of such grids
    tag_width: int = 1 << 9
    time_width: int = 1 << 26
    prefix: str = "l"
    separator: str = "-"
    tolerance: int = 1
    disks: tuple[str, ...] = ("disk1", "disk2", "disk3", "disk4", "disk5")
    shard_set: str = "set1"
    workers: int = 10

    def __post_init__(self):
        power_of_two("tag_width", self.tag_width)
        power_of_two("time_width", self.time_width)
        if self.tolerance < 0 or self.workers < 1 or not self.disks:
            raise ValueError("tolerance must not be negative; there must be a worker and a disk")


@dataclass(frozen=True)
class PageConfig:
    time_step: int = 1 << 16
    tag_step: int = 1 << 6
    rows_per_page: int = 10_000

    def __post_init__(self):
        power_of_two("time_step", self.time_step, 2)
        power_of_two("tag_step", self.tag_step, 2)
        if self.rows_per_page < 1:
            raise ValueError("rows_per_page must be positive")


def check_range(start: int, end: int, step: int | None = None) -> None:
    """A half-open range [start, end) of a query: start below end, start not negative, step a power of two above 1."""
    if start >= end:
        raise ValueError("start must be below end")
    if start < 0 or end < 1:
        raise ValueError("start must not be negative and end must be positive")
    if step is not None:
        power_of_two("step", step, 2)
