"""Routes: /table(slice,slice)@ref/child/.../property, parsed and bound to a catalog; no data is read here."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

_SEGMENT = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)(?:\(([^()]*)\))?(?:@([^/()]+))?(?:\(([^()]*)\))?")


@dataclass(frozen=True)
class Segment:
    table: str
    ref: str | None = None
    slices: tuple[str, ...] = ()

    @property
    def by_time(self) -> bool:
        """Whether the ref is a time id of the history rather than a hash."""
        return self.ref is not None and ":" in self.ref


@dataclass(frozen=True)
class Route:
    segments: tuple[Segment, ...]
    prop: str | None = None

    @property
    def tables(self) -> list[str]:
        return [s.table for s in self.segments]

    def __str__(self) -> str:
        part = lambda s: s.table + (f"({','.join(s.slices)})" if s.slices else "") + (f"@{s.ref}" if s.ref else "")
        return "/" + "/".join([*map(part, self.segments), *([self.prop] if self.prop else [])])


def parse(text: str) -> Route:
    """Raise ValueError for an empty or malformed route."""
    parts = text.strip("/").split("/")
    segments = []
    for part in parts:
        found = _SEGMENT.fullmatch(part)
        if not found:
            raise ValueError(f"invalid route {text!r} at {part!r}")
        slices = tuple(s.strip() for s in (found[2] or found[4] or "").split(",") if s.strip())
        segments.append(Segment(found[1], found[3], slices))
    return Route(tuple(segments))


def bind(route: Route, tables: set[str]) -> Route:
    """Trailing segments that name no table become the property path; an unknown table before one is an error."""
    known = [s.table in tables for s in route.segments]
    n = known.index(False) if False in known else len(known)
    if n == 0 or any(known[n:]):
        raise ValueError(f"unknown table {route.segments[n].table!r} in {route}")
    prop = ".".join(s.table for s in route.segments[n:]) or None
    return replace(route, segments=route.segments[:n], prop=prop)
