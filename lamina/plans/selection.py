"""Models of a view: which columns, in what order, sorted how, with what values set."""

from __future__ import annotations

import re
from dataclasses import dataclass

from lamina.functions.hashing import hash_of

ROUTE = re.compile(r"[a-z][A-Za-z0-9]*(/[a-z][A-Za-z0-9_]*)*")


@dataclass(frozen=True)
class ViewColumn:
    """A route to a property, the alias it has in the view, and titles."""

    route: str
    alias: str
    type: str = "string"
    title: str = ""

    @property
    def layer(self) -> str:
        return self.route.rsplit("/", 1)[0]

    @property
    def prop(self) -> str:
        return self.route.rsplit("/", 1)[1]

    @property
    def hash(self) -> str:
        return hash_of({"route": self.route, "alias": self.alias, "type": self.type, "title": self.title})


@dataclass(frozen=True)
class Selection:
    columns: tuple[ViewColumn, ...] = ()

    def __post_init__(self) -> None:
        for what in ("route", "alias"):
            values = [getattr(c, what) for c in self.columns]
            if twice := sorted({v for v in values if values.count(v) > 1}):
                raise ValueError(f"{what} not unique: {twice}")
        if bad := [c.route for c in self.columns if not ROUTE.fullmatch(c.route)]:
            raise ValueError(f"routes not in lower camel case: {bad}")

    @classmethod
    def from_routes(cls, routes: list[str]) -> Selection:
        """Aliases are last segments, with a counter where they clash; repeated routes count once."""
        columns: list[ViewColumn] = []
        for route in dict.fromkeys(r.strip("/") for r in routes):
            last, taken, n = route.rsplit("/", 1)[-1], {c.alias for c in columns}, 0
            alias = last
            while alias in taken:
                n += 1
                alias = f"{last}{n}"
            columns.append(ViewColumn(route, alias))
        return cls(tuple(columns))

    @classmethod
    def merge(cls, selections: list[Selection]) -> Selection:
        return cls.from_routes([c.route for s in selections for c in s.columns])

    @property
    def routes(self) -> list[str]:
        return [c.route for c in self.columns]

    @property
    def aliases(self) -> list[str]:
        return [c.alias for c in self.columns]

    @property
    def hash(self) -> str:
        return hash_of([{"route": c.route, "alias": c.alias} for c in self.columns])

    def index(self, which: int | str | list[str], missing: int | None = None) -> int:
        """By position, hash, alias, route or list of route segments, in this order."""
        if isinstance(which, int):
            if 0 <= which < len(self.columns):
                return which
        else:
            route = which.strip("/") if isinstance(which, str) else "/".join(which)
            for attribute in ("hash", "alias", "route"):
                for n, c in enumerate(self.columns):
                    if getattr(c, attribute) == (which if attribute == "hash" else route):
                        return n
        if missing is None:
            raise KeyError(f"no column {which!r}; there are {self.routes}")
        return missing

    def column(self, which: int | str | list[str]) -> ViewColumn:
        return self.columns[self.index(which)]

    def added(self, to: Selection) -> list[str]:
        """Routes of this selection that `to` lacks."""
        return [r for r in self.routes if r not in to.routes]

    def metadata(self, attribute: str) -> list:
        return [getattr(c, attribute) for c in self.columns]

    def __len__(self) -> int:
        return len(self.columns)


@dataclass(frozen=True)
class RowSort:
    """(route or alias, "asc" or "desc") in order of weight."""

    by: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class SetValue:
    route: str
    value: object
