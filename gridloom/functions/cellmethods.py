"""Cell methods: the text form of what statistics a value went through, such as `time: mean over years (interval: 1 day)`."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Clauses that may follow a method, in their usual order.
CLAUSES = ("where", "within", "over")


@dataclass
class CellMethod:
    axes: tuple[str, ...]
    method: str
    qualifiers: dict[str, str] = field(default_factory=dict)
    interval: tuple[str, ...] = ()
    comment: str | None = None

    def __str__(self) -> str:
        words = [f"{a}:" for a in self.axes] + [self.method]
        for k in CLAUSES:
            if k in self.qualifiers:
                words += [k, self.qualifiers[k]]
        extra = [f"interval: {i}" for i in self.interval]
        if self.comment:
            extra.append(f"comment: {self.comment}" if extra else self.comment)
        return " ".join(words) + (f" ({' '.join(extra)})" if extra else "")

    def renamed(self, names: dict[str, str]) -> CellMethod:
        return CellMethod(tuple(names.get(a, a) for a in self.axes), self.method, dict(self.qualifiers), self.interval, self.comment)

    def equivalent(self, other: CellMethod) -> bool:
        """Equal but for the order of the axes and comments."""
        if len(self.axes) > 1 and self.interval and len(self.interval) == len(self.axes) and len(other.interval) == len(other.axes):
            same = sorted(zip(self.axes, self.interval)) == sorted(zip(other.axes, other.interval))
        else:
            same = sorted(self.axes) == sorted(other.axes) and self.interval == other.interval
        return same and (self.method, self.qualifiers) == (other.method, other.qualifiers)


def parse(text: str) -> list[CellMethod]:
    """All cell methods of a text, in order."""
    out, pos = [], 0
    token = re.compile(r"\s*(\([^)]*\)|[^\s()]+)")
    tokens = []
    while pos < len(text.rstrip()):
        m = token.match(text, pos)
        if not m:
            raise ValueError(f"can't read the cell methods {text!r}")
        tokens.append(m[1])
        pos = m.end()
    i = 0
    while i < len(tokens):
        axes = []
        while i < len(tokens) and tokens[i].endswith(":"):
            axes.append(tokens[i][:-1])
            i += 1
        if not axes or i >= len(tokens):
            raise ValueError(f"can't read the cell methods {text!r}")
        made = CellMethod(tuple(axes), tokens[i])
        i += 1
        while i < len(tokens) and tokens[i] in CLAUSES:
            if i + 1 >= len(tokens):
                raise ValueError(f"{tokens[i]!r} lacks its name in {text!r}")
            made.qualifiers[tokens[i]] = tokens[i + 1]
            i += 2
        if i < len(tokens) and tokens[i].startswith("("):
            inside = tokens[i][1:-1].strip()
            parts = re.split(r"\s*\b(interval|comment):\s*", inside)
            made.comment = parts[0] or None
            intervals = []
            for key, value in zip(parts[1::2], parts[2::2]):
                if key == "interval":
                    intervals.append(value.strip())
                else:
                    made.comment = value.strip()
            made.interval = tuple(intervals)
            i += 1
        out.append(made)
    return out
