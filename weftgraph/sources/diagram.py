"""Component diagrams in a small subset of PlantUML: read, normalised, written again."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from weftgraph.errors import TechnicalError, UserError

#: A bare name, or one in brackets that may hold blanks.
_NAME = re.compile(r"\s*(?:\[\s*([^\[\]]*[^\[\]\s])\s*\]|([^\[\]\s]+))\s*")
_DECLARED = re.compile(r"(?i:component)\s(?P<named>.*)|(?P<boxed>\[.*)", re.S)


def _name(text: str) -> str | None:
    m = _NAME.fullmatch(text)
    return (m[1] or m[2]) if m else None


def _arrow(said: str) -> tuple[str, str] | None:
    """One or more dashes and one head, left to right, with an optional label behind a colon."""
    left, _, right = said.partition(">")
    source, target = left.rstrip("-"), right.partition(":")[0]
    if source == left or set("<>") & set(source + target):
        return None
    ends = _name(source), _name(target)
    return ends if all(ends) else None


@dataclass(frozen=True)
class Diagram:
    components: tuple[str, ...] = ()
    dependencies: tuple[tuple[str, str], ...] = ()

    @classmethod
    def of(cls, components: Iterable[str], dependencies: Iterable[tuple[str, str]]) -> Diagram:
        """Ends of arrows are components too, arrows to oneself and repeats go; first seen, first listed."""
        arrows = list(dependencies)
        names = dict.fromkeys(components) | dict.fromkeys(x for a in arrows for x in a)
        return cls(tuple(names), tuple(dict.fromkeys(a for a in arrows if a[0] != a[1])))


def parse_diagram(text: str) -> Diagram:
    """Frames, comments, `component X`, `[X]` and `A --> B : label`; anything else is an error that names its line."""
    components: list[str] = []
    arrows: list[tuple[str, str]] = []
    inside = False
    for number, line in enumerate(text.split("\n"), 1):
        said = line.strip()
        if inside:
            inside = "'/" not in said
        elif not said or said.startswith("'") or said.split(" ")[0].lower() in ("@startuml", "@enduml"):
            pass
        elif said.startswith("/'"):
            inside = "'/" not in said[2:]
        elif ">" in said:
            if (arrow := _arrow(said)) is None:
                raise UserError(f"unreadable diagram line {number}: {said!r}")
            arrows.append(arrow)
        elif (m := _DECLARED.fullmatch(said)) and (name := _name(m["named"] or m["boxed"] or "")):
            components.append(name)
        else:
            raise UserError(f"unreadable diagram line {number}: {said!r}")
    out = Diagram.of(components, arrows)
    if not out.components:
        raise UserError("the diagram declares nothing")
    return out


def read_diagram(path: str) -> Diagram:
    try:
        with open(path, encoding="utf-8") as f:
            return parse_diagram(f.read())
    except OSError as e:
        raise TechnicalError(f"read the diagram {path}") from e


_SAFE = str.maketrans({"[": "(", "<": "(", "]": ")", ">": ")", "\n": " ", "\r": " ", "\t": " "})


def render_plantuml(components: list[str], dependencies: list[tuple[str, str]]) -> str:
    """A document that parse_diagram reads back; brackets in names become parentheses."""
    count = lambda n, one, many: f"{n} {one if n == 1 else many}"
    box = lambda name: f"[{name.translate(_SAFE)}]"
    lines = ["@startuml", f"' {count(len(components), 'component', 'components')}, {count(len(dependencies), 'dependency', 'dependencies')}"]
    lines += [f"component {box(c)}" for c in components]
    lines += [f"{box(a)} --> {box(b)}" for a, b in dependencies]
    return "\n".join([*lines, "@enduml", ""])
