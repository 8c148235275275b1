"""Reports on a graph: what to show, how to collapse it, and in which format."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from weftgraph.errors import EmptySnapshotError, UserError
from weftgraph.operators.graph import own_nodes
from weftgraph.operators.snapshot import BACKWARD, BOTH, FORWARD, Narrowing, Snapshot, SnapshotOptions, project_snapshot
from weftgraph.options import CheckOptions
from weftgraph.plans.base import Stage, options_or_default
from weftgraph.report import plural
from weftgraph.sinks import render
from weftgraph.sinks.files import write_text


@dataclass(frozen=True)
class Graph(Stage):
    options: SnapshotOptions = SnapshotOptions()
    check_options: CheckOptions | None = None

    def _with(self, verb: str, phrase: str, change: Callable[[], SnapshotOptions]) -> Graph:
        return self._try(verb, lambda: replace(self, options=change(), said=(*self.said, phrase)))

    def including_external_dependencies(self) -> Graph:
        return self._with("including", "including external dependencies", lambda: replace(self.options, external=True))

    def including_self_dependencies(self) -> Graph:
        """Dependencies within a collapsed node."""
        return self._with("including", "including self dependencies", lambda: replace(self.options, self_dependencies=True))

    def _narrow(self, verb: str, pattern: str, towards: str, depth: int | None = None) -> Graph:
        def made() -> SnapshotOptions:
            return replace(self.options, narrowing=(*self.options.narrowing, Narrowing(self.patterns.path(pattern), towards, depth)))

        within = "" if depth is None else f" within {plural(depth, 'hop')}"
        return self._with(verb, f'{verb} path matches "{pattern}"{within}', made)

    def focus_on(self, pattern: str, depth: int) -> Graph:
        return self._narrow("focus on", pattern, BOTH, max(0, depth))

    def reachable_from(self, pattern: str) -> Graph:
        return self._narrow("reachable from", pattern, FORWARD)

    def dependents_of(self, pattern: str) -> Graph:
        return self._narrow("dependents of", pattern, BACKWARD)

    def collapse_to_folder_depth(self, depth: int) -> Graph:
        def made() -> SnapshotOptions:
            if depth < 1:
                raise UserError(f"a depth of {depth} leaves no folder")
            return replace(self.options, folder_depth=depth)

        return self._with("collapse to folder depth", f"collapse to folder depth {depth}", made)

    def collapse_by_pattern(self, label: str, pattern: str) -> Graph:
        def made() -> SnapshotOptions:
            if not label.strip():
                raise UserError("a group needs a label")
            return replace(self.options, groups=(*self.options.groups, (label, self.patterns.path(pattern))))

        return self._with("collapse by pattern", f'collapse path matches "{pattern}" into "{label}"', made)

    def except_(self, *patterns: str) -> Graph:
        """Qualifies the last modifier that took a pattern."""

        def made() -> SnapshotOptions:
            if not patterns:
                raise UserError("an exclusion needs at least one pattern")
            more = [self.patterns.path(p) for p in patterns]
            last = next((s for s in reversed(self.said) if "path matches" in s), None)
            if last is None:
                raise UserError("an exclusion needs a pattern before it")
            if last.startswith("collapse"):
                *rest, (label, f) = self.options.groups
                return replace(self.options, groups=(*rest, (label, f.excluding(*more))))
            *rest, n = self.options.narrowing
            return replace(self.options, narrowing=(*rest, replace(n, seeds=n.seeds.excluding(*more))))

        return self._with("except", "excluding " + ", ".join(f'"{p}"' for p in patterns), made)

    def titled(self, title: str) -> Graph:
        return self._with("titled", f'titled "{title}"', lambda: replace(self.options, title=title))

    def with_check_options(self, options: CheckOptions) -> Graph:
        return replace(self, check_options=options)

    def snapshot(self) -> Snapshot:
        """Three DataFrames; nothing in the report is an error unless the options allow it."""
        options = options_or_default(self.check_options)
        edges = self._edges(options)
        out = project_snapshot(edges, self.options)
        # a declared node that nothing narrows away is a node of the report, and is found without its dependencies
        shown = not self.options.narrowing and not options.allow_empty_tests and not own_nodes(edges.where("not external")).isEmpty()
        if not options.allow_empty_tests and not shown and out.nodes.isEmpty():
            raise EmptySnapshotError("the report holds no node")
        return out

    def _text(self, renderer: Callable[[render.Drawn], str]) -> str:
        return renderer(render.drawn(self.snapshot()))

    def to_dot(self) -> str:
        return self._text(render.dot)

    def to_mermaid(self) -> str:
        return self._text(render.mermaid)

    def to_d2(self) -> str:
        return self._text(render.d2)

    def to_csv(self) -> str:
        return self._text(render.csv)

    def to_json(self) -> str:
        return self._text(render.json)

    def to_html(self) -> str:
        return self._text(render.page)

    def export_as_dot(self, path: str) -> None:
        write_text(path, self.to_dot)

    def export_as_mermaid(self, path: str) -> None:
        write_text(path, self.to_mermaid)

    def export_as_d2(self, path: str) -> None:
        write_text(path, self.to_d2)

    def export_as_csv(self, path: str) -> None:
        write_text(path, self.to_csv)

    def export_as_json(self, path: str) -> None:
        write_text(path, self.to_json)

    def export_as_html(self, path: str) -> None:
        write_text(path, self.to_html)

    def __str__(self) -> str:
        return ", ".join(["project graph", *self.said]) + (f" (rejected: {self.error})" if self.error else "")


def project_graph(edges, patterns=None) -> Graph:
    return Graph(source=edges, **({"patterns": patterns} if patterns else {}))


dependency_graph = project_graph
