"""Layers: named groups of files, and policies on what they may depend on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph import report
from weftgraph.errors import UserError
from weftgraph.functions.patterns import Filter, Selection
from weftgraph.operators import graph
from weftgraph.operators.projection import Mapping, apart, gathered
from weftgraph.options import CheckOptions, Logger, Population, guard, logged, progress
from weftgraph.plans.base import Stage, options_or_default

ONLY, NOT = "may only depend on", "may not depend on"


@dataclass(frozen=True)
class Clause:
    layer: str
    mood: str
    named: tuple[str, ...]

    def __str__(self) -> str:
        named = " layers " + ", ".join(f'"{n}"' for n in self.named) if self.named else " no layers"
        return f'where layer "{self.layer}", {self.mood}{named}'


def layer_of(identifier: Column, layers: tuple[tuple[str, Selection], ...]) -> Column:
    """The first declared layer with a selector that matches."""
    out = None
    for name, selection in layers:
        hit = selection.column(identifier)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(None).cast("string") if out is None else out


@dataclass(frozen=True)
class Layers(Stage):
    layers: tuple[tuple[str, Selection], ...] = ()
    clauses: tuple[Clause, ...] = ()

    def layer(self, name: str) -> LayerDeclaration:
        return LayerDeclaration(self, name)

    def _declare(self, name: str, make: Callable[[], Filter]) -> Layers:
        def declared() -> Layers:
            if not name.strip():
                raise UserError("a layer needs a name")
            made, known = make(), dict(self.layers)
            known[name] = known.get(name, Selection(any_of=True)).add(made)  # a known name keeps its place
            # exclusions speak of the last selector that was declared
            return replace(self, layers=tuple(known.items()), said=(name,))

        return self._try(f"layer {name!r}", declared)

    def _excluding(self, patterns: tuple[str, ...], build: Callable[[str], Filter] | None) -> Layers:
        def excluded() -> Layers:
            if not self.layers:
                raise UserError("an exclusion needs a layer before it")
            name, known = self.said[-1], dict(self.layers)
            target = known[name].filters[-1].target
            of = build or (lambda p: self.patterns.filter(p, target))
            known[name] = known[name].excepting(*map(of, patterns))
            return replace(self, layers=tuple(known.items()))

        return self._try("except", excluded)

    def except_(self, *patterns: str) -> Layers:
        return self._excluding(patterns, None)

    def except_folder(self, *patterns: str) -> Layers:
        return self._excluding(patterns, self.patterns.folder)

    def except_path(self, *patterns: str) -> Layers:
        return self._excluding(patterns, self.patterns.path)

    def where_layer(self, name: str) -> LayerClause:
        bad = self if name in dict(self.layers) else self._try("where layer", lambda: _undeclared(name))
        return LayerClause(bad, name)

    def select_layer_files(self, options: CheckOptions | None = None) -> DataFrame:
        """layer, files (sorted; none for a layer without any)."""
        edges = self._edges(options_or_default(options))
        spark = edges.sparkSession
        placed = graph.own_nodes(edges).withColumn("layer", layer_of(F.col("node"), self.layers)).where("layer is not null")
        groups = placed.groupBy("layer").agg(F.array_sort(F.collect_list("node")).alias("files"))
        names = spark.createDataFrame([(n,) for n, _ in self.layers], "layer string")
        return names.join(groups, "layer", "left").select("layer", F.coalesce("files", F.array().cast("array<string>")).alias("files"))

    def mapping(self) -> Mapping:
        place = lambda c: layer_of(F.col(c), self.layers)
        return Mapping(place("source"), place("target"), ~F.col("external"))

    def check(self, options: CheckOptions | None = None) -> DataFrame:
        options = options_or_default(options)
        return logged(self, options, lambda log: self._judge(options, log))

    def tally(self, options: CheckOptions | None = None) -> DataFrame:
        """check() with the number of edges behind a pair, n, in place of their list: no row holds a pair's edges."""
        return self._judge(options_or_default(options), listed=False)

    def _judge(self, options: CheckOptions, log: Logger | None = None, listed: bool = True) -> DataFrame:
        edges = self._edges(options)
        if not self.clauses:
            raise UserError("a policy needs a clause")
        own = graph.own_nodes(edges).withColumn("layer", layer_of(F.col("node"), self.layers))
        asked = [Population(f'files in layer "{n}"', str(s), own, F.coalesce(F.col("layer") == n, F.lit(False))) for n, s in self.layers]
        if (empty := guard(asked, options)) is not None:
            return empty if listed else report.tallied(empty)
        spark = edges.sparkSession
        # What a pair of layers breaks follows from the policy alone, so edges meet the broken pairs before they are
        # gathered. There are at most as many pairs as the user declared layers, squared.
        broken = F.broadcast(spark.createDataFrame(self._broken(), "source_label string, target_label string, mood string, named array<string>"))
        hits = gathered(apart(self.mapping()).apply(edges).join(broken.select("source_label", "target_label"), ["source_label", "target_label"]), cumulate=listed)
        first = hits.join(broken, ["source_label", "target_label"])
        progress(log, "pairs of layers that break a clause", first)
        said = {
            "subject": F.col("source_label"),
            "object": F.col("target_label"),
            "mood": F.when(F.col("mood") == NOT, "should not").otherwise("should"),
            "members": F.col("named"),
        }
        if not listed:
            return report.tallies(first, report.LAYER_DEPENDENCY, F.col("count"), **said)
        behind = F.transform("cumulated", lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target")))
        return report.violations(first, report.LAYER_DEPENDENCY, dependencies=behind, **said)

    def _broken(self) -> list[tuple[str, str, str, list[str]]]:
        """For each pair of layers the clause that an edge between them breaks: the first prohibition, else the first permission."""
        out = []
        for source, _ in self.layers:
            mine = sorted((c for c in self.clauses if c.layer == source), key=lambda c: c.mood != NOT)
            for target, _ in self.layers:
                hit = [c for c in mine if (target in c.named) == (c.mood == NOT)]
                if target != source and hit:
                    out.append((source, target, hit[0].mood, list(hit[0].named)))
        return out

    def __str__(self) -> str:
        said = ["project layers", *(f'layer "{n}" defined by {s}' for n, s in self.layers), *map(str, self.clauses)]
        return ", ".join(said) + (f" (rejected: {self.error})" if self.error else "")


def _undeclared(name: str):
    raise UserError(f"layer {name!r} is not declared")


def project_layers(edges, patterns=None) -> Layers:
    return Layers(source=edges, **({"patterns": patterns} if patterns else {}))


layers = project_layers


@dataclass(frozen=True)
class LayerDeclaration:
    layers: Layers
    name: str

    def defined_by(self, pattern: str) -> Layers:
        return self.layers._declare(self.name, lambda: self.layers.patterns.path(pattern))

    def defined_by_folder(self, pattern: str) -> Layers:
        return self.layers._declare(self.name, lambda: self.layers.patterns.folder(pattern))

    def __str__(self) -> str:
        return f'{self.layers}, layer "{self.name}"'


@dataclass(frozen=True)
class LayerClause:
    layers: Layers
    name: str

    def _clause(self, mood: str, named: tuple[str, ...]) -> Layers:
        def made() -> Layers:
            for n in named:
                if n not in dict(self.layers.layers):
                    _undeclared(n)
            if mood == NOT and not named:
                raise UserError("a prohibition needs a layer")
            return replace(self.layers, clauses=(*self.layers.clauses, Clause(self.name, mood, named)))

        return self.layers._try(mood, made)

    def may_only_depend_on_layers(self, *named: str) -> Layers:
        """No names seal the layer."""
        return self._clause(ONLY, named)

    def may_not_depend_on_layers(self, *named: str) -> Layers:
        return self._clause(NOT, named)

    def __str__(self) -> str:
        return f'{self.layers}, where layer "{self.name}"'
