"""Slices: groups of files named by a part of their path, and rules on how the groups depend on each other."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph import report
from weftgraph.errors import EmptySnapshotError, UserError
from weftgraph.functions import identifiers
from weftgraph.functions.patterns import GLOB, REGEX, SHOULD, SHOULD_NOT, Mood, Pattern, compile_pattern
from weftgraph.operators import graph
from weftgraph.operators.projection import Mapping, apart, gathered, project_all, project_edges
from weftgraph.options import CheckOptions, Logger, Population, guard, logged, progress
from weftgraph.plans.base import Stage, make_failed, options_or_default
from weftgraph.sinks.files import write_text
from weftgraph.sources.diagram import Diagram, parse_diagram, read_diagram, render_plantuml


def suffix_slice(identifier: Column) -> Column:
    """The stem's part after its last underscore, the whole stem without one; null if that is empty."""
    return F.nullif(F.element_at(F.split(identifiers.stem(identifier), "_"), -1), F.lit(""))


@dataclass(frozen=True)
class Slicing:
    said: str
    pattern: Pattern | None = None

    def label(self, identifier: Column) -> Column:
        return suffix_slice(identifier) if self.pattern is None else self.pattern.capture(identifier)

    def mapping(self) -> Mapping:
        """External edges have no slice; self-edges keep one, so members of a slice can be listed."""
        return Mapping(self.label(F.col("source")), self.label(F.col("target")), ~F.col("external"))


@dataclass(frozen=True)
class Slices(Stage):
    slicing: Slicing | None = None

    def _define(self, verb: str, make) -> Slices:
        def defined() -> Slices:
            if self.slicing is not None:
                raise UserError("the slices are defined already")
            return replace(self, slicing=make())

        return self._try(verb, defined)

    def defined_by(self, pattern: str) -> Slices:
        """A glob with one group in parentheses, whose text names the slice."""
        made = lambda: compile_pattern(pattern, GLOB, self.patterns.ignore_case, capture=True)
        return self._define("defined by", lambda: Slicing(f'path matches "{pattern}"', made()))

    def defined_by_regex(self, expression: str) -> Slices:
        made = lambda: compile_pattern(expression, REGEX, self.patterns.ignore_case, capture=True)
        return self._define("defined by regex", lambda: Slicing(f'path matches "{expression}"', made()))

    def defined_by_file_suffix(self) -> Slices:
        return self._define("defined by file suffix", lambda: Slicing("defined by file suffix"))

    def _ready(self) -> Slices:
        if self.error or self.slicing is not None:
            return self
        return make_failed(self, UserError("the slices need a definition"))

    def _members(self, edges: DataFrame) -> DataFrame:
        own = graph.own_nodes(edges).withColumn("slice", self.slicing.label(F.col("node")))
        return own.where("slice is not null")

    def select_slice_files(self, options: CheckOptions | None = None) -> DataFrame:
        """slice, files (sorted)."""
        ready = self._ready()
        edges = ready._edges(options_or_default(options))
        return ready._members(edges).groupBy("slice").agg(F.array_sort(F.collect_list("node")).alias("files"))

    def dependencies(self, options: CheckOptions | None = None) -> DataFrame:
        ready = self._ready()
        return project_edges(ready._edges(options_or_default(options)), ready.slicing.mapping())

    def should(self) -> SlicesShould:
        return SlicesShould(self._ready(), SHOULD)

    def should_not(self) -> SlicesShould:
        return SlicesShould(self._ready(), SHOULD_NOT)

    def to_plantuml(self, options: CheckOptions | None = None) -> str:
        options, ready = options_or_default(options), self._ready()
        edges = ready._edges(options)
        pairs = project_all(edges, ready.slicing.mapping()).select("source_label", "target_label").collect()
        names = sorted({x for p in pairs for x in p})  # as many as there are slices
        if not names and not options.allow_empty_tests:
            raise EmptySnapshotError("there are no slices to draw")
        return render_plantuml(names, sorted((a, b) for a, b in pairs if a != b))

    def export_as_plantuml(self, path: str, options: CheckOptions | None = None) -> None:
        write_text(path, lambda: self.to_plantuml(options))

    def __str__(self) -> str:
        said = ", ".join(["project slices", *([self.slicing.said] if self.slicing else [])])
        return said + (f" (rejected: {self.error})" if self.error else "")


def project_slices(edges, patterns=None) -> Slices:
    return Slices(source=edges, **({"patterns": patterns} if patterns else {}))


@dataclass(frozen=True)
class SlicesShould:
    slices: Slices
    mood: Mood

    def contain_dependency(self, source: str, target: str) -> SliceDependencyRule:
        slices = self.slices
        if not source.strip() or not target.strip():
            slices = slices._try("contain dependency", lambda: _bad("both slices need a name"))
        elif source == target:
            slices = slices._try("contain dependency", lambda: _bad("a slice always reaches itself"))
        return SliceDependencyRule(slices, self.mood, source, target)

    def adhere_to_diagram(self, text: str) -> DiagramRule:
        slices, diagram = self._positive("adhere to diagram"), None
        try:
            diagram = parse_diagram(text)
        except UserError as e:
            slices = slices if slices.error else make_failed(slices, e)
        return DiagramRule(slices, diagram)

    def adhere_to_diagram_in_file(self, path: str) -> DiagramRule:
        """The file is read when the rule is checked."""
        return DiagramRule(self._positive("adhere to diagram"), None, path)

    def _positive(self, verb: str) -> Slices:
        return self.slices._try(verb, lambda: _bad("only `should` has this predicate")) if self.mood.negated else self.slices

    def __str__(self) -> str:
        return f"{self.slices}, {self.mood}"


def _bad(text: str):
    raise UserError(text)


def _behind() -> Column:
    """The raw edges behind a pair."""
    return F.transform("cumulated", lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target")))


@dataclass(frozen=True)
class SliceDependencyRule:
    slices: Slices
    mood: Mood
    source: str
    target: str

    def check(self, options: CheckOptions | None = None) -> DataFrame:
        options = options_or_default(options)
        return logged(self, options, lambda log: self._judge(options, log))

    def tally(self, options: CheckOptions | None = None) -> DataFrame:
        """check() with the number of edges behind a pair, n, in place of their list: no row holds a pair's edges."""
        return self._judge(options_or_default(options), listed=False)

    def _judge(self, options: CheckOptions, log: Logger | None = None, listed: bool = True) -> DataFrame:
        edges = self.slices._edges(options)
        members = self.slices._members(edges)
        said = self.slices.slicing.said
        if (empty := guard([Population("slices", said, members)], options)) is not None:
            return empty if listed else report.tallied(empty)
        named = [Population(f'files in slice "{n}"', said, members, F.col("slice") == n) for n in (self.source, self.target)]
        if (empty := guard(named, options)) is not None:
            return empty if listed else report.tallied(empty)
        progress(log, "slices found", members.select("slice").distinct())
        mapping = self.slices.slicing.mapping()
        pair = (mapping.source == self.source) & (mapping.target == self.target)
        found = project_edges(edges, replace(mapping, where=mapping.where & pair), cumulate=listed)
        # one row whether the pair is there or not
        one = edges.sparkSession.range(1).join(found, F.lit(True), "left").where(~self.mood.holds(F.col("source_label").isNotNull()))
        said = {"subject": self.source, "object": self.target, "mood": str(self.mood)}
        if not listed:
            return report.tallies(one, report.SLICE_DEPENDENCY, F.col("count"), **said)
        return report.violations(one, report.SLICE_DEPENDENCY, dependencies=_behind(), **said)

    def __str__(self) -> str:
        return f'{self.slices}, {self.mood}, contain dependency "{self.source}" -> "{self.target}"' if not self.slices.error else str(self.slices)


@dataclass(frozen=True)
class DiagramRule:
    slices: Slices
    diagram: Diagram | None
    path: str = ""
    skip_orphans: bool = False
    skip_absent: bool = False

    def ignoring_orphan_slices(self) -> DiagramRule:
        """Undeclared slices without any dependency are no finding."""
        return replace(self, skip_orphans=True)

    def ignoring_absent_components(self) -> DiagramRule:
        """Components without a slice are no finding."""
        return replace(self, skip_absent=True)

    def check(self, options: CheckOptions | None = None) -> DataFrame:
        options = options_or_default(options)
        return logged(self, options, lambda log: self._judge(options, log))

    def tally(self, options: CheckOptions | None = None) -> DataFrame:
        """check() with the number of edges behind a pair, n, in place of their list: no row holds a pair's edges."""
        return self._judge(options_or_default(options), listed=False)

    def _judge(self, options: CheckOptions, log: Logger | None = None, listed: bool = True) -> DataFrame:
        edges = self.slices._edges(options)
        diagram = self.diagram or read_diagram(self.path)
        members = self.slices._members(edges)
        if (empty := guard([Population("slices", self.slices.slicing.said, members)], options)) is not None:
            return empty if listed else report.tallied(empty)
        spark = edges.sparkSession
        declared = F.broadcast(spark.createDataFrame([(c,) for c in diagram.components], "name string"))  # what a diagram draws
        drawn = F.broadcast(spark.createDataFrame(list(diagram.dependencies), "source_label string, target_label string"))
        progress(log, "components that the diagram declares", declared)
        between = apart(self.slices.slicing.mapping()).apply(edges)
        ends = declared.select(F.col("name").alias("source_label")), declared.select(F.col("name").alias("target_label"))
        undrawn = between.join(ends[0], "source_label", "left_semi").join(ends[1], "target_label", "left_semi")
        undrawn = gathered(undrawn.join(drawn, ["source_label", "target_label"], "left_anti"), cumulate=listed)
        said = {"subject": F.col("source_label"), "object": F.col("target_label"), "mood": "should", "finding": report.UNDRAWN}
        if listed:
            found, rows = report.violations(undrawn, report.SLICE_DIAGRAM, dependencies=_behind(), **said), report.violations
        else:
            found, rows = report.tallies(undrawn, report.SLICE_DIAGRAM, F.col("count"), **said), lambda df, kind, **more: report.tallies(df, kind, F.lit(None), **more)
        present = members.select("slice").distinct()
        extra = present.join(declared, F.col("slice") == F.col("name"), "left_anti")
        if self.skip_orphans:
            tied = between.select(F.explode(F.array("source_label", "target_label")).alias("tied")).distinct()
            extra = extra.join(tied, F.col("slice") == F.col("tied"), "left_semi")
        found = found.unionByName(rows(extra, report.SLICE_DIAGRAM, subject=F.col("slice"), mood="should", finding=report.UNDECLARED))
        if not self.skip_absent:
            gone = spark.createDataFrame([(c,) for c in diagram.components], "name string").join(present, F.col("name") == F.col("slice"), "left_anti")
            found = found.unionByName(rows(gone, report.SLICE_DIAGRAM, subject=F.col("name"), mood="should", finding=report.ABSENT))
        return found

    def __str__(self) -> str:
        said = [str(self.slices), "should", "adhere to diagram" + (f' in "{self.path}"' if self.path else "")]
        said += ["ignoring orphan slices"] * self.skip_orphans + ["ignoring absent components"] * self.skip_absent
        return ", ".join(said)
