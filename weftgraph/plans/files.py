"""Rules on files: names and places, dependencies on files and external modules, cycles, and own predicates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph import report
from weftgraph.errors import UserError
from weftgraph.functions.identifiers import separated
from weftgraph.functions.patterns import SHOULD, SHOULD_NOT, Filter, Mood, Selection
from weftgraph.operators import graph
from weftgraph.operators.components import project_circuits
from weftgraph.operators.projection import per_internal_edge, project_edges
from weftgraph.options import CheckOptions, Logger, Population, guard, logged, progress
from weftgraph.plans.base import Stage, options_or_default


def _node() -> Column:
    return F.col("node")


@dataclass(frozen=True)
class Files(Stage):
    scope: Selection = Selection()

    def _selecting(self, verb: str, make: Callable[[], Filter]) -> Files:
        return self._try(verb, lambda: replace(self, scope=self.scope.add(make())))

    def with_name(self, pattern: str) -> Files:
        return self._selecting("with name", lambda: self.patterns.filename(pattern))

    def in_folder(self, pattern: str) -> Files:
        return self._selecting("in folder", lambda: self.patterns.folder(pattern))

    def in_path(self, pattern: str) -> Files:
        return self._selecting("in path", lambda: self.patterns.path(pattern))

    def in_file(self, path: str) -> Files:
        return self._selecting("in file", lambda: self.patterns.file(path))

    def _excluding(self, verb: str, patterns: tuple[str, ...], build: Callable[[str], Filter]) -> Files:
        return self._try(verb, lambda: replace(self, scope=self.scope.excepting(*map(build, patterns))))

    def except_(self, *patterns: str) -> Files:
        """Takes what the pattern matches out of the last selector, on that selector's own target."""
        target = self.scope.filters[-1].target if self.scope else "path"
        return self._excluding("except", patterns, lambda p: self.patterns.filter(p, target))

    def except_name(self, *patterns: str) -> Files:
        return self._excluding("except name", patterns, self.patterns.filename)

    def except_folder(self, *patterns: str) -> Files:
        return self._excluding("except folder", patterns, self.patterns.folder)

    def except_path(self, *patterns: str) -> Files:
        return self._excluding("except path", patterns, self.patterns.path)

    def select_files(self, options: CheckOptions | None = None) -> DataFrame:
        """node: the files in scope."""
        edges = self._edges(options_or_default(options))
        return graph.own_nodes(edges).where(self.scope.column(_node()))

    def should(self) -> FilesShould:
        return FilesShould(self, SHOULD)

    def should_not(self) -> FilesShould:
        return FilesShould(self, SHOULD_NOT)

    def __str__(self) -> str:
        said = ", ".join(["project files", *map(str, self.scope.filters)])
        return said + (f" (rejected: {self.error})" if self.error else "")


def project_files(edges, patterns=None) -> Files:
    return Files(source=edges, **({"patterns": patterns} if patterns else {}))


files = project_files


@dataclass(frozen=True)
class FilesShould:
    files: Files
    mood: Mood

    def _failed(self, e: UserError) -> Files:
        return self.files if self.files.error else replace(self.files, error=e)

    def _naming(self, make: Callable[[], Filter]) -> NamingRule:
        try:
            return NamingRule(self.files, self.mood, make())
        except UserError as e:
            return NamingRule(self._failed(e), self.mood, None)

    def have_name(self, pattern: str) -> NamingRule:
        return self._naming(lambda: self.files.patterns.filename(pattern))

    def be_in_folder(self, pattern: str) -> NamingRule:
        return self._naming(lambda: self.files.patterns.folder(pattern))

    def be_in_path(self, pattern: str) -> NamingRule:
        return self._naming(lambda: self.files.patterns.path(pattern))

    def depend_on_files(self) -> DependencyRule:
        return DependencyRule(self.files, self.mood)

    def depend_on_external_modules(self) -> ExternalRule:
        return ExternalRule(self.files, self.mood)

    def have_no_cycles(self) -> CyclesRule:
        if self.mood.negated:
            return CyclesRule(self._failed(UserError("have no cycles: only `should` has this predicate")))
        return CyclesRule(self.files)

    def adhere_to(self, predicate: Callable, requirement: str, texts: DataFrame | None = None) -> AdherenceRule:
        """predicate takes a dict of columns and gives a boolean column; a function marked by udf_predicate() takes a row."""
        if not requirement.strip():
            return AdherenceRule(self._failed(UserError("adhere to: a requirement needs a description")), self.mood, predicate, requirement, texts)
        return AdherenceRule(self.files, self.mood, predicate, requirement, texts)

    def __str__(self) -> str:
        return f"{self.files}, {self.mood}"


@dataclass(frozen=True)
class _Rule:
    files: Files

    def check(self, options: CheckOptions | None = None) -> DataFrame:
        options = options_or_default(options)
        return logged(self, options, lambda log: self._judge(options, log))

    def _own(self, edges: DataFrame) -> DataFrame:
        return graph.own_nodes(edges)

    def _subjects(self, own: DataFrame) -> Population:
        return Population("files", ", ".join(map(str, self.files.scope.filters)), own, self.files.scope.column(_node()))

    def _judge(self, options: CheckOptions, log: Logger | None = None) -> DataFrame:
        raise NotImplementedError


@dataclass(frozen=True)
class NamingRule(_Rule):
    mood: Mood
    required: Filter | None

    def _judge(self, options: CheckOptions, log: Logger | None = None) -> DataFrame:
        own = self._own(self.files._edges(options))
        if (empty := guard([self._subjects(own)], options)) is not None:
            return empty
        progress(log, "selected files", own.where(self.files.scope.column(_node())))
        broken = own.where(self.files.scope.column(_node())).where(~self.mood.holds(self.required.column(_node())))
        return report.violations(broken, report.FILE_NAMING, subject=_node(), mood=str(self.mood), requirement=str(self.required))

    def __str__(self) -> str:
        return f"{self.files}, {self.mood}, {self.required}"


def _judge_dependencies(own: DataFrame, subject: Column, hits: DataFrame, mood: Mood, kind: str, requirement: str) -> DataFrame:
    """should: the subjects without any hit; should not: those with one, and what they hit. hits: source, target."""
    said = {"mood": str(mood), "requirement": requirement}
    if mood.negated:
        found = hits.groupBy("source").agg(F.array_sort(F.collect_set("target")).alias("t"))
        return report.violations(found, kind, subject=F.col("source"), members=F.col("t"), **said)
    missing = own.where(subject).join(hits.select(F.col("source").alias("node")), "node", "left_anti")
    return report.violations(missing, kind, subject=_node(), members=F.array().cast("array<string>"), **said)


@dataclass(frozen=True)
class DependencyRule(_Rule):
    mood: Mood
    objects: Selection = Selection()

    def _selecting(self, make: Callable[[], Selection]) -> DependencyRule:
        try:
            return replace(self, objects=make())
        except UserError as e:
            return self if self.files.error else replace(self, files=replace(self.files, error=e))

    def with_name(self, pattern: str) -> DependencyRule:
        return self._selecting(lambda: self.objects.add(self.files.patterns.filename(pattern)))

    def in_folder(self, pattern: str) -> DependencyRule:
        return self._selecting(lambda: self.objects.add(self.files.patterns.folder(pattern)))

    def in_path(self, pattern: str) -> DependencyRule:
        return self._selecting(lambda: self.objects.add(self.files.patterns.path(pattern)))

    def except_(self, *patterns: str) -> DependencyRule:
        target = self.objects.filters[-1].target if self.objects else "path"
        return self._selecting(lambda: self.objects.excepting(*[self.files.patterns.filter(p, target) for p in patterns]))

    def except_name(self, *patterns: str) -> DependencyRule:
        return self._selecting(lambda: self.objects.excepting(*map(self.files.patterns.filename, patterns)))

    def except_folder(self, *patterns: str) -> DependencyRule:
        return self._selecting(lambda: self.objects.excepting(*map(self.files.patterns.folder, patterns)))

    def except_path(self, *patterns: str) -> DependencyRule:
        return self._selecting(lambda: self.objects.excepting(*map(self.files.patterns.path, patterns)))

    def _judge(self, options: CheckOptions, log: Logger | None = None) -> DataFrame:
        edges = self.files._edges(options)
        own = self._own(edges)
        populations = [self._subjects(own)]
        if self.objects:  # an object of all files is never empty by mistake
            populations.append(Population("files to depend on", ", ".join(map(str, self.objects.filters)), own, self.objects.column(_node())))
        if (empty := guard(populations, options)) is not None:
            return empty
        # Both sets come from filters on identifiers, so they are conditions on the scan and not joins. A target that is
        # not external is a declared node.
        subject, target = self.files.scope.column(F.col("source")), self.objects.column(F.col("target"))
        hits = edges.where(~F.col("external") & (F.col("source") != F.col("target"))).where(subject & target)
        progress(log, "selected files", own.where(self.files.scope.column(_node())))
        progress(log, "dependencies on what the rule names", hits)
        requirement = ", ".join(map(str, self.objects.filters))
        return _judge_dependencies(own, self.files.scope.column(_node()), hits, self.mood, report.FILE_DEPENDENCY, requirement)

    def __str__(self) -> str:
        return ", ".join([str(self.files), str(self.mood), "depend on files", *map(str, self.objects.filters)])


@dataclass(frozen=True)
class ExternalRule(_Rule):
    mood: Mood
    modules: Selection = Selection(any_of=True)

    def _selecting(self, make: Callable[[], Selection]) -> ExternalRule:
        try:
            return replace(self, modules=make())
        except UserError as e:
            return self if self.files.error else replace(self, files=replace(self.files, error=e))

    def matching(self, pattern: str) -> ExternalRule:
        """Repeated, any of the patterns may match."""
        return self._selecting(lambda: self.modules.add(self.files.patterns.path(pattern)))

    def except_(self, *patterns: str) -> ExternalRule:
        return self._selecting(lambda: self.modules.excepting(*map(self.files.patterns.path, patterns)))

    def _judge(self, options: CheckOptions, log: Logger | None = None) -> DataFrame:
        edges = self.files._edges(options)
        own = self._own(edges)
        if (empty := guard([self._subjects(own)], options)) is not None:
            return empty
        hits = edges.where(F.col("external") & (F.col("source") != F.col("target")))
        # An external target stays as it was written, so its separators are turned for the match.
        hits = hits.where(self.files.scope.column(F.col("source")) & self.modules.column(separated(F.col("target"))))
        progress(log, "selected files", own.where(self.files.scope.column(_node())))
        progress(log, "dependencies on what the rule names", hits)
        return _judge_dependencies(own, self.files.scope.column(_node()), hits, self.mood, report.FILE_EXTERNAL, str(self.modules))

    def __str__(self) -> str:
        said = [str(self.files), str(self.mood), "depend on external modules"]
        return ", ".join(said + ([str(self.modules)] if self.modules else []))


def select_external_modules(edges: DataFrame, modules: Selection = Selection(any_of=True)) -> DataFrame:
    """module: distinct external targets that any selector matches."""
    return edges.where("external").where(modules.column(separated(F.col("target")))).select(F.col("target").alias("module")).distinct()


@dataclass(frozen=True)
class CyclesRule(_Rule):
    def _judge(self, options: CheckOptions, log: Logger | None = None) -> DataFrame:
        edges = self.files._edges(options)
        own = self._own(edges)
        if (empty := guard([self._subjects(own)], options)) is not None:
            return empty
        scope = self.files.scope
        inside = edges.where(scope.column(F.col("source")) & scope.column(F.col("target")))
        pairs = project_edges(inside, per_internal_edge())
        progress(log, "selected files", own.where(scope.column(_node())))
        progress(log, "dependencies between the selected files", pairs)
        found = project_circuits(pairs)
        return report.violations(found.circuits, report.FILE_CYCLE, subject=F.get("labels", F.lit(0)), mood="should", members=F.col("labels"))

    def __str__(self) -> str:
        return f"{self.files}, should, have no cycles"


def udf_predicate(fn: Callable) -> Callable:
    """Marks a plain Python function of one row; it runs in batches outside the JVM."""
    fn.__weft_row__ = True
    return fn


@dataclass(frozen=True)
class AdherenceRule(_Rule):
    mood: Mood
    predicate: Callable
    requirement: str
    texts: DataFrame | None = field(default=None, repr=False, compare=False)

    def _judge(self, options: CheckOptions, log: Logger | None = None) -> DataFrame:
        edges = self.files._edges(options)
        own = self._own(edges)
        if (empty := guard([self._subjects(own)], options)) is not None:
            return empty
        if self.texts is None:
            raise UserError("adhere to: the texts of the files are needed")
        progress(log, "selected files", own.where(self.files.scope.column(_node())))
        # Texts are read now, and only of the files in scope.
        chosen = self.texts.where(self.files.scope.column(F.col("path"))).join(own.where(self.files.scope.column(_node())), F.col("path") == _node(), "left_semi")
        if getattr(self.predicate, "__weft_row__", False):
            ok = F.udf(self.predicate, T.BooleanType(), useArrow=True)(F.struct(*chosen.columns))
        else:
            ok = self.predicate({c: F.col(c) for c in chosen.columns})
        broken = chosen.where(~self.mood.holds(F.coalesce(ok, F.lit(False))))
        return report.violations(broken, report.FILE_ADHERENCE, subject=F.col("path"), mood=str(self.mood), requirement=self.requirement)

    def __str__(self) -> str:
        return f'{self.files}, {self.mood}, adhere to "{self.requirement}"'
