"""Rules and reports on code-quality numbers."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph import report
from weftgraph.errors import EmptySnapshotError, UserError
from weftgraph.functions.patterns import SHOULD, SHOULD_NOT, Filter, Mood, Selection
from weftgraph.operators import metrics as M
from weftgraph.options import CheckOptions, Logger, Population, guard, logged, progress
from weftgraph.plans.base import Stage, options_or_default
from weftgraph.sinks.files import write_text
from weftgraph.sinks.metrics_page import ReportOptions, render_metrics_page

FILE, CLASS, COMPONENT = "file", "class", "component"


@dataclass(frozen=True)
class Metrics(Stage):
    """files and classes are DataFrames, or functions of the check's options that give them. links say the edges by number."""

    files: DataFrame | Callable | None = field(default=None, repr=False, compare=False)
    classes: DataFrame | Callable | None = field(default=None, repr=False, compare=False)
    scope: Selection = Selection()
    links: M.Links | None = field(default=None, repr=False, compare=False)

    def _selecting(self, verb: str, make: Callable[[], Filter]) -> Metrics:
        return self._try(verb, lambda: replace(self, scope=self.scope.add(make())))

    def with_name(self, pattern: str) -> Metrics:
        return self._selecting("with name", lambda: self.patterns.filename(pattern))

    def in_folder(self, pattern: str) -> Metrics:
        return self._selecting("in folder", lambda: self.patterns.folder(pattern))

    def in_path(self, pattern: str) -> Metrics:
        return self._selecting("in path", lambda: self.patterns.path(pattern))

    def in_file(self, path: str) -> Metrics:
        return self._selecting("in file", lambda: self.patterns.file(path))

    def for_classes_matching(self, pattern: str) -> Metrics:
        return self._selecting("for classes matching", lambda: self.patterns.classname(pattern))

    def _excluding(self, verb: str, patterns: tuple[str, ...], build: Callable[[str], Filter]) -> Metrics:
        return self._try(verb, lambda: replace(self, scope=self.scope.excepting(*map(build, patterns))))

    def except_(self, *patterns: str) -> Metrics:
        target = self.scope.filters[-1].target if self.scope else "path"
        return self._excluding("except", patterns, lambda p: self.patterns.filter(p, target))

    def except_name(self, *patterns: str) -> Metrics:
        return self._excluding("except name", patterns, self.patterns.filename)

    def except_folder(self, *patterns: str) -> Metrics:
        return self._excluding("except folder", patterns, self.patterns.folder)

    def except_path(self, *patterns: str) -> Metrics:
        return self._excluding("except path", patterns, self.patterns.path)

    def except_class(self, *patterns: str) -> Metrics:
        return self._excluding("except class", patterns, self.patterns.classname)

    def subjects(self, options: CheckOptions | None = None) -> M.Subjects:
        options = options_or_default(options)
        edges = self._edges(options)
        of = lambda x: x if isinstance(x, DataFrame) else x(options)
        files, classes = of(self.files), of(self.classes)
        split = lambda want: Selection(tuple(f for f in self.scope.filters if (f.target == "classname") == want))
        return M.select_subjects(edges, files, classes, split(False), split(True), self.links)

    def count(self) -> Group:
        return Group(self, "count", {**{k: (FILE, k) for k in M.FILE_COUNTS}, **{k: (CLASS, k) for k in M.CLASS_COUNTS}})

    def lcom(self) -> Group:
        return Group(self, "lcom", {k: (CLASS, k) for k in M.COHESION})

    def distance(self) -> DistanceGroup:
        return DistanceGroup(self, "distance", {k: (COMPONENT, k) for k in M.DISTANCE})

    def custom_metric(self, name: str, description: str, measure: Callable) -> Metric:
        """measure takes a dict of the class's columns and gives a column; one marked by row_measure() takes a row."""
        bad = None if name.strip() and description.strip() else UserError("a metric needs a name and a description")
        scope = replace(self, error=bad) if bad and not self.error else self
        return Metric(scope, "custom metric", name, CLASS, measure)

    def __str__(self) -> str:
        said = ", ".join(["metrics", *map(str, self.scope.filters)])
        return said + (f" (rejected: {self.error})" if self.error else "")


def metrics(edges, files: DataFrame, classes: DataFrame, patterns=None, links: M.Links | None = None) -> Metrics:
    return Metrics(source=edges, files=files, classes=classes, links=links, **({"patterns": patterns} if patterns else {}))


def row_measure(fn: Callable) -> Callable:
    fn.__weft_row__ = True
    return fn


def _values(subjects: M.Subjects, names: dict[str, tuple[str, str]], custom: Callable | None = None) -> DataFrame:
    """metric, subject, value of the metrics named; a pass over each population that they need."""
    parts = []
    of_files = {k: F.col(M.FILE_COUNTS[k]) for k, (p, _) in names.items() if p == FILE}
    if of_files:
        files = M.with_class_counts(subjects.files, subjects.classes) if {"classes", "interfaces"} & set(of_files) else subjects.files
        parts.append(M.long_form(files, "path", of_files))
    of_classes: dict[str, Column] = {}
    for k, (p, _) in names.items():
        if p == CLASS:
            if custom is not None:
                made = F.udf(custom, T.DoubleType(), useArrow=True)(F.struct(*subjects.classes.columns)) if getattr(custom, "__weft_row__", False) else custom({c: F.col(c) for c in subjects.classes.columns})
                of_classes[k] = made
            else:
                of_classes[k] = F.col(M.CLASS_COUNTS[k]) if k in M.CLASS_COUNTS else M.COHESION[k]()
    if of_classes:
        parts.append(M.long_form(subjects.classes, "identifier", of_classes))
    of_components = {k: M.DISTANCE[k]() for k, (p, _) in names.items() if p == COMPONENT}
    if of_components:
        parts.append(M.long_form(M.with_component_count(subjects.components), "label", of_components))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass(frozen=True)
class Group:
    metrics: Metrics
    name: str
    names: dict[str, tuple[str, str]]

    def metric(self, name: str) -> Metric:
        if name not in self.names:
            bad = self.metrics._try("metric", lambda: _bad(f"{self.name} has no metric {name!r}"))
            return Metric(bad, self.name, name, FILE)
        return Metric(self.metrics, self.name, name, self.names[name][0])

    def __getattr__(self, verb: str) -> Callable[[], Metric]:
        """lines_of_code(), method_count(), lcom96a() and so on."""
        if verb.startswith("__"):
            raise AttributeError(verb)
        key = verb.replace("_", "").lower()
        for name in self.names:
            if name.replace(" ", "").replace("*", "star").lower() == key:
                return lambda: self.metric(name)
        raise AttributeError(f"{self.name} has no metric {verb!r}")

    def measure(self, options: CheckOptions | None = None) -> DataFrame:
        """All metrics of the group over one resolution of the subjects."""
        return _values(self.metrics.subjects(options), self.names)

    def to_html(self, options: CheckOptions | None = None, page: ReportOptions | None = None) -> str:
        options = options_or_default(options)
        rows = self.measure(options).orderBy("metric", "subject").collect()  # a page for readers
        if not rows and not options.allow_empty_tests:
            raise EmptySnapshotError("there is nothing to report")
        data = {name: [] for name in self.names} if rows else {}
        for r in rows:
            data[r["metric"]].append((r["metric"], r["subject"], r["value"]))
        return render_metrics_page(data, page)

    def export_as_html(self, path: str, options: CheckOptions | None = None, page: ReportOptions | None = None) -> None:
        write_text(path, lambda: self.to_html(options, page))

    def __str__(self) -> str:
        return f"{self.metrics}, {self.name}"


@dataclass(frozen=True)
class DistanceGroup(Group):
    def should_not_be_in_zone_of_pain(self) -> ZoneRule:
        return ZoneRule(self.metrics, "zone of pain")

    def should_not_be_in_zone_of_uselessness(self) -> ZoneRule:
        return ZoneRule(self.metrics, "zone of uselessness")

    __getattr__ = Group.__getattr__


def _bad(text: str):
    raise UserError(text)


@dataclass(frozen=True)
class Metric:
    metrics: Metrics
    group: str
    name: str
    population: str
    custom: Callable | None = field(default=None, repr=False, compare=False)

    def measure(self, options: CheckOptions | None = None) -> DataFrame:
        """metric, subject, value; never guarded."""
        return self._measured(self.metrics.subjects(options))

    def _measured(self, subjects: M.Subjects) -> DataFrame:
        return _values(subjects, {self.name: (self.population, self.name)}, self.custom)

    def _be(self, comparison: str, limit: float, mood: Mood) -> ThresholdRule:
        metric = self
        if math.isnan(limit):
            metric = replace(self, metrics=self.metrics._try("limit", lambda: _bad("NaN is no limit")))
        return ThresholdRule(metric, mood, comparison, float(limit))

    def should_be_below(self, limit: float) -> ThresholdRule:
        return self._be("below", limit, SHOULD)

    def should_be_below_or_equal(self, limit: float) -> ThresholdRule:
        return self._be("below or equal", limit, SHOULD)

    def should_be_above(self, limit: float) -> ThresholdRule:
        return self._be("above", limit, SHOULD)

    def should_be_above_or_equal(self, limit: float) -> ThresholdRule:
        return self._be("above or equal", limit, SHOULD)

    def should_be(self, limit: float) -> ThresholdRule:
        return self._be("", limit, SHOULD)

    def should_satisfy(self, predicate: Callable, requirement: str) -> SatisfactionRule:
        """predicate takes dicts of the measurement's and its class's columns; one marked by row_measure() two rows."""
        return self._satisfy(predicate, requirement, SHOULD)

    def should_not_satisfy(self, predicate: Callable, requirement: str) -> SatisfactionRule:
        return self._satisfy(predicate, requirement, SHOULD_NOT)

    def _satisfy(self, predicate: Callable, requirement: str, mood: Mood) -> SatisfactionRule:
        metric = self
        if not requirement.strip():
            metric = replace(self, metrics=self.metrics._try("satisfy", lambda: _bad("a requirement needs a description")))
        return SatisfactionRule(metric, mood, predicate, requirement)

    def __str__(self) -> str:
        return f"{self.metrics}, {self.group}, {self.name}"


@dataclass(frozen=True)
class _MetricRule:
    metric: Metric
    mood: Mood

    def check(self, options: CheckOptions | None = None) -> DataFrame:
        options = options_or_default(options)
        return logged(self, options, lambda log: self._judge(options, log))

    def _guarded(self, options: CheckOptions) -> tuple[M.Subjects, DataFrame, DataFrame | None]:
        subjects = self.metric.metrics.subjects(options)
        measured = self.metric._measured(subjects)
        # A measurement for each subject: the check looks at these, so what is measured is not computed for it.
        rows = {FILE: subjects.files, CLASS: subjects.classes, COMPONENT: subjects.components}[self.metric.population]
        return subjects, measured, guard([Population("measurements", str(self.metric.metrics.scope), rows)], options)


@dataclass(frozen=True)
class ThresholdRule(_MetricRule):
    comparison: str
    limit: float

    def _judge(self, options: CheckOptions, log: Logger | None = None) -> DataFrame:
        _, measured, empty = self._guarded(options)
        if empty is not None:
            return empty
        progress(log, "measurements", measured)
        broken = measured.where(~self.mood.holds(M.holds(F.col("value"), self.comparison, self.limit)))
        return report.violations(
            broken, report.THRESHOLD, subject=F.col("subject"), metric=F.col("metric"), value=F.col("value"),
            comparison=self.comparison, limit=self.limit, mood=str(self.mood),
        )

    def __str__(self) -> str:
        than = f"{self.comparison} " if self.comparison else ""
        return f"{self.metric}, {self.mood} be {than}{report.figure(self.limit)}"


@dataclass(frozen=True)
class SatisfactionRule(_MetricRule):
    predicate: Callable = field(repr=False, compare=False)
    requirement: str = ""

    def _judge(self, options: CheckOptions, log: Logger | None = None) -> DataFrame:
        subjects, measured, empty = self._guarded(options)
        if empty is not None:
            return empty
        progress(log, "measurements", measured)
        classes = subjects.classes
        # of classes that share an identifier the first by path is meant
        first = classes.groupBy("identifier").agg(F.min_by(F.struct(*classes.columns), "path").alias("class"))
        both = measured.join(first, F.col("subject") == F.col("identifier"), "left")
        measurement = F.struct("metric", "subject", "value")
        if getattr(self.predicate, "__weft_row__", False):
            ok = F.udf(self.predicate, T.BooleanType(), useArrow=True)(measurement, F.col("class"))
        else:
            ok = self.predicate({c: F.col(c) for c in ("metric", "subject", "value")}, {c: F.col(f"class.{c}") for c in classes.columns})
        broken = both.where(~self.mood.holds(F.coalesce(ok, F.lit(False))))
        return report.violations(
            broken, report.SATISFACTION, subject=F.col("subject"), metric=F.col("metric"), value=F.col("value"),
            requirement=self.requirement, mood=str(self.mood),
        )

    def __str__(self) -> str:
        return f'{self.metric}, {self.mood} satisfy "{self.requirement}"'


@dataclass(frozen=True)
class ZoneRule:
    metrics: Metrics
    zone: str

    def check(self, options: CheckOptions | None = None) -> DataFrame:
        options = options_or_default(options)
        return logged(self, options, lambda log: self._judge(options, log))

    def _judge(self, options: CheckOptions, log: Logger | None = None) -> DataFrame:
        subjects = self.metrics.subjects(options)
        found = subjects.components
        # A folder with a selected file is a component: the check looks at files, so no dependencies are followed for it.
        if (empty := guard([Population("components", str(self.metrics.scope), subjects.files)], options)) is not None:
            return empty
        progress(log, "components", found)
        return report.violations(
            found.where(M.in_zone(self.zone)), report.ZONE, subject=F.col("label"), requirement=self.zone, mood="should not",
            abstractness=M.abstractness(), instability=M.instability(),
        )

    def __str__(self) -> str:
        return f"{self.metrics}, distance, should not be in {self.zone}"
