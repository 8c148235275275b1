"""Options of a check, its log, and the empty-selection guard."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any, TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph import report
from weftgraph.errors import TechnicalError
from weftgraph.storage import Scratch

# Levels from silent to talkative.
LEVELS = ("error", "warn", "info", "debug")


@dataclass(frozen=True)
class LogOptions:
    """Where records go: a writer, a file, or a time-stamped file in a folder; level is the most talkative shown."""

    level: str = "info"
    writer: TextIO | None = None
    file: str = ""
    folder: str = ""
    moment: datetime | None = None

    def path(self) -> str:
        if self.file or not self.folder:
            return self.file
        return os.path.join(self.folder, (self.moment or datetime.now()).strftime("%Y-%m-%dT%H-%M-%S") + ".log")


class Logger:
    """Levelled text records; the first failure to write is kept and raised by close()."""

    def __init__(self, options: LogOptions | None = None):
        self.options = options or LogOptions()
        self._out: list[TextIO] = [self.options.writer] if self.options.writer else []
        self._file = None
        self._failure: Exception | None = None
        if path := self.options.path():
            try:
                os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
                self._file = open(path, "a", encoding="utf-8")  # noqa: SIM115
            except OSError as e:
                raise TechnicalError(f"open the log file {path}") from e
            self._out.append(self._file)

    def shows(self, level: str) -> bool:
        return LEVELS.index(level) <= LEVELS.index(self.options.level)

    def record(self, level: str, word: str, text: str) -> None:
        if not self.shows(level):
            return
        for out in self._out:
            try:
                out.write(f"{level.upper():<5} {word}: {text}\n")
            except OSError as e:
                self._failure = self._failure or e

    def start(self, rule: str) -> None:
        self.record("info", "start check", rule)

    def progress(self, step: str, count: int) -> None:
        self.record("debug", "progress", f"{step}: {count}")

    def metric(self, name: str, subject: str, value: float) -> None:
        self.record("debug", "metric", f"{name} of {subject}: {report.figure(value)}")

    def violation(self, text: str) -> None:
        self.record("warn", "violation", text)

    def end(self, rule: str, count: int) -> None:
        self.record("info", "end check", f"{rule}: {'no violations' if not count else report.plural(count, 'violation')}")

    def failed(self, rule: str, error: Exception) -> None:
        self.record("error", "end check", f"{rule}: failed: {error}")

    def close(self) -> None:
        if self._file:
            self._file.close()
        if self._failure:
            raise TechnicalError("write to the log") from self._failure


def console(level: str = "info") -> LogOptions:
    return LogOptions(level=level, writer=sys.stderr)


@dataclass(frozen=True)
class CheckOptions:
    allow_empty_tests: bool = False
    log: LogOptions | None = None
    clear_cache: bool = False
    #: Options of a source scan, for rules on a project rather than a DataFrame.
    source: Any = None


@dataclass(frozen=True)
class Population:
    """Something a rule selects: how it is called, what selected it, and the rows with the condition that picks them."""

    subject: str
    selectors: str
    rows: DataFrame
    where: Column = field(default_factory=lambda: F.lit(True))


def guard(populations: list[Population], options: CheckOptions) -> DataFrame | None:
    """Violations for the populations that nothing matched, None if there is no such. Populations of the same rows share a job."""
    if options.allow_empty_tests or not populations:
        return None
    groups: dict[int, list[Population]] = {}
    for p in populations:
        groups.setdefault(id(p.rows), []).append(p)
    matched: dict[int, int] = {}
    for group in groups.values():
        if len(group) == 1:
            matched[id(group[0])] = not group[0].rows.where(group[0].where).isEmpty()
            continue
        row = group[0].rows.agg(*[F.count_if(p.where).alias(f"n{i}") for i, p in enumerate(group)]).first()
        matched |= {id(p): row[i] for i, p in enumerate(group)}
    empty = [(p.subject, p.selectors) for p in populations if not matched[id(p)]]
    return report.empty_tests(populations[0].rows.sparkSession, empty) if empty else None


def progress(log: Logger | None, step: str, rows: DataFrame) -> None:
    """A record of how many rows a step came to; they are counted only for a log that shows it."""
    if log is not None and log.shows("debug"):
        log.progress(step, rows.count())


def logged(rule: Any, options: CheckOptions, check: Callable[[Logger | None], DataFrame]) -> DataFrame:
    """Runs check with start, progress, violation and end records if a log is asked for.

    Only then are the violations written once to the shared folder and passed by here, a partition at a time.
    """
    if options.log is None:
        return check(None)
    log, name = Logger(options.log), str(rule) or "a rule"
    try:
        log.start(name)
        try:
            found = check(log)
            found = Scratch(found.sparkSession).write(found)
            count = 0
            for v in found.toLocalIterator():
                count += 1
                log.violation(f"{v['kind']}: {report.sentence(v)}")
        except Exception as e:
            log.failed(name, e)
            raise
        log.end(name, count)
        return found
    finally:
        log.close()
