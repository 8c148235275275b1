"""What the rule families share: a scope over edges, the first rejected error, and the sentence so far."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from weftgraph.errors import UserError
from weftgraph.functions.patterns import Filter, Patterns
from weftgraph.options import CheckOptions

#: edges, or something that gives them when a terminal asks (a project scan).
Source = DataFrame | Callable[[CheckOptions], DataFrame]


@dataclass(frozen=True)
class Stage:
    """Verbs never raise: the first error is kept, shown in the sentence and raised by the terminal."""

    source: Source | None = field(default=None, repr=False, compare=False)
    said: tuple[str, ...] = ()
    error: UserError | None = None
    patterns: Patterns = Patterns()

    def _edges(self, options: CheckOptions) -> DataFrame:
        if self.error is not None:
            raise self.error
        if self.source is None:
            raise UserError("there are no edges to check")
        return self.source if isinstance(self.source, DataFrame) else self.source(options)

    def _try(self, verb: str, make: Callable):
        """make() gives the next stage; a UserError becomes this stage's first error."""
        if self.error is not None:
            return make_failed(self, self.error)
        try:
            return make()
        except UserError as e:
            return make_failed(self, UserError(f"{verb}: {e}"))

    def __str__(self) -> str:
        return ", ".join(self.said) + (f" (rejected: {self.error})" if self.error else "")


def make_failed(stage, error: UserError):
    return replace(stage, error=error)


def clauses(filters: tuple[Filter, ...], word: str = ", ") -> str:
    return word.join(map(str, filters))


def options_or_default(options: CheckOptions | None) -> CheckOptions:
    return options or CheckOptions()
