"""The two classes of failure: a rule that was written wrongly, and an environment that let it down."""

from __future__ import annotations


class UserError(ValueError):
    """Misuse: a bad pattern, a missing name, a contradiction in a rule."""


class TechnicalError(RuntimeError):
    """A file that cannot be read or parsed, a project that cannot be found."""


class EmptySnapshotError(UserError):
    """A report that holds nothing, which its options do not allow."""
