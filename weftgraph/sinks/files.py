"""Writing one rendered document."""

from __future__ import annotations

import os
from collections.abc import Callable

from weftgraph.errors import TechnicalError, UserError


def write_text(path: str, render: Callable[[], str]) -> None:
    """Makes the folder and writes what render gives; an empty path fails before any work."""
    if not path.strip():
        raise UserError("an export needs a path")
    text = render()
    try:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(text)
    except OSError as e:
        raise TechnicalError(f"write {path}") from e
