"""Escapes that more than one renderer needs."""

from __future__ import annotations

# Entities of HTML pages.
_HTML = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&#34;", "'": "&#39;"})


def html(text: str) -> str:
    return text.translate(_HTML)


def one_line(text: str) -> str:
    """Line feeds become blanks, carriage returns go."""
    return text.replace("\r", "").replace("\n", " ")
