"""Renderers and writers of reports."""
