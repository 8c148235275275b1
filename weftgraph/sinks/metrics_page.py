"""A page of measurements, by group."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from weftgraph.report import figure, plural
from weftgraph.sinks.files import write_text
from weftgraph.sinks.text import html

STYLE = (
    "body { font-family: sans-serif; margin: 2rem; } table { border-collapse: collapse; } "
    "th, td { border: 1px solid #ccc; padding: 0.25rem 0.5rem; text-align: left; } td.value { text-align: right; }"
)


@dataclass(frozen=True)
class ReportOptions:
    title: str = ""
    timestamp: datetime | None = None
    #: Appended after the page's own style, as it is.
    css: str = ""


def render_metrics_page(data: dict[str, list[tuple[str, str, float]]], options: ReportOptions | None = None) -> str:
    """data: heading -> (metric, subject, value) in the order in which they were measured; headings are sorted."""
    options = options or ReportOptions()
    title = html(options.title or "metrics report")
    total = sum(map(len, data.values()))
    out = ["<!DOCTYPE html>", '<html lang="en">', "<head>", '<meta charset="utf-8">', f"<title>{title}</title>"]
    out += ["<style>", STYLE, *([options.css] if options.css else []), "</style>", "</head>", "<body>", f"<h1>{title}</h1>"]
    out.append(f'<p class="summary">{plural(total, "measurement")} in {plural(len(data), "group")}</p>')
    if options.timestamp:
        at = options.timestamp.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        out.append(f'<p class="taken">taken {at}</p>')
    for heading in sorted(data):
        rows = data[heading]
        out.append(f"<h2>{html(heading)}</h2>")
        if rows:
            v = [r[2] for r in rows]
            out.append(
                f'<p class="spread">{plural(len(v), "measurement")}, min {figure(min(v))}, max {figure(max(v))}, average {figure(sum(v) / len(v))}</p>'
            )
        out += ["<table>", "<tr><th>subject</th><th>metric</th><th>value</th></tr>"]
        out += [f'<tr><td class="subject">{html(s)}</td><td>{html(m)}</td><td class="value">{figure(x)}</td></tr>' for m, s, x in rows]
        out.append("</table>")
    return "\n".join([*out, "</body>", "</html>", ""])


@dataclass(frozen=True)
class MetricsExporter:
    """Writes measurements that the caller has grouped."""

    options: ReportOptions | None = None

    def to_html(self, data: dict[str, list[tuple[str, str, float]]]) -> str:
        return render_metrics_page(data, self.options)

    def export_as_html(self, path: str, data: dict[str, list[tuple[str, str, float]]]) -> None:
        write_text(path, lambda: self.to_html(data))
