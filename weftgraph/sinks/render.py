"""Text formats of a snapshot; their keywords, column names and JSON keys are fixed values. A drawn report is for readers, so its nodes and edges come to the driver.

For reports beyond that, tables() gives the same rows as a DataFrame to be written by Spark.
"""

from __future__ import annotations

import json as _json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import kinds
from weftgraph.operators.snapshot import Snapshot
from weftgraph.report import plural
from weftgraph.sinks.text import html, one_line


@dataclass(frozen=True)
class Drawn:
    title: str
    nodes: list[tuple[str, bool]]
    edges: list[tuple[str, str, int, bool, int]]

    @property
    def headline(self) -> str:
        return self.title or "dependency graph"

    @property
    def summary(self) -> dict[str, int]:
        return {
            "nodes": len(self.nodes),
            "edges": len(self.edges),
            "dependencies": sum(e[2] for e in self.edges),
            "externalNodes": sum(n[1] for n in self.nodes),
            "externalEdges": sum(e[3] for e in self.edges),
        }

    @property
    def counts(self) -> str:
        s = self.summary
        said = [plural(s["nodes"], "node"), plural(s["edges"], "edge")]
        said.append(f"{s['dependencies']} {'dependency' if s['dependencies'] == 1 else 'dependencies'}")
        return ", ".join([*said, plural(s["externalNodes"], "external node"), plural(s["externalEdges"], "external edge")])

    def ids(self) -> dict[str, str]:
        names = dict.fromkeys([n for n, _ in self.nodes] + [x for e in self.edges for x in e[:2]])
        return {name: f"n{i}" for i, name in enumerate(names)}


def drawn(snapshot: Snapshot) -> Drawn:
    nodes = snapshot.nodes.orderBy("label").collect()
    edges = snapshot.edges.orderBy("source", "target").collect()
    return Drawn(
        snapshot.title,
        [(r["label"], r["external"]) for r in nodes],
        [(r["source"], r["target"], r["count"], r["external"], r["import_kinds"]) for r in edges],
    )


def tables(snapshot: Snapshot) -> DataFrame:
    """kind, source, target, dependencies, external, import_kinds: node rows and edge rows, ready for write.csv or write.json."""
    node = snapshot.nodes.select(
        F.lit("node").alias("kind"), F.col("label").alias("source"), F.lit(None).cast("string").alias("target"),
        F.lit(None).cast("bigint").alias("dependencies"), "external", F.lit(None).cast("string").alias("import_kinds"),
    )
    edge = snapshot.edges.select(
        F.lit("edge").alias("kind"), "source", "target", F.col("count").alias("dependencies"), "external",
        F.array_join(kinds.names(F.col("import_kinds")), ", ").alias("import_kinds"),
    )
    return node.unionByName(edge)


def _quoted(text: str, newline: str = "\\n") -> str:
    said = text.replace("\\", "\\\\").replace('"', '\\"')
    return '"' + said.replace("\r", "").replace("\n", newline) + '"'


def dot(d: Drawn) -> str:
    out = [f"digraph {_quoted(d.headline)} {{", "\trankdir=LR;", "\tlabelloc=t;"]
    out += [f"\tlabel={_quoted(d.headline + chr(10) + d.counts)};", "\tnode [shape=box];"]
    for label, external in d.nodes:
        out.append(f"\t{_quoted(label)} [label={_quoted(label)}{', style=dashed' if external else ''}];")
    for s, t, n, external, _ in d.edges:
        said = ([f'label="{n}"'] if n > 1 else []) + (["style=dashed"] if external else [])
        out.append(f"\t{_quoted(s)} -> {_quoted(t)}{' [' + ', '.join(said) + ']' if said else ''};")
    return "\n".join([*out, "}", ""])


def mermaid(d: Drawn) -> str:
    said = lambda x: one_line(x).replace("#", "#35;").replace('"', "#quot;")
    ids = d.ids()
    out = [f"%% {one_line(d.headline)}", f"%% {d.counts}", "flowchart LR"]
    out += [f'\t{ids[n]}(["{said(n)}"])' if external else f'\t{ids[n]}["{said(n)}"]' for n, external in d.nodes]
    out += [f"\t{ids[s]} -->{f'|{n}|' if n > 1 else ''} {ids[t]}" for s, t, n, _, _ in d.edges]
    return "\n".join([*out, ""])


def d2(d: Drawn) -> str:
    ids = d.ids()
    out = [f"# {one_line(d.headline)}", f"# {d.counts}", "direction: right"]
    out += [f"{ids[n]}: {{label: {_quoted(n, " ")}{'; style.stroke-dash: 3' if external else ''}}}" for n, external in d.nodes]
    out += [f"{ids[s]} -> {ids[t]}" + (f': "{n}"' if n > 1 else "") for s, t, n, _, _ in d.edges]
    return "\n".join([*out, ""])


def _cell(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(ch in text for ch in ',"\r\n') or text.startswith(" ") else text


def csv(d: Drawn) -> str:
    rows = [("kind", "source", "target", "dependencies", "external", "import kinds")]
    rows += [("node", n, "", "", str(x).lower(), "") for n, x in d.nodes]
    rows += [("edge", s, t, str(n), str(x).lower(), ", ".join(kinds.decode(k))) for s, t, n, x, k in d.edges]
    return "".join(",".join(map(_cell, r)) + "\n" for r in rows)


def json(d: Drawn) -> str:
    document = {
        "title": d.title,
        "summary": d.summary,
        "nodes": [{"label": n, "external": x} for n, x in d.nodes],
        "edges": [{"source": s, "target": t, "dependencies": n, "external": x, "importKinds": kinds.decode(k)} for s, t, n, x, k in d.edges],
    }
    said = _json.dumps(document, indent=2, ensure_ascii=False)
    # Characters that a page must not find in embedded JSON.
    for ch in "<>&  ":
        said = said.replace(ch, f"\\u{ord(ch):04x}")
    return said + "\n"


def page(d: Drawn) -> str:
    """One self-contained page: tables, and the DOT and Mermaid sources."""
    title = html(d.headline)
    out = ["<!DOCTYPE html>", '<html lang="en">', "<head>", '<meta charset="utf-8">', f"<title>{title}</title>"]
    out += ["<style>", "body { font-family: sans-serif; margin: 2rem; } td, th { padding: 0.25rem 0.5rem; text-align: left; }", "</style>"]
    out += ["</head>", "<body>", f"<h1>{title}</h1>", f'<p class="summary">{html(d.counts)}</p>', "<h2>nodes</h2>", "<table>"]
    out.append("<tr><th>label</th><th>external</th></tr>")
    out += [f"<tr><td>{html(n)}</td><td>{'external' if x else ''}</td></tr>" for n, x in d.nodes]
    out += ["</table>", "<h2>dependencies</h2>", "<table>"]
    out.append("<tr><th>source</th><th>target</th><th>dependencies</th><th>external</th><th>import kinds</th></tr>")
    for s, t, n, x, k in d.edges:
        out.append(f"<tr><td>{html(s)}</td><td>{html(t)}</td><td>{n}</td><td>{'external' if x else ''}</td><td>{html(', '.join(kinds.decode(k)))}</td></tr>")
    out += ["</table>", "<h2>DOT</h2>", f"<pre>{html(dot(d))}</pre>", "<h2>Mermaid</h2>", f'<pre class="mermaid">{html(mermaid(d))}</pre>']
    return "\n".join([*out, "</body>", "</html>", ""])
