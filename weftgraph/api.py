"""The names that most users need, in one place."""

from weftgraph.errors import EmptySnapshotError, TechnicalError, UserError
from weftgraph.functions.patterns import GLOB, LITERAL, REGEX, Filter, Pattern, Patterns, Selection
from weftgraph.operators.components import cyclic_components, project_circuits, strong_components
from weftgraph.operators.graph import add, canonical, create_edges, dependencies, find, nodes, own_nodes, self_edges
from weftgraph.operators.projection import Mapping, identity, per_edge, per_external_edge, per_internal_edge, project_all, project_edges, project_nodes
from weftgraph.operators.reach import reach
from weftgraph.options import CheckOptions, LogOptions, Logger, console
from weftgraph.plans.files import project_files, select_external_modules, udf_predicate
from weftgraph.plans.graph import project_graph
from weftgraph.plans.layers import project_layers
from weftgraph.plans.metrics import metrics, row_measure
from weftgraph.plans.slices import project_slices
from weftgraph.report import COLOURS, Checkable, MessageOptions, Palette, assert_all_pass, assert_passes, result, sentence
from weftgraph.sinks.metrics_page import MetricsExporter, ReportOptions
from weftgraph.sources.diagram import Diagram, parse_diagram, read_diagram, render_plantuml
from weftgraph.sources.goproject import GoProject, SourceOptions, cached_graph, clear_graph_cache, extract_graph, locate_project

__all__ = [name for name in dir() if not name.startswith("_")]
