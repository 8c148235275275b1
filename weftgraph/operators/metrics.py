"""Code-quality numbers as column arithmetic: counts, cohesion, abstractness, instability, distance, zones."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.identifiers import folder
from weftgraph.functions.patterns import Selection
from weftgraph.operators import graph
from weftgraph.operators.projection import labelled

D = "double"


@dataclass(frozen=True)
class Subjects:
    """The populations that metrics measure."""

    files: DataFrame
    classes: DataFrame
    components: DataFrame


@dataclass(frozen=True)
class Links:
    """The dependencies between two kinds of files by numbers, for a source that has them: no paths are shuffled for each edge.

    pairs (a, b, there, back) may repeat and are best dealt by a; there says that the file of a depends on that of b, back
    the reverse. ones (a, path) and others (b, path) say which file a number is; a pair without them is no dependency.
    """

    pairs: DataFrame
    ones: DataFrame
    others: DataFrame


def _folders_of_links(links: Links, chosen: DataFrame) -> DataFrame:
    """source_label, target_label of links between chosen files; the files are chosen before the links are joined."""
    place = lambda df, key, label: df.join(chosen, "path", "left_semi").select(key, folder(F.col("path")).alias(label))
    merged = [F.bool_or("there").alias("there"), F.bool_or("back").alias("back")]
    met = links.pairs.join(place(links.ones, "a", "one"), "a").join(place(links.others, "b", "other"), "b")
    met = met.groupBy("one", "other").agg(*merged)
    way = lambda when, s, t: F.when(F.col(when), F.struct(F.col(s).alias("source_label"), F.col(t).alias("target_label")))
    ways = F.array_compact(F.array(way("there", "one", "other"), way("back", "other", "one")))
    return met.select(F.inline(ways))


def _folders_of_edges(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """The same of edges between paths. Once its source is found chosen, an edge is told from others by its source's folder alone."""
    inner = edges.where(~F.col("external") & (F.col("source") != F.col("target"))).where(folder(F.col("source")) != folder(F.col("target")))
    of_chosen = inner.select("source", "target").join(chosen, F.col("source") == F.col("path"), "left_semi")
    seen = labelled(of_chosen, source_label=folder(F.col("source"))).select("source_label", "target").distinct()
    return seen.join(chosen, F.col("target") == F.col("path"), "left_semi").select("source_label", folder(F.col("target")).alias("target_label"))


def components(edges: DataFrame, files: DataFrame, classes: DataFrame, links: Links | None = None) -> DataFrame:
    """label, classes, interfaces, depends_on, depended_on_by: a row for each folder with a selected file.

    Class counts are over all classes of the selected files; dependencies over edges with both ends selected. With links
    these stand for the dependencies of edges.
    """
    f = files.select("path", F.col("directory").alias("label"))
    counts = f.join(classes.select("path", "interface"), "path", "left").groupBy("label").agg(
        F.count("interface").cast("int").alias("classes"), F.count_if("interface").cast("int").alias("interfaces")
    )
    chosen = f.select("path")
    pairs = _folders_of_links(links, chosen) if links else _folders_of_edges(edges, chosen)
    pairs = pairs.where("source_label <> '' and target_label <> '' and source_label <> target_label").distinct()
    # One row for each end of each pair, so both directions are gathered in one grouping.
    end = lambda label, to, of: F.struct(F.col(label).alias("folder"), to.cast("string").alias("to"), of.cast("string").alias("of"))
    ends = pairs.select(F.inline(F.array(end("source_label", F.col("target_label"), F.lit(None)), end("target_label", F.lit(None), F.col("source_label")))))
    met = ends.groupBy("folder").agg(F.array_sort(F.collect_list("to")).alias("depends_on"), F.array_sort(F.collect_list("of")).alias("depended_on_by"))
    none = F.array().cast("array<string>")
    return counts.join(met, F.col("label") == F.col("folder"), "left").select(
        "label", "classes", "interfaces", F.coalesce("depends_on", none).alias("depends_on"), F.coalesce("depended_on_by", none).alias("depended_on_by")
    )


def select_subjects(edges: DataFrame, files: DataFrame, classes: DataFrame, file_scope: Selection, class_scope: Selection, links: Links | None = None) -> Subjects:
    """With class selectors, files narrow to those that declare a selected class, and components follow the files."""
    own = graph.own_nodes(edges).where(file_scope.column(F.col("node"))).select(F.col("node").alias("path"))
    kept_files = files.where(file_scope.column(F.col("path"))).join(own, "path", "left_semi")
    of_files = classes.where(file_scope.column(F.col("path"))).join(own, "path", "left_semi")
    kept_classes = of_files
    if class_scope:
        kept_classes = of_files.where(class_scope.column(F.col("identifier")))
        kept_files = kept_files.join(kept_classes.select("path").distinct(), "path", "left_semi")
    return Subjects(kept_files, kept_classes, components(edges, kept_files, classes, links))


def with_class_counts(files: DataFrame, classes: DataFrame) -> DataFrame:
    """files with class_count and interface_count."""
    n = classes.groupBy("path").agg(F.count(F.lit(1)).alias("c"), F.count_if("interface").alias("i"))
    out = files.join(n, "path", "left")
    return out.select(*files.columns, F.coalesce("c", F.lit(0)).cast("int").alias("class_count"), F.coalesce("i", F.lit(0)).cast("int").alias("interface_count"))


# --- per file and per class: name -> column. Concrete classes are the classes column's own count.

FILE_COUNTS = {
    "lines of code": "lines_of_code",
    "statements": "statement_count",
    "imports": "import_count",
    "functions": "function_count",
    "classes": "class_count",
    "interfaces": "interface_count",
}
CLASS_COUNTS = {"method count": "method_count", "field count": "field_count"}


# --- cohesion; fields: array<struct<name, accessed_by>>, methods: array<struct<name, accessed_fields>>


def _accesses() -> Column:
    return F.aggregate("fields", F.lit(0), lambda n, f: n + F.size(f["accessed_by"])).cast(D)


def _measurable() -> Column:
    return (F.size("fields") > 0) & (F.size("methods") > 1)


def _pairs() -> tuple[Column, Column]:
    """(pairs of methods that share a field, pairs that do not), within the row."""
    m = F.size("methods").cast(D)

    def met(i: Column) -> Column:
        one = F.get("methods", i)["accessed_fields"]
        rest = F.slice("methods", i + 2, F.greatest(F.size("methods"), F.lit(1)))
        return F.size(F.filter(rest, lambda x: F.arrays_overlap(one, x["accessed_fields"])))

    spots = F.sequence(F.lit(0), F.greatest(F.size("methods") - 1, F.lit(0)))
    sharing = F.aggregate(F.transform(spots, met), F.lit(0), lambda a, b: a + b).cast(D)
    return sharing, m * (m - 1) / 2 - sharing


def lcom96a() -> Column:
    m, f = F.size("methods").cast(D), F.size("fields").cast(D)
    return F.when(_measurable(), (_accesses() / f - m) / (1 - m)).otherwise(0.0)


def lcom96b() -> Column:
    m, f = F.size("methods").cast(D), F.size("fields").cast(D)
    return F.when(_measurable(), 1 - _accesses() / (f * m)).otherwise(0.0)


def lcom1() -> Column:
    sharing, apart = _pairs()
    return F.when(_measurable(), F.greatest(F.lit(0.0), apart - sharing)).otherwise(0.0)


def lcom2() -> Column:
    """The share of fields a method does not touch, on average; the same number as 96b."""
    return lcom96b()


def lcom3() -> Column:
    return lcom96a()


def lcom4() -> Column:
    """Groups of methods linked by shared fields: a fold merges the groups that a method's fields meet, all within the row."""
    groups = F.aggregate(
        F.transform("methods", lambda x: x["accessed_fields"]),
        F.array().cast("array<array<string>>"),
        lambda acc, f: F.concat(
            F.filter(acc, lambda g: ~F.arrays_overlap(g, f)),
            F.array(F.array_distinct(F.concat(f, F.flatten(F.filter(acc, lambda g: F.arrays_overlap(g, f)))))),
        ),
    )
    n = F.size(groups).cast(D)
    return F.when(F.size("methods") == 0, 0.0).when(~_measurable(), 1.0).otherwise(n)


def lcom5() -> Column:
    m, f = F.size("methods").cast(D), F.size("fields").cast(D)
    return F.when(_measurable() & (F.size("fields") > 1), (f - _accesses() / m) / (f - 1)).otherwise(0.0)


def lcom_star() -> Column:
    sharing, apart = _pairs()
    return F.when(_measurable() & (sharing + apart > 0), apart / (sharing + apart)).otherwise(0.0)


COHESION = {
    "LCOM96a": lcom96a,
    "LCOM96b": lcom96b,
    "LCOM1": lcom1,
    "LCOM2": lcom2,
    "LCOM3": lcom3,
    "LCOM4": lcom4,
    "LCOM5": lcom5,
    "LCOM*": lcom_star,
}

# --- components


def abstractness() -> Column:
    return F.when(F.col("classes") == 0, 0.0).otherwise(F.col("interfaces").cast(D) / F.col("classes"))


def instability() -> Column:
    out, back = F.size("depends_on").cast(D), F.size("depended_on_by").cast(D)
    return F.when(out + back == 0, 0.0).otherwise(out / (out + back))


def normalized_distance() -> Column:
    return F.abs(abstractness() + instability() - 1)


def distance_from_main_sequence() -> Column:
    return normalized_distance() / F.lit(math.sqrt(2))


def coupling_factor() -> Column:
    """Needs the column n, how many components there are."""
    both = (F.size("depends_on") + F.size("depended_on_by")).cast(D)
    return F.when(F.col("n") < 2, 0.0).otherwise(both / (2 * (F.col("n") - 1)).cast(D))


def with_component_count(components: DataFrame) -> DataFrame:
    """Each row with n: a one-row aggregate joined on, never a window over all rows."""
    return components.join(F.broadcast(components.agg(F.count(F.lit(1)).alias("n"))), F.lit(True), "inner")


DISTANCE = {
    "abstractness": abstractness,
    "instability": instability,
    "distance from the main sequence": distance_from_main_sequence,
    "normalized distance": normalized_distance,
    "coupling factor": coupling_factor,
}

ZONE_RADIUS = 0.3
#: Corner of each zone as (abstractness, instability).
ZONES = {"zone of pain": (0.0, 0.0), "zone of uselessness": (1.0, 1.0)}


def in_zone(zone: str) -> Column:
    a, i = ZONES[zone]
    return F.hypot(abstractness() - a, instability() - i) <= ZONE_RADIUS


# --- thresholds; a NaN satisfies none


COMPARISONS = {
    "below": lambda v, x: v < x,
    "below or equal": lambda v, x: v <= x,
    "above": lambda v, x: v > x,
    "above or equal": lambda v, x: v >= x,
    "": lambda v, x: v == x,
}


def holds(value: Column, comparison: str, limit: float) -> Column:
    return ~F.isnan(value) & COMPARISONS[comparison](value, F.lit(float(limit)))


def long_form(df: DataFrame, subject: str, values: dict[str, Column]) -> DataFrame:
    """metric, subject, value: all metrics from one pass over df."""
    rows = [F.struct(F.lit(k).alias("metric"), F.col(subject).alias("subject"), v.cast(D).alias("value")) for k, v in values.items()]
    return df.select(F.inline(F.array(*rows)))


def spread(measurements: DataFrame, heading: str = "metric") -> DataFrame:
    v = F.col("value")
    return measurements.groupBy(heading).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("average"))
