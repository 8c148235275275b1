import random
import re

import pytest
from pyspark.sql import functions as F

from weftgraph.errors import UserError
from weftgraph.functions import identifiers, kinds
from weftgraph.functions.patterns import REGEX, SHOULD, SHOULD_NOT, Patterns, Selection, compile_pattern

def _tokens(glob):
    """A glob's parts: what `**` means hangs on the slashes round it."""
    glob = re.sub(r"[/\\]+", "/", glob.strip())
    glob = glob[:-1] if len(glob) > 1 and glob.endswith("/") else glob
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("/**/", i):
            out.append("between")
            i += 4
        elif glob[i:] == "/**":
            out.append("below")
            i += 3
        elif i == 0 and glob.startswith("**/"):
            out.append("above")
            i += 3
        elif glob.startswith("**", i):
            out.append("any")
            i += 2
        elif glob[i] == "[":
            end = glob.index("]", i + 2 + (glob[i + 1] in "!^"))
            out.append(("class", glob[i + 1 : end]))
            i = end + 1
        else:
            out.append({"*": "run", "?": "one"}.get(glob[i], ("is", glob[i])))
            i += 1
    return out


def says(glob, path):
    """Whether the glob matches the whole path, by trying every way."""
    tokens = _tokens(glob)

    def at(k, i):
        if k == len(tokens):
            return i == len(path)
        rest, t = path[i:], tokens[k]
        ends = range(len(rest) + 1)
        if t == "any":
            return any(at(k + 1, i + n) for n in ends)
        if t == "run":
            return any(at(k + 1, i + n) for n in ends if "/" not in rest[:n])
        if t == "one":
            return rest[:1] not in ("", "/") and at(k + 1, i + 1)
        if t == "above":
            return any(at(k + 1, i + n) for n in ends if n == 0 or rest[n - 1] == "/")
        if t == "between":
            return rest[:1] == "/" and any(at(k + 1, i + n) for n in ends if n == 1 or (n > 1 and rest[n - 1] == "/"))
        if t == "below":
            return rest == "" or rest[0] == "/"
        kind, what = t
        if not rest:
            return False
        if kind == "is":
            return rest[0] == what and at(k + 1, i + 1)
        negated, listed = what[0] in "!^", what[what[0] in "!^" :]
        spans = re.findall(r"(.)-(.)", listed)
        inside = rest[0] in re.sub(r".-.", "", listed) or any(x <= rest[0] <= y for x, y in spans)
        return inside != negated and at(k + 1, i + 1)  # a class may be a slash

    return at(0, 0)


def matched(spark, predicate, values):
    df = spark.createDataFrame([(v,) for v in values], "id string")
    return {r["id"] for r in df.where(predicate(F.col("id"))).collect()}


def test_globs_against_brute_force(spark):
    rng = random.Random(11)
    pieces = ["p", "q", "p", "/", "/", "*", "**", "/**/", "?", "[pq]", "[!p]", "[^q]", "[o-p]", ".", "+", "q(p)", "\\", "$", "|"]
    globs = {"**", "p/**", "**/p", "**/q/**", "p/**/q", "p**q", "p//q/", "p\\**", "[]p]q", "[p&&q].", "p[q^[]"}
    while len(globs) < 130:
        globs.add("".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))) + rng.choice(["", "", "/**"]))
    globs = sorted(g for g in globs if g.strip("/ \\") or "*" in g)
    paths = {"p", "q", "p/q", "p.q", "pq/q", "]q", "&.", "p^", "p["}
    while len(paths) < 300:
        said = "".join(rng.choice("ppqq//.+$|(") for _ in range(rng.randint(1, 8)))
        paths.add(re.sub("/+", "/", said).strip("/") or "p")
    df = spark.createDataFrame([(x,) for x in sorted(paths)], "id string")
    rows = df.select("id", *[compile_pattern(g).matches(F.col("id")).alias(f"g{k}") for k, g in enumerate(globs)]).collect()
    wrong = [(g, r["id"], r[f"g{k}"]) for r in rows for k, g in enumerate(globs) if r[f"g{k}"] != says(g, r["id"])]
    assert not wrong, wrong[:5]
    assert sum(r[f"g{k}"] for r in rows for k in range(len(globs))) > 500


def test_regex_literal_case_and_anchors(spark):
    assert matched(spark, compile_pattern("a|b.", REGEX).matches, ["a", "b\r", "b\n", "a\n", "ab"]) == {"a", "b\r"}
    assert matched(spark, compile_pattern("É*", ignore_case=True).matches, ["éa", "Éa", "ea"]) == {"éa", "Éa"}
    assert matched(spark, Patterns().file("a/*.go").column, ["a/*.go", "a/b.go"]) == {"a/*.go"}
    for bad in ("", " ", "a[b"):
        with pytest.raises(UserError):
            compile_pattern(bad)
    with pytest.raises(UserError):
        compile_pattern("(", REGEX)


def test_captures(spark):
    p = compile_pattern("stock/(**)/**", capture=True)
    df = spark.createDataFrame([("stock/wool/red/ball",), ("stock//ball",), ("till/ball",)], "id string")
    assert [r[0] for r in df.select(p.capture(F.col("id"))).collect()] == ["wool", None, None]
    for bad in ("a/*", "(*)/(*)"):
        with pytest.raises(UserError):
            compile_pattern(bad, capture=True)


def test_filters(spark):
    p, ids = Patterns(), ["a/b/C.go", "C.go", "a/b/x.Handler", "", "a/b/gen/y.go"]
    assert matched(spark, p.filename("C.go").column, ids) == {"a/b/C.go", "C.go"}
    assert matched(spark, p.folder(".").column, ids) == {"C.go"}
    assert matched(spark, p.classname("Handler").column, ids) == {"a/b/x.Handler"}
    f = p.folder("a/**").excluding(p.folder("**/gen"), p.filename("*.go"))
    assert matched(spark, f.column, ids) == {"a/b/x.Handler"}
    assert matched(spark, f.not_matching().column, ids) == set()
    assert matched(spark, p.path("a/**").not_matching().column, ids) == {"C.go"}
    assert str(f) == 'path without filename matches "a/**", excluding "**/gen", excluding filename matches "*.go"'
    assert str(p.path("x").excluding(p.path("y"), p.path("z")).not_matching()) == 'path does not match "x", excluding "y", "z"'


def test_selections(spark):
    p, ids = Patterns(), ["a/x.go", "a/y.go", "b/x.go"]
    s = Selection().add(p.folder("a")).add(p.filename("x*"))
    assert matched(spark, s.column, ids) == {"a/x.go"}
    assert matched(spark, Selection(s.filters, any_of=True).column, ids) == set(ids)
    assert matched(spark, Selection().column, ids) == set(ids)
    for bad in (lambda: Selection().excepting(p.path("a")), lambda: s.excepting(), lambda: s.excepting(p.classname("A"))):
        with pytest.raises(UserError):
            bad()


def test_moods(spark):
    df = spark.createDataFrame([(True,), (False,)], "s boolean")
    row = lambda m: [r[0] for r in df.select(m.holds(F.col("s"))).collect()]
    assert row(SHOULD) == [True, False] and row(SHOULD_NOT) == [False, True]


def test_identifiers(spark):
    cases = {"/../x": "/x", "/a/../../b": "/b", "a/../..": "..", "../../a/..": "../..", "a/b/../../c/./d/": "c/d", "a/..": ".", " a\\b/../c.go ": "a/c.go", "./a//b/": "a/b", "": "", "  ": "", "/": "/", "//x": "/x", "../a": "../a", "a/.": "a", ".": ".", "é/b.go": "é/b.go"}
    df = spark.createDataFrame([(k,) for k in cases], "id string")
    got = {r[0]: r[1] for r in df.select("id", identifiers.normalized(F.col("id"))).collect()}
    assert got == cases and {k: identifiers.normalize(k) for k in cases} == cases
    assert identifiers.relative("/p", "/p/a/b.go") == "a/b.go" and identifiers.relative("/p", "/q/x") is None
    parts = spark.createDataFrame([("a/b/c.tar.gz",), ("main",)], "id string").select(
        *[f(F.col("id")) for f in (identifiers.base, identifiers.folder, identifiers.stem, identifiers.extension)]
    )
    assert [tuple(r) for r in parts.collect()] == [("c.tar.gz", "a/b", "c.tar", ".gz"), ("main", ".", "main", "")]


def test_kinds(spark):
    assert kinds.mask("plain", "dot") == 9 and kinds.decode(6) == ["aliased", "blank"]
    c = F.lit(5)
    row = spark.range(1).select(kinds.names(c), kinds.count(c), kinds.has(c, "blank"), kinds.with_kinds(c, "dot"), kinds.is_empty(F.lit(0)), kinds.union(c, F.lit(2))).first()
    assert tuple(row) == (["plain", "blank"], 2, True, 13, True, 7)
