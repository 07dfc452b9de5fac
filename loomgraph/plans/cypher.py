"""Compiles parsed queries to DataFrame plans.

State between clauses is a binding table: one row per match, with columns
`variable__property` (and `variable__id`) for nodes and relationships and one
column for each other value. Predicates can so name any variable, patterns are
equi-joins, and column pruning and pushdown reach the scans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import FUNCTIONS, percentile_disc, percentile_disc_floor
from ..graph import PropertyGraph, union
from ..operators.paths import hops
from .lineage import cut
from .parser import AGGREGATES, CypherError, Expr, Item, Node, Pattern, Projection, Query, Rel, parse

_SCALARS = {
    "tolower": F.lower, "toupper": F.upper, "trim": F.trim, "size": F.length, "abs": F.abs, "round": F.round, "floor": F.floor, "ceil": F.ceil, "sqrt": F.sqrt, "coalesce": F.coalesce,
    "tointeger": lambda c: c.try_cast("bigint"), "tofloat": lambda c: c.try_cast("double"), "tostring": lambda c: c.cast("string"), "substring": lambda c, s, n=None: F.substring(c, s + 1, n if n is not None else F.length(c)), "replace": F.replace,
}


@dataclass
class Binding:
    kind: str  # node, rel or value
    props: list[str] = field(default_factory=list)


@dataclass
class State:
    df: DataFrame | None = None
    env: dict[str, Binding] = field(default_factory=dict)


class Compiler:
    """null_semantics `sql`: a comparison with null is not true; `reference`: a missing value equals a missing one and differs from any other."""

    def __init__(self, graph: PropertyGraph, null_semantics: str = "sql") -> None:
        self.graph, self.nulls, self.fresh = graph, null_semantics, 0

    def query(self, q: Query) -> DataFrame:
        df = self._single(q)
        if q.union:
            other = self.query(q.union[0])
            if len(other.columns) != len(df.columns):
                raise CypherError("both branches of a set operation need the same number of columns")
            kind, every = q.union[1:]
            if kind == "UNION":
                return df.union(other) if every else df.union(other).distinct()
            if kind == "INTERSECT":
                return df.intersectAll(other) if every else df.intersect(other)
            return df.exceptAll(other) if every else df.subtract(other)
        return df

    def _single(self, q: Query) -> DataFrame:
        s = State()
        for k, c in enumerate(q.clauses):
            if c.kind in ("match", "with", "where", "call"):
                s = self.reading(s, c)
            elif c.kind == "return":
                if k != len(q.clauses) - 1:
                    raise CypherError("RETURN must come last")
                return self.project(s, c.body)[0]
            else:
                raise CypherError(f"{c.kind.upper()} changes the graph; run it by Session")
        raise CypherError("a query needs RETURN")

    def reading(self, s: State, c) -> State:
        if c.kind == "match":
            return self.match(s, c.body, c.where, c.optional)
        if c.kind == "with":
            df, env = self.project(s, c.body, keep=True)
            s = State(df, env)
            return replace(s, df=df.where(self.expr(c.body.where, s))) if c.body.where else s
        if c.kind == "where":
            return replace(s, df=s.df.where(self.expr(c.body, s)))
        inner = self.query(c.body)
        names = {x: x.replace(".", "_") for x in inner.columns}
        inner = inner.toDF(*names.values())
        if s.df is None:
            return State(inner, {x: Binding("value") for x in inner.columns})
        shared = [x for x in c.extra if x in inner.columns and x in s.env]
        return State(s.df.join(inner, shared) if shared else s.df.crossJoin(inner), s.env | {x: Binding("value") for x in inner.columns})

    # Patterns

    def match(self, s: State, patterns: list[Pattern], where: Expr | None, optional: bool = False) -> State:
        if optional and s.df is not None:
            named = {n.var for p in patterns for n in p.nodes if n.var} | {r.var for p in patterns for r in p.rels if r.var}
            shared = [v for v in named if v in s.env]
            keys = [f"{v}__id" for v in shared]
            outer = self._names(where) & set(s.env) if where else set()
            if outer <= set(shared):  # the match depends on the shared variables only
                kept = [x for x in s.df.columns if x.partition("__")[0] in shared]
                ids = [k for v in shared for k in ([f"{v}__id", f"{v}__typ"] if s.env[v].kind == "rel" else [f"{v}__id"])]
                got = self._match(State(s.df.select(*kept).dropDuplicates(ids), {v: s.env[v] for v in shared}) if shared else State(), patterns, where)
                new = [x for x in got.df.columns if x.partition("__")[0] not in shared]
                right = got.df.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *new)
                on = [s.df[k].eqNullSafe(right[f"__k_{k}"]) for k in keys] or [F.lit(True)]
                df = s.df.join(right, on, "left").drop(*[f"__k_{k}" for k in keys])
                return State(df, s.env | got.env)
            # WHERE looks at other variables of a row too, so rows are numbered, written, and met again by their number.
            rows = cut(s.df.withColumn("__outer", F.monotonically_increasing_id()))
            got = self._match(State(rows, s.env), patterns, where)
            right = got.df.select(F.col("__outer").alias("__of"), *[x for x in got.df.columns if x not in rows.columns])
            return State(rows.join(right, F.col("__outer") == F.col("__of"), "left").drop("__outer", "__of"), s.env | got.env)
        return self._match(s, patterns, where)

    def _names(self, e: Expr) -> set[str]:
        if e.op == "prop" or e.op == "name":
            return {e.args[0]}
        return {x for a in e.args if isinstance(a, Expr) for x in self._names(a)}

    def _match(self, s: State, patterns: list[Pattern], where: Expr | None) -> State:
        for p in patterns:
            if s.df is not None and (p.nodes[0].var not in s.env) and p.nodes[-1].var in s.env:
                p = Pattern(p.nodes[::-1], [replace(r, direction={"out": "in", "in": "out", "both": "both"}[r.direction]) for r in p.rels[::-1]])
            if s.df is not None and p.nodes[0].var not in s.env:
                alone = self._chain(State(), p)
                shared = [v for v in alone.env if v in s.env]
                right = alone.df.select(*[F.col(x).alias(f"__r_{x}") if x.partition("__")[0] in shared else F.col(x) for x in alone.df.columns])
                on = [s.df[f"{v}__id"] == right[f"__r_{v}__id"] for v in shared]
                df = s.df.join(right, on) if on else s.df.crossJoin(right)
                s = State(df.select(*[x for x in df.columns if not x.startswith("__r_")]), s.env | alone.env)
            else:
                s = self._chain(s, p)
        return replace(s, df=s.df.where(self.expr(where, s))) if where else s

    def _name(self, var: str | None) -> str:
        self.fresh += var is None
        return var or f"_anon{self.fresh}"

    def _scan(self, node: Node, var: str, hints: set[str] = frozenset()) -> tuple[DataFrame, Binding]:
        labels = node.labels or (tuple(hints) if len(hints) == 1 else ())
        df = self.graph.label(*labels) if labels else self.graph.nodes()
        return self._prefixed(self._props(df, node.props), var)

    def _prefixed(self, df: DataFrame, var: str, kind: str = "node") -> tuple[DataFrame, Binding]:
        return df.select(*[F.col(f"`{c}`").alias(f"{var}__{c}") for c in df.columns]), Binding(kind, df.columns)

    def _props(self, df: DataFrame, props: dict) -> DataFrame:
        for k, v in props.items():
            df = df.where(F.col(f"`{k}`") == F.lit(v)) if k in df.columns else df.where(F.lit(False))
        return df

    def _tables(self, rel: Rel):
        return [t for t in self.graph.rel_tables if not rel.types or t.typ in rel.types]

    def _hints(self, rel: Rel, first: bool) -> set[str]:
        """The one label that the rel's tables give the node before (or after) it, if they all give one."""
        sides = []
        for t in self._tables(rel):
            sides += {"out": [t.start if first else t.end], "in": [t.end if first else t.start], "both": [t.start, t.end]}[rel.direction]
        return set(sides) if sides and None not in sides else set()

    def _fits(self, t, label_sets) -> bool:
        return all(not labels or side is None or side in labels for side, labels in label_sets)

    def _chain(self, s: State, p: Pattern) -> State:
        first = p.nodes[0]
        var = self._name(first.var)
        if first.var in s.env:
            s = replace(s, df=self._again(s, first))
        else:
            df, b = self._scan(first, var, self._hints(p.rels[0], True) if p.rels else set())
            s = State(df if s.df is None else s.df.crossJoin(df), s.env | {var: b})
        used: list[str] = []
        for rel, node in zip(p.rels, p.nodes[1:], strict=True):
            before, var, rvar = var, self._name(node.var), self._name(rel.var)
            if rel.span:
                s = self._many(s, before, rel, node, var)
            else:
                s = self._one(s, before, rel, node, var, rvar)
                for other in used:  # a relationship is walked once in a pattern
                    s = replace(s, df=s.df.where((F.col(f"{other}__typ") != F.col(f"{rvar}__typ")) | (F.col(f"{other}__id") != F.col(f"{rvar}__id"))))
                used.append(rvar)
        return s

    def _again(self, s: State, node: Node) -> DataFrame:
        df = s.df
        for x in node.labels:
            df = df.where(F.array_contains(f"{node.var}__labels", x))
        for k, v in node.props.items():
            df = df.where(F.col(f"{node.var}__{k}") == F.lit(v)) if k in s.env[node.var].props else df.where(F.lit(False))
        return df

    def _one(self, s: State, before: str, rel: Rel, node: Node, var: str, rvar: str) -> State:
        tables = self._tables(rel)
        known = set(node.labels) if node.labels else None
        ways = []
        for t in tables:
            base = t.df.withColumn("typ", F.lit(t.typ))
            if rel.direction in ("out", "both") and not (known and t.end and t.end not in known):
                ways.append(base.withColumns({"__from": F.col("start"), "__to": F.col("end")}))
            if rel.direction in ("in", "both") and not (known and t.start and t.start not in known):
                back = base.where("start <> end") if rel.direction == "both" else base
                ways.append(back.withColumns({"__from": F.col("end"), "__to": F.col("start")}))
        if not ways:
            ways = [self.graph.rels().limit(0).withColumns({"__from": F.lit(None).cast("bigint"), "__to": F.lit(None).cast("bigint")})]
        r, rb = self._prefixed(self._props(union(ways), rel.props), rvar, "rel")
        rb.props = [x for x in rb.props if not x.startswith("__")]
        df = s.df.join(r, F.col(f"{before}__id") == F.col(f"{rvar}____from")).drop(f"{rvar}____from")
        return self._arrive(State(df, s.env | {rvar: rb}), f"{rvar}____to", node, var, self._hints(rel, False))

    def _arrive(self, s: State, at: str, node: Node, var: str, hints: set[str]) -> State:
        if node.var in s.env:
            s = replace(s, df=s.df.where(F.col(at) == F.col(f"{var}__id")).drop(at))
            return replace(s, df=self._again(s, node))
        df, b = self._scan(node, var, hints)
        return State(s.df.join(df, F.col(at) == F.col(f"{var}__id")).drop(at), s.env | {var: b})

    def _many(self, s: State, before: str, rel: Rel, node: Node, var: str) -> State:
        tables, none = self._tables(rel), self.graph.rels().limit(0)
        e = union([t.df.select(F.col("start").alias("src"), F.col("end").alias("dst")) for t in tables]) if tables else none.select(F.col("start").alias("src"), F.col("end").alias("dst"))
        back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        e = {"out": e, "in": back, "both": e.unionAll(back)}[rel.direction]
        got = hops(e, s.df.select(f"{before}__id"), *rel.span).select(F.col("start").alias("__start"), F.col("id").alias("__to"))
        df = s.df.join(got, F.col(f"{before}__id") == F.col("__start")).drop("__start")
        return self._arrive(State(df, s.env), "__to", node, var, self._hints(rel, False))

    # Expressions

    def expr(self, e: Expr, s: State) -> Column:
        a = e.args
        match e.op:
            case "lit":
                return F.lit(a[0])
            case "prop":
                if a[0] not in s.env:
                    raise CypherError(f"unknown variable {a[0]}")
                return F.col(f"`{a[0]}__{a[1]}`") if a[1] in s.env[a[0]].props else F.lit(None)
            case "name":
                return self.value(a[0], s)
            case "list":
                return F.array(*[self.expr(x, s) for x in a])
            case "and":
                return self.expr(a[0], s) & self.expr(a[1], s)
            case "or":
                return self.expr(a[0], s) | self.expr(a[1], s)
            case "not":
                return ~self.expr(a[0], s)
            case "isnull":
                return self.expr(a[0], s).isNull()
            case "notnull":
                return self.expr(a[0], s).isNotNull()
            case "neg":
                return -self.expr(a[0], s)
            case "in":
                if a[1].op == "list":
                    return self.expr(a[0], s).isin(*[x.args[0] for x in a[1].args]) if all(x.op == "lit" for x in a[1].args) else F.array_contains(self.expr(a[1], s), self.expr(a[0], s))
                return F.array_contains(self.expr(a[1], s), self.expr(a[0], s))
            case "=~":
                if a[1].op == "lit":
                    try:
                        re.compile(a[1].args[0])
                    except (re.error, TypeError):
                        return F.lit(False)
                return self.expr(a[0], s).rlike(a[1].args[0]) if a[1].op == "lit" else F.rlike(self.expr(a[0], s), self.expr(a[1], s))
            case "call":
                return self.call(e, s)
        x, y = self.expr(a[0], s), self.expr(a[1], s)
        if self.nulls == "reference" and e.op in ("=", "<>"):
            return x.eqNullSafe(y) if e.op == "=" else ~x.eqNullSafe(y)
        return {
            "=": lambda: x == y, "<>": lambda: x != y, "<": lambda: x < y, ">": lambda: x > y, "<=": lambda: x <= y, ">=": lambda: x >= y, "+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y,
            "/": lambda: F.try_divide(x, y), "%": lambda: F.try_mod(x, y), "contains": lambda: F.contains(x, y), "starts": lambda: F.startswith(x, y), "ends": lambda: F.endswith(x, y),
        }[e.op]()

    def value(self, name: str, s: State) -> Column:
        b = s.env.get(name)
        if b is None:
            raise CypherError(f"unknown variable {name}")
        return F.col(f"`{name}`") if b.kind == "value" else F.when(F.col(f"{name}__id").isNotNull(), F.struct(*[F.col(f"`{name}__{p}`").alias(p) for p in b.props]))

    def call(self, e: Expr, s: State) -> Column:
        name, *args = e.args
        base, distinct = name.removesuffix(" distinct"), name.endswith(" distinct")
        if base == "id":
            return F.col(f"{args[0].args[0]}__id")
        if base == "labels":
            return F.col(f"{args[0].args[0]}__labels")
        if base == "type":
            return F.col(f"{args[0].args[0]}__typ")
        if base in _SCALARS or base in FUNCTIONS:
            return (FUNCTIONS.get(base) or _SCALARS[base])(*[self.expr(x, s) for x in args])
        if base not in AGGREGATES:
            raise CypherError(f"unknown function {base}")
        if base == "count":
            if args[0].op == "star":
                return F.count(F.lit(1))
            v = F.col(f"{args[0].args[0]}__id") if args[0].op == "name" and s.env.get(args[0].args[0], Binding("value")).kind != "value" else self.expr(args[0], s)
            return F.count_distinct(v) if distinct else F.count(v)
        v = self.expr(args[0], s)
        if base.startswith("percentile"):
            q = args[1].args[0] if len(args) > 1 else 0.5
            if not 0 <= q <= 1:
                raise CypherError("a percentile lies in 0..1")
            return F.percentile(v, F.lit(q)) if base == "percentilecont" else percentile_disc_floor(v, q)
        if base == "collect":
            return F.collect_set(v) if distinct else F.collect_list(v)
        if base == "stdev":  # of the population, null below two values
            return F.when(F.count(v) >= 2, F.stddev_pop(v))
        if base == "sum":
            return F.coalesce(F.sum_distinct(v) if distinct else F.sum(v), F.lit(0))
        return {"avg": F.avg, "min": F.min, "max": F.max, "stdevp": F.stddev_pop}[base](v)

    def aggregates(self, e: Expr) -> bool:
        return e.op == "call" and e.args[0].removesuffix(" distinct") in AGGREGATES or any(self.aggregates(x) for x in e.args if isinstance(x, Expr))

    # Projection

    def label_of(self, i: Item) -> str:
        if i.alias:
            return i.alias
        if i.expr.op == "call" and i.expr.args[1:] and i.expr.args[1].op == "star":
            return "count"
        return i.text.lower() if self.aggregates(i.expr) else i.text

    def project(self, s: State, p: Projection, keep: bool = False) -> tuple[DataFrame, dict[str, Binding]]:
        """Columns of the items (variables stay spread out if keep), grouped, ordered and cut."""
        if s.df is None:
            s = State(self.graph.spark.range(1).select(F.lit(1).alias("__one")), {})
        grouped = bool(p.group) or any(self.aggregates(i.expr) for i in p.items)
        out: list[tuple[str, Column, Expr]] = []
        env: dict[str, Binding] = {}
        for i in p.items:
            name = self.label_of(i)
            b = s.env.get(i.expr.args[0]) if i.expr.op == "name" else None
            if keep and b is not None and b.kind != "value":
                out += [(f"{name}__{x}", F.col(f"`{i.expr.args[0]}__{x}`"), Expr("prop", (i.expr.args[0], x))) for x in b.props]
                env[name] = b
            else:
                out.append((name, self.expr(i.expr, s), i.expr))
                env[name] = Binding("value")
        hidden: list[tuple[str, Column]] = []
        order: list[tuple[str, bool]] = []
        for e, up in p.order:
            same = next((n for n, _, x in out if x == e or e.op == "name" and e.args[0] == n), None)
            if same is None:
                same = f"__order{len(hidden)}"
                hidden.append((same, self.expr(e, s)))
            order.append((same, up))
        if grouped:
            keys = [(f"__g{k}", self.expr(e, s), e) for k, e in enumerate(p.group or [x for _, _, x in out if not self.aggregates(x)])]
            if p.group:
                ids = [F.col(f"`{v}__id`") for v, b in s.env.items() if b.kind == "node"] or [F.lit(0)]  # an item outside the groups has the value at the smallest ids
                wanted = [(n, c if self.aggregates(x) else F.min_by(c, F.struct(*ids)), x) for n, c, x in out]
            else:
                wanted = [(n, c, x) for n, c, x in out if self.aggregates(x)]
            disc = {n: x for n, _, x in wanted if x.op == "call" and x.args[0] == "percentiledisc"}
            aggs = [c.alias(n) for n, c, x in wanted if n not in disc and not any(x == k for _, _, k in keys)] + [c.alias(n) for n, c in hidden]
            df = s.df.groupBy(*[c.alias(n) for n, c, _ in keys]).agg(F.count(F.lit(1)).alias("__n"), *aggs)
            for n, x in disc.items():
                q = x.args[2].args[0] if len(x.args) > 2 else 0.5
                found = percentile_disc(s.df, {k: c for k, c, _ in keys}, self.expr(x.args[1], s), q, n).withColumnsRenamed({k: f"__d{k}" for k, _, _ in keys})
                on = [F.col(k).eqNullSafe(F.col(f"__d{k}")) for k, _, _ in keys]
                df = df.join(found, on, "left").drop(*[f"__d{k}" for k, _, _ in keys]) if on else df.join(found, how="left")
            if not keys:
                df = df.where("__n > 0")  # no match, no row
            by = {n: next(g for g, _, k in keys if k == x) for n, _, x in out if any(k == x for _, _, k in keys)}
            df = df.select(*[F.col(f"`{by.get(n, n)}`").alias(n) for n, _, _ in out], *[n for n, _ in hidden])
        else:
            df = s.df.select(*[c.alias(n) for n, c, _ in out], *[c.alias(n) for n, c in hidden])
        if p.distinct:
            df = df.distinct()
        if order:
            ties = [n for n, t in df.dtypes if (p.skip or p.limit is not None) and n not in {x for x, _ in order} and not t.startswith("map")]
            df = df.orderBy(*[F.col(f"`{n}`").asc_nulls_last() if up else F.col(f"`{n}`").desc_nulls_last() for n, up in order], *[F.col(f"`{n}`").asc_nulls_last() for n in ties])
        if p.skip:
            df = df.offset(p.skip)
        if p.limit is not None:
            df = df.limit(p.limit)
        return df.drop(*[n for n, _ in hidden]) if hidden else df, env


def cypher(graph: PropertyGraph, text: str, null_semantics: str = "sql") -> DataFrame:
    """The result of a reading query as a lazy DataFrame."""
    return Compiler(graph, null_semantics).query(parse(text))


def explain(graph: PropertyGraph, text: str) -> str:
    """Physical plan of a query."""
    return cypher(graph, text)._jdf.queryExecution().toString()
