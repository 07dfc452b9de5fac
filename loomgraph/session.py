"""A session: Cypher text against the current version of a graph, with transactions and savepoints as a stack of versions."""

from __future__ import annotations

import functools
import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import PropertyGraph
from .operators import mutate
from .operators.constraints import Constraints
from .plans.cypher import Compiler, State
from .plans.lineage import cut
from .plans.parser import Clause, CypherError, Pattern, Query, parse


@dataclass
class Result:
    """df of a query, or the counts of a change."""

    df: DataFrame | None = None
    counts: dict[str, int] = field(default_factory=dict)


class Store:
    """The version of a graph that several sessions share. A commit is one compare and set under a lock."""

    def __init__(self, graph: PropertyGraph) -> None:
        self.graph, self.version, self.lock = graph, 0, threading.Lock()

    def publish(self, graph: PropertyGraph, seen: int) -> bool:
        """Make graph the current version if `seen` still is; whether it did."""
        with self.lock:
            if self.version != seen:
                return False
            self.graph, self.version = graph, seen + 1
            return True


#: Of a transaction in a shared store. At the first level statements read what others have committed meanwhile, and a
#: commit behind others runs its own changes again on their version; at the others a transaction reads one version,
#: and such a commit is an error: always for `serializable`, only of changes for `repeatable_read`.
ISOLATION = ("read_committed", "repeatable_read", "serializable")


@dataclass
class Transaction:
    """ops are the texts of its changes, in order; seen is the store's version that it last read."""

    id: int
    graph: PropertyGraph
    began: float
    savepoints: list[tuple[str, PropertyGraph, int]] = field(default_factory=list)
    state: str = "active"
    isolation: str = "read_committed"
    ops: list[str] = field(default_factory=list)
    seen: int = 0


class Session:
    """Versions are immutable, so rolling back is dropping one; a transaction older than `timeout` seconds can't commit.

    Sessions on one Store see each other's commits by the levels of ISOLATION.
    """

    def __init__(self, graph: PropertyGraph | Store, null_semantics: str = "sql", timeout: float = 30.0, constraints: Constraints | None = None) -> None:
        self.store = graph if isinstance(graph, Store) else Store(graph)
        self.graph, self.seen = self.store.graph, self.store.version
        self.nulls, self.timeout, self.constraints = null_semantics, timeout, constraints
        self.transactions: list[Transaction] = []

    # Transactions

    def _open(self) -> Transaction | None:
        return next((t for t in reversed(self.transactions) if t.state == "active"), None)

    def active(self) -> Transaction:
        t = self._open()
        if t is None:
            raise CypherError("no transaction is active")
        return t

    def begin(self, isolation: str = "read_committed") -> int:
        if isolation not in ISOLATION:
            raise CypherError(f"isolation is one of {', '.join(ISOLATION)}")
        self._refresh()
        self.transactions.append(Transaction(self.transactions[-1].id + 1 if self.transactions else 0, self.graph, time.monotonic(), isolation=isolation, seen=self.seen))
        return self.transactions[-1].id

    def _refresh(self) -> None:
        """Read the store's version, as far as the level and own changes allow."""
        t = self._open()
        if t is None or t.isolation == "read_committed" and not t.ops:
            with self.store.lock:
                self.graph, self.seen = self.store.graph, self.store.version

    def commit(self) -> None:
        t = self.active()
        if time.monotonic() - t.began > self.timeout:
            t.state, self.graph = "expired", t.graph
            raise CypherError("the transaction has expired and was rolled back")
        outer = next((x for x in reversed(self.transactions) if x.state == "active" and x is not t), None)
        if outer is not None:  # its changes are the outer one's from now on
            t.state = "committed"
            outer.ops += t.ops
            return
        if t.ops and not self.store.publish(self.graph, self.seen):
            if t.isolation != "read_committed":
                t.state = "rolled back"
                self._refresh()
                raise CypherError("another transaction has committed since; this one was rolled back")
            self._again(t.ops)
        elif t.isolation == "serializable" and not t.ops and self.store.version != self.seen:
            t.state = "rolled back"
            self._refresh()
            raise CypherError("another transaction has committed since; this one was rolled back")
        t.state = "committed"
        if t.ops:
            self.seen = self.store.version

    def _again(self, ops: list[str]) -> None:
        """Run changes on the store's newest version until no other commit comes between."""
        while True:
            with self.store.lock:
                self.graph, self.seen = self.store.graph, self.store.version
            for text in ops:
                self._checked(parse(text))
            if self.store.publish(self.graph, self.seen):
                return

    def rollback(self) -> None:
        t = self.active()
        t.state, self.graph = "rolled back", t.graph
        self._refresh()

    def savepoint(self, name: str) -> None:
        t = self.active()
        if any(n == name for n, *_ in t.savepoints):
            raise CypherError(f"savepoint {name} exists")
        t.savepoints.append((name, self.graph, len(t.ops)))

    def rollback_to(self, name: str) -> None:
        """Back to a savepoint; later ones and later changes go, itself stays."""
        t = self.active()
        at = self._at(t, name)
        _, self.graph, n = t.savepoints[at]
        del t.savepoints[at + 1 :], t.ops[n:]

    def release(self, name: str) -> None:
        t = self.active()
        del t.savepoints[self._at(t, name)]

    def expire(self) -> int:
        """Roll back what is older than the timeout; how many that were."""
        late = [t for t in self.transactions if t.state == "active" and time.monotonic() - t.began > self.timeout]
        for t in late:
            t.state, self.graph = "expired", t.graph
        return len(late)

    def cleanup(self, keep_last: int = 0) -> int:
        """Forget ended transactions but the last ones; how many went."""
        ended = [t for t in self.transactions if t.state != "active"]
        gone = ended[: max(0, len(ended) - keep_last)]
        self.transactions = [t for t in self.transactions if t not in gone]
        return len(gone)

    @staticmethod
    def _at(t: Transaction, name: str) -> int:
        for k, (n, *_) in enumerate(t.savepoints):
            if n == name:
                return k
        raise CypherError(f"no savepoint {name}")

    # Statements

    def run(self, text: str) -> Result:
        q = parse(text)
        kinds = [c.kind for c in q.clauses]
        if kinds[0] in ("begin", "commit", "rollback"):
            getattr(self, kinds[0])()
            return Result()
        self._refresh()
        if not {"create", "merge", "set", "delete", "foreach"} & set(kinds):
            return Result(Compiler(self.graph, self.nulls).query(q))
        before, t = self.graph, self._open()
        result = self._checked(q)
        if t is not None:
            t.ops.append(text)
        elif not self.store.publish(self.graph, self.seen):
            self.graph = before
            self._again([text])
        else:
            self.seen = self.store.version
        return result

    def _checked(self, q: Query) -> Result:
        before = self.graph
        try:
            result = self._change(q)
            if self.constraints:
                self.constraints.enforce(self.graph)
            return result
        except Exception:
            self.graph = before
            raise

    def _change(self, q: Query) -> Result:
        compiler, s, counts, out = Compiler(self.graph, self.nulls), State(), {}, None
        for c in q.clauses:
            compiler.graph = self.graph
            if c.kind in ("match", "with", "where", "call"):
                s = compiler.reading(s, c)
            elif c.kind == "return":
                out = compiler.project(s, c.body)[0]
            else:
                for k, n in getattr(self, f"_{c.kind}")(compiler, s, c).items():
                    counts[k] = counts.get(k, 0) + n
        return Result(out, counts)

    def _create(self, compiler: Compiler, s: State, c: Clause) -> dict[str, int]:
        """New nodes for each variable that isn't bound, and relationships, once for each row of the match."""
        rows = self.graph.spark.range(1).select(F.lit(0).alias("__row")) if s.df is None else s.df
        if s.df is not None and any(n.var not in s.env for p in c.body for n in p.nodes):
            rows = rows.withColumn("__row", F.monotonically_increasing_id())
        if s.df is not None:
            rows = cut(rows)
        n_rows, made, rels = rows.count() if s.df is not None else 1, 0, 0
        known = {v: F.col(f"`{v}__id`") for v, b in s.env.items() if b.kind == "node"}
        first = mutate.next_id(self.graph.nodes(False))
        new: list = []
        for p in c.body:
            for node in p.nodes:
                if node.var not in known or node.var is None:
                    new.append(node)
                    if node.var:
                        known[node.var] = None
        # Row r of the match makes the ids first + r * len(new), ...; rows of a match are numbered with gaps.
        at = {id(n): F.lit(first + k) + (F.col("__row") * F.lit(len(new)) if s.df is not None else F.lit(0)) for k, n in enumerate(new)}
        for n in new:
            if n.var:
                known[n.var] = at[id(n)]
            props = [F.lit(v).alias(k) for k, v in n.props.items()]
            self.graph = mutate.append_nodes(self.graph, n.labels, rows.select(at[id(n)].cast("bigint").alias("id"), *props))
            made += n_rows
        for p in c.body:
            for k, r in enumerate(p.rels):
                if r.direction == "both" or len(r.types) != 1:
                    raise CypherError("a created relationship has one direction and one type")
                a, b = (at[id(n)] if id(n) in at else known[n.var] for n in (p.nodes[k], p.nodes[k + 1]))
                start, end = (a, b) if r.direction == "out" else (b, a)
                base = mutate.next_id(self.graph.rels())
                self.graph = mutate.append_rels(self.graph, r.types[0], cut(rows.select((F.monotonically_increasing_id() + F.lit(base)).alias("id"), start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), *[F.lit(v).alias(x) for x, v in r.props.items()])))
                rels += n_rows
        return {"nodes_created": made, "relationships_created": rels}

    def _set(self, compiler: Compiler, s: State, c: Clause) -> dict[str, int]:
        """Properties of the named variables; counts the nodes (and relationships) that are set."""
        done = 0
        for var in dict.fromkeys(v for v, _, _ in c.body):
            if var not in s.env:
                raise CypherError(f"unknown variable {var}")
            ids = s.df.where(F.col(f"{var}__id").isNotNull())
            changes = ids.select(F.col(f"{var}__id").alias("id"), *[F.struct(compiler.expr(e, s).alias("v")).alias(p) for v, p, e in c.body if v == var])
            self.graph = mutate.update_nodes(self.graph, changes) if s.env[var].kind == "node" else mutate.update_rels(self.graph, changes)
            done += ids.select(f"{var}__id").distinct().count()
        return {"properties_set_on": done}

    def _delete(self, compiler: Compiler, s: State, c: Clause) -> dict[str, int]:
        nodes = rels = 0
        for var in c.body:
            if var not in s.env:
                raise CypherError(f"unknown variable {var}")
            ids = s.df.select(F.col(f"{var}__id").alias("id")).where("id IS NOT NULL")
            if s.env[var].kind == "node":
                self.graph, n, r = mutate.delete_nodes(self.graph, ids)
                nodes, rels = nodes + n, rels + r
            else:
                rels += ids.distinct().count()
                self.graph = mutate.delete_rels(self.graph, ids, tuple({r[0] for r in s.df.select(f"{var}__typ").distinct().collect()}))
        return {"nodes_deleted": nodes, "relationships_deleted": rels}

    def _foreach(self, compiler: Compiler, s: State, c: Clause) -> dict[str, int]:
        """The listed numbers are node ids; counts the updates that met a node."""
        var, values = c.extra
        wanted = [x.args[0] for x in values.args]
        ids = self.graph.nodes(False).where(F.col("id").isin(wanted)).select("id")
        n = ids.count()
        self.graph = mutate.set_props(self.graph, ids, {p: compiler.expr(e, State()) for v, p, e in c.body if v == var})
        return {"properties_set_on": n * len(c.body)}

    def _merge(self, compiler: Compiler, s: State, c: Clause) -> dict[str, int]:
        """Match the pattern, else create what is missing; bound variables of the clauses before stand for their rows' nodes.

        A row of the match before whose pattern is there keeps it; for the other
        rows everything that isn't bound is created. Without such a match the
        pattern is looked for as a whole. Where it isn't there, a single node is
        created; a pattern with relationships is created once, from the first
        start node that matches (smallest id). A missing end of one relationship
        is always created anew, ends of several reuse the first node that
        matches. A relationship without a type has the type RELATED.
        """
        pattern: Pattern = c.body
        for r in pattern.rels:
            r.types = r.types or ("RELATED",)
            r.direction = "out" if r.direction == "both" else r.direction
        for k, n in enumerate(pattern.nodes):
            n.var = n.var or f"_m{k}"
        for k, r in enumerate(pattern.rels):
            r.var = r.var or f"_r{k}"
        counts: dict[str, int] = {}

        def add(more: dict[str, int]) -> None:
            for k, v in more.items():
                counts[k] = counts.get(k, 0) + v

        bound = [n.var for n in pattern.nodes if n.var in s.env]
        fresh = Compiler(self.graph, self.nulls)
        if s.df is None:
            whole = fresh._match(State(), [pattern], None)
            whole.df = cut(whole.df)
            there = not whole.df.isEmpty()
            missing = None if there else self._beginnings(pattern)
        else:
            keys = [f"{v}__id" for v in bound]
            rows = State(cut(s.df), s.env)
            whole = fresh._match(rows, [pattern], None)
            whole.df = cut(whole.df)
            there = not whole.df.isEmpty()
            if keys:  # rows of equal bound nodes merge into one, as the first of them creates what the others find
                lacking = rows.df.dropDuplicates(keys).join(whole.df.select(*[F.col(k).alias(f"__h_{k}") for k in keys]).distinct(), [F.col(k) == F.col(f"__h_{k}") for k in keys], "left_anti")
                missing = State(lacking, s.env)
            else:
                missing = State(rows.df.limit(0 if there else 1), s.env)
        if there and c.extra["MATCH"]:
            add(self._set(compiler, whole, Clause("set", c.extra["MATCH"])))
        if missing is None or missing.df is not None and missing.df.isEmpty():
            return counts
        top, rel_top = mutate.next_id(self.graph.nodes(False)), mutate.next_id(self.graph.rels())
        add(self._create(compiler, missing, Clause("create", [pattern])))
        if c.extra["CREATE"]:
            again = Compiler(self.graph, self.nulls)
            made = again._match(State(), [pattern], None)
            new = [F.col(f"{r.var}__id") >= rel_top for r in pattern.rels] or [F.col(f"{pattern.nodes[0].var}__id") >= top]
            made.df = made.df.where(functools.reduce(lambda a, b: a & b, new))
            add(self._set(again, made, Clause("set", c.extra["CREATE"])))
        return counts

    def _beginnings(self, pattern: Pattern) -> State:
        """What a pattern that isn't there starts from: one row of the first nodes that match it, or nothing."""
        if not pattern.rels:
            return State()
        reuse = pattern.nodes if len(pattern.rels) > 1 else pattern.nodes[:1]
        state = State()
        for n in reuse:
            if n.var in state.env:
                continue
            found = Compiler(self.graph, self.nulls)._match(State(), [Pattern([n], [])], None)
            first = cut(found.df.orderBy(f"{n.var}__id").limit(1))
            if not first.isEmpty():
                state = State(first if state.df is None else state.df.crossJoin(first), state.env | found.env)  # a row each
        return state
