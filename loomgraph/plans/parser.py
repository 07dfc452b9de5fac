"""Parser of the Cypher dialect: text to a tree of dataclasses."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any


class CypherError(ValueError):
    """The text isn't in the dialect, or names something that isn't there."""


@dataclass
class Node:
    var: str | None
    labels: tuple[str, ...]
    props: dict[str, Any]


@dataclass
class Rel:
    var: str | None
    types: tuple[str, ...]
    direction: str  # out, in, both
    props: dict[str, Any]
    span: tuple[int, int | None] | None = None  # variable length


@dataclass
class Pattern:
    nodes: list[Node]
    rels: list[Rel]


@dataclass
class Expr:
    """op and operands: lit, prop (var, name), name, list, star, call, binary and unary operators."""

    op: str
    args: tuple = ()


@dataclass
class Item:
    expr: Expr
    alias: str | None
    text: str


@dataclass
class Projection:
    items: list[Item]
    distinct: bool = False
    group: list[Expr] = field(default_factory=list)
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    skip: int | None = None
    limit: int | None = None
    where: Expr | None = None


@dataclass
class Clause:
    """kind: match, with, return, create, merge, set, delete, foreach, call, begin, commit, rollback."""

    kind: str
    body: Any = None
    optional: bool = False
    where: Expr | None = None
    extra: Any = None


@dataclass
class Query:
    clauses: list[Clause]
    union: tuple[Query, str, bool] | None = None  # the other branch, UNION, INTERSECT or EXCEPT, and whether all rows stay


_TOKEN = re.compile(r"\s+|//[^\n]*|(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?!\.\d))|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<id>[A-Za-z_]\w*|`[^`]+`)|(?P<op><>|!=|<=|>=|=~|\.\.|[-+*/%=<>()\[\]{},.:|;])")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
SETS = ("UNION", "INTERSECT", "EXCEPT")
AGGREGATES = {"count", "sum", "avg", "min", "max", "collect", "stdev", "stdevp", "percentilecont", "percentiledisc"}


def parse(text: str) -> Query:
    p = _Parser(text)
    q = p.query()
    p.accept(";")
    if p.kind != "end":
        p.fail("end of text")
    return q


class _Parser:
    def __init__(self, text: str) -> None:
        self.text, self.tokens, at = text, [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise CypherError(f"unexpected {text[at]!r} at {at}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0], m.start(), m.end()))
            at = m.end()
        self.tokens.append(("end", "", len(text), len(text)))
        self.k = 0

    kind = property(lambda self: self.tokens[self.k][0])
    value = property(lambda self: self.tokens[self.k][1])

    def fail(self, wanted: str):
        raise CypherError(f"expected {wanted} at {self.tokens[self.k][2]}, found {self.value or 'the end'!r}")

    def word(self, *words: str, ahead: int = 0) -> bool:
        t = self.tokens[min(self.k + ahead, len(self.tokens) - 1)]
        return t[0] == "id" and t[1].upper() in words

    def accept(self, *values: str) -> str | None:
        if self.kind == "op" and self.value in values or self.kind == "id" and self.value.upper() in values:
            self.k += 1
            return self.tokens[self.k - 1][1]
        return None

    def expect(self, *values: str) -> str:
        got = self.accept(*values)
        if got is None:
            self.fail(" or ".join(values))
        return got

    def name(self) -> str:
        if self.kind != "id":
            self.fail("a name")
        self.k += 1
        return self.tokens[self.k - 1][1].strip("`")

    def whole(self) -> int:
        if self.kind != "num" or "." in self.value:
            self.fail("a whole number")
        self.k += 1
        return int(self.tokens[self.k - 1][1])

    # Statements

    def query(self) -> Query:
        clauses: list[Clause] = []
        while self.kind == "id" and (c := self.clause()) is not None:
            clauses.append(c)
        if not clauses:
            self.fail("a clause")
        q = Query(clauses)
        if kind := self.accept(*SETS):
            every = bool(self.accept("ALL"))
            q.union = (self.query(), kind.upper(), every)
        return q

    def clause(self) -> Clause | None:
        if self.word(*SETS):
            return None
        if self.accept("BEGIN", "COMMIT", "ROLLBACK"):
            kind = self.tokens[self.k - 1][1].lower()
            self.accept("TRANSACTION")
            return Clause(kind)
        if self.word("OPTIONAL", "MATCH"):
            optional = bool(self.accept("OPTIONAL"))
            self.expect("MATCH")
            return Clause("match", self.patterns(), optional, self.where())
        if self.accept("WITH"):
            return Clause("with", self.projection(True))
        if self.accept("WHERE"):
            return Clause("where", self.expr())
        if self.accept("RETURN"):
            return Clause("return", self.projection(False))
        if self.accept("CREATE"):
            return Clause("create", self.patterns())
        if self.accept("MERGE"):
            pattern, on = self.pattern(), {"CREATE": [], "MATCH": []}
            while self.word("ON"):
                self.k += 1
                when = self.expect("CREATE", "MATCH").upper()
                self.expect("SET")
                on[when] += self.assignments()
            return Clause("merge", pattern, extra=on)
        if self.accept("SET"):
            return Clause("set", self.assignments())
        if self.word("DETACH", "DELETE"):
            self.accept("DETACH")
            self.expect("DELETE")
            return Clause("delete", self.names())
        if self.accept("FOREACH"):
            self.expect("(")
            var = self.name()
            self.expect("IN")
            values = self.primary()
            self.expect("|")
            self.expect("SET")
            body = self.assignments()
            self.expect(")")
            return Clause("foreach", body, extra=(var, values))
        if self.accept("CALL"):
            self.expect("{")
            inner = self.query()
            self.expect("}")
            shared = []
            if self.accept("IN"):
                self.expect("(")
                shared = self.names()
                self.expect(")")
            return Clause("call", inner, extra=shared)
        self.fail("a clause")

    def where(self) -> Expr | None:
        return self.expr() if self.accept("WHERE") else None

    def names(self) -> list[str]:
        out = [self.name()]
        while self.accept(","):
            out.append(self.name())
        return out

    def assignments(self) -> list[tuple[str, str, Expr]]:
        out = []
        while True:
            var = self.name()
            self.expect(".")
            prop = self.name()
            self.expect("=")
            out.append((var, prop, self.expr()))
            if not self.accept(","):
                return out

    def projection(self, is_with: bool) -> Projection:
        p = Projection([], bool(self.accept("DISTINCT")))
        while True:
            start = self.tokens[self.k][2]
            e = self.expr()
            text = self.text[start : self.tokens[self.k - 1][3]]
            p.items.append(Item(e, self.name() if self.accept("AS") else None, text))
            if not self.accept(","):
                break
        if self.accept("GROUP"):
            self.expect("BY")
            p.group.append(self.expr())
            while self.accept(","):
                p.group.append(self.expr())
        if self.accept("ORDER"):
            self.expect("BY")
            while True:
                e = self.expr()
                down = self.accept("DESC", "DESCENDING", "ASC", "ASCENDING")
                p.order.append((e, not (down or "").upper().startswith("D")))
                if not self.accept(","):
                    break
        if self.accept("SKIP"):
            p.skip = self.whole()
        if self.accept("LIMIT"):
            p.limit = self.whole()
        if is_with:
            p.where = self.where()
        return p

    # Patterns

    def patterns(self) -> list[Pattern]:
        out = [self.pattern()]
        while self.accept(","):
            out.append(self.pattern())
        return out

    def pattern(self) -> Pattern:
        p = Pattern([self.node()], [])
        while self.kind == "op" and self.value in ("-", "<"):
            p.rels.append(self.rel())
            p.nodes.append(self.node())
        return p

    def node(self) -> Node:
        self.expect("(")
        var = self.name() if self.kind == "id" else None
        labels = []
        while self.accept(":"):
            labels.append(self.name())
        props = self.props()
        self.expect(")")
        return Node(var, tuple(labels), props)

    def props(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        if self.accept("{"):
            while not self.accept("}"):
                k = self.name()
                self.expect(":")
                out[k] = self.literal()
                if not self.accept(","):
                    self.expect("}")
                    break
        return out

    def rel(self) -> Rel:
        back = bool(self.accept("<"))
        self.expect("-")
        var, types, span, props = None, [], None, {}
        if self.accept("["):
            var = self.name() if self.kind == "id" else None
            while self.accept(":", "|"):
                self.accept(":")
                types.append(self.name())
            if self.accept("*"):
                span = (1, None)
                if self.kind == "num":
                    low = self.whole()
                    span = (1, low)
                    if self.accept(".."):
                        span = (low, self.whole() if self.kind == "num" else None)
                elif self.accept(".."):
                    span = (1, self.whole())
            props = self.props()
            self.expect("]")
        self.expect("-")
        forth = bool(self.accept(">"))
        if back and forth:
            self.fail("one direction")
        return Rel(var, tuple(types), "in" if back else "out" if forth else "both", props, span)

    # Expressions, from loose to tight

    def expr(self) -> Expr:
        e = self.conjunction()
        while self.accept("OR"):
            e = Expr("or", (e, self.conjunction()))
        return e

    def conjunction(self) -> Expr:
        e = self.negation()
        while self.accept("AND"):
            e = Expr("and", (e, self.negation()))
        return e

    def negation(self) -> Expr:
        return Expr("not", (self.negation(),)) if self.accept("NOT") else self.comparison()

    def comparison(self) -> Expr:
        e = self.sum()
        while True:
            if op := self.accept("=", "<>", "!=", "<=", ">=", "<", ">", "=~"):
                e = Expr("<>" if op == "!=" else op, (e, self.sum()))
            elif self.accept("IN"):
                e = Expr("in", (e, self.sum()))
            elif self.accept("IS"):
                no = self.accept("NOT")
                self.expect("NULL")
                e = Expr("notnull" if no else "isnull", (e,))
            elif op := self.accept("CONTAINS"):
                e = Expr("contains", (e, self.sum()))
            elif op := self.accept("STARTS", "ENDS"):
                self.expect("WITH")
                e = Expr(op.lower(), (e, self.sum()))
            else:
                return e

    def sum(self) -> Expr:
        e = self.product()
        while op := self.accept("+", "-"):
            e = Expr(op, (e, self.product()))
        return e

    def product(self) -> Expr:
        e = self.primary()
        while op := self.accept("*", "/", "%"):
            e = Expr(op, (e, self.primary()))
        return e

    def literal(self):
        e = self.primary()
        if e.op == "list":
            return [x.args[0] for x in e.args]
        if e.op != "lit":
            self.fail("a literal")
        return e.args[0]

    def primary(self) -> Expr:
        if self.kind == "num":
            self.k += 1
            raw = self.tokens[self.k - 1][1]
            return Expr("lit", (float(raw) if "." in raw else int(raw),))
        if self.kind == "str":
            self.k += 1
            return Expr("lit", (re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), self.tokens[self.k - 1][1][1:-1]),))
        if self.accept("-"):
            e = self.primary()
            return Expr("lit", (-e.args[0],)) if e.op == "lit" else Expr("neg", (e,))
        if self.accept("("):
            e = self.expr()
            self.expect(")")
            return e
        if self.accept("["):
            items = []
            while not self.accept("]"):
                items.append(self.expr())
                if not self.accept(","):
                    self.expect("]")
                    break
            return Expr("list", tuple(items))
        if self.word("TRUE", "FALSE", "NULL"):
            return Expr("lit", ({"TRUE": True, "FALSE": False, "NULL": None}[self.name().upper()],))
        name = self.name()
        if self.accept("("):
            if self.accept("*"):
                self.expect(")")
                return Expr("call", (name.lower(), Expr("star")))
            distinct, args = bool(self.accept("DISTINCT")), []
            while not self.accept(")"):
                args.append(self.expr())
                if not self.accept(","):
                    self.expect(")")
                    break
            if name.upper() == "EXISTS":
                return Expr("notnull", (args[0],))
            return Expr("call", (name.lower() + (" distinct" if distinct else ""), *args))
        if self.accept("."):
            return Expr("prop", (name, self.name()))
        return Expr("name", (name,))
