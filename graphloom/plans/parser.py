"""Recursive-descent parser of the query language (ISO GQL, the part that queries and describes graphs)."""

from __future__ import annotations

from . import ast as A
from .lexer import SyntaxFault, Token, tokenize

#: Binding strength of infix operators, loosest first.
PRECEDENCE = {"OR": 1, "XOR": 1, "AND": 2, "IS": 3, "=": 5, "<>": 5, "!=": 5, "<": 5, "<=": 5, ">": 5, ">=": 5, "IN": 5, "LIKE": 5, "||": 6, "+": 7, "-": 7, "*": 8, "/": 8, "%": 8}
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "COLLECT_LIST", "STDDEV_SAMP", "STDDEV_POP", "PERCENTILE_CONT", "PERCENTILE_DISC"}
_STOP = {"MATCH", "OPTIONAL", "RETURN", "WHERE", "ORDER", "LIMIT", "OFFSET", "SKIP", "NEXT", "UNION", "EXCEPT", "INTERSECT", "OTHERWISE", "LET", "FOR", "FILTER", "CALL", "YIELD", "GROUP", "HAVING", "FINISH", "AS", "ASC", "DESC", "ASCENDING", "DESCENDING", "NULLS", "THEN", "ELSE", "END", "WHEN", "AND", "OR", "XOR", "NOT", "IS", "IN", "LIKE", "KEEP", "USE", "SELECT", "FROM"}


class Parser:
    def __init__(self, text: str) -> None:
        self.source, self.tokens, self.i, self.fresh = text, tokenize(text), 0, 0

    # -- tokens
    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def ahead(self, k: int = 1) -> Token:
        return self.tokens[min(self.i + k, len(self.tokens) - 1)]

    def fail(self, what: str) -> SyntaxFault:
        return SyntaxFault(f"expected {what} at {self.now.at}, found {self.now.text or 'the end'!r}")

    def word(self, *words: str) -> bool:
        """Takes the words if they come next."""
        if all(self.ahead(k).upper == w for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def one_of(self, *words: str) -> str:
        if self.now.upper in words:
            self.i += 1
            return self.tokens[self.i - 1].upper
        return ""

    def need_word(self, *words: str) -> None:
        if not self.word(*words):
            raise self.fail(" ".join(words))

    def punct(self, p: str) -> bool:
        if self.now.kind == "punct" and self.now.text == p:
            self.i += 1
            return True
        return False

    def peek(self, *marks: str) -> bool:
        return all(self.ahead(k).kind == "punct" and self.ahead(k).text == p for k, p in enumerate(marks))

    def puncts(self, *marks: str) -> bool:
        if self.peek(*marks):
            self.i += len(marks)
            return True
        return False

    def need(self, p: str) -> None:
        if not self.punct(p):
            raise self.fail(repr(p))

    def name(self) -> str:
        if self.now.kind in ("word", "name"):
            self.i += 1
            return self.tokens[self.i - 1].text
        raise self.fail("a name")

    def integer(self) -> int:
        if self.now.kind != "int":
            raise self.fail("an integer")
        self.i += 1
        return int(self.tokens[self.i - 1].text.replace("_", ""), 0) if not self.tokens[self.i - 1].text.isdigit() else int(self.tokens[self.i - 1].text)

    def listed(self, item, sep: str = ",") -> list:  # noqa: ANN001
        out = [item()]
        while self.punct(sep):
            out.append(item())
        return out

    # -- programs
    def program(self) -> list[A.Query | A.Command]:
        out = []
        while self.now.kind != "end":
            if self.punct(";"):
                continue
            out.append(self.statement())
            if self.now.kind != "end":
                self.need(";")
        return out

    def statement(self) -> A.Query | A.Command:
        if self.word("EXPLAIN"):
            return A.Command("explain", {"query": self.statement()})
        if self.word("SESSION"):
            return self.session()
        if self.word("START", "TRANSACTION"):
            mode = "READ ONLY" if self.word("READ", "ONLY") else "READ WRITE" if self.word("READ", "WRITE") else "READ WRITE"
            return A.Command("start", {"mode": mode})
        if self.one_of("COMMIT"):
            return A.Command("commit", {})
        if self.one_of("ROLLBACK"):
            return A.Command("rollback", {})
        if self.now.upper in ("CREATE", "DROP", "TRUNCATE"):
            return self.catalog()
        return self.chain()

    def session(self) -> A.Command:
        if self.word("CLOSE"):
            return A.Command("close", {})
        verb = self.one_of("SET", "RESET")
        if not verb:
            raise self.fail("SET, RESET or CLOSE")
        self.word("PROPERTY") or self.word("ALL")
        kind = self.one_of("SCHEMA", "GRAPH", "TIME", "VALUE", "PARAMETERS", "CHARACTERISTICS")
        if kind == "TIME":
            self.need_word("ZONE")
        if verb == "RESET":
            return A.Command("reset", {"kind": kind or "VALUE", "name": self.name() if not kind and self.now.kind in ("word", "name") else None})
        if kind in ("GRAPH", "SCHEMA"):
            return A.Command("set", {"kind": kind, "name": self.reference()})
        if kind == "TIME":
            return A.Command("set", {"kind": "TIME ZONE", "name": None, "value": self.expr()})
        self.word("IF", "NOT", "EXISTS")
        if self.now.kind == "param":
            self.i += 1
            name = self.tokens[self.i - 1].text[1:]
        else:
            name = self.name()
        self.need("=")
        return A.Command("set", {"kind": "VALUE", "name": name, "value": self.expr()})

    def reference(self) -> str:
        if self.now.kind == "string":
            self.i += 1
            return self.tokens[self.i - 1].text
        parts = []
        while True:
            if self.punct("/"):
                continue
            if self.now.kind in ("word", "name"):
                parts.append(self.name())
                if self.peek("/") or self.peek("."):
                    self.i += 1
                    continue
            return parts[-1] if parts else "/"

    def catalog(self) -> A.Command:
        verb = self.name().lower()
        replace = self.word("OR", "REPLACE")
        self.word("PROPERTY")
        kind = self.one_of("SCHEMA", "GRAPH", "VECTOR")
        if not kind:
            raise self.fail("SCHEMA, GRAPH or VECTOR INDEX")
        if kind == "VECTOR":
            self.need_word("INDEX")
        if kind == "GRAPH" and self.word("TYPE"):
            kind = "GRAPH TYPE"
        missing = self.word("IF", "NOT", "EXISTS") or self.word("IF", "EXISTS")
        args: dict = {"verb": verb, "kind": kind, "name": self.reference(), "lenient": missing, "replace": replace}
        args["lenient"] = args["lenient"] or self.word("IF", "NOT", "EXISTS") or self.word("IF", "EXISTS")
        if kind == "VECTOR" and verb == "create":
            self.need_word("FOR")
            self.need("(")
            args["binding"] = self.name()
            self.need(":")
            args["label"] = self.name()
            self.need(")")
            self.need_word("ON")
            self.need("(")
            owner = self.name()
            self.need(".")
            args["property"] = self.name()
            self.need(")")
            if owner != args["binding"]:
                raise SyntaxFault("the index must be on a property of its own binding")
        elif kind == "GRAPH" and verb == "create" and self.word("AS"):
            self.need_word("COPY", "OF")
            args["copy"] = self.reference()
        elif verb == "create" and kind != "SCHEMA":
            depth = 0
            while self.now.kind != "end" and (depth or not self.peek(";")):  # element types are kept as text
                depth += self.now.text in "{(" and self.now.kind == "punct"
                depth -= self.now.text in "})" and self.now.kind == "punct"
                args["body"] = args.get("body", "") + " " + self.now.text
                self.i += 1
        return A.Command("catalog", args)

    # -- queries
    def chain(self) -> A.Query:
        steps = [(self.composite(), None)]
        while self.word("NEXT"):
            steps[-1] = (steps[-1][0], self.yields() if self.word("YIELD") else None)
            steps.append((self.composite(), None))
        return steps[0][0] if len(steps) == 1 else A.Chain(steps)

    def composite(self) -> A.Query:
        left = self.linear()
        while op := self.one_of("UNION", "EXCEPT", "INTERSECT", "OTHERWISE"):
            every = bool(self.word("ALL")) or (self.word("DISTINCT") and False)
            left = A.SetOp(op, every, left, self.linear())
        return left

    def linear(self) -> A.Linear:
        parts: list = []
        while True:
            if self.word("USE"):
                self.word("GRAPH")
                parts.append(A.Use(None if self.one_of("CURRENT_GRAPH", "CURRENT_PROPERTY_GRAPH") else self.reference()))
                if self.peek(";"):
                    return A.Linear(parts)
            elif self.peek("{"):
                self.i += 1
                parts.append(self.chain())
                self.need("}")
            elif self.now.upper == "OPTIONAL" and self.ahead().upper == "CALL":
                self.i += 2
                parts.append(self.call(optional=True))
            elif self.now.upper == "OPTIONAL" and self.ahead().text in ("{", "("):
                self.i += 1
                close = "}" if self.now.text == "{" else ")"
                self.i += 1
                matches = []
                while not self.punct(close):
                    matches.append(self.match())
                parts.append(A.Block(matches))
            elif self.now.upper in ("MATCH", "OPTIONAL"):
                parts.append(self.match())
            elif self.word("CALL"):
                parts.append(self.call())
            elif self.word("LET"):
                parts.append(A.Let(self.listed(self.binding)))
            elif self.word("FOR"):
                var = self.name()
                self.need_word("IN")
                source, counter = self.expr(), None
                if self.word("WITH"):
                    first = 1 if self.one_of("ORDINALITY") else 0
                    if not first:
                        self.need_word("OFFSET")
                    counter = (self.name(), first)
                parts.append(A.For(var, source, counter))
            elif self.word("FILTER"):
                self.word("WHERE")
                parts.append(A.Filter(self.expr()))
            elif self.now.upper in ("ORDER", "LIMIT", "OFFSET", "SKIP"):
                parts.append(self.order())
            elif self.now.upper == "SELECT":
                return self.select(parts)
            elif self.now.upper in ("RETURN", "FINISH"):
                parts.append(self.result())
                return A.Linear(parts)
            elif parts:
                return A.Linear(parts)
            else:
                raise self.fail("a statement")

    def binding(self) -> tuple[str, A.Expr]:
        self.word("VALUE")
        name = self.name()
        self.need("=")
        return name, self.expr()

    def yields(self) -> list[tuple[str, str]]:
        def one() -> tuple[str, str]:
            n = self.name()
            return n, self.name() if self.word("AS") else n

        return self.listed(one)

    def call(self, optional: bool = False) -> A.Call:
        if (scoped := bool(self.punct("("))) or self.peek("{"):
            scope = None
            if scoped:
                scope = [] if self.peek(")") else self.listed(self.name)
                self.need(")")
            self.need("{")
            inner = self.chain()
            self.need("}")
            return A.Call("", [], None, optional, inner, scope)
        name = self.reference()
        self.need("(")
        args = [] if self.peek(")") else self.listed(self.expr)
        self.need(")")
        return A.Call(name, args, self.yields() if self.word("YIELD") else None, optional)

    def match(self) -> A.Match:
        optional = bool(self.word("OPTIONAL"))
        self.need_word("MATCH")
        different = False
        if self.word("REPEATABLE"):
            self.one_of("ELEMENT", "ELEMENTS", "BINDINGS")
        elif self.word("DIFFERENT"):
            self.one_of("EDGE", "EDGES", "RELATIONSHIP", "RELATIONSHIPS")
            different = True
        paths = self.listed(self.path)
        if self.word("KEEP"):
            search, mode = self.prefix()
            for p in paths:
                p.search, p.mode = search if search != ("ALL", 0) else p.search, mode or p.mode
        where = self.expr() if self.word("WHERE") else None
        names = self.listed(self.name) if self.word("YIELD") else None
        return A.Match(paths, where, optional, different, names)

    # -- paths
    def prefix(self) -> tuple[tuple[str, int], str]:
        search, mode = ("ALL", 0), ""
        if self.word("ALL", "SHORTEST"):
            search = ("ALL SHORTEST", 1)
        elif self.word("ANY", "SHORTEST"):
            search = ("SHORTEST", 1)
        elif self.word("SHORTEST"):
            k = self.integer() if self.now.kind == "int" else 1
            mode = self.one_of("WALK", "TRAIL", "SIMPLE", "ACYCLIC")
            self.one_of("PATH", "PATHS")
            search = ("SHORTEST GROUP", k) if self.one_of("GROUP", "GROUPS") else ("SHORTEST", k)
        elif self.word("ANY"):
            search = ("ANY", self.integer() if self.now.kind == "int" else 1)
        elif self.now.upper == "ALL" and self.ahead().upper in ("WALK", "TRAIL", "SIMPLE", "ACYCLIC", "PATH", "PATHS"):
            self.i += 1
        mode = mode or self.one_of("WALK", "TRAIL", "SIMPLE", "ACYCLIC")
        self.one_of("PATH", "PATHS")
        return search, mode

    def path(self) -> A.Path:
        var = None
        if self.now.kind in ("word", "name") and self.ahead().text == "=" and self.ahead().kind == "punct":
            var = self.name()
            self.need("=")
        search, mode = self.prefix()
        if var is None and self.now.kind in ("word", "name") and self.ahead().text == "=" and self.ahead().kind == "punct":
            var = self.name()
            self.need("=")
        p = self.terms()
        p.var, p.search, p.mode = var, search, mode or "WALK"
        return p

    def terms(self) -> A.Path:
        first = A.Path(self.sequence())
        others, multiset = [], False
        while self.peek("|+|") or self.peek("|"):
            multiset = self.now.text == "|+|" or multiset
            self.i += 1
            others.append(A.Path(self.sequence()))
        return A.Path([], alternatives=[first, *others], multiset=multiset) if others else first

    def sequence(self) -> list:
        items = [self.element()]
        while True:
            edge = self.edge()
            if edge is None:
                if self.peek("("):
                    items.append(self.element())
                    continue
                return items
            items += [edge]
            if self.peek("("):
                items.append(self.element())

    def anonymous(self, kind: str) -> str:
        self.fresh += 1
        return f"_{kind}{self.fresh}"

    def element(self) -> A.Node | A.Group:
        """A node, or a parenthesised path with its quantifier."""
        self.need("(")
        if self.peek("(") or (self.now.kind in ("word", "name") and self.ahead().text == "=" and self.ahead(2).text == "("):
            inner = self.path()
            where = self.expr() if self.word("WHERE") else None
            self.need(")")
            low, high, _ = self.quantifier() or (1, 1, False)
            return A.Group(inner, low, high, where)
        if self.now.upper in ("WALK", "TRAIL", "SIMPLE", "ACYCLIC") and self.ahead().upper not in ("", "WHERE") or self.now.upper in ("WALK", "TRAIL", "SIMPLE", "ACYCLIC") and self.ahead().text == "(":
            inner = self.path()
            where = self.expr() if self.word("WHERE") else None
            self.need(")")
            low, high, _ = self.quantifier() or (1, 1, False)
            return A.Group(inner, low, high, where)
        var, label, props, where = self.filler(")")
        self.need(")")
        return A.Node(var or self.anonymous("n"), label, props, where, bool(var))

    def filler(self, close: str) -> tuple[str | None, A.Expr | None, list, A.Expr | None]:
        var = label = where = None
        props: list[tuple[str, A.Expr]] = []
        if self.now.kind in ("word", "name") and self.now.upper not in ("WHERE", "IS"):
            var = self.name()
        if self.punct(":") or self.word("IS"):
            label = self.label()
        if self.punct("{"):
            while not self.punct("}"):
                key = self.name()
                self.need(":")
                props.append((key, self.expr()))
                self.punct(",")
        if self.word("WHERE"):
            where = self.expr()
        return var, label, props, where

    def label(self, level: int = 0) -> A.Expr:
        if level == 2:
            if self.punct("!"):
                return A.Expr("not", [self.label(2)])
            if self.punct("("):
                inner = self.label()
                self.need(")")
                return inner
            if self.punct("%"):
                return A.Expr("any", [])
            return A.Expr("label", [self.name()])
        left = self.label(level + 1)
        while self.punct("|" if level == 0 else "&") or (level == 1 and self.peek(":") and self.ahead().kind == "word" and self.punct(":")):
            left = A.Expr("or" if level == 0 else "and", [left, self.label(level + 1)])
        return left

    def edge(self) -> A.Edge | None:
        """One of the seven kinds, long or abbreviated; undirected ones match either direction."""
        low = self.puncts("<", "-") or self.puncts("<", "~")
        if not low and not (self.peek("-") or self.peek("~")):
            return None
        if not low:
            self.i += 1
        body = self.punct("[")
        var, label, props, where = self.filler("]") if body else (None, None, [], None)
        if body:
            self.need("]")
            if not (self.punct("-") or self.punct("~")):
                raise self.fail("'-'")
        high = self.punct(">")
        out = A.Edge(var or self.anonymous("e"), "any" if low == high else "in" if low else "out", label, props, where, bool(var))
        if q := self.quantifier():
            out.low, out.high, out.optional = q
        return out

    def quantifier(self) -> tuple[int, int | None, bool] | None:
        if self.punct("*"):
            return 0, None, False
        if self.punct("+"):
            return 1, None, False
        if self.punct("?"):
            return 0, 1, True
        if self.peek("{") and (self.ahead().kind == "int" or self.ahead().text == ","):
            self.i += 1
            low = self.integer() if self.now.kind == "int" else 0
            if self.punct("}"):
                return low, low, False
            self.need(",")
            high = self.integer() if self.now.kind == "int" else None
            self.need("}")
            return low, high, False
        return None

    # -- results
    def items(self) -> tuple[bool, list[tuple[A.Expr, str]]]:
        if self.punct("*"):
            return True, []

        def one() -> tuple[A.Expr, str]:
            start = self.now.at
            e = self.expr()
            text = self.source[start : self.tokens[self.i - 1].at + len(self.tokens[self.i - 1].text)].strip()
            return e, self.name() if self.word("AS") else self.spelled(e, text)

        return False, self.listed(one)

    @staticmethod
    def spelled(e: A.Expr, text: str) -> str:
        if e.op == "var":
            return e.args[0]
        if e.op == "prop" and e.args[0].op == "var":
            return f"{e.args[0].args[0]}.{e.args[1]}"
        return " ".join(text.split())

    def result(self) -> A.Return:
        if self.word("FINISH"):
            return A.Return([], finish=True)
        self.need_word("RETURN")
        distinct = bool(self.word("DISTINCT")) or (self.word("ALL") and False)
        star, items = self.items()
        out = A.Return(items, star, bool(distinct))
        self.tail(out)
        return out

    def tail(self, out: A.Return) -> None:
        if self.word("GROUP", "BY"):
            if self.puncts("(", ")"):
                out.group = []
            else:
                out.group = self.listed(self.expr)
        if self.word("HAVING"):
            out.having = self.expr()
        if self.now.upper in ("ORDER", "LIMIT", "OFFSET", "SKIP"):
            out.order = self.order()

    def select(self, parts: list) -> A.Linear:
        self.need_word("SELECT")
        distinct = bool(self.word("DISTINCT")) or (self.word("ALL") and False)
        star, items = self.items()
        out = A.Return(items, star, bool(distinct))
        if self.word("FROM"):
            if self.now.upper != "MATCH" and not self.peek("{"):
                parts.append(A.Use(None if self.one_of("CURRENT_GRAPH") else self.reference()))
            while self.now.upper in ("MATCH", "OPTIONAL"):
                parts.append(self.match())
                self.punct(",")
            if self.punct("{"):
                parts.append(self.chain())
                self.need("}")
        if self.word("WHERE"):
            parts.append(A.Filter(self.expr()))
        self.tail(out)
        return A.Linear([*parts, out])

    def order(self) -> A.OrderBy:
        out = A.OrderBy()
        if self.word("ORDER", "BY"):
            out.keys = self.listed(self.sort_key)
        while word := self.one_of("OFFSET", "SKIP", "LIMIT"):
            value = self.primary()
            if word == "LIMIT":
                out.limit = value
                out.approximate = bool(self.word("APPROXIMATE"))
            else:
                out.offset = value
        return out

    def sort_key(self) -> A.SortKey:
        e = self.expr()
        up = self.one_of("ASC", "ASCENDING", "DESC", "DESCENDING")
        first = False
        if self.word("NULLS"):
            first = self.one_of("FIRST", "LAST") == "FIRST"
        return A.SortKey(e, not up.startswith("DESC"), first)

    # -- expressions
    def expr(self, least: int = 1) -> A.Expr:
        start = self.i
        if self.word("NOT"):
            left = A.Expr("not", [self.expr(4)])
        else:
            left = self.unary()
        while True:
            op = self.now.text if self.now.kind == "punct" else self.now.upper
            negated = op == "NOT" and self.ahead().upper in ("IN", "LIKE")
            if negated:
                op = self.ahead().upper
            level = PRECEDENCE.get(op)
            if level is None or level < least:
                left.text = left.text or " ".join(t.text for t in self.tokens[start : self.i])
                return left
            if op == "-" and self.peek("-", "[") or op == "<" and self.peek("<", "-", "["):
                return left
            self.i += 2 if negated else 1
            if op == "IS":
                left = self.is_test(left)
            elif op == "IN":
                left = A.Expr("in", [left, self.expr(level + 1)])
            else:
                left = A.Expr(op.lower() if op != "!=" else "<>", [left, self.expr(level + 1)])
            if negated:
                left = A.Expr("not", [left])

    def is_test(self, left: A.Expr) -> A.Expr:
        negated = bool(self.word("NOT"))
        kind = self.one_of("NULL", "TRUE", "FALSE", "UNKNOWN", "TYPED", "DIRECTED", "LABELED", "SOURCE", "DESTINATION")
        if not kind:
            raise self.fail("a test")
        args: list = [kind, left]
        if kind == "TYPED":
            args.append(self.type_name())
        elif kind == "LABELED":
            self.punct(":")
            args.append(self.label())
        elif kind in ("SOURCE", "DESTINATION"):
            self.need_word("OF")
            args.append(self.name())
        out = A.Expr("is", args)
        return A.Expr("not", [out]) if negated else out

    def unary(self) -> A.Expr:
        if self.punct("-"):
            return A.Expr("neg", [self.unary()])
        if self.punct("+"):
            return self.unary()
        e = self.primary()
        while True:
            if self.peek(".") and self.ahead().kind in ("word", "name"):
                self.i += 1
                e = A.Expr("prop", [e, self.name()])
            elif self.punct("["):
                e = A.Expr("at", [e, self.expr()])
                self.need("]")
            else:
                return e

    def type_name(self) -> str:
        words = [self.name()]
        if self.punct("("):
            words.append("(" + ",".join(str(x) for x in self.listed(self.integer)) + ")")
            self.need(")")
        elif words[0].upper() in ("LOCAL", "ZONED", "SIGNED", "UNSIGNED", "DOUBLE") and self.now.kind == "word" and self.now.upper not in _STOP:
            words.append(" " + self.name())
        self.word("NOT", "NULL")
        return "".join(words)

    def primary(self) -> A.Expr:
        t = self.now
        if t.kind == "int":
            return A.Expr("lit", [self.integer()])
        if t.kind == "float":
            self.i += 1
            return A.Expr("lit", [float(t.text.rstrip("fFdDmM").replace("_", ""))])
        if t.kind == "string":
            self.i += 1
            return A.Expr("lit", [t.text])
        if t.kind == "bytes":
            self.i += 1
            return A.Expr("lit", [bytes.fromhex("".join(t.text[2:-1].split()))])
        if t.kind == "param":
            self.i += 1
            return A.Expr("param", [t.text[1:]])
        if self.punct("("):
            e = self.expr()
            self.need(")")
            return e
        if self.peek("["):
            return A.Expr("list", self.bracketed())
        if self.punct("{"):
            return self.record()
        if t.kind == "name":
            self.i += 1
            return A.Expr("var", [t.text])
        if t.kind != "word" or t.upper in _STOP:
            raise self.fail("an expression")
        if t.upper in ("TRUE", "FALSE", "NULL", "UNKNOWN"):
            self.i += 1
            return A.Expr("lit", [{"TRUE": True, "FALSE": False}.get(t.upper)]) if t.upper != "UNKNOWN" else A.Expr("cast", [A.Expr("lit", [None]), "BOOL"])
        if t.upper in ("DATE", "TIME", "DATETIME", "TIMESTAMP", "DURATION") and self.ahead().kind == "string":
            self.i += 2
            return A.Expr("temporal", [t.upper, self.tokens[self.i - 1].text])
        if t.upper in ("LIST", "ARRAY", "VECTOR", "PATH") and self.ahead().text == "[":
            self.i += 1
            return A.Expr({"VECTOR": "vector", "PATH": "path"}.get(t.upper, "list"), self.bracketed())
        if t.upper == "RECORD" and self.ahead().text == "{":
            self.i += 2
            return self.record()
        if t.upper == "SESSION_USER":
            self.i += 1
            return A.Expr("user", [])
        if t.upper == "CASE":
            return self.case()
        if t.upper == "EXISTS" and self.ahead().text in ("{", "("):
            return self.exists()
        if t.upper == "CAST" and self.ahead().text == "(":
            self.i += 2
            e = self.expr()
            self.need_word("AS")
            out = A.Expr("cast", [e, self.type_name()])
            self.need(")")
            return out
        if self.ahead().text == "(" and self.ahead().kind == "punct":
            return self.function()
        self.i += 1
        return A.Expr("var", [t.text])

    def bracketed(self) -> list:
        self.need("[")
        out = [] if self.peek("]") else self.listed(self.expr)
        self.need("]")
        return out

    def record(self) -> A.Expr:
        fields = []
        while not self.punct("}"):
            key = self.name()
            self.need(":")
            fields.append((key, self.expr()))
            self.punct(",")
        return A.Expr("record", fields)

    def case(self) -> A.Expr:
        self.need_word("CASE")
        operand = None if self.now.upper == "WHEN" else self.expr()
        whens, other = [], None
        while self.word("WHEN"):
            cond = self.expr()
            self.need_word("THEN")
            whens.append((cond, self.expr()))
        if self.word("ELSE"):
            other = self.expr()
        self.need_word("END")
        return A.Expr("case", [operand, whens, other])

    def exists(self) -> A.Expr:
        self.i += 1
        close = "}" if self.now.text == "{" else ")"
        self.i += 1
        if self.now.upper == "MATCH":
            m = self.match()
        else:
            paths = self.listed(self.path)
            m = A.Match(paths, self.expr() if self.word("WHERE") else None)
        if self.now.upper == "RETURN":
            self.result()
        self.need(close)
        return A.Expr("exists", [m])

    def function(self) -> A.Expr:
        name = self.name().upper()
        self.need("(")
        if name in AGGREGATES:
            distinct = bool(self.word("DISTINCT")) or (self.word("ALL") and False)
            args = [A.Expr("star", [])] if self.punct("*") else self.listed(self.expr)
            self.need(")")
            return A.Expr("agg", [name, args, bool(distinct)])
        args = [] if self.peek(")") else self.listed(self.expr)
        self.need(")")
        return A.Expr("call", [name, args])


def parse(text: str) -> list[A.Query | A.Command]:
    """The statements of a text."""
    return Parser(text).program()
