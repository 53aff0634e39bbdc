"""Lexer and parser of the dialect. Keywords are not case-sensitive, names are."""

from __future__ import annotations

import re
from dataclasses import dataclass

from quarry.errors import SqlError
from quarry.functions.spatial import EUCLIDEAN, GEODESIC
from quarry.plans import tree as t

#: Words that cannot be names (fixed values).
KEYWORDS = frozenset(
    """CREATE DROP TABLE INDEX ON USING HEAP SEQUENTIAL BTREE HASH BITMAP RTREE CLUSTERED PRIMARY KEY INT FLOAT BOOL DATE VARCHAR
    POINT POLYGON SELECT FROM JOIN WHERE GROUP BY ORDER ASC DESC LIMIT INSERT INTO VALUES DELETE UPDATE SET AND OR BETWEEN TRUE
    FALSE COUNT SUM AVG MIN MAX BEGIN TRANSACTION END ROLLBACK EXPLAIN ANALYZE DISTANCIA DISTANCIA_EUCLIDIANA
    DISTANCIA_GEODESICA DENTRO_DE""".split()
)
DISTANCES = {"DISTANCIA": EUCLIDEAN, "DISTANCIA_EUCLIDIANA": EUCLIDEAN, "DISTANCIA_GEODESICA": GEODESIC, "DISTANCE": EUCLIDEAN, "DISTANCE_EUCLIDEAN": EUCLIDEAN, "DISTANCE_GEODESIC": GEODESIC}
WITHIN = {"DENTRO_DE", "WITHIN"}

LEXEMES = re.compile(
    r"""(?P<space>\s+|--[^\n]*)|(?P<real>\d+\.\d+)|(?P<int>\d+)|(?P<word>[^\W\d]\w*)|(?P<string>'(?:[^'\n]|'')*')|(?P<symbol><=|<>|>=|!=|[,;().*=<>-])"""
)


@dataclass(frozen=True)
class Token:
    kind: str  # int, real, string, name, keyword, symbol, end
    text: str
    line: int
    column: int


def tokens(text: str) -> list[Token]:
    out, at, line, start = [], 0, 1, 0
    while at < len(text):
        m = LEXEMES.match(text, at)
        if not m:
            what = "a string is not closed" if text[at] == "'" else f"unexpected character {text[at]!r}"
            raise SqlError("lexical", what, line, at - start + 1)
        kind, word = m.lastgroup, m[0]
        if kind == "word":
            kind = "keyword" if word.upper() in KEYWORDS else "name"
        if kind != "space":
            out.append(Token(kind, word, line, at - start + 1))
        if "\n" in word:
            line += word.count("\n")
            start = at + word.rindex("\n") + 1
        at = m.end()
    return [*out, Token("end", "", line, at - start + 1)]


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def fail(self, wanted: str) -> SqlError:
        found = self.now.text or "the end"
        return SqlError("syntactic", f"{wanted} expected, found {found}", self.now.line, self.now.column)

    def take(self) -> Token:
        self.at += 1
        return self.tokens[self.at - 1]

    def is_word(self, *words: str) -> bool:
        return self.now.kind == "keyword" and self.now.text.upper() in words

    def is_symbol(self, *symbols: str) -> bool:
        return self.now.kind == "symbol" and self.now.text in symbols

    def opt(self, *words: str) -> str | None:
        """The next token, if it is one of these keywords or symbols."""
        return self.take().text.upper() if self.is_word(*words) or self.is_symbol(*words) else None

    def need(self, *words: str) -> str:
        if (found := self.opt(*words)) is None:
            raise self.fail(" or ".join(words))
        return found

    def name(self) -> str:
        if self.now.kind != "name":
            raise self.fail("a name")
        return self.take().text

    def listed(self, one) -> tuple:
        out = [one()]
        while self.opt(","):
            out.append(one())
        return tuple(out)

    def enclosed(self, one):
        self.need("(")
        out = one()
        self.need(")")
        return out

    def program(self) -> list:
        out = []
        while self.now.kind != "end":
            out.append(self.statement())
            if self.now.kind != "end":
                self.need(";")
        return out

    def statement(self):
        if self.opt("EXPLAIN"):
            analyze = bool(self.opt("ANALYZE"))
            if self.is_word("EXPLAIN"):
                raise self.fail("a statement that is no EXPLAIN")
            return t.Explain(self.statement(), analyze)
        word = self.need("CREATE", "DROP", "SELECT", "INSERT", "DELETE", "UPDATE", "BEGIN", "END", "ROLLBACK")
        if word == "CREATE":
            return self.create_table() if self.need("TABLE", "INDEX") == "TABLE" else self.create_index()
        if word == "DROP":
            self.need("TABLE")
            return t.DropTable(self.name())
        if word == "SELECT":
            return self.select()
        if word == "INSERT":
            self.need("INTO")
            table = self.name()
            self.need("VALUES")
            return t.Insert(table, self.enclosed(lambda: self.listed(self.literal)))
        if word == "DELETE":
            self.need("FROM")
            return t.Delete(self.name(), self.where())
        if word == "UPDATE":
            table = self.name()
            self.need("SET")
            return t.Update(table, self.listed(self.change), self.where())
        if word in ("BEGIN", "END"):
            self.need("TRANSACTION")
        return {"BEGIN": t.Begin, "END": t.End, "ROLLBACK": t.Rollback}[word]()

    def where(self):
        self.need("WHERE")
        return self.condition()

    def change(self) -> tuple[str, object]:
        name = self.name()
        self.need("=")
        return name, self.literal()

    def create_table(self):
        table = self.name()
        columns = self.enclosed(lambda: self.listed(self.column))
        self.need("USING")
        return t.CreateTable(table, columns, self.need("HEAP", "SEQUENTIAL"))

    def column(self) -> tuple[str, str, bool]:
        name, kind = self.name(), self.need("INT", "FLOAT", "BOOL", "DATE", "VARCHAR", "POINT").lower()
        if kind == "varchar":
            length = self.enclosed(self.whole)
            if not length:
                raise SqlError("syntactic", "the length of VARCHAR must be positive", self.now.line, self.now.column)
            kind = f"varchar({length})"
        key = bool(self.opt("PRIMARY"))
        if key:
            self.need("KEY")
        return name, kind, key

    def whole(self) -> int:
        if self.now.kind != "int":
            raise self.fail("a whole number")
        return int(self.take().text)

    def create_index(self):
        self.need("ON")
        table = self.name()
        column = self.enclosed(self.name)
        self.need("USING")
        kind = self.need("BTREE", "HASH", "BITMAP", "RTREE")
        if self.is_word("CLUSTERED") and kind in ("HASH", "BITMAP"):
            raise SqlError("syntactic", f"an index by {kind} cannot be CLUSTERED", self.now.line, self.now.column)
        return t.CreateIndex(table, column, kind, bool(self.opt("CLUSTERED")))

    def select(self):
        items = None if self.opt("*") else self.listed(self.item)
        self.need("FROM")
        table, join, where, group, order, down, limit = self.name(), None, None, None, None, False, None
        if self.opt("JOIN"):
            other = self.name()
            self.need("ON")
            left = self.ref()
            self.need("=")
            join = (other, left, self.ref())
        if self.opt("WHERE"):
            where = self.condition()
        if self.opt("GROUP"):
            self.need("BY")
            group = self.ref()
        if self.opt("ORDER"):
            self.need("BY")
            order = self.distance() if self.calls(DISTANCES) else self.ref()
            down = self.opt("ASC", "DESC") == "DESC"
        if self.opt("LIMIT"):
            limit = self.whole()
        return t.Select(items, table, join, where, group, order, down, limit)

    def item(self):
        if self.is_word("COUNT", "SUM", "AVG", "MIN", "MAX"):
            function = self.take().text.lower()
            self.need("(")
            if self.is_symbol("*") and function != "count":
                raise self.fail("a column")
            argument = None if self.opt("*") else self.ref()
            self.need(")")
            return t.Aggregate(function, argument)
        return self.ref()

    def ref(self) -> t.Name:
        line, at = self.now.line, self.now.column
        first = self.name()
        return t.Name(self.name(), first, line, at) if self.opt(".") else t.Name(first, None, line, at)

    def condition(self):
        parts = [self.both()]
        while self.opt("OR"):
            parts.append(self.both())
        return t.Any(tuple(parts)) if len(parts) > 1 else parts[0]

    def both(self):
        parts = [self.simple()]
        while self.opt("AND"):
            parts.append(self.simple())
        return t.All(tuple(parts)) if len(parts) > 1 else parts[0]

    def calls(self, names) -> bool:
        after = self.tokens[min(self.at + 1, len(self.tokens) - 1)]
        return self.now.kind in ("keyword", "name") and self.now.text.upper() in names and after.text == "("

    def simple(self):
        if self.is_symbol("("):
            return self.enclosed(self.condition)
        if self.calls(WITHIN):
            self.take()
            return self.enclosed(self.within)
        left = self.distance() if self.calls(DISTANCES) else self.ref()
        if isinstance(left, t.Name) and self.opt("BETWEEN"):
            low = self.literal()
            self.need("AND")
            return t.Between(left, low, self.literal())
        op = self.need("=", "!=", "<>", "<", "<=", ">", ">=")
        return t.Compare(left, "!=" if op == "<>" else op, self.literal())

    def within(self):
        column = self.ref()
        self.need(",")
        self.need("POLYGON")
        vertices = self.enclosed(lambda: self.listed(self.point))
        if len(vertices) < 3:
            raise self.fail("a polygon of at least three points")
        return t.Within(column, vertices)

    def distance(self):
        metric = DISTANCES[self.take().text.upper()]
        operand = lambda: self.point() if self.is_word("POINT") else self.ref()
        left, right = self.enclosed(lambda: (operand(), self.need(","), operand()))[::2]
        return t.Distance(metric, left, right)

    def number(self) -> int | float:
        sign = -1 if self.opt("-") else 1
        if self.now.kind not in ("int", "real"):
            raise self.fail("a number")
        token = self.take()
        return sign * (int(token.text) if token.kind == "int" else float(token.text))

    def point(self) -> t.Point:
        self.need("POINT")
        x, _, y = self.enclosed(lambda: (self.number(), self.need(","), self.number()))
        return t.Point(float(x), float(y))

    def literal(self):
        if self.now.kind == "string":
            return self.take().text[1:-1].replace("''", "'")
        if self.is_word("TRUE", "FALSE"):
            return self.take().text.upper() == "TRUE"
        if self.is_word("POINT"):
            return self.point()
        if self.now.kind in ("int", "real") or self.is_symbol("-"):
            return self.number()
        raise self.fail("a literal")


def parse(text: str) -> list:
    """The statements of a program, separated by semicolons."""
    return Parser(text).program()
