"""The lexer, the parser and what statements refuse."""

import pytest

from quarry.errors import SqlError
from quarry.functions import types
from quarry.plans import tree as t
from quarry.plans.parser import parse, tokens


def test_tokens_know_their_place():
    got = [(x.kind, x.text, x.line, x.column) for x in tokens("select a.b -- rest\n <> 'it''s' 1.5 1. x")][:9]
    assert got == [("keyword", "select", 1, 1), ("name", "a", 1, 8), ("symbol", ".", 1, 9), ("name", "b", 1, 10), ("symbol", "<>", 2, 2), ("string", "'it''s'", 2, 5), ("real", "1.5", 2, 13), ("int", "1", 2, 17), ("symbol", ".", 2, 18)]


@pytest.mark.parametrize("text", ["SELECT * FROM t WHERE a = 'x", "SELECT # FROM t", "SELECT a FROM t WHERE b = 'a\nb'"])
def test_lexical_errors(text):
    with pytest.raises(SqlError) as e:
        parse(text)
    assert e.value.kind == "lexical" and e.value.line == 1


def test_precedence_and_parentheses():
    (s,) = parse("SELECT * FROM t WHERE a = 1 OR b < -2 AND c <> 'x'")
    assert s.where == t.Any((t.Compare(t.Name("a"), "=", 1), t.All((t.Compare(t.Name("b"), "<", -2), t.Compare(t.Name("c"), "!=", "x")))))
    (s,) = parse("select * from t where (a = 1 or b = 2) and c between 1.5 and 2;")
    assert isinstance(s.where, t.All) and s.where.parts[1] == t.Between(t.Name("c"), 1.5, 2)


def test_every_statement():
    program = """CREATE TABLE t (id INT PRIMARY KEY, s VARCHAR(5), p POINT, d DATE, b BOOL, f FLOAT) USING HEAP;
    CREATE INDEX ON t (p) USING RTREE; CREATE INDEX ON t (id) USING BTREE CLUSTERED; DROP TABLE t;
    INSERT INTO t VALUES (1, 'a', POINT(-1, 2.5), 3, TRUE, -1.5); DELETE FROM t WHERE id = 1; UPDATE t SET s = 'b', f = 2 WHERE id = 1;
    BEGIN TRANSACTION; END TRANSACTION; ROLLBACK; EXPLAIN SELECT * FROM t; EXPLAIN ANALYZE SELECT COUNT(*), AVG(t.f) FROM t GROUP BY s;
    SELECT a.x FROM a JOIN b ON a.x = b.y WHERE distancia(p, POINT(1, 2)) < 3 AND dentro_de(p, POLYGON(POINT(0,0), POINT(1,0), POINT(1,1)))
    ORDER BY DISTANCE_GEODESIC(p, POINT(0, 0)) DESC LIMIT 0"""
    got = parse(program)
    assert [type(x).__name__ for x in got] == "CreateTable CreateIndex CreateIndex DropTable Insert Delete Update Begin End Rollback Explain Explain Select".split()
    assert got[4].values == (1, "a", t.Point(-1.0, 2.5), 3, True, -1.5)
    assert got[-1].limit == 0 and got[-1].descending and got[-1].order.metric == "geodesic"
    assert "Select" in t.dump(got[-1])


@pytest.mark.parametrize(
    "text",
    """SELECT FROM t|SELECT * FROM t trailing|SELECT * FROM t WHERE a = b|SELECT * FROM t WHERE 1 = a|DELETE FROM t|UPDATE t SET a = 1|CREATE TABLE t (a INT)|
    CREATE INDEX ON t (a) USING HASH CLUSTERED|SELECT SUM(*) FROM t|EXPLAIN EXPLAIN SELECT * FROM t|COMMIT|SELECT * FROM t LIMIT -1|SELECT * FROM t LIMIT 1.5|
    SELECT date FROM t|INSERT INTO t VALUES ()|CREATE TABLE t (a VARCHAR(0) PRIMARY KEY) USING HEAP|SELECT * FROM t WHERE dentro_de(p, POLYGON(POINT(0,0), POINT(1,1)))|
    SELECT * FROM t WHERE NOT a = 1|SELECT a AS b FROM t|SELECT * FROM a JOIN b ON a.x < b.y""".replace("\n", "").split("|"),
)
def test_syntactic_errors(text):
    with pytest.raises(SqlError) as e:
        parse(text.strip())
    assert e.value.kind == "syntactic" and e.value.line >= 1


def test_type_names():
    for name in "int integer int4 smallint int2 bigint int8 float real float4 bool boolean char oid xid cid date timestamp timestampz time timetz interval money uuid name point char(3) varchar(9) bit(4) text string str json jsonb xml varbit bytea".split() + ["double precision", "float8"]:
        types.resolve(name)
    for name in ("varchar(0)", "varchar(-1)", "decimal", "array"):
        with pytest.raises(TypeError):
            types.resolve(name)
    assert types.cut("añb", 2) == "a" and types.cut("añb", 3) == "añ" and types.cut("a\0\0", None) == "a"
