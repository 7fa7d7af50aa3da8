"""Queries of the dialect over the harbour, single expressions, refusals and the lexer."""

import datetime
import random

import pytest

from granary.dialect.emit import like_pattern
from granary.dialect.lexer import DialectError, tokenize
from granary.dialect.parser import parse_query
from granary.plans.engine import Engine
from tests.harbour import column, harbour, one, rows


@pytest.fixture(scope="module")
def e(spark):
    return harbour(spark)


QUERIES = [
    ("SELECT title, label FROM ships, quays WHERE quay = no AND side <> 'north' ORDER BY title", [("Pelagia", "Basalt"), ("Quokka", "Basalt"), ("Riverine", "Drift")]),
    ("SELECT sign FROM ships LEFT JOIN quays ON no = quay AND depth > 5 WHERE label IS NULL ORDER BY sign", [("RI4",), ("SA5",), ("TE6",)]),
    ("SELECT label, SUM(crew) FROM ships RIGHT JOIN quays ON no = quay GROUP BY label ORDER BY 2 DESC, 1", [("Basalt", 66), ("Drift", 33), ("Amber", 24), ("Cobalt", None)]),
    ("SELECT a.label, b.label FROM quays a JOIN quays b ON a.depth > b.depth WHERE b.label = 'drift' ORDER BY 1", [("Amber", "Drift"), ("Basalt", "Drift")]),
    ("SELECT rig, COUNT(quay), MAX(launched) latest FROM ships GROUP BY 1 HAVING latest >= '2010-01-01' ORDER BY rig DESC", [("tug", 1, datetime.date(2020, 11, 1)), ("tanker", 1, datetime.date(2017, 1, 25))]),
    ("SELECT GROUP_CONCAT(title ORDER BY tons SEPARATOR ' < ') FROM ships WHERE rig <> 'TANKER'", [("Tern < Quokka < Riverine < Pelagia",)]),
    ("SELECT rig, SUM(crew) FROM ships GROUP BY rig WITH ROLLUP", [("ferry", 94), ("tanker", 43), ("tug", 5), (None, 142)]),
    ("SELECT title FROM ships s WHERE crew > (SELECT AVG(crew) FROM ships x WHERE x.rig = s.rig) ORDER BY 1", [("Ostrava",), ("Pelagia",), ("Quokka",)]),
    ("SELECT label FROM quays WHERE no NOT IN (SELECT quay FROM ships WHERE quay IS NOT NULL)", [("Cobalt",)]),
    ("SELECT label FROM quays q WHERE EXISTS (SELECT * FROM ships WHERE quay = q.no AND rig = 'tug')", [("Basalt",)]),
    ("SELECT sign FROM ships WHERE tons >= ALL (SELECT tons FROM ships)", [("OS1",)]),
    ("SELECT side FROM quays UNION SELECT 'SOUTH' UNION SELECT 'hill' ORDER BY side", [("east",), ("hill",), ("north",), ("south",)]),
    ("SELECT quay FROM ships WHERE quay IS NOT NULL INTERSECT SELECT no FROM quays WHERE depth < 9 ORDER BY 1", [(2,), (4,)]),
    ("SELECT no FROM quays EXCEPT SELECT quay FROM ships", [(3,)]),
    ("WITH RECURSIVE doubled (x) AS (SELECT 3 UNION ALL SELECT x * 2 FROM doubled WHERE x < 40) SELECT x FROM doubled ORDER BY x DESC LIMIT 2", [(48,), (24,)]),
    ("SELECT sign, RANK() OVER (PARTITION BY rig ORDER BY crew DESC) r FROM ships WHERE rig <> 'tug' ORDER BY sign", [("OS1", 1), ("PE2", 1), ("RI4", 2), ("SA5", 2)]),
    ("SELECT sign, SUM(crew) OVER (ORDER BY sign) FROM ships ORDER BY sign LIMIT 2, 2", [("QU3", 90), ("RI4", 123)]),
    ("SELECT sign, LEAD(title) OVER (ORDER BY launched) FROM ships WHERE rig = 'ferry' ORDER BY 1", [("PE2", "Riverine"), ("RI4", None)]),
    ("SELECT title FROM ships WHERE title RLIKE '^[p-r].*a$' ORDER BY 1", [("Pelagia",), ("Quokka",)]),
    ("SELECT title FROM ships WHERE launched NOT BETWEEN '2000-01-01' AND '2015-01-01' AND title LIKE '%a%' ORDER BY 1", [("Pelagia",), ("Quokka",), ("Sable Star",)]),
    ("SELECT MAX(n) FROM (SELECT COUNT(*) n FROM ships GROUP BY quay) per_quay", [(2,)]),
]


@pytest.mark.parametrize("sql, want", QUERIES)
def test_queries(e, sql, want):
    assert rows(e, sql) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("CONCAT_WS('+', 'north', NULL, 'east', '')", "north+east+"),
        ("SUBSTR('harbour', -4, 3)", "bou"),
        ("SUBSTRING('harbour' FROM 5 FOR 9)", "our"),
        ("LEFT('quay', 0)", ""),
        ("TRIM(BOTH '-' FROM '--pier-7--')", "pier-7"),
        ("RPAD('knot', 7, '=-')", "knot=-="),
        ("RPAD('knot', 6, '')", None),
        ("LOCATE('O', 'boatload', 3)", 6),
        ("FORMAT(-98765.4321, 1)", "-98,765.4"),
        ("-17 DIV 5", -3),
        ("17 % -5", 2),
        ("0 / 0", None),
        ("LEAST(8, 2.5, 3)", 2.5),
        ("LEAST('b', NULL)", None),
        ("IFNULL(NULLIF('Pier ', 'PIER'), 'same')", "same"),
        ("'port' < 'Quay'", 1),
        ("'7 knots' * 2", 14.0),
        ("DATE_SUB('2024-03-31', INTERVAL 1 MONTH)", datetime.date(2024, 2, 29)),
        ("'2023-12-31 22:15:00' + INTERVAL 2 HOUR", datetime.datetime(2024, 1, 1, 0, 15)),
        ("DATE_FORMAT('2025-02-03 09:07:05', '%a %e %b %y, %H.%i')", "Mon 3 Feb 25, 09.07"),
        ("STR_TO_DATE('July 4, 1997', '%M %e, %Y')", datetime.date(1997, 7, 4)),
        ("TIMESTAMPDIFF(DAY, '2024-02-27', '2024-03-01')", 3),
        ("YEARWEEK('2024-01-07')", 202401),
        ("CAST(MAKETIME(-2, 5, 9) AS CHAR)", "-02:05:09"),
        ("MAKETIME(2, 5, 60)", None),
        ("MICROSECOND('2024-05-06 07:08:09.0421')", 42100),
        ("CAST(TIME('07:08:09.5') AS CHAR)", "07:08:09.500000"),
        ("CAST(TIMEDIFF('2024-01-02 00:00:00.9', '2024-01-01 23:59:59.1') AS CHAR)", "00:00:01"),
        ("TIME('low tide')", None),
        ("TIME_FORMAT('19:20:21', '%h:%i %p')", "07:20 PM"),
        ("CAST('-8.5' AS SIGNED)", -9),
        ("CAST(-3 AS UNSIGNED)", 18446744073709551613),
        ("""JSON_EXTRACT('[{"k": [1, {"z": 5}]}]', '$[0].k[1].z')""", "5"),
        ("""JSON_UNQUOTE('"salt\\\\nsea"')""", "salt\nsea"),
        ("REGEXP_REPLACE('tide 3.2m at 14h', '[0-9.]+', 'N')", "tide Nm at Nh"),
        ("REGEXP_INSTR('dock 12, dock 34', '[0-9]+', 1, 2)", 15),
        (r"'50%' LIKE '50\\%'", 1),
        (r"'50x' LIKE '50\\%'", 0),
        ("NULL <=> 0", 0),
        ("('a', 2) IN (('A', 2), ('b', 3))", 1),
        ("3 NOT IN (1, NULL)", None),
        ("6 ^ 5", 3),
        ("1 XOR NULL", None),
        ("0 AND NULL", 0),
        ("SOUNDEX('Schooner')", "S560"),
        ("0xFF + 5", 260),
        ("x'6D6f'", "mo"),
        ("'sea' 'wall'", "seawall"),
        ("9223372036854775807 + 1", 9223372036854775808),
        ("-9223372036854775807 * 100", -922337203685477580700),
    ],
)
def test_expressions(e, text, want):
    got = one(e, f"SELECT {text}")
    assert got == want or (want is not None and got is not None and not isinstance(want, (str, datetime.date)) and float(got) == float(want))


def test_whole_numbers_do_not_wrap(e):
    e.run("CREATE TABLE wide (id INT PRIMARY KEY, n BIGINT); INSERT INTO wide VALUES (1, 9223372036854775807), (2, 9223372036854775807)")
    assert column(e, "SELECT n + id FROM wide ORDER BY id") == [None, None] and column(e, "SELECT n - id FROM wide ORDER BY id")[0] == 9223372036854775806
    assert one(e, "SELECT SUM(CAST(n AS DECIMAL(38, 0))) FROM wide") == 2 * (2**63 - 1) and one(e, "SELECT SUM(n) FROM wide WHERE id = 1") == 2**63 - 1
    assert one(e, "SELECT SUM(n) FROM wide WHERE id > 5") is None
    with pytest.raises(Exception, match="past BIGINT"):
        e.sql("SELECT SUM(n) FROM wide").collect()
    e.run("DROP TABLE wide")


def test_variables(e):
    e.run("SET @deep = 4, @name = 'pier'")
    assert rows(e, "SELECT @deep + 0.5, CONCAT(@name, @deep), @unset") == [(4.5, "pier4", None)] or float(one(e, "SELECT @deep + 0.5")) == 4.5


@pytest.mark.parametrize(
    "text, why",
    [
        ("SELECT no FROM quays a JOIN quays b ON a.no = b.no", "ambiguous"),
        ("SELECT mast FROM ships", "Unknown column"),
        ("SELECT rig FROM ships WHERE COUNT(*) = 2 GROUP BY rig", "HAVING"),
        ("SELECT * FROM cranes", "No table"),
        ("SELECT COUNT(rig, crew) FROM ships", "DISTINCT"),
        ("SELECT ANCHOR(4)", "no function"),
        ("SELECT REPEAT('x')", "arguments"),
        ("SELECT sign, rig FROM ships UNION SELECT no FROM quays", "columns"),
        ("SELECT rig FROM ships ORDER BY 4", "column number"),
        ("SELECT DENSE_RANK() FROM quays", "OVER"),
        ("SELECT MD5(label) FROM quays", "SHA2"),
        ("CALL unload(3)", "procedures"),
        ("SELECT 1 FROM ships FULL JOIN quays ON quay = no", "FULL"),
        ("SELECT crew INTO @c FROM ships", "INTO"),
        ("DROP DATABASE docks", "DROP DATABASE"),
        ("SELECT sign FROM ships WHERE crew = ?", "Placeholders"),
    ],
)
def test_refusals(e, text, why):
    with pytest.raises(DialectError, match=why):
        e.sql(text)


def test_a_single_value_has_one_row(e):
    with pytest.raises(Exception, match="(?i)more than one row|SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        e.sql("SELECT (SELECT label FROM quays WHERE side = 'south')").collect()


def test_views_show_what_is_there(spark):
    e = harbour(spark)
    e.run("CREATE VIEW crowded (s, c) AS SELECT sign, crew FROM ships WHERE crew > 20")
    assert column(e, "SELECT s FROM crowded ORDER BY c DESC") == ["PE2", "RI4", "OS1"]
    e.run("UPDATE ships SET crew = 20 WHERE rig = 'ferry'; CREATE OR REPLACE VIEW calm AS SELECT s FROM crowded")
    assert column(e, "SELECT * FROM calm") == ["OS1"]
    for sql, why in (("CREATE VIEW calm AS SELECT 2", "is taken"), ("DELETE FROM calm", "view"), ("INSERT INTO crowded VALUES ('a', 1)", "view")):
        with pytest.raises(DialectError, match=why):
            e.run(sql)
    e.run("DROP VIEW calm, crowded")
    with pytest.raises(DialectError, match="No table"):
        e.sql("SELECT * FROM calm")


def test_depth_has_a_bound(spark):
    e = Engine(spark)
    text = "SELECT 0 AS z"
    for k in range(44):
        text = f"SELECT z FROM ({text}) t{k}"
    with pytest.raises(DialectError, match="nest"):
        e.sql(text)


def test_lexer_never_crashes_otherwise():
    pieces = ["SELECT", "'a", '"', "`", "/*", "--", "0x", "1e", "@", "@@", "(", ")", "->>", "\\", "\0", "é", "\n", ";", "*", "IN", "BETWEEN"]
    rng = random.Random(4)
    for _ in range(3000):
        text = " ".join(rng.choices(pieces, k=rng.randint(0, 8)))
        try:
            parse_query(text)
        except DialectError:
            pass


def test_tokens_keep_their_places():
    text = "SELECT `a b`, 'x''y' -- end\n FROM t"
    held = tokenize(text)
    assert [t.text for t in held] == ["SELECT", "a b", ",", "x'y", "FROM", "t", ""]
    assert text[held[1].start : held[1].stop] == "`a b`"


def test_like_patterns():
    assert like_pattern("a|_b%", "|") == r"a\_b%" and like_pattern("a\\", "|") == "a\\\\"
