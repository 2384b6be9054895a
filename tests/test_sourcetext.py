import random

from tamiz.operators import catalog as O
from tamiz.operators import sourcetext as T

LINES = "file string, line_no long, text string"


def frame(spark, **files):
    return spark.createDataFrame([(f, i + 1, t) for f, text in files.items() for i, t in enumerate(text.split("\n"))], LINES)


def by_characters(text):
    """Literals of one file as ``(line, text)``, read character by character."""
    out, i, line = [], 0, 1
    while i < len(text):
        c = text[i]
        if c == "\n":
            line += 1
        elif text.startswith("//", i):
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
            continue
        elif text.startswith('@"', i) or c == '"':
            verbatim, begun, i, got = c == "@", line, i + 1 + (c == "@"), ""
            while i < len(text):
                if verbatim and text.startswith('""', i):
                    got, i = got + '"', i + 1
                elif not verbatim and text[i] == "\\" and text[i + 1:i + 2] not in ("", "\n"):
                    got, i = got + (text[i + 1] if text[i + 1] == '"' else text[i:i + 2]), i + 1
                elif text[i] == '"' or (not verbatim and text[i] == "\n"):
                    break
                else:
                    line += text[i] == "\n"
                    got += text[i]
                i += 1
            out.append((begun, got))
            line += text[i:i + 1] == "\n"
        i += 1
    return sorted(out)


def test_literals_equal_a_reading_by_characters(spark):
    draw = random.Random(7)
    pieces = ['@"', '"', '""', "\n", "a", " x = ", "\\\"", "// c", "@\"b\nc\"", ";", '"d"', "\n\n"]
    texts = {f"f{k}": "".join(draw.choice(pieces) for _ in range(draw.randint(0, 40))) for k in range(300)}
    got = {}
    for r in T.source_literals(frame(spark, **texts)).collect():
        got.setdefault(r["file"], []).append((r["line_no"], r["text"]))
    for name, text in texts.items():
        assert sorted(got.get(name, [])) == by_characters(text), repr(text)


def test_statements(spark):
    code = ('var q = @"SELECT ""x"" FROM ORDERS o', '  JOIN rs.CUSTOMER c ON c.ID', '    = o.CUSTOMER_ID', '  WHERE o.A = 1";', "char c = '\"'; // \"SELECT ghost FROM GHOST",
            'var sb = new StringBuilder();', 'sb.Append("SELECT * FROM LINES l").Append(', '   ", PARTS p");', 'sb.AppendLine(@"WHERE l.PART = p.ID");', 'Log("nothing here");',
            'sb = new StringBuilder(64);', 'sb.Append("UPDATE STOCK SET N = 0");', 'Run($"insert into LOG values (\\"a\\")");')
    found = T.source_statements(frame(spark, a="\n".join(code), b="", c='"no words"'))
    got = {(r["file"], r["line_no"], r["kind"], r["sql"]) for r in found.collect()}
    assert got == {("a", 1, "literal", 'SELECT "x" FROM ORDERS o\n  JOIN rs.CUSTOMER c ON c.ID\n    = o.CUSTOMER_ID\n  WHERE o.A = 1'),
                   ("a", 7, "literal", "SELECT * FROM LINES l"), ("a", 7, "builder", "SELECT * FROM LINES l , PARTS p WHERE l.PART = p.ID"),
                   ("a", 12, "literal", "UPDATE STOCK SET N = 0"), ("a", 13, "literal", 'insert into LOG values ("a")')}
    assert {r["table"]: r["statements"] for r in T.named_tables(found).collect()} == {"ORDERS": 1, "CUSTOMER": 1, "LINES": 2, "STOCK": 1, "LOG": 1}
    assert {tuple(r)[:6] for r in O.infer_relations(found).collect()} == {("CUSTOMER", "ID", "ORDERS", "CUSTOMER_ID", "JoinClause", "high")}


def test_nulls_and_no_lines(spark):
    empty = spark.createDataFrame([], LINES)
    assert T.source_statements(empty).count() == 0 and T.named_tables(T.source_statements(empty)).count() == 0
    rows = [("a", 1, '@"SELECT'), ("a", 2, None), ("a", 3, 'FROM X"')]
    assert [tuple(r) for r in T.source_statements(spark.createDataFrame(rows, LINES)).collect()] == [("a", 1, "literal", "SELECT\n\nFROM X")]


def test_a_long_file_of_many_chunks(spark):
    """State is carried over chunks and spans: a literal stays open over 200,000 lines."""
    lines = spark.range(1, 200001).selectExpr("'f' AS file", "id * 400 AS line_no", "CASE WHEN id = 1 THEN 'q(@\"SELECT' WHEN id = 200000 THEN 'FROM X\"); r(\"FROM Y\")' ELSE 'z' END AS text")
    got = {r["line_no"]: r["n"] for r in T.source_statements(lines).selectExpr("line_no", "length(sql) AS n").collect()}
    assert got == {400: 6 + 2 * 199998 + 7, 80000000: 6}


def test_advice_spreads_the_statements_of_one_table(spark):
    ask = spark.range(20000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN 'SELECT A FROM SMALL WHERE A = 1' ELSE 'SELECT A FROM BIG WHERE B = 1' END AS sql")
    layout = spark.createDataFrame([("BIG", ["a"]), ("SMALL", ["a"])], "table string, columns array<string>")
    sizes = spark.createDataFrame([("BIG", 1000, 2), ("SMALL", 1000, 2)], "table string, rows long, n_columns int")
    got = O.access_advice(ask, layout, sizes, large=100)
    assert [tuple(r) for r in got.groupBy("table", "finding").count().collect()] == [("BIG", "no supporting column", 18000)]
    assert "cell" in got._jdf.queryExecution().executedPlan().toString()
