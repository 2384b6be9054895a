import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from tamiz.functions import personal as P
from tamiz.functions import sqltext as S
from tamiz.operators import guard
from tamiz.operators import personal as O

KEY = b"k" * 32
SCHEMA = "table string, column string, type string, nullable boolean, pk_flag boolean, pk_pos int, fk boolean, pii boolean, safe boolean"


@pytest.fixture(scope="module")
def catalog(spark):
    row = lambda t, c, ty, **f: (t, c, ty, True, f.get("pk"), f.get("pos"), f.get("fk"), f.get("pii"), f.get("safe"))
    return spark.createDataFrame([
        row("DEUDA", "IDDEUDOR", "NUMBER(10)", pk=True), row("DEUDA", "NOMBRE", "VARCHAR2(60)"), row("DEUDA", "DNI", "VARCHAR2(9)"),
        row("DEUDA", "TELEFONO", "NUMBER(9)"), row("DEUDA", "SALDO", "NUMBER(12,2)"), row("DEUDA", "FECHA_ALTA", "DATE"),
        row("DEUDA", "OBSERVACIONES", "VARCHAR2(4000)"), row("DEUDA", "COD_POSTAL", "VARCHAR2(5)", safe=True),
        row("DEUDA", "REFERENCIA", "NUMBER(10)", pii=True), row("IDIOMA", "TEXTO", "VARCHAR2(200)")], SCHEMA)


POLICY = O.Policy.build("enforce", parametric=["IDIOMA"])


SHAPES = {"12345678Z": "dni", " 12345678z ": "dni", "12345678I": None, "X1234567L": "nie", "x1234567l": "nie", "W1234567L": None, "612345678": "telefono",
          "+34612345678": "telefono", "+34512345678": None, "512345678": None, "ES9121000418450200051332": "iban", "ES91": None, "nadie@ejemplo.test": "email",
          "nadie@ejemplo": None, "a b@c.es": None, "4111111111111111": "tarjeta", "411111111111": None, "12345678": "dni_num", "1234567": None, "": None, "  ": None,
          "200": None, "1250.00": None, "Madrid": None, "ES": None, None: None}


def test_value_shapes(spark):
    df = spark.createDataFrame([(v,) for v in SHAPES], "v string")
    assert {r["v"]: r["f"] for r in df.select("v", P.detect_form(F.col("v")).alias("f")).collect()} == SHAPES


def hmac_of(value, domain, key):
    message = f"{domain.upper()}|{' '.join(value.split())}".encode()
    return "pii:" + hmac.new(key, message, hashlib.sha256).hexdigest()[:12]


def test_pseudonym_equals_hmac(spark):
    values = ["Ana Lopez", " Ana   Lopez ", "ñandú\u00a0 x", "a\u2003b", "x" * 300]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for key in (KEY, b"long" * 40):
        got = df.select("v", P.pseudonym(F.col("v"), "nombre", key).alias("p")).collect()
        assert all(r["p"] == hmac_of(r["v"], "NOMBRE", key) for r in got)
    assert got[0]["p"] == got[1]["p"]


@pytest.mark.parametrize("text,want", [
    ("doc 12345678Z y 12345678A", "doc [PII] y 12345678A"), ("nie X1234567L.", "nie [PII]."), ("ñ12345678Z", "ñ12345678Z"),
    ("ES9121000418450200051332 a", "[PII] a"), ("correo a.b@c.es, otro", "correo [PII], otro"), ("12345678Z12345678Z", "12345678Z12345678Z"),
    ("(12345678Z)(12345678Z)", "([PII])([PII])"), ("sin nada", "sin nada"), ("X0000000T y 00000000T", "[PII] y [PII]"), ("a@b", "a@b"),
    ("12345678Z a@b.es 87654321X ES00ABCDEFGHIJ", "[PII] [PII] [PII] [PII]")])
def test_redaction(one, text, want):
    assert one(P.redact_text, text) == want


def test_a_number_has_one_text_whatever_its_type(spark):
    kinds = ["bigint", "int", "double", "decimal(38,10)", "decimal(12,2)"]
    df = spark.sql("SELECT " + ", ".join(f"CAST(612345678 AS {k}) AS c{i}" for i, k in enumerate(kinds)))
    texts = df.select(*[P.as_text(F.col(f"c{i}"), k) for i, k in enumerate(kinds)]).first()
    assert set(texts) == {"612345678"}
    near = spark.createDataFrame([(1.231,), (1.234,), (1e-12,), (1e22,), (-0.5,), (100.0,), (float("nan"),)], "v double")
    assert [r[0] for r in near.select(P.as_text(F.col("v"), "double")).collect()] == ["1.231", "1.234", "0.000000000001", "1.0E22", "-0.5", "100", "NaN"]


@pytest.mark.parametrize("kind", ["BIGINT", "DOUBLE", "DECIMAL(38,10)", "STRING"])
def test_numbers_of_any_type_are_judged_alike(spark, catalog, kind):
    df = spark.sql(f"SELECT CAST(v AS {kind}) AS tel FROM VALUES (612345678), (712345679) AS t(v)")
    masked, report = O.mask(df, ["OTHER"], catalog, POLICY, KEY)
    assert report.masked == ["tel"] and {r[0] for r in masked.collect()} == {hmac_of(v, "tel", KEY) for v in ("612345678", "712345679")}


@pytest.mark.parametrize("sql", [
    "SELECT REFERENCIA FROM deuda3", "SELECT REFERENCIA FROM `deuda3`", 'SELECT "a -- b" AS k, REFERENCIA FROM deuda3', "SELECT 'it\\'s' AS k, REFERENCIA FROM deuda3",
    "SELECT REFERENCIA FROM (deuda3)", "SELECT REFERENCIA FROM ((deuda3)) x", "SELECT REFERENCIA FROM deuda3 -- FROM other", "SELECT REFERENCIA FROM global_temp.deuda4",
    "SELECT REFERENCIA FROM `global_temp`.`deuda4`", "WITH w AS (SELECT * FROM deuda3) SELECT REFERENCIA FROM w"])
def test_no_spelling_of_a_relation_escapes_the_flag(spark, catalog, sql):
    values = spark.createDataFrame([(12345,), (54321,)], "REFERENCIA bigint")
    values.createOrReplaceTempView("deuda3")
    values.createOrReplaceGlobalTempView("deuda4")
    more = catalog.unionByName(catalog.where("column = 'REFERENCIA'").withColumn("table", F.lit("DEUDA3"))).unionByName(
        catalog.where("column = 'REFERENCIA'").withColumn("table", F.lit("DEUDA4")))
    df, report = guard.guarded_query(spark, sql, more, POLICY, KEY)
    assert "REFERENCIA" in report.masked and all(r["REFERENCIA"].startswith("pii:") for r in df.collect())


@pytest.mark.parametrize("text,tables", [
    ("SELECT 1 FROM `a`", ["A"]), ("SELECT 1 FROM spark_catalog.default.t", ["T"]), ("SELECT 1 FROM `c`.`d`.`t` x JOIN e.f AS g ON 1 = 1", ["T", "F"]),
    ('SELECT "FROM x" FROM t', ["T"]), ("SELECT 'it\\'s FROM x' FROM t /* FROM y */", ["T"]), ("SELECT 1 FROM (t) JOIN ((u)) ON 1 = 1", ["T", "U"]),
    ("SELECT 1 FROM (SELECT 2 FROM t) s", ["T"]), ("SELECT 'open FROM t", [])])
def test_tables_of_a_spark_statement(one, text, tables):
    assert one(lambda c: S.sql_tables(c, spark=True), text) == tables


@pytest.mark.parametrize("sql", ["SELECT reflect('java.lang.System', 'getProperty', 'x')", "SELECT java_method('a', 'b')", "SELECT 1 FROM t WHERE try_reflect ('a', 'b') = 1",
                                 "SELECT `reflect`('a', 'b')", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM (json . `x`)", "SELECT 1 FROM t JOIN `text`.`/etc/passwd` p ON 1 = 1"])
def test_calls_and_paths_past_the_catalog_are_refused(spark, catalog, sql):
    with pytest.raises(guard.RefusedQuery):
        guard.guarded_query(spark, sql, catalog, POLICY, KEY)


def test_the_gate_cannot_be_pruned(spark):
    rows = spark.createDataFrame([("a.txt", "nada"), ("b.txt", "doc 12345678Z")], "path string, text string")
    gate = O.personal_data_gate(rows, "text", "path")
    for use in (lambda: gate.count(), lambda: gate.select("path").collect(), lambda: gate.where("path = 'b.txt'").select(F.lit(1)).collect()):
        with pytest.raises(Exception, match="personal data of form dni in b.txt"):
            use()
    assert O.personal_data_gate(rows, "text", "path", ("b",)).count() == 2


def test_phrases_with_equal_and_missing_row_keys(spark):
    lines = spark.createDataFrame([("f", 1, "una frase bastante larga aqui"), ("f", 1, "otra frase bastante larga aqui"), (None, None, "x frase bastante larga y"),
                                   ("g", 2, "abcdefghijklmnop" * 40), ("g", 3, "sin nada")], "file string, line_no int, text string")
    phrases = spark.createDataFrame([("frase bastante larga",), ("cdefghijklmn",), ("corta",), ("no esta aqui nunca",)], "phrase string")
    got = sorted((r["file"] or "", r["line_no"] or 0, r["phrase"]) for r in O.contains_phrase(lines, phrases, ["file", "line_no"]).collect())
    assert got == [("", 0, "frase bastante larga"), ("f", 1, "frase bastante larga"), ("f", 1, "frase bastante larga"), ("g", 2, "cdefghijklmn")]


def test_phrases_by_brute_force(spark):
    import random
    rng = random.Random(5)
    words = ["uno", "dos", "tres", "cuatro", "cinco", "ñandú", "x", "largapalabra"]
    texts = [rng.choice([" ", "  ", ", "]).join(rng.choices(words, k=rng.randint(0, 14))) for _ in range(300)] + ["largapalabralargapalabra" * 9, None, "", "😀" * 40]
    phrases = [t[a:a + rng.randint(8, 30)] for t in texts[:200] if t and len(t) > 20 for a in [rng.randrange(len(t) - 10)]] + ["palabralargapal", "😀" * 13, "no esta en ninguna", "uno", None]
    lines = spark.createDataFrame([(k % 7, t) for k, t in enumerate(texts)], "n int, text string")
    asked = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    want = sorted((k % 7, t, p) for k, t in enumerate(texts) if t is not None for p in set(phrases) if p is not None and len(p) >= 12 and p in t)
    for a_pass in (2000, 20):
        assert sorted(map(tuple, O.contains_phrase(lines, asked, ["n"], a_pass=a_pass).collect())) == want


def test_any_number_of_phrases_takes_one_pass_over_the_lines(spark, tmp_path):
    """20,000 phrases of words, and names without an inner word: the plan reads the lines once for each kind of key, and holds no phrase."""
    texts = [f"note about client{i % 3000 * 7} and Client#{i % 90:09d} {'Client#000000003 ' * (i % 3)}" for i in range(4000)]
    spark.createDataFrame(list(enumerate(texts)), "n int, text string").write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    asked = [f"about client{i} and" for i in range(20_000)] + [f"Client#{i:09d}" for i in range(200)]
    held = O.contains_phrase(lines, spark.createDataFrame([(p,) for p in asked], "phrase string"), ["n"])
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert plan.count(str(tmp_path / "lines")) == 2 and "client1407" not in plan
    known = set(asked)
    want = sorted((n, p) for n, t in enumerate(texts) for p in {f"about {t.split()[2]} and", *t.split()[4:]} & known)
    assert sorted((r["n"], r["phrase"]) for r in held.collect()) == want and len(want) > 8000


def test_names_with_a_common_beginning_are_looked_up_by_what_differs(spark):
    """500 names that begin alike, all lines with that beginning: few candidates for each line, where the beginning would give all of them."""
    lines = spark.createDataFrame([(i, f"for Client#{i:09d} only") for i in range(500)], "n int, text string")
    phrases = spark.createDataFrame([(f"Client#{i:09d}",) for i in range(500)], "phrase string")
    keys = O._looked_up_by(lines, phrases, "text")
    assert keys.count() == 500 and keys.groupBy("token").count().agg(F.max("count")).first()[0] == 1
    assert O._met(lines, keys, ["n"], "text").count() < 1000
    assert sorted(map(tuple, O.contains_phrase(lines, phrases, ["n"]).select("n", "phrase").collect())) == [(i, f"Client#{i:09d}") for i in range(500)]


def test_no_phrases_are_in_no_line(spark):
    lines = spark.createDataFrame([(1, "una frase bastante larga"), (2, None)], "n int, text string")
    none = O.contains_phrase(lines, spark.createDataFrame([(None,), ("corta",)], "phrase string"), ["n"])
    assert none.columns == ["n", "text", "phrase"] and none.count() == 0


def test_a_very_long_line_takes_no_more_than_its_length(spark):
    import time
    phrases = spark.createDataFrame([("entre dos palabras mas",), ("sinpalabrainterior",)], "phrase string")

    def seconds(words):
        lines = spark.createDataFrame([(1, "dos palabras " * words + "entre dos palabras mas sinpalabrainterior")], "n int, text string")
        start = time.perf_counter()
        assert O.contains_phrase(lines, phrases, ["n"]).count() == 2
        return time.perf_counter() - start
    seconds(10)
    assert seconds(6200) < 5 + 2 * seconds(62)


def test_rules_leave_out_build_folders(spark):
    lines = spark.createDataFrame([("bin/Debug/a.cs", 1, 'pass = "abcd"'), ("src\\obj\\a.cs", 1, 'pass = "abcd"'), ("src/binary/a.cs", 1, 'pass = "abcd"')], "file string, line_no int, text string")
    assert [r["file"] for r in O.rule_scan(lines).collect()] == ["src/binary/a.cs"]


def test_long_quoted_values_are_blanked(one):
    assert one(P.redact_literals, "x '" + "y" * 5000 + "' z") == "x '<val>' z"


def test_literals_and_clip(one):
    assert one(P.redact_literals, "VALUES('Ana','x') 12345678Z") == "VALUES('<val>','<val>') [PII]"
    assert one(lambda c: P.clip(c, 5), " ab\x01cdefg ") == "ab cd..."


@pytest.mark.parametrize("column,verdict,reason", [
    ("IDDEUDOR", "clear", "type"), ("NOMBRE", "mask", "name"), ("DNI", "mask", "name"), ("TELEFONO", "mask", "name"),
    ("SALDO", "clear", "type"), ("FECHA_ALTA", "clear", "type"), ("OBSERVACIONES", "mask", "text"), ("COD_POSTAL", "clear", "flag"),
    ("REFERENCIA", "mask", "flag"), ("TOTAL", "unresolved", "no definition"), ("APELLIDO1", "mask", "name")])
def test_classification(spark, catalog, column, verdict, reason):
    wanted = spark.createDataFrame([(column, "DEUDA")], "column string, table string")
    r = O.classify_columns(wanted, catalog, POLICY).first()
    assert (r["verdict"], r["reason"]) == (verdict, reason)


def test_most_restrictive_table_wins(spark, catalog):
    more = catalog.unionByName(catalog.where("column = 'TEXTO'").withColumn("table", F.lit("DEUDA")))
    wanted = spark.createDataFrame([("TEXTO", "IDIOMA"), ("TEXTO", "DEUDA")], "column string, table string")
    assert O.classify_columns(wanted, more, POLICY).first()["verdict"] == "mask"
    alone = wanted.where("table = 'IDIOMA'")
    assert O.classify_columns(alone, more, POLICY).first()["reason"] == "parametric"


def test_lost_pattern_list_masks_everything(spark, catalog):
    policy = O.Policy.build("enforce", base=[])
    wanted = spark.createDataFrame([("SALDO", "DEUDA")], "column string, table string")
    assert O.classify_columns(wanted, catalog, policy).first()["verdict"] == "mask"
    assert "TLF*" not in O.Policy.build(remove=["tlf*"]).patterns


def test_scan_and_unresolved(spark):
    df = spark.createDataFrame([("1", "12345678", "x", "10", "123456789", None), ("2", "12345678Z", "y", "3,5", "987654321", " "),
                                ("3", "abc", "z", "-7", "123123123", "")], "a string, b string, c string, d string, e string, f string")
    got = {r["column"]: (r["form"], r["hits"], r["non_blank"]) for r in O.scan_columns(df, df.columns).collect()}
    assert got["b"] == ("dni", 1, 3) and got["a"] == (None, 0, 3) and got["f"] == (None, 0, 0)
    done = {r["column"]: (r["verdict"], r["reason"]) for r in O.resolve_unresolved(O.scan_columns(df, df.columns)).collect()}
    assert done == {"a": ("clear", "plain numbers"), "b": ("mask", "form dni"), "c": ("mask", "other values"),
                    "d": ("clear", "plain numbers"), "e": ("mask", "other values"), "f": ("mask", "blank")}


def test_weak_shape_needs_half(spark):
    rows = [("612345678",)] * 2 + [("x",)] * 2
    df = spark.createDataFrame(rows, "p string")
    assert O.scan_columns(df, ["p"]).first()["form"] == "telefono"
    assert O.scan_columns(df.unionByName(spark.createDataFrame([("y",)], "p string")), ["p"]).first()["form"] is None


def _debts(spark):
    spark.createDataFrame([("1024", "Ana Lopez", 1250.0), ("1025", "Luis Gil", 340.5), ("1026", "Ana Lopez", 980.0), ("1027", " ", 1.0)],
                          "iddeudor string, nombre string, saldo double").createOrReplaceTempView("deuda")


def test_guarded_query_masks_and_reports(spark, catalog):
    _debts(spark)
    df, rep = guard.guarded_query(spark, "SELECT iddeudor, nombre, saldo FROM deuda ORDER BY iddeudor", catalog, POLICY, KEY)
    rows = df.orderBy("iddeudor").collect()
    assert rows[0]["nombre"] == hmac_of("Ana Lopez", "nombre", KEY) == rows[2]["nombre"] != rows[1]["nombre"]
    assert rows[3]["nombre"] == " " and rows[0]["saldo"] == 1250.0
    assert rep.masked == ["nombre"] and rep.tables == ["DEUDA"] and rep.row_count == 4 and rep.rows_truncated is False


def test_guarded_query_caps_rows(spark, catalog):
    _debts(spark)
    df, rep = guard.guarded_query(spark, "SELECT iddeudor FROM deuda", catalog, POLICY, KEY, max_rows=3)
    assert df.count() == 3 and rep.row_count == 3 and rep.rows_truncated


def test_predicate_on_personal_column_is_told(spark, catalog):
    _debts(spark)
    _, rep = guard.guarded_query(spark, "SELECT COUNT(*) AS total FROM deuda WHERE nombre LIKE 'Ana%'", catalog, POLICY, KEY)
    assert rep.predicate_warning == ["NOMBRE"] and rep.masked == []


def test_safe_column_with_personal_values_is_masked(spark, catalog):
    spark.createDataFrame([("12345678Z",), ("x",)], "cod_postal string").createOrReplaceTempView("deuda2")
    more = catalog.unionByName(catalog.where("column = 'COD_POSTAL'").withColumn("table", F.lit("DEUDA2")))
    df, rep = guard.guarded_query(spark, "SELECT cod_postal FROM deuda2", more, POLICY, KEY)
    assert rep.suspect == ["cod_postal"] and all(r[0].startswith("pii:") for r in df.collect())


def test_a_name_may_come_twice(spark, catalog):
    _debts(spark)
    df, rep = guard.guarded_query(spark, "SELECT a.nombre, b.nombre, a.saldo FROM deuda a JOIN deuda b ON a.iddeudor = b.iddeudor", catalog, POLICY, KEY)
    assert rep.error is None and df.columns == ["nombre", "nombre", "saldo"] and rep.masked == ["nombre", "nombre"]
    assert hmac_of("Luis Gil", "nombre", KEY) in {r[1] for r in df.collect()}


def test_modes(spark, catalog):
    _debts(spark)
    for mode, masked in (("off", []), ("audit", ["nombre"])):
        df, rep = guard.guarded_query(spark, "SELECT nombre FROM deuda", catalog, O.Policy.build(mode), KEY)
        assert rep.masked == masked and "Ana Lopez" in [r[0] for r in df.collect()]
    df, _ = guard.guarded_query(spark, "SELECT nombre FROM deuda", catalog, O.Policy.build("enforce", "suppress"), KEY)
    assert {r[0] for r in df.collect()} == {"[PII]", " "}


def test_masking_failure_returns_no_rows(spark):
    _debts(spark)
    broken = spark.createDataFrame([("x",)], "nothing string")
    df, rep = guard.guarded_query(spark, "SELECT nombre FROM deuda", broken, POLICY, KEY)
    assert df.count() == 0 and rep.error


@pytest.mark.parametrize("sql,ok", [
    ("SELECT 1", True), ("  with x as (select 1) select * from x", True), ("SELECT 'a;b' FROM t;", True), ("SELECT 1 -- ; drop\n", True),
    ("SELECT 1; DROP TABLE t", False), ("DELETE FROM t", False), ("WITH x AS (SELECT 1) DELETE FROM t", False), ("", False),
    ("/* SELECT */ UPDATE t SET a=1", False), ("SELECT 'it''s; ok' FROM t", True), ("SELECT 1 /* ; */ FROM t", True),
    ("SELECT '--' ; DROP TABLE t", False)])
def test_readonly_gate(one, sql, ok):
    assert (one(S.readonly_reason, sql) is None) == ok


@pytest.mark.parametrize("sql,tables", [
    ("SELECT * FROM DEUDA", ["DEUDA"]), ("select * from app.deuda d join otra o on d.a=o.a", ["DEUDA", "OTRA"]),
    ("SELECT * FROM A a, B AS b, app . C WHERE 1=1", ["A", "B", "C"]), ("SELECT * FROM (SELECT x FROM T1) z", ["T1"]),
    ("SELECT 1 FROM DUAL", []), ("SELECT * FROM A -- FROM B\n/* JOIN C */", ["A"]), ("SELECT '-- no' FROM A", ["A"]),
    ("SELECT * FROM A WHERE x = 'abierto", []), ("SELECT a FROM T ORDER BY a, b", ["T"]), ("SELECT a FROM T GROUP BY a, b", ["T"]),
    ("SELECT * FROM A, A", ["A"])])
def test_tables_in_scope(one, sql, tables):
    assert one(S.sql_tables, sql) == tables


def test_predicates_and_literals(one):
    sql = "SELECT * FROM t d WHERE d.DNI LIKE '1%' AND saldo>=3 OR nombre IN ('a')"
    assert one(S.sql_predicates, sql) == ["DNI", "SALDO", "NOMBRE"]
    assert one(S.sql_predicates, "SELECT a FROM t") == []
    assert one(S.blank_literals, "x='a' and y='b'") == "x='?' and y='?'"


def test_inventory_hides_values(spark, catalog):
    samples = spark.createDataFrame([("deuda", "cod_postal", "12345678Z"), ("deuda", "cod_postal", "28001"), ("deuda", "saldo", "3.5")],
                                    "table string, column string, value string")
    inv = {r["column"]: r for r in O.column_inventory(catalog, POLICY, samples).collect()}
    assert inv["COD_POSTAL"]["verdict"] == "mask" and inv["COD_POSTAL"]["reason"] == "form dni" and inv["COD_POSTAL"]["hits"] == 1
    assert "12345678Z" not in str(inv)
    total = O.inventory_totals(O.column_inventory(catalog, POLICY)).where("table IS NULL").first()
    assert total["columns"] == 10 and total["clear"] == 5


def test_personal_data_gate(spark):
    df = spark.createDataFrame([("src/a", "hola"), ("out/b", "12345678Z")], "path string, text string")
    assert O.personal_data_gate(df, "text", "path", ("out/",)).count() == 2
    with pytest.raises(Exception, match="dni in out/b") as e:
        O.personal_data_gate(df, "text", "path").collect()
    assert "12345678Z" not in str(e.value).split("personal data")[1][:40]


def test_strictest_mode(spark):
    df = spark.createDataFrame([("a", "off", True), ("a", "audit", True), ("b", None, False), ("c", None, True), ("d", "odd", False)],
                               "workspace string, mode string, declared boolean")
    got = {r["workspace"]: (r["mode"], r["active"]) for r in O.strictest_mode(df).collect()}
    assert got == {"a": ("audit", True), "b": ("off", False), "c": ("indeterminate", True), "d": ("indeterminate", True)}


def test_leak_rules(spark):
    lines = spark.createDataFrame([
        ("a.sql", 1, "CREATE TABLE T (A NUMBER);"), ("a.sql", 2, "-- error ORA-00942 en UTF-8"), ("a.json", 3, '{"pii": true}'),
        ("a.sql", 4, "-- Saldo vivo del deudor a cierre"), ("a.txt", 5, "ver PROJ-1234"), ("a.txt", 6, r"C:\SVN\trunk"), ("a.txt", 7, "Estado")],
        "file string, line_no int, text string")
    phrases = spark.createDataFrame([("Saldo vivo del deudor",), ("Estado",)], "phrase string")
    got = {(r["line_no"], r["reason"]) for r in O.leak_rules(lines, phrases).collect()}
    assert got == {(3, "personal-data mark"), (4, "literal description"), (5, "internal ticket"), (6, "developer path")}


def test_phrase_lookup_equals_brute_force(spark):
    rng = random.Random(11)
    words = ["alfa", "beta", "gamma", "de", "la", "ñu", "x1", "casa-azul", "fin."]
    lines = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for i in range(300)]
    phrases = []
    for _ in range(80):
        text = rng.choice(lines)[1]
        a = rng.randint(0, len(text))
        phrases.append(text[a:a + rng.randint(8, 40)])
    phrases += ["alfabetagamma", "de la beta alfa", "zzzzzzzzzzzzzzz"]
    df = spark.createDataFrame(lines, "id int, text string")
    ph = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    got = {(r["id"], r["phrase"]) for r in O.contains_phrase(df, ph, ["id"]).collect()}
    want = {(i, p) for i, t in lines for p in phrases if len(p) >= 12 and p in t}
    assert got == want and want


def test_rule_scan(spark):
    lines = spark.createDataFrame([
        ("a.cs", 1, 'var q = "SELECT a FROM t" + x; cmd.ExecuteReader();'), ("a.cs", 2, 'password = "abc123"; Response.Write(x)'),
        ("b.aspx", 3, '<%= Request.Form["x"] %>'), ("c.txt", 4, 'password = "abc123"'), ("d.cs", 5, "catch (Exception e) { }")],
        "file string, line_no int, text string")
    web = {(r["line_no"], r["id"]) for r in O.rule_scan(lines).collect()}
    assert web == {(1, "SQL_INJECT_01"), (2, "HARDCRED_01"), (2, "XSS_01"), (3, "XSS_02"), (5, "ERR_01")}
    batch = {r["id"] for r in O.rule_scan(lines, kind="batch").collect()}
    assert batch == {"SQL_INJECT_01", "HARDCRED_01", "ERR_01"}
    assert {r["severity"]: r["findings"] for r in O.severity_counts(O.rule_scan(lines)).collect()} == {
        "critical": 1, "high": 2, "medium": 1, "low": 1}


def test_correlation_needs_one_key(spark):
    df = spark.createDataFrame([("pii:1",)], "n string")
    assert O.correlate(df, df, "n", KEY, KEY).count() == 1
    with pytest.raises(ValueError):
        O.correlate(df, df, "n", KEY, b"other")
