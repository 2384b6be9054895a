import random

import pytest
from pyspark.sql import functions as F

from tamiz.functions import logtext as L
from tamiz.operators import logs as O

SCHEMA = "file string, line_no bigint, text string"
HEAD = "{label}: ({day}/08/2026 {time}) - Codigo error: {code} Codigo error sql: 0 Descripción error: {text}"


def head(label="Error", day="11", time="9:05", code="-21", text="fallo"):
    return HEAD.format(label=label, day=day, time=time, code=code, text=text)


GOLDEN = [
    head(text="ORA-12899: el valor para la columna \"A\".\"B\" (real: 54)", time="13:45"),
    "(Query: INSERT INTO T(A) VALUES('L1','persona@correo.ejemplo') )     en Tienda.Conexion.Ejecutar(String s)",
    "   en FrmDetalle.Cargo() en C:\\src\\FrmDetalle.aspx.cs:línea 7",
    head(text="ORA-12899: el valor para la columna \"A\".\"B\" (real: 58)", time="13:47"),
    "(Query: INSERT INTO T(A) VALUES('L2','otra@correo.ejemplo') )     en Tienda.Conexion.Ejecutar(String s)",
    "   en FrmDetalle.Cargo() en C:\\src\\FrmDetalle.aspx.cs:línea 7",
    head(label="cErrores", code="200", text="System.Threading.AbortException: anulado", day="3", time="8:41:09"),
    "   en System.Threading.Thread.Abort()",
    "   en FrmBase.Ir(String p) en C:\\src\\FrmBase.ascx.cs:línea 1",
    head(label="Fail", code="0", text="System.NullReferenceException: Usuario 12345678Z sin ficha"),
    "2026-08-11 10:00:00 ERROR fecha dentro del mensaje",
    head(label="Warn", text="no se pide"),
    "   en Tienda.NoCuenta.Exception(String s)",
    head(label="Aviso", code="0", text="sin nivel ni excepción"),
]


@pytest.fixture(scope="module")
def golden(spark):
    lines = spark.createDataFrame([("a.log", i, t) for i, t in enumerate(GOLDEN, 1)], SCHEMA)
    return O.describe_events(O.assemble_events(lines)).cache()


def test_golden_events(golden):
    got = [(r["line_no"], len(r["lines"]), r["exception"], r["origin"], r["screen"], r["stamp"]) for r in golden.orderBy("line_no").collect()]
    assert got == [
        (1, 3, "ORA-12899", "Tienda.Conexion.Ejecutar", "FrmDetalle", "2026-08-11 13:45:00"),
        (4, 3, "ORA-12899", "Tienda.Conexion.Ejecutar", "FrmDetalle", "2026-08-11 13:47:00"),
        (7, 3, "COD200", "FrmBase.Ir", "FrmBase", "2026-08-03 08:41:09"),
        (10, 2, "System.NullReferenceException", "", "", "2026-08-11 09:05:00"),
        (14, 1, "COD0", "", "", "2026-08-11 09:05:00")]


def test_golden_signatures(golden):
    agg = O.aggregate_signatures(golden)
    top = O.top_signatures(agg).first()
    assert agg.count() == 4 and top["count"] == 2 and top["first_seen"] == "2026-08-11 13:45:00" and top["last_seen"] == "2026-08-11 13:47:00"
    text = " ".join(r["text"] for r in O.signature_samples(golden).collect()) + " ".join(r["message"] for r in agg.collect())
    assert "@" not in text and "12345678Z" not in text and "'<val>'" in text and "[PII]" in text
    s = O.scan_summary(golden).first()
    assert (s["total_events"], s["distinct_signatures"], s["format_detected"], s["truncated"]) == (5, 4, "labelled", False)


def test_no_errors_is_an_explicit_empty_report(spark):
    lines = spark.createDataFrame([("a.log", 1, "todo bien")], SCHEMA)
    s = O.scan_summary(O.describe_events(O.assemble_events(lines))).first()
    assert (s["total_events"], s["format_detected"]) == (0, "desconocido")


MIXED = [
    ("texto", None), ("System.IO.IOException: lectura", "plain"), ("   en Tienda.A.B(String s)", "+"),
    ("2026-08-11 10:00:00 INFO nada", None), ("   detalle que se salta", None), ("System.IO.IOException en lo saltado", None),
    ("2026-08-11 10:00:00 ERROR x", "stamped"), ("texto", "+"),
    ("[2026-08-11 10:00] Tienda.PagoException", "stamped"), ("(11/08/2026 13:45) nada", None),
    (head(), "labelled"), ("2026-08-11 10:00:00 INFO es parte del mensaje", "+"), ("", "+"),
    (head(label="Warn"), None), ("System.IO.IOException tras un aviso", None), (head(label="Aviso"), "labelled"), ("fin", "+")]


@pytest.mark.parametrize("chunk", [1, 3, 65536])
def test_assembly_of_mixed_headers(spark, chunk):
    lines = spark.createDataFrame([("m", i, t) for i, (t, _) in enumerate(MIXED, 1)], SCHEMA)
    want, last = {}, None
    for i, (text, mark) in enumerate(MIXED, 1):
        if mark == "+":
            want[last][1].append(text)
        elif mark:
            last, want[i] = i, (mark, [text])
    got = {r["line_no"]: (r["kind"], r["lines"]) for r in O.assemble_events(lines, chunk=chunk).collect()}
    assert got == want


def test_chunks_change_nothing_and_events_are_cut(spark):
    rng = random.Random(7)
    kinds = [t for t, _ in MIXED]
    rows = [(f"f{f}", i, rng.choice(kinds)) for f in range(30) for i in range(1, rng.choice([5, 30, 120]))]
    rows += [("long", i, t) for i, t in enumerate(["System.IO.IOException"] + ["   en X.Y()"] * 60, 1)]
    lines = spark.createDataFrame(rows, SCHEMA)
    one, two = ({(r["file"], r["line_no"], r["kind"], tuple(r["lines"])) for r in O.assemble_events(lines, chunk=c).collect()} for c in (3, 65536))
    assert one == two and len(next(ls for f, _, _, ls in one if f == "long")) == 40


def test_levels_and_since(spark):
    lines = spark.createDataFrame([("a", i, t) for i, t in enumerate([head(label="Warn", day="9"), head(day="10"), head(day="12")], 1)], SCHEMA)
    assert O.assemble_events(lines, ["WARN"]).count() == 1
    assert [r["line_no"] for r in O.assemble_events(lines, since="2026-08-11 00:00:00").collect()] == [3]


def test_normalised_message(one):
    text = "id 0f8fad5b-d9cb-469f-a165-70867728950e el 2026-08-11 10:00:00 y 11/08/2026 en C:\\a\\b.txt 0xFF con 12 filas"
    assert one(L.normalise_message, text) == "id <guid> el <fecha> y <fecha> en <ruta> <hex> con # filas"


def test_newest_files_first_under_the_cap(spark):
    rows = [(f, m, i, "x") for f, m, n in (("old", "2026-01-01", 5), ("new", "2026-03-01", 4), ("same", "2026-03-01", 2)) for i in range(1, n + 1)]
    lines = spark.createDataFrame(rows, "file string, m string, line_no bigint, text string").withColumn("mtime", F.to_timestamp("m"))
    got = {r["file"]: (r["n"], r["t"]) for r in O.scan_cap(lines, 8).groupBy("file").agg(
        F.count("*").alias("n"), F.bool_or("scan_truncated").alias("t")).collect()}
    assert got == {"new": (4, False), "same": (2, False), "old": (2, True)}


def test_tickets_triage_recount(spark, golden):
    agg = O.aggregate_signatures(golden)
    known = O.top_signatures(agg).first()["hash"]
    tickets = spark.createDataFrame([(f"[log:{known}] visto",), ("sin marca",)], "title string")
    flags = {r["hash"]: r["is_new"] for r in O.new_signatures(agg, tickets).collect()}
    assert flags.pop(known) is False and all(flags.values())
    rows = {r["exception"]: (r["category"], r["priority"]) for r in O.triage(agg, [("data", "^ORA-", 2), ("code", "NullReference", 3)], ("noise", 0)).collect()}
    assert rows["ORA-12899"] == ("data", 4) and rows["System.NullReferenceException"] == ("code", 3) and rows["COD200"] == ("noise", 0)
    lines = spark.createDataFrame([("a.log", 20000, "x")], SCHEMA)
    assert O.recount_check(lines, golden.limit(1)).first()["doubtful"]


def test_events_and_details_are_whole_on_request(spark):
    """The only own frame stands after the 40th line; the last event ends with its file."""
    from tamiz.operators import stats as T
    from tamiz.sources import documents as D
    stack = ["   en System.Cosa.Hacer()"] * 50 + ["   en FrmLejos.Ir(String p) en C:\\src\\FrmLejos.aspx.cs:línea 1"]
    rows = [head()] + stack + [head(code="-22")] + stack
    lines = spark.createDataFrame([("a.log", i, t) for i, t in enumerate(rows, 1)], SCHEMA)
    got = {most: [(r["line_no"], len(r["lines"]), r["screen"]) for r in O.describe_events(O.assemble_events(lines, most_lines=most)).orderBy("line_no").collect()] for most in (40, None)}
    assert got == {40: [(1, 40, ""), (53, 40, "")], None: [(1, 52, "FrmLejos"), (53, 52, "FrmLejos")]}
    xml = spark.createDataFrame([('<error type="T" message="m" detail="' + "x&#10;" * 30 + 'end"/>',)], "value string")
    assert [len(D.parse_error_xml(xml, most_lines=n).first()["lines"]) for n in (20, None)] == [21, 32]
    failed = spark.createDataFrame([("f", "t", "Failed", "m" * 700, "s" * 900)], "file string, testName string, outcome string, message string, stack string")
    assert [(len(r["message"]), len(r["stack"])) for r in (T.failures(failed).first(), T.failures(failed, shown=None).first())] == [(600, 600), (700, 900)]
