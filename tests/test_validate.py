import pytest

from tamiz.operators import seed as G
from tamiz.operators import validate as O
from tamiz.operators.validate import Field, Structure
from tamiz.sources import text as A

SPEC = Structure("S", numeric_format=",", fields=(
    Field("id", "integer", pk=True, nullable=False), Field("alta", "date"), Field("baja", "date", date_format="DD/MM/AAAA"),
    Field("saldo", "decimal", decimales=2, min=0), Field("tipo", longitud=2, domain=("A", "BB"))),
    comparisons=(("baja", ">=", "alta"),), unique_combos=(("alta", "tipo"),))


def frame(spark, *data):
    return spark.createDataFrame([("f", i, *r) for i, r in enumerate(data, 1)], "file string, line_no bigint, id string, alta string, baja string, saldo string, tipo string")


def test_rules(spark):
    rows = frame(spark, ("1", "20260101", "02/01/2026", "1,50", "A"), ("x", "20260230", "31/12/2025", "1.5", "C"), ("", "20260301", "01/03/2026", "-3,00", "BBB"),
                 ("1", "20260101", "01/01/2025", None, "A"), ("2", "2026-01-01", " ", "7", "BB"))
    got = {(r["line_no"], r["field"], r["rule"]) for r in O.check_structure(rows, SPEC).collect()}
    assert got == {(2, "id", "type"), (2, "alta", "date"), (2, "saldo", "numeric"), (2, "tipo", "domain"), (3, "id", "required"), (3, "saldo", "min"),
                   (3, "tipo", "length"), (3, "tipo", "domain"), (4, "baja", "comparison"), (4, "id", "pk"), (4, "UNIQUE", "unique:alta,tipo"), (5, "alta", "date")}


@pytest.mark.parametrize("fmt,good,bad", [("AAAAMMDD", "20240229", "20230229"), ("DDMMAAAA", "31012026", "20260131"), ("AAAA/MM/DD", "2026/01/31", "2026/1/31"),
                                          ("DD/MM/AAAA", "31/01/2026", "31/02/2026"), ("AAAAMMDDhhmmss", "20260131235959", "20260131246000")])
def test_date_formats(one, fmt, good, bad):
    assert one(lambda c: O.read_date(c, fmt), good) is not None and one(lambda c: O.read_date(c, fmt), bad) is None


def test_unknown_keys_are_refused():
    with pytest.raises(ValueError, match="nuevo"):
        Structure.load({"name": "S", "nuevo": 1})
    with pytest.raises(ValueError, match="raro"):
        Structure.load({"name": "S", "fields": [{"name": "a", "raro": 1}]})
    assert Structure.load({"name": "S", "fields": [{"name": "a", "domain": ["x"]}], "unique_combos": [["a"]]}).fields[0].domain == ("x",)


def test_relation_catalog_and_files(spark):
    f1 = spark.createDataFrame([("a", 1, "1"), ("a", 2, "9")], "file string, line_no bigint, k string")
    f2 = spark.createDataFrame([("b", 1, "1"), ("b", 2, "7")], "file string, line_no bigint, k2 string")
    assert {(r["rule"], r["value"]) for r in O.check_relation(f1, f2, [("k", "k2")]).collect()} == {("f1_not_in_f2", "9"), ("f2_not_in_f1", "7")}
    codes = spark.createDataFrame([("1",)], "code string")
    assert [r["value"] for r in O.check_catalog(f1, "k", codes).collect()] == ["9"]
    rules = spark.createDataFrame([("CLI", "CLI", True), ("CLIDIR", "CLI_DIR", True), ("PAG", "PAG", True)], "structure string, pattern string, required boolean")
    matched = O.match_files(spark.createDataFrame([("x_cli_dir_1.txt",), ("cli_2.txt",), ("otro.txt",)], "file string"), rules)
    assert {r["file"]: r["structure"] for r in matched.collect()} == {"x_cli_dir_1.txt": "CLIDIR", "cli_2.txt": "CLI", "otro.txt": None}
    assert [r["structure"] for r in O.missing_files(matched, rules).collect()] == ["PAG"]
    assert [r["file"] for r in O.unmatched_files(matched).collect()] == ["otro.txt"]
    many = spark.createDataFrame([(f"S{k:04d}", f"P{k:04d}" + "X" * (k % 40), True) for k in range(1500)], "structure string, pattern string, required boolean")
    got = O.match_files(spark.createDataFrame([("a_p0039" + "x" * 39,), ("p0039x",), ("p0040",), (None,), ("p0040",)], "file string"), many).collect()
    assert sorted((r["file"] or "", r["structure"]) for r in got) == [("", None), ("a_p0039" + "x" * 39, "S0039"), ("p0039x", None), ("p0040", "S0040"), ("p0040", "S0040")]


def test_versions_and_groups(spark):
    v = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b")], "structure string, version int, body string")
    assert O.latest_version(O.restore_version(v, 1)).first()["body"] == "a" and O.restore_version(v, 1).count() == 3
    g = spark.createDataFrame([("a", None), ("b", 0), ("c", 4)], "name string, group_id int")
    assert {r["name"] for r in O.group_filter(g, 0).collect()} == {"a", "b"} == {r["name"] for r in O.group_filter(g, None).collect()}
    assert [r["name"] for r in O.group_filter(g, 4).collect()] == ["c"]


def test_detected_structure(spark):
    rows = spark.createDataFrame([("f", 1, "1;20260101;a b;1,5"), ("f", 2, "2;20260228;;2"), ("g", 1, "sin separador")], "file string, line_no int, text string")
    got = {(r["file"], r["position"]): (r["separator"], r["type"]) for r in O.detect_structure(rows).collect()}
    assert got == {("f", 0): (";", "integer"), ("f", 1): (";", "date AAAAMMDD"), ("f", 2): (";", "text"), ("f", 3): (";", "decimal")}


def test_seeded_rows(spark):
    cols = [G.SeedColumn("id", "bigint", unique=True), G.SeedColumn("nombre", "string", 10, nullable=False), G.SeedColumn("fecha", "date")]
    df = G.seed_table(spark, cols, 500)
    rows = df.collect()
    assert rows == G.seed_table(spark, cols, 500).collect() and len({r["id"] for r in rows}) == 500 and min(r["id"] for r in rows) == 900000
    assert all(0 < len(r["nombre"]) <= 10 for r in rows) and 0 < sum(r["fecha"] is None for r in rows) < 150
    made = G.seed_related(spark, {"hijo": ([G.SeedColumn("padre", "bigint")], 200), "padre": (cols, 20)}, {("hijo", "padre"): ("padre", "id")})
    assert list(made) == ["padre", "hijo"] and made["hijo"].join(made["padre"], made["hijo"]["padre"] == made["padre"]["id"], "left_anti").count() == 0
    with pytest.raises(ValueError):
        G.seed_related(spark, {"a": (cols, 1), "b": (cols, 1)}, {("a", "id"): ("b", "id"), ("b", "id"): ("a", "id")})


def test_sample_file_passes_its_structure(spark):
    spec = Structure("P", file_type="positional", fields=(Field("id", "integer", longitud=8, start=1, nullable=False), Field("nombre", longitud=12, start=9)))
    rows = G.seed_table(spark, [G.SeedColumn("id", "bigint", unique=True), G.SeedColumn("nombre", "string", 12, nullable=False)], 30)
    lines = G.sample_input_file(rows, spec).selectExpr("'f' AS file", "monotonically_increasing_id() AS line_no", "value AS text")
    assert O.check_structure(A.parse_structured(lines, spec), spec).count() == 0
