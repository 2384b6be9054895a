import pytest
from pyspark.sql import functions as F

from tamiz.functions import bodies as B
from tamiz.operators import snapshot as O

OBJ = "section string, name string, body string, disabled boolean"


@pytest.mark.parametrize("text,want,lines", [
    ("a  \r\nb\t\r c\n\n", "a\nb\n c", 3), ("\n  x\n", "x", 1), ("", "", 0), ("uno", "uno", 1), ("  a\n   b", "a\n   b", 2), ("a \n", "a", 1),
    (" \t\r\n", "", 0), ("a\n\n\nb", "a\n\n\nb", 4), ("a\r\rb", "a\n\nb", 3)])
def test_normal_form(one, text, want, lines):
    assert one(B.normalise_body, text) == want and one(B.line_count, text) == lines


def test_signatures(spark):
    df = spark.createDataFrame([("CREATE SEQUENCE S START WITH 10 CACHE 5", "CREATE SEQUENCE S START WITH 999 CACHE 5")], "a string, b string")
    sig = lambda c, s: B.body_signature(F.col(c), F.lit(s))
    r = df.select((sig("a", "secuencias") == sig("b", "secuencias")).alias("seq"), (sig("a", "vistas") == sig("b", "vistas")).alias("view")).first()
    assert r["seq"] and not r["view"]


@pytest.fixture(scope="module")
def editions(spark):
    tables = spark.createDataFrame([("CLIENTE",), ("DEUDA",), ("T$X",)], "table string")
    old = spark.createDataFrame([
        ("procedimientos", "PACKAGE PK", "spec CLIENTE", False), ("procedimientos", "PACKAGE BODY PK", "body deuda\n  x", False),
        ("vistas", "V1", "select 1 from cliente, CLIENTES", False), ("triggers", "T1", "begin T$X end", False), ("secuencias", "S1", "START WITH 1 CACHE 1", False),
        ("funciones", "F1", "x", False)], OBJ)
    new = spark.createDataFrame([
        ("procedimientos", "PACKAGE BODY PK", "body deuda  \r\n  x", False), ("procedimientos", "PACKAGE PK", "spec CLIENTE", False),
        ("vistas", "V1", "select 2 from cliente", False), ("triggers", "T1", "begin T$X end", True), ("secuencias", "S1", "START WITH 7 CACHE 2", False),
        ("vistas", "V2", "y", False)], OBJ)
    return O.build_inventory(old, tables).cache(), O.build_inventory(new, tables).cache()


def test_inventory(editions):
    cards = {(r["section"], r["name"]): r for r in editions[0].collect()}
    pk = cards[("paquetes", "PK")]
    assert pk["line_count"] == 3 and pk["used_tables"] == ["CLIENTE", "DEUDA"]
    assert cards[("vistas", "V1")]["used_tables"] == ["CLIENTE"] and cards[("triggers", "T1")]["used_tables"] == ["T$X"]
    assert {r["name"] for r in O.users_of(editions[0], "cliente").collect()} == {"PK", "V1"}
    with pytest.raises(ValueError):
        O.users_of(editions[0].limit(0), "cliente")


def test_delivery(spark, editions):
    diff = O.diff_inventory(*editions)
    got = {(r["section"], r["name"]): (r["change"], r["route"]) for r in O.plan_delivery(diff).collect()}
    assert got == {("vistas", "V1"): ("modified", "deliver"), ("vistas", "V2"): ("new", "deliver"), ("triggers", "T1"): ("state changed", "deliver"),
                   ("secuencias", "S1"): ("modified", "hold"), ("funciones", "F1"): ("removed", "comment")}
    assert [r["section"] for r in O.order_by_dependency(diff).collect()] == ["secuencias", "vistas", "vistas", "funciones", "triggers"]
    blocks = spark.createDataFrame([("procedimientos", n) for n in ("PACKAGE BODY A", "PACKAGE B", "PACKAGE A", "PACKAGE BODY B")], "section string, name string")
    assert [r["name"] for r in O.order_by_dependency(blocks).collect()] == ["PACKAGE A", "PACKAGE BODY A", "PACKAGE B", "PACKAGE BODY B"]
    errors = spark.createDataFrame([("vistas",), ("procedimientos",)], "section string")
    assert O.drop_failed_sections(diff, errors).where("section = 'vistas'").count() == 0
    with pytest.raises(ValueError):
        O.drop_failed_sections(diff, errors, spark.createDataFrame([(1,)], "gap int"))
    kept = O.carry_failed_sections(*editions, errors)
    assert {(r["name"], r["carried"]) for r in kept.where("section IN ('vistas', 'paquetes')").collect()} == {("V1", True), ("PK", True)}


def test_trees(spark):
    a = spark.createDataFrame([("x", "1\r\n2"), ("y", "a"), ("z", "q")], "path string, content string")
    b = spark.createDataFrame([("x", "1\n2"), ("y", "b"), ("w", "q")], "path string, content string")
    assert {r["path"]: r["status"] for r in O.compare_trees(a, b).collect()} == {"y": "different", "z": "missing", "w": "extra"}
