import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tamiz.operators import history as H
from tamiz.operators import stats as T
from tamiz.operators import texts as K
from tamiz.operators import textsearch as X

LINES = "file string, line_no bigint, text string"


def test_delta_range(spark):
    log = spark.createDataFrame([("a", datetime(2026, 1, 1)), ("b", datetime(2026, 2, 1))], "revision string, ts timestamp")
    assert [r["revision"] for r in H.delta(log, datetime(2026, 1, 15), datetime(2026, 3, 1)).collect()] == ["b"]
    assert H.delta_summary(H.delta(log, datetime(2026, 1, 1), datetime(2026, 3, 1), 2), 2).first()["truncated"]
    with pytest.raises(ValueError, match="inverted"):
        H.delta(log, datetime(2026, 2, 1), datetime(2026, 1, 1))


def test_no_delivery_is_an_error(spark):
    log = spark.createDataFrame([("a", "s1", datetime(2026, 1, 5)), ("b", "s1", datetime(2026, 1, 1))], "revision string, solution string, ts timestamp_ntz")
    cuts = spark.createDataFrame([("s1", datetime(2026, 1, 1)), ("s1", datetime(2026, 1, 3))], "solution string, cut timestamp_ntz")
    assert [r["revision"] for r in H.delta_since_last_delivery(log, cuts, ["solution"]).collect()] == ["a"]
    with pytest.raises(Exception, match="no delivery registered for s1"):
        H.delta_since_last_delivery(log, cuts.limit(0), ["solution"]).collect()


def test_tickets(one):
    assert one(H.ticket_ids, "Corrige PROJ-12 y #1234, #1 #1234 ABC-1") == ["#1234", "PROJ-12", "ABC-1"]


def test_diff_symbols(spark):
    rows = [("f", i, "+", f"    public static void M{i % 12}(int x) {{") for i in range(1, 30)] + [("f", 40, "-", "x"), ("g", 1, " ", "public int Z()")]
    got = {r["file"]: (r["added"], r["removed"], r["symbols"]) for r in
           H.diff_summary(spark.createDataFrame(rows, "file string, line_no int, sign string, text string")).collect()}
    assert got == {"f": (29, 1, [f"M{i}" for i in range(1, 11)]), "g": (0, 0, [])}


def test_impact_levels(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("a", "d"), ("z", "y")], "source string, target string")
    starts = spark.createDataFrame([("a",), ("y",), ("q",)], "node string")
    layers = spark.createDataFrame([("b", "ui"), ("c", "bus"), ("d", "dalc"), ("z", "ui"), ("a", "ui")], "node string, layer string")
    got = {r["start"]: (r["direct"], r["indirect"], r["impact"]) for r in H.impact(edges, starts, layers, 9).collect()}
    assert got == {"a": (1, 2, "high"), "y": (1, 0, "low"), "q": (0, 0, "low")}
    # Several outgoing edges and repeated layers of a referrer count it once; what lies beyond the depth is told.
    edges = spark.createDataFrame([("b", "a"), ("b", "x"), ("b", "y"), ("c", "b")], "source string, target string")
    layers = spark.createDataFrame([("b", "ui"), ("b", "ui"), ("b", "bus"), ("c", "ui")], "node string, layer string")
    r = H.impact(edges, starts.where("node = 'a'"), layers, 1).first()
    assert (r["direct"], r["indirect"], r["total"], r["layers"], r["cut"]) == (1, 0, 1, 2, True)
    assert not H.impact(edges, starts.where("node = 'a'"), layers, 2).first()["cut"]
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("a", "d"), ("z", "y")], "source string, target string")
    assert H.reach(edges, starts, 1).count() == 2


def test_cycles_equal_mutual_reach(spark):
    rng = random.Random(4)
    for n in (12, 30):
        pairs = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(int(n * 1.2))}
        reach = {v: {b for a, b in pairs if a == v} for p in pairs for v in p}
        for _ in range(n):
            reach = {v: s | {y for x in s for y in reach[x]} for v, s in reach.items()}
        want = {frozenset(w for w in reach[v] if v in reach[w]) for v in reach if v in reach[v]}
        groups = {}
        for r in H.cycles(spark.createDataFrame(sorted(pairs), "source string, target string")).collect():
            groups.setdefault(r["cycle"], set()).add(r["node"])
        got = {frozenset(g) for g in groups.values()}
        # A node with a loop of its own may also appear as a single group.
        assert {g for g in got if len(g) > 1} == {g for g in want if len(g) > 1}
        assert {g for g in want if len(g) == 1} <= got


def test_cycles_through_chains(spark):
    """Edges drawn out to chains, rings that hang on one node, rings of their own, and two groups joined by a chain."""
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("b", "x1"), ("x1", "x2"), ("x2", "d"),
             ("d", "y1"), ("y1", "y2"), ("y2", "p"), ("p", "q"), ("q", "r"), ("r", "p"), ("q", "s"), ("s", "q"),
             ("m1", "m2"), ("m2", "m3"), ("m3", "m1"), ("u", "u1"), ("u1", "u2"), ("u2", "u"), ("v", "u"), ("u", "w"), ("k", "k")]
    groups = {}
    for r in H.cycles(spark.createDataFrame(edges * 2, "source string, target string")).collect():
        groups.setdefault(r["cycle"], []).append(r["node"])
    assert {k: sorted(v) for k, v in groups.items()} == {"x2": ["a", "b", "c", "d", "x1", "x2"], "s": ["p", "q", "r", "s"], "m3": ["m1", "m2", "m3"],
                                                         "u2": ["u", "u1", "u2"], "k": ["k"]}


def test_cycles_of_long_paths_take_few_rounds(spark, monkeypatch):
    """A chain of 100,000 edges, a ring of 70,000 and a ring of 30,000 that hangs on the chain."""
    stored = []
    kept = H.durable
    monkeypatch.setattr(H, "durable", lambda df: (stored.append(1), kept(df))[1])
    edges = spark.range(100000).selectExpr("id AS source", "id + 1 AS target").union(
        spark.range(70000).selectExpr("200000 + id AS source", "200000 + (id + 1) % 70000 AS target")).union(
        spark.range(30000).selectExpr("if(id = 0, 500, 400000 + id) AS source", "if(id = 29999, 500, 400001 + id) AS target"))
    got = {r["cycle"]: r["count"] for r in H.cycles(edges).groupBy("cycle").count().collect()}
    assert got == {269999: 70000, 429999: 30000} and len(stored) <= 40


def test_commit_groups(spark):
    log = spark.createDataFrame([("Añade pantalla",), ("fix nueva pantalla",), ("Corrige bug",), ("cambio en tabla X",), ("merge rama",), ("refactor",), ("otros",)],
                                "message string")
    got = {r["message"]: r["group"] for r in H.classify_commits(log).collect()}
    assert got == {"Añade pantalla": "new", "fix nueva pantalla": "new", "Corrige bug": "fix", "cambio en tabla X": "database", "refactor": "internal", "otros": "other"}


def test_layers(one):
    assert [one(H.layer_of, n) for n in ("CobroDalc", "BusPagos", "PagosWeb", "AppConfig", "CobroTests", "X")] == [
        "data access", "business", "presentation", "infrastructure", "testing", "unclassified"]


def test_context_and_sections(spark):
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(["# Uno", "a", "BUSCA b", "c", "## Dos", "busca d"], 1)], LINES)
    got = {r["line_no"]: (r["match"], r["before"], r["after"]) for r in X.search_context(lines, "busca", 1).collect()}
    assert got == {3: ("BUSCA b", "a", "c"), 6: ("busca d", "## Dos", "")}
    for chunk in (2, 65536):
        assert {(r["line_no"], r["section"]) for r in X.find_sections(lines, "Busca", chunk=chunk).collect()} == {(3, "Uno"), (6, "Dos")}
    elements = spark.createDataFrame([("busca",), ("falta",)], "element string")
    assert [r["element"] for r in X.undocumented(elements, lines).collect()] == ["falta"]


def test_symbols_in_one_pass(spark):
    lines = spark.createDataFrame([("a.cs", 1, "public class Pago {"), ("a.cs", 2, "  var x = new Pago(Cobro = 1);"), ("a.cs", 3, "nada")], LINES)
    got = {(r["symbol"], r["line_no"]): r["pattern"] for r in X.match_patterns(lines, {s: X.symbol_patterns(s) for s in ("Pago", "Cobro")}).collect()}
    assert got == {("Pago", 1): r"class\s+Pago[\s:{<]", ("Pago", 2): r"\s+Pago\s*\(", ("Cobro", 2): r"Cobro\s*="}


def test_controls(spark):
    lines = spark.createDataFrame([("p.aspx", 1, '<asp:Label runat="server" ID="lbl" Text="Hola" />'), ("p.aspx", 2, '<x:Boton Text="Ir" ID="btn">'),
                                   ("q.aspx", 1, '<asp:Label ID="lbl" Text="Hola" />'), ("q.aspx", 2, "<p>no</p>")], LINES)
    assert {(r["id"], r["label"], r["file"]) for r in X.extract_controls(lines).collect()} == {("lbl", "Hola", "p.aspx"), ("btn", "Ir", "p.aspx")}


@pytest.mark.parametrize("chunk", [3, 65536])
def test_ids_fill_gaps(spark, chunk):
    existing = spark.createDataFrame([(i,) for i in [1000, 1002, 3000, 3001, 3004, 2000]], "id bigint")
    wanted = spark.createDataFrame([(5, "error"), (9, "error"), (1, "screen"), (2, "screen"), (3, "screen"), (4, "screen"), (7, "message")], "request bigint, kind string")
    ranges = {"error": (1000, 1002), "message": (2000, 2999), "screen": (3000, None)}
    got = {r["request"]: (r["id"], r["overflow"]) for r in K.allocate_ids(existing, wanted, ranges, chunk).collect()}
    assert got == {5: (1001, False), 9: (3007, True), 1: (3002, False), 2: (3003, False), 3: (3005, False), 4: (3006, False), 7: (2001, False)}


def test_languages(spark):
    texts = spark.createDataFrame([(1, "ES", "Hola"), (2, "ES", "Adiós")], "id bigint, lang string, text string")
    langs = spark.createDataFrame([("ES",), ("PT",)], "lang string")
    have = spark.createDataFrame([(2, "PT")], "id bigint, lang string")
    assert {(r["id"], r["lang"], r["text"]) for r in K.expand_languages(texts, langs, have).collect()} == {
        (1, "ES", "Hola"), (1, "PT", "[TEXTO_PT]"), (2, "ES", "Adiós")}
    with pytest.raises(ValueError):
        K.expand_languages(texts, langs.limit(0), have)


def test_text_routes(spark):
    old = spark.createDataFrame([("a", 1, "A"), ("b", 2, "B"), ("c", 2, "B"), ("d", 4, "D"), ("e", 5, "E")], "control string, id bigint, text string")
    new = spark.createDataFrame([("a", "A2"), ("b", "B2"), ("c", "B"), ("n", "D"), ("x", "X"), ("e", "E")], "control string, text string")
    got = {r["control"]: (r["action"], r["id"]) for r in K.classify_text_changes(old, new, old.select("id", "control")).collect()}
    assert got == {"a": ("update", 1), "b": ("new id and relink", 2), "c": ("same", 2), "n": ("relink", 4), "x": ("add", None), "e": ("same", 5)}


def test_run_statistics(spark):
    hist = spark.createDataFrame([("1", "2026-03-07T10:00:00", "S", "success", ["a", "b"]), ("2", "2026-03-05T10:00:00", "", "FAIL", ["a"]),
                                  ("3", "2026-01-01T10:00:00", "S", "otro", None)], "id string, timestamp string, solution string, status string, agents array<string>")
    s = T.run_summary(hist).first()
    assert (s["total"], s["success"], s["fail"], s["period_from"], s["period_to"], s["success_pct"]) == (3, 1, 1, "2026-01-01", "2026-03-07", 33.33)
    assert [(r["name"], r["total"], r["success"]) for r in T.by_solution(hist).collect()] == [("S", 2, 1), ("(sin nombre)", 1, 0)]
    assert [(r["name"], r["count"]) for r in T.agent_usage(hist).collect()] == [("a", 2), ("b", 1)]
    days = T.trend(hist, date(2026, 3, 7)).collect()
    assert len(days) == 7 and [d["total"] for d in days] == [0, 0, 0, 0, 1, 0, 1]
    assert T.run_summary(hist.limit(0)).first()["period_from"] == ""
    assert [r["id"] for r in T.history_list(hist, 2).collect()] == ["1", "2"]


def test_impact_by_words_equals_breadth_first_search(spark):
    import random
    from tamiz.session import durable
    rng = random.Random(3)
    nodes = [f"n{k}" for k in range(150)]
    edges = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(260)} | {("n1", "n1"), ("n2", "n3"), ("n3", "n2")}
    layer = {n: f"l{k % 4}" for k, n in enumerate(nodes) if k % 5}
    starts = nodes[:140] + ["alone"]
    into = {}
    for a, b in edges:
        into.setdefault(b, set()).add(a)
    want = {}
    for s in starts:
        level, front, seen = {}, {s}, {s}
        for depth in range(1, 5):
            front = {a for b in front for a in into.get(b, ())} - seen
            seen |= front
            if depth == 4:
                cut = bool(front)
            else:
                level.update(dict.fromkeys(front, depth))
        direct = sum(v == 1 for v in level.values())
        want[s] = (direct, len(level) - direct, len(level), len({layer[n] for n in level if n in layer}), cut)
    e = spark.createDataFrame(sorted(edges), "source string, target string")
    l = spark.createDataFrame(sorted(layer.items()), "node string, layer string")
    st = spark.createDataFrame([(s,) for s in starts], "node string").repartition(5)
    got = {r["start"]: (r["direct"], r["indirect"], r["total"], r["layers"], r["cut"]) for r in H.impact(e, st, l, 3).collect()}
    assert got == want
    # Fewer rows are stored than there are pairs of start and node.
    _, rows, _ = H.reach_words(e, st, 3)
    assert durable(rows).count() < sum(v[2] + 1 for v in want.values())
