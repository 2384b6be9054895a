"""Change history: deltas, tickets, churn, dependencies, coverage, commit groups, graph shape."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.functions import fixed_values as V
from tamiz.operators.ordered import first_rows
from tamiz.session import durable


def _moment(value: datetime) -> Column:
    """A literal without time zone, so the session's zone does not move it."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def delta(commits: DataFrame, since: datetime, until: datetime, limit: int | None = None,
          path: str | None = None, files: DataFrame | None = None) -> DataFrame:
    """Commits of a time range, newest first; with a path, those that touch it."""
    if until < since:
        raise ValueError("inverted range: the end is before the start")
    out = commits.where(F.col("ts").between(_moment(since), _moment(until)))
    if path is not None:
        touched = files.where(F.col("path").startswith(path)).select("revision")
        out = out.join(touched, "revision", "left_semi")
    out = out.orderBy(F.desc("ts"), F.desc("revision"))
    return out if limit is None else out.limit(limit)


def delta_summary(commits: DataFrame, limit: int) -> DataFrame:
    return commits.agg(F.count("*").alias("commits"), (F.count("*") >= limit).alias("truncated"))


def ticket_ids(col: Column) -> Column:
    """Ticket ids of a message, ``#123`` forms first, then ``ABC-123`` forms, once each."""
    hashes = F.transform(F.regexp_extract_all(col, F.lit(V.HASH_TICKET), F.lit(1)),
                         lambda t: F.concat(F.lit("#"), t))
    keys = F.regexp_extract_all(col, F.lit(V.KEY_TICKET), F.lit(1))
    return F.array_distinct(F.concat(hashes, keys))


def last_action(files: DataFrame, order: str) -> DataFrame:
    """One row per path with its last action in log order."""
    return files.groupBy("path").agg(F.max_by("action", order).alias("action"))


def delta_since_last_delivery(commits: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    """Commits after the last cut of their environment and solution. Keys without a delivery have
    no start, so they fail instead of being taken from the beginning."""
    cut = registry.groupBy(*keys).agg(F.max("cut").alias("cut"))
    known = commits.join(cut, keys, "left")
    missing = F.raise_error(F.concat(F.lit("no delivery registered for "), F.concat_ws("/", *keys)))
    start = F.when(F.col("cut").isNull(), missing.cast("timestamp_ntz")).otherwise(F.col("cut"))
    return known.where(F.col("ts") > start)


def diff_summary(diff: DataFrame, symbols: int = 10) -> DataFrame:
    """Added and removed lines of ``(file, line_no, sign, text)`` and the first ten symbols."""
    counts = diff.groupBy("file").agg(F.count_if(F.col("sign") == "+").alias("added"),
                                      F.count_if(F.col("sign") == "-").alias("removed"))
    name = F.regexp_extract("text", V.MEMBER_SYMBOL, 1)
    first = (diff.where((F.col("sign") == "+") & (name != "")).groupBy("file", name.alias("symbol"))
             .agg(F.min("line_no").alias("at")))
    kept = first_rows(first, ["file"], ["at"], symbols).groupBy("file").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "symbol"))), lambda s: s["symbol"]).alias("symbols"))
    return counts.join(kept, "file", "left").withColumn(
        "symbols", F.coalesce("symbols", F.array().cast("array<string>")))


GENERATED = r"(?i)(\.designer\.cs$|[\\/](bin|obj)[\\/])"


def hotspots(changes: DataFrame, sizes: DataFrame, top: int = 15, trivial: int = 0) -> DataFrame:
    """Files that change often and are large. ``changes(path, revision)``, ``sizes(path, size)``;
    each measure is cut into thirds by its quantiles."""
    churn = changes.groupBy("path").agg(F.count_distinct("revision").alias("churn"))
    both = durable(sizes.where(~F.col("path").rlike(GENERATED) & (F.col("size") > trivial)).join(churn, "path"))
    # An exact quantile keeps one counter per distinct value: change counts and sizes repeat a lot.
    cuts = both.agg(*[F.percentile(c, F.lit(q)).alias(f"{c}_{n}")
                      for c in ("churn", "size") for n, q in (("lo", 1 / 3), ("hi", 2 / 3))]).first()
    level = lambda c: (F.when(F.col(c) > cuts[f"{c}_hi"], 3).when(F.col(c) > cuts[f"{c}_lo"], 2)
                       .otherwise(1))
    scored = both.withColumn("churn_level", level("churn")).withColumn("size_level", level("size"))
    total = F.col("churn_level") + F.col("size_level")
    priority = F.when(total == 6, "high").when(F.greatest("churn_level", "size_level") == 3, "medium").otherwise("low")
    return (scored.withColumn("priority", priority)
            .orderBy(total.desc(), F.desc("churn"), F.desc("size"), "path").limit(top))


def shared_dependencies(edges: DataFrame) -> DataFrame:
    """Projects of ``(solution, project)`` used by more than one solution, with their number."""
    return (edges.groupBy("project").agg(F.count_distinct("solution").alias("impact"))
            .where("impact > 1"))


def dependency_users(edges: DataFrame) -> DataFrame:
    """The solutions behind each shared project, one row each."""
    return edges.distinct().join(shared_dependencies(edges), "project").select("project", "solution", "impact")


def version_conflicts(packages: DataFrame) -> DataFrame:
    """Packages of ``(solution, package, version)`` met in several versions, solutions per version."""
    per = packages.groupBy("package", "version").agg(F.count_distinct("solution").alias("solutions"))
    several = per.groupBy("package").agg(F.count("*").alias("versions")).where("versions > 1")
    return per.join(several, "package")


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """Elements that refer to each start within ``depth`` steps: ``(start, node, level)``.

    ``edges(source, target)`` means source refers to target. Breadth first; every round is stored,
    so the plan does not grow and a lost executor costs one round at most.
    """
    edges = durable(edges.select("source", "target").distinct().repartition("target"))
    seen = durable(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("level")).distinct())
    front = seen
    for level in range(1, depth + 1):
        step = (front.join(edges, front["node"] == edges["target"])
                .select("start", edges["source"].alias("node")).distinct())
        front = durable(step.join(seen, ["start", "node"], "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("level > 0")


def _bits(rows: DataFrame, counted: list[str]) -> DataFrame:
    """``(start number, name...)``: for each start of a word the sum of its bit over rows, of every column of ``counted``."""
    one = lambda c, k: F.sum(F.shiftrightunsigned(F.col(c), k).bitwiseAND(F.lit(1).cast("long")))
    sums = rows.groupBy("word").agg(*[F.array(*[one(c, k) for k in range(64)]).alias(c) for c in counted])
    return sums.select("word", F.posexplode(F.arrays_zip(*counted)).alias("bit", "of")).select(
        (F.shiftleft("word", 6) + F.col("bit")).alias("number"), *[F.coalesce(F.col(f"of.{c}"), F.lit(0).cast("long")).alias(c) for c in counted])


def reach_words(edges: DataFrame, starts: DataFrame, depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Breadth-first reach of all starts at once, 64 to a row: the numbered starts ``(number, node)``, rows ``(node, word, bits,
    level)`` of the starts that first reach a node at a level, and those that would reach it beyond ``depth``.

    The bits of a word are carried along the edges and or-ed; what a node has already been reached by is masked off, so no pair of
    start and node is ever a row. Every round is stored."""
    edges = durable(edges.select("source", "target").distinct())
    numbered = durable(starts.select("node").distinct().withColumn("number", F.monotonically_increasing_id()))
    word, bit = F.shiftright("number", 6), F.expr("shiftleft(1L, CAST(number & 63 AS INT))")
    own = numbered.select("node", word.alias("word"), bit.alias("bits")).groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))
    seen = front = durable(own)
    found = front.withColumn("level", F.lit(0))
    for level in range(1, depth + 2):
        step = front.join(edges, front["node"] == edges["target"]).groupBy(edges["source"].alias("node"), "word").agg(F.bit_or("bits").alias("new"))
        new = F.col("new").bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0).cast("long"))))
        front = durable(step.join(seen, ["node", "word"], "left").select("node", "word", new.alias("bits")).where("bits <> 0"))
        if level > depth or front.isEmpty():
            break
        found = found.unionByName(front.withColumn("level", F.lit(level)))
        seen = durable(seen.unionByName(front).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")))
    return numbered, found, front


def impact(edges: DataFrame, starts: DataFrame, layers: DataFrame, depth: int) -> DataFrame:
    """Direct and indirect references per start, and the level by how much they touch. A start that nothing refers to has zeros;
    ``cut`` tells that references go on beyond ``depth``. A node of several layers counts once as a reference."""
    numbered, rows, beyond = reach_words(edges, starts, depth)
    found = rows.where("level > 0")
    none = F.lit(0).cast("long")
    counted = _bits(found.select("word", F.when(F.col("level") == 1, F.col("bits")).otherwise(none).alias("direct"),
                                 F.when(F.col("level") > 1, F.col("bits")).otherwise(none).alias("indirect")), ["direct", "indirect"])
    touched = found.join(layers.select("node", "layer").where("layer IS NOT NULL").distinct(), "node").groupBy("word", "layer").agg(F.bit_or("bits").alias("layers"))
    further = beyond.groupBy("word").agg(F.bit_or("bits").alias("further"))
    zero = lambda c: F.coalesce(F.col(c), none).alias(c)
    agg = (numbered.join(counted, "number", "left").join(_bits(touched, ["layers"]), "number", "left").join(_bits(further, ["further"]), "number", "left")
           .select(F.col("node").alias("start"), zero("direct"), zero("indirect"), (zero("direct") + zero("indirect")).alias("total"), zero("layers"),
                   (F.coalesce("further", none) > 0).alias("cut")))
    return agg.withColumn("impact", F.when(F.col("total") <= 1, "low").when(F.col("layers") <= 2, "medium")
                          .otherwise("high"))


def unreferenced(symbols: DataFrame, refs: DataFrame, inconclusive: Column) -> DataFrame:
    """Symbols nothing refers to; those an exclusion covers are inconclusive, never dead."""
    return (symbols.join(refs.select("symbol").distinct(), "symbol", "left_anti")
            .withColumn("verdict", F.when(inconclusive, "inconclusive").otherwise("dead")))


def reference_coverage(public: DataFrame, test_refs: DataFrame, by: list[str] = ()) -> DataFrame:
    """Share of public symbols that tests refer to, per group."""
    used = test_refs.select("symbol").distinct().withColumn("covered", F.lit(True))
    return (public.join(used, "symbol", "left").groupBy(*by)
            .agg(F.count("*").alias("symbols"), F.count("covered").alias("covered"))
            .withColumn("percent", F.round(F.col("covered") * 100 / F.col("symbols"), 2)))


def classify_commits(commits: DataFrame, since: datetime | None = None, groups=None) -> DataFrame:
    """One functional group per commit by the first keyword group met; noise is left out."""
    text = F.lower("message")
    any_of = lambda words: F.array_max(F.array(*[text.contains(w) for w in words]))
    kind = F.lit("other")
    for name, words in reversed(groups or V.COMMIT_GROUPS):
        kind = F.when(any_of(words), F.lit(name)).otherwise(kind)
    out = commits.where(~any_of(V.COMMIT_NOISE))
    if since is not None:
        out = out.where(F.col("ts") >= _moment(since))
    return out.withColumn("group", kind)


def layer_of(col: Column) -> Column:
    return F.coalesce(*[F.when(col.rlike(rx), F.lit(name)) for name, rx in V.LAYER_RULES], F.lit("unclassified"))


def graph_ends(edges: DataFrame) -> DataFrame:
    """Nodes of ``(source, target)`` with no incoming or no outgoing edge."""
    out = edges.select(F.col("source").alias("node")).distinct().withColumn("has_out", F.lit(True))
    into = edges.select(F.col("target").alias("node")).distinct().withColumn("has_in", F.lit(True))
    both = out.join(into, "node", "full_outer")
    no = lambda c: F.col(c).isNull()
    return both.select("node", no("has_in").alias("entry"), no("has_out").alias("leaf")).where("entry OR leaf")


def _chains(edges: DataFrame) -> DataFrame | None:
    """Nodes with one edge in and one out: ``(node, back, start, end, top, ring)``, between which other nodes their chain lies, or
    that it is a ring of its own, whose greatest node is ``top``. Pointers double their reach in every round, so a chain takes rounds
    by the logarithm of its length."""
    out = edges.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("n"), F.max("target").alias("end")).where("n = 1")
    into = edges.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("m"), F.max("source").alias("back")).where("m = 1")
    state = durable(out.join(into, "node").select("node", "back", F.col("back").alias("start"), "end", F.col("node").alias("top")))
    if state.isEmpty():
        return None
    before = None
    while True:
        ahead = state.select(F.col("node").alias("end"), F.col("end").alias("end2"), F.col("top").alias("top2"))
        behind = state.select(F.col("node").alias("start"), F.col("start").alias("start2"))
        state = durable(state.join(ahead, "end", "left").join(behind, "start", "left").select(
            "node", "back", F.coalesce("start2", "start").alias("start"), F.coalesce("end2", "end").alias("end"), F.greatest("top", "top2").alias("top"),
            F.col("end2").isNotNull().alias("ring"), F.col("start2").isNotNull().alias("tied"), (F.col("top2") > F.col("top")).alias("moved")))
        # A pointer that leaves its chain stays; those of rings never do, and are whole when their greatest nodes no longer change.
        now = state.agg(F.count_if("ring") + F.count_if("tied"), F.count_if("moved")).first()
        if now[0] == 0 or (now[0] == before and now[1] == 0):
            return state.select("node", "back", "start", "end", "top", "ring")
        before, state = now[0], state.select("node", "back", "start", "end", "top")


def _core(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Edges left after taking away, again and again, nodes without edges in or out, and joining the ends of chains; and the
    chains of each round."""
    edges, levels = durable(edges), []
    count = edges.count()
    while count:
        kept = edges.join(edges.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
        kept = durable(kept.join(edges.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
        chains = _chains(kept)
        if chains is not None:
            levels.append(chains)
            over = chains.where("NOT ring AND back = start AND start <> end").select(F.col("start").alias("source"), F.col("end").alias("target"))
            inner = chains.select("node")
            direct = kept.join(inner.withColumnRenamed("node", "source"), "source", "left_anti").join(inner.withColumnRenamed("node", "target"), "target", "left_anti")
            kept = durable(direct.select("source", "target").union(over).distinct())
        edges, before = kept, count
        count = edges.count()
        if count == before:
            break
    return edges, levels


def _spread(edges: DataFrame, state: DataFrame) -> DataFrame:
    """Carry the greatest label of ``(node, label)`` along the edges until nothing changes."""
    while True:
        pushed = edges.join(state, edges["source"] == state["node"]).select(edges["target"].alias("node"), "label")
        best = pushed.groupBy("node").agg(F.max("label").alias("new"))
        after = durable(state.join(best, "node", "left").select(
            "node", F.greatest("label", "new").alias("label"), (F.col("new") > F.col("label")).alias("moved")))
        state = after.select("node", "label")
        if after.where("moved").isEmpty():
            return state


def _strong(rest: DataFrame, levels: list[DataFrame]) -> list[DataFrame]:
    """Groups ``(cycle, node)`` of the edges that `_core` leaves; the chains it joins on the way are added to ``levels``."""
    found = []
    while not rest.isEmpty():
        nodes = rest.select(F.col("source").alias("node")).union(rest.select("target")).distinct()
        color = _spread(rest, durable(nodes.withColumn("label", F.col("node"))))
        same = durable(rest.join(color.select(F.col("node").alias("source"), F.col("label").alias("a")), "source")
                       .join(color.select(F.col("node").alias("target"), F.col("label").alias("b")), "target")
                       .where("a = b").select("source", "target"))
        front = group = durable(color.where("node = label").select(F.col("node").alias("cycle"), "node"))
        while True:
            step = (front.join(same, front["node"] == same["target"])
                    .select("cycle", same["source"].alias("node")).distinct())
            front = durable(step.join(group, ["cycle", "node"], "left_anti"))
            if front.isEmpty():
                break
            group = group.unionByName(front)
        found.append(group.join(group.groupBy("cycle").count().where("count > 1").select("cycle"), "cycle", "left_semi"))
        done = durable(group.select("node").distinct())
        left = (rest.join(done.withColumnRenamed("node", "source"), "source", "left_anti")
                .join(done.withColumnRenamed("node", "target"), "target", "left_anti"))
        rest, more = _core(left.select("source", "target"))
        levels += more
    return found


def cycles(edges: DataFrame) -> DataFrame:
    """Cyclic groups: ``(cycle, node)``, a group being nodes that all reach each other, named by its greatest node. A node with an
    edge to itself is a group too.

    Ends are trimmed and chains joined in turn, which takes rounds by the logarithm of the longest chain and of a tree's size. On
    what is left, labels travel forward along the edges; within one label the nodes that reach its owner form one group, in rounds
    by the number of chains of the longest path. Then the chains go back, each to the group that holds both its ends. Each round
    costs joins on the edges, never all pairs of a group."""
    loops = edges.where("source = target").select(F.col("source").alias("cycle"), F.col("source").alias("node")).distinct()
    rest, levels = _core(edges.where("source <> target").select("source", "target").distinct())
    groups = _strong(rest, levels)
    members = loops.limit(0)
    for group in groups:
        members = members.unionByName(group)
    for chains in reversed(levels):
        members = durable(members)
        lone = chains.where("NOT ring AND start = end").select(F.col("start").alias("node")).distinct().join(members, "node", "left_anti")
        whole = durable(members.unionByName(lone.select(F.col("node").alias("cycle"), "node")))
        inside = (chains.where("NOT ring").join(whole.select(F.col("node").alias("start"), "cycle"), "start")
                  .join(whole.select(F.col("node").alias("end"), F.col("cycle").alias("other")), "end").where("cycle = other").select("cycle", "node"))
        members = whole.unionByName(inside).unionByName(chains.where("ring").select(F.col("top").alias("cycle"), "node"))
    members = durable(members)
    names = members.groupBy("cycle").agg(F.max("node").alias("name"))
    return loops.unionByName(members.join(names, "cycle").select(F.col("name").alias("cycle"), "node"))
