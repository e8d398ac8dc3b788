"""Graph analytics over tables: edges (src, dst) with string or long vertices, one row for each directed edge.

Loops keep a small frame for each round and cut its lineage with a reliable checkpoint. Edges are cached once a call by
a checkpoint as well, partitioned by the key that the rounds join on.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the folder that the session names. Only a local session may go without: it gets a temporary one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        own = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if own is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="plumbline-"))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as compressed Parquet files in the same folder, for frames of many rows: a checkpoint keeps rows as they are in memory. The
    shuffle files of the statement that writes it go at its end."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        checkpointed(spark.range(1))
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes the files of stored() that nothing reads any more."""
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


# -- projection ---------------------------------------------------------------------------------------------


def projected(edges: DataFrame, owners: DataFrame, relations: Sequence[str], proven: Column) -> DataFrame:
    """edges (src, dst, relation, ...) lifted to their owners (node, owner): adds src_owner, dst_owner and reason:
    filtered (relation or no owner), self, unproven, or null for an edge of the projection. Asked in this order."""
    a = owners.select(F.col("node").alias("src"), F.col("owner").alias("src_owner"))
    b = owners.select(F.col("node").alias("dst"), F.col("owner").alias("dst_owner"))
    out = edges.join(a, "src", "left").join(b, "dst", "left")
    wanted = F.coalesce(F.col("relation").isin(*relations), F.lit(False))
    return out.withColumn(
        "reason",
        F.when(~wanted | F.col("src_owner").isNull() | F.col("dst_owner").isNull(), "filtered")
        .when(F.col("src_owner") == F.col("dst_owner"), "self")
        .when(~proven, "unproven"),
    )


def projection_edges(rows: DataFrame) -> DataFrame:
    """One edge for each pair of owners, with its relation kinds and the occurrences of its proofs."""
    kept = rows.filter(F.col("reason").isNull())
    return kept.groupBy(F.col("src_owner").alias("src"), F.col("dst_owner").alias("dst")).agg(
        F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("relations"), F.sum("occurrences").cast("long").alias("occurrences")
    )


def reason_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("edges"))


def owners_of(nodes: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """nodes (node, kind, parent) -> (node, owner): the nearest of itself and its ancestors whose kind is one of
    kinds; null if there is none. Every node knows the node 2**k steps up after k rounds, so a chain of n takes log2(n) of them;
    what has no answer after that climbs in a cycle of parents, and has no owner."""
    own = F.col("kind").isin(*kinds)
    state = nodes.select("node", F.when(own, F.col("node")).alias("owner"), F.when(own, F.lit(None)).otherwise(F.col("parent")).alias("at"))
    state = checkpointed(state)
    for _ in range(max(2, state.count()).bit_length() + 1):
        if not state.filter(F.col("at").isNotNull()).limit(1).count():
            break
        there = state.select(F.col("node").alias("at"), F.col("owner").alias("o"), F.col("at").alias("next"))
        state = checkpointed(state.join(there, "at", "left").select("node", F.coalesce("owner", "o").alias("owner"), F.col("next").alias("at")))
    return state.select("node", "owner")


def ancestors(parents: DataFrame) -> DataFrame:
    """parents (child, parent) -> (node, ancestor, depth) for all proper ancestors, with the least depth; cycles end where they
    close. Each round doubles the reach: pairs at the full depth of the round before are joined with all pairs."""
    step = checkpointed(parents.filter("parent is not null and child <> parent").select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct())
    seen, reach = step, 1
    while True:
        far = seen.filter(F.col("depth") == reach)
        if not far.limit(1).count():
            return seen
        up = seen.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("further"), F.col("depth").alias("more"))
        longer = far.join(up, "ancestor").select("node", F.col("further").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth")).filter("node <> ancestor")
        seen = checkpointed(seen.union(longer).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
        reach *= 2


# -- metrics --------------------------------------------------------------------------------------------------


def node_metrics(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """vertices (v): in_degree, out_degree (self-loops included), ca, ce (distinct neighbours but itself),
    total_neighbors, instability (null if ca + ce is 0), in_centrality and out_centrality (1 for a lone vertex)."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("v"), F.col("dst").alias("w"), F.lit(1).alias("o")).union(e.select("dst", "src", F.lit(0)))
    other = F.col("v") != F.col("w")
    per = ends.groupBy("v").agg(
        F.count_if(F.col("o") == 0).alias("in_degree"),
        F.count_if(F.col("o") == 1).alias("out_degree"),
        F.count_if((F.col("o") == 0) & other).alias("ca"),
        F.count_if((F.col("o") == 1) & other).alias("ce"),
        F.count_distinct(F.when(other, F.col("w"))).alias("total_neighbors"),
    )
    n = vertices.agg(F.count(F.lit(1)).alias("n"))
    counts = ("in_degree", "out_degree", "ca", "ce", "total_neighbors")
    out = vertices.join(per, "v", "left").na.fill(0, list(counts)).join(F.broadcast(n), F.lit(True))
    central = lambda c: F.when(F.col("n") == 1, 1.0).otherwise(F.col(c) / (F.col("n") - 1))
    return out.withColumns(
        {
            "instability": F.try_divide(F.col("ce").cast("double"), (F.col("ca") + F.col("ce")).cast("double")),
            "in_centrality": central("in_degree"),
            "out_centrality": central("out_degree"),
        }
    ).drop("n")


def at_least(value: Column, bound: float) -> Column:
    """value >= bound, where values as close as 1e-12 (relative) count as equal."""
    near = F.abs(value - bound) <= 1e-12 * F.greatest(F.abs(value), F.lit(abs(bound)))
    return (value >= bound) | near


def candidates(metrics: DataFrame, edges: DataFrame, coupling: int, hub: int, members: int, methods: int, delta: float, central: float) -> DataFrame:
    """(rule_id, subject, object): excessive coupling 101, hub 102, god component 103 (member_count and method_count
    in metrics), unstable dependency 104 (an edge), bottleneck 105 (betweenness in metrics)."""
    rules = [("101", F.col("total_neighbors") >= coupling), ("102", F.col("ca") >= hub)]
    if "member_count" in metrics.columns:
        god = (F.col("member_count") >= members) & (F.col("method_count") >= methods) & (F.col("total_neighbors") >= coupling)
        rules.append(("103", god))
    if "betweenness" in metrics.columns:
        rules.append(("105", at_least(F.col("betweenness"), central)))
    hits = F.array_compact(F.array(*[F.when(p, F.lit(f"ARCH{r}")) for r, p in rules]))
    single = metrics.select(F.explode(hits).alias("rule_id"), F.col("v").alias("subject"), F.lit(None).cast(metrics.schema["v"].dataType).alias("object"))
    a = metrics.select(F.col("v").alias("src"), F.col("instability").alias("i_src"))
    b = metrics.select(F.col("v").alias("dst"), F.col("instability").alias("i_dst"))
    pairs = edges.select("src", "dst").distinct().filter("src != dst").join(a, "src").join(b, "dst")
    pairs = pairs.filter(at_least(F.col("i_dst") - F.col("i_src"), delta))
    return single.union(pairs.select(F.lit("ARCH104"), "src", "dst"))


def pagerank(vertices: DataFrame, edges: DataFrame, alpha: float = 0.85, rounds: int = 200, tolerance: float = 1e-10, fixed: bool = False) -> tuple[DataFrame, bool]:
    """((v, rank), converged). Unweighted distinct edges; dangling mass and teleport spread evenly. Stops when the L1
    change is under n * tolerance; fixed runs all rounds. One round is one join and one aggregation; the dangling mass
    and the change come to the driver together, as one row."""
    n = vertices.count()
    if not n:
        return vertices.withColumn("rank", F.lit(0.0)), True
    e = edges.select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    e = checkpointed(e.join(out, "src"))
    state = checkpointed(vertices.join(out.withColumnRenamed("src", "v"), "v", "left").select("v", F.col("deg").isNull().alias("dangling"), F.lit(1.0 / n).alias("rank")))
    lost = state.filter("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
    for _ in range(rounds):
        sent = e.join(state.select(F.col("v").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("v")).agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        base = (1 - alpha) / n + alpha * lost / n
        moved = state.join(sent, "v", "left").select("v", "dangling", F.col("rank").alias("old"), (F.lit(base) + F.lit(alpha) * F.coalesce("got", F.lit(0.0))).alias("rank"))
        moved = checkpointed(moved)
        change, lost = moved.agg(F.sum(F.abs(F.col("rank") - F.col("old"))), F.sum(F.when(F.col("dangling"), F.col("rank")).otherwise(0.0))).first()
        state = moved.select("v", "dangling", "rank")
        if not fixed and change < n * tolerance:
            return state.select("v", "rank"), True
    return state.select("v", "rank"), fixed


def distances(sources: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """sources (s): breadth-first levels (s, v, dist, paths) with the number of shortest paths, self at 0; as far as edges
    lead, or up to max_depth."""
    e = checkpointed(edges.select("src", "dst").distinct())
    front = sources.select("s", F.col("s").alias("v"), F.lit(0).alias("dist"), F.lit(1.0).alias("paths"))
    seen = front
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(e, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        front = checkpointed(step.join(seen.select("s", "v"), ["s", "v"], "left_anti").select("s", "v", F.lit(depth).alias("dist"), "paths"))
        if not front.limit(1).count():
            break
        seen = checkpointed(seen.union(front))
    return seen


#: So many longs has a row of `levels`; the sources that are their bits walk together.
WORDS = 8
#: So many sources have their names broadcast.
NAMES = 1 << 20


def levels(sources: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(s, v, dist) of `distances`, without the number of paths: sources are numbered, and WORDS * 64 of them walk as the bits of one
    row, which takes as many times fewer rows where their ways meet. A round is a join with the edges and one aggregation by
    bit_or, which adds what came and leaves what is new of it. What a round keeps is in compressed files; its shuffle files
    and the set of the round before go at its end."""
    from .ranks import with_rank

    e = stored(edges.select("src", "dst").distinct())
    place = F.col("n") - 1
    numbered = with_rank(sources.select("s").distinct(), [F.col("s")], "n")
    numbered = checkpointed(numbered.select("s", F.floor(place / 64).alias("word"), (place % 64).cast("int").alias("bit")))
    none, words = F.lit(0).cast("long"), range(WORDS)
    named = lambda kind, value: [value(i).alias(f"{kind}{i}") for i in words]
    own = numbered.select(F.col("s").alias("v"), F.floor(F.col("word") / WORDS).alias("block"), *named("fresh", lambda i: F.when(F.col("word") % WORDS == i, F.expr("shiftleft(1L, bit)")).otherwise(none)))
    front = stored(own)
    state = stored(front.select("v", "block", *named("seen", lambda i: F.col(f"fresh{i}"))))
    out, depth = front.withColumn("dist", F.lit(0)), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        came = front.join(e, F.col("v") == F.col("src")).select(F.col("dst").alias("v"), "block", *named("seen", lambda _: none), *named("came", lambda i: F.col(f"fresh{i}")))
        both = state.select("v", "block", *named("seen", lambda i: F.col(f"seen{i}")), *named("came", lambda _: none)).union(came)
        both = both.groupBy("v", "block").agg(*[F.bit_or(f"{kind}{i}").alias(f"{kind}{i}") for kind in ("seen", "came") for i in words])
        before, state = state, stored(both.select("v", "block", *named("seen", lambda i: F.expr(f"seen{i} | came{i}")), *named("fresh", lambda i: F.expr(f"came{i} & ~seen{i}"))))
        dropped(before)
        front = stored(state.filter(" OR ".join(f"fresh{i} <> 0" for i in words)).select("v", "block", *[f"fresh{i}" for i in words]))
        if not front.limit(1).count():
            break
        out = out.union(front.withColumn("dist", F.lit(depth)))
    names = numbered.groupBy("word").agg(F.collect_list(F.struct("bit", "s")).alias("names"))  # 64 at most
    if numbered.limit(NAMES + 1).count() <= NAMES:
        names = F.broadcast(names)
    out = out.select("v", "block", "dist", F.posexplode(F.array(*[f"fresh{i}" for i in words])).alias("at", "fresh")).filter("fresh <> 0")
    out = out.select("v", "dist", "fresh", (F.col("block") * WORDS + F.col("at")).alias("word")).join(names, "word")
    return out.select("v", "dist", F.explode(F.filter("names", lambda x: F.getbit("fresh", x["bit"]) == 1)).alias("name")).select("name.s", "v", "dist")


def betweenness(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, betweenness): exact, directed, normalised by (n - 1)(n - 2). Shortest-path counts forward, then Brandes'
    dependencies backward, both level by level for all sources at once (sources x vertices rows, so for graphs within
    the analysis limit; callers check it and report null beyond)."""
    n = vertices.count()
    e = checkpointed(edges.select("src", "dst").distinct())
    levels = checkpointed(distances(vertices.select(F.col("v").alias("s")), e))
    deepest = levels.agg(F.max("dist")).first()[0] or 0
    delta = levels.filter(F.col("dist") == deepest).select("s", "v", F.lit(0.0).alias("delta"))
    total = delta
    for depth in range(deepest - 1, 0, -1):
        below = levels.filter(F.col("dist") == depth + 1).select("s", F.col("v").alias("w"), F.col("paths").alias("more"))
        below = below.join(delta.select("s", F.col("v").alias("w"), "delta"), ["s", "w"])
        here = levels.filter(F.col("dist") == depth).select("s", "v", "paths")
        share = here.join(e, F.col("v") == F.col("src")).join(below.withColumnRenamed("s", "t"), (F.col("dst") == F.col("w")) & (F.col("s") == F.col("t")))
        got = share.groupBy("s", "v").agg(F.sum(F.col("paths") / F.col("more") * (1 + F.col("delta"))).alias("delta"))
        delta = checkpointed(here.select("s", "v").join(got, ["s", "v"], "left").na.fill(0.0, ["delta"]))
        total = total.union(delta)
    scale = float((n - 1) * (n - 2)) or 1.0
    through = total.filter("s != v").groupBy("v").agg((F.sum("delta") / scale).alias("betweenness"))
    return vertices.join(through, "v", "left").na.fill(0.0, ["betweenness"]) if n > 2 else vertices.withColumn("betweenness", F.lit(0.0))


# -- components and cycles --------------------------------------------------------------------------------------


def _smallest_reaching(front: DataFrame, e: DataFrame, rounds: int = 10_000) -> DataFrame:
    """labels (v, c): the smallest label that reaches v along e (src, dst); front: (v, c) to start from."""
    labels = checkpointed(front)
    for _ in range(rounds):
        got = e.join(labels.select(F.col("v").alias("src"), "c"), "src").groupBy(F.col("dst").alias("v")).agg(F.min("c").alias("n"))
        new = checkpointed(labels.join(got, "v", "left").select("v", F.least("c", F.coalesce("n", "c")).alias("c"), (F.col("n") < F.col("c")).alias("moved")))
        labels = new.select("v", "c")
        if not new.filter("moved").limit(1).count():
            return labels
    raise RuntimeError("labels did not settle")


def scc(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, component): the smallest vertex of its strongly connected component, singletons included.

    Vertices without an edge in or out are their own component and are trimmed first, again and again. Then colours:
    the smallest vertex that reaches each vertex, forward; the component of a colour's root is what reaches it backward
    within the colour. Rounds go on with what is left."""
    left = checkpointed(vertices.select("v").distinct())
    e = checkpointed(edges.select("src", "dst").filter("src != dst").distinct())
    done = left.select("v", F.col("v").alias("component")).limit(0)
    while True:
        both = e.select(F.col("src").alias("v")).intersect(e.select(F.col("dst").alias("v")))
        single = left.join(both, "v", "left_anti")
        k = single.limit(1).count()
        if k:
            done = done.union(single.select("v", F.col("v").alias("component")))
            left = checkpointed(left.join(both, "v"))
            e = e.join(left.withColumnRenamed("v", "src"), "src", "left_semi").join(left.withColumnRenamed("v", "dst"), "dst", "left_semi")
            e = checkpointed(e.select("src", "dst"))
            continue
        if not left.limit(1).count():
            return done
        colour = _smallest_reaching(left.select("v", F.col("v").alias("c")), e)
        inside = e.join(colour.select(F.col("v").alias("src"), F.col("c").alias("a")), "src").join(colour.select(F.col("v").alias("dst"), F.col("c").alias("b")), "dst")
        back = checkpointed(inside.filter("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        front = colour.filter("v = c")
        reached = front
        while front.limit(1).count():
            step = front.join(back, F.col("v") == F.col("src")).select(F.col("dst").alias("v"), "c").distinct()
            front = checkpointed(step.join(reached, ["v", "c"], "left_anti"))
            reached = checkpointed(reached.union(front))
        done = checkpointed(done.union(reached.select("v", F.col("c").alias("component"))))
        left = checkpointed(left.join(reached, "v", "left_anti"))
        e = e.join(left.withColumnRenamed("v", "src"), "src", "left_semi").join(left.withColumnRenamed("v", "dst"), "dst", "left_semi")
        e = checkpointed(e.select("src", "dst"))


def scc_summary(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, size, internal_edges, is_cyclic); self-loops are neither edges of a cycle nor counted."""
    a = members.select(F.col("v").alias("src"), F.col("component").alias("a"))
    b = members.select(F.col("v").alias("dst"), F.col("component").alias("b"))
    inner = edges.select("src", "dst").distinct().filter("src != dst").join(a, "src").join(b, "dst").filter("a = b")
    inner = inner.groupBy(F.col("a").alias("component")).agg(F.count(F.lit(1)).alias("internal_edges"))
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return size.join(inner, "component", "left").na.fill(0, ["internal_edges"]).withColumn("is_cyclic", F.col("size") > 1)


def cycle_proofs(members: DataFrame, edges: DataFrame, max_trace: int = 256) -> DataFrame:
    """(component, seq, v, truncated): for each component of two or more vertices a closed walk from its smallest vertex:
    the first step goes to the successor that is nearest to the start (ties: smallest), then always one step nearer.
    A proof longer than max_trace is cut to its start."""
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
    inside = members.join(size, "component")
    a = inside.select(F.col("v").alias("src"), "component")
    b = inside.select(F.col("v").alias("dst"), F.col("component").alias("other"))
    e = checkpointed(edges.select("src", "dst").distinct().filter("src != dst").join(a, "src").join(b, "dst").filter("component = other").select("component", "src", "dst"))
    # distance to the start, against the edges
    front = inside.filter("v = component").select("component", "v", F.lit(0).alias("d"))
    seen = checkpointed(front)
    front = seen
    while front.limit(1).count():
        step = front.join(e.withColumnRenamed("dst", "v"), ["component", "v"]).select("component", F.col("src").alias("v"), (F.col("d") + 1).alias("d")).distinct()
        front = checkpointed(step.join(seen.select("component", "v"), ["component", "v"], "left_anti"))
        seen = checkpointed(seen.union(front))
    nearest = W.partitionBy("component", "src").orderBy("d", "dst")
    hop = e.join(seen.withColumnRenamed("v", "dst"), ["component", "dst"]).withColumn("r", F.row_number().over(nearest)).filter("r = 1")
    hop = checkpointed(hop.select("component", "src", "dst", "d"))
    at = hop.filter("src = component").select("component", F.lit(0).alias("seq"), F.col("src").alias("v"), "dst", "d")
    cut = F.col("d") + 2 > max_trace
    long = checkpointed(at.filter(cut).select("component", "seq", "v", F.lit(True).alias("truncated")))
    at = checkpointed(at.filter(~cut))
    out = at.select("component", "seq", "v")
    while at.limit(1).count():
        step = at.select("component", (F.col("seq") + 1).alias("seq"), F.col("dst").alias("v"))
        out = out.union(step)
        at = step.filter("v != component").join(hop.withColumnRenamed("src", "v"), ["component", "v"]).select("component", "seq", "v", "dst", "d")
        at = checkpointed(at)
    return checkpointed(out.select("component", "seq", "v", F.lit(False).alias("truncated")).union(long))


def neighbourhood(start: DataFrame, edges: DataFrame, hops: int, direction: str = "OUT", max_nodes: int = 1_000) -> DataFrame:
    """start (v) -> (v, dist): vertices within hops along OUT, IN or BOTH directions; of the order by distance and
    vertex the first max_nodes."""
    e = edges.select("src", "dst")
    if direction != "OUT":
        back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        e = back if direction == "IN" else e.union(back)
    e = checkpointed(e.distinct())
    seen = start.select("v", F.lit(0).alias("dist")).distinct()
    front = seen
    for k in range(1, hops + 1):
        step = front.join(e, F.col("v") == F.col("src")).select(F.col("dst").alias("v")).distinct()
        front = checkpointed(step.join(seen, "v", "left_anti").select("v", F.lit(k).alias("dist")))
        seen = seen.union(front)
    return seen.orderBy("dist", "v").limit(max_nodes)


def induced(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both ends among vertices (v)."""
    return edges.join(vertices.select(F.col("v").alias("src")), "src", "left_semi").join(vertices.select(F.col("v").alias("dst")), "dst", "left_semi")


def shortest_path(edges: DataFrame, source, target) -> list | None:
    """The vertices of one shortest path, or None. The parent of a vertex is its first discoverer when neighbours
    queue in the order of their ids as text. That is the order of the paths, as lists of text, so each vertex keeps the
    least path of its level and no level is ranked."""
    e = checkpointed(edges.select("src", "dst").distinct())
    kind = e.schema["src"].dataType.simpleString()
    front = e.sparkSession.createDataFrame([(source, [str(source)])], f"v {kind}, path array<string>")
    seen = front = checkpointed(front)
    while True:
        found = front.filter(F.col("v") == F.lit(target)).select(F.col("path").cast(f"array<{kind}>")).first()
        if found:
            return list(found[0])
        step = front.join(e, F.col("v") == F.col("src")).groupBy(F.col("dst").alias("v")).agg(F.min("path").alias("path"))
        step = step.join(seen.select("v"), "v", "left_anti")
        front = checkpointed(step.select("v", F.concat("path", F.array(F.col("v").cast("string"))).alias("path")))
        if not front.limit(1).count():
            return None
        seen = checkpointed(seen.select("v").union(front.select("v")))


def guard(vertices: DataFrame, edges: DataFrame, max_nodes: int = 10_000, max_edges: int = 100_000) -> list[str]:
    """Why the graph is over its analysis limits; empty if it is not."""
    found = {"nodes": (vertices.limit(max_nodes + 1).count(), max_nodes), "edges": (edges.limit(max_edges + 1).count(), max_edges)}
    return [f"more than {most} {what}" for what, (n, most) in found.items() if n > most]


def node_rollup(members: DataFrame) -> DataFrame:
    """members (owner, node, kind) -> member_count (symbols but the owner itself) and method_count of each owner."""
    inner = F.col("node") != F.col("owner")
    return members.filter("owner is not null").groupBy("owner").agg(F.count_if(inner).alias("member_count"), F.count_if(inner & F.col("kind").isin("METHOD", "CONSTRUCTOR")).alias("method_count"))


def with_proof_in(edges: DataFrame, relations: Sequence[str]) -> DataFrame:
    """Edges with at least one proof of the relations. proofs: array of structs with relation."""
    return edges.filter(F.exists("proofs", lambda p: p["relation"].isin(*relations)))


def analysis_status(invalid: Column, diagnostics: Column) -> Column:
    """INVALID, INCOMPLETE if there is any diagnostic, else COMPLETE."""
    return F.when(invalid, "INVALID").when(diagnostics > 0, "INCOMPLETE").otherwise("COMPLETE")
