"""Link graphs: components, bounded paths, closures. Loops of joins; each round's state is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.session import written


def components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """node, component (its least node). Large-star/small-star rounds: O(log n) of them, and the number of edges does not grow.

    Each star needs only the least neighbour of a node, which is a partial aggregation; a node that
    is linked with a third of all others is joined by Spark's skew handling, not collected.
    """
    # Written once, self-links included (they keep lone nodes): what makes the edges runs a single time.
    given = written(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    nodes = given.select(F.explode(F.array("u", "v")).alias("u")).distinct()
    e = given.filter("u <> v")
    before = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = written(small.filter("u <> v").distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head(1)[0])  # one row of two numbers
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    label = e.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.withColumnRenamed("u", "node").join(label.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def bounded_paths(start: DataFrame, edges: DataFrame, most_depth: int, node: str = "node", src: str = "src", dst: str = "dst", expand: DataFrame | None = None, budget: int | None = None) -> DataFrame:
    """origin, node, depth, via of every node reached within ``most_depth`` links, each once by a shortest path; ``via`` is
    the node before it on it (of several, the least), from which ``path_of`` puts paths together.

    With ``expand`` (node, cost) a node is followed only while the costs of the nodes its origin followed before it, in
    order of depth and node, are below ``budget``: nodes that are known already cost nothing and are always followed. The
    nodes beyond it are in the result with ``followed`` = false, so that a caller sees what is incomplete.
    """
    links = edges.select(F.col(src).alias("__s"), F.col(dst).alias("__d")).filter("__s IS NOT NULL AND __d IS NOT NULL AND __s <> __d").distinct()
    links = written(links, "links") if most_depth > 1 else links  # read once for each depth
    front = start.select(F.col(node).alias("origin"), F.col(node).alias("node"), F.lit(0).alias("depth"), F.lit(None).cast(dict(start.dtypes)[node]).alias("via")).distinct()
    if expand is not None:
        front = front.withColumn("spent", F.lit(0).cast("bigint"))
    parts: list[DataFrame] = []
    for depth in range(most_depth + 1):
        if depth:
            step = front.join(links, F.col("node") == F.col("__s"))
            best = step.groupBy("origin", F.col("__d").alias("node")).agg(F.min("node").alias("via"), *([F.max("spent").alias("spent")] if expand is not None else []))
            front = best.withColumn("depth", F.lit(depth)).join(_union(parts).select("origin", "node"), ["origin", "node"], "left_anti")
        if expand is not None:
            front = _followed(front, expand, budget or 0)
        at = written(front, f"depth{depth}")
        parts.append(at.drop("spent"))
        if depth == most_depth or (depth and not at.head(1)):
            break
        front = at.filter("followed") if expand is not None else at
    columns = ["origin", "node", "depth", "via", *(["followed"] if expand is not None else [])]
    return _union([p.select(*columns) for p in parts])


def _followed(front: DataFrame, expand: DataFrame, budget: int) -> DataFrame:
    """Adds followed, and spent with the costs of this depth: a node is followed if it costs nothing or if the budget is not
    used up by the ones before it (a running sum over the nodes of one depth of one origin)."""
    priced = front.join(expand.select("node", F.coalesce("cost", F.lit(1)).cast("bigint").alias("__c")), "node", "left").withColumn("__c", F.coalesce("__c", F.lit(1)))
    w = W.partitionBy("origin").orderBy("node").rowsBetween(W.unboundedPreceding, 0)
    total = F.col("spent") + F.sum("__c").over(w)
    priced = priced.withColumns({"followed": (F.col("__c") == 0) | (total <= budget), "spent": F.least(total, F.lit(budget).cast("bigint"))})
    return priced.withColumn("spent", F.max("spent").over(W.partitionBy("origin"))).drop("__c")


def path_of(reached: DataFrame, most_depth: int) -> DataFrame:
    """Adds path (from the origin to the node) to the rows of ``bounded_paths``: one join a depth."""
    step = reached.select(F.col("origin").alias("__o"), F.col("node").alias("__n"), F.col("via").alias("__v"))
    out = reached.withColumns({"path": F.array("node"), "__at": F.col("via")})
    for _ in range(most_depth):
        longer = F.when(F.col("__at").isNotNull(), F.concat(F.array("__at"), "path")).otherwise(F.col("path"))
        out = out.join(step, (F.col("origin") == F.col("__o")) & (F.col("__at") == F.col("__n")), "left").withColumn("path", longer).withColumn("__at", F.col("__v")).drop("__o", "__n", "__v")
    return out.drop("__at")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def closure(edges: DataFrame, most_rounds: int = 30, src: str = "src", dst: str = "dst") -> DataFrame:
    """src, dst for every node and each it reaches, by doubling of path lengths."""
    known = written(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct(), "closure")
    n = known.count()
    for _ in range(most_rounds):
        more = known.alias("a").join(known.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst").filter("src <> dst")
        known = written(known.union(more).distinct(), "closure")
        m = known.count()
        if m == n:
            return known
        n = m
    raise RuntimeError(f"closure did not settle in {most_rounds} rounds")


def reference_edges(files: DataFrame, unit: str, file: str, code: str, types: str) -> DataFrame:
    """unit, src, dst: file src names a type that its sibling dst declares. Words are matched by an equality join within
    the unit, not by a pattern for each pair of files."""
    words = files.select(unit, F.col(file).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(code), F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0)))).alias("word"))
    owner = files.select(unit, F.col(file).alias("dst"), F.explode(types).alias("word"))
    return words.join(owner, [unit, "word"]).filter("src <> dst").select(unit, "src", "dst").distinct()


def hierarchy_pattern(edges: DataFrame, case: str = "case_id") -> DataFrame:
    """case, component, pattern: the shape of each component of a case's type hierarchy. Nodes are numbered by kind in
    the order of the sorted edges; hierarchies of one case are small, so each is folded as one array."""
    e = edges.dropDuplicates([case, "src", "dst"]).withColumns({"__u": F.concat_ws("\0", case, "src"), "__v": F.concat_ws("\0", case, "dst")})
    comp = components(e, "__u", "__v")
    c = e.join(comp, F.col("__u") == F.col("node")).groupBy(case, "component").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "src_type", "dst_type"))).alias("es"))
    ends = F.flatten(F.transform("es", lambda x: F.array(F.struct(x["src"].alias("n"), x["src_type"].alias("t")), F.struct(x["dst"].alias("n"), x["dst_type"].alias("t")))))
    letter = lambda t: F.when(t.isin("CLASS", "INTERFACE", "ENUM", "RECORD", "ANNOTATION"), F.left(t, F.lit(1))).otherwise("U")
    order = F.aggregate("ends", F.array().cast("array<struct<n:string,t:string>>"), lambda acc, x: F.when(F.exists(acc, lambda y: y["n"] == x["n"]), acc).otherwise(F.concat(acc, F.array(F.struct(x["n"].alias("n"), letter(x["t"]).alias("t"))))))
    name = lambda n: F.get(F.filter("ids", lambda y: y["n"] == n), F.lit(0))["id"]
    ids = F.transform("nodes", lambda x, i: F.struct(x["n"].alias("n"), F.concat(x["t"], F.size(F.filter(F.slice("nodes", F.lit(1), i), lambda y: y["t"] == x["t"])).cast("string")).alias("id")))
    c = c.withColumn("ends", ends).withColumn("nodes", order).withColumn("ids", ids)
    pattern = F.array_join(F.array_sort(F.transform("es", lambda x: F.concat(name(x["src"]), F.lit("->"), name(x["dst"])))), ", ")
    return c.select(case, F.substring_index("component", "\0", -1).alias("component"), pattern.alias("pattern"))
