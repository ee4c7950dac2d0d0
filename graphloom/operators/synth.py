"""Edges that no single reference states: containment across files, implemented interfaces, overridden methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import names
from graphloom.session import cut_lineage

CAP = 40  # implementers of an interface, and bridges of a class and its base: a feature of the passes
BLOCK = 512  # types on either side of a block of pairs
# Types that can own a method, and languages with virtual methods.
OWNERS = ("struct", "class", "interface", "enum", "type_alias")
VIRTUAL = ("go", "java", "kotlin", "csharp", "typescript", "javascript", "swift", "scala", "rust", "python", "tsx", "jsx", "dart")


def contains_across_files(nodes: DataFrame, edges: DataFrame, language: str = "go") -> DataFrame:
    """Methods Recv::m that no type contains, with the type Recv of the same folder: source, target, kind, line."""
    n = nodes.where(F.col("language") == language).withColumn("folder", names.directory(F.col("file_path")))
    types = n.where(F.col("kind").isin(*OWNERS))
    owned = edges.where("kind = 'contains'").join(types.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id"))
    free = n.where("kind = 'method' and qualified_name like '%::%'").join(owned, "id", "left_anti").withColumn("receiver", F.regexp_extract("qualified_name", r"([^:]+)::[^:]*$", 1))
    t = types.select("folder", F.col("name").alias("receiver"), F.struct("file_path", "start_line", "id").alias("t"))
    best = free.join(t, ["folder", "receiver"]).groupBy("id", "start_line").agg(F.min("t").alias("t"))
    return best.select(F.col("t.id").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("kind"), F.col("start_line").alias("line"))


def _method_sets(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    """n, type_id, kind, name, methods, blank for types that contain methods: n grows with file_path, start_line and id; methods are names in order; blank if one has none."""
    wide = cut_lineage(nodes.where(F.col("kind").isin("method", *kinds)).select("id", "kind", "name", "file_path", "start_line"))
    order = (F.col(c).asc_nulls_last() for c in ("file_path", "start_line", "id"))
    types = cut_lineage(wide.where(F.col("kind").isin(*kinds)).orderBy(*order).select(F.monotonically_increasing_id().alias("n"), F.col("id").alias("type_id"), "kind", "name"))
    methods = wide.where("kind = 'method'").select(F.col("id").alias("target"), F.col("name").alias("method"))
    owned = edges.where("kind = 'contains'").select(F.col("source").alias("type_id"), "target").join(types.select("n", "type_id"), "type_id").select("n", "target").join(methods, "target")
    sets = owned.groupBy("n").agg(F.array_sort(F.collect_set("method")).alias("methods"), F.bool_or(F.col("method").isNull()).alias("blank"))
    return sets.join(types, "n")


def implements_by_methods(nodes: DataFrame, edges: DataFrame, kind: str = "struct", base: str = "interface", cap: int | None = CAP) -> DataFrame:
    """Types that have every method of an interface: source, target, via; all of them if ``cap`` is None, else at most ``cap`` per interface, the first by file_path, start_line and id.

    Types of one kind with equal methods are a group, named by its first type, so sets are compared once however many
    types have them.  A wanted set meets the sets that have its rarest method.  With a cap, only the first ``cap`` types
    of each group are followed (and one more, since a type does not implement itself).  Without one, the types that have
    a wanted set and the interfaces that want it meet in blocks, which are spread evenly and only then written out as pairs.
    """
    same = Window.partitionBy("kind", "blank", "methods").orderBy("n")
    sets = _method_sets(nodes, edges, (kind, base)).withColumns({"g": F.first("n").over(same), "k": F.row_number().over(same)})
    # One bit of 64 for each method: a set that lacks a bit lacks a method.
    sets = cut_lineage(sets.withColumn("bits", F.expr("aggregate(methods, 0L, (a, m) -> a | shiftleft(1L, cast(xxhash64(m) & 63 as int)))")))
    within = F.lit(True) if cap is None else F.col("k") <= cap + 1
    types = sets.where((F.col("kind") == kind) & within).withColumnRenamed("g", "h")
    groups = types.where("k = 1").select("h", "methods", "bits")
    bases = sets.where((F.col("kind") == base) & ~F.col("blank"))  # nothing has a method without a name
    having = groups.select("h", F.col("bits").alias("has"), F.explode("methods").alias("method"))
    wanted = bases.where("k = 1").select("g", "bits", F.col("methods").alias("need"))
    spread = having.groupBy("method").agg(F.count("*").alias("many"))
    rarest = wanted.select("g", F.explode("need").alias("method")).join(spread, "method", "left").groupBy("g").agg(F.min(F.struct(F.coalesce("many", F.lit(0)).alias("many"), "method")).alias("rare"))
    pairs = wanted.join(rarest.where("rare.many > 0"), "g").withColumn("method", F.col("rare.method")).join(having, "method").where("bits & ~has = 0").select("g", "need", "h")
    full = pairs.join(groups, "h").where(F.size(F.array_except("need", "methods")) == 0).select("g", "h").join(types.select("h", "n", "type_id"), "h")
    first = full.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy("n"))).where(within)
    if cap is None:
        block = F.expr(f"(k - 1) div {BLOCK}")
        sources = first.groupBy("g", block.alias("i")).agg(F.collect_list("type_id").alias("sources"))
        targets = bases.groupBy("g", block.alias("j")).agg(F.collect_list(F.struct(F.col("type_id").alias("target"), F.col("name").alias("via"))).alias("targets"))
        # By number, since few bytes in become many rows out, and partitions that look small would be put together.
        blocks = sources.join(targets, "g").select("sources", "targets").repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return blocks.select("sources", F.explode("targets").alias("x")).select(F.explode("sources").alias("source"), "x.target", "x.via").where("source <> target")
    found = first.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("k", "type_id"))).alias("found"))
    each = bases.select("g", F.col("type_id").alias("target"), F.col("name").alias("via")).join(found, "g")
    others = F.slice(F.filter("found", lambda x: x["type_id"] != F.col("target")), 1, cap)
    return each.select(F.explode(others).alias("x"), "target", "via").select(F.col("x.type_id").alias("source"), "target", "via")


def override_bridges(nodes: DataFrame, edges: DataFrame, cap: int = CAP) -> DataFrame:
    """From a base's method to the same-named method of each class that extends or implements it: source, target, via."""
    classes = nodes.where(F.col("kind").isin("class", "struct") & F.col("language").isin(*VIRTUAL)).select(F.col("id").alias("cls"))
    up = edges.where(F.col("kind").isin("extends", "implements")).select(F.col("source").alias("cls"), F.col("target").alias("base")).where("cls <> base").distinct().join(classes, "cls", "left_semi")
    methods = nodes.where("kind = 'method'").select(F.col("id").alias("target"), F.col("name").alias("via"), "file_path", "start_line")
    owned = edges.where("kind = 'contains'").select("source", "target").distinct().join(methods, "target")
    mine = owned.select(F.col("source").alias("cls"), F.col("target").alias("impl"), "via", "file_path", "start_line")
    theirs = owned.select(F.col("source").alias("base"), F.col("target").alias("base_method"), "via")
    pairs = up.join(mine, "cls").join(theirs, ["base", "via"]).where("impl <> base_method")
    order = Window.partitionBy("cls", "base").orderBy("file_path", "start_line", "impl", "base_method")
    return pairs.withColumn("k", F.row_number().over(order)).where(F.col("k") <= cap).select(F.col("base_method").alias("source"), F.col("impl").alias("target"), "via").distinct()


def synthesize(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target, kind, via, synthesized_by: the three passes, each over the edges of those before it.

    Go's containment across files first, since it completes the methods of its structs; then implemented interfaces;
    then bridges from a base's methods to those of the types that extend or implement it.
    """
    have = edges.select("source", "target", "kind")
    go = nodes.where("language = 'go'")
    contains = cut_lineage(contains_across_files(nodes, have).select("source", "target", "kind"))
    have = have.unionByName(contains)
    implements = cut_lineage(implements_by_methods(go, have))
    have = have.unionByName(implements.select("source", "target", F.lit("implements").alias("kind")))
    bridges = override_bridges(nodes, have)
    none = F.lit(None).cast("string")
    return (
        contains.select("source", "target", "kind", none.alias("via"), none.alias("synthesized_by"))
        .unionByName(implements.select("source", "target", F.lit("implements").alias("kind"), "via", F.lit("go-implements").alias("synthesized_by")))
        .unionByName(bridges.select("source", "target", F.lit("calls").alias("kind"), "via", F.lit("interface-impl").alias("synthesized_by")))
    )
