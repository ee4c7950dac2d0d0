"""References to nodes: each rule is a join that yields (ref_id, target_id, confidence, resolved_by, rule); the first rule that yields one wins.

Candidates of a rule are kept in the order of file, line and id, so that "the first" means the same everywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import names
from graphloom.session import cut_lineage

# Packages of Go's standard library and Go's built-ins, which are no nodes of a repository.
GO_PACKAGES = (
    "fmt os io net http log math sort sync time path bytes strings strconv errors context json xml csv html template regexp reflect runtime testing flag bufio "
    "crypto encoding filepath hash mime rand signal sql syscall unicode unsafe atomic binary debug exec heap ring scanner tar zip gzip zlib tls url user pprof "
    "trace ast build parser printer token types cgo plugin race ioutil utilruntime utilwait utilnet"
).split()
GO_BUILTINS = (
    "make new len cap append copy delete close panic recover print println complex real imag error nil true false iota int int8 int16 int32 int64 uint uint8 "
    "uint16 uint32 uint64 uintptr float32 float64 complex64 complex128 string bool byte rune any"
).split()
# What is tried after a module's path, in this order; the bare path comes last.
MODULE_ENDINGS = {
    "typescript": (".ts", ".tsx", ".d.ts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"),
    "tsx": (".tsx", ".ts", ".d.ts", ".js", ".jsx", "/index.tsx", "/index.ts", "/index.js"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs", "/index.js", "/index.jsx"),
    "jsx": (".jsx", ".js", "/index.jsx", "/index.js"),
    "python": (".py", "/__init__.py"),
}
TYPES = ("class", "struct", "interface")
SCRIPTS = ("typescript", "tsx", "javascript", "jsx", "python")


def _first(rows: DataFrame, *order: Column) -> DataFrame:
    """One row per reference, by an order that ends in the candidates' own."""
    w = Window.partitionBy("ref_id").orderBy(*order, "file_path", "start_line", "id")
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def _found(rows: DataFrame, confidence: Column | float, by: str, rule: int) -> DataFrame:
    c = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return rows.select("ref_id", F.col("id").alias("target_id"), c.cast("double").alias("confidence"), F.lit(by).alias("resolved_by"), F.lit(rule).alias("rule"))


def _nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "kind", "name", "qualified_name", "file_path", "language", "start_line", F.coalesce("is_exported", F.lit(False)).alias("is_exported"), "return_type")


def _refs(refs: DataFrame) -> DataFrame:
    return refs.select(
        "ref_id", "from_node_id", "reference_name", "reference_kind", F.col("line").alias("ref_line"), "candidates",
        F.coalesce("file_path", F.lit("")).alias("ref_file"), F.coalesce("language", F.lit("unknown")).alias("ref_language"),
    )


def _relative(module: Column, folder: Column, language: Column) -> Column:
    """A relative module name against a folder; null for absolute ones. Python's dots are levels, elsewhere .. goes up."""
    dots = F.length(F.regexp_extract(module, r"^\.+", 0))
    steps = F.when(
        language == "python",
        F.concat(F.array_repeat(F.lit(".."), dots - 1), F.split(F.expr("substring(module, length(regexp_extract(module, '^[.]+', 0)) + 1)"), r"\.")),
    ).otherwise(F.split(module, "/"))
    parts = F.aggregate(
        F.concat(F.split(folder, "/"), steps),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.when(module.startswith("."), F.array_join(parts, "/"))


def by_import(refs: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Imports with a module: the module's file, then the symbol in it, an exported one if there is; Python tries a submodule first."""
    r, n = _refs(refs), _nodes(nodes)
    asked = r.where((F.col("reference_kind") == "imports") & (F.size("candidates") > 0) & F.col("ref_language").isin(*SCRIPTS)).withColumn("module", F.element_at("candidates", 1))
    asked = asked.withColumn("folder", names.directory(F.col("ref_file")))
    sub = F.when(F.col("module").endswith("."), F.concat("module", "reference_name")).otherwise(F.concat_ws(".", "module", "reference_name"))
    endings = F.create_map(*(x for k, v in MODULE_ENDINGS.items() for x in (F.lit(k), F.array(*map(F.lit, (*v, ""))))))
    paths = files.select(F.col("path").alias("found")).distinct()

    def resolved(rows: DataFrame) -> DataFrame:
        based = rows.withColumn("base", _relative(F.col("module"), F.col("folder"), F.col("ref_language"))).where("base is not null")
        tried = based.select("*", F.posexplode(F.element_at(endings, F.col("ref_language"))).alias("pos", "ending")).withColumn("path", F.concat("base", "ending")).where("path <> ''")
        return tried.join(paths, F.col("path") == F.col("found")).groupBy("ref_id", "reference_name").agg(F.min_by("path", "pos").alias("file"))

    whole = resolved(asked.where("ref_language = 'python'").withColumn("module", sub)).withColumn("id", F.concat(F.lit("file:"), "file"))
    whole = whole.join(n.select("id"), "id", "left_semi")
    inside = resolved(asked).join(n, (F.col("name") == F.col("reference_name")) & (F.col("file_path") == F.col("file")))
    symbols = _first(inside, F.desc("is_exported"))
    found = _found(symbols, F.when(F.col("is_exported"), 0.95).otherwise(0.85), "import", 1).join(whole.select("ref_id"), "ref_id", "left_anti")
    return _found(whole, 0.95, "import", 1).unionByName(found)


def _ancestors(folder: Column) -> Column:
    """A folder and all folders above it, the empty one last."""
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def _joined(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "/")


# What a Rust path can lead to, and files that are their folder's module.
RUST_TARGETS = ("function", "struct", "enum", "trait", "type_alias", "constant", "method", "class", "interface")
RUST_ROOTS, RUST_OWN = ("lib.rs", "main.rs"), ("mod.rs", "lib.rs", "main.rs")


def by_rust_path(refs: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Rust's use paths: crate, self, super or bare names lead from a folder over module files to one that has the last name.

    The crate begins at the nearest folder above with lib.rs or main.rs.  A bare path is tried below the file's own module
    and then below the crate.  Every module on the way must be an indexed file; what stands in the same file is none.
    """
    n = _nodes(nodes)
    paths = files.select("path").where("path is not null").distinct()
    r = _refs(refs).where((F.col("reference_kind") == "imports") & (F.col("ref_language") == "rust") & F.col("reference_name").contains("::"))
    r = r.withColumn("parts", F.filter(F.split("reference_name", "::"), lambda x: x != "")).where(F.size("parts") >= 2)
    folder, base = names.directory(F.col("ref_file")), names.base_name(F.col("ref_file"))
    r = r.select("ref_id", "ref_file", F.element_at("parts", -1).alias("leaf"), F.slice("parts", F.lit(1), F.size("parts") - 1).alias("modules"), folder.alias("folder"))
    own = F.when(base.isin(*RUST_OWN), F.col("folder")).otherwise(_joined(F.col("folder"), F.regexp_replace(base, r"\.rs$", "")))
    roots = paths.where(names.base_name(F.col("path")).isin(*RUST_ROOTS)).select(names.directory(F.col("path")).alias("above")).distinct()
    crates = r.select("folder").distinct().select("folder", F.posexplode(_ancestors(F.col("folder"))).alias("up", "above")).join(roots, "above").groupBy("folder").agg(F.min_by("above", "up").alias("crate"))
    first = F.element_at("modules", 1)
    supers = F.size("modules") - F.size(F.filter("modules", lambda x: x != "super"))
    begins = (
        F.when(first == "crate", F.array("crate"))
        .when(first == "self", F.array("own"))
        .when(first == "super", F.array(F.element_at(F.concat(_ancestors(F.col("own")), F.array_repeat(F.lit(""), supers)), supers + 1)))
        .otherwise(F.array("own", "crate"))
    )
    told = r.withColumn("own", own).join(crates, "folder", "left").select("ref_id", "ref_file", "leaf", F.filter("modules", lambda x: ~x.isin("self", "crate", "super")).alias("modules"), F.posexplode(begins).alias("choice", "begin"))
    told = told.where("begin is not null and size(modules) > 0")
    steps = told.select("*", F.posexplode("modules").alias("i", "module")).withColumn("here", _joined(F.col("begin"), F.array_join(F.slice("modules", F.lit(1), F.col("i")), "/"), F.col("module")))
    tried = steps.select("*", F.posexplode(F.array(F.concat("here", F.lit(".rs")), F.concat("here", F.lit("/mod.rs")))).alias("form", "found")).join(paths, F.col("found") == F.col("path"))
    met = tried.groupBy("ref_id", "ref_file", "leaf", "choice", F.size("modules").alias("n")).agg(F.countDistinct("i").alias("met"), F.min_by("found", F.struct(-F.col("i"), "form")).alias("file"))
    whole = met.where("met = n").groupBy("ref_id", "ref_file", "leaf").agg(F.min_by("file", "choice").alias("file")).where("file <> ref_file")
    hits = whole.join(n.where(F.col("kind").isin(*RUST_TARGETS)), (F.col("file") == F.col("file_path")) & (F.col("leaf") == F.col("name")))
    return _found(_first(hits), 0.95, "import", 2)


def go_imports(contents: DataFrame) -> DataFrame:
    """file, local_name, source of the imports of Go files, single ones and blocks; without an alias the name is the last part of the path."""
    text = contents.where(F.col("path").endswith(".go") & F.col("content").isNotNull()).select(F.col("path").alias("file"), "content")
    single = F.regexp_extract_all("content", F.lit(r"import\s+((?:\w+\s+)?[\"'][^\"']+[\"'])"), F.lit(1))
    inside = F.flatten(F.transform(F.regexp_extract_all("content", F.lit(r"(?s)import\s*\(\s*([^)]+)\s*\)"), F.lit(1)), lambda x: F.regexp_extract_all(x, F.lit(r"((?:\w+\s+)?[\"'][^\"']+[\"'])"), F.lit(1))))
    one = text.select("file", F.explode(F.concat(single, inside)).alias("spec")).withColumn("source", F.regexp_extract("spec", r"[\"']([^\"']+)[\"']", 1))
    alias = F.regexp_extract("spec", r"^(\w+)\s", 1)
    return one.select("file", F.when(alias != "", alias).otherwise(F.regexp_extract("source", "[^/]*$", 0)).alias("local_name"), "source").distinct()


def go_modules(contents: DataFrame) -> DataFrame:
    """root (a folder) and module of each go.mod among the texts."""
    mods = contents.where((names.base_name(F.col("path")) == "go.mod") & F.col("content").isNotNull())
    plain = F.regexp_replace("content", "//[^\\n]*", "")
    module = F.regexp_replace(F.regexp_extract(plain, r"(?m)^\s*module\s+(\S+)\s*$", 1), "^[\"'`]+|[\"'`]+$", "")
    return mods.select(names.directory(F.col("path")).alias("root"), module.alias("module")).where("module <> ''")


def by_go_package(refs: DataFrame, nodes: DataFrame, imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Go's package.Name: the exported Name in the folder that the imported path means below the module of the nearest go.mod."""
    r = _refs(refs).where((F.col("ref_language") == "go") & F.col("reference_name").rlike(r"^[^.]+\..+"))
    r = r.withColumn("package", F.regexp_extract("reference_name", r"^([^.]+)\.", 1)).withColumn("member", F.regexp_extract("reference_name", r"^[^.]+\.(.+)$", 1))
    met = r.join(imports.withColumnRenamed("file", "ref_file"), "ref_file").where("local_name = package")
    near = met.select("ref_id", "member", "source", F.posexplode(_ancestors(names.directory(F.col("ref_file")))).alias("up", "root")).join(modules, "root")
    near = near.groupBy("ref_id", "member", "source").agg(F.min_by(F.struct("root", "module"), "up").alias("m"))
    below = near.where((F.col("source") == F.col("m.module")) | F.expr("startswith(source, concat(m.module, '/'))"))
    place = below.withColumn("folder", _joined(F.col("m.root"), F.expr("substring(source, length(m.module) + 2)")))
    n = _nodes(nodes).where("language = 'go' and is_exported").withColumn("folder", names.directory(F.col("file_path")))
    return _found(_first(place.join(n, (F.col("member") == F.col("name")) & (place["folder"] == n["folder"])).drop("folder")), 0.95, "import", 4)


def by_function(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Functions used as values: the first one in the file, or the only one of the family."""
    r, n = _refs(refs).where("reference_kind = 'function_ref'"), _nodes(nodes).where(F.col("kind").isin("function", "method"))
    pairs = r.where(~F.col("reference_name").startswith("this.")).join(n, F.col("name") == F.col("reference_name"))
    pairs = pairs.where((F.col("kind") == "function") | ~F.col("ref_language").isin(*SCRIPTS)).where(names.family(F.col("language")) == names.family(F.col("ref_language")))
    pairs = pairs.where(F.col("from_node_id").isNull() | (F.col("id") != F.col("from_node_id"))).withColumn("here", F.col("file_path") == F.col("ref_file"))
    counts = pairs.groupBy("ref_id").agg(F.sum(F.col("here").cast("int")).alias("n_here"), F.count("*").alias("n_all"))
    first = _first(pairs.join(counts, "ref_id").where("(n_here > 0 and here) or (n_here = 0 and n_all = 1)"), F.col("start_line"), F.col("id"))
    return _found(first, F.when(F.col("n_here") == 1, 0.95).when(F.col("n_here") > 1, 0.9).otherwise(0.8), "function-ref", 3)


def by_qualified_name(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names with :: or dots: the only node of that qualified name, else the first whose qualified name ends with it."""
    r = _refs(refs).where(F.col("reference_name").contains("::") | F.col("reference_name").contains("."))
    n = _nodes(nodes)
    exact = r.join(n, F.col("qualified_name") == F.col("reference_name"))
    one = exact.groupBy("ref_id").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    last = F.regexp_extract("reference_name", r"[^:.]*$", 0)
    ends = r.withColumn("last", last).join(n, F.col("name") == F.col("last")).where(F.expr("endswith(qualified_name, reference_name)"))
    return _found(one, 0.95, "qualified-name", 7).unionByName(_found(_first(ends), 0.85, "qualified-name", 8))


def _methods_of(rows: DataFrame, n: DataFrame, owner: str, method: str, language: str) -> DataFrame:
    """Methods called ``method`` whose qualified name is owner::method or ends with it."""
    m = n.where("kind = 'method'")
    want = F.concat_ws("::", owner, method)
    return rows.join(m, (F.col("name") == F.col(method)) & (F.col("language") == F.col(language))).where((F.col("qualified_name") == want) | F.expr(f"endswith(qualified_name, concat('::', {owner}, '::', {method}))"))


def by_call_chain(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Go's F().M and A.f().M: what the first function returns owns the method; where that isn't known, F().M is any M."""
    n = _nodes(nodes)
    parts = _refs(refs).where("ref_language = 'go'").withColumn("inner", F.regexp_extract("reference_name", r"^(.+?)\(\)\.([A-Za-z_]\w*)$", 1)).withColumn(
        "method", F.regexp_extract("reference_name", r"^(.+?)\(\)\.([A-Za-z_]\w*)$", 2)
    ).where("method <> ''")
    parts = parts.withColumn("factory", F.regexp_extract("inner", r"[^.]*$", 0)).withColumn("owner", F.regexp_extract("inner", r"([^.]+)\.[^.]*$", 1))
    f = n.where("language = 'go' and return_type is not null and kind in ('function', 'method')").select(
        F.col("name").alias("f_name"), F.col("kind").alias("f_kind"), F.col("qualified_name").alias("f_q"), "return_type", F.struct("file_path", "start_line", "id").alias("f_ord")
    )
    made = parts.join(f, F.col("factory") == F.col("f_name")).where(
        F.when(F.col("owner") == "", F.col("f_kind") == "function").otherwise((F.col("f_q") == F.concat_ws("::", "owner", "factory")) | F.expr("endswith(f_q, concat('::', owner, '::', factory))"))
    )
    typed = made.groupBy("ref_id", "method", "ref_language").agg(F.min_by("return_type", "f_ord").alias("returned"))
    found = _found(_first(_methods_of(typed, n, "returned", "method", "ref_language")), 0.85, "instance-method", 9)
    unknown = parts.where("owner = ''").select("ref_id", "method").join(found.select("ref_id"), "ref_id", "left_anti")
    bare = by_exact_name(refs.join(unknown, "ref_id").withColumn("reference_name", F.col("method")).drop("method"), nodes)
    return found.unionByName(bare.withColumn("rule", F.lit(9)))


def by_receiver(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """receiver.method: the type of that name, the capitalised name's type, the only method of that name, or the one whose qualified name shares most words."""
    n = _nodes(nodes)
    sep = F.when(F.col("reference_name").contains("::"), F.lit("::")).otherwise(F.lit("."))
    r = _refs(refs).where(F.col("reference_name").rlike(r"(?:::|\.)[A-Za-z_]\w*$")).withColumn("sep", sep)
    r = r.withColumn("method", F.regexp_extract("reference_name", r"[^:.]*$", 0)).withColumn("receiver", F.regexp_extract("reference_name", r"([^.]*?)(?:::|\.)[^:.]*$", 1)).where("receiver <> ''")
    types = n.where(F.col("kind").isin(*TYPES)).select(F.col("name").alias("t_name"), F.col("language").alias("t_language")).distinct()
    direct = r.join(types, (F.col("receiver") == F.col("t_name")) & (F.col("ref_language") == F.col("t_language")))
    a = _found(_first(_methods_of(direct, n, "receiver", "method", "ref_language")), 0.85, "qualified-name", 10)
    capital = r.withColumn("capital", F.concat(F.upper(F.substring("receiver", 1, 1)), F.expr("substring(receiver, 2)"))).where("capital <> receiver")
    capital = capital.join(types, (F.col("capital") == F.col("t_name")) & (F.col("ref_language") == F.col("t_language")))
    b = _found(_first(_methods_of(capital, n, "capital", "method", "ref_language")), 0.80, "instance-method", 11)
    pool = r.join(n.where("kind = 'method'"), F.col("name") == F.col("method")).withColumn("same", F.col("language") == F.col("ref_language"))
    any_same = Window.partitionBy("ref_id")
    pool = pool.withColumn("n_same", F.sum(F.col("same").cast("int")).over(any_same)).where("same or n_same = 0").withColumn("n_pool", F.count("*").over(any_same))
    only = _found(pool.where("n_pool = 1 and same"), 0.70, "instance-method", 12)
    cut = lambda c: F.filter(F.split(F.lower(F.regexp_replace(names.camel_space(F.col(c)), r"[\s._:/\\]+", " ")), " "), lambda x: F.length(x) > 1)
    shared = F.size(F.filter(cut("receiver"), lambda w: F.array_contains(cut("qualified_name"), w)))
    several = pool.where("n_pool > 1").withColumn("overlap", shared + F.col("same").cast("int"))
    best = _found(_first(several.where("overlap >= 2"), F.desc("overlap")), 0.65, "instance-method", 13)
    return reduce(DataFrame.unionByName, (a, b, only, best))


def by_exact_name(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The node of that name; of several the one that scores best by file, folder, language, kind, export, line and not being a test."""
    r, n = _refs(refs), _nodes(nodes)
    pairs = r.join(n, F.col("name") == F.col("reference_name"))
    pairs = pairs.where((F.col("reference_kind") != "references") | (names.family(F.col("language")) == names.family(F.col("ref_language"))))
    near = names.proximity(F.col("ref_file"), F.col("file_path"))
    fits = ((F.col("reference_kind") == "calls") & F.col("kind").isin("function", "method")) | ((F.col("reference_kind") == "instantiates") & F.col("kind").isin(*TYPES))
    score = (
        F.when(F.col("file_path") == F.col("ref_file"), 100).otherwise(0)
        + near
        + F.when(F.col("language") == F.col("ref_language"), 50).otherwise(-80)
        + F.when(fits, 25).otherwise(0)
        + F.when(F.col("is_exported"), 10).otherwise(0)
        + F.greatest(F.lit(0), 20 - F.floor(F.abs(F.coalesce("start_line", F.lit(0)) - F.coalesce("ref_line", F.lit(0))) / 10))
        - F.when(names.is_test(F.col("file_path")) & ~names.is_test(F.col("ref_file")), 60).otherwise(0)
    )
    counts = pairs.groupBy("ref_id").agg(F.count("*").alias("n"))
    best = _first(pairs.withColumn("near", near).withColumn("score", score).join(counts, "ref_id"), F.desc("score"))
    confidence = (
        F.when(F.col("n") == 1, F.when(F.col("language") == F.col("ref_language"), 0.90).otherwise(0.40))
        .when(F.col("near") < 30, 0.30)
        .when(F.col("n") > 8, 0.55)
        .otherwise(0.75)
    )
    return _found(best, confidence, "exact-match", 14)


def is_external() -> Column:
    """Go's standard library and built-ins."""
    return (F.col("language") == "go") & (F.col("reference_name").isin(*GO_BUILTINS) | F.col("reference_name").contains(".") & F.regexp_extract("reference_name", r"^([^.]*)\.", 1).isin(*GO_PACKAGES))


def possible(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References of which some part is the name of a node; no rule resolves the others. Saves the later joins their rows."""
    name = F.col("reference_name")
    head, last = F.regexp_extract(name, r"^([^.]*)", 1), F.regexp_extract(name, r"[^.]*$", 0)
    parts = F.array(name, head, F.concat(F.upper(F.substring(head, 1, 1)), F.expr("substring(regexp_extract(reference_name, '^([^.]*)', 1), 2)")), last, F.regexp_extract(name, r"^(.*?)::", 1), F.regexp_extract(name, r"[^:]*$", 0), F.regexp_extract(name, r"[^/]*$", 0), F.regexp_extract(name, r"[^:.]*$", 0))
    known = nodes.where("name is not null").select(F.col("name").alias("part")).distinct()
    met = refs.select("ref_id", F.explode(F.array_distinct(parts)).alias("part")).where("part <> ''").join(known, "part", "left_semi").select("ref_id").distinct()
    return refs.join(met, "ref_id", "left_semi")


def resolve(refs: DataFrame, nodes: DataFrame, files: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """ref_id, target_id, confidence, resolved_by of every reference that some rule resolves; the first rule in order wins.

    Imports with a module, Rust's use paths and functions used as values have one rule each.  With the texts, Go's
    packages are followed through imports and go.mod.  Null names resolve to nothing.
    """
    imports = F.coalesce(F.col("reference_kind") == "imports", F.lit(False))
    modular = imports & F.col("candidates").isNotNull()
    rust = imports & F.col("candidates").isNull() & F.coalesce((F.col("language") == "rust") & F.col("reference_name").contains("::"), F.lit(False))
    value = F.coalesce(F.col("reference_kind") == "function_ref", F.lit(False))
    nodes = cut_lineage(_nodes(nodes))
    rest = cut_lineage(possible(refs.where(~modular & ~rust & ~value & ~F.coalesce(is_external(), F.lit(False))), nodes))
    found = [by_import(refs.where(modular), nodes, files), by_rust_path(refs.where(rust), nodes, files), by_function(refs, nodes), *(rule(rest, nodes) for rule in (by_qualified_name, by_call_chain, by_receiver, by_exact_name))]
    if contents is not None:
        found.append(by_go_package(rest, nodes, go_imports(contents), go_modules(contents)))
    every = reduce(DataFrame.unionByName, found)
    best = every.groupBy("ref_id").agg(F.min_by(F.struct("target_id", "confidence", "resolved_by"), F.struct("rule", "target_id")).alias("b"))
    return best.select("ref_id", "b.target_id", "b.confidence", "b.resolved_by")


def resolved_edges(refs: DataFrame, nodes: DataFrame, files: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """Edges of the resolved references; extending an interface is implementing, calling a class is instantiating."""
    kinds = nodes.select("id", "kind")
    r = resolve(refs, nodes, files, contents).join(refs, "ref_id")
    r = r.join(kinds.select(F.col("id").alias("target_id"), F.col("kind").alias("t_kind")), "target_id").join(kinds.select(F.col("id").alias("from_node_id"), F.col("kind").alias("s_kind")), "from_node_id", "left")
    kind = (
        F.when(F.col("reference_kind") == "function_ref", "references")
        .when((F.col("reference_kind") == "extends") & F.col("t_kind").isin("interface", "protocol") & ~F.coalesce(F.col("s_kind").isin("interface", "protocol"), F.lit(True)), "implements")
        .when((F.col("reference_kind") == "calls") & F.col("t_kind").isin("class", "struct"), "instantiates")
        .otherwise(F.col("reference_kind"))
    )
    return r.select(F.col("from_node_id").alias("source"), F.col("target_id").alias("target"), kind.alias("kind"), "confidence", "resolved_by", "line", "col", F.lit("tree-sitter").alias("provenance"))
