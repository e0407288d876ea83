"""Import edges between files.

Matching each import against each path is a theta join.  Here both sides write out the
keys they could meet under, and the match is an equi-join on those keys.

A module that very many files import is one hot key, as is a name that very many files
have.  So the distinct keys meet the paths first, which also drops the many imports from
outside, and only then the importing files join what was matched; both joins are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.lookup import parent
from reviewloom.functions.text import imports_of_pr_file, imports_of_repo_file
from reviewloom.operators.joins import salted_join
from reviewloom.operators.selection import is_repo_file
from reviewloom.session import reuse

# What may follow an import in the path it names.
PR_TAILS = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"]
RELATIVE_TAILS = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js"]
ALIAS_TAILS = ["", ".ts", ".tsx", ".js", "/index.ts", "/index.js"]
EDGE_WEIGHT = 2

COUPLED, STRONGLY_COUPLED = 3, 5


def exploded_imports(contents: DataFrame, imports: Column) -> DataFrame:
    """One row per import of each file: (analysis_id, source, source_ord, imp_ord, imp)."""
    return contents.select(
        "analysis_id",
        F.col("path").alias("source"),
        F.col("file_ord").alias("source_ord"),
        F.posexplode(imports).alias("imp_ord", "imp"),
    )


def imports_pr(contents: DataFrame) -> DataFrame:
    return exploded_imports(contents, imports_of_pr_file(F.col("content")))


def imports_repo(contents: DataFrame) -> DataFrame:
    return exploded_imports(contents, imports_of_repo_file(F.col("content")))


def _ending_keys(path: Column, lengths: Column) -> Column:
    """Hashes of the endings of the path, and of the path without each tail it has.

    Only endings that are as long as some import are of use; ``lengths`` are theirs.
    """
    stems = F.filter(
        F.array(
            *[
                F.when(path.endswith(t), F.substring(path, F.lit(1), F.length(path) - len(t)))
                for t in PR_TAILS
            ]
        ),
        lambda s: s.isNotNull() & (s != ""),
    )
    endings = F.transform(
        stems,
        lambda s: F.transform(
            F.filter(lengths, lambda n: (n > 0) & (n <= F.length(s))), lambda n: F.xxhash64(F.right(s, n))
        ),
    )
    return F.array_distinct(F.flatten(endings))


def _resolved(source: Column, imp: Column) -> Column:
    """The path that a relative import of ``source`` names, without ``.`` and ``..``."""
    return _collapse_dots(F.concat_ws("/", parent(source), imp))


def _relative_edges_pr(sources: DataFrame, pr_files: DataFrame) -> DataFrame:
    """Relative imports meet the files they name by whole paths; a file that very many import is spread over tasks."""
    named = _resolved(F.col("source"), F.col("imp"))
    wanted = sources.withColumn("named", named).withColumn(
        "target", F.explode(F.array(*[F.concat("named", F.lit(t)) for t in PR_TAILS]))
    )
    targets = pr_files.select("analysis_id", F.col("path").alias("target"), F.col("file_ord").alias("target_ord"))
    return salted_join(targets, wanted.drop("named"), ["analysis_id", "target"], spread_by="source")


def edges_pr(imports: DataFrame, pr_files: DataFrame, resolve_dots: bool = False) -> DataFrame:
    """Edges from imports (see ``imports_pr``) to changed files whose path ends with them.

    With ``resolve_dots``, relative imports lead to the files they name from the importing file's folder; by default
    their dots are kept as written, so they lead nowhere.

    An import that fits a target gives one edge, and two imports that fit it give two.
    A one-letter import, as the pattern for Python gives, fits every path with that ending: that many edges
    are meant, and both joins are salted for them.
    """
    # Both joins read the imports; the texts they come from are read once.
    every = reuse(imports.withColumn("key", F.xxhash64("imp")))
    relative = F.col("imp").startswith(".")
    sources = every.filter(~relative) if resolve_dots else every
    wanted = sources.select("analysis_id", "imp", "key").distinct()
    # Of each analysis, the lengths of its imports: a few numbers.
    lengths = wanted.groupBy("analysis_id").agg(F.collect_set(F.length("imp")).alias("lengths"))
    targets = pr_files.join(lengths, "analysis_id").select(
        "analysis_id",
        F.col("path").alias("target"),
        F.col("file_ord").alias("target_ord"),
        F.explode(_ending_keys(F.col("path"), F.col("lengths"))).alias("key"),
    )
    # Keys are hashes to keep the shuffled rows short; the texts decide.
    fits = F.lit(False)
    for tail in PR_TAILS:
        fits = fits | F.col("target").endswith(F.concat("imp", F.lit(tail)))
    matched = (
        salted_join(wanted, targets, ["analysis_id", "key"], spread_by="target")
        .filter(fits)
        .drop("key")
    )
    edges = salted_join(matched, sources.drop("key"), ["analysis_id", "imp"], spread_by="source")
    if resolve_dots:
        edges = edges.unionByName(_relative_edges_pr(every.filter(relative).drop("key"), pr_files))
    return edges.filter(F.col("source") != F.col("target")).select(
        "analysis_id",
        "source",
        "target",
        F.when(F.col("imp").startswith("."), "import").otherwise("require").alias("type"),
        F.lit(EDGE_WEIGHT).alias("weight"),
        "source_ord",
        "imp_ord",
        "target_ord",
    )


def _collapse_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` in a path and drop empty steps; a path that leaves the root keeps its ``..``."""
    walked = F.aggregate(
        F.split(path, "/", -1),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg.isin(".", ""), acc)
        .when((seg == "..") & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(seg))),
    )
    return F.array_join(walked, "/")


def _import_keys(source: Column, imp: Column, resolve_dots: bool) -> Column:
    def with_tails(kind: str, head: Column, tails: list[str]) -> Column:
        return F.array(*[F.concat(F.lit(kind), head, F.lit(t)) for t in tails])

    folder = parent(source)
    resolved = F.regexp_replace(
        F.concat(F.when(folder != "", F.concat(folder, F.lit("/"))).otherwise(""), imp), "/+", "/"
    )
    if resolve_dots:
        resolved = _collapse_dots(resolved)
    alias = F.when(imp.startswith("@/"), F.substring(imp, 3, 1 << 30)).otherwise(
        F.substring(imp, 2, 1 << 30)
    )
    return (
        F.when(imp.startswith("."), with_tails("path:", resolved, RELATIVE_TAILS))
        .when(
            imp.startswith("@/") | imp.startswith("/"),
            with_tails("ends:/", alias, ALIAS_TAILS),
        )
        .otherwise(F.array(F.concat(F.lit("name:"), F.substring_index(imp, "/", -1))))
    )


def _target_keys(path: Column) -> Column:
    parts = F.split(path, "/", -1)
    n = F.size(parts)
    # Positions of all segments but the first.
    rest = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    ends = F.transform(
        rest, lambda i: F.concat(F.lit("ends:/"), F.array_join(F.slice(parts, i, n), "/"))
    )

    def names(i: Column) -> Column:
        pieces = F.split(F.element_at(parts, i), r"\.", -1)
        upto = F.size(pieces) - 1
        counts = F.when(upto > 0, F.sequence(F.lit(1), upto)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            counts, lambda k: F.concat(F.lit("name:"), F.array_join(F.slice(pieces, 1, k), "."))
        )

    index_of = F.when(
        F.element_at(parts, -1).isin("index.ts", "index.js") & (n > 2),
        F.array(F.concat(F.lit("name:"), F.try_element_at(parts, n - 1))),
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(
        F.concat(
            F.array(F.concat(F.lit("path:"), path)), ends, F.flatten(F.transform(rest, names)), index_of
        )
    )


def edges_repo(imports: DataFrame, files: DataFrame, resolve_dots: bool = False) -> DataFrame:
    """Edges from imports (see ``imports_repo``) to files of the repository, one per pair.

    Dots in relative imports are kept as written unless ``resolve_dots`` is set, so by
    default they lead nowhere.  The first import that fits a pair gives its type.
    """
    imp = F.col("imp")
    # Both joins read the imports; the texts they come from are read once.
    sources = reuse(imports.filter(is_repo_file(F.col("source")))).withColumn(
        "key", F.explode(_import_keys(F.col("source"), imp, resolve_dots))
    )
    wanted = sources.select("analysis_id", "key").distinct()
    targets = files.select(
        "analysis_id",
        F.col("path").alias("target"),
        F.explode(_target_keys(F.col("path"))).alias("key"),
    )
    edge_type = (
        F.when(imp.startswith("."), "import").when(imp.startswith("@"), "require").otherwise("import")
    )
    matched = salted_join(wanted, targets, ["analysis_id", "key"], spread_by="target")
    met = salted_join(matched, sources, ["analysis_id", "key"], spread_by="source")
    return (
        met.filter(F.col("source") != F.col("target"))
        .withColumn("type", edge_type)
        .groupBy("analysis_id", "source", "target")
        .agg(F.min_by("type", "imp_ord").alias("type"))
        .withColumn("weight", F.lit(EDGE_WEIGHT))
    )


def coupling(edges: DataFrame) -> DataFrame:
    """Files with at least three edges going out."""
    return (
        edges.groupBy("analysis_id", "source")
        .agg(F.count(F.lit(1)).alias("n_edges"), F.min("source_ord").alias("source_ord"))
        .filter(F.col("n_edges") >= COUPLED)
        .withColumn("severity", F.when(F.col("n_edges") >= STRONGLY_COUPLED, "high").otherwise("medium"))
    )


def graph_nodes(edges: DataFrame, metrics: DataFrame) -> DataFrame:
    """Each file an edge touches, with its measures; nulls where it was not measured."""
    nodes = (
        edges.select("analysis_id", F.explode(F.array("source", "target")).alias("path")).distinct()
    )
    measured = metrics.select("analysis_id", "path", "additions", "deletions", "risk", "complexity")
    return nodes.join(measured, ["analysis_id", "path"], "left")


def graph_sizes(edges: DataFrame) -> DataFrame:
    """Edges and distinct files per analysis; counted per file first, so no group is collected."""
    ends = edges.select(
        "analysis_id",
        F.explode(
            F.array(
                F.struct(F.col("source").alias("path"), F.lit(1).alias("edges")),
                F.struct(F.col("target").alias("path"), F.lit(0).alias("edges")),
            )
        ).alias("end"),
    )
    per_file = ends.groupBy("analysis_id", "end.path").agg(F.sum("end.edges").alias("edges"))
    return per_file.groupBy("analysis_id").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.sum("edges").alias("n_edges")
    )
