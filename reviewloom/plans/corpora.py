"""Tables of submissions, files, diffs and pull requests derived from the given tables.

The given tables hold prose; each row is seeded with a snippet from the bank, chosen by
its key, so that the rules have something to find.  Everything is a projection of the
given rows but the repository header and language sizes, which are small aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom.functions.binding import literals
from reviewloom.functions.lookup import SOURCE_EXTENSIONS, extension, language
from reviewloom.plans.bank import SNIPPETS

_EXTS = [ext for ext, _ in SNIPPETS]
_BODIES = [body for _, body in SNIPPETS]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1000) -> DataFrame:
    """The files of a table as a stream; the file limit bounds each micro-batch.

    The path is a pattern, which a table of one file may be given by too.
    """
    files = spark.readStream.schema(table(spark, sf_dir, name).schema)
    return files.option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/{name}.parque[t]")


def texts(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """A table whose texts are to be scanned, with work for every core.

    Scanning is bound by the processor.  A table with fewer splits than there are cores is
    small, and its rows are spread by key first; a large one is read as it lies.
    """
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, *keys)
    return df


def _pick(values: list[str], key: Column) -> Column:
    return F.get(F.expr(f"array({literals(values)})"), (key % len(values)).cast("int"))


def _doc_path(ext: Column) -> Column:
    doc = F.col("doc_id")
    return F.concat(
        F.lit("src/"), F.col("lang"), F.lit("/m"), (doc % 13).cast("string"), F.lit("/f"),
        doc.cast("string"), F.lit("."), ext,
    )


def code_files(
    spark: SparkSession, sf_dir: str, chosen: Column | None = None, *extra: Column
) -> DataFrame:
    """Source files: (analysis_id, file_ord, path, size, content); a repository per source."""
    doc = F.col("doc_id")
    body = F.replace(_pick(_BODIES, doc), F.lit("@NEAR@"), (doc + 20).cast("string"))
    body = F.replace(body, F.lit("@FOLD@"), ((doc + 20) % 13).cast("string"))
    newline = F.lit("\n")
    docs = texts(spark, sf_dir, "documents", "doc_id")
    return (docs if chosen is None else docs.filter(chosen)).select(
        F.col("source").alias("analysis_id"),
        doc.alias("file_ord"),
        *extra,
        _doc_path(_pick(_EXTS, doc)).alias("path"),
        F.col("n_chars").alias("size"),
        F.when(doc % 2 == 0, F.concat(body, newline, "text"))
        .otherwise(F.concat("text", newline, body))
        .alias("content"),
    )


def code_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source file pasted as a submission of its own; every third has a file name."""
    doc = F.col("file_ord")
    return code_files(spark, sf_dir).select(
        F.concat(F.lit("doc-"), doc.cast("string")).alias("analysis_id"),
        F.col("content").alias("code"),
        F.when(doc % 3 == 0, F.col("path")).when(doc % 3 == 1, F.lit("")).alias("filename"),
    )


def _tree_path() -> Column:
    doc = F.col("doc_id")
    return _doc_path(
        F.when(doc % 23 == 0, "png").when(doc % 29 == 0, "lock").otherwise(_pick(_EXTS, doc))
    )


def _tree_type() -> Column:
    return F.when(F.col("doc_id") % 17 == 0, "tree").otherwise("blob")


def _tree_size() -> Column:
    return F.when(F.col("doc_id") % 19 != 0, F.col("n_chars"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository trees: mostly the source files, with some folders and assets."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("analysis_id"),
        F.col("doc_id").alias("file_ord"),
        _tree_path().alias("path"),
        _tree_type().alias("type"),
        _tree_size().alias("size"),
    )


def repo_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of every source file of each repository; ``smaller`` puts them in scan order.

    Largest first, then in order of the tree.
    """
    return code_files(
        spark, sf_dir,
        (_tree_type() == "blob") & extension(_tree_path()).isin(SOURCE_EXTENSIONS),
        (-F.coalesce(_tree_size(), F.lit(0))).cast("bigint").alias("smaller"),
    )


def repo_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.col("source").alias("analysis_id")).agg(
        F.min_by("text", "doc_id").alias("head"),
        F.count(F.lit(1)).alias("n"),
        F.min("doc_id").alias("first"),
    ).select(
        "analysis_id",
        F.col("analysis_id").alias("name"),
        F.concat(F.lit("org/"), "analysis_id").alias("full_name"),
        F.when(F.col("first") % 3 != 0, F.col("head")).alias("description"),
        (F.col("n") * F.col("first")).alias("stargazers_count"),
    )


def repo_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        tree(spark, sf_dir)
        .groupBy("analysis_id", language(F.col("path")).alias("language"))
        .agg(
            F.min("file_ord").alias("lang_ord"),
            F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        )
    )


def _turn_key() -> Column:
    return F.col("conv_id") + F.col("turn")


def _turn_path() -> Column:
    return F.concat(F.lit("src/c"), F.col("turn").cast("string"), F.lit("."), _pick(_EXTS, _turn_key()))


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff per conversation turn, with a file block per line of its text."""
    newline = F.lit("\n")

    def prefixed(prefix: str, text: Column) -> Column:
        return F.concat(
            F.lit(prefix), F.replace(text, newline, F.lit("\n" + prefix)), newline
        )

    def block(line: Column, i: Column) -> Column:
        key = _turn_key() + i
        path = F.concat(
            F.lit("src/c"), F.col("turn").cast("string"), F.lit("/p"), i.cast("string"),
            F.lit("."), _pick(_EXTS, key),
        )
        body = _pick(_BODIES, key)
        removed = F.when(key % 5 != 0, prefixed("-", line)).otherwise("")
        added = F.when(key % 7 != 0, prefixed("+", body)).otherwise(prefixed("-", body))
        return F.concat(
            F.lit("diff --git a/"), path, F.lit(" b/"), path, newline,
            F.lit("--- a/"), path, newline, F.lit("+++ b/"), path, newline,
            F.lit("@@ -1,2 +1,3 @@ ctx\n"), removed, added,
            F.lit("@@ -9 +12,4 @@\n"), prefixed(" ", line),
        )

    blocks = F.transform(F.split("text", "\n", -1), block)
    return texts(spark, sf_dir, "conversations", "conv_id", "turn").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-t"), F.col("turn").cast("string"))
        .alias("analysis_id"),
        F.array_join(blocks, "").alias("diff"),
    )


def pr_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed files of pull requests: one request per conversation, one file per turn."""
    newline = F.lit("\n")
    body = _pick(_BODIES, _turn_key())
    patch = F.concat(
        F.lit("@@ -1,2 +1,3 @@ ctx\n-"), F.replace(body, newline, F.lit("\n-")), F.lit("\n+"),
        F.replace("text", newline, F.lit("\n+")), newline,
    )
    additions = F.floor(F.length("text") / 4).cast("int")
    deletions = (F.col("turn") * 3).cast("int")
    return texts(spark, sf_dir, "conversations", "conv_id", "turn").select(
        F.concat(F.lit("pr-"), F.col("conv_id").cast("string")).alias("analysis_id"),
        F.col("turn").cast("int").alias("file_ord"),
        _turn_path().alias("path"),
        F.lit("modified").alias("status"),
        additions.alias("additions"),
        deletions.alias("deletions"),
        (additions + deletions).alias("changes"),
        F.when(_turn_key() % 11 != 0, patch).alias("patch"),
    )


def pr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the file lists of large requests, which have the files of fifty conversations each."""
    conv = F.substring("analysis_id", 4, 20).cast("bigint")
    group = F.concat(F.lit("big-"), F.floor(conv / 50).cast("string"))
    # A request has a few hundred files, so its numbers fit a plain window, and a page a list.
    order = Window.partitionBy("group").orderBy("conv", "file_ord")
    files = pr_files(spark, sf_dir).withColumns({"group": group, "conv": conv})
    item = F.struct(F.col("path").alias("filename"), "status", "additions", "deletions", "changes", "patch")
    placed = files.select("group", (F.row_number().over(order) - 1).alias("pos"), item.alias("item"))
    items = F.sort_array(F.collect_list(F.struct("pos", "item")))
    return placed.groupBy(
        F.col("group").alias("analysis_id"), (F.floor(F.col("pos") / 100) + 1).cast("int").alias("page")
    ).agg(F.to_json(F.transform(items, lambda x: x["item"])).alias("body"))


def damaged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages as they may land: cut off, replaced by a message, left out, empty, or twice."""
    damage = (F.substring("analysis_id", 5, 20).cast("bigint") * 7 + F.col("page")) % 6
    none = F.lit(None).cast("string")
    body = (
        F.when(damage == 0, F.left("body", F.floor(F.length("body") / 2).cast("int")))
        .when(damage == 1, '{"message":"Not Found"}')
        .when(damage == 3, none)
        .otherwise(F.col("body"))
    )
    copies = F.array_repeat(body, F.when(damage == 2, 0).when(damage == 4, 2).otherwise(1))
    return pr_pages(spark, sf_dir).select("analysis_id", "page", F.explode(copies).alias("body"))


def tree_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees as JSON bodies; a repository of many files has several, each a tree of its own."""
    item = F.struct("path", F.lit("100644").alias("mode"), "type", "size", F.sha1(F.col("path").cast("binary")).alias("sha"))
    items = F.sort_array(F.collect_list(F.struct("file_ord", item.alias("item"))))
    part = F.concat("analysis_id", F.lit("-"), F.floor(F.col("file_ord") / 1000).cast("string"))
    return tree(spark, sf_dir).groupBy(part.alias("analysis_id")).agg(
        F.to_json(F.struct(F.transform(items, lambda x: x["item"]).alias("tree"))).alias("body")
    )


def write_checkout(spark: SparkSession, sf_dir: str, folder: str, documents: int = 25) -> None:
    """Documents as files below ``folder``, some to a file, in the encodings that checkouts come in, every fifth binary."""
    number = F.floor(F.col("doc_id") / documents)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"])
    files = table(spark, sf_dir, "documents").groupBy(number.alias("n")).agg(F.array_join(lines, "\n").alias("text"))
    kind, text = F.col("n") % 5, F.col("text")
    narrow = F.regexp_replace("text", r"[^\x{00}-\x{FF}]", "?")
    # The writer ends each file with the byte 0A, which is the second one of a line end in UTF-16BE.
    wide = F.concat(F.lit(b"\xfe\xff"), F.encode("text", "UTF-16BE"), F.lit(b"\0"))
    raw = (
        F.when(kind == 1, F.concat(F.lit(b"\xef\xbb\xbf"), F.encode("text", "UTF-8")))
        .when(kind == 2, wide)
        .when(kind == 3, F.encode(narrow, "ISO-8859-1"))
        .when(kind == 4, F.concat(F.lit(b"\0"), F.encode("text", "UTF-8")))
        .otherwise(F.encode(text, "UTF-8"))
    )
    named = files.select(F.concat(F.lit("f-"), F.col("n").cast("string")).alias("file"), raw.cast("string").alias("value"))
    named.write.partitionBy("file").text(folder)


def language_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language sizes as JSON bodies, an object for each repository."""
    entries = F.collect_list(F.struct("language", "bytes"))
    return repo_languages(spark, sf_dir).groupBy("analysis_id").agg(F.to_json(F.map_from_entries(entries)).alias("body"))


def pr_header_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.struct("title", F.struct(F.col("author").alias("login")).alias("user"), F.lit("open").alias("state"))
    return pr_headers(spark, sf_dir).select("analysis_id", F.to_json(header).alias("body"))


def pr_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of the files with a patch of each pull request, which import one another."""
    turn = F.col("turn")

    def named(step: int, before: str, after: str) -> list[Column]:
        return [F.lit(before), ((turn + step) % 8).cast("string"), F.lit(after)]

    content = F.concat(
        *named(1, "import x from 'c", "';\n"),
        *named(2, "import { a } from './c", "';\n"),
        *named(3, "from src/c", ".py import z\n"),
        *named(4, "const q = require('src/c", "');\n"),
        *named(5, "const p = await import('src/c", ".js');\n"),
        *named(6, "import * as s from 'c", ".ts';\n"),
        "text",
    )
    rows = texts(spark, sf_dir, "conversations", "conv_id", "turn")
    return rows.filter(_turn_key() % 11 != 0).select(
        F.concat(F.lit("pr-"), F.col("conv_id").cast("string")).alias("analysis_id"),
        turn.cast("int").alias("file_ord"),
        _turn_path().alias("path"),
        content.alias("content"),
    )


def pr_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and author of each pull request: the text and role of its first turn."""
    first = F.min_by(F.struct(F.col("text").alias("title"), "role"), "turn")
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(first.alias("first"))
    conv = F.col("conv_id").cast("string")
    return grouped.select(
        F.concat(F.lit("pr-"), conv).alias("analysis_id"),
        F.col("first.title").alias("title"),
        F.col("first.role").alias("author"),
        F.concat(F.lit("org/repo"), conv).alias("repo_name"),
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "pages"))


def page_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same submissions from the table's own files, as a stream of them."""
    return mixed(table_stream(spark, sf_dir, "pages", files_per_trigger))


def mixed(pages: DataFrame) -> DataFrame:
    """Mixed submissions of pages: addresses, diffs, code and rejects.

    A page whose text is in neither a diff nor code is pasted as it is too, so that all are read.
    """
    page = F.col("page_id")
    kind, number = page % 8, page.cast("string")
    host = "https://github.com/org"
    url = (
        F.when(kind == 0, F.col("url"))
        .when(kind == 1, F.concat(F.lit(host), number, F.lit("/lib.git/pull/"), (page % 3).cast("string"), F.lit("/files")))
        .when(kind == 2, F.concat(F.lit(host), number, F.lit("/app/tree/main")))
        .when(kind == 3, F.concat(F.lit(host), number, F.lit("/app?tab=x#y")))
        .when(kind == 4, F.lit(""))
        .when(kind == 5, F.concat(F.lit(host), number))
    )
    is_diff = (kind == 4) | (kind == 6)
    diff = F.when(
        is_diff,
        F.concat(
            F.when(page % 3 == 0, F.lit("note\n")).otherwise(""),
            F.lit("diff --git a/p"), number, F.lit(".html b/p"), number, F.lit(".html\n"),
            F.when(page % 5 == 0, F.lit(" @@ x\n")).otherwise("@@ -1 +1,2 @@\n"),
            F.lit("+"), F.col("html"), F.lit("\n"),
        ),
    )
    code = F.when(kind == 7, F.concat(_pick(_BODIES, page), F.lit("\n"), F.col("html"))).when(
        kind == 6, F.lit(" \n\t ")
    )
    none = F.lit(None).cast("string")
    first = F.struct(
        F.concat(F.lit("s"), number).alias("analysis_id"), url.alias("url"), diff.alias("diff"), code.alias("code")
    )
    pasted = F.struct(
        F.concat(F.lit("s"), number, F.lit("x")).alias("analysis_id"), none.alias("url"), none.alias("diff"),
        F.col("html").alias("code"),
    )
    rows = F.when(is_diff | (kind == 7), F.array(first)).otherwise(F.array(first, pasted))
    return pages.select(F.inline(rows)).select(
        "analysis_id", "url", "diff", "code",
        none.alias("filename"),
        F.lit(None).cast("timestamp").alias("received_at"),
    )


def saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved results: each event saves the result of its user."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("analysis_id"),
        F.col("ts").alias("saved_at"),
        "event_id",
        "value",
    )
