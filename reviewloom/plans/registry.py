"""The registered queries: each operator applied to the corpora."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions import rules
from reviewloom.functions import text as measures
from reviewloom.functions.lookup import basename, extension, language, parent
from reviewloom.operators import (
    diffs,
    graph,
    listing,
    metrics,
    narrative,
    reviews,
    rollups,
    routing,
    scan,
    scores,
    selection,
)
from reviewloom.plans import analyses, corpora
from reviewloom.session import reuse, scratch
from reviewloom.sources import landed, store, upserts

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _long(df: DataFrame, *names: str) -> DataFrame:
    """Cast counts to one integer type so that engines agree on it."""
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


# Sources -------------------------------------------------------------------------------


@query
def tree_blobs(spark, sf):
    return selection.tree_blobs(corpora.tree(spark, sf))


@query
def repo_tree_json(spark, sf):
    """Trees read back from JSON bodies of the host's shape, a thousand items to a body."""
    return landed.tree(corpora.tree_bodies(spark, sf))


@query
def repo_languages_json(spark, sf):
    found = landed.repo_languages(corpora.language_bodies(spark, sf))
    return found.select("analysis_id", "language", "bytes")


@query
def pr_headers_json(spark, sf):
    found = landed.pr_headers(corpora.pr_header_bodies(spark, sf))
    return found.select("analysis_id", "title", F.col("user.login").alias("author"))


@query
def pr_file_pages(spark, sf):
    """Files of large pull requests from JSON pages of a hundred, which come in any order."""
    pages = corpora.pr_pages(spark, sf).repartition("body")
    return landed.pr_files(pages).select(
        "analysis_id", F.col("file_ord").cast("bigint"), "path", "status", "additions",
        "deletions", "changes", "patch",
    )


@query
def landed_submissions(spark, sf):
    """Submissions landed as JSON and read back."""
    folder = scratch(spark)
    corpora.submissions(spark, sf).write.json(folder)
    return landed.submissions(spark, folder, "json").select("analysis_id", "url", "diff", "code", "filename")


@query
def repo_info_json(spark, sf):
    info = corpora.repo_info(spark, sf)
    bodies = info.select("analysis_id", F.to_json(F.struct(*info.columns[1:])).alias("body"))
    found = landed.repo_info(landed.sound(bodies, "repo_info"))
    return found.select("analysis_id", "name", "full_name", "description", "stargazers_count")


@query
def pr_page_faults(spark, sf):
    """What is wrong with the file lists of large pull requests whose pages were damaged on the way."""
    return _long(landed.page_faults(corpora.damaged_pages(spark, sf)), "page")


@query
def pr_pages_sound(spark, sf):
    """The files of their good pages, of a page landed twice once, and the pages set aside as a row each."""
    pages = corpora.damaged_pages(spark, sf)
    good = landed.pr_files(landed.sound(pages, "pr_files").dropDuplicates(["analysis_id", "page"]))
    aside = landed.rejects(pages, "pr_files")
    return good.select("analysis_id", F.col("file_ord").cast("bigint").alias("ord"), "path", F.lit(None).cast("string").alias("fault")).unionByName(
        aside.select("analysis_id", F.col("page").cast("bigint").alias("ord"), F.lit(None).cast("string").alias("path"), "fault")
    )


@query
def decode_contents(spark, sf):
    docs = corpora.texts(spark, sf, "documents", "doc_id")
    coded = F.base64(F.encode("text", "UTF-8"))
    lines = F.regexp_replace(coded, "(.{60})", "$1\n")
    raw = docs.select(
        F.col("source").alias("analysis_id"),
        F.col("doc_id").alias("file_ord"),
        F.when(F.col("doc_id") % 7 == 0, coded)
        .when(F.col("doc_id") % 7 == 1, F.col("text"))
        .otherwise(lines)
        .alias("content"),
        F.when(F.col("doc_id") % 7 == 1, "none").otherwise("base64").alias("encoding"),
    )
    return landed.file_contents(raw)


@query
def checkout_files(spark, sf):
    """Documents written as files of several encodings, read back by their bytes."""
    folder = scratch(spark)
    corpora.write_checkout(spark, sf, folder)
    name = F.regexp_extract("path", "^file=([^/]*)/", 1)
    return landed.checkout_files(spark, folder).select(name.alias("file"), "size", "kind", "encoding", "content")


@query
def retain_latest(spark, sf):
    kept = store.retain_latest(corpora.saves(spark, sf), ["saved_at", "event_id"])
    return kept.select(
        "analysis_id",
        F.col("first_save.event_id").alias("first_event"),
        F.col("last_save.event_id").alias("last_event"),
        "value",
    )


@query
def result_lookup(spark, sf):
    results = store.latest(corpora.saves(spark, sf), ["saved_at", "event_id"]).select(
        "analysis_id", "value"
    )
    wanted = corpora.table(spark, sf, "conversations").select(
        F.concat(F.lit("u"), F.col("conv_id").cast("string")).alias("analysis_id")
    )
    return store.lookup(wanted, results)


def _store_of_saves(spark, sf):
    """All saves in three batches, the second of which is replayed and then merged into the buckets."""
    folder = scratch(spark)
    saves = corpora.saves(spark, sf)
    for batch_id in (0, 1, 1, 2):
        batch = saves.filter(F.pmod("event_id", F.lit(3)) == batch_id)
        if not upserts.upsert(batch, folder, ["saved_at", "event_id"], batch_id):
            upserts.compact(spark, folder)
    return folder


@query
def store_upsert(spark, sf):
    """The last result of each id, by batch and then by time, out of snapshots and deltas."""
    return upserts.read(spark, _store_of_saves(spark, sf)).select("analysis_id", "event_id", "value")


@query
def store_get(spark, sf):
    """The same for the ids of all conversations, from the files that can have them."""
    wanted = corpora.table(spark, sf, "conversations").select(
        F.concat(F.lit("u"), F.col("conv_id").cast("string")).alias("analysis_id")
    )
    return upserts.get(wanted, _store_of_saves(spark, sf)).select("analysis_id", "value", "found")


# Routing, selection and projections ------------------------------------------------------


@query
def route_submissions(spark, sf):
    return routing.route(corpora.submissions(spark, sf)).select(
        "analysis_id", "kind", "reject_reason"
    )


@query
def parse_urls(spark, sf):
    return routing.parse_urls(corpora.submissions(spark, sf).select("analysis_id", "url"))


@query
def detect_diffs(spark, sf):
    return corpora.submissions(spark, sf).select(
        "analysis_id", F.coalesce(measures.looks_like_diff(F.col("diff")), F.lit(False)).alias("is_diff")
    )


@query
def repo_files(spark, sf):
    return selection.repo_files(corpora.tree(spark, sf))


@query
def scan_candidates(spark, sf):
    return _long(selection.scan_candidates(corpora.tree(spark, sf)), "scan_ord")


@query
def pr_candidates(spark, sf):
    return _long(selection.pr_candidates(corpora.pr_files(spark, sf)), "file_ord", "scan_ord", "changes")


@query
def line_stats(spark, sf):
    text = F.col("content")
    return corpora.code_files(spark, sf).select(
        "analysis_id",
        "path",
        measures.line_count(text).cast("bigint").alias("n_lines"),
        measures.non_blank_lines(text).cast("bigint").alias("n_non_blank"),
    )


@query
def language_by_ext(spark, sf):
    return corpora.tree(spark, sf).select(
        "analysis_id", "path", language(F.col("path")).alias("language")
    )


@query
def language_by_content(spark, sf):
    return corpora.code_files(spark, sf).select(
        "analysis_id", "path", measures.language_by_content(F.col("content")).alias("language")
    )


@query
def path_parts(spark, sf):
    path = F.col("path")
    return corpora.code_files(spark, sf).select(
        "analysis_id",
        "path",
        basename(path).alias("basename"),
        parent(path).alias("parent"),
        extension(path).alias("extension"),
    )


# Scans ------------------------------------------------------------------------------------

_FOUND = ["analysis_id", "path", "file_ord", "kind", "rule_id", "type", "level", "line", "rule_ord", "match_ord"]


def _found(files: DataFrame, pack, text: str) -> DataFrame:
    keyed = files.select("analysis_id", "path", "file_ord", text)
    out = scan.scan(keyed, pack, text).select(*_FOUND)
    return _long(out, "file_ord", "line", "rule_ord", "match_ord")


def _diff_files(spark, sf):
    return diffs.diff_files(diffs.file_blocks(corpora.diffs(spark, sf)))


@query
def scan_code_security(spark, sf):
    return _found(corpora.code_files(spark, sf), rules.CODE_SECURITY, "content")


@query
def scan_catalogue_security(spark, sf):
    """The same by the way of large catalogues: the rules written to a table and read back, gated by required strings."""
    from reviewloom.operators.catalogues import scan_catalogue

    pack = rules.from_table(rules.catalogue(spark).filter("rule_id LIKE 'CS%'"))
    keyed = corpora.code_files(spark, sf).select("analysis_id", "path", "file_ord", "content")
    return _long(scan_catalogue(keyed, pack).select(*_FOUND), "file_ord", "line", "rule_ord", "match_ord")


@query
def scan_incremental(spark, sf):
    """The same by contents: the first run scans each content once, the second finds all of them scanned."""
    from reviewloom.sources import contents

    folder = scratch(spark)
    keyed = corpora.code_files(spark, sf).select("analysis_id", "path", "file_ord", "content")
    for batch_id in range(2):
        contents.scan_new(keyed, rules.CODE_SECURITY, folder, batch_id)
    found = contents.attached(keyed, rules.CODE_SECURITY, folder, "file_ord")
    return _long(found.select(*_FOUND), "file_ord", "line", "rule_ord", "match_ord")


@query
def scan_code_performance(spark, sf):
    return _found(corpora.code_files(spark, sf), rules.CODE_PERFORMANCE, "content")


@query
def scan_repo_security(spark, sf):
    return _found(corpora.code_files(spark, sf), rules.REPO_SECURITY, "content")


@query
def scan_pr_security(spark, sf):
    return _found(corpora.pr_files(spark, sf), rules.PR_SECURITY, "patch")


@query
def scan_pr_performance(spark, sf):
    return _found(corpora.pr_files(spark, sf), rules.PR_PERFORMANCE, "patch")


@query
def scan_diff_security(spark, sf):
    return _found(_diff_files(spark, sf), rules.DIFF_SECURITY, "code")


@query
def scan_diff_performance(spark, sf):
    return _found(_diff_files(spark, sf), rules.DIFF_PERFORMANCE, "code")


@query
def blocking_findings(spark, sf):
    return selection.blocking(scan_code_security(spark, sf))


@query
def flatten_findings(spark, sf):
    """Nested findings of each file, as a result holds them, back in long form."""
    nested = corpora.code_files(spark, sf).select(
        "analysis_id", "path", scan.findings_array("content", rules.CODE_SECURITY).alias("issues")
    )
    return _long(scan.flatten(nested, "issues").select("analysis_id", "path", "type", "level", "line"), "line")


@query
def first_n(spark, sf):
    """The short lists of a dashboard: findings, root folders and changed files."""
    contents = corpora.repo_contents(spark, sf).select("analysis_id", "path", "smaller", "file_ord", "content")
    found = scan.scan(contents, rules.REPO_SECURITY)
    tenth = rollups.first_findings(found, ["smaller", "file_ord", "rule_ord", "match_ord"], 10)
    roots = rollups.first_root_nodes(rollups.folder_tree(selection.repo_files(corpora.tree(spark, sf))), 30)
    files = rollups.first_files(corpora.pr_files(spark, sf), 10)

    def named(name: str, df: DataFrame, item) -> DataFrame:
        return df.select(
            F.lit(name).alias("list"), "analysis_id", F.col("pos").cast("bigint").alias("pos"), item.alias("item")
        )

    return (
        named("findings", tenth, F.concat("rule_id", F.lit(" "), "path"))
        .unionByName(named("root_nodes", roots, F.col("name")))
        .unionByName(named("files", files, F.col("path")))
    )


# Complexity --------------------------------------------------------------------------------


def _complexity(files: DataFrame, measure, text: str) -> DataFrame:
    return files.select(
        "analysis_id", "path", measure(F.col(text)).cast("bigint").alias("complexity")
    )


@query
def complexity_file(spark, sf):
    return _complexity(corpora.code_files(spark, sf), measures.complexity_of_file, "content")


@query
def complexity_code(spark, sf):
    return _complexity(corpora.code_files(spark, sf), measures.complexity_of_code, "content")


@query
def complexity_diff(spark, sf):
    return _long(_diff_files(spark, sf).select("analysis_id", "path", "complexity"), "complexity")


# Diffs ---------------------------------------------------------------------------------------


@query
def diff_files(spark, sf):
    return _long(
        _diff_files(spark, sf).drop("code"), "file_ord", "additions", "deletions", "complexity"
    )


@query
def diff_hunks(spark, sf):
    hunks = diffs.diff_hunks(diffs.file_blocks(corpora.diffs(spark, sf)))
    return _long(hunks, "file_ord", "hunk_ord")


# Graph ----------------------------------------------------------------------------------------


@query
def imports_pr(spark, sf):
    found = graph.imports_pr(corpora.pr_contents(spark, sf))
    return _long(found, "source_ord", "imp_ord")


@query
def imports_repo(spark, sf):
    return _long(graph.imports_repo(corpora.code_files(spark, sf)), "source_ord", "imp_ord")


def _edges_pr(spark, sf):
    return graph.edges_pr(
        graph.imports_pr(corpora.pr_contents(spark, sf)), corpora.pr_files(spark, sf)
    )


def _edges_repo(spark, sf):
    return graph.edges_repo(
        graph.imports_repo(corpora.code_files(spark, sf)), selection.repo_files(corpora.tree(spark, sf))
    )


@query
def edges_pr(spark, sf):
    return _long(
        _edges_pr(spark, sf).select("analysis_id", "source", "target", "type", "weight"), "weight"
    )


@query
def edges_repo(spark, sf):
    return _long(_edges_repo(spark, sf), "weight")


@query
def edges_pr_resolved(spark, sf):
    """The same with relative imports resolved."""
    imports = graph.imports_pr(corpora.pr_contents(spark, sf))
    found = graph.edges_pr(imports, corpora.pr_files(spark, sf), resolve_dots=True)
    return _long(found.select("analysis_id", "source", "target", "type", "weight"), "weight")


@query
def edges_repo_resolved(spark, sf):
    """The same with relative imports resolved; each file imports one of another folder, up and down again."""
    near = F.col("file_ord") + 20
    up = F.concat(F.lit("\nimport up from '../m"), (near % 13).cast("string"), F.lit("/./f"), near.cast("string"), F.lit("';"))
    files = corpora.code_files(spark, sf).withColumn("content", F.concat("content", up))
    return _long(graph.edges_repo(graph.imports_repo(files), selection.repo_files(corpora.tree(spark, sf)), True), "weight")


@query
def coupling(spark, sf):
    return graph.coupling(_edges_pr(spark, sf)).drop("source_ord")


@query
def graph_nodes(spark, sf):
    measured = metrics.repo_file_metrics(corpora.code_files(spark, sf))
    nodes = graph.graph_nodes(_edges_repo(spark, sf), measured)
    return _long(nodes, "additions", "deletions", "complexity")


@query
def graph_sizes(spark, sf):
    return graph.graph_sizes(_edges_repo(spark, sf))


# Risk, counts and scores ------------------------------------------------------------------------


def _pr_metrics(spark, sf):
    return metrics.pr_file_metrics(corpora.pr_files(spark, sf))


def _pr_sums(spark, sf):
    return scores.file_sums(_pr_metrics(spark, sf), "pr")


def _repo_metrics(spark, sf):
    return metrics.repo_file_metrics(corpora.repo_contents(spark, sf))


def _all_files_metrics(spark, sf):
    """Measures of every file of a repository."""
    return metrics.repo_file_metrics(corpora.code_files(spark, sf))


def _pr_parts(spark, sf, with_findings=False):
    return analyses.pr_parts(corpora.pr_files(spark, sf), corpora.pr_contents(spark, sf), with_findings)


def _repo_parts(spark, sf, with_findings=False):
    return analyses.repo_parts(
        corpora.repo_info(spark, sf),
        rollups.language_stats(corpora.repo_languages(spark, sf)),
        selection.repo_files(corpora.tree(spark, sf)),
        corpora.repo_contents(spark, sf),
        with_findings,
    )


@query
def churn_totals(spark, sf):
    return rollups.churn_totals(corpora.pr_files(spark, sf))


@query
def repo_churn(spark, sf):
    return rollups.churn_totals(_repo_metrics(spark, sf))


@query
def severity_counts(spark, sf):
    return scores.severity_counts(_pr_metrics(spark, sf))


@query
def file_risk_pr(spark, sf):
    return _pr_metrics(spark, sf).select("analysis_id", "path", "risk")


@query
def file_risk_repo(spark, sf):
    return _all_files_metrics(spark, sf).select("analysis_id", "path", "risk")


@query
def avg_complexity(spark, sf):
    averages = scores.average_complexity(_pr_sums(spark, sf))
    return _long(averages, "n_files", "shown")


@query
def threat_level(spark, sf):
    return scores.threat_level(_pr_sums(spark, sf))


@query
def impact_level(spark, sf):
    return scores.impact_level(_pr_sums(spark, sf))


@query
def scores_pr(spark, sf):
    return _pr_parts(spark, sf)["scores"]


@query
def scores_repo(spark, sf):
    return _repo_parts(spark, sf)["scores"]


@query
def scores_diff(spark, sf):
    return scores.scores_diff(analyses.diff_sums(corpora.diffs(spark, sf)))


@query
def scores_code(spark, sf):
    return scores.scores_code(metrics.code_metrics(corpora.code_submissions(spark, sf)))


@query
def score_bands(spark, sf):
    return _long(scores.score_bands(scores_code(spark, sf)), "score")


@query
def complexity_bands(spark, sf):
    return _long(scores.complexity_bands(_all_files_metrics(spark, sf)), "complexity")


@query
def review_estimate(spark, sf):
    p = _pr_parts(spark, sf)
    return _long(scores.review_estimate(p["sums"], p["scores"], p["queue"]), "minutes", "n_quick")


# Queues ---------------------------------------------------------------------------------------------


def _queue(df: DataFrame) -> DataFrame:
    return _long(df, "priority", "line")


def _pr_items(spark, sf):
    return reviews.review_items_pr(
        corpora.pr_files(spark, sf), graph.coupling(_edges_pr(spark, sf))
    )


@query
def reviews_pr(spark, sf):
    return _queue(reviews.reviews_pr(_pr_items(spark, sf)))


@query
def reviews_repo(spark, sf):
    return _queue(reviews.reviews_repo(corpora.repo_contents(spark, sf)))


@query
def reviews_diff(spark, sf):
    return _queue(reviews.reviews_diff(_diff_files(spark, sf)))


@query
def reviews_code(spark, sf):
    return _queue(reviews.reviews_code(corpora.code_submissions(spark, sf)))


@query
def code_files_of_paste(spark, sf):
    """Pasted code as the added file and the hunk that a result shows."""
    files = metrics.paste_files(corpora.code_submissions(spark, sf))
    return _long(files, "additions", "deletions", "complexity", "old_start", "old_lines", "new_start", "new_lines")


@query
def risk_heatmap(spark, sf):
    return _long(reviews.risk_heatmap(_pr_metrics(spark, sf)), "position", "complexity")


# Rollups and texts ------------------------------------------------------------------------------------


@query
def language_stats(spark, sf):
    return _long(rollups.language_stats(corpora.repo_languages(spark, sf), 15), "rank")


@query
def folder_tree(spark, sf):
    nodes = rollups.folder_tree(selection.repo_files(corpora.tree(spark, sf)))
    return _long(nodes, "depth", "child_count")


@query
def folder_listing(spark, sf):
    """The folder trees with the position of each node in the listing a reader sees."""
    nodes = rollups.folder_tree(selection.repo_files(corpora.tree(spark, sf)))
    found = listing.display_positions(reuse(nodes))
    return _long(found.select("analysis_id", "path", "node_type", "depth", "pos"), "depth", "pos")


@query
def summary_pr(spark, sf):
    p = _pr_parts(spark, sf)
    return narrative.summary_pr(p["totals"], p["queue"], p["metrics"])


@query
def summary_repo(spark, sf):
    return narrative.summary_repo(_repo_parts(spark, sf)["facts"])


@query
def summary_diff(spark, sf):
    sums = analyses.diff_sums(corpora.diffs(spark, sf))
    return narrative.summary_diff(analyses.totals(sums), reviews.queue_counts_diff(sums))


@query
def summary_code(spark, sf):
    return narrative.summary_code(metrics.code_metrics(corpora.code_submissions(spark, sf)))


@query
def insights_repo(spark, sf):
    return _long(narrative.insights_repo(_repo_parts(spark, sf)["facts"]), "item_ord")


@query
def prompt_context(spark, sf):
    """Facts of all four kinds of analysis."""
    code = narrative.context_code(
        metrics.code_metrics(corpora.code_submissions(spark, sf), F.col("code").alias("shown"))
    )
    diff_metrics = reuse(metrics.diff_file_metrics(_diff_files(spark, sf)))
    diff_queue = reviews.queue_counts_diff(scores.file_sums(diff_metrics, "diff"))
    diff = narrative.context_diff(diff_metrics, diff_queue)
    r = _repo_parts(spark, sf, with_findings=True)
    found = scan.flatten(r["metrics"].select("analysis_id", "smaller", "file_ord", "found"), "found")
    repo = narrative.context_repo(r["facts"], found.withColumn("note", scan.notes(rules.REPO_SECURITY)))
    p = _pr_parts(spark, sf, with_findings=True)
    pr = narrative.context_pr(
        corpora.pr_headers(spark, sf), p["totals"], corpora.pr_files(spark, sf), p["scores"],
        reviews.items_of_scanned_pr(p["metrics"], p["coupled"]), p["queue"],
    )
    kinds = {"code": code, "diff": diff, "repo": repo, "pr": pr}
    named = [df.withColumn("kind", F.lit(kind)) for kind, df in kinds.items()]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df)
    return out


@query
def results(spark, sf):
    """One row per analysis of every kind."""
    code = analyses.results_code(corpora.code_submissions(spark, sf))
    diff = analyses.results_diff(corpora.diffs(spark, sf))
    pr = analyses.results_pr(corpora.pr_files(spark, sf), corpora.pr_contents(spark, sf))
    repo = analyses.results_repo(
        corpora.repo_info(spark, sf),
        rollups.language_stats(corpora.repo_languages(spark, sf)),
        selection.repo_files(corpora.tree(spark, sf)),
        corpora.repo_contents(spark, sf),
    )
    return code.unionByName(diff).unionByName(pr).unionByName(repo)


# Streams ------------------------------------------------------------------------------------------------


@query
def stream_scan(spark, sf):
    from reviewloom.streaming.scan import start_scan

    folder = scratch(spark)
    start_scan(corpora.page_stream(spark, sf), f"{folder}/out", f"{folder}/state").awaitTermination()
    return _long(spark.read.parquet(f"{folder}/out"), "file_ord", "line", "rule_ord", "match_ord")


@query
def stream_results(spark, sf):
    from reviewloom.streaming.results import start_results

    folder = scratch(spark)
    start_results(corpora.page_stream(spark, sf), f"{folder}/out", f"{folder}/state").awaitTermination()
    return store.load(spark, f"{folder}/out").select(*analyses.RESULT)


@query
def stream_dedup_settled(spark, sf):
    """The same, settled as the watermark passes: state is kept for a day of lateness."""
    from reviewloom.streaming.dedup import accepted, start_dedup

    folder = scratch(spark)
    events = corpora.table_stream(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type"
    )
    start_dedup(
        events, f"{folder}/out", f"{folder}/state", ["user_id", "event_type"], "ts", "event_id", 86_400
    ).awaitTermination()
    found = accepted(spark, f"{folder}/out", checkpoint=f"{folder}/state")
    return found.select("user_id", "event_type", F.col("row_id").alias("event_id"))


@query
def stream_dedup(spark, sf):
    """Events of one user and type suppress each other; the table's own files are the stream."""
    from reviewloom.streaming.dedup import accepted, start_dedup

    folder = scratch(spark)
    events = corpora.table_stream(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type"
    )
    start_dedup(
        events, f"{folder}/out", f"{folder}/state", ["user_id", "event_type"], "ts", "event_id"
    ).awaitTermination()
    return accepted(spark, f"{folder}/out").select("user_id", "event_type", F.col("row_id").alias("event_id"))
