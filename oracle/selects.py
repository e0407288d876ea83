"""One statement per registered query."""

from __future__ import annotations

from oracle.ctes import (
    NL,
    base_of,
    complexity_code,
    complexity_file,
    ext_of,
    given,
    language_of,
    lit_re,
    n_lines,
    paste_language,
    queue,
    quoted,
    re2,
    rounded,
    _is_diff,
)
from reviewloom.functions.dialect import NOT_SPACE

SELECTS: dict[str, str] = {}

SELECTS["tree_blobs"] = "SELECT * FROM tree_t WHERE type = 'blob'"
SELECTS["pr_file_pages"] = """
    SELECT 'big-' || (CAST(substr(analysis_id, 4) AS BIGINT) // 50) AS analysis_id,
           row_number() OVER (PARTITION BY CAST(substr(analysis_id, 4) AS BIGINT) // 50
                              ORDER BY CAST(substr(analysis_id, 4) AS BIGINT), file_ord) - 1 AS file_ord,
           path, status, CAST(additions AS INTEGER) AS additions,
           CAST(deletions AS INTEGER) AS deletions, CAST(changes AS INTEGER) AS changes, patch FROM pr_files_t
"""
SELECTS["repo_tree_json"] = """
    SELECT analysis_id || '-' || (file_ord // 1000) AS analysis_id,
           row_number() OVER (PARTITION BY analysis_id, file_ord // 1000 ORDER BY file_ord) - 1 AS file_ord, path, type, size
    FROM tree_t
"""
SELECTS["repo_languages_json"] = "SELECT analysis_id, language, bytes FROM languages_t"
SELECTS["pr_headers_json"] = "SELECT analysis_id, title, author FROM pr_header_t"
SELECTS["decode_contents"] = """
    SELECT source AS analysis_id, doc_id AS file_ord, text AS content FROM documents WHERE doc_id % 7 <> 1 AND text <> ''
"""
SELECTS["checkout_files"] = r"""
    SELECT 'f-' || n AS file, size, CASE WHEN size > 500000 THEN 'too large' WHEN n % 5 = 4 THEN 'binary' ELSE 'text' END AS kind,
           CASE WHEN size > 500000 OR n % 5 = 4 THEN NULL WHEN n % 5 = 2 THEN 'UTF-16BE'
                WHEN n % 5 = 3 AND strlen(t) > length(t) THEN 'ISO-8859-1' ELSE 'UTF-8' END AS encoding,
           CASE WHEN size <= 500000 AND n % 5 <> 4 THEN t || chr(10) END AS content
    FROM (SELECT n, t, CASE n % 5 WHEN 0 THEN strlen(t) + 1 WHEN 1 THEN strlen(t) + 4
                            WHEN 2 THEN 2 * length(t) + 2 * length(regexp_replace(t, '[^\x{10000}-\x{10FFFF}]', '', 'g')) + 4
                            WHEN 3 THEN length(t) + 1 ELSE strlen(t) + 2 END AS size
          FROM (SELECT n, CASE WHEN n % 5 = 3 THEN regexp_replace(s, '[^\x{00}-\x{FF}]', '?', 'g') ELSE s END AS t
                FROM (SELECT doc_id // 25 AS n, string_agg(text, chr(10) ORDER BY doc_id, text) AS s FROM documents GROUP BY 1)))
"""
SELECTS["retain_latest"] = """
    SELECT 'u' || user_id AS analysis_id, min_by(event_id, (ts, event_id)) AS first_event,
           max_by(event_id, (ts, event_id)) AS last_event, max_by(value, (ts, event_id)) AS value
    FROM events GROUP BY user_id ORDER BY min((ts, event_id)) DESC LIMIT 50
"""
SELECTS["result_lookup"] = """
    SELECT c.id AS analysis_id, e.value, e.id IS NOT NULL AS found
    FROM (SELECT DISTINCT 'u' || conv_id AS id FROM conversations) c
    LEFT JOIN (SELECT 'u' || user_id AS id, max_by(value, (ts, event_id)) AS value FROM events GROUP BY user_id) e
      ON e.id = c.id
"""
SELECTS["landed_submissions"] = "SELECT analysis_id, url, diff, code, CAST(NULL AS VARCHAR) AS filename FROM subs_t"
SELECTS["repo_info_json"] = """
    SELECT source AS analysis_id, source AS name, 'org/' || source AS full_name,
           CASE WHEN min(doc_id) % 3 <> 0 THEN arg_min(text, doc_id) END AS description,
           CAST(count(*) * min(doc_id) AS BIGINT) AS stargazers_count
    FROM documents GROUP BY source
"""
SELECTS["pr_page_faults"] = """
    SELECT 'big-' || g AS analysis_id, page, fault FROM (
      SELECT g, page, fault FROM bad_pages_t
      UNION ALL SELECT g, page, 'repeated' FROM big_pages_t WHERE damage = 4
      UNION ALL SELECT g, page, 'short' FROM big_pages_t p WHERE damage IN (4, 5) AND n < 100
        AND EXISTS (SELECT 1 FROM big_pages_t q WHERE q.g = p.g AND q.page > p.page AND q.damage <> 2)
      UNION ALL SELECT g, page, 'missing before' FROM big_pages_t p WHERE damage <> 2
        AND EXISTS (SELECT 1 FROM big_pages_t q WHERE q.g = p.g AND q.page = p.page - 1 AND q.damage = 2))
"""
SELECTS["pr_pages_sound"] = """
    SELECT 'big-' || f.g AS analysis_id, f.ord, f.path, NULL AS fault
    FROM big_files_t f JOIN big_pages_t p ON p.g = f.g AND p.page = f.ord // 100 + 1 WHERE p.damage IN (4, 5)
    UNION ALL SELECT 'big-' || g, page, NULL, fault FROM bad_pages_t
"""
SELECTS["store_upsert"] = """
    SELECT 'u' || user_id AS analysis_id, arg_max(event_id, (event_id % 3, ts, event_id)) AS event_id,
           arg_max(value, (event_id % 3, ts, event_id)) AS value
    FROM events GROUP BY user_id
"""
SELECTS["store_get"] = """
    SELECT c.id AS analysis_id, e.value, e.id IS NOT NULL AS found
    FROM (SELECT DISTINCT 'u' || conv_id AS id FROM conversations) c
    LEFT JOIN (SELECT 'u' || user_id AS id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 DESC, ts DESC, event_id DESC) AS n
               FROM events) e ON e.id = c.id AND e.n = 1
"""
SELECTS["route_submissions"] = "SELECT analysis_id, kind, reject_reason FROM routed_t"
SELECTS["parse_urls"] = "SELECT analysis_id, url, type, owner, repo, pr_number FROM parsed_t"
SELECTS["detect_diffs"] = (
    f"SELECT analysis_id, coalesce({_is_diff('diff')}, false) AS is_diff FROM subs_t"
)
SELECTS["repo_files"] = "SELECT * FROM repo_files_t"
SELECTS["scan_candidates"] = "SELECT * FROM scan_candidates_t"
SELECTS["pr_candidates"] = "SELECT * FROM pr_candidates_t"
SELECTS["line_stats"] = f"""
    SELECT analysis_id, path, {n_lines("content")} AS n_lines,
           len(list_filter(string_split(content, {NL}), lambda l: regexp_matches(l, '{NOT_SPACE}'))) AS n_non_blank
    FROM code_files
"""
SELECTS["language_by_ext"] = (
    f"SELECT analysis_id, path, {language_of('path')} AS language FROM tree_t"
)


def _has(pattern: str, flags: str = "") -> str:
    return f"regexp_matches(content, {quoted(flags + re2(pattern))})"


SELECTS["language_by_content"] = f"""
    SELECT analysis_id, path, CASE
      WHEN {_has(r"^\s*(?:def|import|from|class)\s+\w+", "(?m)")} AND NOT {_has(r"function\s+\w+")} THEN 'python'
      WHEN {_has(r"\b(?:pub\s+fn|impl|struct|enum|use\s+\w+::)")} THEN 'rust'
      WHEN {_has(r'\b(?:func|package|import\s+")')} AND NOT {_has("function")} THEN 'go'
      WHEN {_has(r"\b(?:class|public|private|protected|void|int\s+main)")}
           AND regexp_matches(string_split(content, {NL})[1], {lit_re(r";\s*$")}) THEN 'java'
      WHEN {_has(r"<\?php|<\?=")} THEN 'php'
      WHEN {_has(r"#include\s+<")} THEN 'c' ELSE 'javascript' END AS language
    FROM code_files
"""
SELECTS["path_parts"] = f"""
    SELECT analysis_id, path, {base_of("path")} AS basename, array_to_string(string_split(path, '/')[:-2], '/') AS parent,
           {ext_of("path")} AS extension FROM code_files
"""

_FOUND = (
    "analysis_id, path, file_ord, kind, rule_id, type, level, CAST(line AS BIGINT) AS line, "
    "CAST(rule_ord AS BIGINT) AS rule_ord, match_ord"
)
for _key, _cte in {
    "scan_code_security": "found_cs",
    "scan_catalogue_security": "found_cs",
    "scan_incremental": "found_cs",
    "scan_code_performance": "found_cp",
    "scan_repo_security": "found_rs",
    "scan_pr_security": "found_ps",
    "scan_pr_performance": "found_pp",
    "scan_diff_security": "found_ds",
    "scan_diff_performance": "found_dp",
}.items():
    SELECTS[_key] = f"SELECT {_FOUND} FROM {_cte}"
SELECTS["blocking_findings"] = f"SELECT {_FOUND} FROM found_cs WHERE level IN ('critical', 'high')"
SELECTS["flatten_findings"] = (
    "SELECT analysis_id, path, type, level, CAST(line AS BIGINT) AS line FROM found_cs"
)
SELECTS["first_n"] = """
    SELECT 'findings' AS list, analysis_id, pos, rule_id || ' ' || path AS item
    FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY scan_ord, rule_ord, match_ord) AS pos FROM found_repo)
    WHERE pos <= 10
    UNION ALL
    SELECT 'root_nodes', analysis_id, pos, name
    FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY node_type DESC, name) AS pos
          FROM folders_t WHERE depth = 1) WHERE pos <= 30
    UNION ALL
    SELECT 'files', analysis_id, pos, path
    FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY file_ord) AS pos FROM pr_files_t) WHERE pos <= 10
"""
SELECTS["complexity_file"] = (
    f"SELECT analysis_id, path, CAST({complexity_file('content')} AS BIGINT) AS complexity FROM code_files"
)
SELECTS["complexity_code"] = (
    f"SELECT analysis_id, path, CAST({complexity_code('content')} AS BIGINT) AS complexity FROM code_files"
)
SELECTS["complexity_diff"] = "SELECT analysis_id, path, complexity FROM diff_files_t"
SELECTS["diff_files"] = "SELECT * EXCLUDE (code) FROM diff_files_t"
SELECTS["diff_hunks"] = "SELECT * FROM hunks_t"
SELECTS["imports_pr"] = "SELECT * FROM imports_pr_t"
SELECTS["imports_repo"] = "SELECT * FROM imports_all_t"
SELECTS["edges_pr"] = "SELECT analysis_id, source, target, type, weight FROM edges_pr_t"
SELECTS["edges_repo"] = "SELECT * FROM edges_all_t"
SELECTS["edges_pr_resolved"] = "SELECT * FROM edges_pr_resolved_t"
SELECTS["edges_repo_resolved"] = "SELECT * FROM edges_up_t"
SELECTS["coupling"] = "SELECT analysis_id, source, n_edges, severity FROM coupled_t"
SELECTS["graph_nodes"] = """
    SELECT n.analysis_id, n.path, m.additions, m.deletions, m.risk, m.complexity
    FROM (SELECT analysis_id, source AS path FROM edges_all_t UNION SELECT analysis_id, target FROM edges_all_t) n
    LEFT JOIN all_metrics_t m ON m.analysis_id = n.analysis_id AND m.path = n.path
"""
SELECTS["graph_sizes"] = """
    SELECT e.analysis_id, n_nodes, count(*) AS n_edges FROM edges_all_t e JOIN (
      SELECT analysis_id, count(DISTINCT path) AS n_nodes
      FROM (SELECT analysis_id, unnest([source, target]) AS path FROM edges_all_t) GROUP BY 1) n
      ON n.analysis_id = e.analysis_id GROUP BY e.analysis_id, n_nodes
"""
SELECTS["churn_totals"] = """
    SELECT analysis_id, CAST(sum(additions) AS BIGINT) AS total_additions,
           CAST(sum(deletions) AS BIGINT) AS total_deletions, count(*) AS files_changed FROM pr_files_t GROUP BY 1
"""
SELECTS["repo_churn"] = SELECTS["churn_totals"].replace("pr_files_t", "repo_metrics_t")
SELECTS["severity_counts"] = """
    SELECT analysis_id, sec_critical, sec_high, sec_medium, sec_low, coalesce(sec_files, 0) AS sec_files,
           perf_high, perf_medium, perf_low, coalesce(perf_files, 0) AS perf_files
    FROM pr_sums_t LEFT JOIN (
      SELECT analysis_id, count(DISTINCT CASE WHEN kind = 'security' THEN path END) AS sec_files,
             count(DISTINCT CASE WHEN kind = 'performance' THEN path END) AS perf_files
      FROM found_pr GROUP BY 1) USING (analysis_id)
"""
SELECTS["file_risk_pr"] = "SELECT analysis_id, path, risk FROM pr_metrics_t"
SELECTS["file_risk_repo"] = "SELECT analysis_id, path, risk FROM all_metrics_t"
SELECTS["avg_complexity"] = f"""
    SELECT analysis_id, n_files, avg_complexity, CAST({rounded("avg_complexity")} AS BIGINT) AS shown FROM pr_sums_t
"""
SELECTS["threat_level"] = """
    SELECT s.analysis_id, CASE min(CASE level WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 END)
             WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Clean' END AS threat_level
    FROM pr_sums_t s LEFT JOIN found_ps f ON f.analysis_id = s.analysis_id GROUP BY s.analysis_id
"""
SELECTS["impact_level"] = """
    SELECT s.analysis_id, CASE min(CASE level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) FILTER (f.level IS NOT NULL)
             WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Low' ELSE 'Optimal' END AS impact_level
    FROM pr_sums_t s LEFT JOIN found_pp f ON f.analysis_id = s.analysis_id GROUP BY s.analysis_id
"""
SELECTS["scores_pr"] = "SELECT * FROM pr_scores_t"
SELECTS["scores_repo"] = "SELECT * FROM repo_scores_t"
SELECTS["scores_diff"] = "SELECT * FROM diff_scores_t"
SELECTS["scores_code"] = "SELECT * FROM code_scores_t"
SELECTS["score_bands"] = """
    SELECT analysis_id, score_name, CAST(score AS BIGINT) AS score,
           CASE WHEN score >= 80 THEN 'Excellent' WHEN score >= 60 THEN 'Good' WHEN score >= 40 THEN 'Needs Work'
                ELSE 'Critical' END AS band
    FROM (SELECT analysis_id, unnest(['overall', 'security', 'complexity', 'maintainability']) AS score_name,
                 unnest([overall, security, complexity, maintainability]) AS score FROM code_scores_t)
"""
SELECTS["complexity_bands"] = """
    SELECT analysis_id, path, complexity, CASE WHEN complexity > 80 THEN 'critical' WHEN complexity > 60 THEN 'high'
      WHEN complexity > 40 THEN 'medium' ELSE 'low' END AS band FROM all_metrics_t
"""
SELECTS["review_estimate"] = """
    SELECT analysis_id, minutes, n_quick, CASE WHEN minutes < 60 THEN minutes || 'm'
             WHEN minutes % 60 > 0 THEN (minutes // 60) || 'h ' || (minutes % 60) || 'm'
             ELSE (minutes // 60) || 'h' END AS estimate
    FROM (
      SELECT analysis_id, coalesce(n_quick, 0) AS n_quick,
             CAST(greatest(15, base + 25 * coalesce(n_critical, 0) + 12 * coalesce(n_high, 0)
               + ceil(base * ((100 - complexity) / 100.0::DOUBLE))) AS BIGINT) AS minutes
      FROM (SELECT analysis_id, ceil((additions + deletions) / 15.0::DOUBLE) AS base FROM pr_sums_t)
      JOIN pr_scores_t USING (analysis_id) LEFT JOIN counts_pr USING (analysis_id))
"""
SELECTS["reviews_pr"] = "SELECT * FROM queue_pr"
_by_file = "file_ord, cat, rule_ord, match_ord"
SELECTS["reviews_repo"] = queue("items_repo", _by_file, f"sev, cat, {_by_file}")
SELECTS["reviews_diff"] = queue("items_diff", _by_file, f"sev, {_by_file}")
SELECTS["reviews_code"] = queue(
    "items_code", "cat, rule_ord, match_ord", "sev, cat, rule_ord, match_ord"
)
SELECTS["risk_heatmap"] = """
    SELECT analysis_id, path, risk, complexity, row_number() OVER (PARTITION BY analysis_id ORDER BY
      CASE risk WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, file_ord) AS position
    FROM pr_metrics_t
"""
SELECTS["language_stats"] = "SELECT analysis_id, rank, language, bytes, percentage, color FROM languages_t WHERE rank <= 15"
SELECTS["folder_tree"] = """
    SELECT f.analysis_id, f.path, f.parent, f.name, f.node_type, f.depth,
           (SELECT count(*) FROM folders_t c WHERE c.analysis_id = f.analysis_id AND c.parent = f.path) AS child_count,
           f.language, f.size
    FROM folders_t f
    UNION ALL
    SELECT analysis_id, '', NULL, '/', 'folder', 0, count(*), NULL, NULL FROM folders_t WHERE depth = 1 GROUP BY 1
"""
# Level by level: a child's ordinal among its siblings is appended to its folder's list of ordinals.
SELECTS["folder_listing"] = """
    SELECT analysis_id, path, node_type, depth, row_number() OVER (PARTITION BY analysis_id ORDER BY ordinals) AS pos FROM (
      WITH RECURSIVE placed AS (
        SELECT *, row_number() OVER (PARTITION BY analysis_id, parent ORDER BY node_type DESC, name) AS ordinal FROM folders_t
      ), walked AS (
        SELECT DISTINCT analysis_id, '' AS path, 'folder' AS node_type, 0::BIGINT AS depth, []::BIGINT[] AS ordinals FROM folders_t
        UNION ALL
        SELECT p.analysis_id, p.path, p.node_type, p.depth::BIGINT, list_append(w.ordinals, p.ordinal)
        FROM walked w JOIN placed p ON p.analysis_id = w.analysis_id AND p.parent = w.path AND p.depth = w.depth + 1
      ) SELECT * FROM walked)
"""
SELECTS["summary_pr"] = "SELECT * FROM summary_pr_t"
SELECTS["summary_repo"] = "SELECT * FROM summary_repo_t"
SELECTS["summary_diff"] = "SELECT * FROM summary_diff_t"
SELECTS["summary_code"] = "SELECT * FROM summary_code_t"

_AVG = rounded("avg_complexity")


def _section(name: str, points: list[tuple[str, str]], otherwise: list[str], more: str = "") -> str:
    """A section's points; ``otherwise`` stands in when none of them holds."""
    listed = ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in points)
    kept = f"list_filter([{listed}], lambda t: t IS NOT NULL)"
    full = f"(CASE WHEN len({kept}) = 0 THEN [{', '.join(otherwise)}] ELSE {kept} END)"
    if more:
        full = f"({full} || list_filter([{more}], lambda t: t IS NOT NULL))"
    return (
        f"SELECT analysis_id, '{name}' AS section, unnest(range(0, len({full}))) AS item_ord, "
        f"unnest({full}) AS text FROM facts_t"
    )


_STRENGTHS = [
    ("security_score >= 80", "'Security scores ' || security_score || ' of 100, ' || "
     + given("sec_critical = 0", "'no'", "'few'") + " || ' critical findings.'"),
    ("complexity_score >= 70", "'Complexity scores ' || complexity_score || ' of 100 over ' || total_files || ' files.'"),
    ("n_langs > 1", "'Written in ' || array_to_string(langs[1:3], ', ') || '.'"),
    ("maintainability_score >= 75", "'Maintainability scores ' || maintainability_score || ' of 100.'"),
    ("architecture_score >= 70",
     "'Architecture scores ' || architecture_score || ' of 100; ' || n_edges || ' imports between files were resolved.'"),
]
_WEAKNESSES = [
    ("sec_critical > 0", "sec_critical || ' critical security findings.'"),
    ("sec_high > 0", "sec_high || ' high security findings.'"),
    ("avg_complexity > 60", f"'Files have a complexity of ' || {_AVG} || ' on average.'"),
    ("n_complex > 0", "n_complex || ' files are very complex.'"),
    ("maintainability_score < 60", "'Maintainability scores only ' || maintainability_score || ' of 100.'"),
    ("total_files > 500", "total_files || ' files are a lot for one repository.'"),
]
_DEBT = [
    ("n_complex > 0", "n_complex || ' complex files to split up.'"),
    ("avg_complexity > 50", f"'An average complexity of ' || {_AVG} || ' has built up.'"),
    ("maintainability_score < 70", "'Maintainability is below 70.'"),
]
_IMPROVEMENTS = [
    ("sec_critical + sec_high > 0", "'Fix the ' || (sec_critical + sec_high) || ' urgent security findings.'"),
    ("avg_complexity > 50", "'Split up long functions.'"),
    ("n_edges = 0 AND total_files > 5", "'No imports between files were resolved: name them by path.'"),
    ("architecture_score < 70", "'Draw the lines between modules more clearly.'"),
]
SELECTS["insights_repo"] = " UNION ALL ".join(
    [
        _section("Technical Debt", _DEBT, ["'None to speak of.'"]),
        _section(
            "Strengths", _STRENGTHS,
            ["total_files || ' files were looked at.'", "'Most of it is ' || primary_lang || '.'"],
            "CASE WHEN stargazers_count > 100 THEN 'Starred ' || stargazers_count || ' times.' END",
        ),
        _section("Weaknesses", _WEAKNESSES, ["'None found.'"]),
        _section(
            "Suggested Improvements", _IMPROVEMENTS, ["'Keep to the present standard.'", "'Test the critical paths.'"]
        ),
    ]
)
SELECTS["prompt_context"] = f"""
    SELECT analysis_id, 'code' AS kind,
           'Pasted code:' || {NL} || code || {NL} || 'Security findings: ' || (sec_critical + sec_high + sec_medium + sec_low)
           || '; performance findings: ' || (perf_high + perf_medium + perf_low) || '.' AS text
    FROM code_metrics_t
    UNION ALL
    SELECT m.analysis_id, 'diff', 'Diff by file:' || {NL} || string_agg(path || ': +' || additions || ' -' || deletions || ', '
           || (sec_critical + sec_high + sec_medium + sec_low) || ' security, ' || (perf_high + perf_medium + perf_low) || ' performance',
             {NL} ORDER BY file_ord)
           || {NL} || 'Queue: ' || coalesce(any_value(n_items), 0) || ' items, ' || coalesce(any_value(n_critical), 0) || ' critical'
    FROM diff_metrics_t m LEFT JOIN counts_diff q ON q.analysis_id = m.analysis_id GROUP BY m.analysis_id
    UNION ALL
    SELECT f.analysis_id, 'repo', full_name || {NL} || 'About: ' || coalesce(nullif(description, ''), 'none')
           || {NL} || 'Languages: ' || coalesce(array_to_string(shares, ', '), '') || {NL} || 'Files: ' || total_files
           || {NL} || 'Security ' || security_score || ', complexity ' || complexity_score
           || ', maintainability ' || maintainability_score || ', architecture ' || architecture_score || ' (of 100)' || {NL}
           || coalesce('Urgent: ' || listed, 'Nothing urgent.')
    FROM facts_t f LEFT JOIN (
      SELECT analysis_id, string_agg(type || ': ' || note, '; ' ORDER BY scan_ord, rule_ord, match_ord) AS listed
      FROM found_repo WHERE level IN ('critical', 'high') GROUP BY 1) l ON l.analysis_id = f.analysis_id
    UNION ALL
    SELECT h.analysis_id, 'pr', title || ' (' || author || ')' || {NL} || 'Repository: ' || repo_name
           || {NL} || 'Files: ' || n_files || ', +' || additions || ' -' || deletions
           || {NL} || 'Changed: ' || files
           || {NL} || 'Overall ' || overall || ', security ' || security || ', performance ' || performance || ' (of 100)'
           || {NL} || 'Urgent items: ' || coalesce(n_urgent, 0) || {NL} || coalesce(listed, '')
    FROM pr_header_t h JOIN pr_sums_t s ON s.analysis_id = h.analysis_id
    JOIN pr_scores_t sc ON sc.analysis_id = h.analysis_id
    JOIN (SELECT analysis_id, string_agg(path || ' +' || additions || ' -' || deletions, ', ' ORDER BY file_ord) AS files
          FROM pr_files_t GROUP BY 1) k ON k.analysis_id = h.analysis_id
    LEFT JOIN (SELECT analysis_id, count(*) AS n_urgent,
                      string_agg('* ' || category || ': ' || title || '. ' || description, {NL} ORDER BY priority) AS listed
               FROM queue_pr WHERE severity IN ('critical', 'high') GROUP BY 1) u ON u.analysis_id = h.analysis_id
"""
SELECTS["code_files_of_paste"] = f"""
    SELECT analysis_id, path, 'added' AS status, additions, 0::BIGINT AS deletions, {paste_language()} AS language, complexity,
           1::BIGINT AS old_start, 0::BIGINT AS old_lines, 1::BIGINT AS new_start, additions AS new_lines, code AS content
    FROM code_metrics_t
"""


def _result(kind: str, scores: str, sums: str, summary: str, extra: dict[str, str]) -> str:
    def column(name: str) -> str:
        return f"{extra.get(name, 'NULL::INTEGER')} AS {name}"

    return f"""
    SELECT c.analysis_id, '{kind}' AS kind, c.overall, c.security, c.complexity, c.maintainability,
           {column("performance")}, {column("architecture")}, u.n_files AS files_changed,
           u.additions AS total_additions, u.deletions AS total_deletions, t.summary
    FROM {scores} c JOIN {sums} u ON u.analysis_id = c.analysis_id JOIN {summary} t ON t.analysis_id = c.analysis_id
    """


SELECTS["results"] = " UNION ALL ".join(
    [
        _result(
            "code", "code_scores_t",
            "(SELECT analysis_id, 1 AS n_files, additions, 0 AS deletions FROM code_metrics_t)",
            "summary_code_t", {},
        ),
        _result("diff", "diff_scores_t", "diff_sums_t", "summary_diff_t", {}),
        _result("pr", "pr_scores_t", "pr_sums_t", "summary_pr_t", {"performance": "c.performance"}),
        _result("repo", "repo_scores_t", "repo_sums_t", "summary_repo_t", {"architecture": "c.architecture"}),
    ]
)

_STREAMED = (
    "analysis_id, path, file_ord, kind, rule_id, type, level, CAST(line AS BIGINT) AS line, "
    "CAST(rule_ord AS BIGINT) AS rule_ord, match_ord"
)
SELECTS["stream_scan"] = f"""
    SELECT 'code' AS submission, {_STREAMED} FROM sub_found_code
    UNION ALL SELECT 'diff', {_STREAMED} FROM sub_found_diff
"""
SELECTS["stream_results"] = " UNION ALL ".join(
    [
        _result(
            "code", "sub_code_scores",
            "(SELECT analysis_id, 1 AS n_files, additions, 0 AS deletions FROM sub_code_metrics)",
            "sub_code_summary", {},
        ),
        _result("diff", "sub_diff_scores", "sub_diff_sums", "sub_diff_summary", {}),
    ]
)
SELECTS["stream_dedup"] = "SELECT user_id, event_type, event_id FROM accepted"
SELECTS["stream_dedup_settled"] = SELECTS["stream_dedup"]
