"""Languages, colours and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.functions.binding import literals

# Language of a file extension.
LANGUAGE_OF_EXTENSION = {
    "ts": "TypeScript",
    "tsx": "TypeScript",
    "js": "JavaScript",
    "jsx": "JavaScript",
    "py": "Python",
    "go": "Go",
    "rs": "Rust",
    "java": "Java",
    "rb": "Ruby",
    "cs": "C#",
    "php": "PHP",
    "c": "C",
    "cpp": "C++",
    "h": "C/C++ Header",
    "css": "CSS",
    "scss": "SCSS",
    "html": "HTML",
    "json": "JSON",
    "yaml": "YAML",
    "yml": "YAML",
    "md": "Markdown",
    "sql": "SQL",
    "sh": "Shell",
    "bash": "Shell",
    "dockerfile": "Dockerfile",
    "graphql": "GraphQL",
    "vue": "Vue",
    "svelte": "Svelte",
}

# Display colour of a language.
COLOR_OF_LANGUAGE = {
    "TypeScript": "#3178C6",
    "JavaScript": "#F7DF1E",
    "Python": "#3572A5",
    "Go": "#00ADD8",
    "Rust": "#DEA584",
    "Java": "#B07219",
    "Ruby": "#701516",
    "C#": "#178600",
    "PHP": "#4F5D95",
    "C": "#555555",
    "C++": "#F34B7D",
    "CSS": "#563D7C",
    "HTML": "#E34C26",
    "JSON": "#292929",
    "YAML": "#CB171E",
    "Markdown": "#083FA1",
    "SQL": "#e38c00",
    "Shell": "#89e051",
    "Dockerfile": "#384D54",
    "GraphQL": "#E10098",
    "Vue": "#41B883",
    "Svelte": "#FF3E00",
}
DEFAULT_COLOR = "#6B7280"

# Extensions left out of a repository's file list, and those scanned.
ASSET_EXTENSIONS = [
    "lock", "sum", "map", "min", "png", "jpg", "gif", "svg", "ico", "woff", "woff2", "ttf", "eot",
]
SOURCE_EXTENSIONS = [
    "ts", "tsx", "js", "jsx", "py", "go", "rs", "java", "rb", "cs", "php", "vue", "svelte",
]


def _literal_map(values: dict[str, str]) -> Column:
    return F.expr(f"map({literals(x for pair in values.items() for x in pair)})")


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot; the whole path when it has no dot."""
    return F.lower(F.substring_index(path, ".", -1))


def language(path: Column) -> Column:
    ext = extension(path)
    return F.coalesce(
        F.try_element_at(_literal_map(LANGUAGE_OF_EXTENSION), ext),
        F.when(ext == "", F.lit("Unknown")).otherwise(F.upper(ext)),
    )


def color(lang: Column) -> Column:
    return F.coalesce(F.try_element_at(_literal_map(COLOR_OF_LANGUAGE), lang), F.lit(DEFAULT_COLOR))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Path up to its last slash; empty when there is none."""
    cut = F.length(path) - F.length(basename(path)) - 1
    return F.when(cut > 0, F.substring(path, F.lit(1), cut)).otherwise("")


def rank_of(value: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in ranks.items():
        out = F.when(value == name, F.lit(rank)).otherwise(out)
    return out


def round_half_up(x: Column) -> Column:
    """Rounding with halves going up, as an integer."""
    return F.floor(x + F.lit(0.5)).cast("int")


def score_band(score: Column) -> Column:
    return (
        F.when(score >= 80, "Excellent")
        .when(score >= 60, "Good")
        .when(score >= 40, "Needs Work")
        .otherwise("Critical")
    )


def complexity_band(complexity: Column) -> Column:
    """Band of a file's complexity: above 80, above 60, above 40, and the rest."""
    return (
        F.when(complexity > 80, "critical")
        .when(complexity > 60, "high")
        .when(complexity > 40, "medium")
        .otherwise("low")
    )
