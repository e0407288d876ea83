"""Measures of source text, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.functions.dialect import (
    LINE_START,
    NOT_SPACE,
    SPACE,
    WORD,
    to_java,
    words,
)

# Words counted by the complexity measures.
CONTROL_WORDS = [
    "if", r"else\s+if", "elif", "switch", "case", "for", "while", "do", "catch", "try", "except",
]
CONTROL_WORDS_CODE = CONTROL_WORDS + ["match"]
CONTROL_WORDS_DIFF = ["if", "else", "for", "while", "switch", "try", "catch"]
FUNCTION_WORDS = ["function", "def", "fn", "func", "method"]
FUNCTION_WORDS_DIFF = ["function", "def", "fn"]

# Import statements; group 1 is the module.
IMPORT_FROM = r"""import\s+(?:\{[^}]*\}|\*\s+as\s+\w+|\w+)\s+from\s+['"]([^'"]+)['"]"""
IMPORT_CALL = r"""import\s*\(\s*['"]([^'"]+)['"]\s*\)"""
REQUIRE_CALL = r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)"""
IMPORT_PYTHON = r"(?:from\s+(\S+)\s+import|import\s+(\S+))"


def newlines(text: Column) -> Column:
    # Bytes tell as much as characters, and need no count over the text.
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def line_count(text: Column) -> Column:
    return (newlines(text) + 1).cast("int")


def is_blank(text: Column) -> Column:
    return ~text.rlike(NOT_SPACE)


def non_blank_lines(text: Column) -> Column:
    """Lines with something on them: each match runs from a first visible character to the end of its line."""
    return F.regexp_count(text, F.lit(f"{NOT_SPACE}[^\\n]*+"))


def looks_like_diff(text: Column) -> Column:
    def line_starts_with(head: str) -> Column:
        return text.startswith(head) | text.contains("\n" + head)

    return line_starts_with("diff --git ") & line_starts_with("@@ ")


def _function_words(names: list[str]) -> str:
    # An arrow counts only between two word characters.  One class settles most places; what it took is looked back at.
    starts = "".join(sorted({n[0] for n in names}))
    rests = "|".join(f"(?<={n[0]}){n[1:]}" for n in names)
    return f"[{starts}=](?:(?<!{WORD}.)(?:{rests})(?!{WORD})|(?<={WORD}=)>(?={WORD}))"


def _deepest(text: Column, opening: str, closing: str) -> Column:
    """Largest running balance of brackets; it starts at 0 and may fall below."""
    brackets = F.regexp_replace(text, f"[^\\Q{opening}{closing}\\E]+", "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(acc: Column, ch: Column) -> Column:
        # Text without brackets splits into one empty piece.
        move = F.when(ch == "", 0).when(F.lit(opening).contains(ch), 1).otherwise(-1)
        now = acc["now"] + move
        return F.struct(now.alias("now"), F.greatest(acc["top"], now).alias("top"))

    return F.aggregate(F.split(brackets, ""), zero, step, lambda acc: acc["top"])


def _complexity(text: Column, control: list[str], opening: str, closing: str) -> Column:
    score = (
        F.lit(10)
        + 3 * F.regexp_count(text, F.lit(words(control)))
        + 2 * F.regexp_count(text, F.lit(_function_words(FUNCTION_WORDS)))
        + 4 * _deepest(text, opening, closing)
        + F.floor(line_count(text) / 20)
    )
    return F.least(F.lit(100), F.greatest(F.lit(5), score)).cast("int")


def complexity_of_file(text: Column) -> Column:
    return _complexity(text, CONTROL_WORDS, "{(", "})")


def complexity_of_code(text: Column) -> Column:
    # `pub fn`, `fn main` and `func ` count where `fn` and `func` do, so the function words stay.
    return _complexity(text, CONTROL_WORDS_CODE, "{([", "})]")


def complexity_of_diff(text: Column) -> Column:
    score = (
        F.lit(10)
        + 3 * F.regexp_count(text, F.lit(words(CONTROL_WORDS_DIFF)))
        + 2 * F.regexp_count(text, F.lit(_function_words(FUNCTION_WORDS_DIFF)))
    )
    return F.least(F.lit(100), score).cast("int")


def _modules(text: Column, regex: str, needs: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(to_java(regex)), 1)
    return F.when(text.contains(needs), found).otherwise(F.array().cast("array<string>"))


def _python_modules(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(to_java(IMPORT_PYTHON)), 0)
    second = F.transform(found, lambda m: F.split(m, f"{SPACE}+")[1])
    return F.when(text.contains("import"), second).otherwise(F.array().cast("array<string>"))


def imports_of_repo_file(text: Column) -> Column:
    """Distinct modules a file names, in order of pattern, then of place."""
    return F.array_distinct(
        F.concat(
            _modules(text, IMPORT_FROM, "import"),
            _modules(text, IMPORT_CALL, "import"),
            _modules(text, REQUIRE_CALL, "require"),
        )
    )


def imports_of_pr_file(text: Column) -> Column:
    return F.array_distinct(
        F.concat(
            _modules(text, IMPORT_FROM, "import"),
            _modules(text, IMPORT_CALL, "import"),
            _modules(text, REQUIRE_CALL, "require"),
            _python_modules(text),
        )
    )


def language_by_content(text: Column) -> Column:
    """Guess a language from the text; the first that fits wins."""

    def has(pattern: str) -> Column:
        return text.rlike(pattern)

    word_start = f"(?<!{WORD})"
    first_line = F.substring_index(text, "\n", 1)
    return (
        F.when(
            has(LINE_START + to_java(r"\s*(?:def|import|from|class)\s+\w+"))
            & ~has(to_java(r"function\s+\w+")),
            "python",
        )
        .when(has(word_start + to_java(r"(?:pub\s+fn|impl|struct|enum|use\s+\w+::)")), "rust")
        .when(
            has(word_start + to_java(r'(?:func|package|import\s+")')) & ~text.contains("function"), "go"
        )
        .when(
            has(word_start + to_java(r"(?:class|public|private|protected|void|int\s+main)"))
            & first_line.rlike(to_java(r";\s*") + r"\z"),
            "java",
        )
        .when(text.contains("<?php") | text.contains("<?="), "php")
        .when(has(to_java(r"#include\s+<")), "c")
        .otherwise("javascript")
    )
