"""Take unified diffs apart.  A diff is one row, so nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.binding import let
from reviewloom.functions.dialect import LINE_START, to_java
from reviewloom.functions.lookup import language
from reviewloom.functions.text import complexity_of_diff

# Headers of file blocks and hunks.
FILE_MARK = "diff --git "
FILE_HEADER = r"a/(.+?)\s+b/(.+)"
HUNK_HEADER = r"@@\s+-([\d,]+)\s+\+([\d,]+)\s+@@(.*)"
_HEADER, _HUNK = to_java(FILE_HEADER), to_java(HUNK_HEADER)


def blocks_of(diff: Column) -> Column:
    """File blocks of a diff that have a header, in order."""
    pieces = F.split(diff, LINE_START + FILE_MARK, -1)
    return F.filter(pieces, lambda b: b.rlike(_HEADER))


def path_of(block: Column) -> Column:
    """Path a file block changes; the new one when the file was renamed."""
    return F.regexp_extract(block, _HEADER, 2)


def file_blocks(diffs: DataFrame, diff: str = "diff") -> DataFrame:
    """One row per file block: (analysis_id, file_ord, path, block)."""
    exploded = diffs.select(
        "analysis_id", F.posexplode(blocks_of(F.col(diff))).alias("file_ord", "block")
    )
    return exploded.select("analysis_id", "file_ord", path_of(F.col("block")).alias("path"), "block")


def _number(text: Column, index: int) -> Column:
    """Number in a comma-separated range: 0 when empty, null when there is no such part."""
    part = F.get(F.split(text, ",", -1), F.lit(index))
    return F.when(part == "", F.lit(0)).otherwise(part.try_cast("bigint"))


def hunks_array(block: Column) -> Column:
    """Hunks of a block; a body ends before the next line that starts with ``@@``."""
    found = F.arrays_zip(
        F.regexp_extract_all(block, F.lit(_HUNK), 0).alias("head"),
        # Behind each header up to the next one; there is one piece more, before the first.
        F.slice(F.split(block, _HUNK, -1), 2, 1 << 30).alias("body"),
    )
    return let(found, _hunks)


def _hunks(found: Column) -> Column:
    def to_the_end(i: Column) -> Column:
        # Rare: the next header is inside a line, so the body runs on through it.
        later = F.transform(
            F.slice(found, i + 2, F.size(found)), lambda f: F.concat(f["head"], f["body"])
        )
        tail = F.array_join(later, "")
        return F.substring_index(F.concat(F.get(found, i)["body"], tail), "\n@@", 1)

    def hunk(one: Column, i: Column) -> Column:
        head, body = one["head"], one["body"]
        is_last = i == F.size(found) - 1
        content = (
            F.when(body.contains("\n@@"), F.substring_index(body, "\n@@", 1))
            .when(is_last, body)
            .when(body.endswith("\n"), F.substring(body, F.lit(1), F.length(body) - 1))
            .otherwise(to_the_end(i))
        )
        old, new = F.regexp_extract(head, _HUNK, 1), F.regexp_extract(head, _HUNK, 2)
        return F.struct(
            i.cast("int").alias("hunk_ord"),
            _number(old, 0).alias("old_start"),
            _number(old, 1).alias("old_lines"),
            _number(new, 0).alias("new_start"),
            _number(new, 1).alias("new_lines"),
            content.alias("content"),
        )

    return F.transform(found, hunk)


def diff_hunks(blocks: DataFrame) -> DataFrame:
    return blocks.select(
        "analysis_id", "file_ord", "path", F.inline(hunks_array(F.col("block")))
    )


def status_of(additions: Column, deletions: Column) -> Column:
    return (
        F.when((additions > 0) & (deletions == 0), "added")
        .when((additions == 0) & (deletions > 0), "deleted")
        .otherwise("modified")
    )


def diff_files(blocks: DataFrame) -> DataFrame:
    """One row per file of a diff with its changed lines, and ``code``, its hunk bodies."""
    block = F.col("block")
    additions = F.regexp_count(block, F.lit(LINE_START + r"\+[^+]")).cast("int")
    deletions = F.regexp_count(block, F.lit(LINE_START + r"-[^-]")).cast("int")
    code = F.array_join(F.transform(hunks_array(block), lambda h: h["content"]), "\n")
    counted = blocks.select(
        "analysis_id",
        "file_ord",
        "path",
        additions.alias("additions"),
        deletions.alias("deletions"),
        code.alias("code"),
    )
    return counted.select(
        "analysis_id",
        "file_ord",
        "path",
        status_of(F.col("additions"), F.col("deletions")).alias("status"),
        "additions",
        "deletions",
        language(F.col("path")).alias("language"),
        complexity_of_diff(F.col("code")).alias("complexity"),
        "code",
    )
