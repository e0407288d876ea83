"""Readers for landed snapshots: submissions, pull requests, trees and file contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.binding import let
from reviewloom.session import listed_in_lots, qualified

SUBMISSION_SCHEMA = (
    "analysis_id string, url string, diff string, code string, filename string, "
    "received_at timestamp"
)
PR_HEADER_SCHEMA = (
    "title string, body string, state string, user struct<login:string>, head struct<sha:string>, "
    "base struct<ref:string>, created_at timestamp, updated_at timestamp, changed_files int, "
    "additions int, deletions int"
)
PR_FILE = (
    "struct<filename:string,status:string,additions:int,deletions:int,changes:int,patch:string>"
)
REPO_INFO_SCHEMA = (
    "name string, full_name string, description string, default_branch string, language string, "
    "stargazers_count bigint, forks_count bigint, open_issues_count bigint, "
    "topics array<string>, created_at timestamp, updated_at timestamp, pushed_at timestamp, "
    "size bigint, license struct<spdx_id:string>"
)
TREE_ITEM = "struct<path:string,mode:string,type:string,size:bigint,sha:string>"
PAGE_ROWS = 100

# A zero byte among the first ones makes a file a binary one.
LOOKED_AT = 8000
# Well-formed UTF-16 in hexadecimal digits, by its byte order; possessive, so that long files need no stack.
UTF_16 = {
    "UTF-16LE": "^(?:..(?:[0-9A-CEF].|D[0-7])|..D[89AB]..D[C-F])*+$",
    "UTF-16BE": "^(?:(?:[0-9A-CEF].|D[0-7])..|D[89AB]..D[C-F]..)*+$",
}


def submissions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(SUBMISSION_SCHEMA).format(fmt).load(path)


def submission_stream(
    spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 1000
) -> DataFrame:
    """Submissions as they land; the file limit bounds each micro-batch."""
    return (
        spark.readStream.schema(SUBMISSION_SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger)
        .format(fmt)
        .load(path)
    )


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw landed pages, one JSON line each: (analysis_id, page, body)."""
    return spark.read.schema("analysis_id string, page int, body string").json(path)


# What a body of each kind is read as; a list is wrapped in an object, so that a broken item shows.
BODIES = {
    "pr_files": f"items array<{PR_FILE}>",
    "pr_header": PR_HEADER_SCHEMA,
    "repo_info": REPO_INFO_SCHEMA,
    "tree": f"sha string, truncated boolean, tree array<{TREE_ITEM}>",
    "languages": "items map<string,bigint>",
}


def with_fault(raw: DataFrame, kind: str) -> DataFrame:
    """Raw rows with ``fault``: why their body gives no rows or not all of them, null for a good one.

    ``empty``: null or blank.  ``not json``: cut off or something else.  ``other shape``: JSON without what its kind must
    have, such as an error message, or with a value of another type.  ``truncated``: a tree that the host cut short.
    """
    body, schema = F.col("body"), BODIES[kind]
    wrapped = F.concat(F.lit('{"items":'), body, F.lit("}")) if schema.startswith("items ") else body
    read = F.from_json(wrapped, f"{schema}, unread string", {"columnNameOfCorruptRecord": "unread"})
    needed = {
        "pr_files": lambda r: F.forall(r["items"], lambda f: f["filename"].isNotNull()),
        "pr_header": lambda r: r["title"].isNotNull(),
        "repo_info": lambda r: r["full_name"].isNotNull(),
        "tree": lambda r: F.forall(r["tree"], lambda i: i["path"].isNotNull()),
        "languages": lambda r: F.forall(F.map_values(r["items"]), lambda n: n.isNotNull()),
    }[kind]
    cut = (lambda r: F.coalesce(r["truncated"], F.lit(False))) if kind == "tree" else (lambda r: F.lit(False))
    fault = let(
        read,
        lambda r: F.when(F.coalesce(body, F.lit("")).rlike(r"^\s*$"), "empty")
        .when(F.try_parse_json(body).isNull(), "not json")
        .when(r["unread"].isNotNull() | ~F.coalesce(needed(r), F.lit(False)), "other shape")
        .when(cut(r), "truncated"),
    )
    return raw.withColumn("fault", fault)


def sound(raw: DataFrame, kind: str) -> DataFrame:
    """Raw rows whose body can be read whole, and trees as far as the host gave them."""
    return with_fault(raw, kind).filter(F.col("fault").isNull() | (F.col("fault") == "truncated")).drop("fault")


def rejects(raw: DataFrame, kind: str) -> DataFrame:
    """The other raw rows, body and all, with their fault."""
    return with_fault(raw, kind).filter(F.col("fault") != "truncated")


def page_faults(raw_pages: DataFrame) -> DataFrame:
    """What keeps file lists from being whole: (analysis_id, page, fault), one row per fault.

    Beside the faults of bodies: ``repeated``, a page landed more than once; ``short``, a good page that isn't full and isn't
    the last; ``missing before``, a page whose predecessor never landed.  A list that lacks its last pages does not show
    here; its header's count of files does.  Pages meet their predecessors by key, so a long list is spread over tasks.
    """
    items = F.when(F.col("fault").isNull(), F.json_array_length("body"))
    read = with_fault(raw_pages, "pr_files").select("analysis_id", "page", "fault", items.alias("n"))
    pages = read.groupBy("analysis_id", "page").agg(
        F.count(F.lit(1)).alias("landed"), F.min("n").alias("n"), F.collect_set("fault").alias("faults")
    )
    last = pages.groupBy("analysis_id").agg(F.max("page").alias("last"))
    before = pages.select("analysis_id", (F.col("page") + 1).alias("page"), F.lit(True).alias("follows"))
    placed = pages.join(last, "analysis_id").join(before, ["analysis_id", "page"], "left")
    found = [
        F.when(F.col("landed") > 1, "repeated"),
        F.when((F.col("n") < PAGE_ROWS) & (F.col("page") < F.col("last")), "short"),
        F.when((F.col("page") > 1) & F.col("follows").isNull(), "missing before"),
    ]
    every = F.concat("faults", F.array_compact(F.array(*found)))
    return placed.select("analysis_id", "page", F.explode(every).alias("fault"))


def pr_files(raw_pages: DataFrame) -> DataFrame:
    """Files of pull requests from their pages, in (page, place) order.

    Every page but the last is full, so a file's ordinal follows from its page and place.  A body that isn't
    a list of files gives none; ``rejects`` and ``page_faults`` tell of it.
    """
    files = F.from_json("body", f"array<{PR_FILE}>")
    items = raw_pages.select("analysis_id", "page", F.posexplode(files).alias("pos", "f"))
    return items.filter("f.filename IS NOT NULL").select(
        "analysis_id",
        ((F.col("page") - 1) * PAGE_ROWS + F.col("pos")).cast("int").alias("file_ord"),
        F.col("f.filename").alias("path"),
        "f.status",
        "f.additions",
        "f.deletions",
        "f.changes",
        "f.patch",
    )


def pr_headers(raw: DataFrame) -> DataFrame:
    """Headers from (analysis_id, body) JSON rows."""
    parsed = raw.select("analysis_id", F.from_json("body", PR_HEADER_SCHEMA).alias("pr"))
    return parsed.select("analysis_id", "pr.*")


def repo_info(raw: DataFrame) -> DataFrame:
    parsed = raw.select("analysis_id", F.from_json("body", REPO_INFO_SCHEMA).alias("r"))
    return parsed.select("analysis_id", "r.*")


def tree(raw: DataFrame) -> DataFrame:
    """Tree items from (analysis_id, body) JSON rows, blobs and folders alike."""
    items = F.from_json("body", f"tree array<{TREE_ITEM}>")["tree"]
    return raw.select("analysis_id", F.posexplode(items).alias("file_ord", "item")).select("analysis_id", F.col("file_ord").cast("bigint").alias("file_ord"), "item.path", "item.type", "item.size")


def repo_languages(raw: DataFrame) -> DataFrame:
    """Bytes per language from (analysis_id, body) rows with a JSON object each."""
    parsed = raw.select("analysis_id", F.from_json("body", "map<string,bigint>").alias("bytes"))
    return exploded_languages(parsed)


def exploded_languages(maps: DataFrame) -> DataFrame:
    """(analysis_id, bytes map) -> one row per language, in the order of the map."""
    return maps.select(
        "analysis_id", F.posexplode("bytes").alias("lang_ord", "language", "bytes")
    )


def decoded(content: Column, encoding: Column) -> Column:
    """Text of base64 contents; null when empty or encoded otherwise.

    Line breaks and foreign characters are skipped, both alphabets are read, padding may
    be missing, and bytes that are no UTF-8 become replacement characters.
    """
    plain = F.translate(F.regexp_replace(content, "[^A-Za-z0-9+/_-]", ""), "-_", "+/")

    def padded(p: Column) -> Column:
        usable = F.length(p) - F.when(F.length(p) % 4 == 1, 1).otherwise(0)
        missing = F.pmod(-usable, F.lit(4)).cast("int")
        return F.concat(F.substring(p, F.lit(1), usable), F.repeat(F.lit("="), missing))

    # Well-formed contents are decoded as they are; only the others are cleaned first.
    strict = F.try_to_binary(content, F.lit("base64"))
    binary = F.coalesce(strict, F.unbase64(let(plain, padded)))
    text = F.make_valid_utf8(binary.cast("string"))
    return F.when((encoding == "base64") & (content != ""), text)


def file_contents(raw: DataFrame) -> DataFrame:
    """Readable files from (analysis_id, path, content, encoding, ...) rows."""
    keys = [c for c in raw.columns if c not in ("content", "encoding")]
    coded = raw.filter(F.col("encoding") == "base64")
    text = decoded(F.col("content"), F.col("encoding"))
    # A generator, so that the test of the text does not decode it once more.
    kept = F.filter(F.array(text), lambda t: t != "")
    return coded.select(*keys, F.explode(kept).alias("content"))


def checkout(spark: SparkSession, path: str) -> DataFrame:
    """Source files of a checked-out folder tree, one row each, as text."""
    with listed_in_lots(spark):
        files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def encoding_of(raw: Column) -> Column:
    """The encoding that bytes are text in, null for binary ones.

    A mark at the start decides, if what follows it is well-formed; else a zero byte tells a binary file, and the rest is
    UTF-8 where it is valid and ISO-8859-1 where it is not, which has a character for every byte.
    """
    found = F.when((F.substring(raw, 1, 3) == F.lit(b"\xef\xbb\xbf")) & F.is_valid_utf8(raw.cast("string")), "UTF-8")
    for name, mark in (("UTF-16LE", b"\xff\xfe"), ("UTF-16BE", b"\xfe\xff")):
        found = found.when((F.substring(raw, 1, 2) == F.lit(mark)) & F.hex(raw).rlike(UTF_16[name]), name)
    head = F.hex(F.substring(raw, 1, LOOKED_AT))
    return found.when(~head.rlike("^(?:0[1-9A-F]|[1-9A-F].)*+$"), F.lit(None)).when(
        F.is_valid_utf8(raw.cast("string")), "UTF-8"
    ).otherwise("ISO-8859-1")


def text_of(raw: Column, encoding: Column) -> Column:
    """Bytes as text in their encoding (``encoding_of``), without the mark at their start."""
    marked = F.substring(raw, 1, 3) == F.lit(b"\xef\xbb\xbf")
    rest = F.substring(raw, F.lit(4), F.octet_length(raw))
    wide = F.substring(raw, F.lit(3), F.octet_length(raw))
    text = F.when(encoding == "UTF-8", F.when(marked, rest).otherwise(raw).cast("string"))
    for name in UTF_16:
        text = text.when(encoding == name, F.decode(wide, name))
    return text.when(encoding == "ISO-8859-1", F.decode(raw, "ISO-8859-1"))


def checkout_files(spark: SparkSession, path: str, glob: str = "*", max_bytes: int = 500_000) -> DataFrame:
    """Files of a checked-out folder tree by their bytes: (path, size, kind, encoding, content), one row each.

    ``path`` is the place below the folder.  ``kind`` is ``text``, ``binary`` or ``too large``; only the first has an encoding
    and content.  Files above ``max_bytes`` are listed and not opened: their rows come from a scan without contents.
    Empty files have no row, as Spark's file sources pass them over.
    """
    with listed_in_lots(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    place = F.expr(f"substring(path, {len(qualified(spark, path)) + 2})").alias("path")
    size = F.col("length").alias("size")
    opened = files.filter(F.col("length") <= max_bytes).select(place, size, F.col("content").alias("raw"))
    read = opened.withColumn("encoding", encoding_of(F.col("raw")))
    known = read.select(
        "path",
        "size",
        F.when(F.col("encoding").isNull(), "binary").otherwise("text").alias("kind"),
        "encoding",
        text_of(F.col("raw"), F.col("encoding")).alias("content"),
    )
    no_text = F.lit(None).cast("string")
    large = files.filter(F.col("length") > max_bytes).select(
        place, size, F.lit("too large").alias("kind"), no_text.alias("encoding"), no_text.alias("content")
    )
    return known.unionByName(large)
