"""Language, category and penalty of a path."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.languages import LANGUAGES
from quarry.functions.text import path_name

#: The languages of each category and the words of a test's name, the defaults that settings change.
DOCS = ("markdown", "markdown_inline", "html", "rst", "asciidoc", "latex")
CONFIG = (
    "toml", "yaml", "json", "ini", "xml", "dockerfile", "make", "cmake", "hcl", "terraform", "properties",
    "editorconfig", "gitignore", "gitattributes", "gomod", "gosum", "requirements", "pymanifest",
)
DATA = ("csv", "tsv", "psv")
MARKERS = ("test", "spec")
CATEGORIES = ("code", "tests", "docs", "config", "data")
#: Paths that rank lower, and by how much.
TEST_FILE = (
    r"(?:^|/)(?:test_[^/]*\.py|[^/]*_test\.py|[^/]*_test\.go|[^/]*Tests?\.java|[^/]*Test\.php|[^/]*_spec\.rb|[^/]*_test\.rb"
    r"|[^/]*\.test\.[jt]sx?|[^/]*\.spec\.[jt]sx?|[^/]*Tests?\.kt|[^/]*Spec\.kt|[^/]*Tests?\.swift|[^/]*Spec\.swift"
    r"|[^/]*Tests?\.cs|test_[^/]*\.cpp|[^/]*_test\.cpp|test_[^/]*\.c|[^/]*_test\.c|[^/]*Spec\.scala|[^/]*Suite\.scala"
    r"|[^/]*Test\.scala|[^/]*_test\.dart|test_[^/]*\.dart|[^/]*_spec\.lua|[^/]*_test\.lua|test_[^/]*\.lua|test_helpers?[^/]*\.\w+)$"
)
TEST_DIR = r"(?:^|/)(?:tests?|__tests__|spec|testing)(?:/|$)"
COMPAT_DIR = r"(?:^|/)(?:compat|_compat|legacy)(?:/|$)"
EXAMPLE_DIR = r"(?:^|/)(?:_?examples?|docs?_src)(?:/|$)"
TYPE_FILE = r"\.d\.ts$"


@dataclass(frozen=True)
class Categories:
    """Which languages make up a category, and the words that mark a test."""

    docs: tuple[str, ...] = DOCS
    config: tuple[str, ...] = CONFIG
    data: tuple[str, ...] = DATA
    markers: tuple[str, ...] = MARKERS


def language_table(spark: SparkSession, listing: dict[str, str]) -> DataFrame:
    """(file_key, lang): a row for each key of the listing, some 200, so joins broadcast it."""
    return spark.createDataFrame(list(listing.items()), "file_key string, lang string")


def with_language(files: DataFrame, listing: dict[str, str] = LANGUAGES) -> DataFrame:
    """`lang` by the whole name, else by the last extension; null if unknown.

    Leading dots do not start an extension.
    """
    table = language_table(files.sparkSession, listing)
    name = path_name(F.col("path"))
    ext = F.regexp_extract(F.regexp_replace(name, r"^\.+", ""), r"(\.[^.]+)$", 1)
    by = lambda key: F.broadcast(table.select(F.col("file_key").alias(f"_{key}"), F.col("lang").alias(f"_{key}_lang")))
    out = files.withColumn("_n", name).withColumn("_e", ext)
    out = out.join(by("name"), F.col("_n") == F.col("_name"), "left").join(by("ext"), F.col("_e") == F.col("_ext"), "left")
    return out.withColumn("lang", F.coalesce("_name_lang", "_ext_lang")).select(*[c for c in files.columns if c != "lang"], "lang")


def is_test(path: Column, markers: tuple[str, ...] = MARKERS) -> Column:
    """A test directory, a delimited part of a name, or camel case before the extension."""
    # How a name is marked.
    if not markers:
        return F.lit(False)
    one = "|".join(map(re.escape, markers))
    loose = rf"(?i)(?:^|/)__?(?:{one})s?__?(?:/|$)|(?:^|/)(?:{one})(?:s|ing)?(?:/|$)|(?:^|/|[_.\-])(?:{one})s?[_.\-]|[_.\-](?:{one})s?\.[A-Za-z0-9]+$"
    camel = rf"[a-z0-9](?:{'|'.join(re.escape(m.title()) for m in markers)})s?\.[A-Za-z0-9]+$"
    return path.rlike(loose) | path.rlike(camel)


def content_type(lang: Column, path: Column, by: Categories = Categories()) -> Column:
    low = F.lower(lang)
    among = lambda langs: F.coalesce(low.isin([x.lower() for x in langs]), F.lit(False))
    return F.when(among(by.docs), "docs").when(among(by.config), "config").when(among(by.data), "data").when(is_test(path, by.markers), "tests").otherwise("code")


def content_scope(wanted: list[str], excluded: tuple[str, ...] = ("data",)) -> list[str]:
    """None wanted: all but the excluded, in order.  `all` adds all but data.  Unknown ones are errors."""
    if not wanted:
        return [c for c in CATEGORIES if c not in excluded]
    if bad := sorted(set(wanted) - {*CATEGORIES, "all"}):
        raise ValueError(f"unknown content: {', '.join(bad)}")
    return sorted({c for w in wanted for c in ([x for x in CATEGORIES if x != "data"] if w == "all" else [w])})


def path_penalty(path: Column) -> Column:
    """A factor in (0, 1]; the kinds multiply."""
    norm = F.replace(path, F.lit("\\"), F.lit("/"))
    times = lambda cond, x: F.when(cond, x).otherwise(1.0)
    return (
        times(norm.rlike(TEST_FILE) | norm.rlike(TEST_DIR), 0.3)
        * times(path_name(path).isin("__init__.py", "package-info.java"), 0.5)
        * times(norm.rlike(COMPAT_DIR), 0.3)
        * times(norm.rlike(EXAMPLE_DIR), 0.3)
        * times(norm.rlike(TYPE_FILE), 0.7)
    )


def indexable(files: DataFrame, max_bytes: int = 1_000_000, excluded: tuple[str, ...] = ("data",), by: Categories = Categories()) -> DataFrame:
    """Known languages but keys, small enough, one path per real path, not of an excluded category."""
    known = with_language(files).where("lang is not null and lang <> 'pem'").where(F.col("size") <= max_bytes)
    first = known.groupBy("real_path").agg(F.min("path").alias("path"))
    known = known.join(first.select("path"), "path", "left_semi")
    return known.withColumn("content_type", content_type(F.col("lang"), F.col("path"), by)).where(~F.col("content_type").isin(list(excluded)))


def looks_generated(text: Column) -> Column:
    """Of the first 65,536 bytes, last line aside: under three lines, or a median line over 1,000 bytes.

    Files under 16,384 bytes never do.
    """
    head = F.substring(text.cast("binary"), 1, 65_536).cast("string")
    lines = F.split(head, "\n")
    sizes = F.sort_array(F.transform(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), F.octet_length))
    return (F.octet_length(text) >= 16_384) & ((F.size(sizes) < 3) | (F.coalesce(F.get(sizes, (F.size(sizes) / 2).cast("int")), F.lit(0)) > 1000))
