"""Chunk tables: line windows, definition chunks, coverage, lexical and embedding text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.text import content_hash, humanise, matches, path_stem, split_appended, split_inline, stripped

#: Lines above a definition that are looked at for comments.
LOOK_BACK = 6
WINDOW_BYTES, MOST_BYTES, LEAST_CHARS, MOST_CHARS, MOST_LINES = 750, 20_000, 60, 20_000, 200


def line_windows(files: DataFrame, target: int = WINDOW_BYTES) -> DataFrame:
    """(file_id, path, start_line, end_line, text): whole lines, grouped until `target` bytes."""
    lines = F.split(F.col("text"), "\n")
    start = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("done"), F.lit(1).alias("a"), F.lit(0).alias("i"), F.lit(0).alias("size"))

    def step(s: Column, line: Column) -> Column:
        i, size = s["i"] + 1, s["size"] + F.octet_length(line) + 1
        full = size >= target
        return F.struct(
            F.when(full, F.array_append(s["done"], F.struct(s["a"].alias("a"), i.alias("b")))).otherwise(s["done"]).alias("done"),
            F.when(full, i + 1).otherwise(s["a"]).alias("a"), i.alias("i"), F.when(full, 0).otherwise(size).alias("size"),
        )

    end = lambda s: F.when(s["size"] > 0, F.array_append(s["done"], F.struct(s["a"].alias("a"), s["i"].alias("b")))).otherwise(s["done"])
    w = files.withColumn("_lines", lines).withColumn("_w", F.explode(F.aggregate(F.col("_lines"), start, step, end)))
    text = F.array_join(F.slice("_lines", F.col("_w.a"), F.col("_w.b") - F.col("_w.a") + 1), "\n")
    return w.select("file_id", "path", F.col("_w.a").alias("start_line"), F.col("_w.b").alias("end_line"), text.alias("text"))


def bounded(windows: DataFrame) -> DataFrame:
    """Windows cut at 20,000 bytes without half characters, those under 60 stripped characters left out."""
    cut = F.regexp_replace(F.substring(F.col("text").cast("binary"), 1, MOST_BYTES).cast("string"), "�+$", "")
    text = F.when(F.octet_length("text") > MOST_BYTES, cut).otherwise(F.col("text"))
    return windows.withColumn("text", text).where(F.char_length(stripped(F.col("text"))) >= LEAST_CHARS)


def definition_chunks(defs: DataFrame, files: DataFrame, most_lines: int = MOST_LINES) -> DataFrame:
    """A chunk for each definition: its first `most_lines` lines, if 60 to 20,000 characters."""
    last = F.least(F.col("end_line"), F.col("start_line") + most_lines - 1)
    lines = F.split("text", "\n")
    text = F.array_join(F.slice(lines, F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    out = defs.withColumn("end_line", last).join(files.select("file_id", "path", "text"), "file_id")
    out = out.withColumn("comments", leading_comments(lines, F.col("start_line"))).withColumn("text", text)
    return out.where(F.char_length("text").between(LEAST_CHARS, MOST_CHARS)).select("file_id", "path", "symbol_id", "start_line", "end_line", "text", "comments")


def leading_comments(lines: Column, start_line: Column) -> Column:
    """The comment lines among the six above a definition, without their markers, joined by a space."""
    first = F.greatest(start_line - LOOK_BACK, F.lit(1))
    above = F.transform(F.slice(lines, first, start_line - first), stripped)
    held = F.filter(above, lambda x: x.rlike(r"\A(?:#|//|\*|/\*|;|--)"))
    return F.array_join(F.transform(held, lambda x: stripped(F.regexp_replace(x, r"\A[/*#; -]+", ""))), " ")


def uncovered(windows: DataFrame, defs: DataFrame) -> DataFrame:
    """Windows of which at least half of the lines lie in no definition."""
    d = defs.select("file_id", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct().withColumn("covered", F.lit(1))
    w = windows.select("file_id", "start_line", "end_line", F.explode(F.sequence("start_line", "end_line")).alias("line"))
    share = w.join(d, ["file_id", "line"], "left").groupBy("file_id", "start_line", "end_line").agg(F.count("*").alias("n"), F.count("covered").alias("c"))
    return windows.join(share.where("(n - c) * 2 >= n"), ["file_id", "start_line", "end_line"], "left_semi")


def claimed_once(chunks: DataFrame) -> DataFrame:
    """Of chunks that claim one symbol one stays, the first in position, then by its other columns; windows all stay."""
    nth = F.row_number().over(Window.partitionBy("symbol_id").orderBy("position", *chunks.columns))
    claimed = chunks.where("symbol_id is not null").withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    return chunks.where("symbol_id is null").unionByName(claimed)


def lexical_text(path: Column, body: Column, mode: str = "full", cap: int = 2000, enrich: bool = False, split: str = "off") -> Column:
    """What the keyword index holds of a chunk: path words or path parts around the body, reshaped."""
    body = F.substring(body, 1, cap) if mode == "capped" else body
    if enrich:
        stem, dirs = path_stem(path), F.filter(F.split(path, "/"), lambda s: s != "")
        last = F.slice(dirs, F.greatest(F.size(dirs) - 3, F.lit(1)), F.greatest(F.least(F.size(dirs) - 1, F.lit(3)), F.lit(0)))
        text = F.concat_ws(" ", body, stem, stem, F.array_join(last, " "))
    else:
        text = F.concat(humanise(path), F.lit("\n"), body)
    return split_inline(text) if split == "inline" else split_appended(text) if split == "append" else text


def embed_text(path: Column, body: Column, kind: Column | None = None, comments: Column | None = None) -> Column:
    """Distilled text of a documentation chunk: path words, kind of definition, leading comments, 25 distinct identifiers."""
    names = F.array_distinct(F.filter(F.transform(matches(body, r"[A-Za-z_][A-Za-z0-9_]*"), humanise), lambda w: w != ""))
    parts = (humanise(path), kind, comments, F.array_join(F.slice(names, 1, 25), " "))
    return F.concat_ws(" :: ", *[F.when(p != "", p) for p in parts if p is not None])


def with_hash(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("content_hash", content_hash(F.col("text")))
