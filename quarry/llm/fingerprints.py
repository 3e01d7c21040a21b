"""Bottom-k sketches of word shingles, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words of a shingle, and hashes that a sketch keeps.
SHINGLE = 5
KEEP = 256
#: Documents of one run of ids; runs beyond MOST_RUNS get longer instead.
RUN_ROWS = 512
MOST_RUNS = 100_000
#: Hashes have 48 bits.
_RANGE = float(1 << 48)


def with_sketch(df: DataFrame, text: str, out: str, size: int = SHINGLE, keep: int = KEEP) -> DataFrame:
    """`out`: the `keep` smallest hashes of the text's distinct `size`-word shingles, ascending.

    Words are runs without white space, in lower case.  A text of fewer words, but not none, is one
    shingle; a null text and one without words have an empty sketch.  Equal texts, and texts of the
    same words, have equal sketches.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[ \t-\r]+"), lambda w: w != "")
    df = df.withColumn("_w", F.transform(words, lambda w: F.xxhash64(w)))  # a column of its own: it is read in a lambda below
    many = F.transform(F.sequence(F.lit(0), F.size("_w") - size), lambda i: F.xxhash64(*[F.get(F.col("_w"), i + j) for j in range(size)]))
    few = F.when(F.size("_w") > 0, F.array(F.xxhash64("_w"))).otherwise(F.array().cast("array<bigint>"))
    hashes = F.transform(F.when(F.size("_w") >= size, many).otherwise(few), lambda x: F.shiftrightunsigned(x, 16))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(hashes)), 1, keep)).drop("_w")


def printed(sketch: Column) -> Column:
    """A sketch as base64 of its big-endian 6-byte hashes."""
    return F.base64(F.unhex(F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 12, "0")), "")))


def parsed(text: Column) -> Column:
    digits = F.hex(F.unbase64(text))
    return F.transform(F.filter(F.sequence(F.lit(0), F.length(digits), F.lit(12)), lambda i: i < F.length(digits)), lambda i: F.conv(F.substr(digits, i + 1, F.lit(12)), 16, 10).cast("bigint"))


def merged(a: Column, b: Column, keep: int = KEEP) -> Column:
    """The sketch of two parts taken together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, keep)


def resemblance(a: Column, b: Column, keep: int = KEEP) -> Column:
    """Estimated |A & B| / |A | B|: the share of the union's sketch that both hold.

    Exact while the union has at most `keep` shingles.  1 for two empty sketches, 0 for one.
    """
    both = merged(a, b, keep)
    return F.when(F.size(both) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both))


def distinct_count(sketch: Column, keep: int = KEEP) -> Column:
    """Estimated number of distinct shingles; exact for a sketch that is not full."""
    return F.when(F.size(sketch) < keep, F.size(sketch).cast("double")).otherwise((keep - 1) * _RANGE / (F.element_at(sketch, -1) + 1))


def containment(a: Column, b: Column, keep: int = KEEP) -> Column:
    """Estimated share of A's shingles that B has, from the resemblance and the counts; 1 for an empty A."""
    r, na, nb = resemblance(a, b, keep), distinct_count(a, keep), distinct_count(b, keep)
    return F.when(na == 0, 1.0).otherwise(F.least(F.lit(1.0), r * (na + nb) / ((1 + r) * na)))


def merge_parts(df: DataFrame, by: list[str], sketch: str = "sketch", keep: int = KEEP) -> DataFrame:
    """One sketch for each group of parts.  Each task keeps `keep` hashes of a group before the shuffle."""
    rows = df.select(*by, F.explode(sketch).alias("_x")).distinct()
    w = Window.partitionBy(*by).orderBy("_x")
    kept = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep)
    return kept.groupBy(*by).agg(F.sort_array(F.collect_list("_x")).alias(sketch))


def with_next(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, Window]:
    """Rows laid out so that a lead over the returned window sees the next document by descending id.

    Ids are cut into runs at their quantiles, so that hashed or skewed ids fill all runs alike; each
    run also gets a copy of the row that follows it (`_guest`), so that one shuffle by run serves
    every lead.  After the last row comes the first.  Rows of one id are ordered by text and stay in
    one run; null ids come last.
    """
    n = docs.count()
    runs = max(1, min(MOST_RUNS, n // RUN_ROWS))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("_id"))
    numbers = lambda xs, kind: F.split(F.lit(",".join(map(str, xs))), ",").cast(f"array<{kind}>")  # noqa: E731  # one literal, however long
    cuts = [k / runs for k in range(1, runs)]
    # Where the cuts lie does not matter for the result: approximate quantiles, MOST_RUNS numbers at most.
    edges = ids.agg(F.percentile_approx("_id", numbers(cuts, "double"), 10 * runs).alias("e")).first().e if cuts else None
    edges = sorted(set(edges or []))
    # Runs from 1 by ascending id; 0 for null ids, which come last by descending id.
    bounds = numbers(edges, "bigint") if edges else F.array().cast("array<bigint>")
    rows = docs.select(*columns, F.col("doc_id").cast("bigint").alias("_id")).withColumn("_run", _place(bounds, len(edges)))
    # At most MOST_RUNS + 1 rows: the first id of every run and the run before it.
    tops = rows.groupBy("_run").agg(F.max("_id").alias("_top"))
    tops = tops.select("_run", "_top", F.coalesce(F.lead("_run").over(Window.orderBy("_run")), F.min("_run").over(Window.partitionBy())).alias("_up"))
    own = F.struct(F.col("_run").alias("run"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("_up").alias("run"), F.lit(True).alias("guest"))
    rows = rows.join(F.broadcast(tops), "_run").withColumn("_at", F.explode(F.when(F.col("_id").eqNullSafe(F.col("_top")), F.array(own, guest)).otherwise(F.array(own))))
    rows = rows.select(*columns, "_id", F.col("_at.run").alias("_run"), F.col("_at.guest").alias("_guest"))
    return rows, Window.partitionBy("_run").orderBy("_guest", F.desc_nulls_last("_id"), "text")


def _place(edges: Column, n: int) -> Column:
    """1 + the number of edges below `_id`, 0 for a null one, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, n.bit_length())))])
    further = lambda at, step: (at + step <= n) & (F.get(edges, at + step - 1) < F.col("_id"))
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))
    return F.when(F.col("_id").isNull(), 0).otherwise(below + 1)


def fingerprints(docs: DataFrame, size: int = SHINGLE, keep: int = KEEP) -> DataFrame:
    """Every text's sketch beside that of its edited text and of the next document.

    The edited text: the last floor(n_chars / 2) code points are replaced by the first as many (or
    all) of the next document by descending doc_id.  A null text counts as empty.  A repeated id
    stays as separate rows, ordered by text; a lone document is its own next one.
    """
    rows, w = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["doc_id", "text"])
    rows = with_sketch(rows.withColumn("_next", F.lead("text").over(w)), "text", "sketch", size, keep)
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(w)).where(~F.col("_guest"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("bigint")).withColumn("edited", F.concat(F.substr("text", F.lit(1), n - half), F.substr("_next", F.lit(1), half)))
    return with_sketch(rows, "edited", "edited_sketch", size, keep).select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_chars", "edited", "sketch", "edited_sketch", "next_sketch")


def digest(docs: DataFrame) -> DataFrame:
    """The contract columns of `fingerprints` with production parameters."""
    s, e, x = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return fingerprints(docs).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(s).alias("fingerprint"), printed(e).alias("edited_fingerprint"),
        resemblance(s, e).alias("near_edited"), resemblance(s, x).alias("near_next"),
        distinct_count(s).alias("est_shingles"), containment(s, e).alias("contained_in_edited"),
    )
