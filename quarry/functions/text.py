"""Text and path functions as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as an identifier, and the two ways its parts are split.
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
PARTS = r"[A-Z]+(?![a-z])|[A-Z][a-z]+|[a-z]+"
HUMAN_PARTS = PARTS + r"|[0-9]+"
CAMEL = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
#: Words without retrieval signal, for queries and for path matching.
QUERY_STOP = (
    "how does do the where is are in to a an of and with it we for from on this that what when which "
    "work works done use used app"
).split()
PATH_STOP = (
    "a an and are as at be by do does for from has have how if in is it not of on or the to was what "
    "when where which who why with"
).split()


def _accents() -> tuple[str, str]:
    """Latin letters with a mark, and the letters without, by canonical decomposition."""
    pairs = []
    for p in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        d = unicodedata.normalize("NFD", chr(p))
        if len(d) > 1 and all(unicodedata.combining(c) for c in d[1:]):
            pairs.append((chr(p), d[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern without groups."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def folded(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def humanise(text: Column) -> Column:
    """`HTTPServer_v2` to `HTTP Server v 2`."""
    return F.array_join(matches(F.translate(text, "/.", "  "), HUMAN_PARTS), " ")


def path_name(path: Column) -> Column:
    """The last segment; trailing slashes do not count."""
    return F.element_at(F.split(F.regexp_replace(path, r"/+$", ""), "/"), -1)


def path_stem(path: Column) -> Column:
    """The name without its last extension; a name whose only dot leads it has none."""
    return F.regexp_replace(path_name(path), r"^(.+)\.[^.]+$", "$1")


def path_parent(path: Column) -> Column:
    """The name of the directory that holds the path; empty at the top."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.coalesce(F.get(parts, F.size(parts) - 2), F.lit(""))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def split_identifier(token: Column) -> Column:
    """The compound in lower case, then its parts if there are two or more."""
    low = F.lower(token)
    parts = F.when(token.contains("_"), F.filter(F.split(low, "_"), lambda s: s != "")).otherwise(F.transform(matches(token, CAMEL), F.lower))
    return F.when(F.size(parts) >= 2, F.concat(F.array(low), parts)).otherwise(F.array(low))


def query_terms(query: Column) -> Column:
    """Content words of a query, identifiers kept and split; repeats of whole identifiers stay.

    A part is left out if an earlier word is equal to it.
    """
    long = lambda w: (F.length(w) > 2) & ~w.isin(QUERY_STOP)
    each = F.transform(
        matches(query, IDENTIFIER),
        lambda raw: F.struct(F.filter(F.array(F.lower(raw)), long).alias("whole"), F.filter(F.transform(matches(raw, PARTS), F.lower), long).alias("parts")),
    )
    add = lambda acc, p: F.when(F.array_contains(acc, p), acc).otherwise(F.array_append(acc, p))
    return F.aggregate(each, F.array().cast("array<string>"), lambda acc, e: F.aggregate(e["parts"], F.concat(acc, e["whole"]), add))


def stem_keywords(query: Column) -> Column:
    """Distinct words over two letters that path matching looks for."""
    words = F.transform(F.filter(matches(query, IDENTIFIER), lambda w: F.length(w) > 2), F.lower)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(PATH_STOP)))


def stripped(text: Column) -> Column:
    """Without white space at either end, line ends and Unicode's included."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def is_symbol_query(query: Column) -> Column:
    """A qualified name, a leading underscore, or an upper-case letter or underscore inside."""
    return stripped(query).rlike(
        r"\A(?:[A-Za-z_][A-Za-z0-9_]*(?:(?:::|\\|->|\.)[A-Za-z_][A-Za-z0-9_]*)+"
        r"|_[A-Za-z0-9_]*|[A-Za-z][A-Za-z0-9]*[A-Z_][A-Za-z0-9_]*|[A-Z][A-Za-z0-9]*)\z"
    )


def is_prose(query: Column, least: int = 4) -> Column:
    return F.size(matches(query, IDENTIFIER)) >= least


def _compound_parts(word: Column) -> Column:
    """Parts of a compound identifier; none if it is a single part."""
    parts = matches(word, PARTS)
    return F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))


def split_inline(text: Column) -> Column:
    """Each compound identifier followed by its parts."""
    pieces = matches(text, IDENTIFIER + r"|[^A-Za-z_]+")
    return F.array_join(F.transform(pieces, lambda w: F.array_join(F.concat(F.array(w), _compound_parts(w)), " ")), "")


def split_appended(text: Column) -> Column:
    """The text, then the distinct parts over two letters of its compound identifiers."""
    parts = F.flatten(F.transform(matches(text, IDENTIFIER), lambda w: F.transform(_compound_parts(w), F.lower)))
    return F.concat(text, F.lit("\n"), F.array_join(F.array_distinct(F.filter(parts, lambda p: F.length(p) > 2)), " "))


def glob_regex(glob: str) -> str:
    """`*` crosses slashes, `?` is one character, `[set]` and `[^set]` are sets; the rest is itself."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2 + (glob[i + 1 : i + 2] == "^")) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            body = glob[i + 1 : close].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            out.append(f"[{body}]")
            i = close
        else:
            out.append("\\" + c if not c.isalnum() and c.isascii() else c)
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def glob_match(value: Column, glob: str) -> Column:
    return value.rlike(glob_regex(glob))
