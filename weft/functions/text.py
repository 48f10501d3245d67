"""String functions on traces: tags, answers, labels, tokens, corruptions.  All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def first_tag(c: Column, tag: str) -> Column:
    """Stripped text of the first ``<tag>...</tag>``, null if there is none."""
    start = F.locate(f"<{tag}>", c)
    rest = F.substring(c, start + len(tag) + 2, F.length(c))
    end = F.locate(f"</{tag}>", rest)
    return F.when((start > 0) & (end > 0), strip(F.substring(rest, F.lit(1), end - 1)))


def regex_tag(c: Column, tag: str) -> Column:
    """As ``first_tag``, but an empty string if there is none."""
    return strip(F.regexp_extract(c, f"(?s)<{tag}>(.*?)</{tag}>", 1))


def last_answer(c: Column) -> Column:
    """struct(answer, ended, error): the last complete answer block, whether only white space follows, and what is wrong."""
    blocks = F.regexp_extract_all(c, F.lit("(?s)<answer>(.*?)</answer>"), F.lit(1))
    have = F.size(blocks) > 0
    tail = F.substring_index(c, "</answer>", -1)
    ended = have & (strip(tail) == "")
    error = F.when(~have & c.contains("<answer>"), "unclosed").when(~have, "missing").when(~ended, "trailing")
    return F.struct(F.when(have, strip(F.get(blocks, F.size(blocks) - 1))).alias("answer"), ended.alias("ended"), error.alias("error"))


def fenced_json(c: Column) -> Column:
    """The last fenced JSON object, for recovery only."""
    blocks = F.regexp_extract_all(c, F.lit(r"(?si)```(?:json)?\s*(\{.*?\})\s*```"), F.lit(1))
    return F.get(blocks, F.size(blocks) - 1)


def after_first(c: Column, mark: str) -> Column:
    """Stripped text behind the first mark, the whole text if there is none."""
    at = F.locate(mark, c)
    return F.when(at > 0, strip(F.substring(c, at + len(mark), F.length(c)))).otherwise(strip(c))


def after_last(c: Column, mark: str) -> Column:
    """Stripped text behind the last mark, the whole text if there is none."""
    return strip(F.substring_index(c, mark, -1))


def final_output(c: Column, tags: list[str]) -> Column:
    """The synthesis if there is one, else the text without tagged blocks, else the text."""
    bare = c
    for tag in tags:
        bare = F.regexp_replace(bare, f"(?s)<{tag}>.*?</{tag}>", "")
    return F.coalesce(F.nullif(regex_tag(c, "synthesis"), F.lit("")), F.nullif(strip(bare), F.lit("")), c)


def label_tokens(c: Column, stop: list[str], least: int = 3) -> Column:
    """Lower-case tokens of a CamelCase or under_scored label without stop words and short ones."""
    spaced = F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2"), r"[_\W]+", " ")
    words = F.filter(F.split(F.lower(F.trim(spaced)), " +"), lambda w: F.length(w) >= least)
    return F.array_except(words, F.array(*map(F.lit, stop))) if stop else words


def slug(c: Column) -> Column:
    """Lower-case letters and digits joined by single dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def display_label(c: Column) -> Column:
    """CamelCase and underscores as words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "_+", " "), r"([a-z0-9])([A-Z])", "$1 $2"), " +", " "))


def idea_list(c: Column, n: int, least: int = 12) -> Column:
    """The first ``n`` lines longer than ``least`` without bullets and numbers."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[ \t]*(?:[-*]|[0-9]+[.)])[ \t]*", "")))
    return F.slice(F.filter(lines, lambda x: F.length(x) > least), 1, n)


def strip_header(c: Column) -> Column:
    """Text behind the first line of three dashes, the whole if there is none."""
    return F.regexp_replace(c, r"(?s)\A.*?(?:^|\n)---[ \t]*\n", "")


def strip_category(c: Column) -> Column:
    """Without a bracketed or colon-ended category in front."""
    return F.regexp_replace(c, r"^(?:\[[^\]]*\]|[A-Za-z ]{1,30}:)[ \t]*", "")


def extracted_edges(c: Column) -> Column:
    """Distinct lower-case edges ``a|r|b`` from arrows ``A -> r -> B``."""
    part = r"([A-Za-z0-9 ]+?)[ ]*->[ ]*([A-Za-z0-9 ]+?)[ ]*->[ ]*([A-Za-z0-9 ]+)"
    group = lambda i: F.transform(F.regexp_extract_all(c, F.lit(part), F.lit(i)), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.transform(F.arrays_zip(group(1).alias("a"), group(2).alias("r"), group(3).alias("b")), lambda z: F.concat_ws("|", z["a"], z["r"], z["b"])))


def shuffled(words: Column, seed: str) -> Column:
    """The array in the order of a hash of place and seed: a shuffle any engine repeats."""
    keyed = F.transform(words, lambda w, i: F.struct(F.sha2(F.concat(F.lit(seed + ":"), i.cast("string")), 256).alias("h"), w.alias("w")))
    return F.transform(F.array_sort(keyed), lambda s: s.w)


def path_text(nodes: Column, relations: Column, forward: Column) -> Column:
    """``a -r-> b <-s- c``: nodes with the relation and direction of each step."""
    steps = F.transform(relations, lambda r, i: F.concat(F.when(F.get(forward, i), F.concat(F.lit(" -"), r, F.lit("-> "))).otherwise(F.concat(F.lit(" <-"), r, F.lit("- "))), F.get(nodes, i + 1)))
    return F.concat(nodes[0], F.array_join(steps, ""))


def truth_first(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, null if none does."""
    out = None
    for name, cond in rules:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out
