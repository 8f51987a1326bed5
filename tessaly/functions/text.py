"""Text as Column expressions. Offsets and lengths are in code points. White space is Unicode's, ideographic space too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Delimiters and marks of the text formats read and written here.
CLAUSE_MARKS = "，；、"
TRIM_MARKS = "，。！？；：、,,;:"
FOCUS_MARKS = "，。；！？、"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
STANCES = {"支持": "support", "反对": "oppose", "中立": "neutral", "中性": "neutral", "support": "support", "oppose": "oppose", "neutral": "neutral"}
LATIN_MARKS = ",;:"


def ustrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_spaces(c: Column) -> Column:
    """Without space characters at the ends, as SQL's trim: tabs and line ends stay."""
    return F.regexp_replace(c, r"^\p{Zs}+|\p{Zs}+\z", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def grams_of(t: Column) -> Column:
    """Distinct pairs of neighbouring characters as they are; one character is itself; none for an empty text."""
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2))))
    return F.when(F.length(t) >= 2, many).when(F.length(t) == 1, F.array(t)).otherwise(F.array().cast("array<string>"))


def bigrams(t: Column) -> Column:
    return grams_of(squeeze(F.coalesce(t, F.lit(""))))


def set_cosine(a: Column, b: Column) -> Column:
    n = F.size(a).cast("double") * F.size(b)
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / F.sqrt(n)).otherwise(F.lit(0.0))


def near_duplicate(a: Column, b: Column, least: float = 0.85) -> Column:
    """By pairs of characters, white space included."""
    return set_cosine(grams_of(a), grams_of(b)) >= F.lit(least)


def mentions(name: Column, text: Column) -> Column:
    """Whether any two neighbouring characters of the name are in the text."""
    return F.exists(bigrams(name), lambda g: F.contains(text, g))


def pieces(t: Column, marks: str) -> Column:
    """Runs that end with one of the marks, and the rest."""
    m = "[" + "".join("\\" + c if c in "\\]^-" else c for c in marks) + "]"
    return F.regexp_extract_all(t, F.lit(f"[^{m[1:]}*{m}|[^{m[1:]}+$"), F.lit(0))


def clauses(t: Column, marks: str = CLAUSE_MARKS) -> Column:
    """Clauses with their marks; a blank one joins the one before, or the next where it is first."""
    start = F.array().cast("array<string>")
    blank = lambda x: F.length(ustrip(x)) == 0
    fold = F.aggregate(pieces(t, marks), start, lambda s, x: F.when(blank(x) & (F.size(s) > 0), F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.concat(F.element_at(s, -1), x)))).otherwise(F.concat(s, F.array(x))))
    return F.when(F.length(t) == 0, start).otherwise(fold)


def mark_clauses(t: Column, least: int = 60, marks: str = CLAUSE_MARKS) -> Column:
    """Long texts get a circled number after each mark, from 2 on, up to 20."""
    each = pieces(t, marks)
    numbered = F.transform(each, lambda x, i: F.when(x.rlike(f"[{marks}]$") & (i + 2 <= 20), F.concat(x, F.substring(F.lit(CIRCLED), i + 2, F.lit(1)))).otherwise(x))
    return F.when(F.length(t) >= least, F.array_join(numbered, "")).otherwise(t)


def sentences(t: Column, least: int = 12) -> Column:
    """Stripped runs up to a full stop or its like, `least` characters at least."""
    found = F.regexp_extract_all(t, F.lit("[^。！？!?]+[。！？!?]?"), F.lit(0))
    return F.filter(F.transform(found, ustrip), lambda x: F.length(x) >= least)


def best_window(name: Column, t: Column, marks: str, longest: int, goal: int, edge: str) -> Column:
    """The run of whole clauses, up to `longest` characters, with the most pairs of the name, then of length closest to
    the goal, then first; stripped of the edge's characters. A short text, or one of a single clause, stays."""
    text = ustrip(t)
    parts = F.filter(pieces(text, marks), lambda x: F.length(ustrip(x)) > 0)
    grams = bigrams(name)
    # A clause has a character at least, so no window has more clauses than the bound has characters.
    windows = F.flatten(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda a: F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - a + 1, F.lit(longest))), lambda n: F.struct(a.alias("a"), F.array_join(F.slice(parts, a, n), "").alias("x")))))
    fit = F.filter(windows, lambda w: F.length(w["x"]) <= longest)
    rated = F.transform(fit, lambda w, i: F.struct(F.size(F.filter(grams, lambda g: F.contains(w["x"], g))).alias("n"), (-F.abs(F.length(w["x"]) - goal)).alias("d"), (-i).alias("i"), w["x"].alias("x")))
    best = F.regexp_replace(F.array_max(rated)["x"], f"^[{edge}]+|[{edge}]+$", "")
    return F.when((F.length(text) <= longest) | (F.size(parts) <= 1), text).when(F.coalesce(F.length(best), F.lit(0)) == 0, text).otherwise(best)


def trim_evidence(name: Column, t: Column, marks: str = TRIM_MARKS) -> Column:
    return best_window(name, t, marks, 64, 55, " ,，;；、:：")


def trim_focus(name: Column, t: Column, marks: str = FOCUS_MARKS) -> Column:
    return best_window(name, t, marks, 80, 53, " ，。；、,;")


def stance(c: Column) -> Column:
    """English name of a stance, null for none."""
    return F.create_map(*[F.lit(x) for kv in STANCES.items() for x in kv])[F.lower(ustrip(c))]


def future_pointing(name: Column, future: Column) -> Column:
    """A future statement that doesn't mention its issue gets the issue's name in front."""
    some = (F.length(F.coalesce(name, F.lit(""))) > 0) & (F.length(F.coalesce(future, F.lit(""))) > 0)
    return F.when(some & ~mentions(name, future), F.concat(F.lit("关于"), name, F.lit("，"), future)).otherwise(future)


def without_thinking(c: Column) -> Column:
    """What follows the first closing mark of a model's reasoning."""
    return ustrip(F.regexp_replace(c, r"(?s)^.*?</think>", ""))
