"""Sentences of documents: quotes hold together, long sentences are cut, short ones joined. Offsets are code points."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int>>"
Span = tuple[int, int]
# Quotes, and the characters at which a hard cut may fall.
QUOTES = {"“": "”", "「": "」", "『": "』"}
BREAKS = "，,； "


@dataclass(frozen=True)
class Profile:
    """Marks of three ranks, and lengths in characters."""

    primary: str = "。！？\n"
    secondary: str = "；;"
    tertiary: str = "，,"
    shortest: int = 32
    joined: int = 180
    long: int = 160
    cap: int = 220
    patterns: dict = field(default_factory=dict, compare=False)

    def spans(self, text: str, marks: str) -> list[Span]:
        """Runs up to a mark outside quotes. A quote opens only outside others and, unclosed, runs to the end."""
        if marks not in self.patterns:
            quoted = "|".join(f"{a}[^{b}]*(?:{b}|\\Z)" for a, b in QUOTES.items())
            chars = re.escape(marks)
            self.patterns[marks] = re.compile(f"(?:{quoted}|[^{chars}{''.join(QUOTES)}])*(?:[{chars}]|\\Z)")
        return [m.span() for m in self.patterns[marks].finditer(text) if m.group().strip()]

    def cut(self, text: str, span: Span, limit: int, marks: str) -> list[Span]:
        """A span above the limit at marks of the next rank; where there are none, in windows that end at a break."""
        a, b = span
        if b - a <= limit:
            return [span]
        inner = self.spans(text[a:b], marks)
        if len(inner) > 1:
            return [(a + x, a + y) for x, y in inner]
        out = []
        while a < b:
            to = min(a + limit, b)
            if to < b:
                back = max(a, to - 40)
                last = max((k for k, c in enumerate(text[back:to]) if c in BREAKS), default=-1)
                to = back + last + 1 if last >= 8 else to
            out.append((a, to))
            a = to
        return [(x, y) for x, y in out if text[x:y].strip()]

    def join(self, text: str, spans: list[Span]) -> list[Span]:
        def add(out: list[Span], span: Span) -> list[Span]:
            if out:
                a, b = out[-1]
                short = min(len(text[a:b].strip()), len(text[span[0] : span[1]].strip())) < self.shortest
                if short and span[1] - a <= self.joined:
                    return [*out[:-1], (a, span[1])]
            return [*out, span]

        return reduce(lambda out, s: out[:-1] + add(out[-1:], s), spans, [])

    def sentences(self, text: str) -> list[Span]:
        first = [y for x in self.spans(text, self.primary) for y in self.cut(text, x, self.long, self.secondary)]
        return [y for x in self.join(text, first) for y in self.cut(text, x, self.cap, self.tertiary)]


LATIN = Profile(primary=".!?\n", secondary=";", tertiary=",")


def sentence_spans(text: Column, profile: Profile = Profile()) -> Column:
    """Spans of a text's sentences; none for null."""

    @F.pandas_udf(SPANS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: [{"start": a, "end": b} for a, b in profile.sentences(t or "")])

    return run(text)


def sentences(docs: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """sample_id, doc_index, sent_no, sid, start, end, text (stripped) from sample_id, doc_index and full_text.

    Numbers run over all documents of a sample in order of doc_index."""
    return _numbered(docs.select("sample_id", "doc_index", "full_text", sentence_spans(F.col("full_text"), profile).alias("spans")))


def sentences_by_profile(docs: DataFrame, profiles: dict[str, Profile]) -> DataFrame:
    """Sentences under each of several named profiles, every text read once; sample_id is a struct (profile, sample_id)."""

    @F.pandas_udf(f"array<struct<profile:string,spans:{SPANS}>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: [{"profile": name, "spans": [{"start": a, "end": b} for a, b in p.sentences(t or "")]} for name, p in profiles.items()])

    each = docs.select("sample_id", "doc_index", "full_text", F.explode(run("full_text")).alias("p"))
    return _numbered(each.select(F.struct(F.col("p.profile").alias("profile"), "sample_id").alias("sample_id"), "doc_index", "full_text", F.col("p.spans").alias("spans")))


def _numbered(spans: DataFrame) -> DataFrame:
    spans = spans.select("sample_id", "doc_index", "full_text", F.explode("spans").alias("s"))
    raw = F.substring("full_text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    left = F.length(raw) - F.length(F.regexp_replace(raw, r"(?U)^\s+", ""))
    text = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    rows = spans.select("sample_id", "doc_index", (F.col("s.start") + left).alias("start"), (F.col("s.start") + left + F.length(text)).alias("end"), text.alias("text"))
    number = F.row_number().over(Window.partitionBy("sample_id").orderBy("doc_index", "start"))
    return rows.withColumn("sent_no", number).withColumn("sid", F.format_string("S%02d", "sent_no"))


def neighbourhood(sents: DataFrame, cited: DataFrame, radius: int) -> DataFrame:
    """Sentences within a radius of the cited ones (sample_id, sent_no), each once."""
    around = cited.select("sample_id", F.explode(F.sequence(F.col("sent_no") - radius, F.col("sent_no") + radius)).alias("sent_no")).distinct()
    return sents.join(around, ["sample_id", "sent_no"], "left_semi")
