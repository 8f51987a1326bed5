"""Several variants of one sample's records fused into one: clusters of alike names, votes, and a variant closest to all.

A sample's variants come as one array of struct(variant, issues), issues being struct(name, stance, evidence, future);
variant 0 has priority. Groups are a handful of records, so each is one call inside its row."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rewrite import LONG_FUTURE

RECORDS = "array<struct<name:string,stance:string,evidence:array<string>,future:string>>"


def grams(text: str | None) -> frozenset[str]:
    t = "".join((text or "").split())
    return frozenset([t] if len(t) == 1 else (t[k : k + 2] for k in range(len(t) - 1)))


def alike(a: frozenset[str], b: frozenset[str]) -> float:
    return len(a & b) / (len(a) * len(b)) ** 0.5 if a and b else 0.0


@dataclass(frozen=True)
class Strategy:
    """head: a record is compared with a cluster's first member, else with any. best: it joins the most alike cluster,
    else the first alike one. anchored: clusters with a record of variant 0 stay whatever their votes."""

    head: bool = True
    best: bool = True
    anchored: bool = True
    votes: int = 2
    same_name: float = 0.6
    same_evidence: float = 0.8
    records: int = 6
    evidence: int = 3


ANCHORED = Strategy()
CONSENSUS = Strategy(head=False, best=False, anchored=False, same_evidence=0.6)
UNION = Strategy(anchored=False, votes=1, same_evidence=1.0)


def clusters(variants: list[dict], s: Strategy) -> list[list[tuple[int, dict]]]:
    made: list[list[tuple[int, dict]]] = []
    for v in sorted(variants, key=lambda v: v["variant"]):
        for issue in v["issues"] or []:
            own = grams(issue["name"])
            near = [(max(alike(own, grams(x["name"])) for _, x in (c[:1] if s.head else c)), -k) for k, c in enumerate(made)]
            if s.best:
                near = [(a, k) for a, k in near if all(w != v["variant"] for w, _ in made[-k])]
            near = [(a, k) for a, k in near if a >= s.same_name]
            if not near:
                made.append([(v["variant"], issue)])
                continue
            chosen = made[-(max(near) if s.best else near[0])[1]]
            if all(w != v["variant"] for w, _ in chosen):
                chosen.append((v["variant"], issue))
    return made


def majority(values: list[str | None]) -> str | None:
    """The most frequent, the earliest of equals; null for none."""
    counts = Counter(x for x in values if x)
    return max(counts, key=lambda x: counts[x], default=None)


def evidence(members: list[tuple[int, dict]], s: Strategy) -> list[str]:
    """Distinct evidence under its first spelling, most voted first, then first seen."""
    seen: list[list] = []
    for _, issue in members:
        for text in issue["evidence"] if issue["evidence"] is not None else []:
            known = next((x for x in seen if x[0] == text or (s.same_evidence < 1 and alike(grams(x[0]), grams(text)) >= s.same_evidence)), None)
            if known:
                known[1] += 1
            else:
                seen.append([text, 1])
    return [t for t, _ in sorted(seen, key=lambda x: -x[1])[: s.evidence]]


def fused(variants: list[dict], s: Strategy) -> list[dict]:
    """Records that win, up to the limit; those without a name or evidence are left out before it counts. A record without
    a future gets the fallback one."""
    need = min(s.votes, len(variants))
    before, after, most = LONG_FUTURE
    out = []
    for c in clusters(variants, s):
        who = {w for w, _ in c}
        if len(who) >= need or (s.anchored and 0 in who):
            head = c[0][1]
            name = majority([x["name"] for _, x in c]) if s.head else head["name"]
            chain = evidence(c, s)
            if (name or "").strip() and chain:
                out.append({"name": name, "stance": majority([x["stance"] for _, x in c]), "evidence": chain, "future": head["future"] or before + chain[0].strip()[:most] + after})
    return out[: s.records]


def agreement(a: list[dict], b: list[dict], least: float = 0.6) -> float:
    """Of records matched in order, each with its most alike one: similarity, and a quarter more for an equal stance."""
    free, total = list(range(len(b))), 0.0
    for x in a:
        near = max(((alike(grams(x["name"]), grams(b[j]["name"])), -j) for j in free), default=(0.0, 0))
        if near[0] >= least:
            free.remove(-near[1])
            total += near[0] + 0.25 * (x["stance"] == b[-near[1]]["stance"])
    return total / max(len(a), len(b)) if a or b else 0.0


def _udf(kind: str, call):
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda v: call([{"variant": x["variant"], "issues": list(x["issues"]) if x["issues"] is not None else []} for x in v]))

    return run


def fuse(variants: Column, strategy: Strategy = ANCHORED) -> Column:
    return _udf(RECORDS, lambda v: fused(v, strategy))(variants)


def closest(variants: Column) -> Column:
    """The variant that agrees most with all others, the first of equals."""
    return _udf("int", lambda v: max(v, key=lambda x: (sum(agreement(x["issues"], y["issues"]) for y in v if y is not x), -x["variant"]))["variant"])(variants)
