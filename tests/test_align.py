import difflib
import random

from pyspark.sql import functions as F
from tessaly.functions import text as T
from tessaly.operators import align, rewrite, segment


def brute(sents, text, evidence):
    for width in (1, 2, 3):
        best = None
        for k in range(len(sents) - width + 1):
            run = sents[k : k + width]
            raw, joined = text[run[0].start : run[-1].end], "".join(r.text for r in run)
            if evidence in raw or evidence in joined:
                key = (len(joined), run[0].sid) if width == 1 else (len(raw), k)
                if best is None or key < best[0]:
                    best = (key, [r.sid for r in run])
        if best:
            return best[1]
    return None


def test_smallest_run(spark):
    rng = random.Random(5)
    docs, evidence = [], []
    for sample in range(12):
        text = "".join(rng.choice("甲乙丙丁") * rng.randint(1, 30) + rng.choice("。！\n，") for _ in range(30))
        docs.append((sample, 0, text))
        for k in range(8):
            a = rng.randrange(len(text))
            evidence.append((sample, k, text[a : a + rng.choice([3, 20, 90, 400])]))
        evidence.append((sample, 99, "nowhere"))
    d = spark.createDataFrame(docs, "sample_id long, doc_index int, full_text string")
    e = spark.createDataFrame(evidence, "sample_id long, evidence_no int, evidence string")
    s = segment.sentences(d)
    rows = {}
    for r in s.orderBy("sample_id", "sent_no").collect():
        rows.setdefault(r.sample_id, []).append(r)
    got = {(r.sample_id, r.evidence_no): r.sids for r in align.covers(s, d, e).collect()}
    texts = {sample: text for sample, _, text in docs}
    assert got == {(sample, k): brute(rows[sample], texts[sample], x) for sample, k, x in evidence}
    c = align.containment(align.covers(s, d, e)).first()
    assert c.n == len(evidence) and c.in_one == round(sum(x is not None and len(x) == 1 for x in got.values()) / len(got), 6)
    t = spark.createDataFrame([(0, 0, rows[0][1].text), (0, 1, rows[0][0].text[:5])], "sample_id long, text_no int, text string")
    back = {r.text_no: r.sid for r in align.recovered(s, t).collect()}
    assert back[0] == next(r.sid for r in rows[0] if r.text == rows[0][1].text)
    assert back[1] == next(r.sid for r in rows[0] if rows[0][0].text[:5] in r.text)


def brute_tokens(sents, texts, chain):
    out = []
    for e in chain:
        held = sorted((len(s.text), s.sent_no, s.sid, s.text) for s in sents if e and e in s.text)
        if held:
            _, _, sid, text = held[0]
            if len(text) < 60:
                out.append(sid)
                continue
            a, b, at, first, last = text.index(e), text.index(e) + len(e), 0, None, None
            pieces, piece = [], ""
            for c in text:
                piece += c
                if c in T.CLAUSE_MARKS:
                    pieces, piece = [*pieces, piece], ""
            for k, x in enumerate([*pieces, piece] if piece else pieces, 1):
                first = k if at <= a < at + len(x) else first
                last = k if at < b <= at + len(x) else last
                at += len(x)
            if first > 20:
                out.append(sid)
            elif last > first and last <= 20:
                out.append(f"{sid}.{T.CIRCLED[first - 1]}-{T.CIRCLED[last - 1]}")
            else:
                out.append(f"{sid}.{T.CIRCLED[first - 1]}")
        else:
            host = next((k for k, t in texts if e in t), None)
            pool = [s for s in sents if host is None or s.doc_index == host]
            best = None
            for width in (2, 3):
                for k in range(len(pool) - width + 1):
                    run = pool[k : k + width]
                    if len({r.doc_index for r in run}) == 1 and (e in dict(texts)[run[0].doc_index][run[0].start : run[-1].end] or e in "".join(r.text for r in run)):
                        best = min(best or (9, 0, 0), (width, run[-1].end - run[0].start, k))
            if best:
                out += [r.sid for r in pool[best[2] : best[2] + best[0]] if r.sid not in [t.split(".")[0] for t in out]]
    return out


def test_clause_tokens_and_sweep(spark):
    rng = random.Random(9)
    docs, evidence, chains = [], [], {}
    for sample in range(5):
        texts = ["".join(rng.choice("甲乙丙丁戊己") * rng.randint(1, 3) + rng.choice("，，，，、；。") for _ in range(90)) for _ in range(2)]
        texts.append(texts[0][:200])
        docs += [(sample, k, t) for k, t in enumerate(texts)]
        for issue in range(3):
            for k in range(6):
                t = rng.choice(texts)
                a = rng.randrange(len(t))
                e = t[a : a + rng.choice([4, 12, 40, 150])]
                evidence.append((sample, issue, issue * 10 + k, e))
                chains.setdefault((sample, issue), []).append(e)
    docs.append((5, 0, "、".join("x" * 2 + str(k) for k in range(40)) + "。"))
    evidence += [(5, 0, 0, "xx2、"), (5, 0, 1, "xx30"), (5, 0, 2, "xx18、xx19、xx20"), (5, 1, 10, "nowhere"), (5, 1, 11, "")]
    chains |= {(5, 0): [e[3] for e in evidence[-5:-2]], (5, 1): ["nowhere"]}
    d = spark.createDataFrame(docs, "sample_id long, doc_index int, full_text string")
    e = spark.createDataFrame(evidence, "sample_id long, issue_no int, evidence_no int, evidence string")
    s = segment.sentences(d)
    rows, texts = {}, {}
    for r in s.orderBy("sample_id", "sent_no").collect():
        rows.setdefault(r.sample_id, []).append(r)
    for sample, k, t in docs:
        texts.setdefault(sample, []).append((k, t))
    got = {(r.sample_id, r.issue_no): r.tokens for r in align.clause_tokens(s, d, e).collect()}
    want = {k: brute_tokens(rows[k[0]], texts[k[0]], c) for k, c in chains.items()}
    assert got == {k: v for k, v in want.items() if v}
    assert any("-" in t for v in got.values() for t in v) and got[5, 0][1] == "S01"

    profiles = {"own": segment.Profile(), "long": segment.Profile(shortest=48, joined=200)}
    swept = {r.profile: r for r in align.sweep(d, e, profiles).collect()}
    for name, p in profiles.items():
        alone = segment.sentences(d, p)
        sizes = sorted(r.n for r in alone.select(F.length("text").alias("n")).collect())
        c = align.containment(align.covers(alone, d, e)).first()
        x = swept[name]
        assert (x.sentences, x.most, x.p95, x.mean) == (len(sizes), sizes[-1], sizes[int(len(sizes) * 0.95)], round(sum(sizes) / len(sizes), 6))
        assert (x.n, x.in_one, x.in_one_or_two) == (c.n, c.in_one, c.in_one_or_two)


def test_what_trimming_keeps(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("甲乙丙丁戊己") * rng.randint(1, 3) + rng.choice("，，，、；。") for _ in range(160))
    evidence = [(0, k, text[k * 5 : k * 5 + 3], text[a : a + size]) for k, (a, size) in enumerate([(5, 20), (60, 90), (150, 30), (200, 8)])] + [(0, 9, "甲", "nowhere")]
    d = spark.createDataFrame([(0, 0, text)], "sample_id long, doc_index int, full_text string")
    e = spark.createDataFrame(evidence, "sample_id long, evidence_no int, name string, evidence string")
    s = segment.sentences(d)
    held = align.covers(s, d, e, hosted=True)
    got = {r.evidence_no: r for r in align.trimmed(held, s, e).collect()}
    cited = {r.evidence_no: r.sids for r in held.collect()}
    names = {k: n for _, k, n, _ in evidence}
    cuts = {(r.sid, k): r[f"c{k}"] for r in s.select("sid", *[T.trim_evidence(F.lit(n), F.col("text")).alias(f"c{k}") for k, n in names.items()]).collect() for k in names}
    assert sorted(got) == sorted(k for k, x in cited.items() if x) and 9 not in got
    shares = []
    for k, r in got.items():
        assert r.got == "".join(cuts[sid, k] for sid in cited[k]) and r.gold == evidence[k][3]
        shares.append(sum(m.size for m in difflib.SequenceMatcher(None, r.gold, r.got, autojunk=False).get_matching_blocks()) / len(r.gold))
    total = rewrite.coverage(align.trimmed(held, s, e)).first()
    assert (total.n, total.recall, total.fully_kept) == (len(shares), round(sum(shares) / len(shares), 6), round(sum(x >= 0.9 for x in shares) / len(shares), 6))
