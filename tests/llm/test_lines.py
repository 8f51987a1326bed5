import re

from pyspark.sql import functions as F
from tessaly.llm import lines

from .cases import SCHEMA, documents

SPACE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def key(line):
    line = re.sub(SPACE, "", line)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)


def brute(rows):
    last = 1 << 63
    first = {}
    for doc, text in rows:
        for x in (text or "").split("\n"):
            k = key(x)
            if len(k) >= 10:
                first[k] = min(first.get(k, last), last if doc is None else doc)
    out = []
    for doc, text in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if len(key(x)) < 10 or first[key(x)] == (last if doc is None else doc)]
        out.append((doc, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return out


def test_against_brute_force(spark):
    docs = documents(spark).select("doc_id", "text", "lang")
    more = spark.range(200).select((F.col("id") + 100).alias("doc_id"), F.expr("concat('A common line of text\\n', if(id % 3 = 0, '  a COMMON line of text\\r\\n', ''), 'own line number ', id, '\\n\\n', repeat(concat('again and again ', id % 5, '\\n'), cast(id % 150 as int)), 'é line\\u3000')").alias("text"), F.lit("x").alias("lang"))
    docs = docs.union(more).repartition(6).cache()
    got = sorted(map(str, map(tuple, lines.deduplicate(docs).collect())))
    assert got == sorted(map(str, brute([(r.doc_id, r.text) for r in docs.collect()])))
    assert lines.deduplicate(spark.createDataFrame([], SCHEMA)).collect() == []
