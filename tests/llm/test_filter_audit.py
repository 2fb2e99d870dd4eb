"""The filter audit against a plain version."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from quillon.llm import filter_audit as A
from quillon.llm import queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def failed(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, s in rows:
        t, w = t or "", WORDS.findall(t or "")
        yield i, s or "", "".join(
            f for f, on in zip("ABCDE", (
                len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search(r"[#$%&*|]", t),
                i is not None and least[t] < i), strict=True) if on)


def brute(rows, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    parts, out = defaultdict(list), []
    for i, s, f in failed(rows):
        parts[s].append((i, f))
    for part, docs in parts.items():
        found, shapley = [], Counter()
        for o in map("".join, permutations("ABCDE")):
            left = docs
            for k, f in enumerate(o):
                gone, kept = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                fails = [d for d in docs if f in d[1]]
                lost = [sum(d[0] in ids for d in gone) for ids in (good, toxic)]
                found.append((part, o, k + 1, len(kept), len(gone), len(fails) - len(gone), sum(d[1] == f for d in docs), *lost, f))
                left = kept
        out += [(*r[:-1], shapley[r[-1]]) for r in found]
    return sorted(out)


def shown(df):
    return sorted(tuple(r) for r in df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = [None, "", " \n", "AB#", "ab" * 3000, "ab" * 2999 + "ac", "x" * 256, "x" * 257, "日本 é " * 120, "Éé" * 40]
    texts += [" ".join(rng.choice(["ab", "Cd", "e|", f"w{rng.randint(0, 900)}", f"v{rng.randint(0, 900)}"][(k % 3) * 2 // 2 :]) for _ in range(rng.choice([3, 199, 200, 700]))) for k in range(60)]
    texts += [f"{'p' * 5000}{k % 3}" for k in range(9)]  # the same but for the end
    found = [(i, rng.choice(texts), rng.choice(["a", "b", "", None])) for i in range(400)]
    found += [(5, texts[20], "a"), (5, texts[20], "a"), (None, texts[20], "b"), (None, texts[20], "b"), (None, "only here", "c"), (900, "only here", "c"), (2**40, texts[4], None)]
    return found + [(1000 + k, "copied often", "a") for k in range(300)]


LABELS = [(i, i % 3 and 1, i % 7 == 0 and 1 or 0) for i in range(0, 1300, 2)] + [(4, 0, 1), (4, 1, None), (None, 1, 1), (6, None, None)]


@pytest.fixture(scope="module")
def tables(spark, rows):
    clash = {c: F.lit("clash") for c in ("class", "mask", "part", "body", "n", "least", "words", "block0", "several", "_bits", "before")}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).withColumns(clash)
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("n", F.lit(1))


def test_audit(tables, rows):
    docs, labels = tables
    assert shown(A.audit(docs, labels)) == brute(rows, LABELS)


@pytest.mark.parametrize("hashed", [lambda c: F.lit(7).cast("long"), lambda c: F.length(c).cast("long") % 2])
def test_texts_that_no_hash_tells_apart(tables, rows, hashed):
    found = A.masks(tables[0], hashed=hashed)
    got = Counter((r.doc_id, r.part, r.mask) for r in found.collect())
    assert got == Counter((i, s, sum(1 << "ABCDE".index(x) for x in f)) for i, s, f in failed(rows))


def test_rounds_drop_what_is_alone(tables):
    narrow = A.written(A.failures(tables[0]).drop("body"), "t")
    several, alone = A._refined(narrow, narrow.count())
    sizes = [a.count() for a in alone]
    assert sum(sizes) + several.count() == narrow.count() and sum(sizes) >= 1


def test_map_of_classes(spark):
    rows = spark.range(100_000).select((F.xxhash64("id")).alias("class"))
    few = rows.where("class % 5 = 0")
    assert A._may_be_in(rows, few).join(few, "class", "left_anti").count() < 1000
    assert few.join(A._may_be_in(rows, few), "class", "left_anti").count() == 0


def test_empty_tables(tables):
    docs, labels = tables
    assert A.audit(docs.where("false"), labels).count() == 0
    assert {r[7] for r in shown(A.audit(docs, labels.where("false")))} == {0}


def test_query(spark, duck):
    got = queries.op11_filter_audit(spark, "/root/testdata/sf0.001").toPandas()
    want = duck.sql(queries.ORACLES["op11_filter_audit"]).df()
    order, columns = ["part", "filter_order", "step"], sorted(want.columns)
    assert got.sort_values(order)[columns].values.tolist() == want.sort_values(order)[columns].values.tolist()
