"""Ranked lexical search against a plain version."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import lexical_search as L
from quillon.llm import queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def terms(t):
    return TERM.findall((t or "").translate(LOWER))


def brute(docs, items, k=10):
    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    n, total = len(found), sum(x[2] for x in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in found:
            m = 10 + 90 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            scores += [(-s, i is None, i if i is not None else 0)] * (s > 0)
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def shown(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(4000)] + ["Éa", "日本", "X9", "x9"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 80)))) for i in range(500)]
    docs += [(7, docs[3][1]), (7, docs[3][1]), (None, docs[3][1]), (None, docs[4][1]), (600, None), (601, ""), (602, " .,;"), (603, "w1 " * 20_000), (2**40, "ZZZ-rare_term\n")]
    docs += [(1000 + i, docs[5][1]) for i in range(40)]
    items = [(i, docs[i * 7][1]) for i in range(30)] + [(3, "rare"), (3, "rare"), (None, "X9 日本 éa"), (40, None), (41, "..."), (42, "nowhere"), (43, "w1"), (44, " ".join(f"w{i}" for i in range(400)))]
    return docs, items


@pytest.mark.parametrize("k,shard_bytes,item_bytes", [(10, 1 << 20, 1 << 20), (3, 3000, 2000), (1, 1, 1 << 20)])
def test_search(spark, tables, k, shard_bytes, item_bytes):
    docs, items = tables
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({c: F.lit("clash") for c in ("shard", "term", "where", "df")})
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("_row", "rank", "score")})
    found = L.index(d, shard_bytes=shard_bytes)
    assert found.where("term = ''").agg(F.sum("df")).first()[0] == sum(bool(terms(t)) for _, t in docs)
    assert shown(L.search(found, q, k, item_bytes=item_bytes)) == brute(docs, items, k)


def test_empty_tables(spark, tables):
    d = spark.createDataFrame(tables[0], "doc_id long, text string")
    q = spark.createDataFrame(tables[1], "item_id long, text string")
    assert L.ranked(d.where("false"), q).count() == L.ranked(d, q.where("false")).count() == L.ranked(d.where("text = ''"), q).count() == 0


def test_numbers_come_back():
    rng = np.random.default_rng(2)
    for v in ([], [0], [127, 128, 16383, 16384, 2**40, 0, 0], rng.integers(0, 2**33, 5000)):
        data, starts = L.packed(np.array(v, np.int64))
        assert L.unpacked(data.tobytes()).tolist() == list(v) and starts[-1] == len(data)


def test_documents_that_cannot_win_are_passed_over():
    """A common term opens no documents once rarer ones have filled the heap, and its share still counts."""
    lists = []
    for docs, score in ((range(0, 10_000), 1), (range(0, 10_000, 50), 100)):
        p = object.__new__(L.Postings)
        p.docs, p.score, p.most = list(docs), [score] * len(docs), score
        lists.append(p)
    opened = []

    class Ids(list):
        def __getitem__(self, i):
            opened.append(i)
            return i

    held = []
    L.best(lists, Ids(), held, 10)
    assert sorted(held) == sorted((101, -d) for d in range(0, 500, 50))
    assert len(opened) == 451 + 190  # all up to the tenth document that has both, then only those of the rarer term


def test_query(spark, duck):
    got = queries.op13_lexical_search(spark, "/root/testdata/sf0.001").toPandas()
    want = duck.sql(queries.ORACLES["op13_lexical_search"]).df()
    columns = sorted(want.columns)
    order = ["item_id", "rank"]
    assert got.sort_values(order)[columns].values.tolist() == want.sort_values(order)[columns].values.tolist()
