"""SentencePiece encoding and decoding against the library."""

import hashlib
import random
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from quillon.llm import encoders, queries
from quillon.llm import sentencepieces as S

PATH = encoders.path_of(S.PIECE_BPE)
TEXTS = ["", None, "▁", " ", "   ", " a  b ", "<s> </s> <unk> <0x41>", "\x00\n\t a▁b", "日本語　テキスト é ß 🤔", "�", "a" * 5000, "=-" * 3000, "日本語のテキスト" * 500, "ठकी हे", " \n \r\n x"]
ALPHABETS = [" \n\tabcde'ést129!?.,-", "thersaniou", "日本é ß▁", "aA ", "\x1c\x85　 x\n\x00�", "0123456789,.", " ", "🤔<s></x>"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def want(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_rows(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "x y"), (3, "x y"), (None, "x"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit("clash") for c in ("ids", "n_tokens", "part", "ids_sha256")})
    for verify in (True, False):
        got = sorted((tuple(r) for r in S.round_trip(docs, PATH, verify=verify).collect()), key=repr)
        assert got == sorted(((i, *want(library, t)) for i, t in rows), key=repr)
    assert S.round_trip(docs.where("false"), PATH).count() == 0


def test_random_texts(library):
    p, rng = S.pieces_of(PATH), random.Random(3)
    texts = ["".join(rng.choice(ALPHABETS[k % len(ALPHABETS)]) for _ in range(rng.randint(0, 120))) for k in range(3000)]
    ids = [p.encode(t) for t in texts]
    S.check(p, texts, ids, [p.decode(np.frombuffer(i, np.uint32)) for i in ids])


def test_lists_and_heaps_agree():
    p, rng = S.pieces_of(PATH), random.Random(8)
    for k in range(3000):
        t = "".join(rng.choice(ALPHABETS[k % len(ALPHABETS)] + "the and ing") for _ in range(rng.randint(2, S.SHORT)))
        assert p.merged(t) == p._heaped(t)


def test_parts_side_by_side_agree_with_one_by_one():
    p, rng = S.pieces_of(PATH), random.Random(11)
    parts = ["a", " ", "\n", "é", "🤔", "日本", "aaaaaaa", "\x00a\x00"]
    parts += {"".join(rng.choice(ALPHABETS[k % len(ALPHABETS)] + "the and ing") for _ in range(rng.randint(1, S.SHORT))) for k in range(3000)}
    got = {}
    for names, symbols, size in p._side_by_side(parts):
        got.update(zip(names, np.split(symbols, np.cumsum(size)[:-1]), strict=True))
    assert got.keys() == set(parts)
    for part, numbers in got.items():
        symbols = p.merged(part)
        assert len(numbers) == len(symbols)
        assert all(n == p.id_of[s] if s in p.id_of else n == p.byte_ids[ord(s)] if s.isascii() else n >= p.ids for n, s in zip(numbers, symbols, strict=True)), part


def test_new_words_take_less_than_half_the_time_of_one_agenda_each(library):
    p, rng = S.Pieces(PATH), random.Random(12)
    words = list({"".join(rng.choice("thersaniou") for _ in range(rng.randint(6, 14))) for _ in range(40_000)})
    began = time.process_time()
    for w in words:
        p._part(" " + w)
    alone = time.process_time() - began
    texts = [" ".join(words[k : k + 500]) for k in range(0, len(words), 500)]
    began = time.process_time()
    ids = p.encode_all(texts)
    assert time.process_time() - began < alone / 2
    S.check(p, texts, ids, [t.encode() for t in texts])


def test_the_memo_stays_bounded_and_texts_go_in_groups(library, monkeypatch):
    monkeypatch.setattr(S, "AT_ONCE", 300)
    monkeypatch.setattr(S, "MANY", 64)
    p, rng = S.Pieces(PATH), random.Random(13)
    p.parts.limit, most = 100, 0
    for k in range(30):
        texts = ["".join(rng.choice(ALPHABETS[k % len(ALPHABETS)] + " ") for _ in range(rng.choice([0, 5, 100, 1000]))) for _ in range(rng.randint(0, 9))]
        ids = p.encode_all(texts)
        most = max(most, len(p.parts))
        S.check(p, texts, ids, [p.decode(np.frombuffer(i, np.uint32)) for i in ids])
    assert 64 < most <= 100


def test_ids_outside_the_vocabulary_are_errors():
    p = S.pieces_of(PATH)
    for ids in ([5, -1], [p.ids]):
        with pytest.raises(IndexError):
            p.decode(np.array(ids, np.int64))


def test_random_ids(library):
    """Control, unknown and stray byte pieces too."""
    p, rng = S.pieces_of(PATH), random.Random(5)
    for _ in range(20_000):
        ids = [rng.choice([rng.randrange(300), rng.randrange(32_000)]) for _ in range(rng.randint(0, 12))]
        assert p.decode(np.array(ids, np.int64)).decode() == library.decode(ids), ids


def test_a_difference_stops_the_batch():
    p = S.pieces_of(PATH)
    with pytest.raises(S.Differs):
        S.check(p, ["a b"], [p.encode("a c")], [b"a c"])
    with pytest.raises(S.Differs):
        S.check(p, ["a b"], [p.encode("a b")], [b"a  b"])


def test_one_agenda_of_a_long_part_is_not_quadratic(library):
    p = S.pieces_of(PATH)
    times = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        got = p.merged("ab" * n)
        times.append(time.perf_counter() - began)
        assert [p.id_of[x] for x in got[1:]] == library.encode("ab" * n)[-len(got) + 1 :]
    assert times[1] < 10 * times[0] + 0.5


def test_columns_round_trip(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    back = S.decode_column(S.encode_column(docs, PATH, to="ids2"), PATH, ids="ids2", to="back")
    assert all(r.back == (r.text or "").replace("▁", " ") for r in back.collect())


def test_query(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: want(library, r.text) for r in docs}
