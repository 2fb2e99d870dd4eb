"""The ten corpus operators against brute force, and on awkward tables."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import bpe, components, encoders, exact_dedup, orc_tokens, packing, pii, quality, queries, simhash, substring_dedup, toxicity
from quillon.llm.common import drop_scratch, fold, id_lists, looked_up, scratch

BYTE, WORD = encoders.path_of(encoders.BYTE_BPE), encoders.path_of(encoders.WORD_BPE)
SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(20_000))
SENTENCE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"

#: Nulls, empty and blank texts, a very long one, ties, repeated rows and ids, other alphabets, special tokens.
ROWS = [
    (1, SENTENCE), (2, f"intro {SENTENCE} outro"), (3, SENTENCE.replace(" ", "\n ")), (4, ""), (5, None), (6, " \t\n"), (7, LONG), (8, LONG + " end"), (8, LONG + " end"), (9, "Mail a.b@c.example.org or +1 (415) 555-0101, 10.1.2.3, 4111 1111 1111 1111!"),
    (10, "日本語のテキスト　です é ß İ   x"), (11, "<|endoftext|> a <|startoftext|>"), (11, "other text under the same id"), (None, SENTENCE), (None, None), (12, "a" * 5000), (13, "ÃÂ" * 400 + "  \n\n don't"), (2**40, SENTENCE.upper()),
]
EXTRA = ("g", "kept", "digest", "salt", "body", "bucket", "fp", "part", "score", "predicted", "held_out", "piece", "shard", "component_id", "ids", "first", "_kept_id", "kept_id", "kept_sha", "_chosen", "keep_id")


@pytest.fixture(scope="module")
def docs(spark):
    """The awkward rows, with other columns whose names the operators use inside."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    return df.withColumns({c: F.lit("clash") for c in EXTRA})


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def words(t):
    return WORDS.findall(t or "")


# --- 1 ------------------------------------------------------------------------------------------------------------


def library_digests(t, tok):
    ids = tok.encode(t or "", add_special_tokens=False).ids
    text = tok.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_bpe_equals_the_library(docs, nothing):
    tok = Tokenizer.from_file(BYTE)
    want = sorted(((i, *library_digests(t, tok)) for i, t in ROWS), key=repr)
    assert by_row(bpe.round_trip(docs, BYTE), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe.round_trip(nothing, BYTE).count() == 0


def test_bpe_of_random_texts():
    tok, c, rng = Tokenizer.from_file(BYTE), bpe.codec(BYTE), random.Random(4)
    alphabets = [" \n\tabcde'ést129!?.,-", "thersaniou", "日本é ß", "aA ", "\x1c\x85　 x\n", "0123456789,."]
    for n in range(1500):
        t = "".join(rng.choice(alphabets[n % len(alphabets)]) for _ in range(rng.randint(0, 90)))
        assert bpe.digests(c, t) == library_digests(t, tok), repr(t)


def test_transducer_memory_is_bounded_and_feeding_in_parts_changes_nothing():
    c, rng = bpe.codec(BYTE), random.Random(5)
    assert c.m.lookahead < 1000
    for text in ("thequickbrown" * 700, "a" * 9000, "".join(rng.choice("abcdefgh") for _ in range(8000)), "=-" * 4000):
        whole = bpe.Transducer(c.m)
        want = whole.feed(text.encode()) + whole.finish()
        parts, out, at = bpe.Transducer(c.m), [], 0
        while at < len(text):
            n = rng.randint(1, 400)
            out += parts.feed(text[at : at + n].encode())
            at += n
            assert len(parts.buffer) <= 4 * c.m.lookahead
        assert out + parts.finish() == want == Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids


def test_utf8_machine():
    for data in ("aé日😀b".encode(), b"\xff\xc3", b"\xe6\x97", b"\xc3\xa9\x80\xf0\x9f\x98", b"\xe6a\xed\xa0\x80"):
        m = bpe.Utf8()
        got = "".join(m.feed(data[i : i + 1]) for i in range(len(data)))
        assert len(m.held) <= 3
        assert got + m.finish() == data.decode("utf-8", "replace")


def test_columns_round_trip(docs):
    back = bpe.decode_column(bpe.encode_column(docs, BYTE, to="ids2"), BYTE, ids="ids2", to="back")
    assert all(r.back == (r.text or "") for r in back.select("text", "back").collect())


# --- 2 ------------------------------------------------------------------------------------------------------------


def repeats(rows, window=13):
    least = {}
    for i, t in rows:
        w, i = words(t), i if i is not None else float("inf")
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < (i if i is not None else float("inf")):
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


def test_substring_dedup(docs, nothing):
    got = by_row(substring_dedup.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_text")
    assert got == repeats(ROWS)
    digests = by_row(substring_dedup.remove_repeats(docs, digest=True), "doc_id", "kept_sha256")
    assert digests == sorted(((i, hashlib.sha256(k.encode()).hexdigest()) for i, _, _, k in repeats(ROWS)), key=repr)
    assert substring_dedup.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("window,seed", [(13, 1), (4, 2), (5, 3)])
def test_substring_dedup_of_random_texts(spark, window, seed):
    rng = random.Random(seed)
    passages = [[f"p{k}_{j % 7}" for j in range(rng.randint(window - 2, 40))] for k in range(12)]
    rows = []
    for i in range(120):
        t = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            t += p[rng.randint(0, 5) :] if rng.random() < 0.7 else [rng.choice("abc") for _ in range(9)]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_row(substring_dedup.remove_repeats(df, window), "doc_id", "n_words", "n_removed", "kept_text") == repeats(rows, window)


# --- 3 ------------------------------------------------------------------------------------------------------------


def searched(t):
    out = []
    for kind, p in (("email", pii.EMAIL), ("ip", pii.IP), ("card", pii.CARD), ("phone", pii.PHONE)):
        for m in p.finditer(t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(len(x.lstrip("0")) > 3 or int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_pii(docs, nothing):
    got = {(r.doc_id, r.base_sha256): r for r in pii.find(docs).collect()}
    for i, t in ROWS:
        base = searched(t or "")
        r = got[i, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in pii.BASE]
    assert pii.find(nothing).count() == 0
    clean = {r.text for r in pii.mask(docs.where("doc_id = 9")).collect()}
    assert clean == {"Mail <EMAIL> or <PHONE>, <IP>, <CARD>!"}
    assert pii.mask(docs.where("text IS NULL")).first().text is None


def test_pii_of_random_texts():
    rng = random.Random(6)
    for n in range(8000):
        t = "".join(rng.choice(rng.choice(["0123456789", "0123456789 -.", "+() 12", "a@.b-", "é @"])) for _ in range(rng.randint(0, 60)))
        t = f"4{t}4041894974608795 x@y.z +1 (988) 555-2485 1.2.3.4.5.6.7.8{t}" if n % 3 == 0 else t
        assert [s for s in pii.spans(t) if s[0] in pii.BASE] == searched(t), repr(t)
    for t in ("9" * 6000 + ".1.1.1", "a@" * 3000, "+1" + " " * 5000 + "2", "1-" * 4000):
        assert [s for s in pii.spans(t) if s[0] in pii.BASE] == searched(t)


def test_pii_adds_urls_and_accounts():
    found = pii.spans("See https://a.example/x?y=1. IBAN: DE89370400440532013000, IBAN DE00370400440532013000; account no: AB12345, account nothing")
    assert [(k, b - a) for k, a, b in found if k in ("url", "account")][0] == ("url", 24)
    assert ("account", 22) in [(k, b - a) for k, a, b in found] and ("account", 7) in [(k, b - a) for k, a, b in found]


# --- 4 ------------------------------------------------------------------------------------------------------------


def test_orc_tokens(spark, docs, nothing):
    path = scratch(spark, "orc")
    orc_tokens.write_tokens(docs, path, WORD)
    tok, at, want = Tokenizer.from_file(WORD), 0, []
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(by_row(orc_tokens.summary(spark, path), "doc_id", "start", "n_tokens", "ids_crc32"), key=lambda r: r[1]) == want
    few = orc_tokens.read_tokens(spark, path, [9, 12])
    assert sorted(r.doc_id for r in few.collect()) == [9, 12] and "PushedFilters: [In(doc_id" in few._jdf.queryExecution().toString()
    empty = scratch(spark, "orc")
    orc_tokens.write_tokens(nothing, empty, WORD)
    assert orc_tokens.summary(spark, empty).count() == 0


def test_word_encoder_equals_the_library():
    tok, own, rng = Tokenizer.from_file(WORD), encoders.word_ids(WORD), random.Random(8)
    for n in range(1500):
        t = "".join(rng.choice(" \n\tabcDEXYZ'ést129!?.,-ßÀ" + "日\x1c" * (n % 5 == 0)) for _ in range(rng.randint(0, 80)))
        assert np.frombuffer(own(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_id_lists_of_nothing():
    lists, n = id_lists([])
    assert len(lists) == 0 and len(n) == 0


# --- 6 ------------------------------------------------------------------------------------------------------------


def test_exact_dedup(docs, nothing):
    groups = {}
    for i, t in ROWS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = []
    for body, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(body.encode()).hexdigest()) for i in ids]
    got = by_row(exact_dedup.exact_groups(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(want, key=repr)
    assert exact_dedup.exact_groups(nothing).count() == 0
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and by_row(left, "doc_id", "text") == sorted(((i, t) for i, t in ROWS if i == min((j for j in groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")] if j is not None), default=None)), key=repr)


def test_exact_dedup_runs_no_python(docs):
    plan = exact_dedup.exact_groups(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 7 ------------------------------------------------------------------------------------------------------------


def test_packing(docs, nothing):
    tok = Tokenizer.from_file(BYTE)
    rows = packing.pack(docs, BYTE, capacity=256, shard_pieces=100).collect()
    want = []
    for i, t in ROWS:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 256 or 256
        starts = [0, *range(min(first, len(ids)), len(ids), 256)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(nothing, BYTE).count() == 0


def test_packing_is_tight():
    rng = np.random.default_rng(1)
    lengths = -np.sort(-rng.integers(1, 1024, 6000))
    bins, offsets = packing.place_all(lengths, 1024)
    fill = np.bincount(bins, lengths)
    assert fill.max() <= 1024 and fill.min() > 0 and len(fill) <= 1.02 * lengths.sum() / 1024
    order = np.lexsort((offsets, bins))
    same = bins[order][1:] == bins[order][:-1]
    assert (offsets[order][1:][same] == (offsets + lengths)[order][:-1][same]).all() and (offsets[order][0], offsets[order][1:][~same].sum()) == (0, 0)
    assert packing.place_all(np.zeros(0, np.int64), 1024)[0].size == 0


def test_sum_of_squares_choice():
    # 5 goes on top of 4 (squares stay), then opens a bin, whose gap the last 5 fits
    bins, offsets = packing.place(np.array([4, 5, 5, 5]), 10)
    assert bins.tolist() == [0, 0, 1, 1] and offsets.tolist() == [0, 4, 0, 5]


# --- 8 ------------------------------------------------------------------------------------------------------------


def naive_fingerprint(t):
    w = [x.encode() for x in WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def linked(fp, most=4):
    fp, label = np.array(fp, np.uint64), np.arange(len(fp))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= most
    while True:
        new = np.where(near, label[None, :], len(fp)).min(1)
        if (new == label).all():
            return label
        label = new


def test_simhash(docs, nothing):
    fp = [naive_fingerprint(t) for _, t in ROWS]
    label = linked(fp)
    want = sorted(((i, f"{f:016x}", min((ROWS[k][0] for k in np.flatnonzero(label == c) if ROWS[k][0] is not None), default=None)) for (i, _), f, c in zip(ROWS, fp, label, strict=True)), key=repr)
    assert by_row(simhash.near_groups(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_groups(nothing).count() == 0
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns and sorted({r.doc_id for r in left.collect() if r.doc_id is not None}) == sorted({c for _, _, c in want if c is not None})


@pytest.mark.parametrize("chunk", [7, 20_000])
def test_links_lose_nothing(spark, chunk):
    """Chains and dense groups of fingerprints; a small chunk deals hot keys as pairs of chunks."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 12).astype(np.uint64)
    fp = [base]
    for _ in range(25):
        flips = np.zeros(12, np.uint64)
        for _ in range(rng.integers(0, 5)):
            flips |= np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64)
        fp.append(fp[-1] ^ flips)
    fp = np.unique(np.concatenate(fp))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    got = {r.u: r.v for r in components.components(simhash.links(df, 4, chunk)).collect()}
    ids = fp.view(np.int64)
    mine = [got.get(int(x), int(x)) for x in ids]
    want = linked(fp)
    assert len(set(zip(mine, want.tolist(), strict=True))) == len(set(mine)) == len(set(want.tolist()))


def test_gray_rank_and_parts():
    codes = np.arange(4096, dtype=np.uint64)
    assert (simhash.gray_rank(codes ^ (codes >> np.uint64(1))) == codes).all()
    parts = simhash.part_bounds(4)
    assert len(parts) == 5 and sum(n for _, n in parts) == 64 and [a for a, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, **{k: 100 for k in range(101, 160)}}


# --- 9 and 10 -----------------------------------------------------------------------------------------------------


def labelled(n, seed):
    rng = random.Random(seed)
    syllables = "an the re in on er st ti ou ha".split()
    rows = []
    for i in range(n):
        text = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(9)) + "." for _ in range(rng.randint(2, 7))]
        toxic, good = i % 5 == 0, i % 3 != 0
        if toxic:
            text.insert(1, rng.choice(["what an idiot you are", "utterly stupid nonsense", "a pathetic clown"]))
        body = " ".join(text)
        rows.append((i, body if good else " ".join(w + "%%%" for w in body.split()), int(good), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def sample(spark):
    rows = labelled(240, 11)
    return spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int"), rows


def test_toxicity(sample, docs, nothing):
    texts, labels, rows = sample
    machine = toxicity.trained(texts, labels)
    got = {r.doc_id: r for r in toxicity.score(texts, machine).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r.held_out} == {r[0] for r in held}
    assert np.mean([got[i].predicted == x for i, _, _, x in held]) > 0.9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    s = machine.score([b"you id-iot", b"you are an idi0t", b"the ha re ou", b""])
    assert s[0] > 0.5 and s[1] > 0.5 and s[2] < 0.5 and s[3] < 0.5
    assert toxicity.score(docs, machine).count() == len(ROWS) and toxicity.score(nothing, machine).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.trained(docs, labels.where("false"))).collect()} == {0.0}
    assert all(r.held_out is False for r in toxicity.score(docs, machine).where("doc_id IS NULL").collect())


def test_toxicity_scores_each_text_alone():
    rows = labelled(80, 3)
    machine = toxicity.train([t.encode() for _, t, _, _ in rows], [x for _, _, _, x in rows])
    texts = [t.encode() for _, t, _, _ in rows] + [b"", b" ", b"ab", LONG.encode(), b" idiot", b"x" * 300_000]
    z = machine.evidence(texts)
    assert np.allclose(machine.score(texts), 1 / (1 + np.exp(-np.clip(machine.slope * z + machine.level, -30, 30))))


@pytest.mark.parametrize("run", [b"A", b"a\n", b"ab1/"])
def test_toxicity_ends_on_texts_without_blanks(run):
    """A long run, white space other than blanks, then an insult: linear time, and the insult is found."""
    rows = labelled(80, 3)
    machine = toxicity.train([t.encode() for _, t, _, _ in rows], [x for _, _, _, x in rows])
    insult = next(t for _, t, _, x in rows if x).encode()
    times = []
    for n in (1_000_000, 2_000_000):
        began = time.perf_counter()
        z = machine.evidence([run * (n // len(run)) + b" " + insult, run * (n // len(run)) + b"\n" + insult])
        times.append(time.perf_counter() - began)
        assert (z >= machine.evidence([insult])[0] - 1e-6).all()
    assert times[1] < 4 * times[0] + 1 and times[0] < 12


def test_toxicity_parts_of_long_texts():
    a, again = toxicity.AT_ONCE, toxicity.AGAIN
    for blank in (b"", b" ", b"\n", b"\t"):
        for n in [*range(a - 2, a + 3), 3 * a, 3 * a + again]:
            text = b"".join(b"%07d" % i + blank for i in range(n // 7 + 1))[:n]
            at, end = 0, 0
            for k, p in enumerate(toxicity.parts(text)):
                start = text.index(p[:600], max(0, end - again)) if k else 0
                assert p == text[start : start + len(p)] and len(p) <= a and start <= end and (not k or start - at >= a - again)
                at, end = start, start + len(p)
                assert not blank or (start == 0 or text[start : start + 1] == blank) and (end == n or text[end : end + 1] == blank)
            assert end == n


def test_string_kernel_features_agree_with_the_table():
    words = ["idiot", "idixot", "nothing", "idiotic"]
    table = np.zeros(toxicity.CODES**toxicity.LENGTH)
    for f, v in toxicity.features(["idiot"])[0].items():
        table[f] = v
    got = toxicity.Words(" ".join(words).encode()).scores(table)
    want = [sum(v * table[f] for f, v in g.items()) for g in toxicity.features(words)]
    assert np.allclose(got, want, atol=1e-5) and got[0] > got[1] > got[2]


def test_quality(sample, docs, nothing):
    texts, labels, rows = sample
    net = quality.trained(texts, labels)
    got = {r.doc_id: r for r in quality.score(texts, net).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == {r[0] for r in held}
    assert np.mean([got[i].predicted == q for i, _, q, _ in held]) > 0.9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert quality.score(docs, net).count() == len(ROWS) and quality.score(nothing, net).count() == 0
    kept = quality.keep_good(docs, net)
    assert kept.columns == docs.columns
    assert kept.count() == quality.score(docs, net).where("predicted = 1").count()
    assert quality.keep_good(docs, quality.trained(docs, labels.where("false"))).count() == len(ROWS)


def test_quality_chunks_cover_everything():
    for n in (0, 1, 5, 191, 192, 193, 352, 353, 1000):
        data, valid, doc = quality.chunks([bytes(range(1, 251)) * 5][:1] if n == 1000 else [b"x" * n])
        assert len(data) == len(valid) == len(doc) and (valid >= 1).all()
    text = bytes(random.Random(1).randrange(1, 255) for _ in range(2000))
    data, _, _ = quality.chunks([text])
    assert all(text[k : k + quality.WIDTH] in b"\0".join(map(bytes, data)) for k in range(len(text) - quality.WIDTH))


def test_folds(spark):
    r = spark.range(50).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(x.f == zlib.crc32(str(x.id).encode()) % 5 for x in r)


@pytest.mark.parametrize("cue", ["Tax ID", "tax ID", "TAX id", "Customer ID", "customer ID", "License no"])
def test_pii_cues_in_any_case(cue):
    text = f"İ {cue}: 12-3456789."
    assert [(k, text[a:b]) for k, a, b in pii.spans(text)] == [("account", "12-3456789")]
    assert pii.spans("see hTTps://a.b/c")[0] == ("url", 4, 17)


@pytest.mark.parametrize("iban,after", [("BE68 5390 0754 7034", " for rent"), ("ES91 2100 0418 4502 0005 1332", " from me"), ("AT61 1904 3002 3457 3201", " please"), ("DE89370400440532013000", "."), ("NO93 8601 1117 947", " and more")])
def test_pii_ibans_end_at_their_length(iban, after):
    for before in ("IBAN: ", "account ", "pay to ", ""):
        text = before + iban + after
        assert [text[a:b] for k, a, b in pii.spans(text) if k == "account"] == [iban]
    wrong = "pay to " + iban[:2] + ("00" if iban[2:4] != "00" else "01") + iban[4:] + after
    assert not [s for s in pii.spans(wrong) if s[0] == "account"]


# --- 10, against plain versions -----------------------------------------------------------------------------------


def test_quality_reads_every_byte_of_short_texts():
    """In texts of 0 to 400 bytes a change of any byte reaches some filter at a place that counts."""
    for n in range(401):
        marked = [b"a" * k + b"Z" + b"a" * (n - k - 1) for k in range(n)]
        data, valid, doc = quality.chunks([b"a" * n, *marked])
        counts = np.arange(quality.PLACES) < valid[:, None]
        seen = np.zeros(len(data), bool)
        for tap in quality._taps(data):
            seen |= ((tap == ord("Z")) & counts).any(1)
        assert set(doc[seen].tolist()) == set(range(1, n + 1)), n


def small_network(seed=5):
    rng = np.random.default_rng(seed)
    E, F_, H, W_ = quality.EMBEDDED, quality.FILTERS, quality.HIDDEN, quality.WIDTH
    shapes = {"embed": (256, E), "filter": (W_ * E, F_), "filter_b": (F_,), "dense": (3 * F_, H), "dense_b": (H,), "out": (2 * H,), "out_b": ()}
    p = {k: rng.normal(0, 0.4, s) for k, s in shapes.items()}
    return p | {"mu": rng.normal(0, 0.1, 3 * F_), "sd": np.full(3 * F_, 1.3)}


def plain_score(p, text):
    """The network one place at a time."""
    last, hidden = max(0, len(text) - quality.CHUNK), []
    for at in [*range(0, last, quality.CHUNK - quality.OVERLAP), last]:
        piece = text[at : at + quality.CHUNK]
        n = max(1, -(-(len(piece) - quality.WIDTH) // quality.STRIDE) + 1)
        piece = piece.ljust(quality.STRIDE * n + quality.WIDTH, b"\0")
        act = []
        for k in range(n):
            x = np.concatenate([p["embed"][b] for b in piece[quality.STRIDE * k : quality.STRIDE * k + quality.WIDTH]])
            act.append(np.maximum(x @ p["filter"] + p["filter_b"], 0))
        act = np.array(act)
        mean = act.mean(0)
        hidden.append(np.tanh((np.concatenate([act.max(0), mean, 4 * mean**2]) - p["mu"]) / p["sd"] @ p["dense"] + p["dense_b"]))
    pooled = np.concatenate([np.max(hidden, 0), np.mean(hidden, 0)])
    return 1 / (1 + np.exp(-(pooled @ p["out"] + p["out_b"])))


def test_quality_equals_a_plain_forward_pass():
    p, rng = small_network(), random.Random(3)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 6, 7, 8, 50, 191, 192, 193, 400, 1000)]
    assert np.allclose(quality.Network(p).score(texts), [plain_score(p, t) for t in texts], atol=1e-4)


def test_quality_gradients_are_the_slopes_of_the_loss():
    p, rng = small_network(7), random.Random(4)
    texts = [bytes(rng.randrange(97, 123) for _ in range(n)) for n in (9, 250, 40)]
    data, valid, doc = quality.chunks(texts)
    n, y, weight = np.bincount(doc), np.array([1.0, 0.0, 1.0]), np.array([1.0, 1.5, 1.0])

    def loss(q):
        s = np.array([plain_score(q, t) for t in texts])
        decay = sum(0.5e-4 * (q[k] ** 2).sum() for k in ("filter", "dense", "out"))
        return float((-weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).mean() + decay)

    got = quality._gradients(p, data, valid, n, y, weight, False)
    for k in ("filter", "filter_b", "dense", "dense_b", "out", "out_b", "embed"):
        flat = np.atleast_1d(got[k]).reshape(-1)
        for i in np.argsort(-np.abs(flat))[:4]:
            sides = []
            for d in (1e-5, -1e-5):
                moved = np.array(p[k], float)
                moved.reshape(-1)[i] += d
                sides.append(loss(p | {k: moved}))
            assert np.isclose((sides[0] - sides[1]) / 2e-5, flat[i], rtol=2e-2, atol=1e-5), k


# --- 3, long runs -------------------------------------------------------------------------------------------------

RUNS = [
    lambda n: "7" * n, lambda n: "account" + " " * n + "!", lambda n: "a@" + "b" * n, lambda n: "a" * n + "@", lambda n: "1." * (n // 2), lambda n: "+1" + " " * n, lambda n: "1 " * (n // 2), lambda n: "@" * n,
    lambda n: "xhttp://a/" * (n // 10), lambda n: "a@b" * (n // 3), lambda n: "account " * (n // 8), lambda n: "no:" * (n // 3), lambda n: "account" + " no:" * (n // 4), lambda n: "BE68 5390 0754 7034 " * (n // 20), lambda n: "+1-2" * (n // 4),
]


@pytest.mark.parametrize("k", range(len(RUNS)))
def test_pii_of_long_runs(k):
    text = RUNS[k](10_000)
    assert [s for s in pii.spans(text) if s[0] in pii.BASE] == searched(text)
    long = RUNS[k](1_000_000)
    began = time.process_time()
    pii.masked(long, pii.spans(long))
    assert time.process_time() - began < 4


def test_pii_identifier_after_words():
    for text, want in (("account number12", "number12"), ("Account No. AB-12345", "AB-12345"), ("acct # : id is 998877", "998877"), ("account number: idea99", "idea99"), ("account no one here", None)):
        assert [text[a:b] for k, a, b in pii.spans(text) if k == "account"] == [want] * (want is not None)


# --- 2, identities ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1024, 4096])
def test_substring_dedup_tells_thue_morse_words_apart(spark, size):
    """Words that any polynomial hash modulo 2**64 with an odd base takes for one."""
    word = "".join("ab"[k.bit_count() & 1] for k in range(size))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{word} {SENTENCE}"), (2, f"{other} {SENTENCE}"), (3, " ".join([word] * 13)), (4, " ".join([other] * 13)), (5, " ".join([word] * 12 + [other])), (6, " ".join([word] * 13))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_row(substring_dedup.remove_repeats(df), "doc_id", "n_words", "n_removed", "kept_text") == repeats(rows)


def test_substring_identities_are_those_of_words():
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "b", "ab", "ba", "é"]) for _ in range(60)) for _ in range(20)]
    table = pa.table({"doc_id": list(range(20)), "text": texts})
    g = substring_dedup.Group(table, b"k" * 32)
    places = np.flatnonzero(g.inside(5))
    both = list(zip(g.identity(5, 0, places).tolist(), g.identity(5, 1, places).tolist(), strict=True))
    data = g.data.tobytes()
    shown = [tuple(data[g.starts[p + k] : g.ends[p + k]] for k in range(5)) for p in places]
    assert len(set(both)) == len(set(shown)) == len(set(zip(both, shown, strict=True)))


def test_substring_groups_follow_the_bytes(spark):
    """Many small groups and buckets give what few give."""
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{rng.randrange(3)}" for _ in range(rng.randint(0, 80)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_row(substring_dedup.remove_repeats(df, 6, group_bytes=500), "doc_id", "n_words", "n_removed", "kept_text")
    assert got == repeats(rows, 6)


def test_substring_packing():
    rng = np.random.default_rng(2)
    for bits, n in ((12, 0), (12, 5), (30, 1), (30, 4000), (52, 3), (9, 300)):
        v = np.sort(rng.integers(0, 1 << bits, n).astype(np.uint64))
        assert (substring_dedup._unpacked(*substring_dedup._packed(v, bits), n) == v).all()
        flags = rng.integers(0, 4, n).astype(np.uint8)
        assert (substring_dedup._from_bits(substring_dedup._bits_of(flags), n) == flags).all()


# --- queries with SQL ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, duck, name):
    def plain(df):
        return sorted((tuple(None if x is None or x != x else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)

    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert plain(got) == plain(want)


# --- 6 and 8, rows of one id, hot keys ----------------------------------------------------------------------------


def test_exact_dedup_keeps_one_of_repeated_rows(docs):
    groups = {}
    for i, t in ROWS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    left = exact_dedup.drop_copies(docs, repeats=False)
    assert left.columns == docs.columns
    got = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in left.collect()]
    assert sorted(got, key=repr) == sorted(((min((i for i in ids if i is not None), default=None), body) for body, ids in groups.items()), key=repr)


def test_exact_dedup_of_hot_groups(spark):
    """A text that a third of all rows has, with ids, without and under one id."""
    rows = [(i if i % 3 else None if i % 2 else 5, "hot  text" if i % 3 == 0 else f"t{i % 700}") for i in range(3000)]
    want = {}
    for i, t in rows:
        want.setdefault(re.sub(" +", " ", t), []).append(i)
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(9)).collect()
    assert len(got) == len(rows)
    for body, ids in want.items():
        sha, keep = hashlib.sha256(body.encode()).hexdigest(), min(i for i in ids if i is not None)
        mine = [r for r in got if r.text_sha256 == sha]
        assert sorted((r.doc_id for r in mine), key=repr) == sorted(ids, key=repr) and {(r.keep_id, r.group_size) for r in mine} == {(keep, len(ids))}
        assert sum(r.kept for r in mine) == ids.count(keep)


def test_looked_up(spark, monkeypatch):
    monkeypatch.setattr("quillon.llm.common.HOT", 4)
    keys = [1] * 50 + [2] * 3 + [3] * 20 + [4, 5, 6]
    rows = spark.createDataFrame([(k, f"r{i}") for i, k in enumerate(keys)], "k long, name string")
    table = spark.createDataFrame([(k, keys.count(k), None if k == 3 else f"v{k}") for k in (1, 2, 3, 4, 9)], "k long, n long, value string")
    got = sorted((r.k, r.name, r.value) for r in looked_up(rows, table, "k", "n", len(keys)).fillna("-").collect())
    assert got == sorted((k, f"r{i}", f"v{k}" if k in (1, 2, 4) else "-") for i, k in enumerate(keys))


def test_near_copies_under_one_id(spark):
    one, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"x{i}" for i in range(60))
    rows = [(3, one), (11, one), (11, other), (12, other), (None, one), (None, "z y x"), (20, "")]
    left = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert by_row(left, "doc_id", "text") == sorted([(3, one), (11, other), (None, "z y x"), (20, "")], key=repr)


@pytest.mark.parametrize("n,blocks", [(10, 5), (8 * 10**6, 5), (10**8, 6), (10**9, 6), (10**10, 7), (10**12, 8)])
def test_blocks_follow_the_count(n, blocks):
    assert simhash.blocks_for(n, 4, 2048) == blocks
    parts = simhash.block_bounds(blocks)
    assert sum(b for _, b in parts) == 64 and [a for a, _ in parts] == np.cumsum([0, *[b for _, b in parts]])[:-1].tolist()


@pytest.mark.parametrize("bucket,chunk", [(0, 20_000), (1, 3)])
def test_links_lose_nothing_with_more_blocks(spark, bucket, chunk):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**64, 150, dtype=np.uint64)
    flips = [np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 7)).astype(np.uint64)) for _ in base]
    fp = np.unique(np.concatenate([base, base ^ np.array(flips, np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    got = {r.u: r.v for r in components.components(simhash.links(df, 4, chunk, bucket=bucket)).collect()}
    mine, want = [got.get(int(x), int(x)) for x in fp.view(np.int64)], linked(fp)
    assert len(set(zip(mine, want.tolist(), strict=True))) == len(set(mine)) == len(set(want.tolist()))


def test_scratch_is_dropped_and_needs_a_shared_folder(spark, monkeypatch):
    path = scratch(spark, "x")
    spark.range(3).write.parquet(path)
    drop_scratch(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


# --- 9, gaps that are blanks --------------------------------------------------------------------------------------


def plain_pieces(text):
    """The words, and what joining neighbours gives."""
    w = [x for x in ("".join(chr(96 + c) for c in toxicity.ALPHABET[list(x)].tolist() if c < 255) for x in re.split(rb"[ \t-\r]", text)) if x]
    out = list(w)
    for most in (1, 2):
        run = []
        for x in [*w, "---"]:
            if len(x) <= most:
                run.append(x)
                continue
            if len(run) > 1:
                out.append("".join(run))
            run = []
    out += [a + b for a, b in zip(w, w[1:]) if min(len(a), len(b)) <= toxicity.SHORT and len(a) + len(b) <= toxicity.JOINED and not (len(a) <= 2 and len(b) <= 2)]
    return out


def test_pieces_of_sentences():
    rng = random.Random(7)
    for n in range(400):
        text = " ".join("".join(rng.choice("abcde.-") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 9))).encode()
        words = toxicity.Words(text, joined=True)
        assert sorted(words.string(k) for k in range(len(words))) == sorted(plain_pieces(text)), text
        table = np.random.default_rng(n).normal(size=toxicity.CODES**toxicity.LENGTH)
        want = {s: sum(v * table[f] for f, v in g.items()) for s, g in ((s, toxicity.features([s])[0]) for s in set(plain_pieces(text)))}
        assert np.allclose(words.scores(table), [want[words.string(k)] for k in range(len(words))], atol=1e-3)
    texts = [b"i d", b"i o t", b"id", b"iot is"]
    starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    words = toxicity.Words(b" ".join(texts), True, starts)
    assert sorted(words.string(k) for k in range(len(words))) == sorted(x for t in texts for x in plain_pieces(t))


@pytest.fixture(scope="module")
def insults():
    rows = labelled(240, 11)
    return toxicity.train([t.encode() for _, t, _, _ in rows], [x for _, _, _, x in rows])


def test_insults_with_blanks_and_letters_put_in(insults):
    bad = [b"you i d i o t", b"an id iot indeed", b"you are an i d io t", b"what an i-d-i-o-t", b"so pathe tic", b"p a t h e t i c", b"an IDIOT"]
    clean = [b"the an re in on", b"a b c d e f g h", b"in er st ti", b"1 2 3 4 5", b"st on er in th an"]
    assert [s > 0.5 for s in insults.score(bad)] == [True] * len(bad) and [s < 0.5 for s in insults.score(clean)] == [True] * len(clean)
    far = b"the re " * 60_000 + b"i d i o t" + b" the re" * 60_000
    assert insults.score([far])[0] > 0.5


def test_nystroem_map_and_machine_against_plain_versions():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcd"), rng.integers(3, 8))) for _ in range(40)]
    dense = np.zeros((len(words), toxicity.CODES**toxicity.LENGTH), np.float32)
    for i, g in enumerate(toxicity.features(words)):
        for f, v in g.items():
            dense[i, f] = v
    k = dense @ dense.T
    marks = list(range(12))
    values, vectors = np.linalg.eigh(k[np.ix_(marks, marks)])
    good = values > 1e-6 * values[-1]
    mapped = k[:, marks] @ (vectors[:, good] / np.sqrt(values[good]))
    assert np.allclose((mapped @ mapped.T)[np.ix_(marks, marks)], k[np.ix_(marks, marks)], atol=1e-3)  # exact on the landmarks
    x, y, weight = np.hstack([mapped, np.ones((40, 1))]), np.where(rng.random(40) < 0.5, 1.0, -1.0), rng.random(40) + 0.5
    w = toxicity._newton(x, y, weight, c=5.0, steps=60)
    loss = lambda v: 0.5 * v @ v + 2.5 * (weight * np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
    for _ in range(200):
        assert loss(w + rng.normal(0, 0.05, len(w))) >= loss(w) - 1e-6


def test_labelled_sample_is_bounded(spark):
    from quillon.llm.learning import labelled_sample

    docs = spark.createDataFrame([(i, "x" * i) for i in range(1, 60)] + [(7, "w"), (7, "zz"), (8, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 80)] + [(7, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    texts, known = labelled_sample(docs, labels, "toxic", 5, 0, 1000)
    ids = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 5]
    want = {i: "w" if i == 7 else "" if i == 8 else "x" * i for i in ids}
    assert texts == [want[i] for i in ids] and known == [0 if i == 7 else i % 2 for i in ids]
    few, _ = labelled_sample(docs, labels, "toxic", 5, 0, 10)
    assert len(few) <= 10
    small, _ = labelled_sample(docs, labels, "toxic", 5, 0, 1000, most_bytes=100)
    assert 0 < sum(map(len, small)) <= 100


def test_orc_files_have_stripes_an_index_and_bloom_filters(spark):
    """Many rows of one id and without one spread over files; the files have what skips need."""
    rows = [(5 if i % 3 == 0 else None if i % 3 == 1 else i, f"t{i} " * 40) for i in range(6000)]
    path = scratch(spark, "orc")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    orc_tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path, WORD, stripe_bytes=1 << 14, row_stride=1000)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = orc_tokens.read_tokens(spark, path)
    sizes = [r["count"] for r in read.groupBy("part").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 0.6 * len(rows)
    got = orc_tokens.summary(spark, path).orderBy("start").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert [r.start for r in got] == list(np.cumsum([0, *(r.n_tokens for r in got)])[:-1])
    conf, j = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm
    where = j.org.apache.hadoop.fs.Path(path)
    files = [f.getPath() for f in where.getFileSystem(conf).listStatus(where) if f.getPath().getName().endswith(".orc")]
    kinds, stripes = set(), 0
    for f in files:
        reader = j.org.apache.orc.OrcFile.createReader(f, j.org.apache.orc.OrcFile.readerOptions(conf))
        stripes += reader.getStripes().size()
        records = reader.rows()
        for s in reader.getStripes():
            footer = records.readStripeFooter(s)
            kinds |= {str(x.getKind()) for x in footer.getStreamsList()}
            assert {str(c.getKind()) for c in footer.getColumnsList()} <= {"DIRECT", "DIRECT_V2"}
        records.close()
    assert stripes >= len(files) and "ROW_INDEX" in kinds and "BLOOM_FILTER_UTF8" in kinds


# --- 7, against a plain version -----------------------------------------------------------------------------------


def plain_place(lengths, capacity):
    """Every open gap that fits is tried, and a new bin; the least sum of squares wins, then the smaller gap, then an open bin."""
    gaps, bins = [], []
    for s in lengths:
        options = []
        for gap in sorted({g for g in gaps if g >= s}) + [None]:
            after = list(gaps)
            if gap is None:
                after.append(capacity - s)
            else:
                after[max(i for i, g in enumerate(gaps) if g == gap)] = gap - s
            counts = np.bincount(after, minlength=capacity + 1)[1:]  # full bins are not open
            options.append(((counts**2).sum(), capacity if gap is None else gap, gap))
        _, _, gap = min(options, key=lambda o: o[:2])
        if gap is None:
            gaps.append(capacity - s)
        else:
            gaps[max(i for i, g in enumerate(gaps) if g == gap)] = gap - s
        bins.append(sorted(gaps))
    return bins


def test_sum_of_squares_against_every_choice():
    rng = np.random.default_rng(6)
    for capacity in (7, 12, 20):
        for _ in range(60):
            lengths = rng.integers(1, capacity + 1, 25)
            want = plain_place(lengths.tolist(), capacity)
            bins, offsets = packing.place(lengths, capacity)
            for k in range(len(lengths)):
                fill = np.bincount(bins[: k + 1], lengths[: k + 1], minlength=bins[: k + 1].max() + 1)
                assert sorted((capacity - fill).astype(int).tolist()) == want[k]


def test_packing_in_passes():
    rng = np.random.default_rng(2)
    for lengths in (rng.integers(1, 1024, 20_000), np.full(50, 1023), np.full(7, 512), np.array([1024]), rng.integers(1, 40, 3000)):
        bins, offsets = packing.place_all(lengths, 1024)
        fill = np.bincount(bins, lengths)
        assert fill.max() <= 1024 and fill.min() > 0 and len(fill) <= packing.place(-np.sort(-lengths), 1024)[0].max() + 1
        order = np.lexsort((offsets, bins))
        ends, starts, same = (offsets + lengths)[order][:-1], offsets[order][1:], bins[order][1:] == bins[order][:-1]
        assert (starts[same] == ends[same]).all() and (starts[~same] == 0).all() and offsets[order][0] == 0


def test_stuttering_gathers_no_evidence(insults):
    for bit in (b"ar ", b"io ", b"i d i o ", b"st ", b"a b c "):
        few, many = insults.evidence([bit * 5, bit * 400])
        assert many <= max(few, -0.5) + 0.3
    c = toxicity.Words(b"ab" * 40)
    got: dict[tuple, float] = {}
    letters = [31, *[1, 2] * 40, 31]
    for offsets, weight in toxicity.WAYS:
        for i in range(len(letters) - offsets[-1]):
            key = tuple(letters[i + o] for o in (0, *offsets))
            got[key] = got.get(key, 0.0) + weight
    assert np.isclose(c._own_norm(0), sum(v * v for v in got.values()) ** 0.5)


# --- 1, block by block --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1, 7, 40])
def test_bpe_blocks_change_nothing(monkeypatch, block):
    monkeypatch.setattr(bpe, "BLOCK", block)
    tok, c, rng = Tokenizer.from_file(BYTE), bpe.codec(BYTE), random.Random(block)
    alphabets = ["ab é日本 \n", "a1 _-'s  \t", "日本語　 x\x1c\x85 ", "wörter ünd  zahlen 12 34 ", "İß  \n\n a", "½² ¼a٣ 4 "]
    for n in range(600):
        t = "".join(rng.choice(alphabets[n % len(alphabets)]) for _ in range(rng.randint(0, 120)))
        assert bpe.digests(c, t) == library_digests(t, tok), repr(t)


def test_bpe_holds_a_block(monkeypatch):
    c, seen = bpe.codec(BYTE), []
    monkeypatch.setattr(bpe, "BLOCK", 1000)
    odd = c._odd
    monkeypatch.setattr(c, "_odd", lambda t: seen.append(len(t)) or odd(t))
    ids = b"".join(c.encode("日本 text ünd so weiter " * 4000))
    assert max(seen) < 1100 and len(seen) > 50 and np.frombuffer(ids, "<u4").tolist() == Tokenizer.from_file(BYTE).encode("日本 text ünd so weiter " * 4000, add_special_tokens=False).ids
