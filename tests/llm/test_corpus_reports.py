"""Phrase collocations, source divergence and packing against brute force and the library, on odd tables and in small pieces."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import best_fit_packing, collocations, common, contract, lexicon_bpe, source_divergence, token_stream

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t ", "one", "Two words two WORDS", "a" * 3000, "x y " * 2000, "é😀 ñ <|endoftext|> b.c é😀 ñ", "same text here now", "same text here now", " x\x00y z", "a, b; c. d: e! f?", "Ж жа ÀÉ straße"]


def odd(spark, rows=ODD):
    """Ids, some null or repeated, sources and languages that are null, and columns whose names clash with the operators' own."""
    data = [(None if i in (4, 6) else 3 if i == 5 else i, t, "s" if i % 2 else None, "L" if i % 3 else None, i, "k", [i], i, i) for i, t in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, source string, lang string, n long, term string, counts array<int>, uid int, rank int")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_phrases(rows, least, subsumed, scale, most):
    """rows: (lang, text)."""
    f = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        frequent = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = {p: a for p, a in frequent.items() if not any(len(q) > len(p) and 100 * b >= subsumed * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in frequent.items())}
        scored = []
        for p, a in kept.items():
            cuts = [(scale * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), " ".join(p), a, c[p[:k]], c[p[k:]], n, score))
        out += [(lang, i, *x[3:]) for i, x in enumerate(sorted(scored)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("words", [10**6, 30])
def test_phrases_like_brute_force(spark, monkeypatch, words):
    rng = random.Random(3)
    rows = [(rng.choice(["en", "fr", None]), rng.choice([" ", "\t", "  "]).join(rng.choice(["New", "york", "city", "is", "big", "é", "not.", "so,", "x\x00"]) for _ in range(rng.randrange(60)))) for _ in range(120)] + [("en", t) for t in ODD]
    monkeypatch.setattr(collocations, "WORDS", words)
    df = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string").repartition(3)
    for least, most in ((5, 2000), (12, 7)):
        want = brute_phrases(rows, least, 80, 2_000_000, most)
        assert sorted(tuple(r) for r in collocations.mine(df, least, 80, 2_000_000, most).collect()) == want and want


def test_buckets_only_save_work(spark, monkeypatch):
    rows = [("en", "a b c a b c d")] * 9 + [("en", "b c a")] * 4
    df = spark.createDataFrame(rows, "lang string, text string")
    want = sorted(map(tuple, collocations.phrase_counts(df, 10).collect()))
    monkeypatch.setattr(collocations, "MOST_BUCKETS", 8)  # nearly all grams share a bucket with others
    assert sorted(map(tuple, collocations.phrase_counts(df, 10).collect())) == want
    assert ("en", 3, "b c a", 13) in want and not [x for x in want if x[1] and x[3] < 10]


def test_an_automaton_counts_where_grams_end():
    s = collocations.Shard("en")
    s.add([b"A b a b", b"b. a b"])
    a = s.automaton(3)
    every = np.full((1 << 16) // 8, 255, np.uint8)
    assert {d: dict(zip(x, n.tolist(), strict=True)) for d, x, n in a.grams(16, every)} == {1: {b"a": 3, b"b": 4}, 2: {b"a b": 3, b"b a": 1}, 3: {b"a b a": 1, b"b a b": 1}}
    assert len(a.buckets(16)) == 7 + 4 + 2


def test_products_beyond_64_bits(spark, monkeypatch):
    counts = spark.createDataFrame([("en", 0, "", 10**17), ("en", 1, "a", 6 * 10**16), ("en", 1, "b", 5 * 10**16), ("en", 2, "a b", 5 * 10**16)], "lang string, size int, phrase string, n long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a: counts)
    (got,) = collocations.mine(spark.createDataFrame([], "lang string, text string")).collect()
    assert got.score == 2_000_000 * 5 * 10**16 // (11 * 10**16)


def brute_divergence(rows, least_docs, most):
    """rows: (lang, source, text)."""
    terms = [(la or "", so or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for la, so, t in rows]
    out = []
    for lang in {x[0] for x in terms}:
        own = [(s, w) for la, s, w in terms if la == lang]
        df = collections.Counter(t for _, w in own for t in set(w))
        kept = sorted(t for t, k in df.items() if k >= least_docs)
        groups = {s: collections.Counter() for s, _ in own}
        for s, w in own:
            groups[s].update(t for t in w if df[t] >= least_docs)
        whole = sum(groups.values(), collections.Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in groups.items():
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s)
            tops = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if c[t] and p[s][t] > q[t])[:most]
            out += [(lang, s, part, x, -v, i) for part, found in (("pair", pairs), ("term", tops)) for i, (v, _, x) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("told,block", [(10**6, 128), (20, 2)])
def test_divergence_like_brute_force(spark, monkeypatch, told, block):
    monkeypatch.setattr(source_divergence, "TOLD", told)
    monkeypatch.setattr(source_divergence, "SOURCES", block)
    rng = random.Random(5)
    vocabulary = ["the", "The", "of", "étude", "Étude", "straße", "жук", "x", "xy", "xyz", "日本語", "b2b"]
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "é", "z", None]), " ".join(rng.choices(vocabulary, k=rng.randrange(30)))) for _ in range(150)] + [("en", "empty", None), ("only", "one", "a b"), ("only", "two", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string").repartition(3)
    for least, most in ((3, 10), (40, 2)):
        want = brute_divergence(rows, least, most)
        assert sorted(tuple(r) for r in source_divergence.audit(df, least, most).collect()) == want and want


def test_shares_of_large_counts(spark):
    a, n, v = 8_999_999_999_999_989, 9_000_000_000_000_000, 12_345
    got = spark.range(1).select(source_divergence.share(F.lit(a), F.lit(n), F.lit(v))).first()[0]
    assert got == 1 + 10**9 * (a + 2) // (n + 2 * v)


def test_tries_merge_prefix_by_prefix():
    one, two = source_divergence.Trie(), source_divergence.Trie()
    one.add("s", [b"abcd", b"abcd", b"abce", "жуки".encode()])
    two.add("s", [b"abcd"])
    two.add("t", [b"a", b"abce"])
    whole = source_divergence.Trie()
    for t in (one, two):
        for _, container in t.containers():
            whole.merge(container)
    assert {k for k, _ in one.containers()} == {b"abc", "жу".encode()}
    assert list(whole.walk(1)) == [("a", 1, ["t"], [1]), ("abcd", 2, ["s"], [3]), ("abce", 2, ["s", "t"], [1, 1]), ("жуки", 1, ["s"], [1])]


def library(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(contract.tokenizer_path("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def spec():
    with open(contract.tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.mark.parametrize("most,rows", [(10**9, 20_000), (2000, 3)])
def test_many_texts_get_the_librarys_ids(spark, monkeypatch, most, rows):
    monkeypatch.setattr(token_stream, "MOST_BYTES", most)
    monkeypatch.setattr(token_stream, "ROWS", rows)
    rng = random.Random(6)
    made = ["".join(rng.choice("abcdefgh éßñΣИж日12.,'-!#") for _ in range(rng.randrange(120))) for _ in range(200)]
    texts = [t or "" for t in ODD] + made + ["q" * 47 + " " + "ab" * 24 + "c", "x" * 100_000, "\x1c\x1da b　c"] + [r.text for r in common.table(spark, SF, "documents").limit(60).collect()]
    stream = token_stream.Stream(spec())
    for part in (texts[:50], texts[50:], texts[:20], [], ["", ""]):
        ids, ends = stream.ids(part)
        assert [x.tolist() for x in np.split(ids, ends)[: len(part)]] == library(part)


def test_equal_pairs_merge_from_the_left():
    words = token_stream.Words(spec())
    bpe = lexicon_bpe.Bpe(spec())
    for w in ["aaaa", "aaaaa", "ababab", "lllllll", "eeeeeeeeeeeee", "a", "日日日", "mississippi"]:
        assert np.frombuffer(words.ids([w])[0], "<u4").tolist() == bpe.merge(w)


@pytest.mark.parametrize("seed", range(12))
def test_plans_pack_all_pieces_in_no_more_sequences_than_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 2048])
    counts = {rng.randrange(1, capacity + 1): rng.randrange(1, rng.choice([3, 40, 10**12])) for _ in range(rng.choice([3, 30, 300]))}
    patterns, packed = best_fit_packing.plan(counts, capacity), collections.Counter()
    for lengths, times in patterns:
        assert sum(lengths) <= capacity and times > 0
        for x in lengths:
            packed[x] += times
    assert packed == counts
    n = sum(t for _, t in patterns)
    assert -(-sum(x * k for x, k in counts.items()) // capacity) <= n <= sum(t for _, t in best_fit_packing.best_fit(counts, capacity))
    assert len(patterns) <= 8 * capacity


def test_complements_are_exact():
    assert best_fit_packing.plan({60: 2, 30: 2, 10: 2, 25: 4, 50: 2}, 100) == [((60, 30, 10), 2), ((50, 50), 1), ((25, 25, 25, 25), 1)]
    sums = best_fit_packing.Sums(np.bincount([3, 3, 5, 7], minlength=20).astype(np.int64))
    brute = lambda n: np.bincount([sum(x) for x in np.array(np.meshgrid(*[[3, 5]] * n)).reshape(n, -1).T], minlength=22)[:20]
    sums.take((7,), 1)
    assert sums.two.tolist() == brute(2).tolist() and sums.three.tolist() == brute(3).tolist()


def packed_right(got, texts_by_row, capacity):
    """Every sequence is gapless from 0 and none is longer than the capacity; pieces are cut as they must be."""
    at = collections.defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for rows in at.values():
        upto = 0
        for offset, length in sorted(rows):
            assert offset == upto
            upto += length
        assert upto <= capacity
    want = collections.Counter()
    for doc, ids in texts_by_row:
        ids = [*ids, 0]
        for k, i in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[i : i + capacity], "<u4")
            want[doc, k, i, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    return len(at)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_like_the_library(spark, capacity):
    df = odd(spark).select("doc_id", "text", "uid", "rank").union(common.table(spark, SF, "documents").limit(80).select("doc_id", "text", F.lit(1), F.lit(1))).repartition(3)
    rows = df.collect()
    got = best_fit_packing.pack(df, contract.tokenizer_path("word_bpe_49k.json"), capacity).collect()
    ids = library([r.text for r in rows])
    n = packed_right(got, [(r.doc_id, x) for r, x in zip(rows, ids, strict=True)], capacity)
    assert n <= -(-sum(len(x) + 1 for x in ids) // capacity) + 2


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_odd_and_empty_tables_have_these_values(spark, rows):
    df = odd(spark, rows)
    data = [(r.lang, r.source, r.text) for r in df.collect()]
    assert sorted(tuple(r) for r in collocations.mine(df, 2).collect()) == brute_phrases([(x[0], x[2]) for x in data], 2, 80, 2_000_000, 2000)
    assert sorted(tuple(r) for r in source_divergence.audit(df, 1).collect()) == brute_divergence(data, 1, 10)
    got = best_fit_packing.pack(df, contract.tokenizer_path("word_bpe_49k.json")).collect()
    packed_right(got, list(zip([r.doc_id for r in df.collect()], library([r.text for r in df.collect()]), strict=True)), 2048)
