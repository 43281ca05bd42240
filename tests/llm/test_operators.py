"""The ten operators on small fixtures: against brute force, libraries, or held-out labels; and on odd input."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import common, components, contract, decontamination, host_rules, lexicon_bpe, line_runs, ngram_join, pii_weak, quality_ranker, separator_scan, suffix_dedup, toxicity_mil

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "one", "two words", "a" * 3000, "x y " * 2000, "é😀 ñ <|endoftext|> +1 (415) 555-0100 a.b@c.de", "same text here now", "same text here now"]


def texts(spark, rows):
    """Ids, some null or repeated, and columns whose names clash with the operators' own."""
    data = [(None if i == 4 else 3 if i == 5 else i, t, "src0" if i % 2 else None, "L", i, i, "k", i) for i, t in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, source string, lang string, n_chars long, d long, gone string, rank int")


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF, "documents").cache()


@pytest.fixture(scope="module")
def plain(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def corpus(spark, n=60, seed=1):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefghijkl") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 60))) for _ in range(12)]
    out = []
    for _ in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(["zz", "Y", "b"])
        out.append(rng.choice([" ", "\n"]).join(w))
    return out


@pytest.mark.parametrize("name", contract.QUERIES)
@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_odd_and_empty_tables(spark, tmp_path, name, rows):
    texts(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (3, 1, 0), (99, 0, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "same text here now and then"), (2, None), (None, "")] if rows else [], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = contract.QUERIES[name](spark, str(tmp_path)).collect()
    assert name == "op1_semantic_leaks" or len(got) == len(rows)


def brute_components(rows, n, percent):
    sets = []
    for t in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    return [(i, len(s), label[i]) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("n", "percent", "part"), [(3, 90, 400_000), (5, 80, 400_000), (1, 60, 40)])
def test_ngram_join(spark, monkeypatch, n, percent, part):
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", part)
    rows = corpus(spark)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.jaccard_components(df, n, percent).collect())) == brute_components(rows, n, percent)


def test_a_large_group_of_near_copies_gives_no_more_links_than_members(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for _ in range(500):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append(" ".join(w))
    rows += [" ".join(base[:90] + [f"far{i}x{k}" for k in range(30)]) for i in range(20)]
    made, stored = [], common.stored
    monkeypatch.setattr(ngram_join.common, "stored", lambda df, name: (out := stored(df, name), made.append((name, out.count())))[0])
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(df, 3, 90).collect()}
    first, more = [n for name, n in made if name == "links"]
    assert first < len(rows) and more < dict(made)["open"] and max(n for name, n in made if name in ("labels", "seen", "least")) <= len(rows)
    # Brute force over sets of hashes.
    shingle = ngram_join.Shingler(3)
    sets, label = [set(shingle(t).tolist()) for t in rows], list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if root(i) != root(j) and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    assert got == {i: root(i) for i in range(len(rows))}


def test_components_like_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, 1001 + i) for i in range(300)] + [(2000 + i, 2001 + i) for i in range(90)] + [(1100, 2050)]
    forest = ngram_join.Forest()
    for a, b in edges:
        forest.join(a, b)
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: forest.root(x) for e in edges if e[0] != e[1] for x in e}


def test_rows_without_id_join_nothing_unrelated(spark):
    rng = random.Random(2)
    a, b, c = ([f"{x}{rng.randrange(10**6)}" for _ in range(80)] for x in "abc")
    near = lambda w: " ".join(w[:-1] + ["other"])
    # Real ids at the ends of the range: whatever names a row without one, it must not name a component.
    rows = [(2**63 - 1, " ".join(a)), (None, near(a)), (5, " ".join(b)), (None, near(b)), (None, " ".join(c)), (None, near(c)), (None, ""), (-(2**63), "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.n_shingles) for r in ngram_join.jaccard_components(df, 3, 90).collect()), key=repr)
    assert got == sorted([(2**63 - 1, 2**63 - 1, 78), (None, 2**63 - 1, 78), (5, 5, 78), (None, 5, 78), (None, None, 78), (None, None, 78), (None, None, 0), (-(2**63), -(2**63), 1)], key=repr)
    assert sorted((r.doc_id for r in ngram_join.one_of_each(df, 3, 90).collect() if r.doc_id is not None)) == [-(2**63), 5, 2**63 - 1]


def test_sketches_lose_no_partner():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(400) < keep], rng.integers(0, 2**63, extra, dtype=np.uint64)])) for keep in (0.05, 0.3, 0.9, 0.95, 1) for extra in (0, 3, 90)]
    sets = [s for s in sets if len(s)]
    known = ngram_join.Sketches([ngram_join.sketch(s) for s in sets], np.array([len(s) for s in sets]))
    for percent in (30, 80, 90):
        for i, a in enumerate(sets):
            links = {j for j, b in enumerate(sets) if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))}
            assert links <= set(known.partners(i, percent).tolist())
    far = [rng.integers(0, 2**63, 500, dtype=np.uint64) for _ in range(20)]
    known = ngram_join.Sketches([ngram_join.sketch(s) for s in far], np.full(20, 500))
    assert all(known.partners(i, 80).tolist() == [i] for i in range(20))


def test_divide_skip_is_exact():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        sets = [np.unique(rng.integers(0, 30, rng.integers(1, 40))).astype(np.uint64) for _ in range(20)]
        q, percent = sets[0], int(rng.integers(30, 95))
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= percent * len(np.union1d(q, s))]
        assert sorted(ngram_join.divide_skip(q, ngram_join.Index(sets), percent)) == want


def brute_lines(rows, min_words=5):
    seen, out = set(), []
    for t in rows:
        lines = (t or "").split("\n")
        worded = [k for k, x in enumerate(lines) if WORDS.search(x)]
        gone = set()
        for a in range(len(worded)):
            n = 0
            for b in range(a, len(worded)):
                n += len(WORDS.findall(lines[worded[b]]))
                if n >= min_words:
                    key = tuple(lines[k] for k in worded[a : b + 1])
                    if key in seen:
                        gone.update(worded[a : b + 1])
                    seen.add(key)
                    break
        out.append("\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


@pytest.mark.parametrize("min_words", [1, 5, 7])
def test_line_runs(spark, min_words):
    rows = corpus(spark, 80, 2) + ["a\nb\na\nb\na\nb\n\nc d e", "\n".join(["of it"] * 9)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_runs.deduplicated(df, min_words).collect()}
    assert [got[i] for i in range(len(rows))] == brute_lines(rows, min_words)


def brute_repeats(rows, length):
    raws = [(t or "").encode() for t in rows]
    n = collections.Counter(b[i : i + length] for b in raws for i in range(len(b) - length + 1))
    out = []
    for b in raws:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append([m.span() for m in re.finditer(b"\1+", bytes(gone))])
    return out


@pytest.mark.parametrize("limit", [8192, 8])
def test_suffix_dedup(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "LIMIT", limit)
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh") for _ in range(400))
    rows = [None, "", "short", base, base, base[:200] + "X" + base[200:], "a" * 300, "ab" * 100, "é" * 60 + base[:21]]
    rows += [base[k : k + rng.randrange(15, 120)] + "".join(rng.choice("xyz") for _ in range(20)) for k in (rng.randrange(300) for _ in range(80))]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: [(x.start, x.end) for x in r.spans] for r in suffix_dedup.removed(df, 20).collect()}
    assert [got[i] for i in range(len(rows))] == brute_repeats(rows, 20)


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(2)
    for _ in range(50):
        runs = [sorted("".join(rng.choice("ab") for _ in range(rng.randrange(8))).encode() for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 7))]
        merged = list(suffix_dedup.LoserTree([suffix_dedup.front_coded(r) for r in runs]))
        want = sorted(x for r in runs for x in r)
        assert [s for *_, s in merged] == want
        assert [n for _, _, n, _ in merged][1:] == [suffix_dedup.common_prefix(a, b, 0) for a, b in zip(want, want[1:], strict=False)]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, m):
    d = [int(c) for c in m if c.isdigit()][::-1]
    luhn = sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(d)) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(v) <= 255 for v in m.split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]


def test_pii_base_spans(spark, plain):
    rows = [*plain.values(), "a@b.c_d@e.f 1.2.3.4.5.6.7.8 0001.2.3.255 256.1.1.1 +1 (415) 555-0100- 4111 1111-1111 1111 ñ x@y +123", "1.1.1.1" * 50 + "9" * 5000, "password = hunter22x token: abcdefghi"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.b, r.a) for r in pii_weak.spans(df).select("doc_id", pii_weak.digest(F.col("base")).alias("b"), pii_weak.digest(F.col("added")).alias("a")).collect()}
    for i, t in enumerate(rows):
        want = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, t) if holds(kind, m[0]))
        assert got[i][0] == ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want)


def test_pii_adds_whole_secrets_and_what_only_labelers_find(spark, plain):
    rng = random.Random(6)
    key = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGH0123456789") for _ in range(n - 2)) + "a7"
    secrets = ["sk-" + key(161), "token=" + key(300), "AKIA" + key(40).upper(), "ghp_" + key(36)]
    rows = [f"the key is {x} and more" for x in secrets for _ in range(5)] + ["please call 415-555-0100 today"] * 5 + ["ring 0049 30 1234 5678 now"] * 5
    df = spark.createDataFrame(list(enumerate([*rows, *plain.values()])), "doc_id long, text string")
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.added] for r in pii_weak.spans(df).where(f"doc_id < {len(rows)}").collect()}
    for i, x in enumerate(x for x in secrets for _ in range(5)):
        assert ("secret", 11, 11 + len(x)) in got[i], x[:8]
    assert all(("phone", 12, 24) in got[i] for i in range(20, 25)) and all(("phone", 5, 22) in got[i] for i in range(25, 30))
    # The classifier's probability alone decides: a vote of the regex labeler is no condition.
    both = [("ip", "+++++", 500), ("ip", "-++++", 60), ("ip", "-0--0", 300)]
    chance = pii_weak.span_classifier(both, pii_weak.reliabilities(both)[1])
    assert chance[1] >= 0.5 > chance[2]
    long = [("token=" + "9" * 300_000,), ("sk-" + "a" * 300_000,), ("call " + "1(" * 100_000,)]
    assert pii_weak.spans(spark.createDataFrame([(i, *t) for i, t in enumerate(long)], "doc_id long, text string")).count() == 3


def test_bpe_like_the_library(spark, docs, plain):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(contract.tokenizer_path("word_bpe_49k.json"))
    extra = ["", "<|endoftext|> a <|STARTOFTEXT|>x<|startoftext|>", "ΑΣ ΣΑΣ. İstanbul it's 12½ x\x1cy  z", "é́Å 😀👍🏽", "don't we'll THEY'RE 'S", "\x85​ a", "ŉ ǅ ß ẞ", "ab" * 3000, "日本語 ไทย हिन्दी"]
    rows = list(plain.values()) + extra
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    built = lexicon_bpe.build(docs, contract.tokenizer_path("word_bpe_49k.json"), 2000)
    got = {r.doc_id: r for r in lexicon_bpe.encode(df, built, ("n_tokens", "ids", "decoded", "ids_sha256")).collect()}
    for i, t in enumerate(rows):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].decoded == lib.decode(ids, skip_special_tokens=False)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    back = lexicon_bpe.decode(spark.createDataFrame([(0, got[0].ids), (1, None)], "i int, ids array<int>"), built).orderBy("i").collect()
    assert [r.decoded for r in back] == [got[0].decoded, None]


def test_long_words_merge_alike_and_fast():
    import time

    with open(contract.tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        bpe = lexicon_bpe.Bpe(f.read())
    rng = random.Random(1)
    for n in (49, 50, 64, 200, 600):
        for letters in ("ab", "etaoinshrdlu", "é日a"):
            word = "".join(rng.choice(letters) for _ in range(n))
            ids = [bpe.first[b] for b in word.encode()]
            ids[-1] = bpe.last[word.encode()[-1]]
            plain = list(ids)
            while best := min(((r, i) for i in range(len(plain) - 1) if (r := bpe.rank.get((plain[i], plain[i + 1])))), default=None):
                plain[best[1] : best[1] + 2] = [best[0][1]]
            assert bpe.merge_long(ids) == plain
    began = time.time()
    assert len(bpe.merge("".join(rng.choice("etaoinshrdlu") for _ in range(300_000)))) < 300_000
    assert time.time() - began < 30


def test_short_words_merge_alike():
    with open(contract.tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        bpe = lexicon_bpe.Bpe(f.read())
    assert len(bpe.packed) == len(bpe.rank)
    rng = random.Random(2)
    for n in (*range(1, 49), *range(1, 20)):
        for letters in ("ab", "etaoinshrdlu", "é日a", "aaaaab"):
            word = "".join(rng.choice(letters) for _ in range(n))
            raw = word.encode()
            ids = [*[bpe.first[b] for b in raw[:-1]], bpe.last[raw[-1]]]
            assert bpe.merge(word) == bpe.merge_long(ids), word


def test_the_lexicon_takes_the_most_frequent_words_only(spark):
    rows = [(f"w{i}", 1 + 1000 // (i + 1)) for i in range(3000)]
    df = spark.createDataFrame(rows, "word string, n long")
    got = sorted(r.n for r in lexicon_bpe.most_frequent(df, 100).collect())
    assert 60 <= len(got) <= 100 and got == sorted(n for _, n in rows)[-len(got) :]
    assert lexicon_bpe.most_frequent(df.where("n = 2"), 5).count() == 0 and lexicon_bpe.most_frequent(df, 3000).count() == 3000


def test_fitted_labels_are_bounded(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    got = {r.y: r["count"] for r in common.bounded_labels(df, "y", 6000).groupBy("y").count().collect()}
    assert got[1] == 2000 and 2400 <= got[0] <= 3000


def test_lexicon_finds_its_words_and_no_others():
    words = {w: [i, i + 1] for i, w in enumerate(["a", "ab", "abc", "b", "bc", "tap", "taps", "top", "tops", "é"])}
    lex = lexicon_bpe.Lexicon(lexicon_bpe.compile_lexicon(words))
    assert all(lex.get(w) == ids for w, ids in words.items()) and not any(map(lex.get, ["", "ta", "tapsx", "c", "ê"]))


def test_separator_scan(spark, docs, plain):
    import base64

    import public_tokenizers
    import tiktoken

    path = contract.tokenizer_path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    got = {r.doc_id: r.n_tokens for r in separator_scan.document_tokens(docs, path, public_tokenizers.PATTERN, 50256, 97).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in plain.items()}


def test_separator_scan_stitches(spark, monkeypatch, tmp_path):
    import numpy as np

    monkeypatch.setattr(separator_scan, "RUN", 3)
    monkeypatch.setattr(separator_scan, "RANGE_BLOCKS", 5)
    rng = random.Random(1)
    for f in range(4):
        np.array([0 if rng.random() < (0.02, 0.3, 0, 0.9)[f] else 5 for _ in range(500)], np.uint16).tofile(tmp_path / f"{f}.bin")
    got = collections.defaultdict(dict)
    for r in separator_scan.scan(separator_scan.flat_files(spark, str(tmp_path), 14), 0).collect():
        got[r.file[-5]][r.number] = (r.n_tokens, r.ended)
    for f in range(4):
        pieces = "".join("|" if x == 0 else "." for x in np.fromfile(tmp_path / f"{f}.bin", np.uint16)).split("|")
        want = [(len(p), True) for p in pieces[:-1]] + ([(len(pieces[-1]), False)] if pieces[-1] else [])
        assert [got[str(f)][k] for k in sorted(got[str(f)])] == want
    (tmp_path / "cut.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="whole number"):
        separator_scan.scan(separator_scan.flat_files(spark, str(tmp_path / "cut.bin"), 14), 0).collect()


def test_decontamination_finds_copies_and_paraphrases(spark, docs, plain):
    bench = common.table(spark, SF, "benchmark")
    items = {r.item_id: decontamination.words_of(r.text) for r in bench.collect()}
    rng = random.Random(4)
    rows, want = [], set()
    for i, t in enumerate(list(plain.values())[:60]):
        item = rng.choice(list(items))
        w = [x if rng.random() > 0.12 else rng.choice(["the", "of", "and"]) for x in items[item]]
        h = decontamination.words_of(t)
        k = rng.randrange(len(h) + 1)
        rows.append((1000 + i, " ".join(h[:k] + w + h[k:]).upper()))
        want.add((1000 + i, item))
    both = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(both, bench).collect()}
    # Brute force: every window of the item's length, by longest common subsequence.
    for d, t in list(plain.items()) + rows:
        words = decontamination.words_of(t)
        for i, p in items.items():
            b = decontamination.bits(p)
            if any(decontamination.lcs(b, len(p), words[a : a + len(p)]) >= 0.8 * len(p) for a in range(0, len(words), max(1, len(p) // 8))):
                want.add((d, i))
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.02 * len(got)
    left = {r.doc_id for r in decontamination.clean(both, bench).collect()}
    assert left == {r.doc_id for r in both.collect()} - {d for d, _ in got}


def test_decontamination_rules_out_only_what_no_window_could_confirm(spark, docs, plain, monkeypatch):
    bench = common.table(spark, SF, "benchmark")
    index = decontamination.build_indexes(docs, bench)[0]
    some = decontamination.Searcher(index, 0.3, 0.4, 0.6)
    every = decontamination.Searcher(index, 0.3, 0.4, 0.6)
    monkeypatch.setattr(every, "open_steps", lambda ids: np.ones(-(-len(ids) // decontamination.STEP), bool))
    shut = 0
    rounded = lambda found: {i: (*m[:3], round(m[3], 4), m[4]) for i, m in found.items()}  # noqa: E731 - sums of 32-bit numbers in another order
    for t in plain.values():
        assert rounded(some.matches(t)) == rounded(every.matches(t))
        ids = np.array([index.column.get(w, len(index.column)) for w in decontamination.words_of(t)], np.int64)
        shut += len(ids) > 0 and not some.open_steps(ids).all()
    assert shut > 20


def test_decontamination_projects_only_windows_that_could_be_confirmed(spark, monkeypatch):
    rng = random.Random(21)
    stop = [f"s{i}" for i in range(12)]
    item = lambda n: [rng.choice(stop) if rng.random() < 0.4 else f"w{rng.randrange(900)}" for _ in range(n)]
    items = [item(rng.randrange(6, 100)) for _ in range(40)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    texts = ["", "\u00c4 \u2026"]
    for i, w in enumerate(items):
        words = item(rng.randrange(3, 700))
        for part in (w, w[: len(w) // 2], rng.sample(w, len(w))):  # whole, half, and in another order, far from each other
            k = rng.randrange(len(words) + 1)
            words[k:k] = part if i % 4 else []
        texts.append(" \u00bb ".join([" ".join(words[:9]), *words[9:]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = decontamination.build_indexes(docs, bench)[0]
    s = decontamination.Searcher(index, 0.3, 0.6, 0.75)
    projected = []
    sums = s.window_sums
    monkeypatch.setattr(s, "window_sums", lambda ids, at, k: (projected.append(len(at)), sums(ids, at, k))[1])
    found, may = [s.matches(t) for t in texts], 0
    for t in texts:
        words, opened = decontamination.words_of(t), []
        for at in range(0, len(words), decontamination.STEP):
            looked_at = lambda n: set(words[max(0, at - s.reach_of(n, 32)) : at + 32 + s.reach_of(n, 32)])  # noqa: B023, E731
            opened.append(any(sum(w in around for w in p) >= 0.6 * len(p) - 1e-9 for p in index.passages for around in [looked_at(len(p))]))
        assert not words or s.open_steps(np.array([index.column.get(w, len(index.column)) for w in words])).tolist() == opened
        may += sum(opened)
    assert sum(map(bool, found)) >= 9 and sum(projected) <= 2 * may
    monkeypatch.setattr(decontamination, "PLACES", 300)  # all texts together, in many parts, give the same
    assert list(s.matches_of(texts)) == found


def test_words_in_lower_case_are_those_of_the_pattern():
    rng = random.Random(8)
    for _ in range(3000):
        t = "".join(chr(rng.choice([rng.randrange(128), rng.randrange(0x3000), rng.randrange(0x110000)])) for _ in range(20))
        assert decontamination.words_of(t) == re.findall(r"\w+", t.lower())


def test_short_items_are_found_as_phrases(spark):
    bench = spark.createDataFrame([(1, "Green Eggs"), (2, "ham"), (3, None), (4, "one two three four five six seven eight"), (None, "a b c")], "item_id long, text string")
    rows = [(0, "some green, eggs and ham"), (1, "green and eggs"), (2, "x one two three four five six seven eight y"), (3, "a b c"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(df, bench).collect()} == {(0, 1), (0, 2), (2, 4), (3, None)}
    assert [r.doc_id for r in decontamination.clean(df, bench).orderBy("doc_id").collect()] == [1, 4]
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(df, bench.where("item_id < 3")).collect()} == {(0, 1), (0, 2)}


def test_decontamination_finds_alike_in_a_corpus_a_thousand_times_as_large(spark, monkeypatch):
    rng = random.Random(12)
    items = [[f"w{rng.randrange(400)}" for _ in range(40)] for _ in range(60)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    # Each word in a tenth of the documents, at either size.
    found = {}
    for size in (100, 100_000):
        monkeypatch.setattr(decontamination, "document_frequencies", lambda docs, terms, n=size: (n, np.full(len(terms), n / 10)))
        index = decontamination.build_indexes(bench, bench)[0]
        s = decontamination.Searcher(index, 0.6, 0.6, 0.75)
        new = random.Random(5)
        docs = [" ".join(x if j >= 30 or new.random() > 0.35 else f"new{new.randrange(10**6)}" for j, x in enumerate(w)) for w in items]
        found[size] = [sorted(s.matches(d)) for d in docs]
    assert found[100] == found[100_000] and sum(i in f for i, f in enumerate(found[100])) >= 55
    ids = np.array([index.column.get(w, len(index.column)) for w in (" ".join(docs) + " zz" * 5000).split()])
    at = np.arange(0, len(ids) // 8 - 4)
    assert np.allclose(s.window_sums(ids, at, 4), [index.latent[ids[i * 8 : i * 8 + 32]].sum(0) for i in at], atol=1e-3)


def test_host_rules_reject_bad_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "spam " * 80
    rows = [(i, bad if h == "junk" and i % 10 else good, h) for i, h in enumerate(["junk"] * 100 + ["fine"] * 100)]
    got = host_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r.kept == (r.host == "fine") for r in got)
    assert host_rules.counts("a b c\na b c\na b c x #$") == (11, 12, 2, 1, 9)


def test_host_prior_learns_from_small_hosts(spark):
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 5, 4000)
    failed = rng.binomial(sizes, rng.beta(6.0, 2.0, len(sizes)))
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(h * 4 + i, "short" if i < f else good, f"h{h}") for h, (n, f) in enumerate(zip(sizes.tolist(), failed.tolist(), strict=True)) for i in range(n)]
    got = host_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    shrunk = {(r.host_docs, r.failed): r.rate for r in got.groupBy("host").agg(F.first("host_docs").alias("host_docs"), F.sum(F.col("base_failed").cast("int")).alias("failed"), F.first("host_shrunk_rate").alias("rate")).collect()}
    assert len(shrunk) == 14
    for (n, f), rate in shrunk.items():  # the prior that the hosts were drawn from, as if it were known
        assert abs(rate - (f + 6) / (n + 8)) < 0.04, (n, f)
    # One of two failed: the other hosts' rates decide, so its good document goes, too.
    assert not any(r.kept for r in got.where("host_docs = 2 and not base_failed").collect())


@pytest.mark.parametrize("op", ["op3_pairwise_quality", "op4_multiple_instance_toxicity"])
def test_held_out_accuracy(spark, op):
    sf = "/root/testdata/sf0.1"
    label = "quality" if op[2] == "3" else "toxic"
    got = contract.QUERIES[op](spark, sf).where("held_out").join(common.table(spark, sf, "labels"), "doc_id").where(f"{label} is not null").collect()
    right = [(r[label], r.predicted) for r in got]
    assert sum(a == b for a, b in right) / len(right) > 0.97
    for v in (0, 1):
        assert sum(b == v for a, b in right if a == v) / sum(a == v for a, _ in right) > 0.8


def test_offending_sentences_are_located():
    import numpy as np

    rng = random.Random(1)
    clean = [[{rng.choice("abcdefgh") for _ in range(4)} for _ in range(rng.randrange(1, 9))] for _ in range(200)]
    y = np.array([i % 2 for i in range(200)])
    for bag, bad in zip(clean, y, strict=True):
        if bad:
            bag[rng.randrange(len(bag))].add("vile")
    m = toxicity_mil.fit_noisy_or(toxicity_mil.bags_of(clean, y))
    assert [s[:2] for s in m.spans("a b c. you vile d. e f.") if s[2] >= 0.5] == [(6, 18)]


def test_offending_sentences_next_to_letters_that_lower_longer():
    m = toxicity_mil.Model(-9.0, {"vile": 12.0})
    assert [s[:2] for s in m.spans("\u0130zmir b c. YOU VILE D. e f.")] == [(10, 22)]


def test_quality_threshold_is_a_quantile(spark, docs):
    labels = common.table(spark, SF, "labels")
    model = quality_ranker.fit(docs, labels)
    kept = {r.doc_id for r in quality_ranker.accepted(docs, model).collect()}
    assert kept == {r.doc_id for r in quality_ranker.score(docs, model).where("score >= 0.5").collect()}


def test_pair_sums_are_those_of_all_pairs():
    rng = np.random.default_rng(1)
    z, y, w = rng.normal(size=(60, 4)), np.array([0, 1, 1] * 20), rng.normal(size=4)
    d = np.array([a - b for a in z[y == 1] for b in z[y == 0]])
    p = 1 / (1 + np.exp(d @ w))
    want = np.concatenate([[len(d)], -(d.T @ p), ((d * (p * (1 - p))[:, None]).T @ d).ravel()])
    assert np.allclose(quality_ranker.pair_sums(z, y, w), want)


def test_quality_learns_from_all_labels(spark):
    # A label's 10,000 rows were the most that counted; all 24,000 do, and the threshold parts them at the share of bad ones.
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "## $$ 1 2 3 ##").otherwise("some plain words of a good text.").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality"))
    model = quality_ranker.fit(docs, labels)
    upper = quality_ranker.FEATURES.index("symbols")
    every = np.array([quality_ranker.features("## $$ 1 2 3 ##"), quality_ranker.features("some plain words of a good text.")])
    assert np.isclose(model.mean[upper], every[0, upper] / 4)
    assert (model.score(every) >= 0.5).tolist() == [False, True]


def test_ranked_values_are_exact(spark):
    df = spark.range(5000).select((F.pmod(F.xxhash64("id"), F.lit(1009)) / 7.0).alias("latent"))
    want = sorted(r[0] for r in df.collect())
    assert [quality_ranker.ranked(df, k, 50) for k in (1, 777, 2500, 5000)] == [want[k - 1] for k in (1, 777, 2500, 5000)]
