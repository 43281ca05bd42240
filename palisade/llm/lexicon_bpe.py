"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Words are what the tokenizer's pre-tokenizer cuts from normalised text.  All words of the corpus are counted; the most frequent ones are
merged once and compiled into a minimal acyclic automaton, in which equal endings are shared.  Its transitions carry
outputs whose sum along a word is the word's number; that leads to the word's ids.  The automaton is one flat block of
bytes, which every worker memory-maps.  Words that it lacks are merged exactly, pair by pair in the order of the merge ranks.

The tokenizer is a ``tokenizers`` JSON file of the word-end kind (NFC, white space, lower case; split by a pattern; byte symbols;
a suffix on a word's last symbol).  Its strings for special tokens become special ids, as in the library.

Cases: a null text counts as empty and has no ids.  Equal rows are encoded one by one.  An empty table gives an empty
table.  Extra columns pass through ``encode``; the new columns must not be among them.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import struct
import tempfile
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_SPACES = re.compile(r"[\t-\r \x85\xa0  -     　]+")
#: Characters of a word in the lexicon; a longer one is merged where it stands.
LONGEST = 200
#: Bits of an id where two numbers are packed into one.
BITS = 24
_ID, _NONE = (1 << BITS) - 1, 1 << 62
_NOT_SPACE = re.compile("[\x1c-\x1f]")  # str.split() would split there


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if it is printable Latin-1, else the next free code point from 256 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class Bpe:
    """Normalising, splitting into words, exact merging."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        model = j["model"]
        self.vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in j["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = next(p["pattern"]["Regex"] for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words_of = regex.compile(pattern).findall
        self.symbol = byte_symbols()
        ids = self.vocab
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in enumerate(merges)}
        # The same with a pair, and a rank with the id that its merge makes, as one number each: the least number is the merge that goes first.
        self.packed = {a << BITS | b: r << BITS | new for (a, b), (r, new) in self.rank.items()}
        self.first = [ids[s] for s in self.symbol]
        self.last = [ids[s + self.suffix] for s in self.symbol]

    def chunks(self, text: str) -> list[str]:
        """Normalised text, cut at white space; no word goes across it."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() has a rule of its own for a last sigma
        return _SPACES.split(text.lower()) if _NOT_SPACE.search(text) else text.lower().split()

    def words(self, chunk: str) -> list[str]:
        if chunk.isalpha():
            return [chunk]
        if chunk[:-1].isalpha() and chunk[-1:] in ".,":
            return [chunk[:-1], chunk[-1]]
        return self.words_of(chunk)

    def merge(self, word: str) -> list[int]:
        raw = word.encode()
        ids = [self.first[b] for b in raw[:-1]]
        ids.append(self.last[raw[-1]])
        if len(ids) > 48:
            return self.merge_long(ids)
        look = self.packed.get
        found = [look(a << BITS | b, _NONE) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) != _NONE:
            i = found.index(best)
            new = ids[i] = best & _ID
            del ids[i + 1], found[i]
            if i:
                found[i - 1] = look(ids[i - 1] << BITS | new, _NONE)
            if i < len(found):
                found[i] = look(new << BITS | ids[i + 1], _NONE)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges in n log n: pairs wait in a heap by rank and place, symbols are a list linked both ways."""
        rank, n = self.rank, len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue  # one of the two has been merged since
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if r := rank.get((new, ids[k])):
                    heapq.heappush(heap, (r[0], i, new, ids[k], r[1]))
            if (h := before[i]) >= 0 and (r := rank.get((ids[h], new))):
                heapq.heappush(heap, (r[0], h, ids[h], new, r[1]))
        return [x for x in ids if x >= 0]


def compile_lexicon(entries: dict[str, list[int]]) -> bytes:
    """The automaton of the words: built in word order with a register of states, so that equal right sides are one state.

    Layout: four counts, then base, check, out (int32 a slot), final (a byte a state slot), offsets and ids.  A transition by byte b from state s
    (named by its base) is the slot s + b, if check there is s; out is the number of words before it among s's.
    """
    words = sorted(w.encode() for w in entries)
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, state), ...)), minimal and numbered
    counts: list[int] = []

    def settle(final: bool, edges: list[tuple[int, int]]) -> int:
        key = (final, tuple(edges))
        if key not in register:
            register[key] = len(states)
            states.append(key)
            counts.append(final + sum(counts[t] for _, t in edges))
        return register[key]

    path: list[list] = [[False, [], -1]]  # open states along the last word: final, edges, the byte that led here
    before = b""
    for word in [*words, None]:
        same = 0
        if word is not None:
            limit = min(len(word), len(before))
            while same < limit and word[same] == before[same]:
                same += 1
        while len(path) > same + 1:
            final, edges, byte = path.pop()
            path[-1][1].append((byte, settle(final, edges)))
        if word is None:
            break
        path += [[False, [], b] for b in word[same:]]
        path[-1][0] = True
        before = word
    root = settle(path[0][0], path[0][1])
    # First fit of the states' transitions into one array of slots.
    base = np.zeros(len(states), np.int64)
    size = 1024
    taken = np.zeros(size, bool)
    used_base = np.zeros(size, bool)
    low = 1
    order = sorted(range(len(states)), key=lambda s: -len(states[s][1]))
    for s in order:
        labels = np.array([b for b, _ in states[s][1]], np.int64)
        at = low
        while True:
            if at + 512 > size:
                taken, used_base = np.concatenate([taken, np.zeros(size, bool)]), np.concatenate([used_base, np.zeros(size, bool)])
                size *= 2
            span = np.arange(at, at + 256)
            ok = ~used_base[span] & (~taken[span[:, None] + labels].any(1) if len(labels) else True)
            if ok.any():
                break
            at += 256
        base[s] = span[ok.argmax()]
        used_base[base[s]] = True
        taken[base[s] + labels] = True
        while low + 256 < size and used_base[low]:
            low += 1
    slots = int(base.max()) + 257
    to, check, out, final = np.zeros(slots, np.int32), np.full(slots, -1, np.int32), np.zeros(slots, np.int32), np.zeros(slots, np.uint8)
    for s, (is_final, edges) in enumerate(states):
        final[base[s]] = is_final
        n = int(is_final)
        for b, t in edges:
            slot = base[s] + b
            to[slot], check[slot], out[slot] = base[t], base[s], n
            n += counts[t]
    ids = [entries[w.decode()] for w in words]
    offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    pool = np.array([i for x in ids for i in x], np.int32)
    head = struct.pack("<4i", slots, int(base[root]), len(words), len(pool))
    return head + to.tobytes() + check.tobytes() + out.tobytes() + offsets.tobytes() + pool.tobytes() + final.tobytes()


class Lexicon:
    """Looks words up in the mapped automaton."""

    def __init__(self, blob: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            view = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        slots, self.root, words, pool = struct.unpack_from("<4i", view)
        parts, at = [], 16
        for n in (slots, slots, slots, words + 1, pool):
            parts.append(view[at : at + 4 * n].cast("i"))
            at += 4 * n
        self.to, self.check, self.out, self.offsets, self.pool = parts
        self.final, self.slots = view[at:], slots

    def get(self, word: str) -> list[int] | None:
        s, n, to, check, out = self.root, 0, self.to, self.check, self.out
        for b in word.encode():
            slot = s + b
            if check[slot] != s:
                return None
            n += out[slot]
            s = to[slot]
        return self.pool[self.offsets[n] : self.offsets[n + 1]].tolist() if self.final[s] else None


class Encoder:
    """Whole texts to ids.  A worker remembers the results for chunks between white space: those of late in ``seen``, and the ones before
    in ``older``, each up to a bound on memory."""

    REMEMBERED = 200_000

    def __init__(self, bpe: Bpe, lexicon: Lexicon):
        self.bpe, self.lexicon, self.seen, self.older = bpe, lexicon, {}, {}

    def chunk(self, chunk: str) -> tuple[str, str]:
        ids: list[int] = []
        for w in self.bpe.words(chunk):
            ids += self.lexicon.get(w) or self.bpe.merge(w)
        return " ".join(map(str, ids)), " ".join(map(self.bpe.tokens.__getitem__, ids))

    def parts(self, text: str) -> list[tuple[str, str]]:
        """(ids, tokens) of the text's pieces, in order, each joined by spaces."""
        if "<" in text and self.bpe.cut.search(text):
            out = []
            for piece in self.bpe.cut.split(text):
                if piece in self.bpe.special:
                    out.append((str(self.bpe.special[piece]), piece))
                elif piece:
                    out += self.parts(piece)
            return out
        chunks = self.bpe.chunks(text)
        if new := set(chunks).difference(self.seen):
            if len(self.seen) + len(new) > self.REMEMBERED:
                self.seen, self.older = {}, self.seen
                new = set(chunks)
            for c in new:
                self.seen[c] = self.older.get(c) or self.chunk(c)
        seen = self.seen
        return [p for c in chunks if (p := seen[c])[0]]


def word_counts(docs: DataFrame, spec: str) -> DataFrame:
    """(word, n) over all whole texts.  Tasks add up what they see before rows move, in tables of bounded size."""

    def run(batches):
        bpe, seen = Bpe(spec), Counter()

        def flush():
            words = Counter()
            for chunk, n in seen.items():
                for w in bpe.words(chunk):
                    if len(w) <= LONGEST:
                        words[w] += n
            seen.clear()
            keys = list(words)
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([words[w] for w in part], pa.int64())], ["word", "n"])

        for batch in batches:
            for t in common.texts(batch):
                for piece in bpe.cut.split(t) if "<" in t else [t]:
                    if piece not in bpe.special:
                        seen.update(bpe.chunks(piece))
            if len(seen) > 150_000:
                yield from flush()
        yield from flush()
        common.released()

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(common.BATCH_ROWS))
    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Those rows of (word, n) with the greatest n, as whole classes of about equal n, that are ``most`` at most: a histogram of a few hundred
    classes tells where to stop, so no partition sends more than it has of them."""
    kind = F.floor(F.log2("n") * 16).cast("int")
    seen, least = 0, None
    for k, n in sorted(map(tuple, counts.groupBy(kind.alias("k")).count().collect()), reverse=True):
        seen += n
        if seen > most:
            break
        least = k
    return counts.where(kind >= least) if least is not None else counts.limit(0)


def build(docs: DataFrame, tokenizer_path: str, lexicon_words: int = 40_000) -> tuple[str, bytes]:
    """The tokenizer's specification and the compiled lexicon of the most frequent words, at most ``lexicon_words`` (that number bounds what reaches the driver)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    bpe = Bpe(spec)
    counts = common.stored(word_counts(docs, spec), "words")
    top = most_frequent(counts, lexicon_words).collect()
    common.unstore(counts)
    return spec, compile_lexicon({r["word"]: bpe.merge(r["word"]) for r in top})


#: What encode() can return, as (type, made of the text's ids and tokens, both joined by spaces).
_OUTPUTS = {
    "n_tokens": ("long", lambda ids, _: ids.count(" ") + 1 if ids else 0),
    "ids": ("array<int>", lambda ids, _: [*map(int, ids.split())]),
    "decoded": ("string", lambda _, tokens: tokens),
    "ids_sha256": ("string", lambda ids, _: hashlib.sha256(ids.encode()).hexdigest()),
    "decoded_sha256": ("string", lambda _, tokens: hashlib.sha256(tokens.encode()).hexdigest()),
}


def encode(docs: DataFrame, built: tuple[str, bytes], outputs: tuple[str, ...] = ("n_tokens", "ids"), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns ``keep`` and the outputs asked for: ids, their number, the decoded text (tokens joined by spaces, as the library's
    decode gives for a tokenizer without decoder), or digests of the two, made where the ids are."""
    sent = docs.sparkSession.sparkContext.broadcast(built)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("__text"))
    fields = rows.drop("__text").schema
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{k} {_OUTPUTS[k][0]}" for k in outputs])

    def make():
        enc = _encoder(sent.value)

        def of(batch):
            out = {k: [] for k in outputs}
            for t in common.texts(batch, "__text"):
                parts = enc.parts(t)
                ids, tokens = " ".join([p[0] for p in parts]), " ".join([p[1] for p in parts])
                for k in outputs:
                    out[k].append(_OUTPUTS[k][1](ids, tokens))
            return {f.name: batch.column(i) for i, f in enumerate(fields)} | out

        return of

    return common.arrow_map(rows, ddl, make)


_kept: dict[bytes, Encoder] = {}


def _encoder(built: tuple[str, bytes]) -> Encoder:
    """One encoder a worker process, for the lexicon used last."""
    key = hashlib.sha256(built[1] + built[0].encode()).digest()
    if key not in _kept:
        _kept.clear()
        _kept[key] = Encoder(Bpe(built[0]), Lexicon(built[1]))
    return _kept[key]


def decode(rows: DataFrame, built: tuple[str, bytes]) -> DataFrame:
    """(all columns of rows, decoded): the array column ``ids`` as text; an unknown id is left out, as in the library; null ids give null."""
    sent = rows.sparkSession.sparkContext.broadcast(built[0])

    @F.pandas_udf("string")
    def text(ids):
        tokens = Bpe(sent.value).tokens
        return ids.map(lambda x: None if x is None else " ".join(tokens[i] for i in x if i in tokens))

    return rows.withColumn("decoded", text("ids"))
