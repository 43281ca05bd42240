"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a span classifier decides.

Candidates are the matches of one pattern a kind (email, ip, card, phone, and beyond those secret and ssn), of any length; context
and gazetteer propose more phone numbers: digit groups after a word such as "call", or after 00 and a dialling code.  Labelers
vote 1, 0 or -1 on a candidate: *regex* (does it pass its kind's checks: parts, Luhn, digits), *gazetteer* (top-level domains,
card issuers, dialling codes, key prefixes; reserved networks), *context* (words just before it), *edge* (is it cut from a
longer token) and *shape* (the mix of its characters).  EM over the counts of vote patterns estimates each labeler's
reliability and each pattern's chance to be personal data; a logistic regression on kind and votes, trained on those chances,
is the span classifier.  The patterns are at most 6 kinds x 3^5 votes, whatever the corpus: only their counts reach the
driver.  Spans of the four base kinds that pass their checks always stay; the classifier's probability alone adds spans to them.

Only DataFrame functions touch documents.  Cases: a null or empty text has no spans.  Equal rows are treated one by
one.  An empty table gives an empty table.  Extra columns are left aside.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "secret", "ssn")
BASE = KINDS[:4]
VOTES = ("regex", "gazetteer", "context", "edge", "shape")

# Possessive quantifiers and the guard "not inside a run, unless the last match ended here" give the leftmost matches of the
# plain patterns without their retries, so a text of one endless token takes linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?:(?<![A-Za-z0-9])AKIA[0-9A-Z]{12,}+|(?<![A-Za-z0-9])(?:ghp_|sk-|xox[abp]-)[A-Za-z0-9-]{12,}+|(?i:(?<![A-Za-z])(?:password|passwd|pwd|token|secret|api_?key)\s{0,3}+[=:]\s{0,3}+[\"']?+)[A-Za-z0-9+/_-]{8,}+)",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
_CODES = "(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
_CUE = "(?i:phone|call|tel|mobile|fax|dial)"
#: What context and gazetteer propose beyond the patterns; never base spans.
MORE = {"phone": rf"(?<![0-9+.-])(?:(?<={_CUE}[^0-9+\n]{{0,12}})\(?[0-9][\x20().0-9-]+[0-9]|00{_CODES}[\x20().0-9-]+[0-9])"}
#: A quick look that lets most texts skip a pattern; each is implied by a match.
HINTS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
CUES = {
    "email": "mail|contact|write|reach",
    "ip": "ip|host|server|addr|login|from",
    "card": "card|visa|master|pay|credit|carte|karte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|dial",
    "secret": "key|token|secret|pass|auth|login",
    "ssn": "ssn|social|security",
}
AGAINST = "isbn|version|build|order|invoice|release|example"


def located(text: Column, matches: str, between: str) -> Column:
    """The matches with their starts, from the pieces between them (both columns hold arrays)."""
    size = lambda a, x: a + F.length(x)
    start = lambda i: F.aggregate(F.slice(between, F.lit(1), i + 1), F.lit(0), size) + F.aggregate(F.slice(matches, F.lit(1), i), F.lit(0), size)
    return F.transform(F.transform(matches, lambda m, i: F.struct(m.alias("m"), start(i).alias("start"))), lambda x: F.struct(x["m"].alias("m"), x["start"].alias("start"), F.substring(text, F.greatest(x["start"] - 23, F.lit(1)), F.least(x["start"], F.lit(24))).alias("before"), F.substring(text, x["start"] + F.length(x["m"]) + 1, F.lit(1)).alias("after")))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    d = F.split(F.reverse(digits(m)), "")
    worth = F.transform(d, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def valid(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    return {
        "email": F.lit(True),
        "ip": m.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$"),
        # luhn() sees short strings only: a text may be one endless number.
        "card": F.when(n.between(14, 19), luhn(m)).otherwise(False),
        "phone": n.between(10, 15),
        "secret": m.rlike("[0-9]"),
        "ssn": ~m.rlike("^(?:000|666|9)|-00-|-0000$"),
    }[kind]


def known(kind: str, m: Column) -> Column:
    """The gazetteer's vote."""
    yes, no = {
        "email": (r"(?i)\.(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$", r"^[0-9.]+@|@[0-9.]+$"),
        "ip": ("^[1-9]", r"^(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."),
        "card": ("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)", "^(?:0|1|7|8|9)"),
        "phone": (rf"^(?:\+|00){_CODES}|^\(?[2-9][0-9]{{2}}\)?[\x20.-]", r"^\+0"),
        "secret": ("^(?:AKIA|ghp_|sk-|xox)|(?i:password|passwd|pwd|token|secret|api_?key)", "(?i)(?:changeme|example|password|xxxx)$"),
        "ssn": ("^[0-7]", "^9"),
    }[kind]
    return F.when(m.rlike(no), -1).when(m.rlike(yes), 1).otherwise(0)


def shape(kind: str, m: Column) -> Column:
    plain, odd = {
        "email": ("^.{6,80}$", "^.{160,}"),
        "ip": ("^.{7,15}$", "^.{20,}"),
        "card": (r"^[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{2,7}$", "^.{0,13}$|^.{30,}"),
        "phone": (r"[\x20().-]", "^.{0,8}$|^.{25,}"),
        # Both a digit and a letter on a line, without retries from each of them: a secret may be endless.
        "secret": ("(?m)^(?=.*[0-9]).*[A-Za-z]", "^[A-Za-z]++$"),
        "ssn": ("^.{11}$", "^$"),
    }[kind]
    return F.when(m.rlike(odd), -1).when(m.rlike(plain), 1).otherwise(0)


def votes(kind: str, x: Column) -> Column:
    m, before = x["m"], F.lower(x["before"])
    context = F.when(before.rlike(rf"(?:{AGAINST})[^\n]{{0,6}}$"), -1).when(before.rlike(rf"(?:{CUES[kind]})"), 1).otherwise(0)
    cut = before.rlike("[a-z0-9]$") | x["after"].rlike("^[A-Za-z0-9]")
    each = [F.when(valid(kind, m), 1).otherwise(-1), known(kind, m), context, F.when(cut, -1).otherwise(1), shape(kind, m)]
    return F.concat(*[F.substring(F.lit("-0+"), v + 2, F.lit(1)) for v in each])


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, cands array<struct<start, k, end, kind, base, votes>>): every pattern's matches with the labelers' votes."""
    text = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    cols = []
    for kind, pattern in PATTERNS.items():
        seen = F.col("text").contains(HINTS[kind]) if kind in HINTS else F.col("text").rlike("[0-9]" if kind == "card" else "(?i)AKIA|ghp_|sk-|xox|pass|pwd|token|secret|key")
        cols += [F.when(seen, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none).alias(f"m_{kind}"), F.when(seen, F.split("text", pattern, -1)).otherwise(none).alias(f"b_{kind}")]
    for kind, pattern in MORE.items():
        seen = F.col("text").rlike(f"{_CUE}|00[1-9]")
        cols += [F.when(seen, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none).alias(f"m_{kind}2"), F.when(seen, F.split("text", pattern, -1)).otherwise(none).alias(f"b_{kind}2")]
    split = text.select("doc_id", "text", *cols)
    found = split.select("doc_id", *[located(F.col("text"), f"m_{k}", f"b_{k}").alias(k) for k in (*KINDS, *[f"{k}2" for k in MORE])])

    def voted(kind: str, of: str = "") -> Column:
        base = (lambda m: valid(kind, m)) if kind in BASE and not of else (lambda m: F.lit(False))
        return F.transform(of or kind, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), (x["start"] + F.length(x["m"])).alias("end"), F.lit(kind).alias("kind"), base(x["m"]).alias("base"), votes(kind, x).alias("votes")))

    return found.select("doc_id", F.array_sort(F.concat(*map(voted, KINDS), *[voted(k, f"{k}2") for k in MORE])).alias("cands"))


def reliabilities(patterns: list[tuple[str, str, int]], rounds: int = 50) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """EM: chances of vote v by labeler l given the truth, shape (2, labelers, 3); each pattern's chance to be true; each kind's share."""
    v = np.array([["-0+".index(c) for c in p] for _, p, _ in patterns]).reshape(-1, len(VOTES))
    n = np.array([c for _, _, c in patterns], float)
    kind = np.array([KINDS.index(k) for k, _, _ in patterns], int)
    truth = np.clip(0.5 + 0.2 * (v - 1).sum(1), 0.02, 0.98)  # the start: the majority
    one_hot = np.eye(3)[v]
    share = np.full(len(KINDS), 0.5)
    for _ in range(rounds):
        theta = []
        for q in (1 - truth, truth):
            t = np.einsum("p,plv->lv", n * q, one_hot) + 1.0
            theta.append(t / t.sum(1, keepdims=True))
        theta = np.array(theta)
        for k in range(len(KINDS)):
            own = kind == k
            share[k] = ((n * truth)[own].sum() + 1) / (n[own].sum() + 2)
        ll = np.einsum("plv,clv->pc", one_hot, np.log(theta)) + np.log(np.stack([1 - share[kind], share[kind]], 1))
        truth = 1 / (1 + np.exp(np.clip(ll[:, 0] - ll[:, 1], -30, 30)))
    return theta, truth, dict(zip(KINDS, share, strict=True))


def span_classifier(patterns: list[tuple[str, str, int]], truth: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    """Each pattern's probability by logistic regression on kind and votes, trained on EM's chances weighted by counts (Newton steps)."""
    x = np.array([[*(float(k == q) for q in KINDS), *(float("-0+".index(c) - 1) for c in p)] for k, p, _ in patterns])
    n = np.array([c for _, _, c in patterns], float)
    n /= n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - truth)) + l2 * w
        w -= np.linalg.solve((x.T * (n * p * (1 - p))) @ x + l2 * np.eye(len(w)), grad)
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base array<struct<start,k,end,kind>>, added likewise) for every row of docs, each sorted by start, then kind."""
    cands = common.stored(candidates(docs), "pii")
    seen = cands.select(F.explode("cands").alias("x")).groupBy("x.kind", "x.votes").count().collect()
    patterns = sorted((r[0], r[1], r[2]) for r in seen)
    taken = []
    if patterns:
        _, truth, _ = reliabilities(patterns)
        chance = span_classifier(patterns, truth)
        taken = [f"{k}{v}" for (k, v, _), p in zip(patterns, chance, strict=True) if p >= 0.5]
    good = F.array(*map(F.lit, taken)).cast("array<string>")
    slim = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end"), x["kind"].alias("kind")))
    two = cands.select("doc_id", slim(F.filter("cands", lambda x: x["base"])).alias("base"), slim(F.filter("cands", lambda x: ~x["base"] & F.array_contains(good, F.concat(x["kind"], x["votes"])))).alias("more"))
    return two.select("doc_id", "base", F.filter("more", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))).alias("added"))


def digest(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
