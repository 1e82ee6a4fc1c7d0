"""Personal data by weak supervision, in SQL functions only.

Candidates are found by patterns over the whole text. Labelers vote on each: whether its form is valid (a checksum, a
range, a number of digits), whether it holds an entry of a gazetteer (given names, mail hosts, prefixes of cards, of phones
and of keys), and whether words before it announce such data. Expectation-maximisation over the votes of all candidates
estimates how often each labeler is right, by kind, and the probability of each vote pattern; a logistic model, trained on
these probabilities, is the final classifier. Beside the votes it sees the text itself: length, share of digits, case, and
the characters on either side. All are few small integers, so all candidates together are a table of counts by pattern:
the training sees every candidate, while the driver gets a bounded number of rows (`MAX_PATTERNS`); the weights are applied
as an expression.

Base spans (an e-mail address, an IP address, a card number with a valid checksum, an international phone number) always
stay; other candidates stay if they meet no base span and the classifier gives them at least ``THRESHOLD``.

Defined results: a null text counts as empty; identical rows get identical spans; without candidates there is nothing to
train and nothing is added; added spans of different kinds may overlap, base spans are never given up for them; a text of any
length is read whole; extra columns are kept by `find`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut

#: Base patterns. Each is written so that a search is linear in the text: a run of digits or of name
#: characters is tried from its first character (or from where the last match ended) only.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Patterns of further kinds.
MORE = {
    "email_masked": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++",
    "phone_local": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "account": r"(?<![0-9A-Za-z_-])[0-9]{12,19}(?![0-9A-Za-z_-])",
    "secret": r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{24,}+(?![/+=])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame)\.?\x20[A-Z][a-z]++(?:\x20[A-Z][a-z]++)?",
}
#: Characters that a text must hold for a kind to be searched at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]", "email_masked": r"[\[(]at[\])]", "phone_local": r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", "account": r"[0-9]{12}", "secret": r"[A-Za-z0-9_-]{24}", "name": r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame)\.?\x20[A-Z]"}
#: Given names.
NAMES = (
    "ahmed alice andrew anna anthony barbara brian carlos carol charles christopher claire daniel david deborah donald dorothy edward elizabeth emily emma "
    "fatima francis george hannah helen henry james jennifer jessica john jose joseph karen kevin laura linda lisa louis lucas margaret maria marie mark "
    "martin mary matthew michael michelle mohammed nancy nicole olivia patricia paul peter pierre rachel richard robert ruth sandra sarah sharon sofia "
    "stephen steven susan thomas timothy victoria william wolfgang"
).split()
#: Entries that a candidate of a kind often holds.
GAZETTEER = {
    "email": r"(?i)@(?:[a-z0-9-]+\.)*(?:gmail|hotmail|yahoo|outlook|example|mail[0-9]*)\.|\.(?:com|org|net|edu|gov|de|fr|es|io)$|^(?:" + "|".join(NAMES) + r")(?![a-z])",
    "ip": r"^(?:10|127|172|192|[1-9][0-9]?|1[0-9][0-9]|2[01][0-9]|22[0-3])\.",
    "card": r"^[3-6]",
    "phone": r"^\+(?:1|3[0-9]|4[0-9])[^0-9]",
    "email_masked": r"(?i)(?:gmail|hotmail|yahoo|outlook|example|com|org|net)$|^(?:" + "|".join(NAMES) + r")(?![a-z])",
    "phone_local": r"^\(?[2-9]",
    "account": r"^[0-9]{16}$|^[3-6]",
    "secret": r"^(?:sk|pk|gh[pousr]|AKIA|xox[abp]|[0-9a-f]{32,128}$|[0-9A-F]{32,128}$)",
    "name": r"(?i)\x20(?:" + "|".join(NAMES) + r")(?![a-z])",
}
#: Words that announce such data shortly before it.
CONTEXT = {
    "email": r"(?i)(?:mail|contact|reach|write|from|to)[^A-Za-z0-9]{0,6}$",
    "ip": r"(?i)(?:\bip|addr|address|host|server|from|client)[^A-Za-z0-9]{0,6}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|payment)[^A-Za-z0-9]{0,6}$",
    "phone": r"(?i)(?:tel|phone|call|mobile|fax|cell)[^A-Za-z0-9]{0,6}$",
    "email_masked": r"(?i)(?:mail|contact|reach|write)[^A-Za-z0-9]{0,6}$",
    "phone_local": r"(?i)(?:tel|phone|call|mobile|fax|cell)[^A-Za-z0-9]{0,6}$",
    "account": r"(?i)(?:card|account|konto|compte|cuenta|number|no)[^A-Za-z0-9]{0,6}$",
    "secret": r"(?i)(?:token|key|secret|password|passwd|pwd|bearer|auth)[^A-Za-z0-9]{0,6}$",
    "name": r"(?i)(?:dear|by|from|contact|name|with|to)[^A-Za-z0-9]{0,6}$",
}
KINDS = (*BASE, *MORE)
THRESHOLD = 0.5
#: What the classifier sees beside the kind, with the number of values of each.
FEATURES = {"form": 2, "known": 2, "announced": 2, "size": 4, "digits": 3, "cased": 4, "left": 4, "right": 4}
#: Kinds x features; more rows than this never reach the driver.
MAX_PATTERNS = len(KINDS) * int(np.prod(list(FEATURES.values())))
#: Characters before a candidate that the context labeler reads.
BEFORE = 24


#: Powers of two below the number of elements that an array can have.
POWERS = [1 << k for k in range(31)]


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def running(numbers: Column) -> Column:
    """Sums of an array up to and with each element, by doubling the reach: n log n steps, no growing array."""
    reaches = F.filter(F.array(*[F.lit(x) for x in POWERS]), lambda reach: reach < F.size(numbers))
    return F.aggregate(reaches, numbers, lambda sums, reach: F.transform(sums, lambda x, i: x + F.when(i >= reach, F.get(sums, i - reach)).otherwise(0)))


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, found) of all matches, leftmost and non-overlapping; positions in code points.

    The pieces between matches and the matches themselves come from the same pattern, so their lengths add up.
    """
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("own"))

    def placed(p: Column) -> Column:
        steps = F.transform(p["own"], lambda m, i: F.length(m) + F.length(F.get(p["gaps"], i)))
        place = lambda end, m: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("found"))
        return F.zip_with(bound(steps, running), p["own"], place)

    return bound(parts, placed)


def meets(spans: Column, c: Column) -> Column:
    """Whether a candidate overlaps any of the spans, which are in order and don't overlap: by halving, the last one that
    begins before its end."""
    steps = F.filter(F.array(*[F.lit(x) for x in reversed(POWERS)]), lambda step: step <= F.size(spans))
    before = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(spans, n + step - 1)["start"] < c["end"], n + step).otherwise(n))
    return F.coalesce(F.get(spans, before - 1)["end"] > c["start"], F.lit(False))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Checksum of a string of digits."""
    each = F.split(F.reverse(digits), "")
    doubled = F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: str, found: Column) -> Column:
    """Whether the form of a match is that of the kind."""
    n = F.length(_digits(found))
    if kind == "ip":
        # leading zeros don't count; four digits and more are above 255
        parts = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.left(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return n.between(13, 19) & _luhn(F.when(n <= 19, _digits(found)).otherwise(""))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "phone_local":
        return n == 10
    if kind == "account":
        return n.isin(13, 14, 15, 16, 19)
    if kind == "secret":
        return n >= 4
    return F.lit(True)


def beside(c: Column) -> Column:
    """Class of the character next to a candidate: none or white space, quote or bracket, = or :, other."""
    return F.when((c == "") | F.regexp_like(c, F.lit(r"\s")), 0).when(F.regexp_like(c, F.lit(r"[\"'`()\[\]{}<>]")), 1).when(c.isin("=", ":"), 2).otherwise(3)


def candidates(text: Column) -> Column:
    """Array of (kind, start, end, base and FEATURES): candidates, the votes on them and what the text shows."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*[_of_kind(kind, text) for kind in KINDS])


def _of_kind(kind: str, text: Column) -> Column:
    def ok(m: Column) -> Column:
        return valid(kind, m["found"])

    def voted(m: Column) -> Column:
        before = F.substring(text, F.greatest(F.lit(1), m["start"] + 1 - BEFORE), F.least(F.lit(BEFORE), m["start"]))
        share = F.floor(3 * F.length(_digits(m["found"])) / F.length(m["found"]))
        return F.struct(
            F.lit(kind).alias("kind"),
            m["start"].alias("start"),
            m["end"].alias("end"),
            F.lit(kind in BASE).alias("base"),
            ok(m).cast("int").alias("form"),
            F.regexp_like(m["found"], F.lit(GAZETTEER[kind])).cast("int").alias("known"),
            F.regexp_like(before, F.lit(CONTEXT[kind])).cast("int").alias("announced"),
            F.least(F.lit(3), F.floor((m["end"] - m["start"]) / 12)).cast("int").alias("size"),
            F.least(F.lit(2), share).cast("int").alias("digits"),
            (F.regexp_like(m["found"], F.lit("[A-Z]")).cast("int") + 2 * F.regexp_like(m["found"], F.lit("[a-z]")).cast("int")).alias("cased"),
            beside(F.when(m["start"] > 0, F.substring(text, m["start"], F.lit(1))).otherwise("")).alias("left"),
            beside(F.substring(text, m["end"] + 1, F.lit(1))).alias("right"),
        )

    own = located(text, BASE.get(kind) or MORE[kind])
    # a base match must have a valid form; the rest of the candidates are only voted on
    own = F.transform(F.filter(own, ok) if kind in BASE else own, voted)
    hinted = F.contains(text, F.lit(HINTS[kind])) if kind == "email" else F.regexp_like(text, F.lit(HINTS[kind]))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean," + ",".join(f"{k}:int" for k in FEATURES) + ">>")
    return F.when(hinted, own).otherwise(none)


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Probability of each vote pattern (rows of 0 and 1) to be real, by expectation-maximisation over all counts."""
    p = 0.1 + 0.8 * votes.mean(axis=1)
    for _ in range(rounds):
        on, off = p * counts, (1 - p) * counts
        prior = (on.sum() + 1) / (counts.sum() + 2)
        # how often a labeler votes yes on real and on other candidates, smoothed
        hit = (on @ votes + 2) / (on.sum() + 3)
        false = (off @ votes + 1) / (off.sum() + 3)
        a = np.log(prior) + votes @ np.log(hit) + (1 - votes) @ np.log(1 - hit)
        b = np.log(1 - prior) + votes @ np.log(false) + (1 - votes) @ np.log(1 - false)
        p = 1 / (1 + np.exp(np.clip(b - a, -50, 50)))
    return p


def classifier(patterns: list[tuple], rounds: int = 500) -> dict[str, list[float]]:
    """Weights by value of the kind (as KINDS lists them) and of each feature, from (kind, features, count) tuples."""
    sizes = {"kind": len(KINDS)} | FEATURES
    ends = np.cumsum(list(sizes.values()))
    w = np.zeros(ends[-1])
    if patterns:
        counts = np.array([r[-1] for r in patterns], float)
        kinds = np.array([KINDS.index(r[0]) for r in patterns])
        values = np.column_stack([kinds, np.array([r[1:-1] for r in patterns], int)])
        soft = np.zeros(len(patterns))
        for kind in np.unique(kinds):
            own = kinds == kind
            soft[own] = reliabilities(values[own, 1:4].astype(float), counts[own])
        x = np.zeros((len(patterns), len(w)))
        for j, first in enumerate(ends - list(sizes.values())):
            x[np.arange(len(x)), first + values[:, j]] = 1
        for _ in range(rounds):  # weighted logistic regression on soft labels
            p = 1 / (1 + np.exp(-x @ w))
            w -= 2.0 * (x.T @ (counts * (p - soft)) / counts.sum() + 1e-4 * w)
    return {k: w[e - n : e].tolist() for (k, n), e in zip(sizes.items(), ends)}


def probability(c: Column, weights: dict[str, list[float]]) -> Column:
    """The classifier's probability of a candidate."""
    listed = lambda k: F.array(*[F.lit(x) for x in weights[k]])
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), c["kind"]).cast("int")
    z = F.element_at(listed("kind"), kind)
    for k in FEATURES:
        z = z + F.element_at(listed(k), c[k] + 1)
    return 1 / (1 + F.exp(-z))


PATTERN = ("kind", *FEATURES)


def find(docs: DataFrame) -> DataFrame:
    """Every row of ``docs``: its columns but text in a struct ``row`` (a caller can keep the text under another name), and ``spans``:
    an array of (rank, start, end, kind, base, probability), by kind as listed and start."""
    own = [c for c in docs.columns if c != "text"]
    held = cut(docs.select(F.struct(*[docs[f"`{c}`"] for c in own]).alias("row"), candidates(docs["text"]).alias("found")))
    counted = held.select(F.explode("found").alias("c")).groupBy(*[F.col(f"c.{k}").alias(k) for k in PATTERN]).agg(F.count("*").alias("n"))
    patterns = sorted(tuple(r) for r in counted.limit(MAX_PATTERNS).collect())  # the limit is above the number of patterns
    weights = classifier(patterns)
    rank = F.create_map(*[F.lit(v) for i, k in enumerate(KINDS) for v in (k, i)])
    scored = F.transform("found", lambda c: F.struct(F.element_at(rank, c["kind"]).alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["base"].alias("base"), probability(c, weights).alias("probability")))
    # the table is small: ids and spans
    spans = cut(held.select("row", scored.alias("scored")))

    def staying(all_: Column) -> Column:
        """Base candidates, and those that the classifier takes and that meet none of them; base ones of a kind are in order."""
        line = lambda kind: F.filter(all_, lambda b: b["base"] & (b["kind"] == kind))
        of_kinds = F.struct(*[line(kind).alias(kind) for kind in BASE])
        free = lambda c, base: ~reduce(or_, [meets(base[kind], c) for kind in BASE])
        return bound(of_kinds, lambda base: F.filter(all_, lambda c: c["base"] | ((c["probability"] >= THRESHOLD) & free(c, base))))

    return cut(spans.select("row", F.array_sort(staying(F.col("scored"))).alias("spans")))
