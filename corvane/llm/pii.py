"""Personal data by weak supervision.

Base spans are exact: four patterns with their checks.  Beyond them, looser
candidates are found and labelers vote on each: pattern labelers, a gazetteer
of words that announce such data, and context labelers on the neighbouring
characters.  Expectation-maximisation estimates every labeler's reliability
from the votes of all candidates (conditional independence given the true
class; base spans are known).  Its posteriors train the final classifier, a
logistic model of what the span looks like: its length, its digits, its shape,
its separators and the hashed words around it; the votes are not among its
features.  Candidates that it accepts and that overlap no base span are added.

The votes come to the driver as counts of distinct vote patterns, of which
there are at most 4 * 2 * 3**LABELERS.  The classifier is fitted on a bounded
sample: of each kind, the ``sample`` distinct feature sets with the least
hashes among base spans and as many among the others, weighed by how often
they occur.

Every scan is linear in the text: a run of characters is read a fixed number
of times, however long it is.

Defined results: null is the empty text; a text of any length is read whole;
spans are in code points, end exclusive; equal texts have equal spans, and
repeated rows are separate rows; kinds may overlap each other; of one kind the
leftmost match stands; an empty table gives no rows; columns other than doc_id
and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import least_rows, materialize, text_or_empty

KINDS = ("email", "ip", "card", "phone")
# fixed patterns of the base spans
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Numbers joined by dots, whole; ``BASE["ip"]`` matches every four of them.
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_AT = re.compile(r"@|\(at\)|\[at\]|\{at\}")
_DOMAIN = re.compile(r"\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[A-Za-z0-9-]++)++")
LOOSE = {
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20./-]{1,3}[0-9]{4}){2}[\x20./-]{1,3}[0-9]{1,7})(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?|00[0-9]{1,3}[\x20.-]?|\([0-9]{2,4}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9A-Za-z])"),
}
# words that announce a kind, in the corpus's languages
GAZETTEER = {
    "email": frozenset(("email", "e-mail", "mail", "correo", "courriel", "contact", "kontakt", "write", "reach")),
    "ip": frozenset(("ip", "host", "server", "address", "adresse", "serveur", "servidor", "client", "login")),
    "card": frozenset(("card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta", "payment", "credit")),
    "phone": frozenset(("phone", "tel", "call", "fax", "mobile", "cell", "telefon", "telefono", "telephone", "portable")),
}
_DENIED = re.compile(r"(?:\bno|\bnr|\bref|\bid|isbn|issn|version|order|invoice|token|key|secret|password)[^a-z]{0,4}$")
_WORD = re.compile(r"[^\W\d_][\w-]*")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABELERS = 6
NEAR = 32  # characters looked at on either side of a candidate
SAMPLE = 4_096
#: Features: a constant, lengths, digit shares, characters on either side, hashed shapes, hashed words before and after.
LENGTHS, SHARES, SIDES, SHAPES, BEFORE, AFTER = 24, 6, 10, 128, 128, 64
FEATURES = 1 + LENGTHS + SHARES + SIDES + SHAPES + BEFORE + AFTER


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 if d < 5 else d * 2 - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Per kind, the leftmost non-overlapping matches that pass the kind's check."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if "." in text:
        out["ip"] = _addresses(text)
    out["card"] = [m.span() for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out["phone"] = [m.span() for m in BASE["phone"].finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _emails(text: str) -> list[tuple[int, int]]:
    """The pattern's matches, tried only where an @ stands: the local part begins at the run of its characters before it."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = _run_before(text, at, free)
        m = BASE["email"].match(text, start) if start < at else None
        if m:
            out.append(m.span())
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def _run_before(text: str, at: int, floor: int) -> int:
    while at > floor and text[at - 1] in _LOCAL:
        at -= 1
    return at


def _addresses(text: str) -> list[tuple[int, int]]:
    """Every four of the numbers that dots join are a match; it stands if none is above 255."""
    out = []
    for m in _DOTTED.finditer(text):
        at, parts = m.start(), m[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p) <= 3 and int(p) <= 255 or len(s := p.lstrip("0")) <= 3 and int(s or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def _spelt_emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with the at sign or the dots spelt out or spaced, worked outwards from the sign."""
    free = 0
    for m in _AT.finditer(text):
        at = m.start()
        if at < free:
            continue
        stop = at - 1 if at > free and text[at - 1] == " " else at
        start = _run_before(text, stop, free)
        tail = _DOMAIN.match(text, m.end()) if start < stop else None
        if tail:
            free = tail.end()
            yield start, free


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """One vote per labeler: 1 for personal data, -1 against, 0 abstains."""
    span, before, after = text[start:end], text[max(0, start - NEAR) : start].lower(), text[end : end + NEAR].lower()
    digits = _digits(span)
    n = len(digits)
    words = set(_WORD.findall(before))
    letters = sum(c.isalpha() for c in span)
    wanted = {"email": letters >= 5, "ip": True, "card": 13 <= n <= 19 and luhn(digits), "phone": 9 <= n <= 15}[kind]
    against = {"email": letters < 3, "ip": False, "card": not 13 <= n <= 19 or not luhn(digits), "phone": not 9 <= n <= 15}[kind]
    if kind == "email":  # the last label of a domain is a word
        last = re.split(r"[^A-Za-z0-9-]+", span)[-1]
        regular = 1 if last.isalpha() and 2 <= len(last) <= 24 else -1
    else:  # one sort of separator, and digits that are no mere row
        marks = {c for c in span if c in "./-: "}
        regular = -1 if n and len(set(digits)) <= 2 else 1 if len(marks) <= 1 + ("(" in span) else 0
    return (
        1 if wanted else -1 if against else 0,
        1 if words & GAZETTEER[kind] else -1 if any(words & GAZETTEER[k] for k in KINDS if k != kind) else 0,
        1 if before.rstrip()[-1:] in (":", "=") else 0,
        -1 if before[-1:].isalnum() or after[:1].isalnum() else 1,
        -1 if _DENIED.search(before) else 0,
        regular,
    )


def _slot(text: str, size: int) -> int:
    return zlib.crc32(text.encode()) % size


def features(text: str, start: int, end: int) -> list[int]:
    """Numbers of the features that a span has: of itself and of the words around it."""
    span = text[start:end]
    runs = "".join(f"{c}{min(19, n)}" if c in "9x" else c for c, n in _shape(span))
    before, after = text[max(0, start - NEAR) : start].lower(), text[end : end + NEAR].lower()
    sides = [1 if c.isalpha() else 2 if c.isdigit() else 3 if c in "@_/\\" else 4 if c else 0 for c in (text[start - 1 : start] if start else "", text[end : end + 1])]
    at, out = 1, [0]
    out.append(at + min(LENGTHS - 1, len(span) // 2))
    at += LENGTHS
    out.append(at + len(_digits(span)) * (SHARES - 1) // max(1, len(span)))
    at += SHARES
    out += [at + sides[0], at + 5 + sides[1]]
    at += SIDES
    out.append(at + _slot(runs, SHAPES))
    at += SHAPES
    out += [at + _slot(w, BEFORE) for w in _WORD.findall(before)]
    at += BEFORE
    out += [at + _slot(w, AFTER) for w in _WORD.findall(after)]
    return sorted(set(out))


def _shape(span: str) -> list[tuple[str, int]]:
    """Runs of digits (9) and letters (x) with their lengths; other characters as they are."""
    out: list[tuple[str, int]] = []
    for c in span:
        c = "9" if "0" <= c <= "9" else "x" if c.isalpha() else c
        if out and out[-1][0] == c:
            out[-1] = (c, out[-1][1] + 1)
        else:
            out.append((c, 1))
    return out


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, is base): every base span, and looser matches that overlap no base span of any kind."""
    out = [(k, s, e, True) for k in KINDS for s, e in base[k]]
    starts: list[int] = []  # the union of the base spans, in order
    ends: list[int] = []
    for s, e in sorted((s, e) for _, s, e, _ in out):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for kind in KINDS:
        found = _spelt_emails(text) if kind == "email" else (m.span() for m in LOOSE[kind].finditer(text))
        for s, e in found:
            i = bisect_right(starts, s)
            if (not i or ends[i - 1] <= s) and (i == len(starts) or e <= starts[i]):
                out.append((kind, s, e, False))
    return out


def posteriors(patterns: list[tuple[str, tuple[int, ...], bool, int]], rounds: int = 50) -> dict[tuple[str, tuple[int, ...], bool], float]:
    """Chance that a candidate of each (kind, votes, is base) is personal data, from (kind, votes, is base, count)."""
    out: dict[tuple[str, tuple[int, ...], bool], float] = {}
    for kind in KINDS:
        own = [(v, b, n) for k, v, b, n in patterns if k == kind]
        if not own:
            continue
        v = np.array([x for x, _, _ in own], dtype=float)
        anchored = np.array([b for _, b, _ in own])
        n = np.array([c for _, _, c in own], dtype=float)
        # chances of each vote given the class, with one pseudo-count
        post = np.where(anchored, 1.0, np.clip(0.5 + 0.15 * v.sum(axis=1), 0.05, 0.95))
        for _ in range(rounds):
            prior = float(np.clip((n * post).sum() / n.sum(), 0.02, 0.98))
            log_odds = np.full(len(own), math.log(prior / (1 - prior)))
            for j in range(LABELERS):
                for value in (-1, 0, 1):
                    is_it = v[:, j] == value
                    yes = ((n * post)[is_it].sum() + 1.0 + 2.0 * (value == 1)) / ((n * post).sum() + 5.0)
                    no = ((n * (1 - post))[is_it].sum() + 1.0 + 2.0 * (value == -1)) / ((n * (1 - post)).sum() + 5.0)
                    log_odds[is_it] += math.log(yes / no)
            post = np.where(anchored, 1.0, 1 / (1 + np.exp(-np.clip(log_odds, -30, 30))))
        out |= {(kind, x, b): float(p) for (x, b, _), p in zip(own, post, strict=True)}
    return out


def fit(examples: list[tuple[str, tuple[int, ...], float, float]]) -> dict[str, list[float]]:
    """Weights of the span classifier per kind, from (kind, features, chance, weight): ridge logistic regression on soft labels."""
    model = {}
    for kind in KINDS:
        own = [(f, p, n) for k, f, p, n in examples if k == kind]
        x = np.zeros((len(own), FEATURES))
        for i, (f, _, _) in enumerate(own):
            x[i, list(f)] = 1.0
        y, mass = np.array([p for _, p, _ in own]), np.array([n for _, _, n in own], dtype=float)
        used = np.flatnonzero(x.any(axis=0)) if own else np.zeros(0, dtype=int)
        x, w = x[:, used], np.zeros(len(used))
        mass = mass / mass.mean() if own else mass
        ridge = np.where(used == 0, 1e-6, 1.0)
        for _ in range(25 if own else 0):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve(x.T @ (x * (mass * p * (1 - p))[:, None]) + np.diag(ridge + 1e-9), x.T @ (mass * (y - p)) - ridge * w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        full = np.zeros(FEATURES)
        full[used] = np.round(w, 9)
        model[kind] = full.tolist()
    return model


def accepts(model: dict[str, list[float]], kind: str, feats: list[int], floor: float = 0.5) -> bool:
    score = sum(model[kind][i] for i in feats)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, score)))) > floor


_SPAN = "struct<kind:string,s:long,e:long,base:boolean,vote:array<int>,feat:array<int>>"


def find_spans(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id and spans (kind, s, e, base) in order of kind and start, for every row; reads the texts once."""

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                found = candidates(t, base_spans(t))
                out.append([{"kind": k, "s": s, "e": e, "base": b, "vote": list(votes(k, t, s, e)), "feat": features(t, s, e)} for k, s, e, b in found])
            yield pd.Series(out)

    found = materialize(docs.select("doc_id", F.pandas_udf(scan, f"array<{_SPAN}>")(text_or_empty()).alias("found")), "pii-candidates")
    each = found.select(F.explode("found").alias("f"))
    counted = each.groupBy("f.kind", "f.vote", "f.base").agg(F.count(F.lit(1)).alias("n"))
    patterns = sorted((r["kind"], tuple(r["vote"]), r["base"], int(r["n"])) for r in counted.collect())  # 4 * 2 * 3**LABELERS rows at most
    chance = posteriors(patterns)
    distinct = each.groupBy("f.kind", "f.base", "f.vote", "f.feat").agg(F.count(F.lit(1)).alias("n"))
    ticket = F.xxhash64("feat", "vote")
    picked = least_rows(distinct, ["kind", "base"], [ticket, F.col("feat"), F.col("vote")], sample, "i", F.shiftright(ticket, 20)).collect()  # 8 * sample rows at most
    examples = sorted((r["kind"], tuple(r["feat"]), chance[r["kind"], tuple(r["vote"]), r["base"]], float(r["n"])) for r in picked)
    model = fit(examples)

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([[bool(x["base"]) or accepts(model, x["kind"], x["feat"]) for x in spans] for spans in rows])

    order = F.create_map(*[F.lit(y) for i, k in enumerate(KINDS) for y in (k, i)])
    loose = F.exists("found", lambda x: ~x["base"])
    # documents of base spans alone, the most, are not sent to Python again
    judged = found.filter(loose).withColumn("keep", F.pandas_udf(judge, "array<boolean>")("found"))
    kept = F.transform(F.filter(F.arrays_zip("found", "keep"), lambda x: x["keep"]), lambda x: x["found"])
    both = judged.select("doc_id", kept.alias("found")).unionByName(found.filter(~loose).select("doc_id", "found"))
    ranked = F.array_sort(F.transform("found", lambda x: F.struct(order[x["kind"]].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), x["base"].alias("base"))))
    return both.select("doc_id", ranked.alias("spans"))


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def digest(spans: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and the text of all spans."""
    base = F.filter("spans", lambda x: x["base"])
    line = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    counts = [F.size(F.filter(base, _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return spans.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


__all__ = ["find_spans", "digest", "base_spans", "candidates", "posteriors", "fit", "accepts", "features", "luhn", "votes"]
