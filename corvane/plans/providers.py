"""Model-backed steps behind plain functions, with deterministic defaults that run offline.

Providers are called through ``stages.called`` and may be retried, so they must
be idempotent.  The defaults are stand-ins, not models.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np

_WORD = re.compile(r"\w+")


def hashed_vector(text: str, size: int = 64) -> list[float]:
    """Feature hashing of lower-case words into a unit vector."""
    v = np.zeros(size)
    for w in _WORD.findall(text.lower()):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        v[h % size] += 1.0 if h >> 63 else -1.0
    n = float(np.sqrt((v * v).sum()))
    return (v / n if n else v).tolist()


def overlap_score(question: str, passage: str) -> float:
    """Share of the question's words that the passage has."""
    q = set(_WORD.findall(question.lower()))
    return len(q & set(_WORD.findall(passage.lower()))) / len(q) if q else 0.0


def extractive_answer(question: str, passages: list[str], most: int = 3) -> str:
    """The sentence nearest to the question from each of the first passages, with its marker."""
    lines = []
    for i, p in enumerate(passages[:most], 1):
        parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+", p) if s.strip()]
        if parts:
            lines.append(f"{max(parts, key=lambda s: (overlap_score(question, s), -parts.index(s)))} [{i}]")
    return "\n".join(lines) or "The provided documents do not contain enough information to answer this question."


def parse_json(text: str) -> object:
    """The JSON value in a reply: without its code fence, else the first span that parses; None when none does."""
    body = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text)
    decoder = json.JSONDecoder()
    try:
        return json.loads(body)
    except ValueError:
        pass
    for m in re.finditer(r"[\[{]", body):
        try:
            return decoder.raw_decode(body, m.start())[0]
        except ValueError:
            continue
    return None


def clean_variants(items: object, original: str, most: int) -> list[str]:
    """Distinct strings, white space collapsed, without the original; case does not tell them apart."""
    seen, out = {" ".join(original.split()).casefold()}, []
    for item in items if isinstance(items, list) else []:
        text = " ".join(item.split()) if isinstance(item, str) else ""
        if text and text.casefold() not in seen:
            seen.add(text.casefold())
            out.append(text)
    return out[:most]


class KeyRotator:
    """Keys in turn; a key that was refused for a scope is left out there until its time is over."""

    def __init__(self, keys: list[str], clock: Callable[[], float] = time.monotonic) -> None:
        self.keys, self.clock, self.next = list(dict.fromkeys(k for k in keys if k)), clock, 0
        self.blocked: dict[tuple[str, str], float] = {}

    def block(self, key: str, scope: str, seconds: float) -> None:
        self.blocked[key, scope] = self.clock() + seconds

    def take(self, scope: str = "") -> str | None:
        """The next key that is not blocked for the scope, None when all are."""
        now = self.clock()
        for i in range(len(self.keys)):
            key = self.keys[(self.next + i) % len(self.keys)]
            if self.blocked.get((key, scope), now) <= now:
                self.next = (self.next + i + 1) % len(self.keys)
                return key
        return None


class AllKeysBlocked(RuntimeError):
    pass


def call_with_rotation(call: Callable[[str], Any], rotator: KeyRotator, scope: str = "", refused: Callable[[Exception], float | None] = lambda e: None) -> Any:
    """The call with one key after the other: ``refused`` says for how long an error blocks the key, None that it is not the key's fault."""
    while (key := rotator.take(scope)) is not None:
        try:
            return call(key)
        except Exception as e:
            wait = refused(e)
            if wait is None:
                raise
            rotator.block(key, scope, wait)
    raise AllKeysBlocked(f"no key is left for {scope or 'this call'}")


def call_with_retries(call: Callable[[], Any], waits: tuple[float, ...] = (10.0, 30.0, 60.0, 120.0), transient: Callable[[Exception], bool] = lambda e: True, deadline: float | None = None, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> Any:
    """The call again after each wait while it fails for a passing reason, and no wait beyond the deadline (seconds from now)."""
    end = None if deadline is None else clock() + deadline
    for wait in (*waits, None):
        try:
            return call()
        except Exception as e:
            if wait is None or not transient(e) or end is not None and clock() + wait > end:
                raise
            sleep(wait)
    raise AssertionError


def overlap_verdicts(claims: list[str], evidence: list[str], least: float = 0.5) -> str:
    """Stand-in for a verifier: a claim is supported when its evidence has enough of its words."""
    plain = lambda c: re.sub(r"\[[\d,; ]+\]", " ", c)
    judged = [{"index": i, "supported": overlap_score(plain(c), e) >= least, "reason": "shared words"} for i, (c, e) in enumerate(zip(claims, evidence, strict=True))]
    return json.dumps({"claims": judged, "safety": {"verdict": "pass", "reason": ""}})


def rewrite_query(question: str, excerpts: str) -> str:
    """Stand-in for a rewrite: the question as it is."""
    return question


@dataclass(frozen=True)
class Providers:
    embed: Callable[[str], list[float]] = hashed_vector
    rerank: Callable[[str, str], float] = overlap_score
    answer: Callable[[str, list[str]], str] = extractive_answer
    expand: Callable[[str], list[str]] = field(default=lambda question: [])
    verdict: Callable[[str, list[str]], str] = field(default=lambda question, passages: "insufficient")
    web: Callable[[str], list[dict]] = field(default=lambda question: [])
    rewrite: Callable[[str, str], str] = rewrite_query
    resolve: Callable[[str, str], str | None] = field(default=lambda question, conversation: None)
    verify: Callable[[list[str], list[str]], str | None] = overlap_verdicts
    decompose: Callable[[str], list[str]] = field(default=lambda question: [])
    unsafe: Callable[[str], str | None] = field(default=lambda question: None)
