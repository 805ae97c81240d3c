"""Scalar text functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: ASCII punctuation, a group of citation markers, a number
PUNCTUATION = r"[!-/:-@\[-`{-~]"
MARKER_GROUP = r"\[\s*(\d+(?:\s*[,;]\s*\d+)*)\s*\]"
NUMBER = r"\d+(?:[.,]\d+)*"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it: projections may be merged, lambdas are not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokenize(text: Column) -> Column:
    """Lower case, ASCII punctuation deleted, split on white space."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), PUNCTUATION, ""), r"\s+"), lambda x: x != "")


def collapse(text: Column) -> Column:
    """White space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sanitize(text: Column) -> Column:
    return collapse(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def word_set(text: Column) -> Column:
    """Distinct words for near-duplicate tests (lower case; differs from case folding for letters such as ß)."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([A-Za-z0-9_À-ÿ]+)"), F.lit(1))))


def alike(a: Column, b: Column, least_percent: int) -> Column:
    """Whether two sets, arrays without repeats, have a Jaccard similarity of so many percent; where their sizes rule it out no elements are compared."""
    few, many = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return F.when((many == 0) | (few * 100 < many * least_percent), F.lit(False)).otherwise(let(common, lambda n: n * 100 >= (F.size(a) + F.size(b) - n) * least_percent))


def numbers(text: Column) -> Column:
    """The multiset of numbers in a text, thousands separators removed, in order."""
    return F.array_sort(F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit(""))))


def markers(answer: Column) -> Column:
    """Distinct citation numbers in order of first appearance."""
    groups = F.regexp_extract_all(answer, F.lit(MARKER_GROUP), F.lit(1))
    return F.array_distinct(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*[,;]\s*"))), lambda x: x.cast("int")))


def strip_markers(text: Column) -> Column:
    return collapse(F.regexp_replace(text, MARKER_GROUP, " "))


def tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"[ \t]+([.,;:!?])", "$1"))


def chunk_id(scope: Column, source_doc: Column, method: Column, kind: Column, page: Column, location: Column, index: Column, text: Column) -> Column:
    """First 24 hex digits of SHA-256 over eight fields; nulls are empty fields, the text is hashed on its own."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    parts = [blank(x) for x in (scope, source_doc, method, kind, page, location, index)]
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts, F.sha2(text, 256)), 256), 1, 24)


def entry_id(scope: Column, question: Column) -> Column:
    return F.sha2(F.concat(scope, F.lit("\x00"), question), 256)


def document_key(document: Column) -> Column:
    return F.concat(F.lit("doc:"), F.substring(F.sha2(document, 256), 1, 24))


def canonical_url(url: Column) -> Column:
    """Without fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")


def valid_url(url: Column) -> Column:
    return url.rlike(r"(?i)^\s*https?://[^/?#\s]+")


def snippet(text: Column, chars: int = 200) -> Column:
    return F.substring(collapse(text), 1, chars)


def summarize_answer(answer: Column, chars: int = 200) -> Column:
    """At most ``chars`` characters: the last sentence end in the second half, else the last word and an ellipsis."""
    text = strip_markers(answer)
    window = F.substring(text, 1, chars)
    sentence = F.regexp_extract(window, r"^(.*[.!?])(?=\s|$)", 1)
    word = F.concat(F.regexp_replace(F.regexp_replace(window, r" [^ ]*$", ""), r"[,;:]+$", ""), F.lit("…"))
    return F.when(F.length(text) <= chars, text).when(F.length(sentence) >= chars // 2, sentence).otherwise(word)


def seconds(duration: Column) -> Column:
    """'1m30s' or '250ms' as seconds; a bare number is seconds; null when neither."""
    parts = F.regexp_extract_all(duration, F.lit(r"([\d.]+(?:ms|h|m|s))"), F.lit(1))
    unit = lambda x: F.when(x.endswith("ms"), 0.001).when(x.endswith("h"), 3600.0).when(x.endswith("m"), 60.0).otherwise(1.0)
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + F.regexp_extract(x, r"^([\d.]+)", 1).cast("double") * unit(x))
    return F.coalesce(F.expr("NULL").cast("double"), F.when(duration.rlike(r"^\s*[\d.]+\s*$"), F.trim(duration).cast("double")), F.when(F.size(parts) > 0, total))


def suffix(filename: Column) -> Column:
    """Lower case after the last dot; the whole name where there is none."""
    return F.lower(F.element_at(F.split(filename, r"\."), -1))


def elapsed_ms(began: Column, ended: Column) -> Column:
    """Milliseconds between two times in seconds, one decimal."""
    return F.round((ended - began) * 1000, 1)


def billed_tokens(candidates: Column, thoughts: Column) -> Column:
    """Output tokens that are charged: the answer's and those of thinking."""
    return F.coalesce(candidates, F.lit(0)) + F.coalesce(thoughts, F.lit(0))


# fixed values: what errors of rate limits, overload and daily quotas say
RATE_LIMIT = ("429", "resource_exhausted", "rate limit", "quota")
OVERLOAD = ("503", "unavailable", "high demand", "overloaded")
DAILY = "perday"


def error_kind(message: Column) -> Column:
    """'daily_quota', 'rate_limit', 'overload' or 'other' by what the error says."""
    low = F.lower(message)
    says = lambda marks: F.greatest(*[low.contains(m).cast("int") for m in marks]) == 1
    return F.when(low.contains(DAILY), "daily_quota").when(says(RATE_LIMIT), "rate_limit").when(says(OVERLOAD), "overload").otherwise("other")


def reset_seconds(retry_after: Column, tokens: Column, requests: Column, most: float = 60.0) -> Column:
    """How long to wait: the first of three headers that is a duration, else the most."""
    return F.coalesce(seconds(retry_after), seconds(tokens), seconds(requests), F.lit(most))


def sse_frame(event: Column, data: Column) -> Column:
    """A server-sent event of a name and a JSON line."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def sse_parts(frame: Column) -> Column:
    """(event, data) of a frame; data lines are joined."""
    lines = F.split(frame, "\n")
    after = lambda name: F.transform(F.filter(lines, lambda x: x.startswith(name)), lambda x: F.trim(F.substring(x, len(name) + 1, 1 << 30)))
    return F.struct(F.get(after("event:"), F.lit(0)).alias("event"), F.array_join(after("data:"), "\n").alias("data"))


def first_json(reply: Column) -> Column:
    """The first JSON object in a model's reply, as its text: alone, in a code fence or amid prose; null where there is none.

    A name that an object has twice makes it none.
    """
    def spans(body: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(body), F.lit(1))), lambda i: F.substring(body, i, F.lit(1)) == "{")
        found = F.transform(places, lambda i: F.to_json(F.try_parse_json(F.substring(body, i, F.length(body)))))
        return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))

    return let(reply, spans)
