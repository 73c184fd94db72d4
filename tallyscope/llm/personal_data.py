"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URL schemes and cue words
for accounts and streets. Each anchor goes to a small deterministic parser that expands it to the left and
right and validates the span.

Base kinds (leftmost, non-overlapping within a kind):

* ``email``: local part and dotted domain around an at-sign
* ``ip``: four dotted numbers, each at most 255
* ``card``: 14 to 19 digits, single spaces or hyphens between them, Luhn checksum
* ``phone``: plus sign, 10 to 15 digits with spaces, dots, brackets and hyphens

Further kinds, found by the same pass (they may overlap base spans and never replace them):

* ``url``: scheme, host and everything up to a blank, quote or angle bracket
* ``iban``: two letters, two check digits and 11 to 30 characters after a cue word, ISO 7064 mod 97-10
* ``account``: 6 to 18 digits after an account cue
* ``street``: a house number before, or a number after, a street word
"""

from __future__ import annotations

import string
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import from_arrow_type

from tallyscope.llm.tokens import in_small_batches

KINDS = ("email", "ip", "card", "phone", "url", "iban", "account", "street")

# Cue words, matched without regard to case and only between non-letters.
ACCOUNT_CUES = ("account", "acct", "konto", "kontonummer", "compte", "cuenta")
IBAN_CUES = ("iban",)
STREET_CUES = ("street", "avenue", "boulevard", "lane", "straße", "strasse", "calle", "avenida", "rue")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")

_DIGITS = frozenset(string.digits)
_ALNUM = frozenset(string.ascii_letters + string.digits)
_LOCAL = _ALNUM | frozenset("._%+-")
_HOST = _ALNUM | frozenset("-")
_DIALLED = _DIGITS | frozenset(" ().-")
_URL_END = frozenset(" \t\n\r\f\v\"'<>")

_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
SPANS = from_arrow_type(_SPANS)


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    words = {digit: ("digit", 1) for digit in string.digits}
    words |= {"@": ("at", 1), "+": ("plus", 1)}
    for name, cues in (("scheme", SCHEMES), ("account", ACCOUNT_CUES), ("iban", IBAN_CUES), ("street", STREET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                words[form] = (name, len(form))
    for word, value in words.items():
        found.add_word(word, value)
    found.make_automaton()
    return found


def _run(text: str, at: int, allowed: frozenset) -> int:
    """End of the run of allowed characters that starts at ``at``."""
    size = len(text)
    while at < size and text[at] in allowed:
        at += 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 if value > 4 else value * 2
        total += value
    return total % 10 == 0


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign; its local part starts at ``floor`` or later."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _HOST)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in _HOST:
        end = _run(text, end + 1, _HOST)
        labels += 1
    return (start, end) if labels else None


def card_at(text: str, start: int) -> tuple[int, str]:
    """End and digits of the run of digits with single separators that starts at ``start``."""
    end, parts, size = start, [], len(text)
    while True:
        stop = _run(text, end, _DIGITS)
        parts.append(text[end:stop])
        end = stop
        if end + 1 < size and text[end] in " -" and text[end + 1] in _DIGITS:
            end += 1
        else:
            return end, "".join(parts)


def ip_at(text: str, start: int) -> tuple[int, list[str]] | None:
    """End and parts of four dotted numbers that start at ``start``, whatever their values."""
    end = _run(text, start, _DIGITS)
    parts = [text[start:end]]
    while len(parts) < 4:
        if not (end + 1 < len(text) and text[end] == "." and text[end + 1] in _DIGITS):
            return None
        stop = _run(text, end + 1, _DIGITS)
        parts.append(text[end + 1 : stop])
        end = stop
    return end, parts


def phone_at(text: str, plus: int) -> int | None:
    """End of the dialled number after a plus sign."""
    if plus + 1 >= len(text) or text[plus + 1] not in _DIGITS:
        return None
    end = _run(text, plus + 2, _DIALLED)
    while end > plus + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    return end if end > plus + 3 and text[end - 1] in _DIGITS else None


def _after_cue(text: str, at: int) -> int:
    """Skip what may stand between a cue and its value."""
    size = len(text)
    for word in (" number", " no.", " no", " nr.", " nr", " n°"):
        if text[at : at + len(word)].lower() == word:
            at += len(word)
            break
    while at < size and text[at] in " :#=":
        at += 1
    return at


def _alone(text: str, start: int, end: int) -> bool:
    return not (start and text[start - 1].isalpha()) and not (end < len(text) and text[end].isalpha())


def iban_at(text: str, start: int) -> int | None:
    """End of a valid IBAN, groups separated by single blanks."""
    chars, end, size, best = [], start, len(text), None
    while end < size and len(chars) < 34:
        if text[end] in _ALNUM:
            chars.append(text[end].upper())
            end += 1
            closed = end == size or text[end] not in _ALNUM
            if closed and len(chars) >= 15 and chars[0].isalpha() and chars[1].isalpha():
                moved = "".join(chars[4:] + chars[:4])
                if "".join(chars[2:4]).isdigit() and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1:
                    best = end
        elif text[end] == " " and end + 1 < size and text[end + 1] in _ALNUM and chars:
            end += 1
        else:
            break
    return best


def street_at(text: str, start: int, end: int) -> tuple[int, int] | None:
    """``12 Long Street`` (number, up to three capitalised words) or ``Rue Longue 12``."""
    begin, words = start, 0
    while words < 4 and begin > 1 and text[begin - 1] == " ":
        stop = begin - 1
        first = stop
        while first and text[first - 1].isalnum():
            first -= 1
        word = text[first:stop]
        if word.isdigit() and len(word) <= 5 and word.isascii():
            return (first, end) if words else None
        if not word or not word[0].isupper():
            break
        begin, words = first, words + 1
    stop, words = end, 0
    while words < 4 and stop + 1 < len(text) and text[stop] == " ":
        last = stop + 1
        while last < len(text) and text[last].isalnum():
            last += 1
        word = text[stop + 1 : last]
        if word.isdigit() and len(word) <= 5 and word.isascii():
            return (start, last) if words or text[start].isupper() else None
        if not word or not word[0].isupper():
            break
        stop, words = last, words + 1
    return None


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind as listed."""
    spans: list[tuple[str, int, int]] = []
    email_end = card_end = ip_end = ip_run = url_end = account_end = iban_end = 0
    for last, (name, width) in anchors().iter(text):
        at = last - width + 1
        if name == "digit":
            if at >= card_end:
                card_end, digits = card_at(text, at)
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", at, card_end))
            if at >= ip_run and at >= ip_end:
                ip_run = _run(text, at, _DIGITS)
                if ip_run < len(text) and text[ip_run] == "." and (dotted := ip_at(text, at)):
                    ip_end, parts = dotted
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts):
                        spans.append(("ip", at, ip_end))
        elif name == "at":
            if at >= email_end and (address := email_at(text, at, email_end)):
                spans.append(("email", *address))
                email_end = address[1]
        elif name == "plus":
            if end := phone_at(text, at):
                if 10 <= sum(c in _DIGITS for c in text[at:end]) <= 15:
                    spans.append(("phone", at, end))
        elif name == "scheme":
            if at >= url_end and not (at and text[at - 1].isalpha()):
                end = at + width
                while end < len(text) and text[end] not in _URL_END:
                    end += 1
                while end > at + width and text[end - 1] in ".,;:!?)":
                    end -= 1
                if end > at + width:
                    spans.append(("url", at, end))
                    url_end = end
        elif _alone(text, at, last + 1):
            if name == "account":
                start = _after_cue(text, last + 1)
                end, digits = card_at(text, start) if text[start : start + 1] in _DIGITS else (start, "")
                if 6 <= len(digits) <= 18 and start >= account_end:
                    spans.append(("account", start, end))
                    account_end = end
            elif name == "iban":
                start = _after_cue(text, last + 1)
                end = iban_at(text, start)
                if end and start >= iban_end:
                    spans.append(("iban", start, end))
                    iban_end = end
            elif street := street_at(text, at, last + 1):
                spans.append(("street", *street))
    spans.sort(key=lambda span: (span[1], KINDS.index(span[0]), span[2]))
    return spans


@F.arrow_udf(SPANS)
def personal_spans(texts: pa.Array) -> pa.Array:
    """Column function: text to its spans (kind, start, end in code points, end exclusive); null text has none."""
    rows = [
        [{"kind": kind, "start": start, "end": end} for kind, start, end in find(text)] if text else []
        for text in texts.to_pylist()
    ]
    return pa.array(rows, type=_SPANS)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col`` and ``spans``.

    Null and empty texts have no spans; a null id stays null; repeated rows give repeated rows; other columns
    are not carried, so none can clash. An empty table gives an empty result.
    """
    return in_small_batches(docs).select(F.col(f"`{id_col}`"), personal_spans(F.col(f"`{text_col}`")).alias("spans"))


def masked(docs: DataFrame, text_col: str = "text", mask: str = "<{}>") -> DataFrame:
    """The same rows with every span of the text replaced by its kind; overlapping spans are merged first."""

    @F.arrow_udf(T.StringType())
    def mask_text(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            parts, at = [], 0
            for kind, start, end in find(text) if text else ():
                if start >= at:
                    parts += (text[at:start], mask.format(kind))
                at = max(at, end)
            out.append(None if text is None else "".join(parts) + text[at:])
        return pa.array(out, type=pa.string())

    return in_small_batches(docs).withColumn(text_col, mask_text(F.col(f"`{text_col}`")))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
