"""Sentences with their places, and the places of quotes in texts: helpers that work on one text, for use in Arrow batches."""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterator

#: English abbreviations that a sentence goes on after, besides the short names of months.
SHORT = set("dr mr mrs ms prof st jr sr vs etc fig eq vol ed approx dept est".split()) | {m.lower() for m in calendar.month_abbr[1:] if m not in calendar.month_name} | {"sept"}
#: Abbreviations that stand before a number.
COUNTED = {"no", "nos", "p", "pp", "ch", "sec"}
END = re.compile(r"[.!?…]+[\"'”’)\]]*(?=\s|$)")
LAST_WORD = re.compile(r"[^\W\d_]+$")


def following(text: str, at: int) -> str:
    """The next character that is not white space, or nothing."""
    while at < len(text) and text[at].isspace():
        at += 1
    return text[at : at + 1]


def ends_here(text: str, m: re.Match[str]) -> bool:
    """Whether a sentence ends at a match of END: not after an abbreviation, an initial, or a number's dot that more digits follow."""
    if m.group()[0] != "." or len(m.group()) > 1:
        return True
    before = LAST_WORD.search(text, max(0, m.start() - 12), m.start())
    if before is None:
        return True
    word, after = before.group(), following(text, m.end())
    if len(word) == 1 and before.start() and text[before.start() - 1] == ".":
        return not after.islower()  # the last dot of p.m. and the like
    if len(word) == 1 and word.isupper() and word != "I" and not (before.start() and text[before.start() - 1].isalnum()):
        return not after.isupper()  # an initial, if a capital goes on
    if word.lower() in SHORT:
        return False
    return not (word.lower() in COUNTED and after.isdigit())


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence, in code points, without the white space around it; together they hold all that is not white space."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    start = 0
    for m in END.finditer(text):
        if ends_here(text, m):
            out += trimmed(text, start, m.end())
            start = m.end()
    return out + trimmed(text, start, len(text))


def trimmed(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The span without white space at its ends; none if nothing is left."""
    piece = text[start:end]
    body = piece.strip()
    if not body:
        return []
    begin = start + len(piece) - len(piece.lstrip())
    return [(begin, begin + len(body))]


def least_edits(pattern: str, text: str) -> tuple[int, int]:
    """(edits, end) of the best match of pattern anywhere in text, the first of equally good ones: bit-parallel, free at both of text's ends."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        x = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (full & ~(h | up)), up & h
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | (full & ~(x | plus)), plus & x
        if score < best:
            best, end = score, j + 1
    return best, end


def windows(pattern: str, text: str, most: int) -> Iterator[tuple[int, int]]:
    """The parts of text that can hold pattern within `most` edits: one of most + 1 pieces of it stands there unchanged."""
    m, found = len(pattern), []
    for k in range(most + 1):
        a, b = m * k // (most + 1), m * (k + 1) // (most + 1)
        i = text.find(pattern[a:b]) if b > a else -1
        while i >= 0:
            found.append((max(0, i - a - most), min(len(text), i - a + m + most)))
            i = text.find(pattern[a:b], i + 1)
    merged: list[list[int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    yield from ((a, b) for a, b in merged)


def fuzzy_place(pattern: str, text: str, most: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best match within `most` edits, the first of equally good ones and of these the shortest; None if there is none."""
    best: tuple[int, int, int] | None = None
    for a, b in windows(pattern, text, most) if pattern else ():
        edits, end = least_edits(pattern, text[a:b])
        if edits <= most and (best is None or edits < best[2]):
            back = text[a : a + end][::-1][: len(pattern) + most]
            _, size = least_edits(pattern[::-1], back)
            best = (a + end - size, a + end, edits)
            if not edits:
                break
    return best


def ground(text: str | None, span: str | None, fact: str | None, start: int | None = None, end: int | None = None, share: float = 0.2) -> tuple[bool, int | None, int | None, str]:
    """Where a fact's quoted span stands in its text: (valid, start, end, reason).

    As it stands at the given places, as it stands anywhere, what the given places hold,
    within `share` of its characters edited, or the first sentence that holds the fact's
    first three words (not valid, but a place to look). Nothing is made up.
    """
    text, span = text or "", (span or "").strip()
    given = start is not None and end is not None and 0 <= start < end <= len(text)
    if span and given and text[start:end] == span:
        return True, start, end, "exact at offsets"
    i = text.find(span) if span else -1
    if i >= 0:
        return True, i, i + len(span), "exact"
    if given:
        return True, start, end, "offsets"
    near = fuzzy_place(span, text, int(share * len(span)))
    if near:
        return True, near[0], near[1], "fuzzy"
    words = [w.lower() for w in (fact or "").split()[:3]]
    for a, b in sentence_spans(text) if words else ():
        low = text[a:b].lower()
        if all(w in low for w in words):
            return False, a, b, "nearest sentence"
    return False, None, None, "not found"
