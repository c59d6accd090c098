"""Personal data by anchor expansion.

One Aho-Corasick pass over each whole text, A-Z lower-cased, finds the anchors: at-signs, plus
signs, digits, schemes and identifier cues.  From each anchor a deterministic
local parser expands to the boundaries of an e-mail address, an IPv4 address, a
card or phone number, a web address that names its user, or an account
identifier, and validates what it has.
"""

from __future__ import annotations

import hashlib
import re
from typing import Iterator, NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import slices, small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "address", "account")
# The cues, found in A-Z too.  An account cue must be followed by a separator and an identifier.
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("token", "api_key", "apikey", "secret", "password", "passwd", "iban", "account", "ssn", "passport")
# Cues whose identifiers are written in groups, with a blank or hyphen between.
GROUPED_CUES = frozenset({"iban", "account", "ssn", "passport"})

_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_LOCAL = frozenset(_ALNUM + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_USER_URL = re.compile(r"[^\s/?#@<>\"']+@[A-Za-z0-9.-]+(?::[0-9]+)?[^\s<>\"']*")
_ASSIGNED = re.compile(r"(?:[ _-]?(?ai:id|no|number|key))?[ ]{0,3}[:=#][ ]{0,3}[\"']?")
_PLAIN = re.compile(r"[A-Za-z0-9_-]{8,}+")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]{4}){2,7}(?:[ -]?[A-Za-z0-9]{1,3})?")
_DIGIT_GROUPS = re.compile(r"[0-9]{2,}(?:[ -][0-9]{2,})+(?![A-Za-z0-9])")
_GROUP_END = re.compile(r"[A-Za-z0-9](?![A-Za-z0-9])")
_DIGITS = re.compile(r"[0-9]+")
_UPPER = re.compile(r"[A-Z]+")


class Span(NamedTuple):
    """Code points start:end, end exclusive."""

    start: int
    end: int
    kind: str


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of international account numbers, of 15 to 34 characters."""
    if not 15 <= len(iban) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def account_end(text: str, at: int, cue: str) -> int | None:
    """Where an identifier that begins at a place, after this cue, ends; None for no identifier.

    After iban, the longest run of whole groups that passes mod-97; after the
    grouped cues, groups of digits, 8 digits or more in all; else, and after
    the other cues, one run of 8 characters or more with 2 digits or more.
    """
    if cue == "iban" and (m := _IBAN.match(text, at)):
        for end in reversed([g.end() for g in _GROUP_END.finditer(text, at, min(m.end() + 1, len(text))) if g.end() <= m.end()]):
            if mod97(text[at:end].replace(" ", "").replace("-", "")):
                return end
    if cue in GROUPED_CUES and (m := _DIGIT_GROUPS.match(text, at)) and sum(map(str.isdigit, m[0])) >= 8:
        return m.end()
    if (m := _PLAIN.match(text, at)) and sum(map(str.isdigit, m[0])) >= 2:
        return m.end()
    return None


def _automaton():
    found = ahocorasick.Automaton()
    for word, kind in [("@", "at"), ("+", "plus"), *((str(d), "digit") for d in range(10)), *((s, "scheme") for s in SCHEMES), *((c, "cue") for c in CUES)]:
        found.add_word(word, (kind, word))
    found.make_automaton()
    return found


_ANCHORS = None


def find_spans(text: str | None) -> list[Span]:
    """All spans of a whole text, by start, then kind as KINDS lists them; none for a null or empty text.

    Spans of one kind don't overlap: a search goes on after the last match, also
    after one that failed its validation.
    """
    global _ANCHORS
    if not text:
        return []
    if _ANCHORS is None:
        _ANCHORS = _automaton()
    spans: list[Span] = []
    free = dict.fromkeys(KINDS, 0)  # where the next match of a kind may start
    run_end = 0  # end of the run of digits that has been seen
    for last, (kind, word) in _ANCHORS.iter(_UPPER.sub(lambda m: m[0].lower(), text)):
        at = last + 1 - len(word)
        if kind == "digit":
            if at < run_end:
                continue
            run_end = _DIGITS.match(text, at).end()
            # A match can only start where a run of digits does: ends of matches are ends of runs.
            if at >= free["ip"] and (m := _IP.match(text, at)):
                free["ip"] = m.end()
                if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
                    spans.append(Span(at, m.end(), "ip"))
            if at >= free["card"] and (m := _CARD.match(text, at)):
                free["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append(Span(at, m.end(), "card"))
        elif kind == "plus":
            if at >= free["phone"] and (m := _PHONE.match(text, at)):
                free["phone"] = m.end()
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    spans.append(Span(at, m.end(), "phone"))
        elif kind == "at":
            start, floor = at, free["email"]
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                free["email"] = m.end()
                spans.append(Span(start, m.end(), "email"))
        elif kind == "scheme":
            if at >= free["address"] and (m := _USER_URL.match(text, last + 1)):
                free["address"] = m.end()
                spans.append(Span(at, m.end(), "address"))
        elif at >= free["account"] and (m := _ASSIGNED.match(text, last + 1)) and (end := account_end(text, m.end(), word)):
            free["account"] = end
            spans.append(Span(m.end(), end, "account"))
    rank = {k: n for n, k in enumerate(KINDS)}
    spans.sort(key=lambda s: (s.start, rank[s.kind]))
    return spans


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span, overlapping ones joined, replaced by the first one's kind in angle brackets."""
    if not spans:
        return text
    out, at, end = [], 0, -1
    for s in spans:
        if s.start >= end:
            out += [text[at : s.start], f"<{s.kind.upper()}>"]
            end = s.end
        else:
            end = max(end, s.end)
        at = end
    return "".join([*out, text[at:]])


def joined(spans: list[Span]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


_ADDED = {"n_email": "long", "n_ip": "long", "n_card": "long", "n_phone": "long", "base_sha256": "string", "spans": "string", "redacted": "string"}


def scan_pii(df: DataFrame, text: str = "text", keep_text: bool = True, add: tuple[str, ...] = tuple(_ADDED)) -> DataFrame:
    """Adds counts, digests, spans and the redacted text to df (columns of these names are replaced).

    add chooses among n_email, n_ip, n_card, n_phone (long), base_sha256 (of
    the base kinds' spans), spans and redacted; keep_text=False leaves out the
    text itself.  A null text has no spans and a null redacted text, an empty
    one stays empty.  Rows are independent of each other and kept, repeated ones
    too; an empty table gives an empty one; texts of any length are read whole.
    """
    names = [c for c in df.columns if c.lower() not in add and (keep_text or c.lower() != text.lower())]
    wide = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("__pii_text"))
    kinds = {"string": pa.string(), "long": pa.int64()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__pii_text", 16 << 20):
                rows = {k: [] for k in add}
                for value in batch.column("__pii_text"):
                    t = value.as_py()
                    spans = find_spans(t)
                    for k in add:
                        if k == "redacted":
                            rows[k].append(redact(t, spans))
                        elif k == "spans":
                            rows[k].append(joined(spans))
                        elif k == "base_sha256":
                            rows[k].append(hashlib.sha256(joined([s for s in spans if s.kind in BASE_KINDS]).encode()).hexdigest())
                        else:
                            rows[k].append(sum(s.kind == k[2:] for s in spans))
                arrays = [batch.column(c) for c in names] + [pa.array(rows[k], type=kinds[_ADDED[k]]) for k in add]
                yield pa.RecordBatch.from_arrays(arrays, [*names, *add])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names), *(f"`{k}` {_ADDED[k]}" for k in add)])
    return small_batches(wide).mapInArrow(scan, schema)
