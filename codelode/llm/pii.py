"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over the text: at-signs, plus
signs, digits, schemes and identifier cues.  At each anchor a small deterministic
parser expands to both sides and validates.  Every parser stops at the next anchor
of its kind or at a foreign character, so a text is read a bounded number of times.

Kinds: email, ip, card and phone (the base), and two the method adds: ``url`` for
addresses that name a person or carry a password (mailto:, tel:, sip: and
scheme://user@host), ``account`` for an identifier after a cue such as "IBAN" or
"account no.".
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm import spans

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE_KINDS = KINDS[:4]
CUES = ("iban", "account", "acct", "a/c", "passport", "ssn", "social security", "routing", "member id", "customer id", "tax id")
PERSON_SCHEMES = ("mailto:", "tel:", "sip:")
_DIGIT = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | {"-"}
_PHONE = _DIGIT | frozenset(" ().-")
_SCHEME = _ALNUM | frozenset("+.-")
_TRAILING = frozenset(".,;:!?)]")
_URL_END = frozenset(" \t\n\r\x0b\x0c<>\"'`{}|\\^")


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for c in _DIGIT:
        machine.add_word(c, ("digit", 1))
    for kind, words in (("at", ("@",)), ("plus", ("+",)), ("scheme", ("://",)), ("person", PERSON_SCHEMES)):
        for word in words:
            machine.add_word(word, (kind, len(word)))
    for word in CUES:
        for form in {word, word.upper(), word.capitalize(), word.title()}:
            machine.add_word(form, ("cue", len(form)))
    machine.make_automaton()
    return machine


def _while(text: str, at: int, allowed: frozenset) -> int:
    while at < len(text) and text[at] in allowed:
        at += 1
    return at


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = _while(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == "." and (more := _while(text, end + 1, _LABEL)) > end + 1:
        end, labels = more, labels + 1
    return (start, end) if labels else None


def _ip(text: str, at: int) -> tuple[int, bool, int]:
    """End of the match (-1 without one), whether its parts are small enough, end of the first run of digits."""
    end = first = _while(text, at, _DIGIT)
    parts = [text[at:end]]
    for _ in range(3):
        if end >= len(text) or text[end] != "." or (more := _while(text, end + 1, _DIGIT)) == end + 1:
            return -1, False, first
        parts.append(text[end + 1 : more])
        end = more
    return end, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts), first


def _card(text: str, at: int) -> tuple[int, str]:
    end, digits = at + 1, [text[at]]
    while end < len(text):
        if text[end] in _DIGIT:
            step = end
        elif text[end] in " -" and end + 1 < len(text) and text[end + 1] in _DIGIT:
            step = end + 1
        else:
            break
        digits.append(text[step])
        end = step + 1
    return end, "".join(digits)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _phone(text: str, at: int) -> tuple[int, bool] | None:
    if at + 1 >= len(text) or text[at + 1] not in _DIGIT:
        return None
    end = _while(text, at + 2, _PHONE)
    while end > at + 3 and text[end - 1] not in _DIGIT:
        end -= 1
    if end <= at + 3:
        return None
    return end, 8 <= sum(c in _DIGIT for c in text[at:end]) <= 15


def _iban(word: str) -> bool:
    if not (15 <= len(word) <= 34 and word[:2].isalpha() and word[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in word[4:] + word[:4])) % 97 == 1


def _account(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The identifier after a cue: at least 6 letters and digits, 4 of them digits; an IBAN must add up."""
    if (start and text[start - 1] in _ALNUM) or (end < len(text) and text[end] in _ALNUM):
        return None
    at = _while(text, end, frozenset(" \t.:#="))
    for word in ("number", "no", "num", "nr", "id", "is"):
        if text[at : at + len(word)].lower() == word and not (at + len(word) < len(text) and text[at + len(word)] in _ALNUM):
            at = _while(text, at + len(word), frozenset(" \t.:#="))
    stop = at
    while stop < len(text) and (text[stop] in _ALNUM or (text[stop] in " -" and stop + 1 < len(text) and text[stop + 1] in _DIGIT)):
        stop += 1
    if not any(c in _DIGIT for c in text[at : _while(text, at, _LABEL)]):
        return None
    word = text[at:stop].replace(" ", "").replace("-", "")
    if text[start:end].lower() == "iban":
        return (at, stop) if _iban(word.upper()) else None
    return (at, stop) if 6 <= len(word) <= 34 and sum(c in _DIGIT for c in word) >= 4 else None


def _url(text: str, kind: str, start: int, end: int) -> tuple[int, int] | None:
    """What can fail is tested before the address is read to its end: the part tested
    stops at the next anchor, and a match moves on past all it has read."""
    if kind == "person":
        if start and text[start - 1] in _ALNUM:
            return None
    else:
        scheme = start
        while start and text[start - 1] in _SCHEME:
            start -= 1
        host = end
        while host < len(text) and text[host] != "/" and text[host] not in _URL_END:
            host += 1
        more = host < len(text) and text[host] == "/"
        while not more and host > end and text[host - 1] in _TRAILING:
            host -= 1
        if start == scheme or "@" not in text[end:host].strip("@"):
            return None
    stop = end
    while stop < len(text) and text[stop] not in _URL_END:
        stop += 1
    while stop > end and text[stop - 1] in _TRAILING:
        stop -= 1
    if kind == "person" and not any(c in _ALNUM for c in text[end:stop]):
        return None
    return start, stop


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, by kind and then by start."""
    found: dict[str, list] = {kind: [] for kind in KINDS}
    done = dict.fromkeys(KINDS, 0)
    for last, (anchor, length) in _automaton().iter(text):
        at = last - length + 1
        if anchor == "digit":
            if at >= done["ip"]:
                end, small, first = _ip(text, at)
                if end > 0 and small:
                    found["ip"].append((at, end))
                done["ip"] = end if end > 0 else first
            if at >= done["card"]:
                end, digits = _card(text, at)
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append((at, end))
                done["card"] = end
        elif anchor == "at":
            if span := _email(text, at, done["email"]):
                found["email"].append(span)
                done["email"] = span[1]
        elif anchor == "plus":
            if (match := _phone(text, at)) and match[1]:
                found["phone"].append((at, match[0]))
        else:
            kind = "account" if anchor == "cue" else "url"
            if at >= done[kind]:
                span = _account(text, at, last + 1) if anchor == "cue" else _url(text, anchor, at, last + 1)
                if span and span[0] >= done[kind]:
                    found[kind].append(span)
                    done[kind] = span[1]
    return [(kind, *span) for kind in KINDS for span in found[kind]]


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """Each span becomes its kind in angle brackets; spans that overlap become one."""
    parts, place = [], 0
    for kind, start, end in sorted(found, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if start >= place:
            parts += [text[place:start], f"<{kind}>"]
        place = max(place, end)
    return "".join(parts) + text[place:]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_pii(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id and ``spans array<struct<kind, start, end>>``; NULL text has none."""
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in spans.row_slices(whole, "text")):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS)], ["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")


def summary(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and the spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    shown = lambda those: F.concat_ws(",", F.transform(those, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{kind}')) AS BIGINT)").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def redacted(documents: DataFrame, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """The rows with personal data replaced in the text; all other columns stay.

    ``length_column``, if the rows have it, gets the new number of characters.
    """
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in spans.row_slices(whole, text_column)):
            texts = [None if (t := v.as_py()) is None else redact(t, s) if (s := find(t)) else t for v in batch.column(names.index(text_column))]
            columns = list(batch.columns)
            columns[names.index(text_column)] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    clean = documents.mapInArrow(run, documents.schema)
    if length_column in names:
        clean = clean.withColumn(length_column, F.length(text_column).cast(documents.schema[length_column].dataType))
    return clean
