"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors: at-signs, URL schemes, plus signs, digits and
words that announce an identifier. Each kind has a local parser that grows an anchor to its
boundaries in the neighbouring characters and validates what it got. Text without anchors
costs one pass of the automaton.

Kinds `email`, `ip`, `card` and `phone` follow the base rules of `BASE_RULES`; the anchors
for schemes and cues add `url` and `secret`.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwright.llm.common import ids_and_text, map_batches

# The base rules, in the order in which spans are listed.
BASE_RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE_KINDS = tuple(BASE_RULES)
KINDS = (*BASE_KINDS, "url", "secret")
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("token", "secret", "password", "api_key", "apikey", "iban", "passport", "account")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile("(?<![0-9])" + BASE_RULES["ip"])  # what begins inside a run of digits has failed at its start
_CARD = re.compile(BASE_RULES["card"])
_PHONE = re.compile(BASE_RULES["phone"])
_DOTTED = re.compile(r"[0-9.]+")
_SPACED = re.compile(r"[0-9\x20-]+")
_URL_TAIL = re.compile(r"[^\s<>\"'`]+")
_CUED = re.compile(r"[\x20]?(?:is|no|number)?[\x20]?[:=#]?[\x20]?[\"']?([A-Za-z0-9][A-Za-z0-9_/+-]{7,})")


def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in [("@", "at"), ("+", "plus"), *((str(d), "digit") for d in range(10)),
                       *((s, "scheme") for s in SCHEMES), *((c, "cue") for c in CUES)]:
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


_automaton: list[ahocorasick.Automaton] = []


def luhn(digits: str) -> bool:
    """The check sum of card numbers: every second digit from the right counts double."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Grow to the left over local characters down to `floor`, to the right over labels."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1)
    return (start, domain.end()) if start < at and domain else None


def _ips(text: str, start: int, end: int):
    for m in _IP.finditer(text, start, end):
        if all(_small(part) for part in m.group().split(".")):
            yield m.span()


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part) <= 255


def _cards(text: str, start: int, end: int):
    for m in _CARD.finditer(text, start, end):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phone(text: str, plus: int) -> tuple[int, int] | None:
    m = _PHONE.match(text, plus)
    return m.span() if m and 8 <= sum(c.isdigit() for c in m.group()) <= 15 else None


def _url(text: str, end: int, size: int) -> tuple[int, int] | None:
    """From a scheme to the next white space or quote, without closing punctuation."""
    tail = _URL_TAIL.match(text, end)
    if not tail:
        return None
    stop = end + len(tail.group().rstrip(".,;:!?)]}"))
    return (end - size, stop) if stop > end else None


def _secret(text: str, end: int) -> tuple[int, int] | None:
    """Eight or more characters of an identifier after a cue."""
    m = _CUED.match(text, end)
    return m.span(1) if m else None


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in order of kind and place; ends are exclusive, in code points."""
    if not text:
        return []
    if not _automaton:
        _automaton.append(_anchors())
    spans: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    dotted = spaced = mail_end = url_end = secret_end = 0  # what has been parsed so far: anchors before it are done
    for last, (kind, size) in _automaton[0].iter(text):
        if kind == "at":
            span = _email(text, last, mail_end)
            if span:
                spans["email"].append(span)
                mail_end = span[1]
        elif kind == "digit":
            if last >= dotted:
                dotted = _DOTTED.match(text, last).end()
                spans["ip"].extend(_ips(text, last, dotted))
            if last >= spaced:
                spaced = _SPACED.match(text, last).end()
                spans["card"].extend(_cards(text, last, spaced))
        elif kind == "plus":
            span = _phone(text, last)
            if span:
                spans["phone"].append(span)
        elif kind == "scheme":
            span = _url(text, last + 1, size) if last >= url_end else None
            if span:
                spans["url"].append(span)
                url_end = span[1]
        else:
            span = _secret(text, last + 1) if last + 1 >= secret_end else None
            if span:
                secret_end = span[1]
                if any(c.isdigit() for c in text[span[0] : span[1]]):
                    spans["secret"].append(span)
    return [(kind, *span) for kind in KINDS for span in sorted(set(spans[kind]))]


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end), one row per input row; null and empty texts have none.

    Whole texts are parsed. Rows that repeat a doc_id are answered one by one; other columns
    of the input are not read.
    """

    def run(batch):
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(text)] for text in batch["text"]]
        return {"doc_id": batch["doc_id"], "spans": found}

    base = ids_and_text(docs)
    kind = base.schema["doc_id"].dataType.simpleString()
    return map_batches(base, run, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans as text."""
    found = find_pii(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; overlapping spans become one."""

    def run(batch):
        out = []
        for text in batch["text"]:
            parts, done = [], 0
            for start, end, kind in sorted((s, e, k) for k, s, e in find(text or "")):
                if start >= done:
                    parts += [text[done:start], f"[{kind}]"]
                done = max(done, end)
            out.append(text if text is None else "".join(parts) + text[done:])
        return batch | {"text": out}

    return map_batches(docs, run, docs.schema)
