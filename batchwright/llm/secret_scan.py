"""Secrets by character Markov models.

The base rules `BASE_RULES` name what is surely a secret by its form. The method adds runs of
identifier characters that look drawn at random: two first-order Markov models over characters,
one of random strings and one of ordinary identifiers, give each run its log-likelihood ratio,
and a run above the threshold is a span of kind `random`.

Both models are trained on labelled samples out of the documents themselves: the values that
the base rules find are random, the other identifiers of the same texts are ordinary. As the
rules see few alphabets, seeded strings over hexadecimal digits, letters with digits and
base-64 characters are added to the random ones. The threshold is the smallest at which no more
than FALSE_SHARE of the ordinary sample would be taken.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwright.llm.common import ids_and_text, map_batches, received, send
from batchwright.storage import materialize

# The base rules, in the order in which spans of one start are listed.
BASE_RULES = {
    "assign": r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
BASE_KINDS = tuple(BASE_RULES)
KINDS = (*BASE_KINDS, "random")

#: Documents drawn for the samples, with and without a base match; their whole texts are read.
SAMPLE_DOCS = 1_000
#: Distinct strings kept of each sample.
SAMPLE_STRINGS = 20_000
#: Seeded random strings for each alphabet.
SEEDED_STRINGS = 2_000
#: Characters a run must have to be judged.
LEAST = 16
#: Share of the ordinary sample that may lie above the threshold.
FALSE_SHARE = 0.001

_ASSIGN = re.compile(BASE_RULES["assign"], re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(BASE_RULES["access"])
_HEX = re.compile(f"[0-9a-f]{{{HEX_LEAST},}}")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_RUN_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
_LONG_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
_MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])", re.DOTALL)
_ALPHABETS = ("0123456789abcdef", _RUN_CHARS[:62], _RUN_CHARS[:64], _RUN_CHARS[26:62])


def _marks(chars: str) -> bytes:
    """A table for bytes.translate: `x` for the given characters, a full stop for the rest."""
    return bytes(ord("x") if chr(b) in chars else ord(".") for b in range(256))


_HEX_MARKS, _RUN_MARKS = _marks("0123456789abcdef"), _marks(_RUN_CHARS)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base rules by start, then kind; ends are exclusive, in code points.

    Bytes are looked at first: a text without a keyword, or without a run of hexadecimal
    digits that is long enough, is not searched for these.
    """
    data = text.encode("utf-8", "surrogatepass")
    found = []
    lowered = data.lower()
    if any(word in lowered for word in _KEYWORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    if b"AKIA" in data:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if b"x" * HEX_LEAST in data.translate(_HEX_MARKS):
        found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, taken: list[tuple[str, int, int]]):
    """(start, end) of maximal runs of identifier characters, LEAST or more, letters and digits both, clear of `taken`."""
    if b"x" * LEAST not in text.encode("utf-8", "surrogatepass").translate(_RUN_MARKS):
        return
    for m in _LONG_RUN.finditer(text):
        start, end = m.span()
        if not any(s < end and start < e for _, s, e in taken) and _MIXED.match(m.group()):
            yield start, end


class MarkovModel:
    """First-order character model: log-probabilities of each next character, the first one included."""

    def __init__(self, strings: list[str], smoothing: float = 0.5):
        n = len(_RUN_CHARS)
        counts = np.full((n + 1, n), smoothing)
        for string in strings:
            codes = encoded(string)
            np.add.at(counts, (np.append(n, codes[:-1]), codes), 1)
        self.table = np.log(counts / counts.sum(axis=1, keepdims=True))


_PLACE = np.zeros(128, dtype=np.int64)
_PLACE[[ord(c) for c in _RUN_CHARS]] = np.arange(len(_RUN_CHARS))


def encoded(string: str) -> np.ndarray:
    """Places of the characters among those of identifiers."""
    return _PLACE[np.frombuffer(string.encode("ascii"), dtype=np.uint8)]


class SecretModel:
    """Ratio of the two models, in nats a character, and the threshold above which a run is random."""

    def __init__(self, secret: list[str], ordinary: list[str]):
        drawn = random.Random(11)
        seeded = ["".join(drawn.choices(alphabet, k=drawn.randint(LEAST, 64))) for alphabet in _ALPHABETS for _ in range(SEEDED_STRINGS)]
        self.ratio = MarkovModel(secret + seeded).table - MarkovModel(ordinary).table
        own = sorted((self.score(s) for s in ordinary if len(s) >= LEAST // 2), reverse=True)
        allowed = int(FALSE_SHARE * len(own))
        self.threshold = max(0.0, own[allowed]) if own else 0.0

    def score(self, string: str) -> float:
        codes = encoded(string)
        before = np.append(len(_RUN_CHARS), codes[:-1])
        return float(self.ratio[before, codes].sum()) / len(codes)


def secret_spans(text: str, model: SecretModel) -> list[tuple[str, int, int]]:
    """Base and random spans by start, then kind."""
    found = base_spans(text)
    added = [("random", s, e) for s, e in candidates(text, found) if model.score(text[s:e]) > model.threshold]
    return sorted(found + added, key=lambda s: (s[1], KINDS.index(s[0])))


def labelled_strings(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_strings: int = SAMPLE_STRINGS) -> tuple[list[str], list[str]]:
    """(random, ordinary) strings out of about `sample_docs` documents with a base match and as many of all.

    Documents come in the order of a hash of their id and text, so the sample does not depend
    on partitioning; only hashes are ranked, and the texts stay distributed. The strings are
    distinct; of each class those with the smallest hashes stay. What reaches the driver is
    bounded by the two parameters, whatever the texts hold.
    """
    formed = F.col("text").rlike(f"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{{{HEX_LEAST}}}")
    place = F.xxhash64("doc_id", "text")
    base = ids_and_text(docs)

    def last_drawn(rows: DataFrame) -> int:
        ranked = rows.select(place.alias("place")).orderBy("place").limit(sample_docs).collect()
        return ranked[-1].place if ranked else -(1 << 63)

    drawn = (place <= last_drawn(base)) | ((place <= last_drawn(base.where(formed))) & formed)

    def split(batch):
        out = {"secret": [], "string": []}
        for text in batch["text"]:
            spans = base_spans(text)
            values = {m.group() for _, s, e in spans for m in _RUN.finditer(text, s, e) if m.end() - m.start() >= ASSIGN_LEAST}
            values = {v for v in values if any(c.isdigit() for c in v)}
            done = 0
            plain = set()
            for _, s, e in [*spans, ("", len(text), len(text))]:
                plain.update(m.group() for m in _RUN.finditer(text, done, max(done, s)) if m.end() - m.start() >= 4)
                done = max(done, e)
            for secret, strings in ((True, values), (False, plain)):
                out["secret"] += [secret] * len(strings)
                out["string"] += strings
        return out

    strings = map_batches(base.where(drawn).select("text"), split, "secret boolean, string string")
    strings = materialize(strings.where(F.length("string") <= 256).distinct(), "secret-strings")
    kept = [
        strings.where(F.col("secret") == F.lit(secret)).orderBy(F.xxhash64("string"), "string").limit(sample_strings).collect()
        for secret in (True, False)
    ]
    return [r.string for r in kept[0]], [r.string for r in kept[1]]


def fit(docs: DataFrame) -> SecretModel:
    return SecretModel(*labelled_strings(docs))


def find_secrets(docs: DataFrame, model: SecretModel | None = None) -> DataFrame:
    """doc_id and spans (kind, start, end), one row per input row, by start and kind.

    Whole texts are searched; null and empty texts have no spans. The model is fitted on the
    documents given unless there is one. Rows that repeat a doc_id, or have none, are answered
    one by one; other columns of the input are not read.
    """
    sent = send(docs.sparkSession, model or fit(docs))

    def run(batch):
        own = received(sent, lambda fitted: fitted)
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in secret_spans(text, own)] for text in batch["text"]]
        return {"doc_id": batch["doc_id"], "spans": found}

    base = ids_and_text(docs)
    kind = base.schema["doc_id"].dataType.simpleString()
    return map_batches(base, run, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def secret_report(docs: DataFrame, model: SecretModel | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans as text: the digest of `find_secrets`."""
    found = find_secrets(docs, model)

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redact(docs: DataFrame, model: SecretModel | None = None) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; overlapping spans become one; null stays null."""
    sent = send(docs.sparkSession, model or fit(docs))

    def run(batch):
        own = received(sent, lambda fitted: fitted)
        out = []
        for text in batch["text"]:
            parts, done = [], 0
            for kind, start, end in secret_spans(text or "", own):
                if start >= done:
                    parts += [text[done:start], f"[{kind}]"]
                done = max(done, end)
            out.append(text if text is None else "".join(parts) + text[done:])
        return batch | {"text": out}

    return map_batches(docs, run, docs.schema)
