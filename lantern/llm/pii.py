"""PII: patterns propose spans, checksums confirm them, words nearby adjust a score.

Base kinds are email, ip, card and phone, matched leftmost and without overlap in each kind. The score never
removes a base span. Added are spans whose score reaches a threshold: iban, confirmed by mod-97 at any boundary of a run,
which alone is enough; and routing, nine digits by the checksum of bank routing numbers, which one number in ten passes, so
that a context word has to stand near it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lantern.llm.common import caches_of, small_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "routing")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# No digit before it, as a match that fails from the start of a run of digits fails from within it too.
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Where an IBAN may start, and the longest run from there; added_spans() finds its end.
IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?: ?[A-Z0-9]){11,30}")
#: A digit comes first, as a search for it is fast; what stands before it is looked at then.
ROUTING = re.compile(r"[0-9](?<![0-9A-Za-z+.-][0-9])[0-9]{8}(?![0-9A-Za-z]|[.-][0-9])")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    c[:2]: int(c[2:])
    for c in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 "
        "HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 "
        "QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The score of a confirmed span by kind, what a context word adds, and how far it may stand away.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "routing": 0.4}
#: Context words of English, German, French and Spanish; they count as whole words.
CONTEXT = {
    "email": "mail email e-mail contact kontakt correo courriel",
    "ip": "ip host server address adresse serveur servidor",
    "card": "card visa credit payment karte kreditkarte carte tarjeta",
    "phone": "phone tel call mobile fax telefon handy téléphone teléfono",
    "iban": "iban bank account transfer konto überweisung compte banque cuenta banco",
    "routing": "routing aba rtn bank account transfer konto überweisung compte banque cuenta banco",
}
WORDS = {k: re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, v.split()))})(?!\w)", re.IGNORECASE) for k, v in CONTEXT.items()}
NEAR, BONUS, THRESHOLD = 40, 0.15, 0.5

OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def routed(digits: str) -> bool:
    return sum(w * int(d) for w, d in zip((3, 7, 1) * 3, digits, strict=True)) % 10 == 0 and digits != "000000000"


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        floor = at + 1
        if m:
            yield m.span()
            floor = m.end()
        at = text.find("@", floor)


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of the base kinds, in order."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    out.sort()
    return out


def _iban_end(text: str, start: int, stop: int) -> int:
    """The end of the IBAN that starts at start, or 0: at its country's length, else at the end of the run; with no known
    country, at any boundary, longest first."""
    plain, ends = text[start:stop].replace(" ", ""), {}
    n = 0
    for i in range(start, stop):
        n += text[i] != " "
        if n >= 15 and text[i] != " " and not (text[i + 1 : i + 2].isascii() and text[i + 1 : i + 2].isalnum()):
            ends[n] = i + 1
    own = IBAN_LENGTHS.get(plain[:2])
    longest = sorted(ends, reverse=True)
    for n in [own, *longest[:1]] if own else longest:
        if n in ends and mod97(plain[:n]):
            return ends[n]
    return 0


def added_spans(text: str) -> list[tuple[int, int, int]]:
    found, at = [], 0
    while m := IBAN.search(text, at):
        end = _iban_end(text, *m.span())
        if end and score(text, m.start(), end, "iban") >= THRESHOLD:
            found.append((m.start(), 4, end))
        at = end or m.start() + 1
    for m in ROUTING.finditer(text):
        if routed(m[0]) and score(text, *m.span(), "routing") >= THRESHOLD:
            found.append((m.start(), 5, m.end()))
    return sorted(found)


def score(text: str, start: int, end: int, kind: str) -> float:
    """What the kind is worth by itself, more if a context word stands within NEAR characters: words that NEAR cuts do not count."""
    a, b = max(0, start - NEAR), min(len(text), end + NEAR)
    near = WORDS[kind].search(text, a, start) or WORDS[kind].search(text, end, b)
    if near and (near.start() == a > 0 and text[a - 1].isalnum() or near.end() == b < len(text) and text[b].isalnum()):
        near = None
    return round(min(1.0, SCORES[kind] + BONUS * bool(near)), 2)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in every whole text: counts of the base kinds, their hash, all spans, and their scores.

    Offsets are code points, ends exclusive; spans are ordered by start, then by kind as in KINDS. A null text
    counts as empty and has no spans. Repeated and null ids are kept; other columns of docs are left out.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches_of("pii")
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            hashes, spans, scores = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                every = sorted(base + added_spans(text))
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in base))
                hashes.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
                scores.append([score(text, a, b, KINDS[k]) for a, k, b in every])
            cols = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(hashes, pa.string()), pa.array(spans, pa.string()), pa.array(scores, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, OUT)


def masked_text(text: str) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans, the longest stretch goes under the first kind."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, k, b in sorted(base_spans(text) + added_spans(text)):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([a, k, b])
    for a, k, b in merged:
        out += [text[at:a], f"[{KINDS[k]}]"]
        at = b
    return "".join([*out, text[at:]]) if merged else text


def mask(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with personal data masked in text_col and length_col, where there is one, counted anew.

    Null texts stay null, with a null length; texts are read whole, equal rows stay equal, an empty table gives an empty one. A
    length column that holds neither numbers nor strings is another's and stays as it is, like all other columns.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    n_at = docs.columns.index(length_col) if length_col in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches_of("pii")
        for batch in batches:
            texts = [None if t is None else masked_text(t) for t in batch.column(at).to_pylist()]
            cols = list(batch.columns)
            cols[at] = pa.array(texts, pa.string())
            if n_at >= 0:
                kind = batch.schema.field(n_at).type
                if any(test(kind) for test in (pa.types.is_integer, pa.types.is_floating, pa.types.is_string)):
                    cols[n_at] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(kind)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
