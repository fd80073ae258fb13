"""Personal data: patterns propose spans, checksums confirm, context words adjust a score.

Every pattern is matched over the whole text in time linear in its length.  The
base kinds (email, ip, card, phone) follow fixed rules and always stay; further
kinds (iban, ssn, secret) need a score that a checksum, or for secrets the spread of
their characters, and the words on both sides of the span give them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import fresh, release

#: The order of kinds decides between spans that start together.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE_KINDS = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits leads to the same next character from each of its digits, so a match
# can only begin at the first: the look-behind changes no result and keeps the scan linear.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: A long run of letters and digits, as keys and tokens are.
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{24,128}={0,2}(?![A-Za-z0-9_+/=-])")

#: Words that make a kind likelier when one is among the CONTEXT characters before the span or the AFTER characters behind it.
CONTEXT, AFTER = 60, 40
#: In English, French, German and Spanish; fixed values.
CONTEXT_WORDS = {
    "email": ("email", "e-mail", "mail", "contact", "write", "courriel", "écrire", "kontakt", "schreiben", "correo", "contacto", "escribir"),
    "ip": ("ip", "address", "server", "host", "login", "adresse", "serveur", "rechner", "anmeldung", "dirección", "servidor"),
    "card": ("card", "visa", "credit", "payment", "account", "carte", "paiement", "crédit", "karte", "kreditkarte", "zahlung", "tarjeta", "pago", "crédito"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "téléphone", "appeler", "telefon", "anrufen", "handy", "teléfono", "llamar", "móvil"),
    "iban": ("iban", "bank", "account", "transfer", "banque", "compte", "virement", "konto", "überweisung", "banco", "cuenta", "transferencia"),
    "ssn": ("ssn", "social", "security", "tax", "sécurité", "sociale", "impôt", "sozialversicherung", "steuer", "seguridad", "impuesto"),
    "secret": ("token", "key", "secret", "password", "api", "bearer", "jeton", "clé", "passe", "schlüssel", "passwort", "clave", "contraseña", "secreto"),
}
_CONTEXT_RE = {k: re.compile(r"(?<![^\W\d_])(?:" + "|".join(map(re.escape, v)) + r")(?![^\W\d_])") for k, v in CONTEXT_WORDS.items()}
#: Score of a proposal, and what a confirmed checksum and a context word add.
START = {"email": 0.9, "ip": 0.7, "card": 0.4, "phone": 0.6, "iban": 0.2, "ssn": 0.3, "secret": 0.05}
CHECKSUM_GAIN, CONTEXT_GAIN, KEEP = 0.5, 0.3, 0.6
#: Bits a character of a text that no one wrote by hand: a random hex string has nearly 4.
RANDOM_BITS = 3.0


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def looks_random(text: str) -> bool:
    """Letters and digits mixed, and spread as evenly as in a drawn key."""
    counts = Counter(text)
    bits = -sum(c / len(text) * log2(c / len(text)) for c in counts.values())
    return bits >= RANDOM_BITS and any(c.isdigit() for c in counts) and any(c.isalpha() for c in counts)


def _emails(text: str) -> list[tuple[int, int]]:
    """Spans of local@domain.tld, leftmost first: from each @, back to the first local character."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            floor = m.end()
        else:
            floor = max(floor, at + 1)
        at = text.find("@", floor)
    return found


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind's place, end, 1) of the four base kinds, by start and kind."""
    found = [(a, 0, b, 1) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) < 4 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.groups())):
            found.append((m.start(), 1, m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end(), 1))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end(), 1))
    return sorted(found)


def more_spans(text: str, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans of the further kinds whose score reaches KEEP.

    One that a checksum confirms stands beside a base span that it overlaps; any
    other gives way to it.
    """
    starts = [a for a, _, _, _ in base]
    #: The furthest end of the base spans up to each.
    ends = list(accumulate((b for _, _, b, _ in base), max))
    found = []
    for place, pattern, confirm in ((4, _IBAN, mod97), (5, _SSN, None), (6, _SECRET, looks_random)):
        for m in pattern.finditer(text):
            if confirm and not confirm(m.group()):
                continue
            if score_of(text, KINDS[place], m.start(), m.end(), bool(confirm)) < KEEP:
                continue
            before = bisect_left(starts, m.end())
            if place == 4 or not before or ends[before - 1] <= m.start():
                found.append((m.start(), place, m.end(), 0))
    return found


def score_of(text: str, kind: str, start: int, end: int, confirmed: bool) -> float:
    """Start value, plus the gain of what confirms the span, plus that of a context word on either side of it."""
    pattern = _CONTEXT_RE[kind]
    near = pattern.search(text[max(0, start - CONTEXT) : start].lower()) or pattern.search(text[end : end + AFTER].lower())
    return min(1.0, START[kind] + CHECKSUM_GAIN * confirmed + CONTEXT_GAIN * bool(near))


def find_spans(text: str | None) -> list[tuple[int, int, int, int]]:
    """All (start, kind's place in KINDS, end, is base) of one whole text, by start and kind."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + more_spans(text, base))


def _join(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


_TYPE = "struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,n_spans:bigint,base_sha256:string,spans:string,scores:string>"
_TYPES = [pa.int64()] * 5 + [pa.string()] * 3
_NAMES = ["n_email", "n_ip", "n_card", "n_phone", "n_spans", "base_sha256", "spans", "scores"]


def _spans_batch(texts: pa.Array) -> pa.Array:
    rows = []
    for value in texts:
        text = value.as_py()
        spans = find_spans(text)
        base = [s for s in spans if s[3]]
        scores = ",".join(f"{score_of(text, KINDS[k], a, b, k in (2, 4, 6)):.2f}" for a, k, b, _ in spans)
        rows.append((*[sum(s[1] == k for s in base) for k in range(4)], len(spans), hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans), scores))
    columns = zip(*rows, strict=True) if rows else [[] for _ in _NAMES]
    found = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)
    del rows, columns
    release()
    return found


def _masked_batch(texts: pa.Array) -> pa.Array:
    found = pa.array([mask(t.as_py()) for t in texts], pa.string())
    release()
    return found


def mask(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    if not text:
        return text
    out, at = [], 0
    for start, kind, end, _ in find_spans(text):
        if end <= at:
            continue
        out += [text[at : max(at, start)], f"<{KINDS[kind].upper()}>" if start >= at else ""]
        at = end
    return "".join(out) + text[at:] if out else text


def pii_spans(text: Column) -> Column:
    """Struct of the counts, the digest of the base spans, all spans and, in their order, their scores."""
    return F.arrow_udf(_spans_batch, _TYPE)(text)


def detect_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its personal data; positions are code points, ends exclusive.

    Null and empty texts have no spans (zero counts, empty ``spans``, the digest
    of the empty string).  Null ids and repeated rows pass through one for one,
    an empty table gives no rows; only the two named columns are read.
    """
    return df.select(F.col(id_col), pii_spans(F.col(text_col)).alias("p")).select(id_col, "p.*")


def redact_pii(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``df`` with personal data in ``text_col`` masked; ``length_col``, where present, follows the text.

    Null and empty texts stay as they are; no row is dropped.
    """
    masked = fresh(df, "__masked")
    out = df.withColumn(masked, F.arrow_udf(_masked_batch, "string")(F.col(text_col))).withColumn(text_col, F.col(masked)).drop(masked)
    if length_col and length_col in df.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(df.schema[length_col].dataType))
    return out
