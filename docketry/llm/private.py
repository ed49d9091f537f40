"""Personal data by anchor expansion: an Aho-Corasick automaton finds cues, local parsers expand and validate them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 22  # characters of text held as Python strings at once, about; one longer text is held alone

# The base patterns.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

SCHEMES = ["http://", "https://", "ftp://"]
IBAN_CUES = ["iban"]
ACCOUNT_CUES = ["account", "konto", "cuenta", "compte", "passport", "ssn"]
TOKEN_CUES = ["token", "secret", "password", "api_key"]
HIDDEN_AT = ["(at)", "[at]"]


def cased(cues: list[str]) -> list[str]:
    """Every cue in lower case, with a capital, and in capitals."""
    return [x for c in cues for x in dict.fromkeys((c, c.capitalize(), c.upper()))]


# What the method adds: an address with user information, and values behind an identifier cue. Where a pattern has a
# group, the group is the span.
LOGIN = r"""\b(?:https?|ftp)://[^\x00-\x20"'<>/@:]+(?::[^\x00-\x20"'<>/@]*)?@[A-Za-z0-9.-]+"""
IBAN = rf"\b(?:{'|'.join(cased(IBAN_CUES))})[ :#.=]{{0,3}}([A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,4}})?)"
ACCOUNT = rf"\b(?:{'|'.join(cased(ACCOUNT_CUES))})(?: (?:[Nn]umber|[Nn]o\.?|[Nn]r\.?))?[ :#.=]{{0,3}}([A-Z0-9][A-Z0-9-]{{4,30}}[A-Z0-9])"
TOKEN = rf"""\b(?:{'|'.join(cased(TOKEN_CUES))})[\x20\x09]*[=:][\x20\x09]*["']?([A-Za-z0-9_+/=.-]{{12,}})"""
HIDDEN_EMAIL = r"[A-Za-z0-9._%+-]+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]) ?[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+"

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "login", "iban", "account", "token", "hidden_email"]

_DIGITS = "0123456789"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
_DOMAIN = re.compile(EMAIL.partition("@")[2])
_HIDDEN_DOMAIN = re.compile(HIDDEN_EMAIL.partition(r"\[at\])")[2])
_PATTERNS = {k: re.compile(p, re.ASCII) for k, p in (("ip", IP), ("card", CARD), ("phone", PHONE), ("login", LOGIN), ("iban", IBAN), ("account", ACCOUNT), ("token", TOKEN))}

# A parser takes the text, where the anchor starts and ends, and where the kind's last match ended. It returns where the
# match ends, the span, and whether the span is valid; or None where nothing matches.
Found = tuple[int, int, int, bool] | None


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def iban_valid(value: str) -> bool:
    """ISO 7064 remainder of the rearranged number."""
    plain = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _local_start(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1] in _LOCAL:
        at -= 1
    return at


def _email(text: str, at: int, end: int, least: int) -> Found:
    start = _local_start(text, at, least)
    domain = _DOMAIN.match(text, end) if start < at else None
    return (domain.end(), start, domain.end(), True) if domain else None


def _hidden_email(text: str, at: int, end: int, least: int) -> Found:
    close = at - 1 if at - 1 > least and text[at - 1] == " " else at
    start = _local_start(text, close, least)
    domain = _HIDDEN_DOMAIN.match(text, end) if start < close else None
    return (domain.end(), start, domain.end(), True) if domain else None


def _ip(text: str, at: int, end: int, least: int) -> Found:
    while at > least and text[at - 1] in _DIGITS:
        at -= 1
    match = _PATTERNS["ip"].match(text, at)
    if not match:
        return None
    valid = all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in match[0].split(".")))
    return match.end(), at, match.end(), valid


def _card(text: str, at: int, end: int, least: int) -> Found:
    match = _PATTERNS["card"].match(text, at)
    if not match:
        return end, at, end, False
    digits = match[0].replace(" ", "").replace("-", "")
    return match.end(), at, match.end(), 13 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str, at: int, end: int, least: int) -> Found:
    match = _PATTERNS["phone"].match(text, at)
    return (match.end(), at, match.end(), 9 <= sum(c in _DIGITS for c in match[0]) <= 15) if match else None


def _login(text: str, at: int, end: int, least: int) -> Found:
    match = _PATTERNS["login"].match(text, at)
    return (match.end(), at, match.end(), True) if match else None


def _cued(kind: str, valid):
    def parse(text: str, at: int, end: int, least: int) -> Found:
        if at and text[at - 1] in _WORD:
            return None
        match = _PATTERNS[kind].match(text, at)
        return (match.end(), match.start(1), match.end(1), valid(match[1])) if match else None

    return parse


def _account_valid(value: str) -> bool:
    return sum(c in _DIGITS for c in value) >= 6


def _token_valid(value: str) -> bool:
    return any(c in _DIGITS for c in value) and any(c.isalpha() for c in value)


PARSERS = {
    "email": _email, "ip": _ip, "card": _card, "phone": _phone, "login": _login, "iban": _cued("iban", iban_valid),
    "account": _cued("account", _account_valid), "token": _cued("token", _token_valid), "hidden_email": _hidden_email,
}
ANCHORS = {
    "email": ["@"], "ip": [f"{d}." for d in _DIGITS], "card": list(_DIGITS), "phone": [f"+{d}" for d in _DIGITS], "login": SCHEMES,
    "iban": cased(IBAN_CUES), "account": cased(ACCOUNT_CUES), "token": cased(TOKEN_CUES), "hidden_email": HIDDEN_AT,
}


def anchor_automaton(kinds: list[str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for kind in kinds:
        for anchor in ANCHORS[kind]:
            automaton.add_word(anchor, (KINDS.index(kind), len(anchor)))
    automaton.make_automaton()
    return automaton


def find(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """Kind, start and end of every span, by kind and start.

    An anchor inside the last match of its kind is passed over, so the matches of a kind
    are leftmost and do not overlap; a match that is not valid still uses up its characters.
    """
    parsers = [PARSERS[k] for k in KINDS]
    until = [0] * len(KINDS)
    out = []
    for last, (kind, n) in automaton.iter(text):
        at = last + 1 - n
        if at < until[kind]:
            continue
        found = parsers[kind](text, at, last + 1, until[kind])
        if found:
            until[kind], start, end, valid = found
            if valid:
                out.append((kind, start, end))
    out.sort()
    return out


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch of ids and texts that hold about ``PIECE`` characters, with their texts."""
    sizes = [x or 0 for x in pc.binary_length(batch.column(1)).to_pylist()]
    first, held = 0, 0
    for k, n in enumerate(sizes):
        if held and held + n > PIECE:
            part = batch.slice(first, k - first)
            yield part, [t or "" for t in part.column(1).to_pylist()]
            first, held = k, 0
        held += n
    if first < len(sizes):
        part = batch.slice(first)
        yield part, [t or "" for t in part.column(1).to_pylist()]


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: list[str] | None = None) -> DataFrame:
    """``doc_id, spans`` for every row: ``kind, start, end`` in code points, by kind as in ``KINDS``, then start.

    A null text is empty and has no spans, like an empty one; repeated rows each get
    their own; an id may be null. Texts are read whole, other columns are ignored, an empty
    table gives no rows. Nothing is shuffled.
    """
    wanted = [k for k in KINDS if kinds is None or k in kinds]
    id_type = docs.schema[id_col].dataType.simpleString()
    names = KINDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchor_automaton(wanted)
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for part, texts in _pieces(batch):
                spans = [[{"kind": names[k], "start": a, "end": b} for k, a, b in find(t, automaton)] for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, pa.list_(span))], ["doc_id", "spans"])

    plain = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("t"))
    return plain.mapInArrow(run, f"doc_id {id_type}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def span_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row.

    The digest is over the base kinds' spans; both lists are written ``kind:start:end``, comma-joined.
    """
    found = personal_spans(docs, id_col, text_col)

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    digest = F.sha2(joined(of(*BASE_KINDS)).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, joined(F.col("spans")).alias("spans"))


def without_personal_data(docs: DataFrame, text_col: str = "text", kinds: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` with every span written as ``[kind]``; where spans overlap, the first and longest one names it.

    Only the text changes: all rows and columns stay, null and empty texts as they are.
    """
    wanted = [k for k in KINDS if kinds is None or k in kinds]
    names = KINDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchor_automaton(wanted)

        def clean(text: str) -> str:
            out, at = [], 0
            for start, end, kind in sorted(((a, b, k) for k, a, b in find(text, automaton)), key=lambda s: (s[0], -s[1], s[2])):
                if start >= at:
                    out += [text[at:start], f"[{names[kind]}]"]
                at = max(at, end)
            return "".join([*out, text[at:]])

        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            texts = [None if t is None else clean(t) for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)

