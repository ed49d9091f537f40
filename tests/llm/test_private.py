import hashlib
import random
import re

from docketry.llm import private
from tests.llm.helpers import rows_of

BASE = {"email": private.EMAIL, "ip": private.IP, "card": private.CARD, "phone": private.PHONE}
ADDED = {"login": private.LOGIN, "iban": private.IBAN, "account": private.ACCOUNT, "token": private.TOKEN, "hidden_email": private.HIDDEN_EMAIL}


def valid(kind, value):
    digits = [int(c) for c in re.sub("[^0-9]", "", value)]
    if kind == "ip":
        return max(map(int, value.split("."))) <= 255
    if kind == "card":
        doubled = [d if k % 2 == 0 else sum(map(int, str(2 * d))) for k, d in enumerate(digits[::-1])]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "iban":
        v = value.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1
    if kind == "account":
        return len(digits) >= 6
    if kind == "token":
        return bool(digits) and re.search("[A-Za-z]", value) is not None
    return True


def brute(text, patterns):
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text or "", re.ASCII):
            group = m.lastindex or 0
            if valid(kind, m[group]):
                out.append(f"{kind}:{m.start(group)}:{m.end(group)}")
    return out


def expected(rows):
    out = []
    for i, t in rows:
        base = brute(t, BASE)
        counts = [sum(s.startswith(k + ":") for s in base) for k in BASE]
        out.append((i, *counts, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(brute(t, BASE | ADDED))))
    return sorted(out, key=repr)


def samples():
    rng = random.Random(4)
    pool = [
        "a", "Z9", "@", ".", "-", "+", "+1", " ", "\n", "(", ")", "1", "4111 1111 1111 1111", "4111-1111 11111111", "10.0.0.255", "256", "0255.1.2.3", "é", "𝟙",
        "x.y@z-1.co.uk", "%_+", "+49 (0)30 123-456", "https://", "ftp://u:p@h.org", "u:p@", "token", "Token = ", "TOKEN=\"", "abc123def456ghi", "password: ", "api_key=",
        "IBAN ", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "DE88370400440532013000", "account number: ", "Konto Nr. ", "12-345678", "ssn ", "_", "(at)", "[at] ",
        "host(dot)de", "me ", " [dot] org", "٣", "3704",
    ]
    odd = [None, "", " ", "@", "a@b", "a@b.c@d.e", "a@b@c.d", "1.2.3.4.5.6.7.8", "1.2.3.400 1.2.3.4", "+1" + " " * 500, "9" * 2000, "1 " * 2000, "a" * 2000 + "@b.c"]
    return odd + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(1500)]


def test_spans_match_regular_expressions(documents):
    rows = [*enumerate(samples()), (None, "a@b.de"), (7, "a@b@c.d")]
    out = private.span_report(documents(rows))
    assert rows_of(out, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans") == expected(rows)
    spans = ",".join(r[-1] for r in expected(rows))
    assert all(k + ":" in spans for k in private.KINDS)


def test_pieces_of_a_batch_lose_no_row(documents, monkeypatch):
    monkeypatch.setattr(private, "PIECE", 50)
    rows = list(enumerate(samples()[:60]))
    assert rows_of(private.span_report(documents(rows)), "doc_id", "spans") == sorted(((r[0], r[-1]) for r in expected(rows)), key=repr)


def test_masked_text_holds_no_span(documents):
    rows = [(1, "write to a.b@c.org, from 10.1.2.3"), (2, None), (3, ""), (4, "token = \"abc123def456ghi\" x"), (5, "plain"), (6, "https://me:pw@host.org/x")]
    docs = documents(rows)
    out = private.without_personal_data(docs)
    assert out.columns == docs.columns
    left = {r.doc_id: r.text for r in out.collect()}
    assert left == {1: "write to [email], from [ip]", 2: None, 3: "", 4: "token = \"[token]\" x", 5: "plain", 6: "[login]/x"}


def test_empty_table(documents):
    assert private.span_report(documents([])).count() == 0
    assert private.without_personal_data(documents([])).count() == 0


def test_long_texts_are_read_once_over():
    automaton = private.anchor_automaton(private.KINDS)
    n = 300_000
    assert private.find("9" * n, automaton) == private.find("1 " * n, automaton) == private.find("+1" + " " * n, automaton) == []
    assert private.find("a" * n + "@b.c", automaton) == [(0, 0, n + 4)]
    assert private.find("1." * n, automaton) == [(1, 8 * k, 8 * k + 7) for k in range(n // 4)]
