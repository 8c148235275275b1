import hashlib
import random
import re

from weftgraph.llm import pii
from weftgraph.llm.queries import op9_pii as op9

# The base expressions of the contract.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, (kind, rx) in enumerate(PLAIN.items()):
        for m in re.finditer(rx, text):
            s = m.group()
            d = re.sub(r"[^0-9]", "", s)
            double = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1]))
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")),
                "card": 12 <= len(d) <= 19 and double % 10 == 0,
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def base(text):
    return [f"{x.kind}:{x.start}:{x.end}" for x in pii.find_spans(text) if x.kind in pii.BASE]


def test_against_plain_expressions():
    rng = random.Random(5)
    pieces = ["a.b@c.d", "@", "a", ".", "-", "+", "1", "23", "255", "256", "4111 1111 1111 1111", "+1 (555) 123-4567", "é", " ", "(", ")", "x@y", "1.2.3.4", "10.0.0.1.5", "00012", "@@", "%_", "4041894974608795"]
    for _ in range(6000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert base(t) == brute(t), t


def test_long_texts_stay_linear():
    for t in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "+1" + " " * 200_000, "@" * 100_000, "a@" * 100_000):
        pii.find_spans(t)


def test_iban_context_and_redaction():
    t = "my iban DE89 3704 0044 0532 0130 00, bad DE88 3704 0044 0532 0130 00, é a@b.co"
    found = pii.find_spans(t)
    iban = [x for x in found if x.kind == "iban"]
    assert [t[x.start : x.end] for x in iban] == ["DE89 3704 0044 0532 0130 00"] and iban[0].score > pii.PRIOR["iban"]
    assert pii.redact(t, found).startswith("my iban <") and pii.redact(t, found).endswith("é <EMAIL>")
    assert "a@b.co" not in pii.redact(t, found)


def test_numbers_inside_longer_runs():
    t = "room 123 4111 1111 1111 1111 call +1 (555) 123-4567 4041894974608795 99"
    found = {x.kind: t[x.start : x.end] for x in pii.find_spans(t)}
    assert found == {"card_part": "4041894974608795", "phone_part": "+1 (555) 123-4567"} | found
    assert "4111 1111 1111 1111" in [t[x.start : x.end] for x in pii.find_spans(t) if x.kind == "card_part"]
    assert pii.redact(t, pii.find_spans(t)) == "room 123 <CARD_PART> call <PHONE_PART> <CARD_PART> 99"
    pii.find_spans("1 " * 100_000)


def test_query(spark, make_docs):
    texts = [None, "", "mail a@b.com now", "x " * 50_000 + "1.2.3.4", "mail a@b.com now", "4111111111111111 +1 (555) 123-4567"]
    _, d = make_docs(texts, extra={"spans": "string", "redacted": "int"})
    got = {r.doc_id: r for r in op9(spark, d).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        spans = brute(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert got[i].n_email == sum(s.startswith("email") for s in spans)
        assert got[i].n_phone == sum(s.startswith("phone") for s in spans)
        assert set(spans) <= set(got[i].spans.split(",")) or not spans
    _, d = make_docs([])
    assert op9(spark, d).count() == 0


def test_iban_before_words_in_capitals_or_digits():
    es, at, be = "ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201", "BE68 5390 0754 7034"
    ibans = lambda t: [t[x.start : x.end] for x in pii.find_spans(t) if x.kind == "iban"]
    for iban in (es, at, be, es.replace(" ", ""), at.replace(" ", ""), "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"):
        for rest in ("", ".", " BIC CAIXESBB", " 12 marzo", " BANK AUSTRIA", " BANK 1234 ABCD", " X"):
            assert ibans(f"to {iban}{rest}") == [iban], (iban, rest)
    assert ibans(f"{es} {at} {be}") == [es, at, be]
    assert ibans(f"AB12 {es} BANK") == [es]
    assert ibans("ES92 2100 0418 4502 0005 1332 BANK") == [] and ibans(es[:-1] + " BANK") == []
    assert pii.redact(f"{es} BANK", pii.find_spans(f"{es} BANK")).endswith("> BANK")
    pii.find_spans("AB12 " * 40_000)


def test_context_decides_for_local_numbers():
    near, alone = "please call 415 555 0134 today", "order 415 555 0134 today"
    assert [(x.kind, near[x.start : x.end], round(x.score, 1)) for x in pii.find_spans(near)] == [("phone_local", "415 555 0134", 0.6)]
    assert pii.find_spans(alone) == [] and [x.kind for x in pii.find_spans(alone, 0.0)] == ["phone_local"]
    # base spans stay whatever their score, and digits of other spans are no local number
    assert [x.kind for x in pii.find_spans("tel +1 415 555 0134", 1.0)] == ["phone"]
    assert pii.find_spans("tel 1.415.555.0134 and 415-555-01345 and v2.415-555-0134", 0.0) == []
