import random
import re

from gridloom.llm.private import KINDS, Detector, _luhn, fit_detector, find_private, redacted, rewritten, strict_spans, valid_account


def brute(text):
    """The four formats searched plainly, from left to right."""
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
                          ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
                          ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                    "card": 12 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if fine:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def test_strict_spans_match_plain_search():
    rng = random.Random(5)
    parts = ["@", ".", "a", "b.c", "-", " ", "+1", "(555) 010-9999", "192.168.0.1", "256.1.1.1", "0004.1.2.3", "4539 1488 0343 6467",
             "x@y.zz_q@r.s", "%", "é", "1", "22", "4111111111111111", "٣", "@@", "a@b", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert strict_spans(text) == brute(text), text


def test_long_runs_are_fast():
    assert strict_spans("a" * 300_000) == [] and strict_spans("1" * 200_000) == [] and strict_spans("a" * 100_000 + "@b.c")[0] == (0, 100_004, "email")


def test_table_edges(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cd now", "k"), (None, None, "k"), (1, "", "k")], "doc_id long, text string, kind string")
    rows = find_private(docs, fit_detector(docs)).collect()
    assert sorted(len(r.spans) for r in rows) == [0, 0, 1]
    assert {r.text for r in redacted(docs, Detector()).collect()} == {"mail [EMAIL] now", None, ""}
    assert find_private(docs.limit(0), Detector()).count() == 0


def test_loose_personal_data_is_added(spark):
    """Disguised mailboxes, phone numbers without a plus sign and accounts are found, and not plain numbers or false accounts."""
    assert valid_account("GB82 WEST 1234 5698 7654 32") and not valid_account("GB83 WEST 1234 5698 7654 32")
    assert [valid_account(form) for form, _ in rewritten("4539 1488 0343 6467", "card")[1:]] == [True, False]
    draw = random.Random(3)
    number = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    texts = []
    for i in range(400):
        card = next(c for c in iter(lambda: number(16), None) if _luhn(c))
        texts.append(f"Write to u{i}.x@site{i % 9}.org or call +49 {number(3)} {number(3)}-{number(4)} soon, card {card} too. "
                     f"Order {number(8)} and batch {number(11)} were sent, stock code DE00{number(12)} as well.")
    added = {"write me at ann.lee (at) mail.example (dot) org please": "ann.lee (at) mail.example (dot) org",
             "or bob [at] example.com today": "bob [at] example.com",
             "pay to GB82 WEST 1234 5698 7654 32 by May": "GB82 WEST 1234 5698 7654 32", "stock code DE00123456789012 as well": None,
             "or call 49 555 123-4567 soon": "49 555 123-4567", "Order 12345678 was sent": None}
    docs = spark.createDataFrame(list(enumerate([*texts, *added])), "doc_id long, text string")
    detector = fit_detector(docs)
    assert set(detector.thresholds) >= {"mailbox", "account", "number"}
    for text, span in added.items():
        assert [text[a:b] for a, b, _ in detector.spans(text)[1]] == ([span] if span else []), text
    clean = {r.doc_id: r.text for r in redacted(docs, detector).where(f"doc_id >= {len(texts)}").collect()}
    assert clean[len(texts)] == "write me at [MAILBOX] please" and clean[len(texts) + 3] == "stock code DE00123456789012 as well"
