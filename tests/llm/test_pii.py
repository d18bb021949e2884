import re

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlake.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            v = m.group()
            digits = re.sub(r"[^0-9]", "", v)
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in v.split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": lambda: 8 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def base(text):
    return [s for s in pii.spans_of(text) if s[0] in pii.BASE_KINDS]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab9@.+-% ()0123é", max_size=60))
def test_base_equals_patterns(text):
    assert base(text) == brute(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111111111111111", "+1 (269) 555-3296", "10.2.3.255", "0300.1.1.1", "000000000000001.2.3.4", "a.b@c.de", "@", ".", " ", "-", "7", "x", "é", "+", ")"]), max_size=9))
def test_base_on_pieces(parts):
    text = "".join(parts)
    assert base(text) == brute(text)


def test_added_kinds_and_mask():
    text = "see https://a.example/x?y=1, iban DE89 3704 0044 0532 0130 00. mail é@x q.r@s.tu"
    kinds = [k for k, _, _ in pii.spans_of(text)]
    assert kinds == ["email", "url", "account"]
    assert pii.masked(text) == "see [URL], iban [ACCOUNT]. mail é@x [EMAIL]"
    assert pii.masked(None) is None and pii.masked("") == "" and pii.spans_of(None) == []


def test_rows(spark):
    docs = spark.createDataFrame([(1, "a@b.cd", 1), (1, "a@b.cd", 1), (2, None, 2), (None, "", 3), (4, "é" * 200000 + " 1.2.3.4", 4)], "doc_id long, text string, kind int")
    rows = {(r.doc_id, r.n_email, r.n_ip, r.spans) for r in pii.digest(docs).collect()}
    assert rows == {(1, 1, 0, "email:0:6"), (2, 0, 0, ""), (None, 0, 0, ""), (4, 0, 1, "ip:200001:200008")}
    assert pii.digest(docs).count() == 5
    out = pii.mask(docs)
    assert out.columns == docs.columns and out.filter("doc_id = 1").first().text == "[EMAIL]"
    assert pii.digest(docs.limit(0)).count() == 0
