import random
import re

from tallyscope.llm import personal_data as pd
from tests.llm.cases import ROWS, empty, frame

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(part) <= 255 for part in match.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m.group())]
    return sorted(found, key=lambda s: (s[1], pd.KINDS.index(s[0])))


def test_base_kinds_equal_the_patterns():
    rng = random.Random(5)
    parts = ["a", "b.", "@", ".", "1", "22", "255", "4111111111111111", "+", "-", " ", "(", ")", "é", "0000", "٣", "3 ", "9-", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        assert [s for s in pd.find(text) if s[0] in PATTERNS] == brute(text), text


def test_added_kinds():
    text = "see https://x.example/a?b=1, IBAN: DE89 3704 0044 0532 0130 00 or account no. 12345678, 12 Long Hill Street."
    found = {kind: text[a:b] for kind, a, b in pd.find(text)}
    assert found["url"] == "https://x.example/a?b=1" and found["iban"] == "DE89 3704 0044 0532 0130 00"
    assert found["account"] == "12345678" and found["street"] == "12 Long Hill Street"
    assert not [s for s in pd.find("IBAN: DE88 3704 0044 0532 0130 00 accountant 123456 rue") if s[0] in ("iban", "account", "street")]


def test_rows(spark):
    rows = [*ROWS, (9, "mail x@y.de now", "en", "a")]
    out = pd.scan(frame(spark, rows))
    assert out.columns == ["doc_id", "spans"] and out.count() == len(rows)
    assert [r.spans for r in out.collect() if r.doc_id == 9] == [[("email", 5, 11)]]
    masked = {r.doc_id: r.text for r in pd.masked(frame(spark, rows)).collect()}
    assert masked[9] == "mail <email> now" and masked[1] is None and masked[2] == ""
    assert pd.scan(empty(spark)).collect() == []
