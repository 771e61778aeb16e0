import hashlib
import random
import re

from hypothesis import given, settings, strategies as st

from tablechange.llm.pii import BASE, KINDS, base_spans, candidates, features, find_pii, fit_pii, luhn, redact, train_pii, weak_label
from tablechange.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def keep(kind, body):
        digits = re.sub("[^0-9]", "", body)
        if kind == "ip":
            return all(int(p) <= 255 for p in body.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 10 <= len(digits) <= 15

    found = [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if keep(k, m[0])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


@settings(max_examples=1500, deadline=None)
@given(st.text("a1.@+- (0é5", max_size=40))
def test_base_spans_like_the_plain_patterns(text):
    assert base_spans(text) == plain_spans(text)


def test_more_base_spans():
    rng = random.Random(3)
    pieces = ["a@b.c", "@", "x@y", "4111111111111111", "4111 1111 1111 1111", "+1 (555) 010-9999", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "000255.1.1.1", " ", "-", "7", "a.b@c.d.e@f.g", "é", "+"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(8)))
        assert base_spans(text) == plain_spans(text), text


def test_long_runs_stay_linear():
    for text in ("1" * 200_000, "a" * 200_000, "a@" * 100_000, "1." * 100_000, "+" * 200_000, "1 " * 100_000, "(" * 100_000, "a1" * 100_000 + "=", "key=" * 50_000):
        base = base_spans(text)
        candidates(text)
        assert isinstance(base, list)


ROWS = (
    [(i, f"word token = \"{random.Random(i).getrandbits(160):040x}\" then more words") for i in range(60)]
    + [(100 + i, f"mail me at user{i}@mail.example.com or +1 (212) 555-{1000 + i} now") for i in range(60)]
    + [(200 + i, f"order {random.Random(i).getrandbits(60)} of part 1234-5678-90{i}") for i in range(60)]
)


def test_operator(make):
    rows = ROWS + [(901, None), (902, ""), (None, "x@y.zz"), (903, "p 1.2.3.4"), (903, "p 1.2.3.4"), (904, "word " * 60_000 + "a@b.cd")]
    df = make(rows, extra=True)
    model = train_pii(df)
    assert "secret" in model.least
    got = find_pii(df, model).collect()
    texts = sorted(((i, t or "") for i, t in rows), key=repr)
    assert len(got) == len(rows)
    want = sorted(((i, plain_spans(t)) for i, t in texts), key=repr)
    assert sorted(((r["doc_id"], [tuple(s) for s in r["base"]]) for r in got), key=repr) == want
    secrets = {r["doc_id"] for r in got if any(s["kind"] == "secret" for s in r["added"])}
    assert set(range(60)) <= secrets
    for r in got:
        assert not any(a["start"] < b["end"] and b["start"] < a["end"] for a in r["added"] for b in r["base"])
    assert not [r for r in got if r["doc_id"] == 904 and r["added"]]
    assert find_pii(make([]), train_pii(make([]))).count() == 0


def test_held_out_accuracy():
    rows = []
    for i, t in ROWS:
        base = base_spans(t)
        for s in candidates(t):
            label = weak_label(t, s, base)
            if label is not None:
                rows.append((s[0], features(t, s, base), label, i % 2 == 0))
    model = fit_pii(rows)
    test = [r for r in rows if r[3]]
    right = sum((model.score(r[1]) > 0.5) == bool(r[2]) for r in test)
    assert right / len(test) > 0.95


def account(country, number):
    """An account number with its check digits, in groups of four."""
    check = 98 - int("".join(str(int(c, 36)) for c in number + country + "00")) % 97
    body = f"{country}{check:02d}{number}"
    return " ".join(body[i : i + 4] for i in range(0, len(body), 4))


def test_learns_what_base_formats_do_not_find(make):
    rng = random.Random(8)
    mails = [f"write to jane{i} [at] example{i % 7} [dot] {rng.choice(['com', 'org'])} soon" for i in range(80)]
    right = [account("DE", f"{rng.randrange(10**18):018d}") for _ in range(80)]
    wrong = [a[:2] + f"{(int(a[2:4]) + 1) % 98:02d}" + a[4:] for a in right]
    rows = [*mails, *(f"please pay {a} by may" for a in right), *(f"model {a} is sold" for a in wrong), *(f"call(foo.bar{i}) [at] x.{i}" for i in range(80))]
    docs = make([*enumerate(rows), *((None, t) for t in rows[:5])])
    model = train_pii(docs)
    got = {r["doc_id"]: {(s["kind"], rows[r["doc_id"]][s["start"] : s["end"]]) for s in r["added"]} for r in find_pii(docs, model).filter("doc_id is not null").collect()}
    assert all(("odd_email", rows[i].removeprefix("write to ").removesuffix(" soon")) in got[i] for i in range(80))
    clear = [i for i, a in enumerate(right) if not base_spans(rows[80 + i])]
    assert len(clear) > 40 and all(("id_number", right[i]) in got[80 + i] for i in clear)
    assert not any(("id_number", a) in got[160 + i] for i, a in enumerate(wrong))
    assert ("id_number", 4, 31) in candidates("PAY DE89 3704 0044 0532 0130 00 NOW") and weak_label("DE89 3704 0044 0532 0130 00", ("id_number", 0, 27), []) == 1


def test_redact():
    assert redact("a x@y.zz b 1.2.3.4", [("email", 2, 8), ("ip", 11, 18)]) == "a [email] b [ip]"
    assert redact("abcdef", [("email", 0, 4), ("ip", 2, 6)]) == "[email]ef"


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op3_pii"](spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        spans = plain_spans(texts[r["doc_id"]])
        joined = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in spans) for k in BASE]
        every = r["spans"].split(",") if r["spans"] else []
        assert set(joined) <= set(every)
        assert every == sorted(every, key=lambda s: (int(s.split(":")[1]), KINDS.index(s.split(":")[0])))
