import hashlib
import random
import re

from pyspark.sql import functions as F

from palimpsest.llm.pii import digest, expectation_maximisation, masked

SCHEMA = "doc_id long, text string"
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def good(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    found = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        found += [(m.start(), k, m.end()) for m in p.finditer(text or "") if good(kind, m[0])]
    names = list(PATTERNS)
    return [f"{names[k]}:{a}:{b}" for a, k, b in sorted(found)]


def corpus(seed):
    r = random.Random(seed)
    parts = ["é", " ", "a.b", "@", "x-y.org", ".", "_", "a@b.c_d@e.f", "1.2.3.4", "256.1.1.1", "0001.2.3.0255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "12", "-", "漢", "\n", "(", "9" * 25, "+49.30.123", "1.2.3.4.5.6.7.8.9"]
    return [(i, "".join(r.choice(parts) for _ in range(r.randrange(25)))) for i in range(300)] + [(900, None), (901, ""), (902, "1" * 9000 + "x@" * 500), (903, "7-" * 9000), (904, "8" * 12_000), (905, "a@" + "b.c" * 20_000), (906, "+1" + "(" * 90_000), (907, "a." * 4_000)]


def test_base_against_brute_force(spark):
    rows = corpus(1)
    for r in digest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect():
        base = brute(dict(rows)[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), (dict(rows)[r.doc_id], base, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in base) for k in PATTERNS]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in PATTERNS] == base


def test_votes_add_spans(spark):
    rows = [(i, f"Please call phone (555) 123-{4000 + i}, or mail x{i}@example.com") for i in range(40)]
    rows += [(100 + i, f"part no 555.123.{4000 + i} of the catalogue") for i in range(10)]
    got = {r.doc_id: r.spans for r in digest(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, base string")).collect()}
    assert all("local_phone:18:32" in got[i] for i in range(40)) and not any(got[100 + i] for i in range(10))


def test_reliable_labelers_win():
    post = expectation_maximisation([((1, 1, 1, 0, 1), 60), ((1, 0, 0, -1, -1), 30), ((0, 1, 1, 0, 1), 5), ((1, 0, 0, 0, -1), 5)])
    assert post[1, 1, 1, 0, 1] > 0.9 > 0.1 > post[1, 0, 0, -1, -1]
    assert post[0, 1, 1, 0, 1] > 0.5 > post[1, 0, 0, 0, -1]


def planted(seed, n=1500):
    """Documents with one loose case or one decoy each: (doc_id, text, kind, start, end), kind None for decoys."""
    r = random.Random(seed)
    d = lambda k: "".join(str(r.randrange(10)) for _ in range(k))
    names = ["Anna", "Peter", "Maria", "Jean", "Hans", "Laura", "Olga", "Yusuf", "Ines", "Tariq"]
    cases = {
        "masked_email": lambda: ("Write by e-mail to ", f"{r.choice(names).lower()}.{r.choice('abc')}{r.choice([' (at) ', ' [at] ', '(at)'])}{r.choice(['gmail', 'example', 'web'])}{r.choice([' [dot] ', ' (dot) '])}com"),
        "national_id": lambda: (r.choice(["social security no. is ", "Her SSN: ", "My ssn is "]), f"{r.randrange(100, 600)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}"),
        "iban": lambda: (r.choice(["Please pay to account ", "IBAN: ", "the IBAN is "]), f"DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}"),
        "local_phone": lambda: (r.choice(["Call me: ", "phone ", "Tel. "]), f"({r.randrange(200, 900)}) {d(3)}-{d(4)}"),
        "titled_name": lambda: (r.choice(["The letter was signed by ", "Please contact ", "the address of "]), f"{r.choice(['Mr.', 'Mrs.', 'Dr.'])} {r.choice(names)} {r.choice(['Berg', 'Costa', 'Novak'])}"),
    }
    decoys = [
        lambda: ("see part no ", f"{d(3)}.{d(3)}.{d(4)}"), lambda: ("ISBN ", f"000-{d(2)}-{d(4)}"), lambda: ("order ", f"{d(3)} {d(3)} {d(4)}"),
        lambda: ("serial ", f"9{d(2)}-00-{d(4)}"), lambda: ("model ", f"AB{d(2)} {d(4)} {d(4)} {d(4)}"), lambda: ("as in figure ", f"{d(3)}-{d(3)}-{d(4)}"),
    ]
    rows = []
    for i in range(n):
        kind = r.choice([*cases, None])
        before, span = cases[kind]() if kind else r.choice(decoys)()
        lead = r.choice(["It rained. ", "é 漢 once. ", ""])
        start = len(lead + before)
        rows.append((i, f"{lead}{before}{span}, and so on.", kind, start, start + len(span)))
    return rows


def test_planted_cases(spark):
    rows = planted(6)
    got = {r.doc_id: [s for s in r.spans.split(",") if s] for r in digest(spark.createDataFrame([x[:2] for x in rows], SCHEMA)).collect()}
    wanted = {(i, f"{k}:{a}:{b}") for i, _, k, a, b in rows if k}
    found = {(i, s) for i, own in got.items() for s in own}
    precision, recall = len(found & wanted) / len(found), len(found & wanted) / len(wanted)
    print("precision", precision, "recall", recall, {k: sum(w[1].startswith(k) for w in wanted - found) for k in ("masked_email", "national_id", "iban", "local_phone", "titled_name")})
    assert precision >= 0.98 and recall >= 0.9


def test_masked_stays_in_its_row(spark):
    rows = [(1, "a@b.cc", "p"), (1, "hello world nothing here", "q"), (None, "x a@b.cc", "r"), (None, None, None), (1, "a@b.cc", "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumn("_spans", F.lit("s")).withColumn("_of", F.lit("o")).withColumn("row", F.lit("w")).withColumn("base", F.lit(1)).withColumn("email", F.lit(2))
    got = masked(df)
    assert got.schema.names == df.schema.names
    expected = [(1, "[email]", "p"), (1, "hello world nothing here", "q"), (None, "x [email]", "r"), (None, None, None), (1, "[email]", "p")]
    assert sorted(map(str, (tuple(x) for x in got.collect()))) == sorted(str((*x, "s", "o", "w", 1, 2)) for x in expected)


def test_masked_and_native(spark):
    df = spark.createDataFrame([(1, "é a@b.cc +1 555 123 4567!", 7), (2, None, 7), (3, "plain", 7)], "doc_id long, text string, kind int")
    got = {r.doc_id: r.text for r in masked(df).collect()}
    assert got == {1: "é [email] [phone]!", 2: None, 3: "plain"} and masked(df).columns == df.columns
    assert digest(df.limit(0)).collect() == []
    assert "Python" not in digest(df)._jdf.queryExecution().toString()
