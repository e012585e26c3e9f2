import hashlib
import math
import random
import re

import public_tokenizers

from palimpsest.llm.secrets import SEGMENT_COST, Segments, _alphabet, guess_cost, is_secret, ranks, scan_secrets

PATH = public_tokenizers.path("word_bpe_49k.json")
RANK = ranks(PATH)

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)]


def corpus(seed):
    r = random.Random(seed)
    parts = ["é", " ", "password=", "TOKEN : '", "api_key=", "ApiKey= ", "secret", "=", "abcdef0123456789", "AKIA", "ABCDEFGHIJ1234567", "0f" * 9, "zz", "漢", "\n", "passwd\":\"", "x" * 13, "ſecret=", "pass"]
    return [(i, "".join(r.choice(parts) for _ in range(r.randrange(30)))) for i in range(300)] + [(900, None), (901, ""), (902, "abcdef01"), (903, "23456789abcdef01")]


def test_base_against_brute_force(spark):
    rows = corpus(1)
    for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), PATH).collect():
        base = brute(dict(rows)[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
        assert [s for s in r.spans.split(",") if s and not s.startswith("guess")] == base


def every_segmentation(value):
    """The least cost over all segmentations, by recursion."""
    segments = Segments(value, RANK)
    each = math.log10(_alphabet(value))
    memo = {len(value): 0.0}

    def rest(a):
        if a not in memo:
            options = [(b - a) * each + SEGMENT_COST + rest(b) for b in range(a + 1, len(value) + 1)]
            options += [c + SEGMENT_COST + rest(b) for b, c in segments.starting(a)]
            memo[a] = min(options)
        return memo[a]

    return rest(0)


def test_costs():
    r = random.Random(3)
    for _ in range(200):
        v = "".join(r.choice(["password", "2019", "qwerty", "aaa", "abc", "x", "7", "Q", "$"]) for _ in range(r.randrange(1, 7)))
        assert math.isclose(guess_cost(v, RANK)[0], every_segmentation(v))
    weak = ["password123", "qwertyuiop", "aaaaaaaaaaaa", "abcdefgh", "19991231", "P@ssw0rd"]
    strong = ["x9$Kq2!vLm7Z", "tR7pLq9ZxW2v", "correcthorseXk29vbq"]
    assert not any(is_secret(x, RANK) for x in weak) and all(is_secret(x, RANK) for x in strong)


def test_long_values_cost_little_time():
    assert not is_secret("a" * 100_000, RANK) and not is_secret("abab" * 20_000, RANK) and is_secret("xq7" + "Z9k!" * 9 + "0" * 50_000, RANK)


def test_guessed_values(spark):
    rows = [(1, "The password is x9$Kq2!vLm7Z, keep it."), (2, "password: password123"), (3, "the token was lost"), (4, "passwort ist tR7!pLq9ZxW2v"), (5, "é password=abc"), (6, "passphrases are words of the language")]
    got = {r.doc_id: r.spans for r in scan_secrets(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, spans int"), PATH).collect()}
    assert got[1] == "guess:16:28" and got[4] == "guess:13:26" and not (got[2] or got[3] or got[5] or got[6])


def test_ordinary_words_and_addresses_are_no_secrets(spark):
    quiet = "documentation authentication_required https://example.com/reset environment/variables user_name_or_email confidential. never-share-this unavailable config.database.password /etc/application/settings.json 2024-01-15 Donaudampfschiff".split()
    loud = "x9$Kq2!vLm7Z tR7pLq9ZxW2v https://example.com/reset?key=tR7pLq9ZxW2v vQ4-mmX9-tPz1 8Kd0aQw3Zp j4kR#82nqPz Zx81kfQ0pLw2 mK3vR9tQxW7b".split()
    rows = [(i, f"Note: the secret is {x} as before") for i, x in enumerate(quiet + loud)]
    rows += [(100 + i, f"password: {x}") for i, x in enumerate(quiet + loud)]
    got = {r.doc_id for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect() if "guess" in r.spans}
    assert {d % 100 for d in got if d < 100} == set(range(len(quiet), len(quiet + loud)))
    #: Values that the base pattern takes are its own.
    assert all(d - 100 >= len(quiet) for d in got if d >= 100)


def test_precision_and_recall_on_planted_values(spark):
    """1,000 values behind credential words: half random, half of words, dates, walks and repeats."""
    r = random.Random(8)
    words = [w for w in list(RANK)[:20_000] if len(w) > 4]
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&*"
    weak = [lambda: r.choice(words), lambda: r.choice(words) + str(r.randrange(100)), lambda: r.choice(words) + "_" + r.choice(words), lambda: r.choice(words) + "-" + r.choice(words) + "." + r.choice(words), lambda: f"https://{r.choice(words)}.com/{r.choice(words)}/{r.choice(words)}", lambda: r.choice(["qwertyuiop", "aaaaaaaa", "1234567890", "abcdefgh"]) + str(r.randrange(10))]
    values = [(True, "".join(r.choice(letters) for _ in range(r.randrange(10, 20)))) if i % 2 else (False, r.choice(weak)()) for i in range(1000)]
    rows = [(i, f"as said, the {r.choice(['password', 'secret', 'token'])} is {v} for all") for i, (_, v) in enumerate(values)]
    got = {x.doc_id for x in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect() if "guess" in x.spans}
    planted = {i for i, (bad, _) in enumerate(values) if bad}
    precision, recall = len(got & planted) / len(got), len(got & planted) / len(planted)
    print("precision", precision, "recall", recall)
    assert precision >= 0.98 and recall >= 0.98


def test_cues_in_letters_beyond_ascii(spark):
    rows = [(k, f"{cue}: tR7!pLq9ZxW2v") for k, cue in enumerate(["CONTRASEÑA", "Contraseña", "PA\u017f\u017fWORD", "to\u212aen", "ap\u0131key"])]
    got = {r.doc_id: r.spans for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    assert got == {k: f"guess:{len(text) - 13}:{len(text)}" for k, text in rows}


def test_empty(spark):
    assert scan_secrets(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
