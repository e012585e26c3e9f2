import random
import re
from collections import Counter

from palimpsest.llm.quality import TABLE, digest, keep_good, measured, reasons, verdict

SCHEMA = "doc_id long, text string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["a", "b", "É", "x#y", "<b>", "漢字", "\x85", "end."]
    texts = ["".join(r.choice(vocabulary) + r.choice([" ", "\n", "\t", " \n"]) for _ in range(r.choice([0, 3, 9, 30, 200]))) for _ in range(60)]
    texts += [None, "", " \n ", "\n\na\na\n", "one two three four five six seven eight nine ten", "a " * 500, "7" * 60_000, "Z" * 60_000, "#" * 60_000]
    return list(enumerate(texts))


def test_base_against_brute_force(spark):
    rows = corpus(1)
    got = {r.doc_id: tuple(r)[1:-1] for r in digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {d: brute(t) for d, t in rows}


def test_verdict(spark):
    good = "This is an ordinary sentence of some fourteen words, which no rule of the table rejects."
    shout = " ".join(f"WORD{chr(65 + i)}!!" for i in range(20))
    marks = " ".join(f"#{i} $$" for i in range(20))
    df = spark.createDataFrame([(1, good, 0), (2, shout, 0), (3, marks, 0), (4, None, 0), (5, good, 1)], "doc_id long, text string, words int")
    assert sorted(r.doc_id for r in keep_good(df).collect()) == [1, 5]
    assert keep_good(df).columns == df.columns
    names = {r.doc_id: r.why for r in measured(df).select("doc_id", reasons().alias("why")).collect()}
    assert names[1] == [] and "capital words" in names[2] and "symbols to words" in names[3] and "words" in names[4]
    loose = [(n, m, None, None) for n, m, _, _ in TABLE]
    assert measured(df).filter(verdict(loose)).count() == 5


def test_no_python_in_plan(spark):
    plan = digest(spark.createDataFrame(corpus(2), SCHEMA).select("doc_id", "text"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert digest(spark.createDataFrame([], SCHEMA)).collect() == []
