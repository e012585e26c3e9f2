import hashlib
import random

from pyspark.sql import functions as F

from palimpsest.llm.chat import best_paths, digest, format_trees, read_back, threads

SCHEMA = "conv_id long, turn long, role string, text string"
CONTROL = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<\\|im_end|>", "<\\\\/s>", "[\\INST]", "\\", "\n", "x", "é漢", "<", "[", "%", "%0A"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def corpus(seed):
    r = random.Random(seed)
    rows = []
    for c in range(25):
        for t in range(r.choice([1, 2, 3, 7, 40])):
            rows.append((c, t, r.choice(["user", "assistant", "system"]), "".join(r.choice(CONTROL) for _ in range(r.randrange(9)))))
    return rows + [(100, 0, "assistant", None), (101, 0, None, "x"), (102, 5, "we\nird%<|im_end|>", "y"), (103, 1, "user", "b"), (103, 1, "user", "a"), (103, 1, "user", "a")]


def test_round_trip(spark):
    rows = corpus(1)
    got = {r.conv_id: r for r in digest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    for c in {x[0] for x in rows}:
        own = sorted((t, role or "", text or "") for k, t, role, text in rows if k == c)
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got.pop(c)
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{a}\n{b}\n" for _, a, b in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    assert not got


def test_texts_hold_no_control_strings(spark):
    text = "".join(CONTROL) * 2
    row = format_trees(threads(spark.createDataFrame([(1, 0, "user", text)], SCHEMA))).first()
    body = row.formatted.removeprefix("<|im_start|>user\n").removesuffix("<|im_end|>\n")
    assert not any(c in body for c in CONTROL[:8])


def tree(seed):
    r = random.Random(seed)
    rows = []
    for c in range(20):
        for m in range(1, r.randrange(2, 30)):
            rows.append((c, m, r.choice([None, *range(1, m)]) if r.random() < 0.5 else (m - 1 or None), "user", f"{c}.{m}", float(r.randrange(10))))
    return rows


def test_paths_against_brute_force(spark):
    rows = tree(4) + [(99, 1, 50, "user", "orphan", 1.0)]
    got = {}
    for r in best_paths(spark.createDataFrame(rows, "conv_id long, message long, parent long, role string, text string, score double"), 2).collect():
        got.setdefault((r.conv_id, r.path), []).append((r.depth, r.message))
    expected = {}
    for c in {x[0] for x in rows}:
        own = {m: (p, s) for k, m, p, _, _, s in rows if k == c}
        paths = []
        for leaf in own.keys() - {p for p, _ in own.values()}:
            path, m = [], leaf
            while m in own:
                path.append(m)
                m = own[m][0]
            paths.append((-sum(own[m][1] for m in path) / len(path), -len(path), leaf, path[::-1]))
        for k, (_, _, _, path) in enumerate(sorted(paths)[:2], 1):
            expected[c, k] = list(enumerate(path, 1))
    assert {k: sorted(v) for k, v in got.items()} == expected


def test_empty(spark):
    assert [r.conv_id for r in digest(spark.createDataFrame([], SCHEMA)).collect()] == [-7]
    assert read_back(format_trees(threads(spark.createDataFrame([], SCHEMA)))).collect() == []


TREE = "conv_id long, message long, parent long, role string, text string, score double"


def test_rings_of_parents_end(spark):
    """A ring is cut before its least message; a message that is its own parent is a root."""
    rows = [(1, 4, 6, "user", "a", 0.0), (1, 5, 4, "user", "b", 0.0), (1, 6, 5, "user", "c", 0.0), (1, 9, 6, "user", "d", 0.0), (2, 1, 1, "user", "e", 0.0), (2, 2, 1, "user", "f", 0.0)]
    rows += [(3, k, (k + 1) % 17, "user", str(k), 0.0) for k in range(17)] + [(4, 1, None, "user", "g", 0.0), (4, 2, 1, "user", "h", 0.0)]
    got = {r.conv_id: [t.text for t in r.turns] for r in read_back(format_trees(spark.createDataFrame(rows, TREE))).collect()}
    assert got == {1: ["a", "b", "c", "d"], 2: ["e", "f"], 3: ["0", *[str(k) for k in range(16, 0, -1)]], 4: ["g", "h"]}


def test_messages_that_share_a_number_are_one(spark):
    rows = [(1, 1, None, "user", "x", 0.0), (1, 1, None, "user", "x", 0.0), (1, 2, 1, "user", "b", 0.0), (1, 2, 1, "user", "a", 0.0), (None, 1, None, None, None, 0.0), (None, 1, None, None, None, 0.0)]
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in read_back(format_trees(spark.createDataFrame(rows, TREE).withColumn("least", F.lit(1)))).collect()}
    assert got == {1: [("user", "x"), ("user", "a")], None: [("", "")]}


def test_conversation_of_the_contract_takes_turns_of_the_input_in(spark):
    row = {r.conv_id: r for r in digest(spark.createDataFrame([(-7, 5, "user", "more")], SCHEMA)).collect()}[-7]
    assert row.n_turns == 3
