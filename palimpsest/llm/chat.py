"""Chat formatting over reply trees, in DataFrame operations only.

Messages name their parent. Iterative self-joins double each message's pointer to an ancestor,
and with it the sums along the way, until all pointers have passed the root: so every message
knows its depth and the score of its branch after about log2(depth) joins. Leaves are ranked
by branch score within their conversation. The paths of the chosen leaves are then enumerated
by the same pointers from the longest down: each join adds the ancestors that many steps up.

Each path becomes one conversation: ``<|im_start|>role`` newline ``text<|im_end|>`` newline a
turn. Control strings inside texts get a backslash after their first character (one more, if
there are some already), which reading back removes. The loss mask lists the code points of
the assistant's texts.

Cases: null texts and roles are empty; a parent that is missing makes a message a root; turns
of one conversation that share a number are ordered by role and text; repeated rows are turns
of their own; messages of a tree that share a number are one message; in a ring of parents the
least message is the root; a conversation -7 of the input takes the contract's turns in; empty
tables give an empty result; other columns are ignored. A conversation becomes one text, so its
turns meet in one task; nothing else is gathered by conversation alone but the rank of its leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palimpsest.llm.shared import checkpointed, written

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
#: What follows the first character of a control string (fixed values).
_AFTER_ANGLE = r"/?s>|</?SYS>>|\|[A-Za-z0-9_]{1,64}\|>"
_AFTER_SQUARE = r"/?INST\]"
_CONTROL = rf"(<(?=\\*(?:{_AFTER_ANGLE}))|\[(?=\\*{_AFTER_SQUARE}))"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(<(?=\\+(?:{_AFTER_ANGLE}))|\[(?=\\+{_AFTER_SQUARE}))\\", "$1")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _role_in(role: Column) -> Column:
    return unescaped(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def threads(conversations: DataFrame) -> DataFrame:
    """Rows by turn as reply trees of one branch: conv_id, message, parent, role, text, score."""
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    number = F.row_number().over(order)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("conv_id", number.cast("long").alias("message"), F.when(number > 1, number - 1).cast("long").alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def distinct_messages(messages: DataFrame) -> DataFrame:
    """One row for each message number of a conversation: of rows that share one, the least by parent, score, role and text."""
    rest = ("parent", "score", "role", "text")
    least = messages.groupBy("conv_id", "message").agg(F.min(F.struct(*rest)).alias("least"))
    whole = {c: F.col("least")[c] for c in rest}
    return least.select("conv_id", "message", *[(F.coalesce(x, F.lit("")) if c in ("role", "text") else x).alias(c) for c, x in whole.items()])


def _climbed(nodes: DataFrame, rounds: int) -> tuple[DataFrame, list[DataFrame], bool]:
    """Every message with its steps to the root and the sum of scores on the way, the pointers of each round, and
    whether some never got there. Pointers also carry the least message that they passed."""
    known = nodes.select(F.col("conv_id").alias("c"), F.col("message").alias("m"))
    parent = F.when(F.col("m").isNotNull(), F.col("parent"))
    state = nodes.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("m")), "left").select(
        "conv_id", "message", parent.alias("up"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("sum"), parent.alias("least")
    )
    jumps = []
    for _ in range(rounds + 1):
        state = checkpointed(state)
        jumps.append(state.select("conv_id", "message", "up").filter("up is not null"))
        if jumps[-1].isEmpty():
            return state, jumps, False
        above = state.select(F.col("conv_id").alias("c"), F.col("message").alias("m"), F.col("up").alias("further"), F.col("steps").alias("more"), F.col("sum").alias("plus"), F.col("least").alias("lower"))
        going = state.filter("up is not null").join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("m")))
        moved = going.select("conv_id", "message", F.col("further").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("sum") + F.col("plus")).alias("sum"), F.least("least", "lower").alias("least"))
        state = state.filter("up is null").unionByName(moved)
    return checkpointed(state), jumps, True


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(conv_id, path, depth, message): the messages on the best root-to-leaf paths of each tree, path counting from 1.

    As many rounds as the largest conversation needs reach every root. What is still climbing then
    goes round a ring of parents; the least message of each ring becomes a root.
    """
    nodes = checkpointed(messages.select("conv_id", "message", "parent", "score"))
    largest = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    state, jumps, rings = _climbed(nodes, largest.bit_length())
    if rings:
        roots = state.filter("up is not null and least = message").select(F.col("conv_id").alias("c"), F.col("message").alias("m"))
        cut = nodes.join(roots, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("message") == F.col("m")), "left")
        nodes = checkpointed(cut.select("conv_id", "message", F.when(F.col("m").isNull(), F.col("parent")).alias("parent"), "score"))
        state, jumps, _ = _climbed(nodes, largest.bit_length())
    parents = nodes.select(F.col("conv_id").alias("c"), F.col("parent").alias("m")).filter("m is not null").distinct()
    leaves = state.join(parents, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("message") == F.col("m")), "left_anti")
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc(F.col("sum") / F.col("steps")), F.desc("steps"), "message"))
    ranked = leaves.withColumn("path", rank).filter(F.col("path") <= branches)
    paths = checkpointed(ranked.select("conv_id", "path", F.col("steps").alias("depth"), "message"))
    for power in range(len(jumps) - 2, -1, -1):
        jump = jumps[power].select(F.col("conv_id").alias("c"), F.col("message").alias("m"), "up")
        further = paths.join(jump, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("message") == F.col("m"))).select("conv_id", "path", (F.col("depth") - (1 << power)).alias("depth"), F.col("up").alias("message"))
        paths = checkpointed(paths.unionByName(further))
    return paths


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """conv_id, path, formatted text, and the loss mask as (start, end) code points."""
    return _formatted(distinct_messages(messages), branches)


def _formatted(messages: DataFrame, branches: int) -> DataFrame:
    paths = best_paths(messages, branches)
    texts = messages.select(F.col("conv_id").alias("c"), F.col("message").alias("m"), "role", "text")
    turns = paths.join(texts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("message") == F.col("m"))).select("conv_id", "path", "depth", "role", "text")
    head, body = F.concat(F.lit(START), _role_out(F.col("role")), F.lit("\n")), escaped(F.col("text"))
    pieces = turns.select("conv_id", "path", "depth", head.alias("head"), body.alias("body"), (F.col("role") == LOSS_ROLE).alias("loss"))
    pieces = pieces.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    before = F.coalesce(F.sum(F.char_length("piece")).over(W.partitionBy("conv_id", "path").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = before + F.char_length("head")
    placed = pieces.select("conv_id", "path", "depth", "piece", "loss", start.alias("start"), (start + F.char_length("body")).alias("end"))
    whole = placed.groupBy("conv_id", "path").agg(F.array_sort(F.collect_list(F.struct("depth", "piece", "loss", "start", "end"))).alias("turns"))
    mask = F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return whole.select("conv_id", "path", F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"), mask.alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The formatted conversations with their turns and the text under the mask, as parsed from the output."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 1 << 30)

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        body = F.substring(x, F.char_length(role) + 2, F.char_length(x) - F.char_length(role) - 1 - len(END) - 1)
        return F.struct(_role_in(role).alias("role"), unescaped(body).alias("text"))

    masked = F.transform("loss_mask", lambda s: unescaped(F.substring(F.col("formatted"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumn("turns", F.transform(parts, turn)).withColumn("loss_text", F.array_join(masked, ""))


def extra_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7 of the contract."""
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    return spark.range(2, numPartitions=1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))


def digest(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(extra_conversation(conversations.sparkSession))
    read = read_back(_formatted(written(threads(rows), "messages"), 1))
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(role) + length(text)
           + len(regexp_extract_all(text, '<\\*(?:/?s>|</?SYS>>|\|[A-Za-z0-9_]{1,64}\|>)|\[\\*/?INST\]')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
