"""Chat formatting of reply trees (native): the best root-to-leaf path of each tree as one conversation.

A message names its parent. Paths are found by self-joins of the (message, ancestor) table with itself:
each round doubles the distance, and adds the scores in between, so a thread of n messages takes log2(n)
rounds on a table that stays one row a message. Leaves are ranked by the score of their whole path. The
chosen paths are then marked from the leaf up by the same tables in reverse, and only the messages on
them meet their texts. All rounds carry ids and numbers; each is a table in the shared folder.

Template, for each turn: ``<turn ROLE>TEXT</turn>`` and a line feed. In roles and texts ``\\`` is written
``\\\\``, ``<`` is ``\\l`` and ``>`` is ``\\g``, so no text can hold a mark, and every text can be read
back. The loss mask is a list of code point spans that cover the texts of assistants and nothing else.

Defined results: a null text or role is empty, a null score 0; a parent that is not in the tree makes a
root; messages on a cycle, and those below one, have no root and belong to no path; leaves of equal score
are ranked by depth, the deeper first, then by id; a null tree id is a tree of its own (kept apart as the
smallest 64-bit integer); message ids must be unique in a tree; extra columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantscope.llm.common import hex_sha256, prefix_sums, shared_table

NO_TREE = -(2**63)
ASSISTANT = "assistant"
OPEN, MIDDLE, CLOSE = "<turn ", ">", "</turn>\n"


def escape(x: Column) -> Column:
    for plain, written in (("\\", "\\\\"), ("<", "\\l"), (">", "\\g")):
        x = F.replace(x, F.lit(plain), F.lit(written))
    return x


def unescape(x: Column) -> Column:
    """Pairs of backslashes are taken first, from the left; in what is between them \\l and \\g are marks."""
    parts = F.transform(
        F.split(x, r"\\\\", -1),
        lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")),
    )
    return F.array_join(parts, "\\")


def _jumps(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Per round (t, n, up: the ancestor 2**round above), and (t, n, root, depth, score) of every message.

    ``messages``: (t, n, p, s).
    """
    known = messages.select("t", F.col("n").alias("p"), F.lit(True).alias("known"))
    state = shared_table(
        messages.join(known, ["t", "p"], "left").select(
            "t",
            "n",
            F.when(F.col("known"), F.col("p")).alias("up"),
            F.coalesce(F.when(F.col("known"), F.col("p")), F.col("n")).alias("top"),
            F.when(F.col("known"), 1).otherwise(0).cast("long").alias("steps"),
            F.col("s").alias("score"),
        ),
        "reply-jumps",
    )
    tables, ended = [], [state.where("up is null")]
    open_, left = state.where("up is not null"), -1
    while True:
        n = open_.count()
        if n in (0, left):  # what stays open hangs on a cycle
            break
        left = n
        tables.append(open_.select("t", "n", "up"))
        # the ancestor may have come to the root in an earlier round
        above = state.select("t", F.col("n").alias("up"), *[F.col(c).alias(f"_{c}") for c in ("up", "top", "steps", "score")])
        met = shared_table(
            open_.join(above, ["t", "up"]).select(
                "t",
                "n",
                F.col("_up").alias("up"),
                F.col("_top").alias("top"),
                (F.col("steps") + F.col("_steps")).alias("steps"),
                (F.col("score") + F.col("_score")).alias("score"),
            ),
            "reply-jumps",
        )
        ended.append(met.where("up is null"))
        open_ = met.where("up is not null")
        state = state.where("up is null").unionByName(met)
    done = ended[0]
    for x in ended[1:]:
        done = done.unionByName(x)
    return tables, done.select("t", "n", F.col("top").alias("root"), F.col("steps").alias("depth"), "score")


def best_paths(
    replies: DataFrame,
    tree: str = "tree_id",
    node: str = "node_id",
    parent: str = "parent_id",
    score: str = "score",
    branches: int | None = 1,
) -> DataFrame:
    """(t, leaf, rank, n, position): the messages on the ``branches`` best paths of each root (None: on all)."""
    messages = shared_table(
        replies.select(
            F.coalesce(F.col(tree).cast("long"), F.lit(NO_TREE)).alias("t"),
            F.col(node).alias("n"),
            F.col(parent).alias("p"),
            F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("s"),
        ),
        "reply-messages",
    )
    tables, reached = _jumps(messages)
    answered = messages.select("t", F.col("p").alias("n"))
    leaves = reached.join(answered, ["t", "n"], "left_anti")
    order = Window.partitionBy("t", "root").orderBy(F.desc("score"), F.desc("depth"), "n")
    ranked = leaves.withColumn("rank", F.row_number().over(order))
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    marked = ranked.select("t", F.col("n").alias("leaf"), "rank", "n", F.col("depth").alias("position"))
    for k in range(len(tables) - 1, -1, -1):
        above = F.struct(F.col("up").alias("n"), (F.col("position") - F.lit(1 << k)).alias("position"))
        both = F.when(F.col("up").isNull(), F.array(F.struct("n", "position"))).otherwise(F.array(F.struct("n", "position"), above))
        marked = shared_table(
            marked.join(tables[k], ["t", "n"], "left").select("t", "leaf", "rank", F.explode(both).alias("x")).select("t", "leaf", "rank", "x.*"),
            "reply-paths",
        )
    return marked


def formatted(turns: Column) -> dict[str, Column]:
    """``text`` and ``loss`` (spans of code points, end exclusive) from an array of (role, text)."""
    heads = F.transform(turns, lambda x: F.concat(F.lit(OPEN), escape(x["role"]), F.lit(MIDDLE)))
    bodies = F.transform(turns, lambda x: escape(x["text"]))
    tail = len(CLOSE)
    ends = prefix_sums(F.zip_with(heads, bodies, lambda h, b: F.char_length(h) + F.char_length(b) + tail))
    spans = F.zip_with(
        F.zip_with(turns, bodies, lambda x, b: F.struct(x["role"].alias("role"), F.char_length(b).alias("chars"))),
        ends,
        lambda x, end: F.struct((end - tail - x["chars"]).alias("start"), (end - tail).alias("end"), x["role"].alias("role")),
    )
    taught = F.transform(F.filter(spans, lambda s: s["role"] == ASSISTANT), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    parts = F.zip_with(heads, bodies, lambda h, b: F.concat(h, b, F.lit(CLOSE)))
    return {"text": F.array_join(parts, ""), "loss": taught}


def conversations(
    replies: DataFrame,
    tree: str = "tree_id",
    node: str = "node_id",
    parent: str = "parent_id",
    score: str = "score",
    role: str = "role",
    text: str = "text",
    branches: int | None = 1,
) -> DataFrame:
    """(tree, leaf, rank, text, loss) of every chosen path."""
    paths = best_paths(replies, tree, node, parent, score, branches)
    own = replies.select(
        F.coalesce(F.col(tree).cast("long"), F.lit(NO_TREE)).alias("t"),
        F.col(node).alias("n"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    turns = paths.join(own, ["t", "n"]).groupBy("t", "leaf", "rank").agg(
        F.array_sort(F.collect_list(F.struct("position", "role", "text"))).alias("turns")
    )
    made = formatted(F.col("turns"))
    return turns.select(
        F.when(F.col("t") != NO_TREE, F.col("t")).alias("tree"),
        "leaf",
        "rank",
        made["text"].alias("text"),
        made["loss"].alias("loss"),
    )


def read_back(text: Column) -> Column:
    """The (role, text) of every turn of a formatted conversation."""
    turns = F.filter(F.split(text, "</turn>\n", -1), lambda x: x != "")
    return F.transform(
        turns,
        lambda x: F.struct(
            unescape(F.substring(F.substring_index(x, MIDDLE, 1), len(OPEN) + 1, 2**31 - 1)).alias("role"),
            unescape(F.substring(x, F.instr(x, MIDDLE) + 1, F.char_length(x))).alias("text"),
        ),
    )


def thread(table: DataFrame) -> DataFrame:
    """A linear conversation table as replies: each row answers the one before it by turn."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = table.select("conv_id", "turn", "role", "text").withColumn("node_id", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node_id") > 1, F.col("node_id") - 1)
    return rows.select(F.col("conv_id").alias("tree_id"), "node_id", parent.alias("parent_id"), F.lit(0.0).alias("score"), "role", "text")


def digest(table: DataFrame) -> DataFrame:
    hard = "\\### Assistant: </turn> ok"
    added = table.sparkSession.createDataFrame(
        [(-7, 0, "user", hard), (-7, 1, ASSISTANT, hard)], "conv_id long, turn long, role string, text string"
    )
    plain = table.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    made = conversations(thread(plain.unionByName(added)))
    read = made.select(
        F.col("tree").alias("conv_id"),
        read_back(F.col("text")).alias("turns"),
        F.array_join(
            F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))), ""
        ).alias("taught"),
        F.char_length("text").cast("long").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        hex_sha256(said).alias("turns_sha256"),
        F.char_length("taught").cast("long").alias("loss_chars"),
        hex_sha256(F.col("taught")).alias("loss_sha256"),
        "formatted_chars",
    )


DIGEST_SQL = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)
), e AS (
    SELECT *, length(replace(replace(replace(role, '\', '\\'), '<', '\l'), '>', '\g'))
              + length(replace(replace(replace(text, '\', '\\'), '<', '\l'), '>', '\g')) + 15 AS chars
    FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
