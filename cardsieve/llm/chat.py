"""Reply trees as chat text: root-to-leaf paths, ranked, each formatted as a conversation.

Messages point at the message they answer. Self-joins that double their reach enumerate
the paths: after k rounds a message knows its ancestor 2**k steps up and the score summed
on the way, so a thread of a million turns takes twenty rounds and no path is carried as a
list. Leaves are ranked by the score of their path, and the chosen ones mark their ancestors
by the same jumps.

Formatted text is written one row per turn, so no conversation has to fit into a row; in
order, the rows of a conversation are its text. Control strings inside texts get a
backslash, which reading takes away again.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardsieve.llm.common import by_value, input_parts, keep, with_dense_index
from cardsieve.llm.components import component_labels

by_value(__name__)

START, END = "<|im_start|>", "<|im_end|>"


def chain_replies(rows: DataFrame) -> DataFrame:
    """(conv_id, msg_id, parent_id, role, text, score) of linear conversations.

    Each row answers the one before it by turn; equal turns are ordered by role and text,
    and repeated rows are turns of their own. A null conv_id is a conversation too. Null
    roles and texts are empty. All scores are 0.
    """
    rows = rows.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    rows = with_dense_index(rows, order, "msg_id", input_parts(rows.sparkSession))
    # The index is dense and follows the order, so a conversation begins at its least one.
    first = rows.groupBy("conv_id").agg(F.min("msg_id").alias("first"))
    first = first.withColumnRenamed("conv_id", "of")
    linked = rows.join(first, F.col("conv_id").eqNullSafe(F.col("of")))
    return linked.select(
        "conv_id",
        "msg_id",
        F.when(F.col("msg_id") > F.col("first"), F.col("msg_id") - 1).alias("parent_id"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


def one_row_a_message(messages: DataFrame) -> DataFrame:
    """The columns of a message, one row for each msg_id: repeated rows are one, of unlike ones
    the least by its columns stays. Rows without msg_id and other columns go."""
    known = ("conv_id", "parent_id", "role", "text", "score")
    others = [c for c in known if c in messages.columns]
    found = messages.where("msg_id IS NOT NULL").groupBy("msg_id")
    return found.agg(F.min(F.struct(*others)).alias("row")).select("msg_id", "row.*")


def _circle_heads(jump: DataFrame, first: DataFrame) -> DataFrame:
    """(msg_id) of the least message of each circle, from jumps longer than any way to a root:
    they end on circles only, and on every message of those."""
    on = jump.where("up IS NOT NULL").select(F.col("up").alias("msg_id")).distinct()
    edges = first.join(on, "msg_id").select(F.col("msg_id").alias("a"), F.col("up").alias("b"))
    labels = component_labels(edges).withColumnRenamed("node", "msg_id")
    # A message that answers itself is a circle of its own and has no label.
    return on.join(labels, "msg_id", "left").where("label IS NULL OR label = msg_id").select("msg_id")


def best_paths(messages: DataFrame, paths: int = 1, unique: bool = False) -> DataFrame:
    """The messages of each conversation's `paths` best root-to-leaf paths.

    Adds path (1 is best) and place (0 is the root). A path's score is the sum of its
    messages' scores; equal scores are ordered by the leaf's msg_id, null scores count 0. A
    message whose parent is not there is a root of its own. Where messages answer each other
    in a circle, the least msg_id of the circle is its root. Unless `unique` says that every
    msg_id stands in one row, `one_row_a_message` comes first.
    """
    if not unique:
        messages = keep(one_row_a_message(messages), "messages")
    score = F.coalesce("score", F.lit(0.0)).alias("score")
    nodes = messages.select("conv_id", "msg_id", "parent_id", score)
    found = _jumps(nodes)
    if found[-1].where("up IS NOT NULL").isEmpty():
        return _chosen(messages, found, paths)
    heads = keep(_circle_heads(found[-1], found[0]), "heads").withColumn("head", F.lit(True))
    parent = F.when(F.col("head").isNull(), F.col("parent_id")).alias("parent_id")
    opened = nodes.join(heads, "msg_id", "left").select("conv_id", "msg_id", parent, "score")
    return _chosen(messages, _jumps(opened), paths)


def _jumps(nodes: DataFrame) -> list[DataFrame]:
    """(conv_id, msg_id, up, place, score, above): each message's ancestor 1, 2, 4, ... steps
    up, until no way to a root can be longer."""
    known = nodes.select(F.col("msg_id").alias("up"), F.lit(True).alias("there"))
    jump = nodes.join(known, nodes["parent_id"] == known["up"], "left").select(
        "conv_id",
        "msg_id",
        F.when(F.col("there"), F.col("parent_id")).alias("up"),
        F.when(F.col("there"), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("place"),
        "score",
        F.lit(0.0).alias("above"),
    )
    levels = [keep(jump, "jump")]
    rounds = levels[0].count().bit_length()
    while len(levels) <= rounds and not levels[-1].where("up IS NOT NULL").isEmpty():
        one = levels[-1]
        two = one.select(
            F.col("msg_id").alias("mid"),
            F.col("up").alias("next"),
            F.col("place").alias("more"),
            F.expr("score + above").alias("sum"),
        )
        levels.append(
            keep(
                one.join(two, one["up"] == two["mid"], "left").select(
                    "conv_id",
                    "msg_id",
                    F.col("next").alias("up"),
                    (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"),
                    "score",
                    (F.col("above") + F.coalesce("sum", F.lit(0.0))).alias("above"),
                ),
                "jump",
            )
        )
    return levels


def _chosen(messages: DataFrame, levels: list[DataFrame], paths: int) -> DataFrame:
    """The messages on the way from the best leaves to their roots."""
    done = levels[-1]
    parents = levels[0].where("up IS NOT NULL").select(F.col("up").alias("msg_id"))
    leaves = done.join(parents, "msg_id", "left_anti").withColumn(
        "total", F.expr("score + above")
    )
    if paths == 1:
        ranked = F.struct((-F.col("total")).alias("worse"), F.col("msg_id").alias("leaf"))
        chosen = leaves.groupBy("conv_id").agg(F.min(ranked).alias("best")).select(
            F.col("best.leaf").alias("msg_id"), F.lit(1).alias("path")
        )
    else:
        # Spark keeps the first `paths` of a conversation in each task before the shuffle.
        best = Window.partitionBy("conv_id").orderBy(F.col("total").desc(), "msg_id")
        chosen = leaves.select("msg_id", F.row_number().over(best).alias("path")).where(
            F.col("path") <= paths
        )
    chosen = keep(chosen, "chosen")
    for level in reversed(levels[:-1]):
        up = level.where("up IS NOT NULL").select("msg_id", "up")
        reached = chosen.join(up, "msg_id").select(F.col("up").alias("msg_id"), "path")
        chosen = keep(chosen.union(reached).distinct(), "chosen")
    places = done.select("msg_id", "place")
    return messages.join(chosen, "msg_id").join(places, "msg_id")


def escape(text: Column) -> Column:
    """One backslash more behind each `<` that starts a control string, escaped or not."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles stand on one line: backslashes and line feeds are escaped as well."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def format_paths(paths: DataFrame) -> DataFrame:
    """(conv_id, path, place, formatted, loss_from, loss_to): one row per turn.

    The loss mask covers the text of assistant turns, from loss_from up to loss_to in code
    points of the row; both are 0 elsewhere.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    learned = F.col("role") == "assistant"
    return paths.select(
        "conv_id",
        "path",
        "place",
        F.concat(head, body, F.lit(f"{END}\n")).alias("formatted"),
        F.when(learned, F.length(head)).otherwise(F.lit(0)).alias("loss_from"),
        F.when(learned, F.length(head) + F.length(body)).otherwise(F.lit(0)).alias("loss_to"),
    )


def parse_formatted(rows: DataFrame) -> DataFrame:
    """role, text and loss_text (null outside the mask) of formatted rows."""
    inner = F.expr(f"substring(formatted, {len(START) + 1}, length(formatted) - {len(START + END) + 1})")
    text = F.expr("substring(inner, length(split_part(inner, '\n', 1)) + 2)")
    # Split at escaped backslashes first, so that the rest holds only escaped line feeds.
    role = F.expr(
        r"array_join(transform(split(found, '\\\\\\\\', -1), p -> replace(p, '\\n', '\n')), '\\')"
    )
    masked = F.expr("substring(formatted, loss_from + 1, loss_to - loss_from)")
    return (
        rows.withColumn("inner", inner)
        .withColumn("found", unescape(F.substring_index("inner", "\n", 1)))
        .select(
            "conv_id",
            "path",
            "place",
            role.alias("role"),
            unescape(text).alias("text"),
            F.when(F.col("loss_to") > 0, unescape(masked)).alias("loss_text"),
            F.length("formatted").cast("long").alias("chars"),
        )
    )


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Per path: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest reads its input in order, so each conversation is one sorted run of rows; they
    stream through with a fixed amount of memory, however long it is.
    """
    names = ["conv_id", "path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def work(batches):
        key, state, done = None, None, []

        def close():
            if state is not None:
                n, turns, chars, loss, total = state
                done.append((*key, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*done), kinds)], names
            )
            done.clear()
            return out

        for batch in batches:
            for conv, path, role, text, learned, chars in zip(
                *(batch[c].to_pylist() for c in ("conv_id", "path", "role", "text", "loss_text", "chars"))
            ):
                if state is None or (conv, path) != key:
                    close()
                    key, state = (conv, path), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if learned is not None:
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += chars
            if done:
                yield flush()
        close()
        if done:
            yield flush()

    parts = input_parts(turns.sparkSession)
    return (
        turns.repartition(parts, "conv_id", "path")
        .sortWithinPartitions("conv_id", "path", "place")
        .withColumn("path", F.col("path").cast("long"))
        .mapInArrow(
            work,
            "conv_id long, path long, n_turns long, turns_sha256 string, loss_chars long,"
            " loss_sha256 string, formatted_chars long",
        )
    )
