"""Reply trees to conversations in a chat template. DataFrame functions only.

Messages name their parent. Root-to-leaf paths come from iterated self-joins: unbranched runs are drawn together by
doubling pointers, then each round joins the paths' ends with the runs that reply, until none has any. Paths are ranked by score within their tree, and each chosen path becomes one text in the
template, with the spans that count for the loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almoneda.llm.shared import discard, free_name, materialize

#: The template's marks, and other control strings that must not occur in a text. Fixed values.
BEGIN, END = "<|im_start|>", "<|im_end|>"
CONTROL = (BEGIN, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    """Text without control strings: a backslash is doubled, and one is put after the first character of each."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _chains(nodes: DataFrame) -> DataFrame:
    """(tree, msg, head, dist): the first message of the unbranched run that a message is in, and its place there.

    nodes: (tree, msg, up), up the parent that has no other reply, else null. Pointers are doubled: each self-join makes
    them twice as long, so a run of n messages takes log n joins. Messages on a cycle reach no head and are left out.
    """
    heads = nodes.filter("up IS NULL").select("tree", "msg", F.col("msg").alias("up"), F.lit(0).cast("long").alias("dist"))
    table = materialize(heads.select("*", F.lit(True).alias("done")).unionByName(nodes.filter("up IS NOT NULL").select("tree", "msg", "up", F.lit(1).cast("long").alias("dist"), F.lit(False).alias("done"))), "chains")
    left = table.filter("NOT done").count()
    while left:
        to = table.select(F.col("tree").alias("t"), F.col("msg").alias("m"), F.col("up").alias("up2"), F.col("dist").alias("d2"), F.col("done").alias("done2"))
        active = table.filter("NOT done").join(to, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("m"))).select("tree", "msg", F.col("up2").alias("up"), (F.col("dist") + F.col("d2")).alias("dist"), F.col("done2").alias("done"))
        table = materialize(table.filter("done").unionByName(active), "chains")
        now = table.filter("NOT done").count()
        if now == left:  # only cycles are left
            break
        left = now
    return table.filter("done").select("tree", "msg", F.col("up").alias("head"), "dist")


def reply_paths(messages: DataFrame) -> DataFrame:
    """(tree, path, score): every root-to-leaf path, `path` an array of (msg, role, text) from the root.

    messages: (tree, msg, parent, role, text, score). A root has a null parent, or one that its tree lacks. A path's
    score is the sum of its messages' scores, null as 0. Null roles and texts are empty.

    Unbranched runs of messages are first drawn together, so the joins that extend paths are as many as a path has
    branchings, however long it is; they carry ids only, and texts are joined to the finished paths.

    Messages on a cycle hang on no root and are left out. Rows that repeat a message's id count once: least parent,
    role and text, greatest score. An empty table gives an empty table.
    """
    m = messages.filter("msg IS NOT NULL").groupBy("tree", "msg").agg(F.min("parent").alias("parent"), F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("said"), F.max(F.coalesce("score", F.lit(0.0)).cast("double")).alias("score"))
    m = materialize(m, "messages")
    replies = m.filter("parent IS NOT NULL").groupBy("tree", "parent").agg(F.count("*").alias("replies"))
    known = m.select(F.col("tree").alias("t"), F.col("msg").alias("p")).join(replies.withColumnsRenamed({"tree": "rt", "parent": "rp"}), F.col("t").eqNullSafe(F.col("rt")) & (F.col("p") == F.col("rp"))).select("t", "p", "replies")
    nodes = m.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p")), "left").select("tree", "msg", F.col("p").alias("parent"), F.when(F.col("replies") == 1, F.col("p")).alias("up"), "score")
    nodes = materialize(nodes, "nodes")
    chains = materialize(_chains(nodes.select("tree", "msg", "up")), "placed")
    placed = chains.withColumnsRenamed({"tree": "ct", "msg": "cm"})
    inside = nodes.join(placed, F.col("tree").eqNullSafe(F.col("ct")) & (F.col("msg") == F.col("cm")))
    sums = inside.groupBy("tree", "head").agg(F.sum("score").alias("score"), F.max(F.when(F.col("dist") == 0, F.col("parent"))).alias("above"))
    above = placed.select(F.col("ct").alias("at"), F.col("cm").alias("am"), F.col("head").alias("parent_head"))
    runs = sums.join(above, F.col("tree").eqNullSafe(F.col("at")) & (F.col("above") == F.col("am")), "left").select("tree", "head", "score", "above", "parent_head")
    runs = materialize(runs, "runs")
    edge = runs.filter("parent_head IS NOT NULL").select(F.col("tree").alias("t"), F.col("head").alias("child"), F.col("parent_head").alias("p"), F.col("score").alias("s"))
    branching = edge.select(F.col("t").alias("bt"), F.col("p").alias("bp"), F.lit(True).alias("more")).distinct()
    at = F.col("tree").eqNullSafe(F.col("bt")) & (F.col("last") == F.col("bp"))

    def round_of(front: DataFrame) -> DataFrame:
        """The paths (tree, ids, last, score), written, and whether more replies follow."""
        return materialize(front.join(branching, at, "left").select("tree", "ids", "last", "score", F.coalesce("more", F.lit(False)).alias("more")), "front")

    rounds = [round_of(runs.filter("above IS NULL").select("tree", F.array("head").alias("ids"), F.col("head").alias("last"), "score"))]
    while not (front := rounds[-1].filter("more")).isEmpty():
        grown = front.drop("more").join(edge, F.col("tree").eqNullSafe(F.col("t")) & (F.col("last") == F.col("p")))
        rounds.append(round_of(grown.select("tree", F.concat("ids", F.array("child")).alias("ids"), F.col("child").alias("last"), (F.col("score") + F.col("s")).alias("score"))))
    # One read of all rounds' tables, so the plan doesn't grow with them.
    done = messages.sparkSession.read.schema(rounds[0].schema).parquet(*[r._table_path for r in rounds]).filter("NOT more")
    paths = materialize(done.select("tree", "ids", "score", F.monotonically_increasing_id().alias("path_id")), "paths")
    discard(*rounds)
    flat = paths.select("path_id", "tree", "score", F.posexplode("ids").alias("pos", "run"))
    said = m.select(F.col("tree").alias("mt"), F.col("msg").alias("mm"), "said").join(placed, F.col("mt").eqNullSafe(F.col("ct")) & (F.col("mm") == F.col("cm"))).select("mt", F.col("mm").cast("long").alias("msg"), "head", "dist", "said.role", "said.text")
    joined = flat.join(said, F.col("tree").eqNullSafe(F.col("mt")) & (F.col("run") == F.col("head")))
    path = F.transform(F.sort_array(F.collect_list(F.struct("pos", "dist", "msg", "role", "text"))), lambda x: F.struct(x["msg"].alias("msg"), x["role"].alias("role"), x["text"].alias("text")))
    return joined.groupBy("path_id", "tree", "score").agg(path.alias("path")).select("tree", "path", "score")


def chosen_paths(paths: DataFrame, best: int = 1) -> DataFrame:
    """The `best` paths of each tree by score, with their rank from 1; ties by the messages' ids."""
    order = Window.partitionBy("tree").orderBy(F.desc("score"), F.transform("path", lambda x: x["msg"]))
    return paths.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


def format_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    """paths with `formatted` and `loss_spans`, an array of (start, end) code points that hold the assistant's texts.

    A turn is BEGIN role newline text END newline, role and text escaped, in roles newlines too. An empty path formats as
    empty text.
    """
    formatted, spans = free_name(paths.columns, "formatted"), free_name(paths.columns, "loss_spans")
    turn = F.transform(path, lambda x: F.struct(x["role"].alias("role"), F.replace(escape(x["role"]), F.lit("\n"), F.lit("\\\n")).alias("r"), escape(x["text"]).alias("t")))
    begin, end = len(BEGIN), len(END) + 1
    text = F.array_join(F.transform(turn, lambda x: F.concat(F.lit(BEGIN), x["r"], F.lit("\n"), x["t"], F.lit(END + "\n"))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + begin + F.length(x["r"]) + 1
        last = first + F.length(x["t"])
        return F.struct((last + end).alias("at"), F.when(x["role"] == "assistant", F.concat(acc["out"], F.array(F.struct(first.alias("start"), last.alias("end"))))).otherwise(acc["out"]).alias("out"))

    return paths.withColumn(formatted, text).withColumn(spans, F.aggregate(turn, start, step, lambda a: a["out"]))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    turns = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")
    body = lambda x: F.substring(x, F.lit(1), F.length(x) - len(END) - 1)
    role = lambda x: F.regexp_extract(x, r"^[^\\\n]*+(?:\\[\s\S][^\\\n]*+)*+", 0)
    cut = lambda x: F.struct(role(x).alias("role"), x.alias("whole"))
    return F.transform(F.transform(F.transform(turns, body), cut), lambda x: F.struct(unescape(x["role"]).alias("role"), unescape(F.substring(x["whole"], F.length(x["role"]) + 2, F.length(x["whole"]))).alias("text")))


def as_trees(conversations: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each turn replies to the one before.

    Rows of one turn follow each other in order of role and text; a null turn comes first.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    msg = F.row_number().over(order).cast("long")
    ranked = conversations.select("conv_id", "role", "text", msg.alias("msg"))
    return ranked.select(F.col("conv_id").alias("tree"), "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back from the output."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = format_paths(chosen_paths(reply_paths(as_trees(rows.unionByName(extra)))))
    lost = F.transform("loss_spans", lambda s: F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))
    out = out.select(F.col("tree").alias("conv_id"), "formatted", read_back(F.col("formatted")).alias("turns"), F.array_join(F.transform(lost, unescape), "").alias("loss"))
    dump = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(dump.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _oracle() -> str:
    def sql(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def escaped(x: str) -> str:
        x = f"replace({x}, {sql(chr(92))}, {sql(chr(92) * 2)})"
        for c in CONTROL:
            x = f"replace({x}, {sql(c)}, {sql(c[0] + chr(92) + c[1:])})"
        return x

    said = "</s>[INST] ok [/INST]"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {sql(said)} UNION ALL SELECT -1, 1, 'assistant', {sql(said)}),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    CAST(sum({len(BEGIN) + len(END) + 2} + length({escaped("role")}) + length({escaped("text")})) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a
"""


ORACLE_SQL = _oracle()
