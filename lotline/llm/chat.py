"""Chat formatting of reply trees by iterative self-joins."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written

#: The marks of the template.
START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """Text without control strings: a backslash is doubled and one is put inside each "<|".

    unescaped() undoes it.
    """
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL)


def header(role: Column) -> Column:
    """What stands before a turn's text; the role's line ends are escaped too."""
    return F.concat(F.lit(START), F.replace(escaped(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"))


def piece(role: Column, text: Column) -> Column:
    """One turn in the template."""
    return F.concat(header(role), escaped(text), F.lit(END + "\n"))


class Parser:
    """Reads turns back from a conversation's text, which may come in parts cut anywhere.

    turn(role, text) is called for each turn. Only marks end a turn, so texts may
    hold what they like as long as it is escaped; text that the template can't
    have written raises.
    """

    def __init__(self, turn):
        self.turn, self.rest, self.role, self.parts = turn, "", None, []

    def feed(self, more: str) -> None:
        self.rest += more
        while True:
            if self.role is None:
                if not self.rest.startswith(START[: len(self.rest)]):
                    raise ValueError("a turn must begin with its mark")
                name, found, after = self.rest[len(START) :].partition("\n")
                if not found:
                    return
                self.role, self.rest = unescaped(name), after
            at = self.rest.find("<|")
            if at < 0 or not self.rest.startswith((END + "\n")[: len(self.rest) - at], at):
                if at >= 0:
                    raise ValueError("a control string stands in a text")
                # an escape or the beginning of a mark may be cut
                keep = len(self.rest) - (self.rest.endswith("<") or (len(self.rest) - len(self.rest.rstrip("\\"))) % 2)
                self.parts.append(unescaped(self.rest[:keep]))
                self.rest = self.rest[keep:]
                return
            if len(self.rest) - at < len(END) + 1:
                return
            self.turn(self.role, "".join([*self.parts, unescaped(self.rest[:at])]))
            self.rest, self.role, self.parts = self.rest[at + len(END) + 1 :], None, []

    def close(self) -> None:
        if self.rest or self.role is not None:
            raise ValueError("the last turn has no end")


def branches(nodes: DataFrame, best: int = 1) -> DataFrame:
    """Root-to-leaf paths of reply trees, the best by score.

    nodes: tree, node, parent (null: a root), score; node ids are unique in a
    tree. Self-joins double the distance to the ancestor that each node knows,
    adding up scores, so a path of n turns takes log2(n) + 1 rounds. The leaves
    are ranked in their tree by mean score of the path, then node id. Going back
    from the longest jumps, each chosen path is then enumerated, each distance
    once. Nodes whose parent is missing count as roots; nodes under a cycle have
    no root and are on no path. Returns tree, leaf, rank, depth (0 at the root)
    and node.
    """
    ids = nodes.select("tree", "node")
    known = ids.withColumnRenamed("node", "parent").withColumn("there", F.lit(True))
    state = nodes.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("sum"), F.lit(1).cast("long").alias("n"))
    jumps = [written(state, "chat-jump")]
    most = jumps[0].count()
    while 2 ** (len(jumps) - 1) <= most and not jumps[-1].where("up is not null").isEmpty():
        now = jumps[-1]
        far = now.select(F.col("tree"), F.col("node").alias("up"), F.col("up").alias("up2"), F.col("sum").alias("sum2"), F.col("n").alias("n2"))
        going = now.where("up is not null").join(far, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("sum") + F.col("sum2")).alias("sum"), (F.col("n") + F.col("n2")).alias("n"))
        jumps.append(written(going.unionByName(now.where("up is null")), "chat-jump"))
    done = jumps[-1].where("up is null")
    inner = jumps[0].where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = done.join(inner, ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("sum") / F.col("n")), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    path = written(chosen.select("tree", F.col("node").alias("leaf"), "rank", "node", (F.col("n") - 1).alias("depth")), "chat-path")
    for i in reversed(range(len(jumps) - 1)):
        # up of jump table i is the ancestor 2**i above, where there is one
        step = jumps[i].where("up is not null").select("tree", "node", "up")
        more = path.join(step, ["tree", "node"]).select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("depth") - 2**i).alias("depth"))
        longer = written(path.unionByName(more), "chat-path")
        forget(path)
        path = longer
    return path


def format_paths(nodes: DataFrame, best: int = 1, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Each chosen path as one conversation, in parts.

    nodes: tree, node, parent, score, role, text. Returns tree, rank, depth, role,
    piece, and the loss mask: loss_from and loss_to, the code points of piece (end
    exclusive) that are learned, null where none is. A conversation's text is its
    pieces joined by depth; a part for each turn keeps memory bounded however long
    a conversation is. conversations() joins them.
    """
    path = branches(nodes.select("tree", "node", "parent", "score"), best)
    told = path.join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    before = F.length(header(F.col("role"))).cast("long")
    mask = F.col("role").isin(*learn)
    return told.select("tree", "rank", "depth", "role", piece(F.col("role"), F.col("text")).alias("piece"), F.when(mask, before).alias("loss_from"), F.when(mask, before + F.length(escaped(F.col("text")))).alias("loss_to"))


def conversations(formatted: DataFrame) -> DataFrame:
    """(tree, rank, text, mask): whole conversations, each with its learned spans (code points, end exclusive) as an array.

    A conversation must fit a row; digests() reads longer ones from their parts.
    """
    parts = F.array_sort(F.collect_list(F.struct("depth", "piece", "loss_from", "loss_to")))
    rows = formatted.groupBy("tree", "rank").agg(parts.alias("parts"))
    zero = F.lit(0).cast("long")
    ends = F.aggregate("parts", F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x["piece"]))))
    spans = F.transform("parts", lambda x, i: F.struct((F.get("ends", i) + x["loss_from"]).alias("from"), (F.get("ends", i) + x["loss_to"]).alias("to")))
    return rows.withColumn("ends", ends).select("tree", "rank", F.array_join(F.transform("parts", lambda x: x["piece"]), "").alias("text"), F.filter(spans, lambda m: m["from"].isNotNull()).alias("mask"))


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations, in one ordered pass.

    A conversation's parts are sorted into one task, which joins them as they
    come: turns are found by parsing the marks of the running text, the learned
    text by its mask, and both are unescaped. A turn at a time is in memory.
    """

    def read(batches):
        now = None
        for batch in batches:
            rows = []
            for tree, rank, text, a, b in zip(*(batch[c] for c in ("tree", "rank", "piece", "loss_from", "loss_to"))):
                if now is None or now.id != (tree, rank):
                    if now:
                        rows.append(now.closed())
                    now = Reading((tree, rank))
                now.add(text, a, b)
            yield frame(rows)
        if now:
            yield frame([now.closed()])

    def frame(rows):
        return pd.DataFrame(rows, columns=["tree", "rank", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    ordered = formatted.select("tree", "rank", "depth", "piece", "loss_from", "loss_to").repartition("tree", "rank").sortWithinPartitions("tree", "rank", "depth")
    return ordered.mapInPandas(read, "tree string, rank int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


class Reading:
    """Counts and digests of one conversation that is read part by part."""

    def __init__(self, id):
        self.id, self.n, self.chars, self.loss_n = id, 0, 0, 0
        self.turns, self.loss, self.parser = hashlib.sha256(), hashlib.sha256(), Parser(self.turn)

    def turn(self, role: str, text: str) -> None:
        self.n += 1
        self.turns.update(f"{role}\n{text}\n".encode())

    def add(self, text: str, a, b) -> None:
        self.chars += len(text)
        self.parser.feed(text)
        if a == a and a is not None:
            learned = unescaped(text[int(a) : int(b)])
            self.loss.update(learned.encode())
            self.loss_n += len(learned)

    def closed(self) -> tuple:
        self.parser.close()
        return (*self.id, self.n, self.turns.hexdigest(), self.loss_n, self.loss.hexdigest(), self.chars)


def as_chains(conversations: DataFrame) -> DataFrame:
    """Conversations by turn as trees with one branch; repeated turns follow each other by role and text.

    The tree is conv_id as text; rows without conv_id belong to one tree named
    "". Nodes are numbered inside their conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), F.row_number().over(order).cast("long").alias("node"), "role", "text")
    return rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))
