"""Quotation linking of chats.

Lines that begin with '>' marks are quotes, nested as deep as they have marks. Lines of one depth in a row form a
passage. Passages and their lines are normalised (blanks folded, lower case) and hashed. The first message of the
conversation that holds such a passage or line unquoted is the original. A message answers the original of its
outermost quotes that have one, however deep they are: whole passages count before lines, longer ones before shorter, later
originals before earlier.
A message without a linked quote begins a thread. Conversations are ordered by thread, then by turn.
Null texts count as empty; rows with a null conversation or turn come back unlinked, with null positions; repeated rows
stay and share links, and get positions of their own in the order of role and text.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

QUOTED = re.compile(r"[ \t]*((?:>[ \t]*)+)(.*)", re.S)
SAID = re.compile(r"\s*(?:On|Am|Le|El)\b.{0,200}:\s*$")
#: Threads and turns are numbered in blocks of so many, so that no task orders a whole conversation.
BLOCK = 4096


def key(text: str) -> int | None:
    text = " ".join(text.split()).lower()
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True) if text else None


def parse(text: str | None) -> tuple[str, list[int], list[dict]]:
    """The text without quotes, the keys of its own passages and lines, and its quotes (depth, key, lines, whole)."""
    rows = []
    for line in (text or "").split("\n"):
        m = QUOTED.fullmatch(line)
        rows.append((m[1].count(">"), m[2]) if m else (0, line))
    rows = [r for i, r in enumerate(rows) if not (r[0] == 0 and i + 1 < len(rows) and rows[i + 1][0] and SAID.match(r[1]))]
    own, quotes, i = set(), [], 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j][0] == rows[i][0]:
            j += 1
        depth, block = rows[i][0], [x for _, x in rows[i:j]]
        keys = [key(" ".join(block)), *map(key, block)]
        if depth:
            quotes += [{"depth": depth, "key": k, "lines": len(block) if n == 0 else 1, "whole": int(n == 0)} for n, k in enumerate(keys) if k is not None]
        else:
            own |= {k for k in keys if k is not None}
        i = j
    kept = [x for d, x in rows if d == 0]
    if own:
        own |= {k for k in [key(" ".join(kept))] if k is not None}
    return ("\n".join(kept).strip("\n") if quotes else text or ""), sorted(own), quotes


def parsed(messages: DataFrame) -> DataFrame:
    @F.pandas_udf("own string, keys array<long>, quotes array<struct<depth:int,key:long,lines:int,whole:int>>")
    def split(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(t) for t in text], columns=["own", "keys", "quotes"])

    return messages.withColumn("p", split.asNondeterministic()("text")).select("conv_id", "turn", "role", "p.*")


def quote_links(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, depth, key, lines, whole, original): each quote that an earlier message of the conversation holds.

    Originals are aggregated to one row for each passage first, so that a line thousands of messages share joins once.
    """
    quotes = rows.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*")
    asked = quotes.select("conv_id", "key").distinct()
    first = rows.select("conv_id", "turn", F.explode("keys").alias("key")).groupBy("conv_id", "key").agg(F.min("turn").alias("original")).join(asked, ["conv_id", "key"], "left_semi")
    return quotes.join(first, ["conv_id", "key"]).where(F.col("original") < F.col("turn"))


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, text without quotes, n_quotes, parent_turn, thread_turn, depth, position."""
    rows = written(parsed(messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))), "messages")
    best = quote_links(rows).groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("depth")).alias("outer"), "whole", "lines", "original")).alias("b"))
    links = written(best.select("conv_id", "turn", F.col("b.original").alias("parent_turn"), F.col("b.original").alias("top"), F.lit(1).alias("depth")), "links")
    while True:  # each round doubles the length of the chains that are followed
        up = links.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"))
        step = links.join(up, ["conv_id", "top"], "left")
        moved = step.select("conv_id", "turn", "parent_turn", F.coalesce("next", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved"))
        moved = written(moved, "links")
        links = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    out = rows.join(links, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", F.col("own").alias("text"), F.size("quotes").cast("long").alias("n_quotes"), "parent_turn", F.coalesce("top", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))
    return positions(out)


def positions(rows: DataFrame) -> DataFrame:
    """Add `position`, the message's place in its conversation by thread and turn, from sums over blocks of each."""
    rows = rows.withColumn("a", F.floor(F.col("thread_turn") / BLOCK)).withColumn("b", F.floor(F.col("turn") / BLOCK))
    small = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "a", "thread_turn", "b").agg(F.count("*").alias("n"))
    large = small.groupBy("conv_id", "a").agg(F.sum("n").alias("n"))
    before = lambda keys, order: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    large = large.withColumn("large", before(["conv_id"], ["a"])).drop("n")
    small = small.withColumn("small", before(["conv_id", "a"], ["thread_turn", "b"])).drop("n")
    starts = small.join(large, ["conv_id", "a"]).withColumn("start", F.col("small") + F.col("large")).drop("small", "large")
    apart = F.when(F.col("conv_id").isNull() | F.col("turn").isNull(), F.monotonically_increasing_id()).otherwise(0)  # these get no position
    at = F.row_number().over(Window.partitionBy("conv_id", "a", "thread_turn", "b", apart).orderBy("turn", "role", "text"))
    return rows.withColumn("at", at).join(starts, ["conv_id", "a", "thread_turn", "b"], "left").select("conv_id", "turn", "role", "text", "n_quotes", "parent_turn", "thread_turn", "depth", (F.col("start") + F.col("at") - 1).cast("long").alias("position"))


def conversations(linked: DataFrame) -> DataFrame:
    """One row per conversation: its messages in reply order. The messages of one conversation meet in one row, so this is for
    conversations of ordinary length; link_quotes() alone serves any."""
    return linked.where("position IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", "role", "text"))).alias("m")).select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("messages"))
