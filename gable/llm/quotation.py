"""Conversations from messages that quote each other.

Nested quote levels are parsed from the leading '>' signs. A message's own words are normalised and hashed as a whole
and line by line, and so is each quoted passage; hashes are joined, and a passage is linked to the message that most of
it agrees on, so trimmed quotations and answers between the lines are linked too. Messages come out without quotes,
with the message that they answer, in an order in which every answer follows what it answers.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gable.llm.common import by_group, map_arrow, written
from gable.llm.components import connected_components

_SIGNS = re.compile(r"^((?:[ \t]?>)+)[ \t]?")
#: "On ... wrote:" and its like in other languages, alone on a line above a quotation.
_WROTE = re.compile(r"^\s*(?:On|Am|Le|El|Il)\b.{0,200}(?:wrote|schrieb|écrit|escribió|scritto)\s*:\s*$", re.I)


def passages(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """A message's own words, and its quoted passages in order with their level (1: quoted once)."""
    own: list[str] = []
    quoted: list[tuple[int, list[str]]] = []
    last = 0
    for line in (text or "").split("\n"):
        m = _SIGNS.match(line)
        level = m.group(1).count(">") if m else 0
        if level:
            if last != level or not quoted:
                quoted.append((level, []))
                if own and _WROTE.match(own[-1]):
                    own.pop()
            quoted[-1][1].append(line[m.end() :])
        else:
            own.append(line)
        last = level
    return "\n".join(own).strip(), [(n, "\n".join(x)) for n, x in quoted]


def passage_hash(text: str) -> bytes | None:
    """128 bits of the words in lower case, white space and attribution lines aside; None if there are none."""
    words = " ".join(w for line in text.split("\n") if not _WROTE.match(line) for w in line.lower().split())
    return xxhash.xxh128_digest(words.encode("utf-8", "surrogatepass")) if words else None


def units(text: str) -> list[tuple[bytes, int]]:
    """Hashes of a text as a whole and of its lines, with their weight: a line counts one, the whole more than all lines."""
    whole = passage_hash(text)
    if whole is None:
        return []
    lines = [h for line in text.split("\n") if (h := passage_hash(line))]
    return [(whole, len(lines) + 1), *((h, 1) for h in dict.fromkeys(lines) if h != whole)]


#: Orders of a thread that are looked at together.
STRETCH = 1024


def latest_before(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(th, h, od, src): for each row of asked (th, h, od) the largest order of known (th, h, od) below od.

    A running maximum over stretches of orders, then over their maxima, so a thread that repeats one line for ever is no
    single task.
    """
    part = F.floor(F.col("od") / STRETCH).alias("part")
    both = known.select("th", "h", "od", F.col("od").alias("src"), part).unionByName(asked.select("th", "h", "od", F.lit(None).cast("long").alias("src"), part))
    within = Window.partitionBy("th", "h", "part").orderBy("od").rangeBetween(Window.unboundedPreceding, -1)
    inside = both.withColumn("before", F.max("src").over(within)).where("src is null").select("th", "h", "part", "od", "before")
    over = Window.partitionBy("th", "h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tops = both.groupBy("th", "h", "part").agg(F.max("src").alias("top")).withColumn("top", F.max("top").over(over)).where("top is not null")
    return inside.join(tops, ["th", "h", "part"], "left").select("th", "h", "od", F.coalesce("before", "top").alias("src")).where("src is not null").distinct()


#: Links of a component that one task ranks; larger components are ranked level by level over all tasks.
LINKS = 50_000


def levels(a: list[int], b: list[int]) -> dict[int, int]:
    """Rank of each thread of a: one more than the largest rank of those in b that it answers; 0 in a circle and behind one."""
    waits, behind = defaultdict(int), defaultdict(list)
    for x, y in zip(a, b):
        waits[x] += 1
        behind[y].append(x)
    rank, ready_ = {}, [y for y in behind if y not in waits]
    while ready_:
        after = []
        for y in ready_:
            for x in behind[y]:
                rank[x] = max(rank.get(x, 0), rank.get(y, 0) + 1)
                waits[x] -= 1
                if not waits[x]:
                    after.append(x)
        ready_ = after
    return {x: rank[x] if not n else 0 for x, n in waits.items()}


def thread_ranks(across: DataFrame, named: DataFrame, links: int = LINKS) -> DataFrame:
    """(th, thread_rank) of threads a that answer threads b: one more than the largest rank of those they answer, from 0.

    Threads that answer each other in a circle, and those that wait for one of them, have rank 0; other threads of the
    table, and of the same component, keep theirs. named: (id, component). Components of up to `links` links are ranked in a task each, however
    long their chains; in larger ones a level a round is ranked, as many rounds as there are levels.
    """
    of = written(across.join(named, F.col("a") == F.col("id")).select("component", "a", "b"))
    large = written(of.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > links).select("component"))

    def solve(table: pa.Table) -> dict[str, list]:
        got = levels(table["a"].to_pylist(), table["b"].to_pylist())
        return {"th": list(got), "thread_rank": list(got.values())}

    out = by_group(of.join(large, "component", "left_anti"), ["component"], solve, "th long, thread_rank long")
    rest = written(of.join(large, "component", "left_semi").select("a", "b"))
    if rest.isEmpty():
        return out
    asked = rest.select("a").distinct()
    done = written(rest.select(F.col("b").alias("th")).distinct().join(asked, F.col("th") == F.col("a"), "left_anti").withColumn("thread_rank", F.lit(0).cast("long")))
    new = done
    while not new.isEmpty():
        # threads all of whose answered ones have a rank, one of them since the last round
        near = rest.join(new.select(F.col("th").alias("b")), "b", "left_semi").select("a").distinct().join(done.select(F.col("th").alias("a")), "a", "left_anti")
        full = rest.join(near, "a").join(done.withColumnRenamed("th", "b"), "b", "left").groupBy(F.col("a").alias("th"))
        new = written(full.agg(F.count_if(F.col("thread_rank").isNull()).alias("open"), (F.max("thread_rank") + 1).alias("thread_rank")).where("open = 0").drop("open"))
        done = done.unionByName(new)
    ranked = asked.withColumnRenamed("a", "th").join(done, "th", "left").select("th", F.coalesce("thread_rank", F.lit(0)).cast("long").alias("thread_rank"))
    return out.unionByName(ranked)


def linked(messages: DataFrame, thread: str = "conv_id", order: str = "turn", author: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conversation_id, thread_rank, thread, order, author, text (without quotes), reply_thread, reply_order, n_quotes, n_linked.

    Of a quoted passage, the whole and each line is looked up: first the latest earlier message of its own thread that has the
    same words as a whole or as a line, else the first message of any thread (smallest thread, then order), if that is
    another thread. The passage is linked to the message that most of it agrees on; ties go to the later order
    of the own thread, then to the smallest thread. The message answered is the one that a passage of level 1 is linked to
    (the latest, if several).

    Threads joined by an answer form one conversation, named by its smallest thread. conversation_id, thread_rank, thread,
    order is an order of reading in which answers follow: a thread comes after those it answers. Threads that answer
    each other in a circle, and threads behind one, have rank 0 and stand in the order of their numbers; no other does for them.

    thread and order are integers; a message whose thread or order is null keeps its row and is not linked. Null texts
    are empty; passages of no words link with nothing; rows that repeat thread and order each keep a row. An
    empty table gives an empty one. Other columns are not read.
    """
    raw = messages.select(F.col(thread).cast("long").alias("th"), F.col(order).cast("long").alias("od"), F.col(author).cast("string").alias("au"), F.col(text).alias("_t"))
    raw = raw.withColumn("r", F.xxhash64("th", "od", "au", "_t"))

    def parsed(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [passages(t) for t in batch.column("_t").to_pylist()]
        quotes = [[{"q": k, "level": n, "hash": h, "weight": w} for k, (n, x) in enumerate(q) for h, w in units(x)] for _, q in rows]
        kind = pa.list_(pa.struct([("q", pa.int32()), ("level", pa.int32()), ("hash", pa.binary()), ("weight", pa.int32())]))
        own = [[h for h, _ in units(o)] for o, _ in rows]
        return pa.RecordBatch.from_arrays(
            [batch.column(x) for x in ("th", "od", "au", "r")] + [pa.array([o for o, _ in rows], pa.string()), pa.array(own, pa.list_(pa.binary())), pa.array(quotes, kind), pa.array([len({x["q"] for x in q}) for q in quotes], pa.int64())],
            names=["th", "od", "au", "r", "own", "has", "quotes", "n_quotes"],
        )

    rows = written(map_arrow(raw, parsed, "th long, od long, au string, r long, own string, has array<binary>, quotes array<struct<q:int,level:int,hash:binary,weight:int>>, n_quotes long"))
    placed = rows.where("th is not null and od is not null")
    asked = placed.select("th", "od", "r", F.explode("quotes").alias("x")).select("th", "od", "r", "x.q", "x.level", F.col("x.hash").alias("h"), "x.weight").distinct()
    known = placed.select("th", "od", F.explode("has").alias("h"))
    near = written(latest_before(asked.select("th", "h", "od").distinct(), known.distinct()))
    first = written(known.groupBy("h").agg(F.min(F.struct("th", "od")).alias("first")))
    found = asked.join(near.hint("merge"), ["th", "h", "od"], "left").join(first.hint("merge"), "h", "left")
    elsewhere = F.col("src").isNull() & (F.col("first.th") != F.col("th"))
    found = found.withColumn("to", F.when(F.col("src").isNotNull(), F.struct("th", F.col("src").alias("od"))).when(elsewhere, F.col("first"))).where("to is not null")
    votes = found.groupBy("th", "od", "r", "q", "level", "to").agg(F.sum("weight").alias("votes"))
    own = F.col("to.th") == F.col("th")
    best = F.max(F.struct("votes", own.alias("own"), F.when(own, F.col("to.od")).otherwise(-F.col("to.th")).alias("k"), F.when(own, F.lit(0)).otherwise(-F.col("to.od")).alias("l"), "to"))
    agreed = votes.groupBy("th", "od", "r", "q", "level").agg(best["to"].alias("to"))
    answers = written(agreed.groupBy("th", "od", "r").agg(F.count(F.lit(1)).alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("to"))).alias("to")))

    across = written(answers.where("to is not null and to.th != th").select(F.col("th").alias("a"), F.col("to.th").alias("b")).distinct())
    named = written(connected_components(across))
    ranks = thread_ranks(across, named)
    out = rows.join(answers.withColumnsRenamed({"th": "_th", "od": "_od", "r": "_r"}).hint("merge"), (F.col("r") == F.col("_r")) & (F.col("th") == F.col("_th")) & (F.col("od") == F.col("_od")), "left")
    out = out.join(named, F.col("th") == F.col("id"), "left").join(written(ranks.withColumnRenamed("th", "_rt")), F.col("th") == F.col("_rt"), "left")
    return out.select(
        F.coalesce("component", "th").alias("conversation_id"),
        F.coalesce("thread_rank", F.lit(0)).cast("long").alias("thread_rank"),
        F.col("th").alias(thread),
        F.col("od").alias(order),
        F.col("au").alias(author),
        F.col("own").alias(text),
        F.col("to.th").alias("reply_thread"),
        F.col("to.od").alias("reply_order"),
        "n_quotes",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )


def chat_lines(conversations: DataFrame, author: str = "role", text: str = "text") -> DataFrame:
    """conversations with `chat`: the message as one turn of a chat transcript; a null author is `unknown`, a null text gives null."""
    return conversations.withColumn("chat", F.concat(F.lit("<|"), F.coalesce(author, F.lit("unknown")), F.lit("|>\n"), F.col(text), F.lit("\n<|end|>\n")))


def as_mail(messages: DataFrame, thread: str = "conv_id", order: str = "turn", author: str = "role", text: str = "text") -> DataFrame:
    """messages as mail programs send them, each with a quotation of the message before (order less one).

    Orders of the form 5 k + 3 answer between the lines: the first line quoted, the first line of the answer, then the rest of
    both. Others of the form 3 k + 1 quote the first line only. All others stand below the whole message, in which
    the one before that is quoted again. A null text is empty and quotes nothing of itself; where rows repeat an order, the
    least text is quoted. Null threads and orders quote nothing. An empty table gives an empty one.
    """
    before = messages.groupBy(F.col(thread).alias("_t"), F.col(order).alias("_o")).agg(F.min(text).alias("_x"))
    quoted = lambda c, sign: F.regexp_replace(F.regexp_replace(c, "(?m)^", sign), r"\n(?!>)", "\n" + sign)
    line = lambda c: F.substring_index(c, "\n", 1)
    rest = lambda c: F.when(F.instr(c, "\n") > 0, F.substring(c, F.instr(c, "\n") + 1, F.length(c)))
    one = before.select("_t", (F.col("_o") + 1).alias("_1"), F.col("_x").alias("_x1"))
    two = before.select(F.col("_t").alias("_t2"), (F.col("_o") + 2).alias("_2"), F.col("_x").alias("_x2"))
    both = messages.join(one, (F.col(thread) == F.col("_t")) & (F.col(order) == F.col("_1")), "left").join(two, (F.col(thread) == F.col("_t2")) & (F.col(order) == F.col("_2")), "left")
    x1, x2, own = F.col("_x1"), F.col("_x2"), F.coalesce(F.col(text), F.lit(""))
    between = F.concat_ws("\n", quoted(line(x1), "> "), line(own), quoted(rest(x1), "> "), rest(own))
    trimmed = F.concat_ws("\n", quoted(line(x1), "> "), own)
    below = F.concat_ws("\n", quoted(x2, ">> "), F.when(x1.isNotNull(), F.concat(F.lit("> On an earlier day somebody wrote:\n"), quoted(x1, "> "))), own)
    body = F.when(F.col(order) % 5 == 3, between).when(F.col(order) % 3 == 1, trimmed).otherwise(below)
    return both.select(thread, order, author, body.alias(text))
