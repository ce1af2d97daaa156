"""Chat formatting by quotation linking. DataFrame functions only: no Python on the executors.

A line's quote level is the number of ``>`` it begins with (white space between them). A passage is
a run of consecutive lines of one level without blank lines, joined by spaces, lower-cased, with
white space collapsed. A quoted passage (level 1 or more) is joined by its hash to the message of
the same conversation that said it first, at level 0 and in an earlier turn. A message replies to
the one from which its least nested linked passages take the most characters, the latest in a tie.

A message that quotes nothing known begins a thread. Conversations are ordered by the turn of the
thread's first message, then by turn, so a reply follows what it replies to. Texts lose their
quoted lines and get a role header. Ranks come from a scan over ranges, threads from pointer
doubling, and originals from a pre-aggregated minimum: no conversation is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import materialise, prefix_scan

QUOTE = r"^(\s*>)+"
END = "<|end|>\n"


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def own_text(text: Column) -> Column:
    """The text without its quoted lines, and without white space at its ends; empty for NULL."""
    own = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: ~x.rlike(QUOTE))
    return stripped(F.array_join(own, "\n"))


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, size, hash): the passages of each message."""
    keyed = messages.where("text is not null").select("conv_id", "turn", "text").distinct()
    lines = keyed.select("conv_id", "turn", F.md5("text").alias("m"), F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    lines = lines.withColumn("level", F.length(F.regexp_replace(F.regexp_extract("line", QUOTE, 0), "[^>]", "")))
    lines = lines.withColumn("body", stripped(F.regexp_replace("line", QUOTE, "")))
    of = Window.partitionBy("conv_id", "turn", "m").orderBy("i")
    same = (F.lag("level").over(of) == F.col("level")) & (F.lag("body").over(of) != "") & (F.col("body") != "")
    lines = lines.withColumn("fresh", F.when(same, 0).otherwise(1))
    lines = lines.withColumn("run", F.sum("fresh").over(of)).where("body <> ''")
    runs = lines.groupBy("conv_id", "turn", "m", "run", "level").agg(F.sort_array(F.collect_list(F.struct("i", "body"))).alias("b"))
    body = F.lower(F.regexp_replace(F.array_join("b.body", " "), r"\s+", " "))
    return runs.select("conv_id", "turn", "level", F.length(body).alias("size"), F.md5(body).alias("hash"))


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent): which earlier turn a turn replies to, for turns with a linked quote."""
    made = passages(messages).where("conv_id is not null and turn is not null")
    first = made.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    quoted = made.where("level > 0").groupBy("conv_id", "turn", "level", "hash").agg(F.sum("size").alias("size"))
    hit = quoted.join(first, ["conv_id", "hash"]).where("origin < turn")
    hit = hit.groupBy("conv_id", "turn", "origin", "level").agg(F.sum("size").alias("size"))
    best = F.min(F.struct("level", (-F.col("size")).alias("s"), (-F.col("origin")).alias("o")))
    return hit.groupBy("conv_id", "turn").agg((-best["o"]).alias("parent"))


def threads(linked: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, thread_turn, depth): linked turns with the first turn of their thread."""
    now = linked.select("conv_id", "turn", "parent", F.col("parent").alias("thread_turn"), F.lit(1).alias("depth"))
    now = materialise(now, "threads")
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("t"), F.col("depth").alias("d"))
        both = now.join(up, ["conv_id", "thread_turn"], "left")
        if both.where("t is not null").isEmpty():
            return now
        now = materialise(
            both.select(
                "conv_id", "turn", "parent", F.coalesce("t", "thread_turn").alias("thread_turn"),
                (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"),
            ),
            "threads",
        )


def conversations(messages: DataFrame) -> DataFrame:
    """One row a message (conv_id, turn, role, text), in the order of replies.

    (conv_id, position, turn, role, parent_turn, thread_turn, depth, n_quoted, body, formatted).
    position counts from 1 in each conversation. NULL texts are empty, NULL roles are ``user``.
    Messages without conv_id form one conversation; those without turn come first in theirs and
    link to nothing. Repeated messages keep their rows; those with one (conv_id, turn) share links.
    """
    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    linked = threads(links(rows))
    quoted = F.size(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(QUOTE)))
    made = rows.join(linked, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.col("parent").alias("parent_turn"),
        F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("int").alias("depth"),
        F.when(F.col("text").isNull(), 0).otherwise(quoted).cast("long").alias("n_quoted"), own_text(F.col("text")).alias("body"),
    )
    made = made.withColumn("formatted", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "body", F.lit(END)))
    made = prefix_scan(made, ["conv_id", "thread_turn", "turn", "role", "body"], {"_at": ("sum", F.lit(1))}, "conversations")
    begin = made.groupBy(F.col("conv_id").alias("_c")).agg(F.min("_at").alias("_begin"))
    made = made.join(begin, F.col("conv_id").eqNullSafe(F.col("_c")))
    made = made.withColumn("position", (F.col("_at") - F.col("_begin") + 1).cast("long"))
    return made.select(
        "conv_id", "position", "turn", "role", "parent_turn", "thread_turn", "depth", "n_quoted", "body", "formatted"
    )


ORACLE_SQL = r"""
WITH RECURSIVE line AS (
    SELECT conv_id, turn, m, i, s AS line FROM (
        SELECT conv_id, turn, md5(text) AS m, unnest(string_split(text, chr(10))) AS s,
               unnest(range(len(string_split(text, chr(10))))) AS i
        FROM (SELECT DISTINCT conv_id, turn, text FROM conversations WHERE text IS NOT NULL))),
level AS (
    SELECT conv_id, turn, m, i,
           length(regexp_replace(regexp_extract(line, '^(\s*>)+', 0), '[^>]', '', 'g')) AS level,
           regexp_replace(regexp_replace(line, '^(\s*>)+', ''), '^\s+|\s+$', '', 'g') AS body FROM line),
fresh AS (
    SELECT *, CASE WHEN lag(level) OVER w = level AND lag(body) OVER w <> '' AND body <> '' THEN 0 ELSE 1 END AS f
    FROM level WINDOW w AS (PARTITION BY conv_id, turn, m ORDER BY i)),
run AS (SELECT *, sum(f) OVER (PARTITION BY conv_id, turn, m ORDER BY i) AS run FROM fresh),
passage AS (
    SELECT conv_id, turn, level, lower(regexp_replace(string_agg(body, ' ' ORDER BY i), '\s+', ' ', 'g')) AS p
    FROM run WHERE body <> '' GROUP BY conv_id, turn, m, run, level),
origin AS (SELECT conv_id, p, min(turn) AS origin FROM passage WHERE level = 0 GROUP BY conv_id, p),
hit AS (
    SELECT conv_id, q.turn, level, origin, sum(length(p)) AS size
    FROM passage q JOIN origin USING (conv_id, p) WHERE level > 0 AND origin < q.turn GROUP BY ALL),
parent AS (
    SELECT conv_id, turn, origin AS parent FROM hit
    QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, size DESC, origin DESC) = 1),
climb AS (
    SELECT conv_id, turn, parent, parent AS top, 1 AS depth FROM parent
    UNION ALL
    SELECT c.conv_id, c.turn, c.parent, p.parent, depth + 1 FROM climb c
    JOIN parent p ON p.conv_id = c.conv_id AND p.turn = c.top),
thread AS (SELECT conv_id, turn, parent, min(top) AS top, max(depth) AS depth FROM climb GROUP BY ALL),
made AS (
    SELECT c.conv_id, c.turn, coalesce(role, 'user') AS role, parent AS parent_turn, coalesce(top, c.turn) AS thread_turn,
           CAST(coalesce(depth, 0) AS INTEGER) AS depth,
           CAST(coalesce(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^(\s*>)+'))), 0) AS BIGINT) AS n_quoted,
           regexp_replace(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_matches(x, '^(\s*>)+')), chr(10)), '^\s+|\s+$', '', 'g') AS body
    FROM conversations c LEFT JOIN thread t ON t.conv_id = c.conv_id AND t.turn = c.turn)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY thread_turn, turn, role, body) AS position, turn, role,
       parent_turn, thread_turn, depth, n_quoted, body, '<|' || role || '|>' || chr(10) || body || '<|end|>' || chr(10) AS formatted
FROM made
"""
