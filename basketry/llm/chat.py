"""Chat formatting with cumulative-snapshot collapse.

Chat services log a conversation again after every turn, so that one log
prefixes the next. Each turn is hashed; a rolling hash over the turn hashes
names every turn-prefix of a conversation. A conversation whose full hash is
a proper turn-prefix of a longer one is a snapshot and goes (an anti-join);
of conversations with equal turns the one with the smallest id stays. The
maximal conversations are then rendered.

Only hashes travel until the survivors are known: prefix hashes are made
distinct before the anti-join, so a first turn that a third of all
conversations share is one row there. A prefix's hash is a running sum over
the conversation's turns, a window of narrow rows that spills to disk; no
value grows with the turns. Texts are shuffled once, for survivors. Only the
rendering puts a conversation into one value, which must fit one task.

Edge cases: turns are ordered by ``turn`` (null first), then by hash; exact
repeats of a row count once; a null role reads ``unknown`` and a null text is
empty; rows without a conversation id take no part; an empty table gives an
empty result; further columns are not read. Texts of any length are hashed
and rendered whole. ``<|`` inside a role or text is written ``< |``, so a
text cannot forge a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry.session import materialize


def _turns(logs: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = F.coalesce(F.col(role_col), F.lit("unknown")), F.coalesce(F.col(text_col), F.lit(""))
    return (logs.where(F.col(conv_col).isNotNull())
            .select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
            .withColumn("hash", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))


def _prefixes(turns: DataFrame) -> DataFrame:
    """``conv, turn_no, a, b, last``: a row for every turn-prefix. Its hash
    (``a``, ``b``) is a running sum of the turns' hashes weighed by position:
    each turn is hashed twice together with its number."""
    own = Window.partitionBy("conv").orderBy("turn", "hash")
    rows = turns.select("conv", "turn", "hash").distinct().withColumn("turn_no", F.row_number().over(own))
    rolled = {n: F.sum(F.xxhash64(F.lit(n), "turn_no", "hash").cast("decimal(20,0)")).over(own.rowsBetween(Window.unboundedPreceding, 0)) for n in ("a", "b")}
    return rows.withColumns(rolled | {"last": F.lead("turn_no").over(own).isNull()}).select("conv", "turn_no", "a", "b", "last")


def maximal(turns: DataFrame) -> DataFrame:
    """``conv, n_turns, n_copies`` of the conversations that stay."""
    rows, prefix = materialize(_prefixes(turns), "chat-prefixes"), ["turn_no", "a", "b"]
    distinct = rows.where("last").groupBy(*prefix).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_copies"))
    proper = rows.where("NOT last").select(*prefix).distinct()
    return distinct.join(proper, prefix, "left_anti").select("conv", F.col("turn_no").alias("n_turns"), "n_copies")


def render(role: Column, text: Column) -> Column:
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|im_start|>"), safe(role), F.lit("\n"), safe(text), F.lit("<|im_end|>\n"))


def format_chats(logs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_col, n_turns, n_copies, text``: every maximal conversation, rendered."""
    turns = _turns(logs, conv_col, turn_col, role_col, text_col)
    kept = materialize(maximal(turns), "chat-maximal")
    messages = F.sort_array(F.collect_set(F.struct("turn", "hash", "role", "text")))
    text = F.array_join(F.transform(messages, lambda m: render(m["role"], m["text"])), "")
    return (turns.join(kept, "conv").groupBy("conv", "n_turns", "n_copies").agg(text.alias("text"))
            .select(F.col("conv").alias(conv_col), "n_turns", "n_copies", "text"))


#: ``format_chats`` over ``conversations`` in DuckDB SQL, by the turns
#: themselves instead of hashes of prefixes.
ORACLE_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT *, sha256(length(role) || ':' || role || text) AS hash FROM t),
c AS (
  SELECT conv_id, list(role || chr(0) || text ORDER BY turn NULLS FIRST, hash) AS turns, count(*) AS n,
         string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), ''
                    ORDER BY turn NULLS FIRST, hash) AS rendered
  FROM h GROUP BY conv_id),
u AS (SELECT turns, min(conv_id) AS conv_id, any_value(n) AS n, count(*) AS copies, any_value(rendered) AS rendered FROM c GROUP BY turns),
p AS (SELECT DISTINCT turns[1:i] AS turns FROM (SELECT turns, unnest(range(1, n)) AS i FROM u))
SELECT conv_id, CAST(n AS INT) AS n_turns, copies AS n_copies, rendered AS text FROM u ANTI JOIN p USING (turns)
"""
