"""Preference pairs of conversations (native DataFrame functions only).

The longest common prefix of turns of a chosen and a rejected conversation is
rendered once as the prompt; what follows in each is a completion, with a mask of
the characters to train on: what the assistant says, with its end mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm.common import table

#: A turn is rendered as <|role|>, a line feed, its text, <|end|> and a line feed. "<|"
#: in a role or text becomes "<||", so that marks can be told from text.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<||"))


def header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(turn["role"]), F.lit(CLOSE))


def body(turn: Column) -> Column:
    return F.concat(escaped(turn["text"]), F.lit(END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t), body(t))), "")


def trained_spans(turns: Column) -> Column:
    """The character ranges [first, stop) of the rendered turns that are trained on."""
    none = F.array().cast("array<struct<first: bigint, stop: bigint>>")

    def step(s: Column, t: Column) -> Column:
        first = s["at"] + F.char_length(header(t))
        stop = first + F.char_length(body(t))
        span = F.array(F.struct(first.alias("first"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(t["role"] == TRAINED, F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step, lambda s: s["spans"])


def common_prefix(a: Column, b: Column) -> Column:
    """How many first turns have the same role and text (nulls are equal to each other)."""
    same = lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"])
    n = F.least(F.size(a), F.size(b))
    equal = F.transform(F.sequence(F.lit(0), n - 1), lambda i: same(F.get(a, i), F.get(b, i)))
    unlike = F.array_position(equal, False)
    return F.when(n == 0, 0).when(unlike == 0, n).otherwise(unlike - 1).cast("int")


def preference_pairs(turns: DataFrame, pair: Column, chosen: Column, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per pair: pair_id, chosen_id, rejected_id, n_prompt_turns, prompt, chosen,
    rejected (rendered completions), chosen_spans, rejected_spans.

    turns has one row a turn; pair and chosen are columns over it: the pair of its
    conversation, and whether that is the chosen one. Turns are ordered by number,
    then role and text; a null number comes first, null roles and texts render as
    empty. A pair with one side only has an empty prompt, an empty other completion
    and a null other id. If all turns agree, the prompt holds them and both
    completions are empty. Rows with a null pair are in no pair and are left out;
    repeated rows are repeated turns. Other columns are not read; an empty table
    gives an empty result. Each pair's turns come together in one shuffle; a conversation,
    like a document, must fit into a task.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = turns.select(pair.alias("pair_id"), F.coalesce(chosen, F.lit(False)).alias("_good"), F.col(conv_col).alias("_conv"), turn.alias("_turn")).where("pair_id is not null")
    side = lambda good: F.sort_array(F.collect_list(F.when(F.col("_good") == good, F.col("_turn"))))
    conv = lambda good: F.min(F.when(F.col("_good") == good, F.col("_conv")))
    both = rows.groupBy("pair_id").agg(conv(True).alias("chosen_id"), conv(False).alias("rejected_id"), side(True).alias("_a"), side(False).alias("_b"))
    both = both.withColumn("_n", common_prefix(F.col("_a"), F.col("_b")))
    rest = lambda c: F.slice(c, F.col("_n") + 1, F.greatest(F.size(c) - F.col("_n"), F.lit(0)))
    cut = both.select("*", F.slice("_a", F.lit(1), F.col("_n")).alias("_p"), rest("_a").alias("_c"), rest("_b").alias("_r"))
    return cut.select(
        "pair_id", "chosen_id", "rejected_id", F.col("_n").cast("long").alias("n_prompt_turns"), rendered(F.col("_p")).alias("prompt"),
        rendered(F.col("_c")).alias("chosen"), rendered(F.col("_r")).alias("rejected"), trained_spans(F.col("_c")).alias("chosen_spans"), trained_spans(F.col("_r")).alias("rejected_spans"),
    )


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["first"].cast("string"), F.lit("-"), s["stop"].cast("string"))), ",")


def neighbour(conv: Column) -> Column:
    """The other one of 2k and 2k + 1, for negative numbers too."""
    return conv + 1 - 2 * F.pmod(conv, F.lit(2))


def with_replies_of_neighbours(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with the last reply of each conversation replaced by
    its neighbour's; a conversation without a reply, or whose neighbour has none, stays as it is."""
    last = turns.where(F.col("role") == TRAINED).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    lent = last.select(neighbour(F.col("conv_id")).alias("conv_id"), F.struct("last.text").alias("lent"))
    both = turns.join(last.join(lent, "conv_id"), "conv_id", "left")
    own = (F.col("role") == TRAINED) & F.col("turn").eqNullSafe(F.col("last.turn")) & F.col("lent").isNotNull()
    return both.select("conv_id", "turn", "role", F.when(own, F.col("lent.text")).otherwise(F.col("text")).alias("text"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of pairs of all conversations. reply: each conversation, and the same one
    with its last reply from its neighbour. neighbours: of 2k and 2k + 1 the even one is chosen.
    Rows without a conversation's id are in no pair."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").where("conv_id is not null")
    conv = F.col("conv_id")
    pair = lambda kind, k: F.struct(F.lit(kind).alias("kind"), k.cast("long").alias("id")).alias("pair")
    whole = [F.lit(True).alias("good"), "conv_id", "turn", "role", "text"]
    rows = turns.select(pair("neighbours", F.floor((conv - F.pmod(conv, F.lit(2))) / 2)), (F.pmod(conv, F.lit(2)) == 0).alias("good"), *whole[1:])
    rows = rows.unionByName(turns.select(pair("reply", conv), *whole))
    lent = with_replies_of_neighbours(turns).select(pair("reply", conv), F.lit(False).alias("good"), neighbour(conv).alias("conv_id"), "turn", "role", "text")
    pairs = preference_pairs(rows.unionByName(lent), F.col("pair"), F.col("good"))
    return pairs.select(
        "pair_id.kind", F.col("pair_id.id").alias("pair_id"), "chosen_id", "rejected_id", "n_prompt_turns", "prompt", "chosen", "rejected",
        spans_text(F.col("chosen_spans")).alias("chosen_mask"), spans_text(F.col("rejected_spans")).alias("rejected_mask"),
    )


def _sql() -> str:
    text = "replace(coalesce({x}, ''), '<|', '<||')"
    head, tail = f"('<|' || {text.format(x='t.role')} || '|>' || chr(10))", f"({text.format(x='t.text')} || '<|end|>' || chr(10))"

    def side(c: str) -> str:
        size = f"list_transform({c}, lambda t: length({head}) + length({tail}))"
        start = f"coalesce(list_sum(({size})[1:i - 1]), 0)"
        span = f"(({start}) + length({head.replace('t.', f'{c}[i].')}))::BIGINT || '-' || ({start} + ({size})[i])::BIGINT"
        return f"array_to_string(list_transform(list_filter(range(1, len({c}) + 1), lambda i: {c}[i].role = 'assistant'), lambda i: {span}), ',')"

    rendered_sql = lambda c: f"array_to_string(list_transform({c}, lambda t: {head} || {tail}), '')"
    return f"""
WITH u AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM u WHERE role = 'assistant' GROUP BY 1),
r AS (SELECT 'neighbours' AS kind, floor(conv_id / 2.0)::BIGINT AS pair_id, conv_id % 2 = 0 AS good, conv_id, turn, role, text FROM u
  UNION ALL SELECT 'reply', conv_id, true, conv_id, turn, role, text FROM u
  UNION ALL SELECT 'reply', u.conv_id, false, u.conv_id + 1 - 2 * (u.conv_id % 2), u.turn, role, CASE WHEN role = 'assistant' AND u.turn = l.turn AND n.turn IS NOT NULL THEN n.text ELSE u.text END
    FROM u LEFT JOIN l ON l.conv_id = u.conv_id LEFT JOIN l n ON n.conv_id = u.conv_id + 1 - 2 * (u.conv_id % 2)),
p AS (SELECT kind, pair_id, min(conv_id) FILTER (good) AS chosen_id, min(conv_id) FILTER (NOT good) AS rejected_id,
  coalesce(list({{'role': role, 'text': text}} ORDER BY turn, role, text) FILTER (good), []) AS a,
  coalesce(list({{'role': role, 'text': text}} ORDER BY turn, role, text) FILTER (NOT good), []) AS b FROM r GROUP BY 1, 2),
q AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]), false), 0) AS u FROM p),
n AS (SELECT *, CASE WHEN u = 0 THEN least(len(a), len(b)) ELSE u - 1 END AS n FROM q),
c AS (SELECT *, a[1:n] AS pre, a[n + 1:] AS x, b[n + 1:] AS y FROM n)
SELECT kind, pair_id, chosen_id, rejected_id, n::BIGINT AS n_prompt_turns, {rendered_sql('pre')} AS prompt, {rendered_sql('x')} AS chosen, {rendered_sql('y')} AS rejected,
 {side('x')} AS chosen_mask, {side('y')} AS rejected_mask FROM c
"""


QUERIES = {"op6_chat_format": op6_chat_format}
ORACLE_SQL = {"op6_chat_format": _sql()}
