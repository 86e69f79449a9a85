"""Preference records: the longest common turn prefix as prompt, two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SHUT = "<|{}|>\n", "<|end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): turns by number; ties by role, then text. Null role or text counts as empty."""
    t = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(t)).alias("turns"))


def _head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t["role"]), t["text"], F.lit(SHUT))), "")


def _mask(name: str) -> Column:
    """(start, end) of what is learned in a rendered completion: assistant texts with their end mark."""
    span = "array<struct<start:int,end:int>>"
    return F.expr(f"""aggregate({name}, named_struct('at', 0, 'out', cast(array() as {span})),
        (a, t) -> named_struct('at', a.at + length(t.role) + length(t.text) + {len('<||>') + 1 + len(SHUT)},
            'out', if(t.role = 'assistant', concat(a.out, array(named_struct(
                'start', a.at + length(t.role) + {len('<||>') + 1}, 'end', a.at + length(t.role) + length(t.text) + {len('<||>') + 1 + len(SHUT)}))), a.out)),
        a -> a.out)""")


def preference_records(pairs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per pair (pair_id, chosen_id, rejected_id): the prompt once, both completions and their masks.

    Turns are equal if role and text are; turn numbers only order them. A conversation
    that is missing or null has no turns. usable says that both completions hold an
    assistant turn and differ; identical conversations are all prompt.
    """
    c = conversations(turns)
    none = F.expr("cast(array() as array<struct<turn:bigint,role:string,text:string>>)")
    p = pairs.join(c.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("c")), "chosen_id", "left")
    p = p.join(c.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("r")), "rejected_id", "left")
    p = p.withColumns({"c": F.coalesce("c", none), "r": F.coalesce("r", none)})
    n = F.least(F.size("c"), F.size("r"))
    same = F.expr("""transform(sequence(1, least(size(c), size(r))), i -> c[i - 1].role = r[i - 1].role and c[i - 1].text = r[i - 1].text)""")
    first = F.array_position(same, False)
    p = p.withColumn("n_prompt", F.when(n == 0, 0).otherwise(F.when(first == 0, n).otherwise(first - 1)).cast("int"))
    p = p.withColumns({"head": F.expr("slice(c, 1, n_prompt)"), "ct": F.expr("slice(c, n_prompt + 1, size(c))"), "rt": F.expr("slice(r, n_prompt + 1, size(r))")})
    has = lambda x: F.exists(x, lambda t: t["role"] == "assistant")
    return p.select(
        "pair_id", "chosen_id", "rejected_id", "n_prompt", _render(F.col("head")).alias("prompt"), _render(F.col("ct")).alias("chosen"), _render(F.col("rt")).alias("rejected"),
        _mask("ct").alias("chosen_mask"), _mask("rt").alias("rejected_mask"), (has("ct") & has("rt")).alias("usable"))


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) as pair k, also if one of them is missing."""
    k = F.floor(F.col("conv_id") / 2)
    return turns.where("conv_id is not null").select(k.alias("pair_id")).distinct().select("pair_id", (F.col("pair_id") * 2).alias("chosen_id"), (F.col("pair_id") * 2 + 1).alias("rejected_id"))
