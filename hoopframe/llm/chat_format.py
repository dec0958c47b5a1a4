"""Chat formatting: the common turns of a chosen and a rejected conversation once as prompt, the rest as masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, read, stash

TRAINED_ROLE = "assistant"


def _header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _body(text: Column) -> Column:
    return F.concat(text, F.lit("<|end|>\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t["role"]), _body(t["text"]))), "")


def _spans(turns: Column) -> Column:
    """The characters that are trained on: text and end mark of the trained role's turns; start and end, end exclusive."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(_header(t["role"]))
        end = begin + F.length(_body(t["text"]))
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == TRAINED_ROLE, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per pair of pairs(chosen_id, rejected_id) of which both conversations have turns.

    turns: conv_id, turn, role, text. Columns: chosen_id, rejected_id,
    n_prompt (turns in the prompt), prompt, chosen, rejected (rendered text),
    chosen_spans and rejected_spans (trained characters of the completions).

    The prompt is the longest prefix of turns that both conversations have,
    by turn number, role and text. A conversation that is a prefix of the
    other has an empty completion. A null turn counts as turn -1, null roles
    and texts as empty; rows of one turn number follow role and text and are
    compared as a whole; repeated rows count as often as they occur. Turns
    without a conv_id and pairs with a null id are left out, repeated pairs
    count once, and other columns aren't read. The turns of one pair meet in
    one row of the result, and only there.
    """
    pairs = stash(pairs.select("chosen_id", "rejected_id").where("chosen_id is not null and rejected_id is not null").distinct(), "pairs")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = turns.where("conv_id is not null").select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    sides = pairs.select("chosen_id", "rejected_id", F.explode(F.array(F.struct(F.col("chosen_id").alias("conv_id"), F.lit(True).alias("is_chosen")), F.struct(F.col("rejected_id").alias("conv_id"), F.lit(False).alias("is_chosen")))).alias("s"))
    sides = sides.select("chosen_id", "rejected_id", "s.*")
    uses = stash(turns.groupBy("conv_id").agg(F.count("*").alias("size")).join(sides, "conv_id"), "sides")
    total = uses.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    rows = stash(attach(turns, uses, "conv_id", "size", total), "paired-turns")
    key = ["chosen_id", "rejected_id"]
    mark = F.xxhash64("role", "text").cast("decimal(38,0)")
    side = F.when(F.col("is_chosen"), F.lit(1)).otherwise(F.lit(-1))
    same = rows.groupBy(*key, "turn").agg(F.sum(mark * side).alias("marks"), F.sum(side).alias("n"))
    first = same.where("marks != 0 or n != 0").groupBy(*key).agg(F.min("turn").alias("first"))
    turn = F.struct("turn", "role", "text")
    before = F.col("first").isNull() | (F.col("turn") < F.col("first"))

    def part(which: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(which, turn)))

    both = rows.join(first, key, "left").groupBy(*key).agg(
        part(before & F.col("is_chosen")).alias("p"),
        part(~before & F.col("is_chosen")).alias("c"),
        part(~before & ~F.col("is_chosen")).alias("r"),
        F.count_distinct("is_chosen").alias("n"),
    )
    return both.where("n = 2").select(
        *key,
        F.size("p").cast("long").alias("n_prompt"),
        _render(F.col("p")).alias("prompt"),
        _render(F.col("c")).alias("chosen"),
        _render(F.col("r")).alias("rejected"),
        _spans(F.col("c")).alias("chosen_spans"),
        _spans(F.col("r")).alias("rejected_spans"),
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of even id is the chosen one to the next id's rejected one."""
    turns = read(spark, sf_dir, "conversations")
    ids = turns.select("conv_id").distinct()
    pairs = ids.where("conv_id % 2 = 0").select(F.col("conv_id").alias("chosen_id"), (F.col("conv_id") + 1).alias("rejected_id"))
    out = format_preferences(turns, pairs)

    def text(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(spans)

    return out.withColumns({c: text(c) for c in ("chosen_spans", "rejected_spans")})


SQL = """
WITH t AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text, conv_id - conv_id % 2 AS pair
           FROM conversations WHERE conv_id IS NOT NULL),
ok AS (SELECT pair FROM t GROUP BY pair HAVING count(DISTINCT conv_id) = 2),
side AS (SELECT pair, turn, list((role, text) ORDER BY role, text) FILTER (conv_id = pair) AS c,
         list((role, text) ORDER BY role, text) FILTER (conv_id <> pair) AS r FROM t JOIN ok USING (pair) GROUP BY pair, turn),
cut AS (SELECT pair, min(turn) AS first FROM side WHERE c IS DISTINCT FROM r GROUP BY pair),
s AS (SELECT pair, turn, role, conv_id = pair AS chosen, first IS NULL OR turn < first AS prompt, '<|' || role || '|>' || chr(10) AS h,
      text || '<|end|>' || chr(10) AS b, text FROM t JOIN ok USING (pair) LEFT JOIN cut USING (pair)),
w AS (SELECT *, coalesce(sum(length(h || b)) OVER (PARTITION BY pair, chosen, prompt ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ofs FROM s)
SELECT pair AS chosen_id, pair + 1 AS rejected_id, count(*) FILTER (prompt AND chosen) AS n_prompt,
       coalesce(string_agg(h || b, '' ORDER BY turn, role, text) FILTER (prompt AND chosen), '') AS prompt,
       coalesce(string_agg(h || b, '' ORDER BY turn, role, text) FILTER (NOT prompt AND chosen), '') AS chosen,
       coalesce(string_agg(h || b, '' ORDER BY turn, role, text) FILTER (NOT prompt AND NOT chosen), '') AS rejected,
       coalesce(string_agg((ofs + length(h))::BIGINT || ':' || (ofs + length(h || b))::BIGINT, ',' ORDER BY ofs) FILTER (NOT prompt AND chosen AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg((ofs + length(h))::BIGINT || ':' || (ofs + length(h || b))::BIGINT, ',' ORDER BY ofs) FILTER (NOT prompt AND NOT chosen AND role = 'assistant'), '') AS rejected_spans
FROM w GROUP BY pair
"""
