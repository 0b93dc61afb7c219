"""Chat formatting: preference pairs as one prompt and two masked completions, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The ChatML turn marks, fixed values of that format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turns(rows: DataFrame, pair: str, turn: str, role: str, text: str, side: str) -> DataFrame:
    """One row for each pair: its turns in order. A conversation is one training example and so of bounded length."""
    # Lines end a role, so a role is one line.
    name = F.translate(_escaped(F.coalesce(F.col(role), F.lit(""))), "\r\n", "  ")
    one = F.struct(F.col(turn).alias("turn"), name.alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    some = rows.select(F.col(pair).alias("pair_id"), one.alias("t")).where(F.col("t.turn").isNotNull() & F.col("pair_id").isNotNull())
    return some.groupBy("pair_id").agg(F.array_sort(F.collect_set("t")).alias(side))


def _escaped(c: Column) -> Column:
    """Turn marks inside a text or a role lose their pipes, so neither can open or close a turn."""
    return F.replace(F.replace(c, F.lit(OPEN), F.lit("<im_start>")), F.lit(CLOSE), F.lit("<im_end>"))


def _render(turns: Column) -> Column:
    said = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), _escaped(t["text"]), F.lit(f"{CLOSE}\n"))
    return F.array_join(F.transform(turns, said), "")


def _spans(turns: Column) -> Column:
    """(start, end) in code points of a rendered list of turns, of what the loss covers: assistant text and its end mark."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(s, t):
        head = s["at"] + len(OPEN) + F.char_length(t["role"]) + 1
        end = head + F.char_length(_escaped(t["text"])) + len(CLOSE)
        span = F.array(F.struct(head.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == "assistant", F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, begin, step, lambda s: s["spans"])


def format_preferences(
    chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row for each pair of a chosen and a rejected conversation, given as rows of turns.

    Returns pair_id, n_shared (int: turns of the longest common prefix, equal in role and text), prompt (that
    prefix, rendered once, and never masked in), chosen and rejected (the rest of either side), chosen_spans and
    rejected_spans (array<struct<start,end>>: half-open spans in code points of the completion that the loss
    covers: what an assistant says, with its end mark; all else is masked).

    Turns are ordered by number, then role (its turn marks without pipes, its line ends as spaces), then text; a repeated row counts once, rows without a pair or turn number are left out; null
    role or text is empty. A side that is missing or ends at the prefix has an empty completion and no spans; equal
    sides have both empty. Other columns are ignored. Pairs meet in two aggregations and a join on the pair's key,
    so a turn or conversation that many pairs share is never a key.
    """
    both = _turns(chosen, pair, turn, role, text, "c").join(_turns(rejected, pair, turn, role, text, "r"), "pair_id", "full")
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    shape = "array<struct<turn:bigint,role:string,text:string>>"
    both = both.select("pair_id", F.coalesce(F.col("c").cast(shape), none).alias("c"), F.coalesce(F.col("r").cast(shape), none).alias("r"))
    # Turn by turn: equal, or not; the prefix ends before the first that isn't. The longer side's rest compares as null.
    same = F.zip_with("c", "r", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position("same", False).cast("int")
    shared = F.when(first == 0, F.size("same")).otherwise(first - 1)
    cut = both.withColumn("same", same).withColumn("n_shared", shared)
    rest = lambda s: F.slice(F.col(s), F.col("n_shared") + 1, F.greatest(F.size(s) - F.col("n_shared"), F.lit(0)))
    parts = cut.select("pair_id", "n_shared", F.slice("c", F.lit(1), F.col("n_shared")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return parts.select(
        "pair_id",
        "n_shared",
        _render(F.col("p")).alias("prompt"),
        _render(F.col("c")).alias("chosen"),
        _render(F.col("r")).alias("rejected"),
        _spans(F.col("c")).alias("chosen_spans"),
        _spans(F.col("r")).alias("rejected_spans"),
    )


def op7_preference_pairs(spark, sf_dir: str) -> DataFrame:
    """Each conversation is the chosen side of a pair; the rejected side has its last assistant turn replaced by that
    of the conversation it is paired with (2k with 2k+1), or left out if that one has none."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = rows.where(F.col("role") == "assistant").groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("x"))
    other = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("x.text").alias("reply"))
    own = last.select("pair_id", F.col("x.turn").alias("swap"))
    given = rows.join(own, "pair_id", "left").join(other, "pair_id", "left")
    swapped = F.coalesce(F.col("turn") == F.col("swap"), F.lit(False))
    rejected = given.select("pair_id", "turn", "role", F.when(swapped, F.col("reply")).otherwise(F.col("text")).alias("text"), swapped.alias("s"))
    rejected = rejected.where(~F.col("s") | F.col("text").isNotNull()).drop("s")
    out = format_preferences(rows, rejected)
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.withColumns({"chosen_spans": flat("chosen_spans"), "rejected_spans": flat("rejected_spans")})


_SIDE = r"""
  SELECT pair_id, turn, role, text,
         '<|im_start|>' || role || chr(10) || replace(replace(text, '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') || '<|im_end|>' || chr(10) AS said,
         row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, text) AS k
"""
_SPANS = r"""
  SELECT pair_id, string_agg(said, '' ORDER BY k) AS body,
         coalesce(string_agg(CAST(pos + 12 + length(role) + 1 AS VARCHAR) || '-' || CAST(pos + length(said) - 1 AS VARCHAR), ',' ORDER BY k)
                  FILTER (WHERE role = 'assistant'), '') AS spans
"""
_AT = "CAST(coalesce(sum(length(said)) OVER (PARTITION BY s.pair_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos"
ORACLE = {
    "op7_preference_pairs": f"""
WITH base AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations),
last AS (SELECT pair_id, max(turn) AS swap, arg_max(text, turn) AS reply FROM base WHERE role = 'assistant' GROUP BY pair_id),
rej AS (
  SELECT b.pair_id, b.turn, b.role, CASE WHEN b.turn = o.swap THEN p.reply ELSE b.text END AS text
  FROM base b LEFT JOIN last o ON b.pair_id = o.pair_id LEFT JOIN last p ON p.pair_id = xor(b.pair_id, 1)
  WHERE b.turn IS DISTINCT FROM o.swap OR p.reply IS NOT NULL),
c AS ({_SIDE} FROM base), r AS ({_SIDE} FROM rej),
ids AS (SELECT pair_id, count(*) AS n FROM c GROUP BY pair_id),
differ AS (SELECT c.pair_id, min(c.k) AS k FROM c LEFT JOIN r ON c.pair_id = r.pair_id AND c.k = r.k
           WHERE r.k IS NULL OR c.role <> r.role OR c.text <> r.text GROUP BY c.pair_id),
cut AS (SELECT i.pair_id, CAST(coalesce(d.k - 1, i.n) AS INTEGER) AS n_shared FROM ids i LEFT JOIN differ d ON i.pair_id = d.pair_id),
pr AS (SELECT c.pair_id, string_agg(c.said, '' ORDER BY c.k) AS prompt FROM c JOIN cut ON c.pair_id = cut.pair_id AND c.k <= n_shared GROUP BY c.pair_id),
ca AS ({_SPANS} FROM (SELECT s.*, {_AT} FROM c s JOIN cut ON s.pair_id = cut.pair_id AND k > n_shared) GROUP BY pair_id),
ra AS ({_SPANS} FROM (SELECT s.*, {_AT} FROM r s JOIN cut ON s.pair_id = cut.pair_id AND k > n_shared) GROUP BY pair_id)
SELECT cut.pair_id, n_shared, coalesce(prompt, '') AS prompt, coalesce(ca.body, '') AS chosen, coalesce(ra.body, '') AS rejected,
       coalesce(ca.spans, '') AS chosen_spans, coalesce(ra.spans, '') AS rejected_spans
FROM cut LEFT JOIN pr ON cut.pair_id = pr.pair_id LEFT JOIN ca ON cut.pair_id = ca.pair_id LEFT JOIN ra ON cut.pair_id = ra.pair_id
"""
}
QUERIES = {"op7_preference_pairs": op7_preference_pairs}
