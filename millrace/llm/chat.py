"""Chat formatting by prefix-target expansion. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Fixed values of the template: a turn is OPEN + role + COLON + text + CLOSE.
OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
# Fixed values of the escapes: each control string and the code that stands for it inside texts and roles. The backslash comes first.
ESCAPES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\t"), (": ", "\\c"))

# Examples of a conversation that one task builds at once.
EXAMPLES = 64


def escape(text: Column) -> Column:
    """The text with control strings replaced by backslash codes; ``unescape`` gives it back exactly."""
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    def codes(part: Column) -> Column:
        for plain, code in ESCAPES[1:]:
            part = F.replace(part, F.lit(code), F.lit(plain))
        return part

    # doubled backslashes are cut out first, so that the rest holds codes only
    return F.array_join(F.transform(F.split(text, r"\\\\"), codes), "\\")


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, parts): the rendered turns of each conversation in order of turn (ties: role, then text; null turns first).

    parts is an array of structs (head, body, tail, target): target marks replies of the assistant. Null roles and texts count
    as empty. Repeated rows stay. A conversation's text must fit in a row, as its digest is of the whole; nothing is cut.
    """
    rows = turns.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    part = lambda t: F.struct(F.concat(F.lit(OPEN), escape(t["role"]), F.lit(COLON)).alias("head"), escape(t["text"]).alias("body"), F.lit(CLOSE).alias("tail"), (t["role"] == "assistant").alias("target"))
    return grouped.select("conv_id", F.transform("ts", part).alias("parts"))


def _render(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], p["tail"])), "")


def examples(turns: DataFrame) -> DataFrame:
    """One row per reply of the assistant: all preceding turns as context, and only that reply trainable.

    Columns: conv_id, example_no (from 1), target_turn (position from 0; null in a closing row), is_last, prompt (the rendered turns before it, and the
    head of its own), completion (the escaped reply, the only text under the loss mask), suffix. A conversation that does not end
    with a reply gets one more row, without completion, whose prompt is all of it: it trains nothing but loses no turn.
    prompt is built per row, so a reader of other columns does not pay for the repeated context.
    """
    return _expanded(conversations(turns)).drop("parts")


def _expanded(conv: DataFrame) -> DataFrame:
    """``examples`` with the parts of the conversation. A long conversation is dealt over tasks in runs of EXAMPLES, as its prompts are square in its turns."""
    n = F.size("parts")
    at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.element_at("parts", i + 1)["target"])
    closed = F.element_at("parts", -1)["target"]
    at = F.when(closed, at).otherwise(F.concat(at, F.array(F.lit(None).cast("int"))))
    some = F.sequence(F.lit(0), F.floor((F.size(at) - 1) / EXAMPLES).cast("int"))
    runs = conv.select("conv_id", "parts", F.size(at).alias("k"), at.alias("at"), F.explode(some).alias("run")).repartition(int(conv.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id", "run")
    rows = runs.select("conv_id", "parts", "k", "run", F.posexplode(F.slice("at", F.col("run") * EXAMPLES + 1, EXAMPLES)).alias("i", "target_turn")).withColumn("i", F.col("i") + F.col("run") * EXAMPLES)
    reply = F.element_at("parts", F.col("target_turn") + 1)
    prompt = F.when(F.col("target_turn").isNull(), _render(F.col("parts"))).otherwise(F.concat(_render(F.slice("parts", F.lit(1), F.coalesce("target_turn", F.lit(0)))), reply["head"]))
    return rows.select("conv_id", "parts", (F.col("i") + 1).alias("example_no"), "target_turn", (F.col("i") + 1 == F.col("k")).alias("is_last"), prompt.alias("prompt"), F.when(F.col("target_turn").isNotNull(), reply["body"]).alias("completion"), F.when(F.col("target_turn").isNotNull(), reply["tail"]).alias("suffix"))


#: Digests of prompts are sums modulo this prime.
PRIME = 1_000_000_007


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def prompt_digest(pieces: Column, n: Column, closing: Column) -> Column:
    """The digest of a prompt, read from the n pieces that CLOSE cuts its text into: the sum, over its turns and its own head, of place (from 1) times the first 32 bits of the MD5.

    closing: the prompt is all of its conversation and ends with a turn, not with a head.
    """
    value = lambda p, i: (i + 1) * _number(F.when(i < n - 1, F.concat(p, F.lit(CLOSE))).otherwise(p))
    return F.aggregate(F.transform(F.slice(pieces, F.lit(1), n - closing.cast("int")), value), F.lit(0).cast("long"), lambda a, v: (a + v) % PRIME)


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of structs (role, text), unescaped."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    role = lambda p: F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), COLON, 1)
    text = lambda p: F.substr(p, F.lit(len(OPEN) + len(COLON) + 1) + F.length(role(p)))
    return F.transform(pieces, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(text(p)).alias("text")))


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation what can be read back from its examples, every prompt included; see ``op3_chat_format``."""
    ex = _expanded(conversations(turns))
    whole = F.when(F.col("is_last"), F.concat("prompt", F.coalesce("completion", F.lit("")), F.coalesce("suffix", F.lit(""))))
    # the pieces and their number are columns, so that no lambda cuts the text anew
    ex = ex.select("conv_id", "example_no", "completion", "target_turn", whole.alias("whole"), F.length("prompt").cast("long").alias("chars"), F.split("prompt", CLOSE).alias("pieces"))
    ex = ex.withColumn("n", F.size("pieces"))
    read = F.struct("chars", prompt_digest(F.col("pieces"), F.col("n"), F.col("target_turn").isNull()).alias("digest"))
    per = ex.select("conv_id", "example_no", "completion", "whole", read.alias("read")).groupBy("conv_id").agg(
        F.struct(F.count("*").alias("n"), F.sum("read.chars").alias("chars"), (F.sum("read.digest") % PRIME).alias("digest")).alias("prompts"),
        F.max("whole").alias("formatted"), F.array_sort(F.collect_list(F.when(F.col("completion").isNotNull(), F.struct("example_no", "completion")))).alias("replies"))
    per = per.select("conv_id", "prompts", "formatted", read_back(F.col("formatted")).alias("turns"), F.array_join(F.transform("replies", lambda r: unescape(r["completion"])), "").alias("loss"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("prompts.n").alias("n_examples"), F.col("prompts.chars").alias("prompt_chars"), F.col("prompts.digest").alias("prompt_digest"))


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns and conversation -7, whose texts hold the template's own control strings."""
    tricky = "\\### Assistant: </turn> ok"
    extra = turns.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(with_probe(table(spark, sf_dir, "conversations")))


ORACLE = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e as (
  select *, replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ': ', '\c') as er,
         replace(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t'), ': ', '\c') as et from t
), f as (select *, '### ' || er || ': ' as head, '### ' || er || ': ' || et || '</turn>' || chr(10) as whole, row_number() over (partition by conv_id order by turn nulls first, role, text) as place, count(*) over (partition by conv_id) as n from e),
g as (
  select *, coalesce(sum(length(whole)) over before, 0) as chars, coalesce(sum(place * ('0x' || substr(md5(whole), 1, 8))::bigint) over before, 0) as digest from f
  window before as (partition by conv_id order by place rows between unbounded preceding and 1 preceding)
), x as (
  select conv_id, chars + length(head) as chars, digest + place * ('0x' || substr(md5(head), 1, 8))::bigint as digest from g where role = 'assistant'
  union all select conv_id, chars + length(whole), digest + place * ('0x' || substr(md5(whole), 1, 8))::bigint from g where place = n and role <> 'assistant'
), prompts as (select conv_id, count(*)::bigint as n_examples, sum(chars)::bigint as prompt_chars, (sum(digest) % 1000000007)::bigint as prompt_digest from x group by conv_id),
c as (
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
  sum(4 + length(er) + 2 + length(et) + 8)::bigint as formatted_chars
from e group by conv_id
)
select c.*, n_examples, prompt_chars, prompt_digest from c join prompts on c.conv_id is not distinct from prompts.conv_id
"""
