r"""Chat formatting in Spark expressions only.

Method.  The turns of a conversation are collected as structs and sorted; every turn looks at the one before: with the
same role its text joins the message behind a separator, otherwise it opens a message.  A message reads
``<|im_start|>ROLE\nTEXT<|im_sep|>TEXT<|im_end|>\n``.  Strings that could be taken for control strings of this or another
common template (``CONTROL``) are escaped inside texts and roles by a backslash behind their first character; a run of
backslashes there grows by one, so that unescaping is exact whatever the text.  The loss mask is in run lengths, a run
for each turn: ``skip`` code points of the formatted text that don't count, then ``keep`` that do, which are the text if
the turn is the assistant's; the end mark behind the last run doesn't count.

Scale.  One shuffle by conversation; the first aggregation takes the rows as they come.  A conversation is one row of the
result, so its turns meet in one task; the work there is linear in its length, as no array or string is grown step by
step (a conversation of 40,000 turns is among the tests).

Defined results: null text is an empty text, null role an empty role; line feeds in roles are escaped; null
conversation ids form one conversation; rows of the same turn are ordered by role, then text, repeated rows are kept;
an empty table gives no conversations; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: What follows the first character (``<`` or ``[``) of a control string.
CONTROL = r"\|(?:im_start|im_sep|im_end|endoftext|begin_of_text|end_of_text|start_header_id|end_header_id|eot_id|user|assistant|system|pad)\|>|/?s>|/?INST\]|</?SYS>>|(?:start|end)_of_turn>|bos>|eos>"
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={CONTROL})", r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={CONTROL})", "$1$2")


def _role(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _role_back(role: Column) -> Column:
    return unescaped(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def formatted(conversations: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss_runs)``, a row for each conversation."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def piece(t, i):
        opening = F.when((i > 0) & (F.get("turns", i - 1)["role"] == t["role"]), F.lit(SEPARATOR)).otherwise(F.concat(F.when(i > 0, END).otherwise(""), F.lit(START), _role(t["role"]), F.lit("\n")))
        return F.struct(opening.alias("opening"), escaped(t["text"]).alias("text"), (t["role"] == ASSISTANT).alias("counts"))

    def run(p):
        n, m = F.length(p["opening"]), F.length(p["text"])
        return F.struct(F.when(p["counts"], n).otherwise(n + m).alias("skip"), F.when(p["counts"], m).otherwise(0).alias("keep"))

    held = grouped.withColumn("pieces", F.transform("turns", piece))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["opening"], p["text"])), "")
    return held.select("conv_id", F.concat(text, F.lit(END)).alias("formatted"), F.transform("pieces", run).alias("loss_runs"))


def read_back(chats: DataFrame) -> DataFrame:
    """``(conv_id, formatted, turns, loss_text)`` from text and mask: ``turns`` as ``(role, text)`` in order, and the text
    under the loss mask, unescaped."""
    body = F.expr(f"substring(formatted, {len(START) + 1}, length(formatted) - {len(START) + len(END)})")
    messages = F.split(body, r"<\|im_end\|>\n<\|im_start\|>", -1)

    def of(message):
        cut = F.instr(message, "\n")
        role = F.substring(message, F.lit(1), cut - 1)
        texts = F.split(F.substring(message, cut + 1, F.length(message)), r"<\|im_sep\|>", -1)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), x.alias("text")))

    raw = chats.select("conv_id", "formatted", "loss_runs", F.flatten(F.transform(messages, of)).alias("raw"))
    # a run ends where its turn's text does
    masked = F.zip_with("raw", "loss_runs", lambda t, r: unescaped(F.substring(t["text"], F.length(t["text"]) - r["keep"] + 1, r["keep"])))
    turns = F.transform("raw", lambda t: F.struct(_role_back(t["role"]).alias("role"), unescaped(t["text"]).alias("text")))
    return raw.select("conv_id", "formatted", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"))


def digest(conversations: DataFrame) -> DataFrame:
    back = read_back(formatted(conversations))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The conversation that the query adds: texts that look like another template's control strings.
PROBE = "select -7L conv_id, cast(turn as long) turn, role, text from values (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]') as t(turn, role, text)"

ORACLE = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed as (
  select *, lag(role) over (partition by conv_id order by turn, role, text) as before,
    regexp_replace(text, '([<\[])(\\*)(\|(?:im_start|im_sep|im_end|endoftext|begin_of_text|end_of_text|start_header_id|end_header_id|eot_id|user|assistant|system|pad)\|>|/?s>|/?INST\]|</?SYS>>|(?:start|end)_of_turn>|bos>|eos>)', '\1\\\2\3', 'g') as safe
  from rows
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(safe) + case when before = role then 10 else 12 + length(role) + 1 + 11 end) as bigint) as formatted_chars
from placed group by conv_id
"""
