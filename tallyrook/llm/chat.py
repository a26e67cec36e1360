"""Chat formatting as relational expressions: collect, sort, merge, escape, concatenate; and read the output back.

Template, for each run of adjacent turns of one role:

    <|im_start|>role<|content|>text<|part|>text ...<|im_end|>\\n

`<|part|>` keeps apart the turns that a run merges. Inside roles and texts a backslash is put behind each `<`, `[` and
backslash, so no control string, of this template or of others (`</s>`, `[INST]`), stands in the output that way, and
taking it out again restores the text.

The loss mask is by segment: segments are the output cut before each `<|` and behind each `|>`; loss is true for an
assistant's texts alone. Joined, the segments are the output.

A conversation's output is one string, so one row, and its turns meet in one task, as the output itself does; only
keyed by conv_id, hot conversations are as large as their own output and no larger.

Cases: a null text or role is empty; turns are ordered by turn (null first), then role, then text, so ties and repeated
rows have a defined order and all stay; a null conv_id is a conversation of its own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, CONTENT, PART, END = "<|im_start|>", "<|content|>", "<|part|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """turns (conv_id, turn, role, text, ...) -> conv_id, formatted, segments array<struct<text, loss>>."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    own = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))

    def turn_of_run(run: Column) -> Column:
        head = F.concat(F.lit(START), escape(run["role"]), F.lit(CONTENT))
        return F.concat(head, F.array_join(F.transform(run["parts"], escape), PART), F.lit(END))

    text = F.array_join(F.transform(merged_runs("t"), turn_of_run), "")
    return own.select("conv_id", text.alias("formatted")).select("conv_id", "formatted", segments_of("formatted", loss_role).alias("segments"))


def merged_runs(turns: str) -> Column:
    """An array of turns (role, text) -> its runs of one role: array of struct(role, parts). Each turn is touched once."""
    t = F.col(turns)
    heads = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i - 1)["role"] != F.get(t, i)["role"]))
    ends = F.concat(F.slice(heads, 2, F.size(heads)), F.array(F.size(t)))
    return F.zip_with(heads, ends, lambda a, b: F.struct(F.get(t, a)["role"].alias("role"), F.transform(F.slice(t, a + 1, b - a), lambda x: x["text"]).alias("parts")))


def blocks_of(formatted: str) -> Column:
    """The runs of one role in an output: array of struct(role, parts), still escaped."""
    blocks = F.filter(F.split(F.col(formatted), r"<\|im_end\|>\n"), lambda b: b != "")
    return F.transform(
        blocks,
        lambda b: F.struct(
            F.substring_index(F.substring_index(b, START, -1), CONTENT, 1).alias("role"),
            F.split(F.substring_index(b, CONTENT, -1), r"<\|part\|>").alias("parts"),
        ),
    )


def segments_of(formatted: str, loss_role: str) -> Column:
    """An output cut at its control strings: array of struct(text, loss)."""

    def cut(b: Column) -> Column:
        head = F.struct(F.concat(F.lit(START), b["role"], F.lit(CONTENT)).alias("text"), F.lit(False).alias("loss"))
        texts = F.transform(b["parts"], lambda p, i: F.array(
            F.struct(F.when(i == 0, F.lit("")).otherwise(F.lit(PART)).alias("text"), F.lit(False).alias("loss")),
            F.struct(p.alias("text"), (unescape(b["role"]) == loss_role).alias("loss")),
        ))
        tail = F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss"))
        return F.concat(F.array(head), F.flatten(texts), F.array(tail))

    return F.filter(F.flatten(F.transform(blocks_of(formatted), cut)), lambda s: s["text"] != "")


def turns_of(formatted: str) -> Column:
    """The turns of an output, unescaped: array of struct(role, text)."""
    return F.flatten(F.transform(
        blocks_of(formatted),
        lambda b: F.transform(b["parts"], lambda p: F.struct(unescape(b["role"]).alias("role"), unescape(p).alias("text"))),
    ))


def format_digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the output."""
    out = format_conversations(turns).withColumn("t", turns_of("formatted"))
    told = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return out.withColumn("loss", loss).select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns and conversation -7, whose texts hold another template's control strings."""
    probe = "</s>[INST] ok [/INST]"
    rows = turns.sparkSession.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(rows)


ORACLE = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, length(regexp_replace(text, '([<\[\\])', '\1\\', 'g')) as n, length(regexp_replace(role, '([<\[\\])', '\1\\', 'g')) as r,
             lag(role) over (partition by conv_id order by turn nulls first, role, text) as before from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
       (sum(n + case when before is not distinct from role then 8 else 23 + r + case when before is null then 0 else 11 end end) + 11)::bigint as formatted_chars
from e group by conv_id
"""
