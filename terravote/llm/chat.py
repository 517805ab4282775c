"""Chat formatting (operator 6): token-budgeted windows of turns with loss masks; DataFrame functions only.

Template of a turn: ``<|turn|>role<|body|>text<|end|>``.  Inside roles and texts a backslash is doubled, and every control
string, of this template or of others in use, gets a backslash after its first character; removing each backslash that
stands before another character gives the text back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_small, prefix_sums, saved, table

# Control strings.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
CONTROL = [TURN, BODY, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]

#: Tokens of a window, all of it, and of them at most for history that is repeated before the new turns.
BUDGET, HISTORY = 1024, 256
#: Turns that may be repeated.
LOOK_BACK = 8
#: Turn numbers of a range within which running sums are sorted, and turns of a range in which windows are chosen.
RANGE = 4096
#: The unit of the budget: words, digits and marks as a byte-pair pattern cuts them before merging.
PRE_TOKEN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"


def escape(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + "\\" + c[1:])), CONTROL, F.replace(text, F.lit("\\"), F.lit("\\\\")))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _length(text: Column) -> Column:
    return F.char_length(text)


def _spans(numbered: DataFrame, budget: int, history: int) -> DataFrame:
    """(conv_id, first, upto, back) of every window: its new turns, and how many turns before them are repeated.

    Greedy, along prefix sums: a window takes turns as long as the system turn, the history and they fit the budget.  Its
    history are the last turns before it, at most LOOK_BACK, that fit ``history`` tokens and what the budget leaves
    beside the system turn and the window's first turn.  Windows are chosen within ranges of RANGE turns, which begin a
    window each, so a row here holds a bounded number of turns whatever a conversation's length; a range sees the turns
    that it may repeat of the range before.
    """
    n = numbered.select("conv_id", "pos", "before", "tokens", "head", F.expr(f"pos div {RANGE}").alias("range"))
    late = F.expr(f"pos % {RANGE} >= {RANGE - LOOK_BACK}")
    shown = n.select("*", F.explode(F.when(late, F.array(F.col("range"), F.col("range") + 1)).otherwise(F.array("range"))).alias("of"))
    rows = shown.groupBy("conv_id", "of").agg(F.sort_array(F.collect_list(F.struct("pos", "before", "tokens", "head"))).alias("t"))
    rows = rows.filter(F.expr(f"t[size(t) - 1].pos >= of * {RANGE}"))
    system = numbered.filter("head").select("conv_id", F.col("tokens").alias("s"))
    rows = join_small(rows, saved(system), ["conv_id"]).select("conv_id", "of", "t", F.coalesce("s", F.lit(0).cast("long")).alias("s"))
    # What is repeated before turn i: the most turns of those before it, short of the system turn, whose tokens fit ``room``.
    fits = f"filter(sequence(1, {LOOK_BACK}), b -> i - b >= 0 and not t[i - b].head and t[i].before - t[i - b].before <= least({history}L, {budget} - s - t[i].tokens))"
    open_ = f"transform(array(coalesce(array_max({fits}), 0)), b -> struct(t[i].pos as first, b as back, t[i].tokens + if(t[i].head, 0L, s) + t[i].before - t[i - b].before as used))[0]"
    state = "struct(cast(null as struct<first:bigint,back:int,used:bigint>) as w, cast(array() as array<struct<first:bigint,back:int,used:bigint>>) as done)"
    step = f"""case when t[i].pos < of * {RANGE} then a
        when a.w.used + t[i].tokens <= {budget} then struct(struct(a.w.first as first, a.w.back as back, a.w.used + t[i].tokens as used) as w, a.done as done)
        else struct({open_} as w, if(a.w is null, a.done, array_append(a.done, a.w)) as done) end"""
    run = f"aggregate(sequence(0, size(t) - 1), {state}, (a, i) -> {step}, a -> array_append(a.done, a.w))"
    rows = rows.withColumn("w", F.expr(run)).withColumn("end", F.expr("t[size(t) - 1].pos + 1"))
    cut = "transform(w, (x, k) -> struct(x.first as first, coalesce(get(w, k + 1).first, end) as upto, x.back as back))"
    return rows.select("conv_id", F.explode(F.expr(cut)).alias("x")).select("conv_id", "x.*")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, first, n_new, n_context, n_tokens, has_system, formatted, loss array<struct<start,
    length>>.

    One budget holds for the whole window: the conversation's system turn, which every window retains, the turns repeated
    before the new ones, and the new turns.  Only a window of a single new turn that is too long beside the system turn
    exceeds it, as turns are not cut; it repeats nothing else.  Tokens are counted as pre-tokens of a byte-pair pattern and
    three marks a turn, as merging has no native form.  Only assistant texts of new turns are under the mask, each in one
    window alone.

    Sums, spans and texts are found without bringing a conversation into one task: rows are sorted within ranges of turns,
    and a window's size is bounded by the budget and its longest turn.
    """
    t = turns.select("conv_id", "turn", "role", "text")
    t = t.withColumn("tie", F.xxhash64("turn", "role", "text")).withColumn("tokens", (F.regexp_count(F.concat_ws(" ", "role", "text"), F.lit(PRE_TOKEN)) + 3).cast("long")).withColumn("one", F.lit(1).cast("long"))
    order = [F.asc_nulls_last("turn"), F.asc("tie")]
    cell = F.when(F.col("turn").isNull(), F.lit(2**61) + F.shiftright("tie", 50)).otherwise(F.floor(F.col("turn") / RANGE))
    t = prefix_sums(t, ["conv_id"], cell, order, {"before": "tokens", "pos": "one"})
    t = t.withColumn("head", (F.col("pos") == 0) & (F.col("role") == "system"))
    t = t.withColumn("body", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY), escape(F.col("text")), F.lit(END))).withColumn("target", F.col("role") == "assistant")
    t = t.withColumn("lead", _length(F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY)))).withColumn("masked", _length(escape(F.col("text"))))
    t = saved(t.select("conv_id", "pos", "before", "tokens", "head", "body", "target", "lead", "masked"))
    spans = saved(_spans(t.select("conv_id", "pos", "before", "tokens", "head"), budget, history))
    # Which turns a window holds is found on positions alone; then texts are fetched, once for each window they are in.
    whose = spans.select(F.col("conv_id").alias("c"), F.col("first").alias("window"), F.explode(F.expr("transform(sequence(first - back, upto - 1), p -> struct(p as pos, if(p < first, 1, 2) as kind))")).alias("x")).select("c", "window", F.col("x.pos").alias("p"), F.col("x.kind").alias("kind"))
    met = t.join(whose, t["conv_id"].eqNullSafe(F.col("c")) & (t["pos"] == F.col("p")))
    piece = F.struct("kind", "pos", "body", (F.col("target") & (F.col("kind") == 2)).alias("target"), "lead", "masked", "tokens").alias("p")
    parts = met.select("conv_id", "window", piece)
    system = saved(t.filter("head").select("conv_id", "pos", "body", "target", "lead", "masked", "tokens"))
    s = join_small(spans.filter("first > 0").select("conv_id", F.col("first").alias("window")), system, ["conv_id"], "inner").withColumn("kind", F.lit(0))
    w = parts.unionByName(s.select("conv_id", "window", piece)).groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("p")).alias("p")).withColumn("first", F.col("window"))
    w = w.withColumn("formatted", F.array_join(F.transform("p", lambda x: x["body"]), ""))
    run = F.aggregate(
        "p",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss")),
        lambda a, x: F.struct((a["at"] + _length(x["body"])).alias("at"), F.when(x["target"], F.concat(a["loss"], F.array(F.struct((a["at"] + x["lead"]).alias("start"), x["masked"].alias("length"))))).otherwise(a["loss"]).alias("loss")),
    )
    count = lambda kind: F.size(F.filter("p", lambda x: x["kind"] == kind))
    tokens = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return w.select("conv_id", "window", "first", count(2).alias("n_new"), (count(0) + count(1)).alias("n_context"), tokens.alias("n_tokens"), (count(0) > 0).alias("has_system"), "formatted", run["loss"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Windows are parsed by their marks; repeated turns are the first n_context.  A digest of a whole conversation needs its
    texts in one value, so this reading, unlike the windows, holds one conversation per row; its parts are collected per
    window, in map-side combined lists.
    """
    turns = F.slice(F.split(F.col("formatted"), r"<\|turn\|>"), F.lit(2) + F.col("n_context"), F.greatest(F.col("n_new"), F.lit(0)))
    said = F.transform(turns, lambda t: F.concat(unescape(F.substring_index(t, BODY, 1)), F.lit("\n"), unescape(F.regexp_replace(F.substring(t, F.instr(t, BODY) + len(BODY), _length(t)), r"(?s)<\|end\|>\z", "")), F.lit("\n")))
    loss = F.transform("loss", lambda x: unescape(F.substring("formatted", x["start"] + 1, x["length"])))
    w = formatted.select("conv_id", "first", F.col("n_new").cast("long").alias("n_new"), F.array_join(said, "").alias("said"), F.array_join(loss, "").alias("learned"), _length(F.col("formatted")).cast("long").alias("chars"))
    c = w.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first", "said", "learned"))).alias("w"), F.sum("n_new").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    text = F.array_join(F.transform("w", lambda x: x["said"]), "")
    learned = F.array_join(F.transform("w", lambda x: x["learned"]), "")
    return c.select("conv_id", "n_turns", F.sha2(text, 256).alias("turns_sha256"), _length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), "formatted_chars")


def format_chats(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """The windows of every conversation, see ``windows``.

    Rows are ordered by turn, null turns last, then by a hash of role and text.  Null text or role: empty.  Null conv_id:
    one conversation of its own.  Repeated rows: a turn each.  Empty and very long texts are turns like any other; nothing
    is cut.  Empty table: no rows.  Other columns are ignored, whatever their names.
    """
    t = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return windows(t, budget, history)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return read_back(saved(format_chats(rows)))
