"""Chat formatting with a grammar round trip, in DataFrame functions only.

The output of a conversation is a sequence of turns

    <|im_start|>ROLE LF BODY <|im_end|> LF          a body written as it is
    <|im_start|>ROLE <|esc|> LF BODY <|im_end|> LF  a body (and role) with escapes

and is read by a deterministic parser: cut at each ``<|im_start|>``, cut the header off at the first line feed, end the
body at the first ``<|``, undo the escapes if the header ends in ``<|esc|>``. Every conversation is first rendered as it
is and parsed. If the turns read back are not those of the source, the turns whose own text conflicts are rendered
anew with escapes: a backslash becomes two, ``<|`` becomes ``<`` backslash ``|``, and a line feed in a role becomes
backslash ``n``. Should that not read back identical, all turns are escaped; a difference after that is an error.

The turns of one conversation are gathered in one row, since its output is one text; nothing else is grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
START, END, ESCAPED = "<|im_start|>", "<|im_end|>", "<|esc|>"


def _escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def _escape_role(role: Column) -> Column:
    return F.replace(_escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape(text: Column) -> Column:
    # Runs of backslashes are cut into pairs from the left, which leaves only those of the other escapes.
    parts = F.split(text, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("<\\|"), F.lit("<|")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(plain, "\\")


def _render(turns: Column, which: Column | None) -> Column:
    """The text of all turns; ``which`` says of each turn (by index) whether it is escaped; None: no turn."""

    def one(turn: Column, i: Column) -> Column:
        raw = F.concat(F.lit(START), turn["role"], F.lit("\n"), turn["text"], F.lit(END + "\n"))
        if which is None:
            return raw
        safe = F.concat(F.lit(START), _escape_role(turn["role"]), F.lit(ESCAPED + "\n"), _escape(turn["text"]), F.lit(END + "\n"))
        return F.when(F.get(which, i), safe).otherwise(raw)

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: an array of role, text, whether the body was escaped, and its written form."""
    cut = F.split(formatted, r"<\|im_start\|>", -1)
    blocks = F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0)))

    def read(block: Column) -> Column:
        at = F.locate("\n", block)
        head, rest = F.substr(block, F.lit(1), F.greatest(at - 1, F.lit(0))), F.substr(block, at + 1)
        body = F.substr(rest, F.lit(1), F.greatest(F.locate("<|", rest) - 1, F.lit(0)))
        safe = F.endswith(head, F.lit(ESCAPED))
        role = F.when(safe, _unescape(F.substr(head, F.lit(1), F.length(head) - len(ESCAPED)))).otherwise(head)
        return F.struct(role.alias("role"), F.when(safe, _unescape(body)).otherwise(body).alias("text"), safe.alias("escaped"), body.alias("written"))

    return F.transform(blocks, read)


def _read_back(formatted: Column) -> Column:
    return F.transform(parse(formatted), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``formatted``: one row for each conversation, its turns in order.

    Turns with the same number follow role and text; repeated rows are repeated turns; null turn numbers come first;
    null roles and texts are empty; a row with a null conversation is a conversation of its own with a null id; an empty
    table gives no rows; other columns are ignored.
    """
    rows = df.select(
        F.col(conv).alias("conv"),
        F.when(F.col(conv).isNull(), F.monotonically_increasing_id()).alias("alone"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    gathered = rows.groupBy("conv", "alone").agg(F.array_sort(F.collect_list("t")).alias("sorted"))
    turns = gathered.select("conv", F.transform("sorted", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    first = turns.withColumn("formatted", _render(F.col("turns"), None))
    first = first.withColumn("same", _read_back(F.col("formatted")) == F.col("turns"))
    clash = F.transform("turns", lambda t: F.contains(t["text"], F.lit("<|")) | F.contains(t["role"], F.lit("<|")) | F.contains(t["role"], F.lit("\n")))
    second = first.withColumn("formatted", F.when(F.col("same"), F.col("formatted")).otherwise(_render(F.col("turns"), clash)))
    second = second.withColumn("same", F.col("same") | (_read_back(F.col("formatted")) == F.col("turns")))
    every = F.transform("turns", lambda t: F.lit(True))
    third = second.withColumn("formatted", F.when(F.col("same"), F.col("formatted")).otherwise(_render(F.col("turns"), every)))
    wrong = ~F.col("same") & (_read_back(F.col("formatted")) != F.col("turns"))
    checked = F.when(wrong, F.raise_error(F.lit("a formatted conversation does not read back"))).otherwise(F.col("formatted"))
    return third.select(F.col("conv").alias(conv), checked.alias("formatted"))


def loss_spans(formatted: Column, speaker: str = "assistant") -> Column:
    """The loss mask as spans (start from 0, end; code points of the formatted text) of the written bodies of a role's
    turns, and whether they are escaped."""
    turns = parse(formatted)

    def step(state: Column, t: Column) -> Column:
        head = F.length(F.when(t["escaped"], F.concat(_escape_role(t["role"]), F.lit(ESCAPED))).otherwise(t["role"])) + len(START) + 1
        begin = state["at"] + head
        end = begin + F.length(t["written"])
        span = F.struct(begin.alias("start"), end.alias("end"), t["escaped"].alias("escaped"))
        return F.struct(
            (end + len(END) + 1).alias("at"),
            F.when(t["role"] == speaker, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,escaped:boolean>>").alias("spans"))
    return F.aggregate(turns, empty, step, lambda s: s["spans"])


def summarize(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of what is read back from formatted texts: the turns, and the text under the loss mask, unescaped."""
    read = formatted.select(conv, "formatted", parse(F.col("formatted")).alias("turns"))
    under = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(conv, F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), under.alias("loss"), "formatted").select(
        conv,
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
