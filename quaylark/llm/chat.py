"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation:

    conversation := turn*
    turn         := "[INST]" role LF text "[/INST]"      (any role but assistant)
                  | "<s>" role LF text "</s>"            (assistant; its text is under the loss mask)

A turn is first rendered as it is. A deterministic parser cuts the rendered string at
the control strings and takes the escapes back; where the turns it recovers differ
from the source, the turn is rendered anew with its conflicting content escaped. The
escapes are reversible for any text, so the second rendering always reads back alike;
the whole conversation is parsed once more and a difference stops the job.

Edge cases: null texts and roles are empty; turns are ordered by turn, then role, then
text (repeated turns all stay); a null conv_id is a conversation of its own; a
conversation is one string and so one row, as its digests are over the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"
#: What is escaped, and the digit after the escape sign that stands for it.
CONTROL = (("<s>", "1"), ("</s>", "2"), ("[INST]", "3"), ("[/INST]", "4"))
_ANY = r"<s>|</s>|\[INST\]|\[/INST\]"
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    """Escape signs first, then control strings; every escape sign is then followed by a digit."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    for string, digit in CONTROL:
        out = F.replace(out, F.lit(string), F.lit(ESCAPE + digit))
    return out


def unescaped(text: Column) -> Column:
    """The reverse of ``escaped``: control strings first, escape signs last."""
    out = text
    for string, digit in CONTROL:
        out = F.replace(out, F.lit(ESCAPE + digit), F.lit(string))
    return F.replace(out, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit(ESCAPE + "5"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit(ESCAPE + "5"), F.lit("\n")))


def rendered(role: Column, text: Column) -> Column:
    inner = F.concat(role, F.lit("\n"), text)
    return F.when(role == ASSISTANT, F.concat(F.lit("<s>"), inner, F.lit("</s>"))).otherwise(F.concat(F.lit("[INST]"), inner, F.lit("[/INST]")))


def parsed(formatted: Column) -> Column:
    """array<struct<role,text,masked>> of a formatted string; null where it is not of the grammar.

    Cutting at control strings gives an empty piece before, between and after the
    turns, and the inside of a turn at every second place.
    """
    pieces = F.split(formatted, _ANY, -1)
    marks = F.regexp_extract_all(formatted, F.lit(_ANY), F.lit(0))
    kinds = F.array_join(marks, "")
    insides = F.filter(pieces, lambda p, i: i % 2 == 1)
    opens = F.filter(marks, lambda p, i: i % 2 == 0)
    turns = F.zip_with(insides, opens, _turn)
    whole = kinds.rlike(r"^(?:<s></s>|\[INST\]\[/INST\])*+$") & F.forall(F.filter(pieces, lambda p, i: i % 2 == 0), lambda p: p == "")
    return F.when(whole, turns)


def _turn(piece: Column, opened: Column) -> Column:
    role = F.substring_index(piece, "\n", 1)
    return F.struct(unescaped_role(role).alias("role"), unescaped(F.substr(piece, F.length(role) + 2)).alias("text"), (opened == "<s>").alias("masked"))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans, n_turns, n_escaped); a loss span is (start, end) in code points."""
    empty = F.lit("")
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), empty).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), empty).alias("text"),
    )
    raw = rendered(F.col("role"), F.col("text"))
    same = lambda c, role, text: (F.size(c) == 1) & (c[0]["role"] == role) & (c[0]["text"] == text)
    rows = rows.withColumn("raw", raw).withColumn("back", parsed(F.col("raw")))
    clear = F.coalesce(same(F.col("back"), F.col("role"), F.col("text")), F.lit(False))
    rows = rows.withColumn("clear", clear).withColumn("out", F.when(F.col("clear"), F.col("raw")).otherwise(rendered(escaped_role(F.col("role")), escaped(F.col("text")))))
    gathered = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "out"))).alias("turns"),
        F.count_if(~F.col("clear")).alias("n_escaped"),
    )
    whole = gathered.withColumn("formatted", F.array_join(F.col("turns")["out"], "")).withColumn("read", parsed(F.col("formatted")))
    alike = F.coalesce(F.transform("read", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), F.lit(False))
    checked = F.when(alike, F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("conversation does not read back alike: "), F.col("conv_id").cast("string"))).cast("string"))
    return whole.select("conv_id", checked.alias("formatted"), F.size("turns").cast("long").alias("n_turns"), "n_escaped").withColumn("loss_spans", loss_spans(F.col("formatted")))


def loss_spans(formatted: Column) -> Column:
    """array<struct<start,end>>: places of the assistant texts inside a formatted conversation."""
    pieces = F.split(formatted, _ANY, -1)
    marks = F.regexp_extract_all(formatted, F.lit(_ANY), F.lit(0))
    kind = "array<struct<start:int,end:int>>"

    def step(acc: Column, x: Column) -> Column:
        piece, mark = x["p"], x["m"]
        begin = acc["at"] + F.length(F.substring_index(piece, "\n", 1)) + 1
        end = acc["at"] + F.length(piece)
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + F.coalesce(F.length(mark), F.lit(0))).alias("at"), F.when(mark == "</s>", F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    zipped = F.zip_with(pieces, marks, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def report(formatted: DataFrame) -> DataFrame:
    """Digests of ``format_conversations`` rows, read back from the formatted strings."""
    read = formatted.withColumn("read", parsed(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    turns = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
