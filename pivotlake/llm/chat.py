r"""Chat formatting with a grammar that is read back, in DataFrame functions only.

The grammar: a conversation is a sequence of turns, each

    ### <role>: <text></turn>\n

with ``### `` and ``</turn>`` as its only control strings. The parser cuts the text at
every control string; the pieces between must alternate between turns and line ends.

Conflicting content is escaped in steps, until the parser gives back the very turns
that went in: (0) as it is; (1) control strings replaced by codes of a backslash and a
letter; (2) backslashes too. Step 2 can always be read back: each backslash it leaves
is followed by one letter, and codes are replaced in the opposite order. A role's colon
has a code from step 1 on. The parser decodes all codes at any step, so it need not be
told the step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE, AFTER_ROLE = "### ", "</turn>", ": "
# Codes in the order of encoding; backslashes first, and only in the last step.
BACKSLASH = ("\\", "\\b")
CODES = ((OPEN, "\\h"), (CLOSE, "\\e"))
COLON = (":", "\\c")
STEPS = (0, 1, 2)


def _swap(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def encode(text: Column, step: int, role: bool = False) -> Column:
    pairs = ((BACKSLASH,) if step > 1 else ()) + (CODES if step else ()) + ((COLON,) if step and role else ())
    return _swap(text, pairs)


def decode(text: Column) -> Column:
    return _swap(text, [(new, old) for old, new in (COLON, *reversed(CODES), BACKSLASH)])


def _write(turns: Column, step: int) -> Column:
    one = lambda t: F.concat(F.lit(OPEN), encode(t["role"], step, True), F.lit(AFTER_ROLE), encode(t["text"], step), F.lit(CLOSE + "\n"))
    return F.array_join(F.transform(turns, one), "")


def pieces(formatted: Column) -> Column:
    """What lies between control strings: "" or a line end, a turn, a line end, a turn, ..."""
    return F.split(formatted, "### |</turn>")


def parse(formatted: Column) -> Column:
    """Turns (role, text) that the grammar finds; null where the text is not of the grammar."""
    parts = pieces(formatted)
    bodies = F.filter(parts, lambda _, i: i % 2 == 1)
    between = F.filter(parts, lambda _, i: i % 2 == 0)
    sound = (F.size(parts) % 2 == 1) & (parts[0] == "") & F.forall(F.slice(between, 2, F.size(between)), lambda x: x == "\n")
    sound = sound & F.forall(bodies, lambda b: F.contains(b, F.lit(AFTER_ROLE)))

    def turn(body: Column) -> Column:
        role = F.substring_index(body, AFTER_ROLE, 1)
        return F.struct(decode(role).alias("role"), decode(F.substr(body, F.length(role) + len(AFTER_ROLE) + 1)).alias("text"))

    return F.when(formatted == "", F.array().cast("array<struct<role:string,text:string>>")).when(sound, F.transform(bodies, turn))


def formatted(conversations: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, step, turns and the loss mask.

    ``conversations`` has one row per turn: conv_id, turn, role, text. Turns are ordered
    by turn, then role and text, nulls first; repeated rows are repeated turns. A null
    role or text counts as empty; rows without conv_id make up one conversation. ``turns``
    are read back from ``formatted``. The mask is an array of runs (chars, loss) that
    cover ``formatted``: loss is true for the texts of ``trained`` turns. One conversation
    has to fit into memory, as its text does.
    """
    empty = F.lit("")
    turns = conversations.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")))).alias("source")
    )
    turns = turns.select("conv_id", F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    tried = turns
    for step in STEPS[:-1]:
        tried = tried.withColumn(f"text{step}", _write(F.col("source"), step))
    good = {step: F.coalesce(parse(F.col(f"text{step}")) == F.col("source"), F.lit(False)) for step in STEPS[:-1]}
    step = F.when(good[0], 0).when(good[1], 1).otherwise(2)
    tried = tried.withColumn("step", step)
    written = F.when(F.col("step") == 0, F.col("text0")).when(F.col("step") == 1, F.col("text1")).otherwise(_write(F.col("source"), 2))
    done = tried.select("conv_id", "source", "step", written.alias("formatted"))

    def runs(part: Column, i: Column) -> Column:
        """Mask runs of one piece with the control string after it."""
        role = F.substring_index(part, AFTER_ROLE, 1)
        head = F.length(role) + len(AFTER_ROLE)
        return F.when(i % 2 == 0, F.array(_run(F.length(part) + F.lit(len(OPEN)), F.lit(False)))).otherwise(
            F.array(_run(head, F.lit(False)), _run(F.length(part) - head, decode(role) == trained), _run(F.lit(len(CLOSE)), F.lit(False)))
        )

    parts = pieces(F.col("formatted"))
    # The last piece is the line end after the last turn: no control string follows it.
    mask = F.flatten(F.transform(F.slice(parts, 1, F.size(parts) - 1), runs))
    return done.select("conv_id", "formatted", "step", parse(F.col("formatted")).alias("turns"), F.concat(mask, F.array(_run(F.lit(1), F.lit(False)))).alias("mask"))


def _run(chars: Column, loss: Column) -> Column:
    return F.struct(chars.cast("bigint").alias("chars"), loss.alias("loss"))


def loss_texts(formatted: Column, mask: Column) -> Column:
    """The decoded texts under the mask, in order, found by the mask alone.

    The parser's pieces are laid over the mask: text runs are every fourth run from the
    third on, so no prefix of the text is walked again for each run.
    """
    bodies = F.filter(pieces(formatted), lambda _, i: i % 2 == 1)
    text_runs = F.filter(mask, lambda _, i: i % 4 == 2)
    under = F.filter(F.arrays_zip(bodies.alias("body"), text_runs.alias("run")), lambda z: z["run"]["loss"])
    return F.transform(under, lambda z: decode(F.right(z["body"], z["run"]["chars"].cast("int"))))
