r"""Fill-in-middle transformation with counted quantifiers, in DataFrame functions only.

A text is a run of units: white space with the word after it, or white space at the end.
``regexp_count`` gives their number n. Two cuts 0 <= a <= b <= n come from a seeded hash of
the id. A pattern made for the row, ``\A((?:unit){a}+)((?:unit){b-a}+)(.*+)\z``, captures
prefix, middle and suffix in one match, and the replacement puts them in order between
control strings. The groups are possessive, so the matcher counts units in a loop: it
neither tries again nor needs stack for them, whatever the length of the text.

A text that holds a control string stays plain, and each control string starts with a
character that no control string has anywhere else. Therefore the output can be cut at
its control strings without doubt, which is how :func:`pieces` and :func:`restored` read it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Marks:
    """The control strings in front of prefix, suffix and middle."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        firsts = {m[:1] for m in marks}
        if not all(marks) or len(set(marks)) < 3 or any(f in m[1:] for f in firsts for m in marks):
            raise ValueError("control strings must differ, and start with a character they do not hold elsewhere")
        if any(a != b and a.startswith(b) for a in marks for b in marks):
            raise ValueError("no control string may start another one")
        if any(c in m for c in "$\\" for m in marks):
            raise ValueError("control strings must be free of $ and \\")


def hashes(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of an id: the first groups of eight digits of
    sha256("<seed>:<id>"); a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def transformed(documents: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80, marks: Marks = Marks()) -> DataFrame:
    """Per row of ``documents`` (doc_id, text, ...): row (the row itself), n, form, output.

    ``n`` is the number of units; ``form`` is plain, psm (prefix, suffix, middle) or spm
    (suffix, prefix, middle). A null or empty text, and one that holds a control string,
    is plain; a text of white space only is one unit. Rows of equal id and text give
    equal results, and a null id is hashed as an empty one. Any further columns stay in
    ``row``, whatever their names. Nothing is shuffled; a row is the unit of work.
    """
    text = F.coalesce(F.col("row.text"), F.lit(""))
    told = documents.select(F.struct("*").alias("row")).select("row", text.alias("text"), F.struct(*(h.alias(f"h{i}") for i, h in enumerate(hashes(F.col("row.doc_id"), seed), 1))).alias("h"))
    told = told.withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("bigint"))
    holds = F.contains("text", F.lit(marks.prefix)) | F.contains("text", F.lit(marks.suffix)) | F.contains("text", F.lit(marks.middle))
    plain = (F.col("text") == "") | holds | (F.col("h.h3") % 100 >= fim_percent)
    told = told.withColumn("form", F.when(plain, PLAIN).when(F.col("h.h4") % 100 < spm_percent, SPM).otherwise(PSM))
    one, other = F.col("h.h1") % (F.col("n") + 1), F.col("h.h2") % (F.col("n") + 1)
    told = told.withColumns({"a": F.least(one, other), "b": F.greatest(one, other)})
    times = lambda k: F.concat(F.lit(f"((?:{UNIT}){{"), k.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"(?s)\A"), times(F.col("a")), times(F.col("b") - F.col("a")), F.lit(r"(.*+)\z"))
    order = F.when(F.col("form") == SPM, f"{marks.suffix}$3{marks.prefix}$1{marks.middle}$2").otherwise(f"{marks.prefix}$1{marks.suffix}$3{marks.middle}$2")
    return told.select("row", "n", "form", F.when(F.col("form") == PLAIN, F.col("text")).otherwise(F.regexp_replace("text", pattern, order)).alias("output"))


def pieces(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """struct(prefix, middle, suffix) of an output, cut at its control strings; null if plain."""

    def between(first: str, second: str) -> Column:
        start = F.instr(output, first) + len(first)
        return F.substr(output, start, F.instr(output, second) - start)

    middle = F.substr(output, F.instr(output, marks.middle) + len(marks.middle))
    psm = F.struct(between(marks.prefix, marks.suffix).alias("prefix"), middle.alias("middle"), between(marks.suffix, marks.middle).alias("suffix"))
    spm = F.struct(between(marks.prefix, marks.middle).alias("prefix"), middle.alias("middle"), between(marks.suffix, marks.prefix).alias("suffix"))
    return F.when(form == PSM, psm).when(form == SPM, spm)


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The exact text, from output and form alone."""
    cut = pieces(output, form, marks)
    return F.when(form == PLAIN, output).otherwise(F.concat(cut["prefix"], cut["middle"], cut["suffix"]))
