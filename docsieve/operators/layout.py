"""Names by their place on a card, where no label leads to them: folds over the lines with a small state, not patterns over the text.

Lines are read once and in order. A state tells where the search stands (before, inside, or after the lines that may hold a name) and what it has found.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import no_apostrophes, repair_given_name, repair_patronymic, strong_first_name
from .extract_words import PATRONYMIC_END, name_like, tokens

# --- fixed values: what ends a search for a patronymic, and the endings that mark a line with one ---
BIRTH_LINE = r"(?iu)tug['ʻʼ`]?il|birth|[0-9]{2}[./-][0-9]{2}[./-][0-9]{4}"
PATRONYMIC_MARKS = ("OVICH", "EVICH", "QIZI", "O'G'LI", "OGLI")
# --- end of fixed values ---


def patronymic_below(lines: Column, first_name: Column, repairs: tuple[tuple[str, str], ...] = ()) -> Column:
    """The first word with a patronymic's ending in the two lines below the first one that holds ``first_name``; a line of the birth date ends the search."""
    wanted = F.upper(first_name)
    # left: lines that may still be read, -1 before the first name's line
    start = F.struct(F.lit(-1).alias("left"), F.lit(None).cast("string").alias("found"))

    def word(line: Column) -> Column:
        fits = F.filter(tokens(line), lambda t: name_like(t, 4) & t.rlike(PATRONYMIC_END))
        return repair_patronymic(F.get(fits, 0), repairs)

    def step(s: Column, line: Column) -> Column:
        state = lambda left, found: F.struct(F.lit(left).cast("int").alias("left") if isinstance(left, int) else left.alias("left"), found.alias("found"))
        before = F.when(F.upper(line).contains(wanted), state(2, s["found"])).otherwise(s)
        inside = F.when(line.rlike(BIRTH_LINE), state(0, s["found"])).otherwise(state(s["left"] - 1, word(line)))
        return F.when(s["found"].isNotNull() | (s["left"] == 0), s).when(s["left"] < 0, before).otherwise(inside)

    return F.when(F.coalesce(first_name, F.lit("")) != "", F.aggregate(lines, start, step)["found"])


def given_between(lines: Column, surname: Column, first_name: Column, repairs: tuple[tuple[str, str], ...] = ()) -> Column:
    """``first_name``, or a better one from the lines between the surname's and the next with a patronymic's ending.

    A strong name of these lines replaces any; a weak one counts only where there was none. Of several sections each is read in turn.
    """
    null = F.lit(None).cast("string")
    plain = no_apostrophes(surname)
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("read"), null.alias("weak"), null.alias("strong"), first_name.alias("first"))

    def step(s: Column, line: Column) -> Column:
        up = F.upper(line)
        held = lambda inside, read, weak, strong, first: F.struct(F.lit(inside).alias("inside"), read.alias("read"), weak.alias("weak"), strong.alias("strong"), first.alias("first"))
        opened = F.when(up.contains(surname) | no_apostrophes(up).contains(plain), held(True, F.lit(0), null, null, s["first"])).otherwise(s)
        mark = F.lit(False)
        for m in PATRONYMIC_MARKS:
            mark = mark | up.contains(m)
        closed = held(False, F.lit(0), null, null, F.coalesce(s["strong"], s["first"], s["weak"]))
        fits = F.filter(F.transform(F.filter(tokens(line), lambda t: (t != surname) & name_like(t, 3)), lambda t: repair_given_name(t, surname, repairs)), lambda t: t.isNotNull())
        strong = F.get(F.filter(fits, strong_first_name), 0)
        # a name that is strong already is looked for in the first line of a section alone
        done = s["strong"].isNotNull() | ((s["read"] > 0) & strong_first_name(s["first"]))
        read = F.when(done, s).otherwise(held(True, s["read"] + 1, F.coalesce(s["weak"], F.get(fits, 0)), strong, s["first"]))
        return F.when(~s["inside"], opened).when(mark, closed).otherwise(read)

    return F.aggregate(lines, start, step)["first"]
