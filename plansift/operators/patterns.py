"""Which of many patterns occur in which texts, in one pass over the texts, however many patterns there are.

Every pattern must contain a piece of plain text. All pieces together make one automaton (Aho-Corasick), which goes to every task once and is run over each text once; only
the patterns whose piece is there are then tried themselves, by Spark's own regular expressions. Patterns without such a piece are tried on every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


def _fold(text: str) -> str:
    """Letters that match in any case become the same ones."""
    return text.casefold().replace("̇", "")


def required_text(pattern: str) -> str:
    """The longest piece of plain text, folded, that all that the pattern matches contains; '' if there is none at the pattern's top level."""
    from re import _constants as kinds
    from re import _parser as parser

    best, run = "", ""
    for kind, value in [*parser.parse(pattern, 0), (None, None)]:
        if kind is kinds.LITERAL:
            run += chr(value)
            continue
        if kind is kinds.AT:  # an edge of a word or a line takes no room
            continue
        if len(_fold(run)) > len(best):
            best = _fold(run)
        run = ""
    return best


def _by_letter(words: list[str]) -> str:
    """A regular expression for any of the words, which share what they begin with."""
    rests: dict[str, list[str]] = {}
    for w in words:
        rests.setdefault(w[:1], []).append(w[1:])
    found = [re.escape(first) + _by_letter(some) if first else "" for first, some in sorted(rests.items(), reverse=True)]
    return found[0] if len(found) == 1 else f"(?:{'|'.join(found)})"


def any_of(patterns: Iterable[str]) -> str:
    """A regular expression that occurs where any of the patterns does. Plain words and texts are tried by their letters, at places that begin with one of the first, not one after the other."""
    words, texts, others = [], [], []
    for p in dict.fromkeys(patterns):
        if m := re.fullmatch(r"\\b([\w' -]*\w)\\b", p):
            words.append(m[1])
        elif re.fullmatch(r"[\w\u0c00-\u0c7f' -]+", p):
            texts.append(p)
        else:
            others.append(p)
    begin = lambda some: "(?=[" + "".join(re.escape(c) for c in sorted({w[0] for w in some})) + "])"
    tried = [begin(words) + r"\b" + _by_letter(words) + r"\b"] if words else []
    return "|".join([*tried, *([begin(texts) + _by_letter(texts)] if texts else []), *others])


def _finder(pieces: list[str]):
    """A column function: the numbers of the pieces that a text contains, each once; blank pieces are left out."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        held: dict[str, list[int]] = {}
        for n, piece in enumerate(pieces):
            if piece:
                held.setdefault(piece, []).append(n)
        automaton = ahocorasick.Automaton()
        for piece, numbers in held.items():
            automaton.add_word(piece, numbers)
        if held:
            automaton.make_automaton()
        for texts in parts:
            yield pd.Series([sorted({n for _, numbers in automaton.iter(_fold(t)) for n in numbers}) if t and held else [] for t in texts], dtype="object")

    return found


def hits(df: DataFrame, text: Column, patterns: Mapping[str, str], name: str = "pattern") -> DataFrame:
    """df's rows once for each pattern (name -> regular expression, in any case) that occurs in the text, with its name; rows without any, and null texts, go."""
    names, regexes = list(patterns), list(patterns.values())
    if not names:
        return df.withColumn(name, F.lit("")).limit(0)
    pieces = [required_text(r) for r in regexes]
    always = [n for n, piece in enumerate(pieces) if not piece]
    rows = df.withColumn("_text", text.cast("string")).filter(F.col("_text").isNotNull())
    maybe = F.concat(_finder(pieces)("_text"), F.array(*map(F.lit, always)).cast("array<int>"))
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit("(?iu)" + r).alias("regex")) for n, r in zip(names, regexes)])
    rows = rows.withColumn("_n", F.explode(maybe)).withColumn("_p", F.get(table, F.col("_n")))
    return rows.filter(F.expr("_text rlike _p.regex")).withColumn(name, F.col("_p.name")).drop("_text", "_n", "_p")
