"""Texts cut into pieces as a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import functions as F

#: Where a text may be cut, the coarsest first; what has none of them left is cut by characters.
SEPARATORS = ("\n\n", "\n", " ")
#: Characters that stand for a token where a text has no separators.
CHARACTERS = 3.5


def pieces(text: str | None, most: int) -> Iterator[str]:
    """Pieces of at most ``most`` words that together are the text. Each level of separators fills pieces greedily with
    the parts between them, separators staying at the ends of parts; a part that is too large ends the piece in hand and
    is cut by the next level. A word is never above ``most``, so characters only cut what blanks can't."""
    todo = [(text or "", 0)]
    while todo:
        part, level = todo.pop()
        if len(part.split()) <= most:
            if part:
                yield part
        elif level == len(SEPARATORS):
            size = max(1, int(most * CHARACTERS))
            yield from (part[i : i + size] for i in range(0, len(part), size))
        else:
            todo += reversed([(run, level + 1) for run in runs(part, SEPARATORS[level], most)])


def runs(text: str, separator: str, most: int) -> Iterator[str]:
    """Neighbouring parts put together while they stay within ``most`` words; a larger part is alone."""
    *ended, rest = text.split(separator)
    held, used = [], 0
    for part in [*(p + separator for p in ended), rest]:
        n = len(part.split())
        if held and used + n > most:
            yield "".join(held)
            held, used = [], 0
        held.append(part)
        used += n
    if held:
        yield "".join(held)


@F.udtf(returnType="piece_no: int, piece: string")
class split_text:  # noqa: N801  (called like a function)
    """``piece_no, piece``: a row for each piece of a text, numbered from 0; none for a null or empty text. Used as
    ``df.lateralJoin(split_text(F.col("text").outer(), F.lit(200)))``."""

    def eval(self, text: str, most: int):
        yield from enumerate(pieces(text, most))
