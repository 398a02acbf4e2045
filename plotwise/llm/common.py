"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import dropped, written

#: A word: a run of code points other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def guarded(docs: DataFrame, own: Iterable[str]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """``docs`` with all columns but ``own`` under names that no operator uses, and the pairs (old, new) of names.

    So an extra column may be called what an operator calls one of its own, or one that it reads in another case. A
    column of exactly the name is the one that is read, else the first with the name in another case.
    """
    old, places = docs.columns, {}
    for name in own:
        same = [i for i, c in enumerate(old) if c == name] or [i for i, c in enumerate(old) if c.lower() == name.lower()]
        if same:
            places[same[0]] = name
    new = [places.get(i, f"_x{i}") for i in range(len(old))]
    return docs.toDF(*new), list(zip(old, new, strict=True))


def picked(docs: DataFrame, *names: str) -> DataFrame:
    """These columns of ``docs`` alone, whatever the others are called."""
    return guarded(docs, names)[0].select(*names)


def restored(df: DataFrame, names: list[tuple[str, str]], added: Iterable[str] = ()) -> DataFrame:
    """The columns that :func:`guarded` renamed, under their names again, and those ``added``, which replace their namesakes."""
    taken = {a.lower() for a in added}
    return df.select(*[F.col(new).alias(old) for old, new in names if old.lower() not in taken], *added)


def joined_to_one(rows: DataFrame, keyed: DataFrame, key: str, how: str = "inner", heavy: int = 1000, most_heavy: int = 100_000) -> DataFrame:
    """``rows`` joined on ``key`` with ``keyed``, a written table of one row a key with ``_n``, the rows that have it.

    Keys of more than ``heavy`` rows are broadcast, so their rows stay where they are and no task gets a hot key; the
    others meet by shuffle. ``heavy`` rises with the rows, so that ``most_heavy`` keys are broadcast at most. Where there
    are such keys ``rows`` is computed twice. ``how``: ``inner`` or ``left_semi``. Null keys match nothing.
    """
    total, largest = keyed.agg(F.sum("_n"), F.max("_n")).first()
    heavy = max(heavy, -(-(total or 0) // most_heavy))
    named = keyed.drop("_n") if how == "inner" else keyed.select(key)
    if (largest or 0) <= heavy:
        return rows.join(named, key, how)
    hot, rest = (keyed.where(F.col("_n") > heavy), keyed.where(F.col("_n") <= heavy))
    hot, rest = (k.select(*named.columns) for k in (hot, rest))
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key, how).unionByName(others.join(rest, key, how))


def sent_if_few(rows: DataFrame, n: int, most: int = 1_000_000) -> DataFrame:
    """``rows``, broadcast to what they are joined with if ``n``, a count of them, is ``most`` at most; else they meet it by shuffle."""
    return F.broadcast(rows) if n <= most else rows


_OF_WORKER: dict = {}


def once(key: tuple, make: Callable):
    """``make()``, once for each ``key`` in a Python worker, for its later tasks too; the last four are held."""
    if key not in _OF_WORKER:
        while len(_OF_WORKER) >= 4:
            _OF_WORKER.pop(next(iter(_OF_WORKER)))
        _OF_WORKER[key] = make()
    return _OF_WORKER[key]


def words_of(text: Column) -> Column:
    """Array of the words of ``text``; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def unit_hash(seed: int, *keys: Column) -> Column:
    """Uniform number in [0, 1) that depends on ``seed`` and ``keys`` alone (first 52 bits of an MD5)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))
