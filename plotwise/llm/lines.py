"""Line dedup by content-defined chunks, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, dropped, guarded, joined_to_one, restored, sent_if_few, written

ADDED = ["n_lines", "n_removed_lines", "n_removed_chunks"]


def chunk_ends(lines: Column, divisor: int) -> Column:
    """Index of the last line of each chunk.

    A rolling hash runs over the hashes of a line and the line before; a chunk ends where ``divisor`` divides it. So
    boundaries depend on two lines alone and come back after lines were put in or taken out.
    """
    hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))
    rolled = F.transform(F.array(hashes), lambda h: F.transform(h, lambda x, i: F.pmod(F.coalesce(F.get(h, i - 1), F.lit(0)) * 31 + x, F.lit(divisor)) == 0))
    last = F.size(lines) - 1
    marked = F.transform(F.get(rolled, F.lit(0)), lambda ends, i: F.when(ends | (i == last), i))
    return F.filter(marked, lambda i: i.isNotNull())


def with_chunks(docs: DataFrame, divisor: int) -> DataFrame:
    """``docs`` with ``_chunks``, an array of (text, lines): joined by line breaks they are the text."""
    cut = docs.withColumn("_lines", F.split("text", "\n")).withColumn("_ends", chunk_ends(F.col("_lines"), divisor))

    def chunk(end: Column, k: Column) -> Column:
        begin = F.coalesce(F.get("_ends", k - 1), F.lit(-1)) + 1
        return F.struct(F.array_join(F.slice("_lines", begin + 1, end - begin + 1), "\n").alias("text"), (end - begin + 1).alias("lines"), begin.alias("begin"))

    return cut.withColumn("_chunks", F.transform("_ends", chunk)).drop("_lines", "_ends")


def repeated_chunks(docs: DataFrame, divisor: int) -> tuple[DataFrame, list[DataFrame]]:
    """``_at _begin _lines`` of the chunks that go from ``docs`` (see :func:`line_dedup`), and the written tables behind it.

    ``_at``: id, MD5 and place of the chunk in its document; ``_begin``: its first line.
    """
    # explode_outer: for explode the optimizer would build the chunks once more, inlined, to filter out empty arrays
    identity = [F.col("doc_id").alias("_id"), F.md5("text").alias("_md5")]
    multi = with_chunks(docs.select("doc_id", "text").where(F.col("text").contains("\n")), divisor).select(*identity, F.posexplode_outer("_chunks").alias("_place", "_chunk")).where((F.col("_chunk.lines") > 1) & F.col("_chunk.text").rlike(WORD))
    hashed = multi.withColumn("_hash", F.xxhash64("_chunk.text"))
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_md5").alias("md5"), F.col("_place").alias("place"))
    again = hashed.groupBy("_hash").agg(F.min(place).alias("_low"), F.max(place).alias("_high"), F.count("*").alias("_n"))
    again = written(again.where("_low <> _high").select("_hash", "_n"), "line-hashes")
    # read again below; as a table the chunks move once
    repeats = joined_to_one(hashed, again, "_hash", "left_semi")
    found = written(repeats.select("_hash", F.col("_chunk.text").alias("_bytes"), place.alias("_at"), F.col("_chunk.begin").alias("_begin"), F.col("_chunk.lines").alias("_lines")), "line-chunks")
    first = lambda rows: rows.groupBy("_hash", "_bytes").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    kinds = first(found).groupBy("_hash").agg(F.count("*").alias("_kinds"), F.min("_first").alias("_first"), F.sum("_n").alias("_n"))
    kinds = written(kinds, "line-firsts")
    # a hash of one byte string stands for it; strings that share a hash meet by their bytes
    later = joined_to_one(found.select("_hash", "_at", "_begin", "_lines"), kinds.where("_kinds = 1").drop("_kinds"), "_hash").select("_at", "_begin", "_lines", "_first")
    shared = kinds.where("_kinds > 1")
    if not shared.isEmpty():
        some = found.join(shared.select("_hash"), "_hash", "left_semi")
        later = later.union(some.join(first(some).drop("_n"), ["_hash", "_bytes"]).select("_at", "_begin", "_lines", "_first"))
    return later.where("_at <> _first").select("_at", "_begin", "_lines"), [again, found, kinds]


def line_dedup(docs: DataFrame, divisor: int = 3) -> DataFrame:
    """``docs`` with repeated multi-line chunks taken out of ``text``, and ``n_lines n_removed_lines n_removed_chunks``.

    Texts are cut into chunks of lines (:func:`chunk_ends`). Of all chunks of two or more lines with a word that are
    equal byte by byte, in one document or several, the first stays (by ``doc_id``, null last, then MD5 of the text,
    then place); the others go with their line breaks. A text all of whose chunks go is empty; a null text stays null
    (0 lines). Rows with equal id and text are one document and get the same result. Columns of ``docs`` with the names
    above are replaced; an ``n_chars`` follows the text if ``docs`` has one.

    Hashes alone move first, then the text of chunks whose hash comes again, once a task, to be compared. Each first
    place is joined back by :func:`plotwise.llm.common.joined_to_one`, so a chunk of a third of all documents is no
    task's list. Whole texts move for the final join.
    """
    docs, names = guarded(docs, {"doc_id", "text", "n_chars"})
    later, _ = repeated_chunks(docs, divisor)
    gone = later.groupBy(F.col("_at.id").alias("_id"), F.col("_at.md5").alias("_md5")).agg(F.collect_set("_at.place").alias("_gone"))
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.md5("text") == F.col("_md5")), "left")
    # only texts that lose something are cut once more
    cut = with_chunks(joined.withColumn("_whole", F.col("text")).withColumn("text", F.when(F.col("_gone").isNotNull(), F.col("text"))), divisor)
    cut = cut.withColumn("_stays", F.array_except(F.sequence(F.lit(0), F.size("_chunks") - 1), "_gone"))
    left = F.aggregate("_stays", F.lit(0), lambda a, k: a + F.get("_chunks", k)["lines"])
    lost = F.col("_gone").isNotNull()
    added = {
        "n_lines": F.when(F.col("_whole").isNull(), F.lit(0)).otherwise(F.size(F.split("_whole", "\n"))).cast("long"),
        "n_removed_lines": F.when(lost, F.size(F.split("_whole", "\n")) - left).otherwise(F.lit(0)).cast("long"),
        "n_removed_chunks": F.when(lost, F.size("_gone")).otherwise(F.lit(0)).cast("long"),
    }
    text = F.when(lost, F.array_join(F.transform("_stays", lambda k: F.get("_chunks", k)["text"]), "\n")).otherwise(F.col("_whole"))
    changed = {"text": text} | ({"n_chars": F.when(lost, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return restored(cut.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns], *[v.alias(k) for k, v in added.items()]), names, ADDED)


def passage_dedup(docs: DataFrame, divisor: int | None = None, most_broadcast: int = 500_000) -> DataFrame:
    """``docs`` without the lines of ``text`` that are in a repeated run of two or more lines.

    Of all pairs of adjacent lines with a word that are equal byte for byte, in one document or several, the first stays
    (in the order of :func:`line_dedup`), and the lines of the others go. So every run all of whose adjacent pairs came
    before goes whole, wherever it begins and ends; nothing depends on a choice of chunks. Where a line follows itself, a
    pair may share a line with the first of its kind: that line stays. Each line that goes is still there at an earlier
    place. Rows with equal id and text are one document; null texts stay null and an ``n_chars`` follows the text.

    With a ``divisor`` the chunks that :func:`line_dedup` takes out go first, and the pairs are the exact check for what
    borders of chunks cut. Both are judged on the input, and each line that goes has an earlier place, so the first of
    its kind stays in any case.

    A pair moves as its SHA-256, which stands for its bytes (a line break keeps its two lines apart). Tables in between
    are deleted at once; the numbers of the lines that go are kept for the result. Up to ``most_broadcast`` of these are
    broadcast, so that no text moves; more meet the texts by shuffle.
    """
    docs, names = guarded(docs, {"doc_id", "text", "n_chars"})
    cut = docs.select(F.col("doc_id").alias("_id"), F.md5("text").alias("_md5"), F.split("text", "\n").alias("_lines")).where(F.col("text").contains("\n"))
    pair = F.concat_ws("\n", F.col("_line"), F.get("_lines", F.col("_place") + 1))
    each = cut.select("*", F.posexplode_outer("_lines").alias("_place", "_line")).where(F.col("_place") < F.size("_lines") - 1).select("_id", "_md5", "_place", pair.alias("_pair"))
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_md5").alias("md5"), F.col("_place").alias("place"))
    found = written(each.where(F.col("_pair").rlike(WORD)).select(F.unhex(F.sha2("_pair", 256)).alias("_key"), place.alias("_at")), "line-pairs")
    first = found.groupBy("_key").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.count("*").alias("_n"))
    first = written(first.where("_first <> _last").select("_key", "_first", "_n"), "line-firsts")
    later = joined_to_one(found, first, "_key").where("_at <> _first")
    begin, own = F.col("_at.place"), (F.col("_at.id").eqNullSafe(F.col("_first.id"))) & (F.col("_at.md5") == F.col("_first.md5"))
    lost = F.when(own & (begin == F.col("_first.place") + 1), F.array(begin + 1)).otherwise(F.array(begin, begin + 1))
    of = lambda rows, lines: rows.select(F.col("_at.id").alias("_id"), F.col("_at.md5").alias("_md5"), lines.alias("_lost"))
    parts, tables = of(later, lost), [found, first]
    if divisor is not None:
        chunks, made = repeated_chunks(docs, divisor)
        parts, tables = of(chunks, F.sequence("_begin", F.col("_begin") + F.col("_lines") - 1)).union(parts), tables + made
    gone = written(parts.groupBy("_id", "_md5").agg(F.array_distinct(F.flatten(F.collect_list("_lost"))).alias("_gone")), "line-gone")
    dropped(*tables)
    losses = gone.agg(F.sum(F.size("_gone") + 1)).first()[0] or 0
    joined = docs.join(sent_if_few(gone, losses, most_broadcast), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.md5("text") == F.col("_md5")), "left")
    lines = F.split("text", "\n")
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    held = joined.withColumn("_lines", F.when(F.col("_gone").isNotNull(), lines)).withColumn("_stays", F.when(F.col("_gone").isNotNull(), stays))
    text = F.when(F.col("_gone").isNotNull(), F.array_join(F.transform("_stays", lambda k: F.get("_lines", k)), "\n")).otherwise(F.col("text"))
    changed = {"text": text} | ({"n_chars": F.when(F.col("_gone").isNotNull(), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return restored(held.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns]), names)
