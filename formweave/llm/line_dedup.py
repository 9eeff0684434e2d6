"""Line dedup by a log-template tree; DataFrame functions only.

Every line of every text walks a tree of fixed depth: first by its number of tokens, then by its
leading tokens.  Tokens that hold a digit are variable fields from the start.  In a leaf, a
token is a constant of its position if the lines that hold it there recur (in ``min_docs`` pairs of
a line and a document at least); every other token is generalised to a variable field.  A line's
template is its leaf with the constants that are left.  A template of which constants make up
half or more of its tokens, and whose lines occur in ``min_docs`` documents or more, is
dropped: all its lines go from all texts.

Documents are told apart by their texts, so a text and its exact copies are one document.  Texts,
lines and places are named by two 64-bit hashes in between.  Lines of leaves that cannot
recur drop out before their texts are needed.  What one line, leaf, place, template or text shares
with many rows is joined by key and run (or broadcast, if it is counted and small), so that no task
gets all rows of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import drop_dir, matched, spread, written, written_at

FIELD = "<*>"
DOC, LINE, PLACE, TEMPLATE = ["d1", "d2"], ["l1", "l2"], ["k1", "k2"], ["x", "y"]


def masked(line: Column) -> Column:
    """Tokens of a line, parted by single blanks; those with a digit as variable fields.

    Tokens are what the characters of [\x20\x09-\x0D] part.  Most lines are so already.
    """
    plain = F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))
    other = line.contains("  ") | line.startswith(" ") | line.endswith(" ") | line.rlike(r"[0-9\x09-\x0D]")
    return F.when(other, F.regexp_replace(plain, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*", FIELD)).otherwise(line)


def names(columns: list[str], *values: Column) -> list[Column]:
    """Two 64-bit hashes of the values."""
    return [F.xxhash64(F.lit(i), *values).alias(c) for i, c in enumerate(columns)]


def leaf_of(tokens: Column, depth: int) -> Column:
    """The path of a line in the tree: its number of tokens and the leading ones."""
    count = F.length(tokens) - F.length(F.replace(tokens, F.lit(" "), F.lit(""))) + 1
    return F.concat_ws(" ", count.cast("string"), F.substring_index(tokens, " ", depth))


def _lines(docs: DataFrame, text: str, depth: int) -> DataFrame:
    """``d1``, ``d2`` (the text), ``at``, ``l1``, ``l2`` (the line), ``tokens`` and ``leaf`` of all lines that have tokens."""
    named = docs.select(*names(DOC, F.col(text)), F.split(F.col(text), "\n", -1).alias("lines"))  # once a text, below the lines; "outer" lets Spark add no filter, which would split again
    rows = named.select(*DOC, F.posexplode_outer("lines").alias("at", "line")).filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    tokens = F.col("tokens")
    return rows.select(*DOC, "at", masked(F.col("line")).alias("tokens")).select(*DOC, "at", *names(LINE, tokens), "tokens", F.xxhash64(leaf_of(tokens, depth)).alias("leaf"))


def recurring_lines(docs: DataFrame, text: str = "text", depth: int = 2, min_docs: int = 3) -> DataFrame:
    """``d1``, ``d2`` and ``at`` (from 0) of every line of every distinct text whose template recurs."""
    count = F.count(F.lit(1))
    every, every_at = written_at(_lines(docs, text, depth), "masked-lines", "lz4")
    lines = written(every.select(*DOC, "at", *LINE, "leaf").distinct(), "lines")

    # lines with the number of their documents, in leaves that may hold a constant
    counted = written(lines.select(*LINE, "leaf", *DOC).distinct().groupBy(*LINE, "leaf").agg(count.alias("docs")), "line-counts")
    leaves = written(counted.groupBy("leaf").agg(F.sum("docs").alias("all")).filter(F.col("all") >= min_docs).select("leaf"), "leaves")
    opened = matched(counted, leaves, ["leaf"], "l1").select(*LINE, "docs")
    found = matched(every.select(*LINE, "tokens", "leaf"), leaves, ["leaf"], "l1")
    known = written(found.groupBy(*LINE).agg(F.min("tokens").alias("tokens")).join(opened, LINE), "open-lines")
    drop_dir(docs.sparkSession, every_at)

    # constants of each position of a leaf, and the template that they leave of a line
    path = leaf_of(F.col("tokens"), depth)
    placed = known.select(*LINE, "docs", F.substring_index(path, " ", 1).cast("int").alias("n"), *names(["p1", "p2"], path), F.split("tokens", " ").alias("parts"))  # once a line, below the tokens
    placed = placed.select(*LINE, "docs", "n", "p1", "p2", F.posexplode_outer("parts").alias("pos", "token"))
    place = (F.xxhash64(p, F.col("pos"), F.col("token")).alias(k) for p, k in zip(("p1", "p2"), PLACE, strict=True))
    places = placed.filter(F.col("token") != FIELD).select(*LINE, "docs", "n", *place)
    constants = written(places.groupBy(*PLACE).agg(F.sum("docs").alias("all")).filter(F.col("all") >= min_docs).select(*PLACE), "constants")
    # all that a frequent line holds is constant
    kept = matched(places.filter(F.col("docs") < min_docs), constants, PLACE, "l1").unionByName(places.filter(F.col("docs") >= min_docs))
    templates = kept.groupBy(*LINE, "docs", "n").agg(count.alias("kept"), F.bit_xor("k1").alias("x"), F.bit_xor("k2").alias("y")).filter(2 * F.col("kept") >= F.col("n"))
    templates = written(templates.select(*LINE, "docs", *TEMPLATE), "templates")

    # a template recurs by one of its lines alone, or by the documents of all of them
    sums = templates.groupBy(*TEMPLATE).agg(F.max("docs").alias("most"), F.sum("docs").alias("all")).filter(F.col("all") >= min_docs)
    sums = written(sums, "template-counts")
    alone = sums.filter(F.col("most") >= min_docs).select(*TEMPLATE)
    rare = written(spread(templates, sums.filter(F.col("most") < min_docs).select(*TEMPLATE), TEMPLATE, "l1").select(*LINE, *TEMPLATE), "rare-lines")
    shared = matched(lines, rare, LINE, "d1").select(*TEMPLATE, *DOC).distinct().groupBy(*TEMPLATE).agg(count.alias("docs")).filter(F.col("docs") >= min_docs).select(*TEMPLATE)
    gone = written(spread(templates, alone.unionByName(shared), TEMPLATE, "l1").select(*LINE), "recurring")
    return matched(lines, gone, LINE, "d1").select(*DOC, "at")


def line_dedup(docs: DataFrame, text: str = "text", depth: int = 2, min_docs: int = 3) -> DataFrame:
    """``docs`` with ``text`` cleaned, and ``n_lines`` and ``n_dropped`` added (in place of columns of
    those names).

    Lines end at a line feed; a carriage return is a blank.  Lines without tokens stay.  A null text
    has no lines and stays null; an empty one has one line.  A text of which all lines go is empty.
    Rows with equal texts are one document but all stay, whatever their ids; an empty table gives
    no rows.  Nothing else of a row changes.
    """
    gone = written(recurring_lines(docs, text, depth, min_docs).groupBy(*DOC).agg(F.collect_set("at").alias("_ld_gone")), "lines-to-drop")
    key = ["_ld_1", "_ld_2"]
    gone = gone.select(F.col("d1").alias("_ld_1"), F.col("d2").alias("_ld_2"), "_ld_gone")
    some = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(*some, *names(key, F.col(text)), F.xxhash64(*some).alias("_ld_by"))
    total = gone.agg(F.sum(F.size("_ld_gone"))).first()[0] or 0  # lines to drop: few are broadcast
    met = rows.join(F.broadcast(gone), key, "left") if total <= 2_000_000 else spread(rows, gone, key, "_ld_by", "left")
    met = met.withColumn("_ld_parts", F.split(F.col(text), "\n", -1))  # a column of its own: not split again for each line that stays
    parts = F.col("_ld_parts")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_ld_gone"))
    clean = F.when(F.col("_ld_gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n"))
    out = [clean.alias(text) if c == text else F.col(c) for c in some]
    return met.select(*out, F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
                      F.coalesce(F.size("_ld_gone"), F.lit(0)).cast("long").alias("n_dropped"))
