"""Line dedup with a log-template tree, in DataFrame functions only.

A line is parsed by a tree of fixed depth: number of tokens, then its first ``LEAD`` tokens, tokens
with a digit being a variable field ``<*>``. Lines of one leaf are generalised in three ways, each
with an absolute support, so that other lines of the leaf never take a template away:

- the line's masked form is a template, unless most of it is fields (rows of numbers are none);
- a token that ``MIN_TEXTS`` texts have in a place is constant, any other is a variable field; lines with the
  same constants in the same places share a template, if these are ``CONSTANT_TENTHS`` of the tokens;
- one word behind the leading ones is a variable field, if as many of the other tokens are constant. This finds
  templates whose field holds words that are frequent in their place.

A template that recurs in ``MIN_TEXTS`` different texts is dropped from every document but the one with
the smallest id. So is a line that is literally the same (but for blanks), digits or not: from ``MIN_TEXTS`` texts
on, with ``LONG_TOKENS`` tokens from ``long_texts`` on, under ``MIN_TOKENS`` tokens from ``SHORT_TEXTS`` on. A line
in several templates stays only if its document is the first of all. Texts are counted, not documents:
whole copies of a document do not make its lines boilerplate (near-dedup removes those).

Work: one pass over the texts writes hashes and masked forms of their lines, and finds the leaves that recur; a
second one, over these tables, collects the lines of such leaves, and everything after runs on these. Hot
lines are folded map-side before anything is joined. What a join broadcasts passes the driver and has a bound in
bytes there; beyond it the join is a shuffle in which hot keys are salted.

Defined cases: NULL texts stay NULL and empty ones empty; within one document a repeated line counts
once, and all its occurrences go or stay together; a NULL id counts as larger than all others; rows
that agree in id and text get the same result; an empty table gives an empty result; other columns
pass unchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesift.llm.frames import column, fresh, small, stored

LEAD = 3
MIN_TOKENS = 5
MIN_TEXTS = 3
CONSTANT_TENTHS = 7
# A line of so many tokens is no chance repeat: two texts are enough if it is the same literally.
LONG_TOKENS, LONG_TEXTS = 10, 2
# Lines under ``MIN_TOKENS`` tokens recur by chance.
SHORT_TEXTS = 10
FIELD = "<*>"
# Characters between tokens of a line.
BLANKS = r"[ \t\r\f\x0B]+"
NOT_BLANK = r"[^ \t\r\f\x0B]"
# A token with a digit, found from its start, so that long tokens take linear time.
WITH_DIGIT = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"
SALTS = 16
# Rows of one key from which on it is dealt to ``SALTS`` tasks.
HOT_ROWS = 1_000
# A broadcast passes the driver, which holds it as a hash table and once more in blocks, until its garbage is collected:
# the bytes there of a row of hashes, of a mere hash, and of a document's dropped lines (and 8 each), and the most that
# is sent at once.
HASH_ROW, KEY_ROW, DROPPED_ROW = 48, 24, 160
SENT_BYTES, SENT_DROPPED = 16 << 20, 24 << 20


def spaced(line: Column) -> Column:
    """The tokens of a line with one space in between."""
    return F.trim(F.regexp_replace(line, BLANKS, " "))


def masked(line: Column) -> Column:
    """A spaced line with fields for tokens that hold a digit."""
    return F.regexp_replace(line, WITH_DIGIT, FIELD)


def n_tokens(line: Column) -> Column:
    """Tokens of a spaced line that has any."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def literal_key(line: Column) -> Column:
    """Hash of a line as it is, but for blanks."""
    return F.xxhash64(spaced(line))


def _needed(n: Column, long_texts: int) -> Column:
    """Texts that make a line of ``n`` tokens recurring if it is literally the same."""
    return F.when(n < MIN_TOKENS, SHORT_TEXTS).when(n < LONG_TOKENS, MIN_TEXTS).otherwise(long_texts)


def _joined(many: DataFrame, few: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a table with hot keys to a stored one with unique keys: by broadcast, or with hot keys salted if too large for it.

    ``few`` holds hashes, numbers and at most two ids, and as ``n_rows`` about how many rows of ``many`` a key meets.
    """
    n, total = few.agg(F.count(F.lit(1)), F.sum("n_rows")).first()
    keyed = few.drop("n_rows")
    near = small(keyed, n, KEY_ROW if keyed.columns == on else HASH_ROW, SENT_BYTES)
    if near is not keyed:
        return many.join(near, on, how)
    # Never more hot keys than may be broadcast. Salted copies must not be broadcast for their size on disk.
    is_hot = F.col("n_rows") > max(HOT_ROWS, total * HASH_ROW // SENT_BYTES)
    hot = F.broadcast(few.where(is_hot).select(*on, F.lit(True).alias("hot")))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = few.withColumn("salt", F.explode(salts)).drop("n_rows").hint("merge")
    # From the row itself, so that a task that is run again deals its rows alike.
    salt = F.pmod(F.xxhash64(*[column(c) for c in many.columns]), F.lit(SALTS)).cast("int")
    dealt = many.join(hot, on, "left").withColumn("salt", F.when(F.col("hot"), salt).otherwise(0)).drop("hot")
    return dealt.join(copies, [*on, "salt"], how).drop("salt")


def _raw_lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc, text_key, line``: every different line of every document that has tokens, spaced."""
    lines = F.array_distinct(F.split(column(text), "\n"))
    rows = docs.select(
        column(doc).alias("doc"), F.xxhash64(column(text)).alias("text_key"), F.explode(lines).alias("line")
    )
    return rows.where(F.col("line").rlike(NOT_BLANK)).select("doc", "text_key", spaced(F.col("line")).alias("line"))


def _parsed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc, text_key, n, literal, form, leaf, masked``: lines as hashes, long enough ones with masked form."""
    rows = _raw_lines(docs, doc, text)
    rows = rows.select(
        "doc",
        "text_key",
        n_tokens(F.col("line")).alias("n"),
        F.xxhash64("line").alias("literal"),
        masked(F.col("line")).alias("masked"),
    )
    leaf = F.xxhash64("n", F.substring_index("masked", " ", LEAD))
    return rows.select(
        "doc",
        "text_key",
        "n",
        "literal",
        F.xxhash64("masked").alias("form"),
        leaf.alias("leaf"),
        F.when(F.col("n") >= MIN_TOKENS, F.col("masked")).alias("masked"),
    )


def _cells(forms: DataFrame) -> DataFrame:
    """One row per word of a masked form: ``place`` and ``cell``, the hash of leaf, place and word.

    ``others`` is the hash of all other cells of the form, ``fixed`` the number of its words.
    """
    parts = F.split("masked", " ")
    cells = F.transform(parts, lambda t, i: F.xxhash64("leaf", i, t))
    total = F.aggregate(cells, F.lit(0).cast("bigint"), lambda s, c: s.bitwiseXOR(c))
    fixed = F.size(F.filter(parts, lambda t: t != FIELD))
    rows = forms.select("*", cells.alias("cells"), fixed.alias("fixed"))
    rows = rows.withColumn("total", total).drop("masked")
    rows = rows.select("*", F.posexplode("cells").alias("place", "cell")).drop("cells")
    rows = rows.where(F.col("cell") != F.xxhash64("leaf", "place", F.lit(FIELD)))
    return rows.withColumn("others", F.col("total").bitwiseXOR(F.col("cell"))).drop("total")


def _templates(forms: DataFrame) -> DataFrame:
    """``form, group`` and the counts of the form: the templates that a form may belong to."""
    counts = ["form", "n_texts", "n_rows", "low", "high", "first"]
    cells = _cells(forms)
    constant = cells.groupBy("cell").agg(F.sum("n_texts").alias("n_cell"))
    constant = constant.where(F.col("n_cell") >= MIN_TEXTS).select("cell", F.col("n_cell").alias("n_rows"))
    constant = stored(constant, "line-constants")
    matched = _joined(cells, constant, ["cell"]).groupBy("leaf", "n", *counts)
    matched = matched.agg(F.expr("bit_xor(cell)").alias("constants"), F.count(F.lit(1)).alias("n_constant"))
    matched = matched.where(10 * F.col("n_constant") >= CONSTANT_TENTHS * F.col("n"))
    general = matched.select(*counts, F.xxhash64("leaf", "constants").alias("group"))
    one = cells.where((F.col("place") >= LEAD) & (10 * (F.col("fixed") - 1) >= CONSTANT_TENTHS * F.col("n")))
    one = one.select(*counts, F.xxhash64("leaf", "place", "others").alias("group"))
    return general.unionByName(one)


def _recurring_forms(held: DataFrame) -> DataFrame:
    """``form, low_first, high_first, n_rows``: forms of recurring templates with the first documents of these."""
    lines = held.where(F.col("masked").isNotNull())
    keys = ["leaf", "form", "n", "masked"]
    forms = lines.groupBy(*keys, "text_key").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n_rows"))
    forms = forms.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.sum("n_rows").alias("n_rows"),
        F.min("text_key").alias("low"),
        F.max("text_key").alias("high"),
        F.min("first").alias("first"),
    )
    forms = stored(forms, "line-forms")
    words = F.size(F.filter(F.split("masked", " "), lambda t: t != FIELD))
    alone = forms.where((F.col("n_texts") >= MIN_TEXTS) & (2 * words >= F.col("n"))).select("form", "first", "n_rows")

    members = _templates(forms)
    # Two of a form's texts, or the fact that it has enough by itself, decide the support of its groups.
    texts = members.select(
        "group",
        "first",
        (F.col("n_texts") >= MIN_TEXTS).alias("enough"),
        F.explode(F.array_distinct(F.array("low", "high"))).alias("text_key"),
    )
    texts = texts.groupBy("group", "text_key").agg(
        F.min("first").alias("first"), F.max("enough").alias("enough"), F.count(F.lit(1)).alias("n_rows")
    )
    groups = texts.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("enough").alias("enough"),
        F.min("first").alias("of_group"),
        F.sum("n_rows").alias("n_rows"),
    )
    groups = groups.where((F.col("n") >= MIN_TEXTS) | F.col("enough")).select("group", "of_group", "n_rows")
    groups = stored(groups, "line-groups")
    found = _joined(members, groups, ["group"]).select("form", F.col("of_group").alias("first"), "n_rows")
    found = found.unionByName(alone).groupBy("form")
    return found.agg(
        F.min("first").alias("low_first"), F.max("first").alias("high_first"), F.max("n_rows").alias("n_rows")
    )


def recurring_lines(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", long_texts: int = LONG_TEXTS
) -> DataFrame:
    """``doc, text_key, line_key``: lines to drop, as their literal key."""
    lines = stored(_parsed(docs, doc, text), "lines")
    leaves = lines.groupBy("leaf", "n", "text_key").agg(F.count(F.lit(1)).alias("n_rows"))
    leaves = leaves.groupBy("leaf", "n").agg(F.count(F.lit(1)).alias("leaf_texts"), F.sum("n_rows").alias("n_rows"))
    leaves = leaves.where(F.col("leaf_texts") >= _needed(F.col("n"), long_texts)).select("leaf", "n_rows")
    held = stored(_joined(lines, stored(leaves, "leaves"), ["leaf"]), "held-lines")

    same = held.groupBy("literal", "n", "text_key").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n_rows"))
    same = same.groupBy("literal", "n").agg(
        F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"), F.sum("n_rows").alias("n_rows")
    )
    same = same.where(F.col("texts") >= _needed(F.col("n"), long_texts))
    same = stored(same.select("literal", "first", "n_rows", F.lit(True).alias("is_same")), "same-lines")
    forms = _recurring_forms(held).withColumn("is_form", F.lit(True))

    rows = held.select("doc", "text_key", "literal", "form")
    rows = _joined(rows, same, ["literal"], "left")
    rows = _joined(rows, stored(forms, "recurring-forms"), ["form"], "left")
    firsts = [F.least("first", "low_first"), F.greatest("first", "high_first")]
    stays = reduce(Column.__and__, [F.col("doc").eqNullSafe(f) for f in firsts])
    rows = rows.where((F.col("is_same").isNotNull() | F.col("is_form").isNotNull()) & ~stays)
    return rows.select("doc", "text_key", F.col("literal").alias("line_key"))


def drop_recurring_lines(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", long_texts: int = LONG_TEXTS
) -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text``; rows and other columns are as before.

    Before near-dedup ``long_texts`` should be ``MIN_TEXTS``: pairs of near copies would be left as fragments.
    """
    return _without(docs, recurring_lines(docs, doc, text, long_texts), doc, text)


def repeated_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, text_key, line_key``: lines of ``LONG_TOKENS`` and more, with or without digits, that are the
    same in ``LONG_TEXTS`` different texts, for every document but the first."""
    rows = _raw_lines(docs, doc, text).where(n_tokens(F.col("line")) >= LONG_TOKENS)
    rows = rows.select("doc", "text_key", F.xxhash64("line").alias("line_key"))
    groups = rows.groupBy("line_key", "text_key").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n_rows"))
    groups = groups.groupBy("line_key").agg(
        F.count(F.lit(1)).alias("n"), F.min("first").alias("first"), F.sum("n_rows").alias("n_rows")
    )
    groups = stored(groups.where(F.col("n") >= LONG_TEXTS).select("line_key", "first", "n_rows"), "repeated-lines")
    rows = _joined(rows, groups, ["line_key"]).where(~F.col("doc").eqNullSafe(F.col("first")))
    return rows.select("doc", "text_key", "line_key")


def drop_repeated_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with long lines left in their first document only; for a table without near copies, which
    would be left as fragments. ``docs`` is read twice and should be stored."""
    return _without(docs, repeated_lines(docs, doc, text), doc, text)


def _without(docs: DataFrame, lines: DataFrame, doc: str, text: str) -> DataFrame:
    """``docs`` without ``lines`` (``doc, text_key, line_key``)."""
    dropped = lines.groupBy("doc", "text_key")
    dropped = dropped.agg(F.collect_set("line_key").alias("gone"))
    dropped = stored(dropped, "dropped-lines")
    n_docs, n_lines = dropped.agg(F.count(F.lit(1)), F.sum(F.size("gone"))).first()
    key, gone = fresh(docs, "text_key"), fresh(docs, "gone")
    dropped = dropped.select(
        F.col("doc").alias(f"{key}_doc"), F.col("text_key").alias(f"{key}_of"), F.col("gone").alias(gone)
    )
    dropped = small(dropped.hint("merge"), n_docs + (n_lines or 0) * 8 // DROPPED_ROW, DROPPED_ROW, SENT_DROPPED)
    kept = F.filter(
        F.split(column(text), "\n"), lambda line: ~F.array_contains(F.col(gone), literal_key(line))
    )
    cleaned = F.when(F.col(gone).isNull(), column(text)).otherwise(F.array_join(kept, "\n"))
    return (
        docs.withColumn(key, F.xxhash64(column(text)))
        .join(
            dropped,
            column(doc).eqNullSafe(F.col(f"{key}_doc")) & (F.col(key) == F.col(f"{key}_of")),
            "left",
        )
        .select(*[(cleaned if c == text else column(c)).alias(c) for c in docs.columns])
    )
