"""Operator 3: drop recurring lines by a tree of log templates, by DataFrame functions alone.

A line falls down a tree of fixed depth: by its number of tokens, then by its leading tokens. A token with a digit is a
variable field, ``<*>``, unless more than half of the line's tokens have one. Lines of a leaf that have the same tokens and
fields share a template. The templates of a leaf are generalised further, in two ways: templates that differ at one place
only have a variable field there, and a token that no other template of the leaf has at its place is a variable field too,
if no more than a fifth of the line is variable. A template that occurs in two or more documents recurs, whatever its
length: its lines stay in the document with the smallest id and are dropped from all others.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, let, shared_checkpoint, unused

FIELD = "<*>"
#: A token that holds a digit. Begins only where a token begins, so it never scans a token twice.
VARIABLE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
#: Words of a bitmap that tells which keys are wanted; its size is the same for any input.
FILTER_WORDS = 1 << 17
TEMPLATE = ("template", "check")
TEMPLATE_OF_P = tuple(f"p.{c}" for c in TEMPLATE)


def masked(line: Column) -> Column:
    """The tokens of a line with single blanks between them, those with a digit replaced."""
    return F.when(irregular(line), tidy(F.regexp_replace(line, VARIABLE, FIELD))).otherwise(line)


def irregular(line: Column) -> Column:
    """Whether a line has digits or anything but single blanks between its tokens; most lines have neither."""
    return line.rlike(r"[0-9\x09\x0B-\x0D]") | line.contains("  ") | line.startswith(" ") | line.endswith(" ")


def tidy(line: Column) -> Column:
    return F.regexp_replace(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), SPACE, " ")


def comparable(line: Column) -> Column:
    """The masked line, or the line itself with single blanks where more than half of its tokens have a digit: such lines
    would be equal with little or nothing in common."""
    few = F.regexp_count(line, F.lit(VARIABLE)) * 2 <= F.regexp_count(line, F.lit(WORD))
    fields = F.when(~line.rlike("[0-9]"), line).when(few, F.regexp_replace(line, VARIABLE, FIELD)).otherwise(line)
    return F.when(irregular(line), tidy(fields)).otherwise(line)


def parsed(raw: Column, depth: int, open_from: int, with_line: bool = False) -> Column:
    """(n, leaf, template, check) of a line, and on demand the masked line; leaf is null below ``open_from`` tokens."""

    def parse(line: Column) -> Column:
        tokens = F.when(line == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)
        leaf = F.when(tokens >= open_from, F.xxhash64(tokens, F.substring_index(line, " ", depth)))
        return F.struct(tokens.alias("n"), leaf.alias("leaf"), F.xxhash64(line).alias("template"), F.hash(line).alias("check"), *[line.alias("line")] * with_line)

    return let(comparable(raw), parse)


def place_in_tree(docs: DataFrame, depth: int, min_tokens: int, open_from: int) -> DataFrame:
    """(doc_id, row_id, line_no, leaf, template, check) of the lines. leaf is null below ``open_from`` tokens, where no field
    can be generalised. row_id tells rows with equal ids but other texts apart; template and check are 96 bits of hashes.
    Each line is parsed once, within the array of its text."""
    lines = F.transform(F.split("text", "\n", -1), lambda raw: parsed(raw, depth, open_from))
    rows = docs.select("doc_id", "row_id", F.posexplode(lines).alias("line_no", "p")).filter(F.col("p.n") >= max(min_tokens, 1))
    return rows.select("doc_id", "row_id", "line_no", "p.leaf", *TEMPLATE_OF_P)


def spot() -> Column:
    """A number of the place where a line stands."""
    return F.xxhash64("doc_id", "row_id", "line_no")


def template_lines(docs: DataFrame, wanted: DataFrame, depth: int, open_from: int) -> DataFrame:
    """(template, check, line) of the templates of ``wanted``, each read at its ``spot`` alone, so that no copy of a line is
    parsed again. A few other lines may be among them."""
    raw = docs.select("doc_id", "row_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw")).withColumn("spot", spot())
    rows = may_match(raw, "spot", wanted).select(F.explode(F.array(parsed(F.col("raw"), depth, open_from, with_line=True))).alias("p"))
    return rows.groupBy(*(F.col(c) for c in TEMPLATE_OF_P)).agg(F.max("p.line").alias("line"))


def may_match(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``key`` may be among the keys of ``wanted``, by a broadcast bitmap of fixed size; a few others pass
    too, more as the bitmap fills, so an exact join has to follow. It spares that join's shuffle all other rows."""
    word, bit = F.pmod(F.col(key), F.lit(FILTER_WORDS)), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({key}, 20) & 63 as int))")
    bitmap = wanted.groupBy(word.alias("word_")).agg(F.bit_or(bit).alias("bits_"))  # FILTER_WORDS rows at most
    met = rows.withColumn("bit_", bit).join(F.broadcast(bitmap), word == F.col("word_"))
    return met.filter(F.col("bits_").bitwiseAND(F.col("bit_")) != 0).drop("word_", "bits_", "bit_")


def one_place_cuts(lines: DataFrame) -> DataFrame:
    """(t, cut) of templates that equal another one of the leaf in all places but one. Each template stands once under every
    place, with a hash of the rest, so no pair of templates is formed."""
    rest = lambda token, place: F.xxhash64("leaf", place, F.col("whole").bitwiseXOR(token))
    places = lines.select("t", "first_doc", "last_doc", F.explode(F.transform("hashes", rest)).alias("rest"))
    groups = places.groupBy("rest").agg(F.min("first_doc").alias("cut"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    groups = shared_checkpoint(groups.select("rest", "cut"))
    return may_match(places, "rest", groups).select("t", "last_doc", "rest").join(groups, "rest").filter("last_doc > cut").select("t", "cut")


def rare_token_cuts(lines: DataFrame, constant_share: float) -> DataFrame:
    """(t, cut) of templates that are equal once the tokens that no other template of the leaf has at their place are
    variable fields."""
    places = lines.select("t", "first_doc", "last_doc", F.explode("hashes").alias("token"))
    constant = places.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("first_doc").alias("a"), F.max("last_doc").alias("b")).filter("m > 1 and a < b")
    constant = shared_checkpoint(constant.select("token"))
    fixed = may_match(places, "token", constant).select("t", "token").join(constant, "token").groupBy("t").agg(F.count(F.lit(1)).alias("n_fixed"), F.bit_xor("token").alias("parts"))
    size = F.size("hashes")
    marked = lines.join(fixed, "t").filter((F.col("n_fixed") < size) & (F.col("n_fixed") >= constant_share * size))
    general = shared_checkpoint(marked.select("t", "first_doc", "last_doc", F.xxhash64("leaf", "n_fixed", "parts").alias("general")))
    cuts = shared_checkpoint(general.groupBy("general").agg(F.min("first_doc").alias("cut")))
    return general.join(cuts, "general").filter("last_doc > cut").select("t", "cut")


def variant_cuts(docs: DataFrame, templates: DataFrame, *, depth: int, open_from: int, constant_share: float) -> DataFrame:
    """(template, check, cut) of the templates that recur once fields are generalised; cut is the first document that has
    any of the variants.

    Templates that recur exactly take part like all others, each as one row, so that more copies of a variant never part
    it from the others.
    """
    leaves = templates.filter("leaf is not null").groupBy("leaf").agg(F.count(F.lit(1)).alias("m"), F.min("first_doc").alias("a"), F.max("last_doc").alias("b")).filter("m > 1 and a < b").select("leaf")
    wanted = shared_checkpoint(templates.join(leaves, "leaf").select("leaf", *TEMPLATE, "first_doc", "last_doc", "spot"))
    texts = template_lines(docs, wanted, depth, open_from)
    hashes = F.transform(F.split("line", " "), lambda token, place: F.xxhash64("leaf", place, token))
    whole = F.aggregate("hashes", F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))
    lines = texts.join(wanted, [*TEMPLATE]).select(*TEMPLATE, "leaf", "first_doc", "last_doc", hashes.alias("hashes"))
    lines = shared_checkpoint(lines.withColumns({"whole": whole, "t": F.monotonically_increasing_id()}))
    cuts = one_place_cuts(lines).unionByName(rare_token_cuts(lines, constant_share)).groupBy("t").agg(F.min("cut").alias("cut"))
    return lines.select("t", *TEMPLATE).join(cuts, "t").drop("t")


def drop_recurring_lines(
    docs: DataFrame, *, depth: int = 4, min_tokens: int = 1, constant_share: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
    kept_col: str = "kept_text_", lines_col: str = "n_lines_", dropped_col: str = "n_dropped_",
) -> DataFrame:
    """All rows and columns of ``docs``, with ``kept_col``, ``lines_col`` and ``dropped_col`` added; input columns of these
    names are replaced, all others stay whatever their names.

    Lines end at line feeds and are compared by their tokens. A line without a token never drops; ``min_tokens`` may spare
    short lines, and by default spares none. A null text stays null, with no lines; an empty text has one empty line. A
    text may lose all its lines and becomes empty then. Rows with equal ids count as one document; a null id counts as
    larger than any other. An empty table gives an empty table.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    text = F.col(text_col).cast("string")
    small = docs.select(key.alias("doc_id"), text.alias("text")).withColumn("row_id", F.xxhash64("doc_id", "text"))
    open_from = next(n for n in count(2) if n - 1 >= constant_share * n)
    keys = shared_checkpoint(place_in_tree(small, depth, min_tokens, open_from))
    templates = shared_checkpoint(keys.groupBy("leaf", *TEMPLATE).agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.min(spot()).alias("spot")))
    cuts = variant_cuts(small, templates, depth=depth, open_from=open_from, constant_share=constant_share)
    early = F.least("first_doc", "cut")  # of two values the one that is not null
    known = shared_checkpoint(templates.join(cuts, [*TEMPLATE], "left").select(*TEMPLATE, early.alias("early"), "last_doc").filter("last_doc > early"))
    found = may_match(keys.drop("leaf"), "template", known).join(known, [*TEMPLATE]).filter("doc_id > early")
    id_, row, drops = unused(docs, "id_", "row_", "drops_")
    dropped = found.groupBy(F.col("doc_id").alias(id_), F.col("row_id").alias(row)).agg(F.collect_set("line_no").alias(drops))
    lines = F.split(text, "\n", -1)
    kept = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(drops)), lambda i: F.get(x, i)), "\n"))
    joined = docs.withColumns({id_: key, row: F.xxhash64(key, text)}).join(dropped, [id_, row], "left")
    added = joined.withColumns({
        kept_col: F.when(F.col(drops).isNull(), text).otherwise(kept),
        lines_col: F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long"),
        dropped_col: F.coalesce(F.size(drops), F.lit(0)).cast("long"),
    })
    return added.drop(id_, row, drops)
