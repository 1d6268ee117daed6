"""Line deduplication with a log-template tree of fixed depth, in DataFrame functions alone.

A line is put down the tree by its number of tokens and its leading tokens; tokens with a digit
are variable fields and count as one wildcard. In a leaf, the line seen most often is a template;
lines that agree with it in enough places belong to it, and the places where they differ are
variable fields as well. Of the lines left over, the one seen most often is the next template, and
so on until too few are left to recur; those are templates of their own.

A template recurs when it stands in at least `least_docs` unlike documents, wherever in them. A
document is unlike all others when at least a tenth of its tokens are in lines that no other document
has; the others are copies, and all copies with the same rarest shared line (the first by documents,
then by hash) count as one. So lines that many unlike documents share are dropped, whole blocks of
them too, while copies of a document, near copies among them, keep theirs for document deduplication.

Lines are compared by 64-bit hashes; their texts are shuffled only in leaves where lines differ.

Tokens: maximal runs of characters other than space and \\x09-\\x0D.

Defined cases: a null text stays null and has no lines; an empty text has one, which is empty. Lines
with no more tokens than the tree looks at are never dropped, but tell documents apart; empty lines
do neither. The first of the lines seen equally often is the one in the smallest id and place. Rows
with the same id and text are one document when lines are counted, and each gives a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.arrows import BROADCAST_NUMBERS, beside, checkpointed, free_name, keyed

DEPTH = 3
LEAST_DOCS = 5
SIMILARITY = 0.6
OWN = 0.1  # share of the tokens of a document that its own lines hold; near copies at 0.85 have 0.08

# Lines of a leaf among which a round picks templates: at first, and at most.
FIRST, MOST = 64, 4096

_WILD = "<*>"


def masked(lines: Column) -> Column:
    """The tokens of lines, joined by single spaces, with a wildcard for those with a digit."""

    def spaced(line: Column) -> Column:
        odd = line.rlike(r"[\x09-\x0D]|\x20\x20")
        return F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")).otherwise(line))

    def wild(line: Column) -> Column:
        # starts of tokens only, without going back, so that very long tokens take linear time
        token = r"(?<![^\x20])[^\x200-9]*+[0-9][^\x20]*+"
        return F.when(line.rlike("[0-9]"), F.regexp_replace(line, token, _WILD)).otherwise(line)

    return F.transform(F.transform(lines, spaced), wild)


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """A row per line with tokens: its document, number and hash, and its leaf where the tree covers it."""
    hashed = docs.where(F.col("text").isNotNull()).select(
        "id", "k1", "k2", masked(F.split("text", "\n", -1)).alias("line")
    )
    hashed = hashed.select("*", F.transform("line", lambda x: F.xxhash64(x)).alias("mask"))
    zipped = F.arrays_zip(
        F.sequence(F.lit(0), F.size("line") - 1).alias("number"),
        F.col("line"),
        F.col("mask"),
    )
    rows = hashed.select("id", "k1", "k2", F.inline(zipped).alias("number", "line", "mask")).where("line <> ''")
    tokens = F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1
    rows = rows.withColumn("tokens", tokens)
    leaf = F.when(F.col("tokens") > depth, F.xxhash64("tokens", F.substring_index("line", " ", depth)))
    return rows.select("id", "k1", "k2", "number", "line", "mask", "tokens", leaf.alias("leaf"))


def _agreement(a: Column, b: Column) -> Column:
    """Share of the tokens of two lines of one length that are equal."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x) / F.size(a)


def _unsettled(variants: DataFrame, least_docs: int) -> DataFrame:
    """The variants of leaves that could still hold a template of several lines that recurs."""
    leaves = (
        variants.groupBy("leaf").agg(F.count("*").alias("masks"), F.sum("n").alias("lines"))
        .where((F.col("masks") > 1) & (F.col("lines") >= least_docs))
        .select("leaf")
    )
    return variants.join(leaves, "leaf", "left_semi")


def _templates(lines: DataFrame, slim: DataFrame, least_docs: int, similarity: float) -> DataFrame:
    """From a line to the template of its leaf, for lines that belong to it and differ from it.

    A round settles the first lines of every leaf one after the other, and all lines that agree with
    the templates among them; the first of these is theirs.
    """
    counted = slim.where("leaf is not null").groupBy("leaf", "mask").agg(F.count("*").alias("n"))
    leaves = checkpointed(
        counted.groupBy("leaf")
        .agg(F.count("*").alias("masks"), F.sum("n").alias("lines"))
        .where((F.col("masks") > 1) & (F.col("lines") >= least_docs))
        .select("leaf", F.lit(True).alias("several"))
    )
    left = checkpointed(
        beside(lines, leaves, "leaf", leaves.count(), BROADCAST_NUMBERS)
        .where("several")
        .groupBy("leaf", "mask")
        .agg(F.count("*").alias("n"), F.min(F.struct("id", "number")).alias("first"), F.min("line").alias("line"))
        .select("leaf", "mask", "n", "first", F.split("line", " ").alias("words"))
    )
    agree = lambda x, y: _agreement(x["words"], y["words"]) >= similarity
    add = lambda known, x: F.when(F.exists(known, lambda t: agree(t, x)), known).otherwise(F.concat(known, F.array(x)))
    none = F.array().cast("array<struct<mask:bigint,words:array<string>>>")
    rank = F.row_number().over(Window.partitionBy("leaf").orderBy(F.col("n").desc(), "first"))
    mapped, first = None, FIRST
    while mapped is None or left.count():
        heads = left.withColumn("rank", rank).where(F.col("rank") <= first)
        own = F.array_sort(F.collect_list(F.struct("rank", "mask", "words")))
        own = F.transform(own, lambda x: F.struct(x["mask"].alias("mask"), x["words"].alias("words")))
        seeds = heads.groupBy("leaf").agg(own.alias("own")).select("leaf", F.aggregate("own", none, add).alias("seeds"))
        line = F.struct("mask", "words")
        placed = left.join(seeds, "leaf").withColumn("seed", F.get(F.filter("seeds", lambda t: agree(t, line)), F.lit(0))["mask"]).drop("seeds")
        placed = checkpointed(placed)
        found = placed.where("seed <> mask").select("mask", F.col("seed").alias("template"))
        mapped = found if mapped is None else mapped.unionByName(found)
        left = checkpointed(_unsettled(placed.where("seed is null").drop("seed"), least_docs))
        first = min(2 * first, MOST)
    return mapped


def recurring(
    docs: DataFrame, depth: int = DEPTH, least_docs: int = LEAST_DOCS, similarity: float = SIMILARITY
) -> tuple[DataFrame, DataFrame]:
    """Lines (k1, k2, number, tokens, template), and the templates that recur with their documents."""
    lines = _lines(docs, depth)
    slim = checkpointed(lines.drop("line"))
    mapped = _templates(lines, slim, least_docs, similarity)
    placed = checkpointed(
        beside(slim, mapped, "mask", mapped.count(), BROADCAST_NUMBERS).select(
            "k1", "k2", "number", "tokens", F.coalesce("template", "mask").alias("template")
        )
    )
    shared = checkpointed(
        placed.select("template", "k1", "k2").distinct().groupBy("template").agg(F.count("*").alias("docs")).where("docs > 1")
    )
    counted = beside(placed, shared, "template", shared.count(), BROADCAST_NUMBERS)
    frequent = (F.col("tokens") > depth) & (F.col("docs") >= least_docs)
    documents = counted.groupBy("k1", "k2").agg(
        F.sum("tokens").alias("all"),
        F.sum(F.when(F.col("docs").isNull(), F.col("tokens")).otherwise(0)).alias("own"),
        F.min(F.when(F.col("docs").isNotNull(), F.struct("docs", "template"))).alias("rarest"),
        F.collect_set(F.when(frequent, F.col("template"))).alias("templates"),
    )
    unlike = F.col("own") >= OWN * F.col("all")
    kind = F.when(unlike, F.xxhash64("k1", "k2")).otherwise(F.col("rarest.template"))
    found = (
        documents.select(F.explode("templates").alias("template"), kind.alias("kind"))
        .distinct()
        .groupBy("template")
        .agg(F.count("*").alias("docs"))
        .where(F.col("docs") >= least_docs)
    )
    return placed, checkpointed(found)


def drop_lines(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    depth: int = DEPTH,
    least_docs: int = LEAST_DOCS,
    similarity: float = SIMILARITY,
    dropped: str | None = None,
) -> DataFrame:
    """The documents, with all their columns, without the lines of recurring templates.

    With `dropped`, the numbers of the lines that went are added in a column of that name.
    """
    inner = [f"c{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, inner))
    rows = keyed(docs.toDF(*inner), of[id], of[text])
    slim = rows.select(F.col(of[id]).alias("id"), F.col(of[text]).alias("text"), "k1", "k2")
    placed, found = recurring(slim, depth, least_docs, similarity)
    hit = beside(placed, found.select("template", F.lit(True).alias("hit")), "template", found.count(), BROADCAST_NUMBERS).where("hit")
    gone = checkpointed(hit.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("number")).alias("gone")))
    joined = rows.join(gone, ["k1", "k2"], "left")
    lines = F.split(of[text], "\n", -1)
    joined = joined.withColumn("lines", F.when(F.col("gone").isNotNull(), lines))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.array_join(F.transform(stay, lambda i: F.col("lines")[i]), "\n")
    columns = [
        F.when(F.col("gone").isNull(), F.col(c)).otherwise(kept).alias(c) if c == of[text] else F.col(c) for c in inner
    ]
    names = list(docs.columns)
    if dropped is not None:
        columns.append(F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
        names.append(free_name(names, dropped))
    return joined.select(*columns).toDF(*names)
