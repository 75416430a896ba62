"""Line dedup by a tree of line templates, in DataFrame operations only.

The tree has fixed depth: a line goes by its number of tokens and then by its `depth` leading tokens, where a token with
a digit counts as a variable field. In a leaf, a token stays a constant of its place if lines of at least `min_docs`
documents have it there; every other place is a variable field. A line's template is its leaf with the constants of its
places. A template without variable fields may be a single token, as lines of scripts without spaces are; one with them
needs at least `min_tokens`, of which the share `constant` must be constants, so that prose lines that start alike are no
template.

A template met in at least `min_docs` documents recurs: its lines are dropped everywhere but at its first place (smallest
document, then line), so no text leaves the corpus whole.

Rows with equal id and text are one document and get the same result; rows with equal id and different texts are
ordered by a hash of the text. Null ids come first. Null texts stay null, blank lines and empty texts stay as they are,
and other columns pass. Lines are only shuffled by hashed keys, in joins and partial aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import checkpoint, shielded

SPACE = "[ \\t-\\r]"
#: A token with a digit; matching starts at token starts only, so a long token costs one pass.
FIELD = "(?<![^ \\t-\\r])[^ \\t-\\r0-9]*+[0-9][^ \\t-\\r]*"
MARK = "<*>"


@dataclass(frozen=True)
class Tree:
    depth: int = 3
    min_docs: int = 3
    min_tokens: int = 5
    constant: float = 0.75


def masked(line: Column) -> Column:
    """Tokens of a line with one space between them; tokens with a digit become the mark of a variable field."""
    fields = F.when(line.rlike("[0-9]"), F.regexp_replace(line, FIELD, MARK)).otherwise(line)
    even = F.trim(F.regexp_replace(fields, f"{SPACE}{{2,}}|[\\t-\\r]", " "))
    # Most lines have neither digits nor odd white space, which one look tells.
    return F.when(line.rlike("[0-9\\t-\\r]|  "), even).otherwise(F.trim(line))


def lines(docs: DataFrame, text: str, tree: Tree) -> DataFrame:
    """Non-blank lines with their leaf: number of tokens and leading tokens, as hashes."""
    # Masked before the lines are taken apart, so that no later filter computes it again.
    bodies = F.transform(F.split(text, "\n"), masked)
    rows = docs.where(F.col(text).isNotNull()).select("_id", F.xxhash64(text).alias("_th"), F.posexplode(bodies).alias("_line", "_body"))
    n = F.length("_body") - F.length(F.replace("_body", F.lit(" "))) + 1
    return rows.where(~F.col("_body").isin("", MARK)).withColumn("_leaf", F.xxhash64(n, F.substring_index("_body", " ", tree.depth)))


def candidates(docs: DataFrame, text: str, tree: Tree) -> DataFrame:
    """Lines whose leaf at least `min_docs` documents share."""
    found = lines(docs, text, tree)
    leaves = found.select("_leaf", "_id", "_th").distinct().groupBy("_leaf").count().where(F.col("count") >= tree.min_docs)
    return found.join(leaves.select("_leaf"), "_leaf").withColumn("_hash", F.xxhash64("_body"))


def templates(found: DataFrame, tree: Tree) -> DataFrame:
    """`_leaf`, `_hash` of each distinct line with its `_template` hash; lines that may not be generalised are left out."""
    in_doc = found.groupBy("_leaf", "_hash", "_id", "_th").agg(F.first("_body").alias("_body"))
    distinct = in_doc.groupBy("_leaf", "_hash").agg(F.count(F.lit(1)).alias("_docs"), F.first("_body").alias("_body"))
    distinct = checkpoint(distinct)
    mixed = distinct.groupBy("_leaf").agg(F.min("_docs").alias("_least"), F.count(F.lit(1)).alias("_kinds"))
    mixed = mixed.where((F.col("_kinds") > 1) & (F.col("_least") < tree.min_docs)).select("_leaf")
    tokens = distinct.join(mixed, "_leaf").select("_leaf", "_hash", "_docs", F.posexplode(F.split("_body", " ")).alias("_at", "_token"))
    constants = tokens.groupBy("_leaf", "_at", "_token").agg(F.sum("_docs").alias("_support"))
    constants = constants.where((F.col("_support") >= tree.min_docs) & (F.col("_token") != MARK)).drop("_support")
    fixed = tokens.select("_leaf", "_hash", "_at", "_token").join(constants, ["_leaf", "_at", "_token"])
    fixed = fixed.groupBy("_leaf", "_hash").agg(F.sort_array(F.collect_list(F.struct("_at", "_token"))).alias("_fixed"))
    general = distinct.join(fixed, ["_leaf", "_hash"], "left")
    whole = F.split("_body", " ")
    # Lines of leaves that are not mixed recur as they are, or not at all.
    plain = F.filter(F.transform(whole, lambda t, i: F.struct(i.alias("_at"), t.alias("_token"))), lambda x: x["_token"] != MARK)
    general = general.withColumn("_fixed", F.coalesce("_fixed", F.when(F.col("_docs") >= tree.min_docs, plain)))
    n, kept = F.size(whole), F.size("_fixed")
    good = F.col("_fixed").isNotNull() & ((kept == n) | ((n >= tree.min_tokens) & (kept >= n * tree.constant)))
    return general.where(good).select("_leaf", "_hash", F.xxhash64("_leaf", "_fixed").alias("_template"))


def dropped(docs: DataFrame, text: str, tree: Tree) -> DataFrame:
    """`_id`, `_th` and the sorted numbers of the lines that go."""
    found = checkpoint(candidates(docs, text, tree))
    marked = checkpoint(found.drop("_body").join(templates(found, tree), ["_leaf", "_hash"]).select("_id", "_th", "_line", "_template"))
    firsts = marked.groupBy("_template", "_id", "_th").agg(F.min("_line").alias("_line"))
    recurring = firsts.groupBy("_template").agg(F.count(F.lit(1)).alias("_docs"), F.min(F.struct("_id", "_th", "_line")).alias("_first"))
    recurring = recurring.where(F.col("_docs") >= tree.min_docs).select("_template", "_first")
    gone = marked.join(recurring, "_template").where(~F.struct("_id", "_th", "_line").eqNullSafe(F.col("_first")))
    return gone.groupBy("_id", "_th").agg(F.sort_array(F.collect_set("_line")).alias("_gone"))


@shielded("doc_id", "text")
def drop_recurring(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tree: Tree = Tree()) -> DataFrame:
    """`docs` with recurring lines taken out of `text`, and `n_lines` and `n_dropped`."""
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    own = docs.select(F.col(doc_id).alias("_id"), text)
    gone = dropped(own, text, tree).withColumnRenamed("_id", "_gid").withColumnRenamed("_th", "_gth")
    # The text travels as its lines, which a lambda above the join can then take by number.
    rows = docs.select(*[F.split(c, "\n").alias(c) if c == text else c for c in kept], F.xxhash64(text).alias("_th"))
    rows = rows.join(gone, rows[doc_id].eqNullSafe(F.col("_gid")) & (F.col("_th") == F.col("_gth")), "left")
    numbers = F.array_except(F.sequence(F.lit(0), F.size(text) - 1), "_gone")
    left = F.transform(numbers, lambda i: F.col(text)[i])
    return rows.select(
        *[F.array_join(F.when(F.col("_gone").isNull(), F.col(c)).otherwise(left), "\n").alias(c) if c == text else c for c in kept],
        F.greatest(F.size(text), F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
