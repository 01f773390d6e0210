r"""Document fingerprints: a Merkle tree over sections and paragraphs, with DataFrame functions only.

A text's sections are parted by empty lines, a section's paragraphs by line ends, and a paragraph is cut into leaves of
16 to 64 code points, preferably after a word that ends in one of a few letters: leaves are set by what stands there, so
those behind an inserted letter stay as they are. A leaf's hash is the md5 of its text, a paragraph's that of its leaves' hashes, a section's
that of its paragraphs', the root that of its sections'. Separators are fixed, so the tree covers every character.
The fingerprint is the whole tree as a string, hashes below the root in short::

    root/section(paragraph:leaf.leaf.leaf,paragraph:leaf)/section(...)

so equal roots mean equal texts, and differing branches lead down to the place of an edit: changed() lists them. Likeness of two
fingerprints is 1 for equal roots, else the number of leaves they share over the number of leaves of both
(as sets).

Defined results: null text is empty; empty texts have a root and one empty leaf; rows with equal doc_id have the
same next document (the next greater id; of its rows the one that sorts first); rows with null doc_id have
no next document: their edited text loses its last quarter and near_next is 0; so with a single id, the next document is
itself; very long texts are hashed whole (a fingerprint is about a third of its text); equal texts have equal fingerprints;
an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import broadcast_if_small, materialize, table, text_or_empty

#: A leaf: lazily up to a word's end on one of these letters, else 64 code points.
LEAF = "(?s).{16,62}?[dehnrst][ .,]|.{1,64}"
EDIT_SHARE = 4


def _short(c: Column, digits: int) -> Column:
    return F.substring(F.md5(c.cast("binary")), 1, digits)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where a lambda's body has no other way to name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprint(text: Column) -> Column:
    """The Merkle tree of a text, as a string."""
    whole = lambda hashes: F.md5(F.array_join(hashes, "").cast("binary"))
    of = lambda nodes: F.transform(nodes, lambda n: n["hash"])

    def paragraph(p: Column) -> Column:
        cut = F.when(p == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)))
        short = lambda hashes: F.array_join(F.transform(hashes, lambda h: F.substring(h, 1, 8)), ".")
        return _let(F.transform(cut, lambda x: F.md5(x.cast("binary"))), lambda hashes: F.struct(whole(hashes).alias("hash"), short(hashes).alias("below")))

    def section(s: Column) -> Column:
        below = lambda nodes: F.array_join(F.transform(nodes, lambda p: F.concat(F.substring(p["hash"], 1, 8), F.lit(":"), p["below"])), ",")
        return _let(F.transform(F.split(s, "\n", -1), paragraph), lambda nodes: F.struct(whole(of(nodes)).alias("hash"), below(nodes).alias("below")))

    below = lambda nodes: F.array_join(F.transform(nodes, lambda s: F.concat(F.substring(s["hash"], 1, 12), F.lit("("), s["below"], F.lit(")"))), "/")
    return _let(F.transform(F.split(text, "\n\n", -1), section), lambda nodes: F.concat(whole(of(nodes)), F.lit("/"), below(nodes)))


def changed(a: Column, b: Column) -> Column:
    """Where the text of fingerprint a differs from that of b: an array of (section, paragraph, leaf), counted from 0, of
    the leaves that b lacks. Only branches whose hash b lacks are followed down; equal roots end at once."""
    sections = lambda fp: F.slice(F.split(fp, "/"), F.lit(2), F.size(F.split(fp, "/")))
    paragraphs = lambda s: F.split(F.regexp_extract(s, r"\((.*)\)", 1), ",")
    numbered = lambda xs: F.transform(xs, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    lacking = lambda xs, known: F.filter(numbered(xs), lambda n: ~F.array_contains(known, n["x"]))
    of_b = F.struct(
        sections(b).alias("sections"), F.flatten(F.transform(sections(b), paragraphs)).alias("paragraphs"), leaves(b).alias("leaves"))

    def walk(known: Column) -> Column:
        leaf = lambda s, p: F.transform(
            lacking(F.split(F.substring_index(p["x"], ":", -1), r"\."), known["leaves"]), lambda x: F.struct(s["i"].alias("section"), p["i"].alias("paragraph"), x["i"].alias("leaf")))
        down = lambda s: F.flatten(F.transform(lacking(paragraphs(s["x"]), known["paragraphs"]), lambda p: leaf(s, p)))
        return F.flatten(F.transform(lacking(sections(a), known["sections"]), down))

    return F.when(_root(a) != _root(b), _let(of_b, walk)).otherwise(F.array().cast("array<struct<section:int,paragraph:int,leaf:int>>"))


def leaves(fp: Column) -> Column:
    """The leaf hashes of a fingerprint."""
    return F.regexp_extract_all(fp, F.lit(r"[:.]([0-9a-f]{8})"), F.lit(1))


def _root(fp: str | Column) -> Column:
    return F.substring_index(fp, "/", 1)


def _alike(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    own, other = F.array_distinct(leaves_a), F.array_distinct(leaves_b)
    counts = F.struct(F.size(own).alias("a"), F.size(other).alias("b"), F.size(F.array_intersect(own, other)).alias("both"))
    return F.when(root_a == root_b, F.lit(1.0)).otherwise(_let(counts, lambda n: n["both"].cast("double") / (n["a"] + n["b"] - n["both"])))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints: 1 for equal texts, else the share of leaves in both."""
    return _alike(_root(a), leaves(a), _root(b), leaves(b))


def next_ids(ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Distinct ids -> (doc_id, next_id) in ascending order, the last one followed by the first. Ids are dealt by
    range; only the first id of each range, one row a partition, is looked at across ranges."""
    spark = ids.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ids = materialize(ids.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id")).distinct().repartitionByRange(parts, "doc_id").withColumn("part", F.spark_partition_id()), "ids")
    firsts = sorted_ids.groupBy("part").agg(F.min("doc_id").alias("first"))
    across = F.lead("first").over(W.partitionBy().orderBy("part"))
    firsts = materialize(firsts.select("part", F.coalesce(across, F.min("first").over(W.partitionBy())).alias("after")), "firsts")
    within = F.lead("doc_id").over(W.partitionBy("part").orderBy("doc_id"))
    return sorted_ids.withColumn("within", within).join(broadcast_if_small(firsts), "part").select("doc_id", F.coalesce("within", "after").alias("next_id"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each document.

    Only ids and lengths decide which document follows; texts are shuffled once, by id. That one exchange serves
    both joins: it gives each document's opening, root and leaves to the one before, and takes them in."""
    # an alias would hide that exchanges are alike
    ids = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    base = docs.select(ids, text_or_empty(F.col("text").cast("string")).alias("text"))
    known = base.where("doc_id is not null")
    lengths = known.groupBy("doc_id").agg((F.max(F.length("text")) / EDIT_SHARE).cast("int").alias("k"))
    follow = materialize(next_ids(lengths.select("doc_id")).join(lengths, "doc_id"), "next").withColumnRenamed("doc_id", "taker")
    tree = lambda fp: F.struct(_root(fp).alias("root"), F.unhex(F.array_join(leaves(fp), "")).alias("leaves"))
    first = F.struct(F.xxhash64("text").alias("h"), F.left("text", "k").alias("opening"), _let(fingerprint(F.col("text")), tree).alias("tree"))
    given = known.join(follow, F.col("doc_id") == F.col("next_id")).select("taker", first.alias("n"))
    given = given.groupBy("taker").agg(F.min("n").alias("n")).select("taker", F.col("n.opening").alias("opening"), F.col("n.tree").alias("next_tree"))
    rows = known.join(given, F.col("doc_id") == F.col("taker"), "left").drop("taker")
    none = {"opening": F.lit(None).cast("string"), "next_tree": F.lit(None).cast("struct<root:string,leaves:binary>")}
    k = (F.length("text") / EDIT_SHARE).cast("int")
    edited = F.concat(F.left("text", F.length("text") - k), F.left(F.coalesce("opening", F.lit("")), k))
    rows = rows.unionByName(base.where("doc_id is null").withColumns(none)).withColumn("edited", edited)
    rows = rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_tree")
    next_leaves = F.regexp_extract_all(F.lower(F.hex("next_tree.leaves")), F.lit(".{8}"), F.lit(0))
    of_next = _alike(_root("fingerprint"), leaves(F.col("fingerprint")), F.col("next_tree.root"), next_leaves)
    near = likeness(F.col("fingerprint"), F.col("edited_fingerprint"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near.alias("near_edited"), F.coalesce(of_next, F.lit(0.0)).alias("near_next"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


#: For tables in which every doc_id is there and comes once.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER o, first_value(t) OVER o) AS nt FROM d WINDOW o AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT doc_id, t, left(t, length(t) - length(t) // 4) || left(nt, length(t) // 4) AS ed FROM n),
texts AS (SELECT doc_id, 0 AS kind, t AS x FROM e UNION ALL SELECT doc_id, 1, ed FROM e),
cuts AS (
  SELECT doc_id, kind, x, list_transform(string_split(x, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p:
    list_transform(CASE WHEN p = '' THEN [''] ELSE regexp_extract_all(p, '(?s).{16,62}?[dehnrst][ .,]|.{1,64}') END, lambda l: md5(l)))) AS ls FROM texts),
pars AS (SELECT doc_id, kind, x, ls, list_transform(ls, lambda s: list_transform(s, lambda p: md5(array_to_string(p, '')))) AS ps FROM cuts),
secs AS (SELECT doc_id, kind, x, ls, ps, list_transform(ps, lambda p: md5(array_to_string(p, ''))) AS ss FROM pars),
fp AS (
  SELECT doc_id, kind, x, list_distinct(list_transform(flatten(flatten(ls)), lambda h: h[1:8])) AS leaves, md5(array_to_string(ss, '')) AS root,
    md5(array_to_string(ss, '')) || '/' || array_to_string(list_transform(range(1, len(ss) + 1), lambda i: ss[i][1:12] || '(' ||
      array_to_string(list_transform(range(1, len(ps[i]) + 1), lambda j: ps[i][j][1:8] || ':' || array_to_string(list_transform(ls[i][j], lambda h: h[1:8]), '.')), ',') || ')'), '/') AS f
  FROM secs),
t AS (SELECT *, coalesce(lead(root) OVER o, first_value(root) OVER o) AS nroot, coalesce(lead(leaves) OVER o, first_value(leaves) OVER o) AS nleaves
      FROM fp WHERE kind = 0 WINDOW o AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT t.doc_id, length(t.x)::BIGINT AS n_chars, sha256(u.x) AS edited_sha256, t.f AS fingerprint, u.f AS edited_fingerprint,
  CASE WHEN t.root = u.root THEN 1.0 ELSE len(list_intersect(t.leaves, u.leaves))::DOUBLE / (len(t.leaves) + len(u.leaves) - len(list_intersect(t.leaves, u.leaves))) END::DOUBLE AS near_edited,
  CASE WHEN t.root = t.nroot THEN 1.0 ELSE len(list_intersect(t.leaves, t.nleaves))::DOUBLE / (len(t.leaves) + len(t.nleaves) - len(list_intersect(t.leaves, t.nleaves))) END::DOUBLE AS near_next
FROM t JOIN fp u ON u.kind = 1 AND u.doc_id = t.doc_id
"""
