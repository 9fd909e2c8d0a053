"""Document fingerprints: a Merkle tree over sections, paragraphs and runs of words, in DataFrame operations only.

A section ends at an empty line, a paragraph at a line's end. A paragraph is cut into runs of four words with the spaces
around them; the hashes of these runs are the tree's leaves, and every other node hashes its children. So equal roots
mean equal texts, and where roots differ, branches are matched by hash: an edit lies in the sections that the other tree
lacks, and there in the paragraphs that it lacks, wherever they stand. A fingerprint is "root:sections:paragraphs:leaves",
the last three as shortened hashes, paragraphs apart by section. Likeness is the share of leaves in matched branches.

Defined cases: a null text is the empty text; the empty text has a root, one section and no leaves; two texts without
leaves are alike (1) only if equal, else 0; rows that repeat, or tie in doc_id, are ordered by their text's hash; null ids
come last; other columns are left out; an empty table gives an empty result; a text's length is not limited.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Up to four words with the spaces around them, or spaces alone: the runs of a paragraph put together are the paragraph.
BLANK, INK = r"[\x20\x09\x0B-\x0D]", r"[^\x20\x09-\x0D]"
LEAF = rf"{BLANK}*(?:{INK}+{BLANK}*){{1,4}}|{BLANK}+"
#: Texts of about this many characters share a range of ids; there are at most MOST_RANGES ranges.
RANGE_CHARS, MOST_RANGES = 4_000_000, 4096


def with_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds name_root, name_sections, name_paragraphs (by section) and name_leaves (shortened) of the column text."""
    node = lambda kind, children: F.sha2(F.concat(F.lit(kind), F.array_join(children, "")), 256)
    leaf = lambda x: F.substring(F.sha2(F.concat(F.lit("l"), x), 256), 1, 32)
    runs = F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), leaf)))
    df = df.withColumn(f"{name}_runs", runs)
    df = df.withColumn(f"{name}_paragraphs", F.transform(f"{name}_runs", lambda s: F.transform(s, lambda p: node("p", p))))
    df = df.withColumn(f"{name}_sections", F.transform(f"{name}_paragraphs", lambda s: node("s", s)))
    df = df.withColumn(f"{name}_leaves", F.transform(F.flatten(F.flatten(f"{name}_runs")), lambda x: F.substring(x, 1, 8)))
    return df.withColumn(f"{name}_root", node("r", F.col(f"{name}_sections"))).drop(f"{name}_runs")


def as_string(name: str):
    sections = F.transform(f"{name}_sections", lambda s: F.substring(s, 1, 16))
    paragraphs = F.transform(f"{name}_paragraphs", lambda s: F.array_join(F.transform(s, lambda p: F.substring(p, 1, 8)), ""))
    return F.concat_ws(":", F.col(f"{name}_root"), F.array_join(sections, "."), F.array_join(paragraphs, "."), F.array_join(f"{name}_leaves", ""))


def likeness(a: str, b: str):
    """1 for equal roots, else the Dice overlap of the distinct leaves, below 1; leaves of branches in both trees are in both."""
    x, y = F.array_distinct(f"{a}_leaves"), F.array_distinct(f"{b}_leaves")
    both, size = F.size(F.array_intersect(x, y)), F.size(x) + F.size(y)
    return F.when(F.col(f"{a}_root") == F.col(f"{b}_root"), 1.0).when(size == 0, 0.0).otherwise(F.least(2.0 * both / size, F.lit(0.999999)))


def edits(a: str, b: str) -> dict:
    """The branches of tree a that tree b lacks: changed_sections ("section", from 0) and changed_paragraphs ("section.paragraph")."""
    gone = F.array_except(f"{a}_sections", f"{b}_sections")
    lost = F.array_except(F.flatten(f"{a}_paragraphs"), F.flatten(f"{b}_paragraphs"))
    text = lambda i: i.cast("string")
    sections = F.filter(F.transform(f"{a}_sections", lambda s, i: F.when(F.array_contains(gone, s), text(i))), lambda x: x.isNotNull())
    at = lambda i: F.filter(F.transform(F.get(F.col(f"{a}_paragraphs"), i), lambda p, j: F.when(F.array_contains(lost, p), F.concat_ws(".", text(i), text(j)))), lambda x: x.isNotNull())
    none = F.expr("cast(array() as array<string>)")
    paragraphs = F.flatten(F.transform(f"{a}_sections", lambda s, i: F.when(F.array_contains(gone, s), at(i)).otherwise(none)))
    equal = F.col(f"{a}_root") == F.col(f"{b}_root")
    return {"changed_sections": F.when(equal, "").otherwise(F.array_join(sections, ",")), "changed_paragraphs": F.when(equal, "").otherwise(F.array_join(paragraphs, ","))}


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the text of the next document by descending doc_id; after the last comes the first.

    Ids are cut into ranges of like size. Each range also gets a copy of the first document of the range that follows,
    so one shuffle by range and one lead inside each range are enough.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text").cast("long") + 16)).first()[0] or 0
    n = int(min(MOST_RANGES, max(1, chars // RANGE_CHARS)))
    bounds = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], max(10_000, 4 * n))).first()[0] if n > 1 else None
    bounds = sorted(set(bounds or []))
    rows = rows.withColumn("part", _range_of(bounds)).withColumn("guard", F.lit(0))
    first = rows.groupBy("part").agg(F.max("doc_id").alias("first_id"))  # at most MOST_RANGES rows
    follows = F.coalesce(F.lead("part").over(Window.orderBy(F.desc("part"))), F.max("part").over(Window.partitionBy()))
    after = first.select(F.col("part").alias("for_part"), follows.alias("part")).join(first, "part")
    one = Window.partitionBy("for_part").orderBy(F.xxhash64("text"), "text")
    guards = rows.join(F.broadcast(after), "part").where(F.col("doc_id").eqNullSafe(F.col("first_id")))
    guards = guards.withColumn("n", F.row_number().over(one)).where("n = 1").select("doc_id", "text", F.col("for_part").alias("part"), F.lit(1).alias("guard"))
    inside = Window.partitionBy("part").orderBy("guard", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")
    return rows.unionByName(guards).withColumn("next_text", F.lead("text").over(inside)).where("guard = 0").select("doc_id", "text", "next_text")


def _range_of(bounds: list[int]):
    """The number of bounds that are at most doc_id, by binary search over literals; null ids are in the lowest range."""
    if not bounds:
        return F.lit(0)

    def search(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") >= bounds[mid], search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(bounds))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are."""
    both = with_next(docs)
    n, half = F.length("text").cast("long"), F.floor(F.length("text") / 2).cast("int")
    both = both.select("doc_id", "text", "next_text", n.alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"))
    out = with_tree(with_tree(with_tree(both, "text", "own"), "edited", "new"), "next_text", "next")
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_string("own").alias("fingerprint"), as_string("new").alias("edited_fingerprint"), likeness("own", "new").alias("near_edited"), likeness("own", "next").alias("near_next"), *[x.alias(k) for k, x in edits("own", "new").items()])
