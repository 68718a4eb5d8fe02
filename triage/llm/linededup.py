r"""Operator 3: fuzzy line deduplication by MinHash, in DataFrame functions alone.

1. Texts are split at \n; of a document's equal lines the first counts, and
   lines without a word carry nothing and go. A line is named by a 128-bit hash.
2. Signature: character shingles that begin at the line's words, and at every
   place of a word longer than SHINGLE until its end is covered: up to SHINGLE
   characters each, over the following blanks and words. The ROWS hashes that
   follow each of BANDS fixed places are a band's samples (one-permutation
   MinHash). Equal lines are summed on the map side, so a line in a third of all
   documents is one row.
3. Banding: lines that share ROWS samples of a band are candidates. First every
   member of a bucket meets the bucket's smallest and largest line; later
   rounds (`buckets.resolve`) only pair members whose components still differ,
   until every pair of a bucket was compared or is connected. All test a parity
   bitmap of the shingle sets first: its XOR never has more bits than the sets
   differ in elements, so it loses nothing.
4. Candidates are verified exactly: the Jaccard similarity of their sets of
   GRAM-character shingles, one at every character of the line, is SIMILARITY
   or more, the shingles taken as 64-bit hashes. Only candidate lines' texts are
   shuffled; a bitmap of fixed size, broadcast, holds back all others.
5. Components of the links (union-find by joins); of each the line of the
   smallest document id is kept, there and nowhere else.

Recall: BANDS bands find 1 - (1 - 0.8^ROWS)^BANDS = 0.998 of the pairs at the
threshold, if the samples are independent, and more of those above it.

Defined results: null, empty and blank texts have no lines; a line shorter than
GRAM is one shingle; ties go to the smaller document id, then line hash; rows of
one id are one document, whose lines are kept in each of its rows that has them;
rows without id come after all others, those of one text as one document; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage.llm.buckets import resolve, unresolved
from triage.llm.common import drop, let, stored
from triage.llm.components import beside, components

SHINGLE, GRAM, BANDS, ROWS, SIMILARITY = 9, 5, 9, 3, 0.8
#: Hashes are that many bits shorter than 64, so that they and their arcs are exact in floating point.
ARC_SHIFT = 12
ARC = float(1 << 52) / BANDS
#: 64-bit words of a line's parity bitmap: of sets that differ in few elements more than similar ones do, few pass.
PARITY = 16
#: Shingles of a line that one row of its parity bitmap's sum takes.
LANES = 4
#: Later rounds have so many times as many hubs as the one before.
SPREAD = 16
#: Bits of the candidate bitmap, 2 MB whatever the input, and its words a row.
BITMAP = 1 << 24
_PAGE = 16
#: Java's \s, the white space of lines.
_BLANKS = " \t\n\x0b\f\r"
#: Stands for a null document id, after all others.
_LAST = (1 << 63) - 1


def worded(text: str = "text") -> Column:
    """Lines of a text that hold a word, in order, repeats included."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.ltrim(x, F.lit(_BLANKS)) != "")


def names(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("l1"), F.xxhash64(line, F.lit(3)).alias("l2")]


def shingles(line: Column) -> Column:
    """The signed shingles of a line, repeats included: one a word, of a word longer than SHINGLE one a character until its end is covered."""
    # Java's \s is BLANK, and tested by a table.
    return F.regexp_extract_all(line, F.lit(rf"(?s)(?=(.{{1,{SHINGLE}}}+))(?:\S{{1,{SHINGLE}}}+(?!\S)|\S)\s*+"), 1)


def grams(line: Column) -> Column:
    """The GRAM-character shingles of a line, from every character on, repeats included, as 64-bit hashes; of a shorter line its whole."""
    # Four bytes a character, in a lambda variable: a shingle is a copy of GRAM * 4 bytes, wherever it begins.
    last = lambda wide: F.greatest(F.lit(1), F.octet_length(wide) - (4 * GRAM - 1))
    return let(F.encode(line, "UTF-32"), lambda wide: F.transform(F.sequence(F.lit(1), last(wide), F.lit(4)), lambda at: F.xxhash64(F.substring(wide, at, F.lit(4 * GRAM)))))


def circle(line: Column) -> Column:
    """A line's distinct shingle hashes in order, as places on a circle."""
    return F.sort_array(F.array_distinct(F.transform(shingles(line), lambda x: F.shiftrightunsigned(F.xxhash64(x), ARC_SHIFT))))


def bands(hashes: Column) -> Column:
    """The band keys of a line with these places on the circle, as an array.

    Band b's samples are the ROWS places that follow the b-th of BANDS equal arcs'
    start: as those of MinHash, two lines share them with the chance that ROWS of
    all their shingles are common. Arcs' starts are sorted among the places, so
    that a start's position counts those before it; a lambda function, which
    isn't compiled, would have to look at every place.
    """
    starts = [F.lit(math.ceil(b * ARC)).cast("long") for b in range(BANDS)]
    among_them = F.sort_array(F.concat(hashes, F.array(*starts)))

    def key(b: int) -> Column:
        before = F.array_position(among_them, starts[b]) - F.lit(b + 1)
        return F.xxhash64(F.lit(b), *[F.get(hashes, F.pmod((before + k).cast("int"), F.size(hashes))) for k in range(ROWS)])

    return F.array(*[key(b) for b in range(BANDS)])


def owners() -> list[Column]:
    """owner and ghost name a row's document: its id, and for a row without one a hash of its text."""
    ghost = F.greatest(F.lit(1), F.shiftrightunsigned(F.xxhash64("text"), 1))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("owner"), F.when(F.col("doc_id").isNull(), ghost).otherwise(F.lit(0)).cast("long").alias("ghost")]


def occurrences(docs: DataFrame) -> DataFrame:
    """(owner, ghost, line): every document's distinct lines."""
    # A plain explode is preceded by a filter that computes the array, too.
    return docs.select(*owners(), F.explode_outer(F.array_distinct(worded())).alias("line")).filter("line is not null")


def signatures(docs: DataFrame) -> DataFrame:
    """(l1, l2, owner, ghost, b0 ...): every distinct line of the corpus, its first document and band keys."""
    rows = occurrences(docs).select("owner", "ghost", *names(F.col("line")), circle(F.col("line")).alias("circle"))
    rows = rows.select("owner", "ghost", "l1", "l2", bands(F.col("circle")).alias("keys"))
    parts = [f"b{b}" for b in range(BANDS)]
    rows = rows.select("owner", "ghost", "l1", "l2", *[F.get("keys", F.lit(i)).alias(c) for i, c in enumerate(parts)])
    last = F.when(F.col("owner") == _LAST, F.col("ghost"))
    out = rows.groupBy("l1", "l2").agg(F.min("owner").alias("owner"), F.min(last).alias("ghost"), *[F.min(c).alias(c) for c in parts])
    return out.withColumn("ghost", F.when(F.col("owner") == _LAST, F.col("ghost")).otherwise(F.lit(0)).cast("long"))


def members(signed: DataFrame) -> DataFrame:
    """(key, line): every line in the buckets of its bands."""
    return signed.select(F.explode(F.array(*[f"b{b}" for b in range(BANDS)])).alias("key"), F.col("l1").alias("line"))


def buckets_of(signed: DataFrame) -> DataFrame:
    """(key, a, b, n), stored: the buckets of two or more lines, with the smallest and the largest."""
    return stored(members(signed).groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("b"), F.count(F.lit(1)).alias("n")).filter("a < b"), "line-buckets")


def large_buckets(signed: DataFrame, buckets: DataFrame) -> DataFrame:
    """(key, line, a, b, n), stored: the members of buckets of three or more."""
    large = buckets.filter("n > 2")
    return stored(beside(among(members(signed), large, "key"), large, "key", signed.count() * BANDS), "line-members")


def candidates(buckets: DataFrame, large: DataFrame) -> DataFrame:
    """(a, b): pairs of line hashes a < b of the first round, each line of a bucket against its smallest and largest."""
    met = large.select("line", F.explode(F.array("a", "b")).alias("hub")).filter("line <> hub")
    met = met.select(F.least("line", "hub").alias("a"), F.greatest("line", "hub").alias("b"))
    return buckets.filter("n = 2").select("a", "b").unionByName(met).distinct()


def bit_of(slot: Column) -> Column:
    """The bit of a 64-bit word that stands for a slot, counted modulo 64."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))


def among(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Rows whose column is among wanted's, and few others: a bitmap of BITMAP bits, broadcast, before any shuffle."""
    slot = F.pmod(F.col(column), F.lit(BITMAP))
    page, word = F.shiftright(slot, 6 + int(math.log2(_PAGE))), F.shiftright(slot, 6).bitwiseAND(F.lit(_PAGE - 1)).cast("int")
    bits = wanted.select(page.alias("__page"), word.alias("__word"), bit_of(slot).alias("__bit"))
    nth = [F.bit_or(F.when(F.col("__word") == w, F.col("__bit")).otherwise(F.lit(0).cast("long"))) for w in range(_PAGE)]
    pages = bits.groupBy("__page").agg(F.array(*nth).alias("__map"))
    hit = F.get("__map", word).bitwiseAND(bit_of(slot)) != 0
    return rows.join(F.broadcast(pages), page == F.col("__page")).filter(hit).drop("__page", "__map")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(l1, line): the lines whose hashes are the distinct w of wanted. A line's occurrences are one row before they are moved."""
    lines = among(occurrences(docs).select("line", F.xxhash64("line").alias("l1")), wanted.withColumnRenamed("w", "l1"), "l1")
    # A semi join would be pushed below the bitmap.
    return lines.groupBy("l1").agg(F.min("line").alias("line")).join(wanted, F.col("l1") == F.col("w")).select("l1", "line")


def similar(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose full shingle sets are similar enough. The sets' sizes, if pairs has them as m and n, aren't counted again."""
    known = "m" in pairs.columns
    for k in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("l1").alias(f"{k}1"), F.col("line").alias(f"line_{k}")), F.col(k) == F.col(f"{k}1")).drop(f"{k}1")
    # Equal parts of one compiled condition are computed once.
    a, b = grams(F.col("line_a")), grams(F.col("line_b"))
    sizes = F.col("m") + F.col("n") if known else F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    either = F.size(F.array_union(a, b))
    return pairs.filter(sizes - either >= F.lit(similarity) * either).select("a", "b")


def sketched(texts: DataFrame) -> DataFrame:
    """(l1, size, p0 ...): each line's number of distinct shingles and their parity bitmap, summed where the line is, LANES shingles a row."""
    # Sorted, a repeat follows its like: no set is needed.
    each = texts.repartition("l1").select("l1", F.sort_array(grams(F.col("line"))).alias("h"))
    each = each.select("l1", "h", F.explode_outer(F.sequence(F.lit(0), F.size("h") - 1, F.lit(LANES))).alias("at"))
    nth = [F.get("h", F.col("at") + k) for k in range(-1, LANES)]
    each = each.select("l1", *[x.alias(f"x{k}") for k, x in enumerate(nth)])
    fresh = [F.col(f"x{k}").isNotNull() & ~F.col(f"x{k}").eqNullSafe(F.col(f"x{k - 1}")) for k in range(1, LANES + 1)]
    bit = [F.when(x, bit_of(F.shiftrightunsigned(f"x{k}", 58))).otherwise(F.lit(0).cast("long")).alias(f"bit{k}") for k, x in enumerate(fresh, 1)]
    word = [F.col(f"x{k}").bitwiseAND(F.lit(PARITY - 1)).cast("int").alias(f"word{k}") for k in range(1, LANES + 1)]
    each = each.select("l1", sum((x.cast("int") for x in fresh), F.lit(0)).alias("n"), *bit, *word)

    def parity(w: int) -> Column:
        mine = [F.when(F.col(f"word{k}") == w, F.col(f"bit{k}")).otherwise(F.lit(0).cast("long")) for k in range(1, LANES + 1)]
        return F.bit_xor(functools.reduce(Column.bitwiseXOR, mine)).alias(f"p{w}")

    return each.groupBy("l1").agg(F.sum("n").cast("int").alias("size"), *[parity(w) for w in range(PARITY)])


def likely(similarity: float) -> Column:
    """Whether a pair of sketched rows (with _a and _b) may be similar enough; of those that are it loses none."""
    m, n = F.col("size_a"), F.col("size_b")
    differ = sum((F.bit_count(F.col(f"p{w}_a").bitwiseXOR(F.col(f"p{w}_b"))) for w in range(PARITY)), F.lit(0))
    sizes = F.least(m, n) >= F.lit(similarity - 1e-9) * F.greatest(m, n)
    return sizes & (F.lit(1 + similarity) * differ <= F.lit(1 - similarity + 1e-9) * (m + n))


def plausible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs that `likely` doesn't rule out, with their sets' sizes m and n: only these move texts."""
    for k in ("a", "b"):
        pairs = pairs.join(sketches.withColumnsRenamed({c: f"{c}_{k}" for c in sketches.columns}), F.col(k) == F.col(f"l1_{k}")).drop(f"l1_{k}")
    return pairs.filter(likely(similarity)).select("a", "b", F.col("size_a").alias("m"), F.col("size_b").alias("n"))


def linked_lines(docs: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """(node, component), stored: the components of similar lines, all pairs of a bucket compared or connected."""
    spark = docs.sparkSession
    found_in = buckets_of(signed)
    large = large_buckets(signed, found_in)
    met = stored(candidates(found_in, large), "line-pairs")
    wanted = stored(met.select(F.explode(F.array("a", "b")).alias("w")).distinct(), "line-wanted")
    texts = stored(texts_of(docs, wanted), "line-texts")
    sketches = stored(sketched(texts), "line-sketches")
    # Pairs that the sketches rule out need no memory: they rule them out again.
    tested = stored(plausible(met, sketches, similarity), "line-tested")
    drop(spark, found_in, wanted, met)
    links = stored(similar(tested, texts, similarity), "line-links")
    found = components(links)
    groups = stored(found, "line-components")
    drop(spark, found, links)
    # Of a bucket of three all pairs were compared.
    left = unresolved(large.select("key", F.col("line").alias("name")), groups, 4)
    drop(spark, large)
    if left.limit(1).count():
        ready = stored(left.join(sketches, F.col("name") == F.col("l1")).drop("l1"), "line-members")
        groups = resolve(ready, groups, tested.select("a", "b"), likely(similarity), lambda new: stored(similar(new, texts, similarity), "line-links"), SPREAD)
        drop(spark, ready)
    drop(spark, left, texts, sketches, tested)
    return groups


def verdicts(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(l1, l2, owner, ghost), stored: the lines that stay, and the document in which each does."""
    signed = stored(signatures(docs), "line-signatures")
    groups = linked_lines(docs, signed, similarity)
    lines = signed.select("l1", "l2", "owner", "ghost")
    tied = lines.join(groups, F.col("l1") == F.col("node"))
    first = tied.groupBy("component").agg(F.min(F.struct("owner", "ghost", "l1", "l2")).alias("f")).select("f.l1", "f.l2", "f.owner", "f.ghost")
    alone = lines.join(groups, F.col("l1") == F.col("node"), "left_anti")
    out = stored(alone.unionByName(first), "line-verdicts")
    drop(docs.sparkSession, signed, groups)
    return out


def _with_kept(rows: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """rows (with owner and ghost) and in __kept the hashes of the lines that stay in their document, as many as it has at most."""
    kept = verdicts(docs, similarity).groupBy("owner", "ghost").agg(F.collect_list("l1").alias("__kept"))
    kept = kept.withColumnsRenamed({"owner": "__o", "ghost": "__g"})
    # Not sorted: rows hold whole texts.
    out = rows.join(kept.hint("shuffle_hash"), (F.col("owner") == F.col("__o")) & (F.col("ghost") == F.col("__g")), "left").drop("__o", "__g")
    return out.withColumn("__kept", F.coalesce("__kept", F.array().cast("array<bigint>")))


def counts(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per row of docs: doc_id, n_lines (with a word, repeats included) and n_kept, the lines of the text that dedup_lines leaves it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    left = dedup_lines(rows, ("doc_id", "text", "n_lines"), similarity)
    # No line that stays is empty.
    n_kept = let(F.coalesce("text", F.lit("")), lambda x: F.when(x == "", F.lit(0)).otherwise(F.size(F.split(x, "\n"))))
    return left.select("doc_id", "n_lines", n_kept.cast("long").alias("n_kept"))


def dedup_lines(docs: DataFrame, columns: tuple[str, ...], similarity: float = SIMILARITY) -> DataFrame:
    """Every row of docs with only its kept lines in text, and n_chars to match (pipeline stage); n_lines, if asked for, counts the lines it had."""
    rows = _with_kept(docs.select(*[c for c in columns if c in docs.columns], *owners()), docs, similarity)

    def left(lines: Column) -> Column:
        # What goes is mostly nothing or little: membership is looked up there.
        gone = F.array_except(F.transform(lines, lambda x: F.xxhash64(x)), "__kept")
        return let(gone, lambda g: F.when(F.size(g) == 0, lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(g, F.xxhash64(x)))))

    # One lambda variable holds the lines, which a text is split to once.
    made = let(worded(), lambda every: let(F.array_distinct(every), lambda lines: F.struct(F.size(every).cast("long").alias("n"), F.array_join(left(lines), "\n").alias("text"))))
    rows = rows.withColumn("__made", made)
    rows = rows.withColumn("text", F.when(F.col("text").isNotNull(), F.col("__made.text"))).withColumn("n_chars", F.length("text").cast("long"))
    return (rows.withColumn("n_lines", F.col("__made.n")) if "n_lines" not in docs.columns else rows).select(*columns)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: its lines with a word, how many are kept, and how many go."""
    out = counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("n_removed", F.col("n_lines") - F.col("n_kept"))
