"""Near-duplicate lines by a deletion-neighbourhood join.  DataFrame functions only.

The unit of an edit is a word: two lines are alike if one word's insertion, deletion or replacement makes them equal, which
covers any edits of characters inside a word.  Lines whose shorter one has fewer than `min_words` words must be equal (one
word of five is the 0.8 that near-duplicates need).

A line stands at (doc_id, tag, line_no); the tag is a hash of the text, so rows that share a doc_id but not a text are documents
of their own, in the order of their tags, and rows that share both are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklight.llm.common import materialise, release, table, texts

PLACE = ("doc_id", "tag", "line_no")


def clean_lines(text: Column) -> Column:
    """The lines of a text with runs of white space made one space; lines can keep a space at their ends."""
    odd = F.contains(text, F.lit("  "))
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(text, F.lit(c))
    clean = F.regexp_replace(text, r"\x20*[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*|\x20{2,}", " ")
    return F.split(F.when(odd, clean).otherwise(text), "\n")  # most texts have no run to find


def n_words(normal: Column) -> Column:
    """How many words a line has that is trimmed and has single spaces."""
    return (F.octet_length(normal) - F.octet_length(F.replace(normal, F.lit(" "), F.lit(""))) + 1).cast("int")


def keyed_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """PLACE, key and more (128 bits of the line's words) and halves (half keys, none for short lines) of each line with a word.  Texts
    go no further than this, and runs of white space are sought once for each text."""
    cut = docs.select("doc_id", "tag", F.posexplode(clean_lines(F.col("text"))).alias("line_no", "line"))
    own = cut.select(*PLACE, F.trim("line").alias("normal")).where("normal <> ''")
    some = own.select(*PLACE, "normal", n_words(F.col("normal")).alias("n"))
    halves = F.when(F.col("n") >= min_words, half_keys(F.col("normal"), F.col("n"), min_words)).otherwise(F.array().cast("array<bigint>"))
    return some.select(*PLACE, F.xxhash64("normal").alias("key"), F.xxhash64(F.lit("more"), "normal").alias("more"), halves.alias("halves"))


def half_keys(normal: Column, n: Column, min_words: int) -> Column:
    """Keys of the first and last words of a line, such that two lines within one word share a key.

    Lengths fall into classes (four for each doubling).  The key of a class that starts at b has b div 2 words; an edit of a
    line of b words or more leaves that many at one end whole.  A pair meets in the class of its shorter line, so a line that
    begins a class has the keys of the class before it too.
    """

    def start(m: Column) -> Column:
        step = F.pow(F.lit(2), F.greatest(F.length(F.bin(m)) - 3, F.lit(0))).cast("int")
        return (m - m % step).cast("int")

    def of(b: Column) -> list[Column]:
        half = F.floor(b / 2).cast("int")
        part = lambda k: F.call_function("substring_index", normal, F.lit(" "), k)
        return [F.xxhash64(b, F.lit("first"), part(half)), F.xxhash64(b, F.lit("last"), part(-half))]

    first_of_class = (start(n - 1) != start(n)) & (n > min_words)
    return F.when(first_of_class, F.array(*of(start(n)), *of(start(n - 1)))).otherwise(F.array(*of(start(n))))


def possible_lines(docs: DataFrame, first: DataFrame) -> DataFrame:
    """PLACE, normal (single spaces) and n (words) of the distinct lines that share a half with another; no other line can be
    within one word of one.  They are cut from the texts of the documents that have any; the texts are shuffled whatever
    the size, so that a small run tells what a large one takes."""
    halves = first.select(*PLACE, F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("half")
    able = materialise(halves.join(shared, "half", "left_semi").groupBy("doc_id", "tag").agg(F.collect_set("line_no").alias("at")), "able")
    picked = lambda e: F.transform("at", lambda i: F.struct(i.alias("line_no"), F.trim(F.get(e, i)).alias("normal")))
    own = docs.join(able.hint("merge"), ["doc_id", "tag"]).select("doc_id", "tag", F.inline(F.transform(F.array(clean_lines(F.col("text"))), picked)[0])).dropDuplicates(PLACE)
    possible = materialise(own.withColumn("n", n_words(F.col("normal"))), "possible")
    release(able)
    return possible


def variants(possible: DataFrame) -> DataFrame:
    """place, n, p, h, g: 128 bits of each line without its word p, and of the whole line (p = -1).

    Bits of a word sequence are the XOR of each word's hash with its place.  Without word p, the words before it keep their
    places and those after it move down by one, so running XORs over the line's words give all its variants in one pass,
    however long the line is.
    """
    each = possible.select(*PLACE, "n", F.posexplode(F.split("normal", " ")).alias("p", "w"))
    stay = lambda seed: F.xxhash64(F.lit(seed), "w", "p")
    moved = lambda seed: F.xxhash64(F.lit(seed), "w", F.col("p") - 1)
    each = each.select(*PLACE, "n", "p", stay(1).alias("a1"), moved(1).alias("b1"), stay(2).alias("a2"), moved(2).alias("b2"))
    line = Window.partitionBy(*PLACE)
    before = line.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    run = {}
    for k in ("1", "2"):
        run[f"v{k}"] = F.coalesce(F.bit_xor(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))).over(before), F.lit(0)).bitwiseXOR(F.bit_xor(f"b{k}").over(line)).bitwiseXOR(F.col(f"b{k}"))
        run[f"whole{k}"] = F.bit_xor(f"a{k}").over(line)
    got = each.withColumns(run)
    one = lambda p, h, g: F.struct(p.alias("p"), h.alias("h"), g.alias("g"))
    own = one(F.col("p"), F.col("v1"), F.col("v2"))
    all_ = F.when(F.col("p") == 0, F.array(own, one(F.lit(-1), F.col("whole1"), F.col("whole2")))).otherwise(F.array(own))
    return got.select(F.struct(*PLACE).alias("place"), "n", F.inline(all_))


def repeated_variants(emitted: DataFrame) -> DataFrame:
    """The variants under a key that others share; few are, so a narrow row for each finds them and the others go no further.

    A key has the length of the line without a word, as it is for insertions and deletions; those that replacements
    meet under are parts of it.
    """
    keyed = emitted.withColumn("k", F.xxhash64("h", "g", F.when(F.col("p") >= 0, F.col("n") - 1).otherwise(F.col("n"))))
    shared = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k")
    return keyed.join(shared, "k", "left_semi").drop("k")


def near_pairs(emitted: DataFrame, min_words: int) -> DataFrame:
    """place of lines and other, an earlier line that shares a deletion variant with each: the earliest under every key.

    Replacements meet under the key of the variant and its position, insertions and deletions under the key of the longer
    line's variant and the shorter line itself; as all lines under one key are alike, its earliest line is all that the others
    need, so no pairs are made within a key.
    """
    key = ["h", "g", "n"]
    replaced = emitted.where("p >= 0").groupBy(*key, "p").agg(F.min("place").alias("low"), F.max("place").alias("high")).where("low <> high")
    by_place = emitted.join(replaced, [*key, "p"]).where("place <> low").select("place", F.col("low").alias("other"))
    longer = emitted.where(f"p >= 0 and n > {min_words}").select("h", "g", (F.col("n") - 1).alias("n"), "place")
    shorter = emitted.where("p = -1").select(*key, "place")
    one_word = longer.groupBy(*key).agg(F.min("place").alias("long_first")).join(shorter, key)
    later_short = one_word.where("long_first < place").select("place", F.col("long_first").alias("other"))
    later_long = longer.withColumnRenamed("place", "long_place").join(shorter, key).where("place < long_place").select(F.col("long_place").alias("place"), F.col("place").alias("other"))
    return by_place.unionByName(later_short).unionByName(later_long).distinct()


def within_one(a: Column, b: Column) -> Column:
    """Whether word arrays a and b differ by at most one inserted, deleted or replaced word."""
    na, nb = F.size(a), F.size(b)
    differs = F.filter(F.sequence(F.lit(1), F.greatest(F.least(na, nb), F.lit(1))), lambda i: ~F.try_element_at(a, i).eqNullSafe(F.try_element_at(b, i)))
    p = F.coalesce(F.try_element_at(differs, F.lit(1)), F.least(na, nb) + 1)  # the first place that differs

    def rest(x: Column, n: Column, at: Column) -> Column:
        return F.slice(x, at, F.greatest(n - at + 1, F.lit(0)))

    return F.when(na == nb, rest(a, na, p + 1) == rest(b, nb, p + 1)).when(na == nb + 1, rest(a, na, p + 1) == rest(b, nb, p)).when(nb == na + 1, rest(a, na, p) == rest(b, nb, p + 1)).otherwise(F.lit(False))


def dropped_lines(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """PLACE of every line that an earlier line equals or is within one word of.  docs: doc_id, tag, text."""
    keyed = materialise(keyed_lines(docs, min_words), "lines")
    first = materialise(keyed.groupBy("key", "more").agg(F.min(F.struct(*PLACE, "halves")).alias("f")).select("key", "more", *(f"f.{c}" for c in PLACE), "f.halves"), "first")
    possible = possible_lines(docs, first)
    emitted = materialise(variants(possible), "variants")
    alike = materialise(repeated_variants(emitted), "alike")
    release(emitted)
    pair = materialise(near_pairs(alike, min_words), "pairs")
    release(alike)
    line = possible.select(F.struct(*PLACE).alias("place"), F.split("normal", " ").alias("w"))
    both = pair.join(line, "place").join(line.select(F.col("place").alias("other"), F.col("w").alias("o")), "other")
    near = both.where(within_one(F.col("w"), F.col("o"))).select("place.*").distinct().withColumn("near", F.lit(True))
    judged = materialise(first.select("key", "more", *PLACE).join(near, [*PLACE], "left").select("key", "more", F.struct(*PLACE).alias("first"), "near"), "judged")
    release(first, possible, pair)
    return keyed.select("key", "more", *PLACE).join(judged, ["key", "more"]).where(F.coalesce("near", F.lit(False)) | (F.struct(*PLACE) != F.col("first"))).select(*PLACE)


def dedup_lines(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """All columns of docs with text without its dropped lines, and n_lines and n_dropped.

    A line goes if an earlier one (by doc_id, then the hash of the text, then line number) equals it, white space aside, or,
    from min_words words on, is within one word of it.  Lines without a word stay.  A null text stays null, an empty one empty;
    a text whose lines all go becomes empty.  Rows that share doc_id and text are one document and lose the same lines; rows
    that share a doc_id alone are documents of their own; rows with a null doc_id are kept as they are.  Any other column is
    kept, whatever its name, but n_lines and n_dropped are replaced.  A line may have any number of words.  An empty table
    gives an empty result.
    """
    own = docs.drop("n_lines", "n_dropped")
    names = own.columns
    rows = own.select(F.struct(*(F.col(f"`{c}`") for c in names if c != "text")).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tag"), F.col("text").cast("string").alias("text"))
    doc = texts(docs, None).where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("tag"), "text")
    gone = dropped_lines(doc, min_words).groupBy("doc_id", "tag").agg(F.collect_set("line_no").alias("gone"))
    lines = F.split("text", "\n")
    left = lambda e: F.array_except(F.sequence(F.lit(0), F.size(e) - 1), F.col("gone"))
    kept = F.transform(F.array(lines), lambda e: F.array_join(F.transform(left(e), lambda i: F.get(e, i)), "\n"))[0]
    found = rows.join(gone, ["doc_id", "tag"], "left").select("row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
    return found.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names), "n_lines", "n_dropped")


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
