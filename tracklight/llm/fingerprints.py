"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.  DataFrame functions only.

A paragraph is a line; a line of more than LONG characters is cut at places that the hashes of its own words decide (of its
pairs of characters, in words of scripts without spaces), so that an edit costs only its surroundings, in any script.  Each distinct
paragraph is one key, a 64-bit hash, so texts that differ in the order or the repeats of paragraphs alone have one fingerprint.  A key is added to one cell in each of three parts of
the sketch; a cell holds the number, the XOR of the keys and the XOR of their check hashes.  A sketch is kept as a row for each
cell that isn't empty, so that adding, subtracting and peeling are aggregates.  Subtracting two sketches cancels what the texts
share, and peeling (a cell with one key gives it away and lets it be taken from its other cells) recovers the
keys that differ.  Where cells are left over, both sketches are made anew with twice the cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklight.llm.common import materialise, release, table, texts

#: Cells in each part of the smallest sketch, cells for each key, how often a pair of sketches is made larger, peeling rounds.
LEAST, ROOM, RETRIES, ROUNDS = 8, 4, 4, 6
#: Lines longer than LONG are cut before one word in WORDS; words longer than UNBROKEN are cut before one character in
#: CHARACTERS, by it and the next.
LONG, WORDS, UNBROKEN, CHARACTERS = 120, 10, 24, 40
_AFTER_SPACE, _CHARACTER = r"(?<=[\x20\x09])", r"(?![\uDC00-\uDFFF])"


def _cut_line(line: Column) -> Column:
    """The line in pieces, by its own words."""
    cut = lambda t, key, one_in: F.when(F.pmod(key, F.lit(one_in)) == 0, F.concat(F.lit("\x00"), t)).otherwise(t)

    def word(w: Column) -> Column:
        chars = F.split(w, _CHARACTER)
        following = F.concat(F.slice(chars, F.lit(2), F.size(chars)), F.array(F.lit("")))
        return F.when(F.length(w) > UNBROKEN, F.array_join(F.zip_with(chars, following, lambda c, d: cut(c, F.xxhash64(c, d), CHARACTERS)), "")).otherwise(cut(w, F.xxhash64(w), WORDS))

    return F.split(F.array_join(F.transform(F.split(line, _AFTER_SPACE), word), ""), "\x00")


def paragraph_keys(text: Column) -> Column:
    """The distinct paragraphs' hashes, sorted."""
    pieces = F.flatten(F.transform(F.split(text, "\n"), lambda p: F.when(F.length(p) > LONG, _cut_line(p)).otherwise(F.array(p))))
    return F.sort_array(F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p))))


def sketch_size(n_keys: Column) -> Column:
    """Cells in each part of the sketch of so many keys: a power of two."""
    need = F.greatest(F.ceil(n_keys * ROOM / 3), F.lit(1)).cast("long")
    return F.greatest(F.pow(F.lit(2), F.length(F.bin(need - 1))).cast("long"), F.lit(LEAST).cast("long"))


def _place(k: Column, j: int, size: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(k, F.lit(3 * seed + j)), size) + j * size


def _cells(entries: DataFrame, by: list[str]) -> DataFrame:
    """Entries (c, n, k, h) of the same cell summed, without cells that come to nothing.  Rows of a document stand in one
    partition, so nothing is shuffled."""
    return entries.groupBy(*by, "size", "c").agg(F.sum("n").cast("int").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h")).where("n <> 0 or k <> 0 or h <> 0")


def sketches(keys: DataFrame, by: list[str], seed: int = 0) -> DataFrame:
    """by, size, c, n, k, h: the cells of the sum of each group's keys; keys: by, size, k, n (1 or, to subtract, -1)."""
    each = F.explode(F.array(*(_place(F.col("k"), j, F.col("size"), seed) for j in range(3))))
    return _cells(keys.select(*by, "size", each.alias("c"), "n", "k", F.hash("k").alias("h")), by)


def peeled(cells: DataFrame, by: list[str], seed: int) -> DataFrame:
    """by, found (keys recovered), failed (cells are left over).

    In turn each part's cells of one key give it away; it is taken from its cells in the other two parts.  A key has one cell
    in a part, so it is never taken twice.  Cell -1 counts what has been found.
    """
    k, size = F.col("k"), F.col("size")
    at = lambda c, n, k, h: F.struct(c.alias("c"), n.alias("n"), k.alias("k"), h.alias("h"))
    for _ in range(ROUNDS):
        for j in range(3):
            pure = (F.abs("n") == 1) & (F.hash("k") == F.col("h")) & (F.col("c") == _place(k, j, size, seed))
            others = [at(_place(k, i, size, seed), -F.col("n"), k, F.col("h")) for i in range(3) if i != j]
            one = at(F.lit(-1).cast("long"), F.lit(1), F.lit(0).cast("long"), F.lit(0))
            moves = F.when(pure, F.array(one, *others)).otherwise(F.array(at(F.col("c"), F.col("n"), k, F.col("h"))))
            cells = _cells(cells.select(*by, "size", F.inline(moves)), by)
    return cells.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("c") < 0, F.col("n"))), F.lit(0)).alias("found"), (F.max("c") >= 0).alias("failed"))


def written(cells: DataFrame, by: list[str]) -> DataFrame:
    """by and the fingerprint as text: the cells of a part, then each cell that isn't empty (place, number, keys and checks, in
    hexadecimal but for the number)."""
    hex_ = lambda c: F.lower(F.hex(c))
    one = lambda x: F.concat_ws(".", hex_(x["c"]), x["n"].cast("string"), hex_(x["k"]), hex_(x["h"].cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))
    rows = cells.groupBy(*by).agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("c", "n", "k", "h"))).alias("cells"))
    return rows.select(*by, F.concat_ws(";", F.col("size").cast("string"), F.array_join(F.transform("cells", one), ",")).alias("fingerprint"))


PAIRS = ("edited", "next")


def likenesses(docs: DataFrame) -> DataFrame:
    """id, tag, pair (of PAIRS), found (paragraphs that only one of the two has) and tries (how many pairs of sketches it took;
    RETRIES + 2: the keys themselves).  docs: id, tag, own_keys, edited_keys, next_keys.

    The first try subtracts the fingerprints' own sketches, the smaller one made at the size of the larger: that has room for
    the keys of both, as a fingerprint has ROOM cells for each key.  Each retry takes twice the cells, with other places; only
    pairs that failed are tried again.  What no try peels is settled by the keys.
    """
    by, done = ["id", "tag", "pair"], None
    pairs = F.explode(F.array(*(F.struct(F.lit(p).alias("pair"), F.col(f"{p}_keys").alias("other")) for p in PAIRS)))
    todo = docs.select("id", "tag", F.col("own_keys").alias("own"), pairs.alias("x")).select("id", "tag", "x.pair", "own", "x.other").where("own <> other")
    for k in range(RETRIES + 1):
        size = F.greatest(sketch_size(F.size("own")), sketch_size(F.size("other"))) * 2**k
        signed = F.concat(F.transform("own", lambda x: F.struct(x.alias("k"), F.lit(1).alias("n"))), F.transform("other", lambda x: F.struct(x.alias("k"), F.lit(-1).alias("n"))))
        keys = todo.repartition("id", "tag").select(*by, size.alias("size"), F.inline(signed))
        tried = materialise(peeled(sketches(keys, by, k), by, k), "peeled")
        good = tried.where("not failed").select(*by, "found", F.lit(k + 1).alias("tries"))
        done = good if done is None else done.unionByName(good)
        todo = todo.join(tried.where("failed").select(*by), by, "left_semi")
        if tried.where("failed").isEmpty():
            return done
    rest = todo.select(*by, (F.size(F.array_except("own", "other")) + F.size(F.array_except("other", "own"))).cast("long").alias("found"), F.lit(RETRIES + 2).alias("tries"))
    return done.unionByName(rest)


def next_documents(docs: DataFrame) -> DataFrame:
    """doc_id, tag, next_id, next_tag: each distinct document (doc_id and the hash of its text) with the one that follows it by
    doc_id and tag; after the last: the first.  A null doc_id is before all others.

    Ids alone are dealt into ranges of about equal numbers, whatever they are; the window over a range knows all but the last
    one's follower, which is the head of the next range.  There are as many heads as ranges.
    """
    ids = docs.select("doc_id", "tag").distinct().repartitionByRange("doc_id", "tag").withColumn("range", F.spark_partition_id())
    ids = materialise(ids, "ranges")
    heads = ids.groupBy("range").agg(F.min(F.struct("doc_id", "tag")).alias("head"))
    every = Window.orderBy("range")
    after = heads.select("range", F.coalesce(F.lead("head").over(every), F.first("head").over(every)).alias("after"))
    own = Window.partitionBy("range").orderBy("doc_id", "tag")
    follow = ids.join(after, "range").withColumn("f", F.coalesce(F.lead(F.struct("doc_id", "tag")).over(own), F.col("after")))
    return follow.select("doc_id", "tag", F.col("f.doc_id").alias("next_id"), F.col("f.tag").alias("next_tag"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """The fingerprints of all documents and of their edited texts, and their likenesses.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and how many tries each likeness
    took.  The edited text has the last quarter of the code points replaced by the first ones of the next document.  A null
    text counts as empty; a null doc_id comes before all others; documents that share a doc_id follow each other in the order
    of their texts' hashes; rows that share both are one document and get equal rows; a single document is its own next; other
    columns are ignored; an empty table gives an empty result.
    """
    id_ = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))  # so that null ids join
    rows = texts(docs).select(id_.alias("id"), F.xxhash64("text").alias("tag"), "text", paragraph_keys(F.col("text")).alias("own_keys"))
    n = F.length("text")
    chain = materialise(next_documents(rows.select(F.col("id").alias("doc_id"), "tag")), "follow")
    lengths = rows.select("id", "tag", F.floor(n / 4).cast("int").alias("need")).distinct()
    sought = chain.join(lengths.withColumnRenamed("id", "doc_id"), ["doc_id", "tag"]).select(F.col("next_id").alias("id"), F.col("next_tag").alias("tag"), F.col("doc_id").alias("to_id"), F.col("tag").alias("to_tag"), "need")
    sought = materialise(sought, "sought")
    sent = rows.join(sought, ["id", "tag"]).select("to_id", "to_tag", F.substr("text", F.lit(1), F.col("need")).alias("start"), F.col("own_keys").alias("next_keys"))
    sent = sent.dropDuplicates(["to_id", "to_tag"]).select(F.col("to_id").alias("id"), F.col("to_tag").alias("tag"), "start", "next_keys")
    got = rows.join(sent, ["id", "tag"])
    quarter = F.floor(n / 4).cast("int")
    got = got.select("id", "tag", n.cast("long").alias("n_chars"), F.concat(F.substr("text", F.lit(1), n - quarter), "start").alias("edited"), "own_keys", "next_keys")
    got = got.select("id", "tag", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own_keys", paragraph_keys(F.col("edited")).alias("edited_keys"), "next_keys")
    sides = ("own", "edited", "next")
    docs = materialise(got, "paragraphs")
    release(chain, sought)
    like = materialise(likenesses(docs).groupBy("id", "tag").pivot("pair", list(PAIRS)).agg(F.max("found").alias("found"), F.max("tries").alias("tries")), "likeness")
    by = ["id", "tag", "version"]
    versions = F.explode(F.array(*(F.struct(F.lit(v).alias("version"), F.col(f"{v}_keys").alias("keys")) for v in ("own", "edited"))))
    keys = docs.repartition("id", "tag").select("id", "tag", versions.alias("x")).select("id", "tag", "x.version", sketch_size(F.size("x.keys")).alias("size"), F.explode("x.keys").alias("k"), F.lit(1).alias("n"))
    prints = written(sketches(keys.distinct(), by), by).groupBy("id", "tag").agg(*(F.max(F.when(F.col("version") == v, F.col("fingerprint"))).alias(v) for v in ("own", "edited")))
    shown = docs.join(prints, ["id", "tag"]).join(like, ["id", "tag"], "left")
    near = lambda p: F.greatest(F.lit(0.0), 1 - F.coalesce(f"{p}_found", F.lit(0)) / (F.size("own_keys") + F.size(f"{p}_keys")))
    tries = lambda p: F.coalesce(f"{p}_tries", F.lit(0))
    return shown.select(F.nullif("id", F.lit(-(2**63))).alias("doc_id"), "n_chars", "edited_sha256", F.col("own").alias("fingerprint"), F.col("edited").alias("edited_fingerprint"), near("edited").alias("near_edited"), near("next").alias("near_next"), tries("edited").alias("near_edited_tries"), tries("next").alias("near_next_tries"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))
