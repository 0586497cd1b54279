"""A Merkle manifest of a dataset: leaf digests, subroots of each source, the root, and a proof of every row.

Nodes are known by coordinates (tree, level, index).  The trees of the sources are numbered in the order of their sources; the
tree over their subroots is number -1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklight.llm.common import materialise, table
from tracklight.operators.ranks import gapless_rank

#: Columns of a leaf, in the order of its digest.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")
GROUP = 16
#: Bits of a place within a run.
BITS = 4
#: A level of so many nodes, some 100 bytes each, is looked up by a broadcast; larger ones are joined by shuffling.
BROADCAST = 50_000
TOP = -1


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def counted(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 byte count, a colon and the value."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    return digest(*(counted(columns[c]) for c in LEAF))


def tampered_text(text: Column) -> Column:
    """The text with A to Z in lower case."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def _up(level: DataFrame) -> DataFrame:
    """The level above: sixteen neighbours meet in one group, whatever the tree's size."""
    runs = level.groupBy("tree", "level", "width", F.expr(f"idx div {GROUP}").alias("parent")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("run"))
    return runs.select("tree", (F.col("level") + 1).alias("level"), F.col("parent").alias("idx"), F.expr(f"(width + {GROUP - 1}) div {GROUP}").alias("width"), digest(F.array_join("run.digest", "")).alias("digest"))


def _climb(level: DataFrame, widest: int) -> DataFrame:
    """Nodes (tree, level, idx, width, digest) of a level and all above it; width: how many its level has in its tree."""
    found = level
    while widest > 1:
        widest = -(-widest // GROUP)
        level = materialise(_up(level.where("width > 1")), "nodes")
        found = found.unionByName(level)
    return found


def _coordinates(tree: str, place: str, width: str, first_step: int) -> Column:
    """Where a leaf at this place has siblings on the way up: tree, level, step, place and width of each level with other nodes."""
    at = f"named_struct('tree', {tree}, 'level', h, 'step', h + {first_step}, 'place', shiftright({place}, {BITS} * h), 'width', shiftright({width} + shiftleft(1L, {BITS} * h) - 1, {BITS} * h))"
    return F.expr(f"filter(transform(sequence(0, {60 // BITS}), h -> {at}), s -> s.width > 1)")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; see prove().

    Leaves ascend by doc_id (null first), equal ids by their digests; sources ascend bytewise, null first.  Repeated rows are
    leaves of their own; a null field is digested as `-`; a row without a doc_id isn't tampered with; a lone leaf is its subroot,
    and without any siblings the proof is the digest of nothing; an empty table gives no rows; texts of any length and further
    columns of any name are fine.
    """
    read = docs.select(*LEAF)
    plain = {c: F.col(c) for c in LEAF}
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    changed = F.when(hit & F.col("text").isNotNull(), leaf(plain | {"text": tampered_text(F.col("text"))}))
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    leaves = materialise(read.select(source.alias("src"), F.col("doc_id").cast("long").alias("doc_id"), leaf(plain).alias("leaf"), changed.alias("tampered")), "leaves")
    ranked = gapless_rank(leaves, [F.col("doc_id").asc_nulls_first(), F.col("leaf")], ["src"], "idx", materialise)
    sources = gapless_rank(leaves.groupBy("src").agg(F.count(F.lit(1)).alias("width")), ["src"], None, "tree", materialise)
    return prove(ranked.join(sources, "src").drop("src"))


def prove(leaves: DataFrame) -> DataFrame:
    """Proofs of leaves(tree, idx, width, doc_id, leaf, tampered), where idx and width are a leaf's place and the number of
    leaves in its tree.

    The node table is written level by level.  Leaves of one run of sixteen have all siblings above it in common, so each run
    explodes these sibling coordinates once (index and width alone give them), joins them to the node table, and orders and
    joins the digests before and after its own on each level; a leaf adds its siblings within the run, and folds.
    """
    runs = leaves.groupBy("tree", "width", F.expr(f"idx div {GROUP}").alias("run")).agg(F.array_sort(F.collect_list(F.struct("idx", "leaf", "doc_id", "tampered"))).alias("leaves"))
    runs = materialise(runs, "runs")
    widest = runs.agg(F.max("width")).first()[0] or 0
    run_digest = digest(F.array_join("leaves.leaf", ""))
    first = materialise(runs.where("width > 1").select("tree", F.lit(1).alias("level"), F.col("run").alias("idx"), F.expr(f"(width + {GROUP - 1}) div {GROUP}").alias("width"), run_digest.alias("digest")), "nodes")
    nodes = _climb(first, -(-widest // GROUP))
    subroots = materialise(nodes.where("width = 1").select("tree", "digest").unionByName(runs.where("width = 1").select("tree", F.col("leaves")[0]["leaf"].alias("digest"))), "subroots")
    n_trees = subroots.count()
    top = _climb(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), F.lit(n_trees).cast("long").alias("width"), "digest"), n_trees)
    root = (top.where("width = 1").first() or {"digest": None})["digest"]
    table_ = materialise(nodes.unionByName(top).where("width > 1").select("tree", "level", "idx", "digest"), "nodetable")

    steps = F.concat(F.filter(_coordinates("tree", f"run * {GROUP}", "width", 0), lambda s: s["level"] > 0), _coordinates(f"{TOP}L", "tree", f"{n_trees}L", 100))
    asked = runs.select(F.col("tree").alias("of"), "run", F.explode(steps).alias("s")).select("of", "run", "s.*")
    begin = F.expr(f"place - place % {GROUP}")
    siblings = F.filter(F.sequence(begin, F.least(begin + GROUP, F.col("width")) - 1), lambda i: i != F.col("place"))
    asked = asked.select("of", "run", "tree", "level", "step", "place", F.explode(siblings).alias("idx"))
    # What many runs ask for lies on small levels, which are broadcast; a node of a larger level is asked for by few.
    is_top = F.col("tree") == TOP
    counts = table_.groupBy(is_top.alias("top"), "level").count().collect()
    small = F.lit(False)
    for r in counts:
        if r["count"] <= BROADCAST:
            small = small | ((is_top == r["top"]) & (F.col("level") == r["level"]))
    keys = ["tree", "level", "idx"]
    got = asked.where(small).join(F.broadcast(table_.where(small)), keys).unionByName(asked.where(~small).join(table_.where(~small), keys))
    found = got.groupBy("of", "run").agg(F.array_sort(F.collect_list(F.struct("step", "idx", "place", "digest"))).alias("found")).withColumnRenamed("of", "tree")

    joined = lambda keep: lambda step: F.array_join(F.transform(F.filter("found", lambda x: (x["step"] == step) & keep(x)), lambda x: x["digest"]), "")
    before, after = joined(lambda x: x["idx"] < x["place"]), joined(lambda x: x["idx"] > x["place"])
    path = F.transform("steps", lambda s: F.struct(s["step"].alias("step"), before(s["step"]).alias("b"), after(s["step"]).alias("a")))  # a step may be without siblings
    fold = lambda start, over: F.aggregate(over, start, lambda acc, s: digest(s["b"], acc, s["a"]))
    own = F.when(F.col("width") == 1, F.col("leaves")[0]["leaf"]).otherwise(run_digest)
    none = F.array().cast(found.schema["found"].dataType)
    whole = runs.withColumn("steps", steps).join(found, ["tree", "run"], "left").withColumn("found", F.coalesce("found", none)).select("width", "leaves", path.alias("path")).withColumns({"subroot": fold(own, F.filter("path", lambda s: s["step"] < 100)), "above": F.array_join(F.transform("path", lambda s: F.concat(s["b"], s["a"])), "")})
    each = whole.select("width", "subroot", "above", "path", "leaves", F.posexplode("leaves").alias("at", "x"))
    part = lambda start, size: F.array_join(F.transform(F.slice("leaves", start, size), lambda x: x["leaf"]), "")
    each = each.select("width", "subroot", "above", "path", "x.*", part(F.lit(1), F.col("at")).alias("b"), part(F.col("at") + 2, F.greatest(F.size("leaves") - F.col("at") - 1, F.lit(0))).alias("a"))
    start = F.coalesce("tampered", "leaf")
    folded = fold(F.when(F.col("width") == 1, start).otherwise(digest(F.col("b"), start, F.col("a"))), F.col("path"))
    return each.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), digest(F.col("b"), F.col("a"), F.col("above")).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same rows in DuckDB's SQL; the checksum that picks rows to tamper with is built from its polynomial."""
    upper = "".join(map(chr, range(65, 91)))
    joined = lambda text: " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in (*LEAF[:-1], text))
    up = f"level + 1, idx // {GROUP}, (width + {GROUP - 1}) // {GROUP}, sha256(string_agg(digest, '' order by idx))"
    grouped = f"group by tree, level, width, idx // {GROUP}"
    return f"""with recursive byte as materialized (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda x, y: case when (x & 1) = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) as t),
docs as materialized (select row_number() over () as r, doc_id, coalesce('=' || source, '') as src, sha256({joined("text")}) as leaf,
  case when text is not null and xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda x, b: xor(t[(xor(x, b) & 255) + 1], x >> 8)), 4294967295) % 5 = 0
  then sha256({joined(f"translate(text, '{upper}', '{upper.lower()}')")}) end as tampered from documents, byte),
sources as materialized (select src, row_number() over (order by src) - 1 as tree, count(*) as width from docs group by src),
leaves as materialized (select r, doc_id, leaf, tampered, tree, width, row_number() over (partition by src order by doc_id nulls first, leaf) - 1 as idx from docs join sources using (src)),
nodes(tree, level, idx, width, digest) as (select tree, 0, idx, width, leaf from leaves union all select tree, {up} from nodes where width > 1 {grouped}),
tops(tree, level, idx, width, digest) as (select -1::bigint, 0, tree, (select count(*) from sources), digest from nodes where width = 1 union all select tree, {up} from tops where width > 1 {grouped}),
inner_nodes as materialized (select * from nodes where width > 1 union all select * from tops where width > 1),
siblings as materialized (select x.tree, x.level, x.idx, coalesce(string_agg(y.digest, '' order by y.idx) filter (where y.idx < x.idx), '') as before, coalesce(string_agg(y.digest, '' order by y.idx) filter (where y.idx > x.idx), '') as after
  from inner_nodes x join inner_nodes y on x.tree = y.tree and x.level = y.level and x.idx // {GROUP} = y.idx // {GROUP} group by 1, 2, 3),
steps as materialized (select r, before, after, row_number() over (partition by r order by step) as k from (
  select r, before, after, s.level as step from leaves l join siblings s on s.tree = l.tree and s.idx = l.idx // (1::bigint << (4 * s.level))
  union all select r, before, after, s.level + 100 from leaves l join siblings s on s.tree = -1 and s.idx = l.tree // (1::bigint << (4 * s.level)))),
folds(r, k, digest) as (select r, 0::bigint, coalesce(tampered, leaf) from leaves union all select f.r, s.k, sha256(s.before || f.digest || s.after) from folds f join steps s on s.r = f.r and s.k = f.k + 1),
folded as (select r, arg_max(digest, k) as folded_root from folds group by r),
proofs as (select r, sha256(string_agg(before || after, '' order by k)) as proof from steps group by r)
select l.doc_id, l.leaf, n.digest as subroot, o.digest as root, coalesce(proof, sha256('')) as proof_sha256, folded_root, folded_root = o.digest as verified
from leaves l join folded using (r) left join proofs using (r) join nodes n on n.tree = l.tree and n.width = 1 join tops o on o.width = 1"""
