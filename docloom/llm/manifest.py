"""Merkle manifest of a table: leaf digests, one tree per group, and a checked proof for every row.

Inner nodes are few (a seventh of the leaves), so proofs are found among them by pointer jumping:
a node holds the siblings it meets on the way to some ancestor; a self-join appends what that
ancestor holds, which doubles the distance each round until every node has reached the root. A leaf then
needs its own run and what the run's node holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .ranks import group_text, ranked

#: Children of a node; rows that one key and salt of a pointer join may have.
ARITY, MEET = 8, 64
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value as ``length in bytes : value``, or ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_rows(docs: DataFrame, tampered: Column, change: Column) -> DataFrame:
    """``doc_id, grp, leaf, shown``: the digest of each row, and of what a checker is shown instead."""
    head = [field(F.col(c)) for c in FIELDS[:-1]]
    shown = F.when(tampered & F.col("text").isNotNull(), digest(*head, field(change)))
    leaf = digest(*head, field(F.col("text")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), group_text("lang").alias("grp"), leaf.alias("leaf"), shown.alias("shown"))
    return rows.withColumn("shown", F.coalesce("shown", "leaf"))


def joined(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def others(hashes: Column, at: Column) -> Column:
    """All hashes of a run but the one at 0-based ``at``, as one text."""
    return joined(F.filter(hashes, lambda x, i: i != at))


def runs(nodes: DataFrame) -> DataFrame:
    """Consecutive nodes (``grp, pos, hash, height``) of groups that have several, eight by eight."""
    several = nodes.where("size > 1")
    made = several.groupBy("grp", F.floor(F.col("pos") / ARITY).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("kids"), F.max("height").alias("height"), F.first("size").alias("size")
    )
    hashes = F.transform("kids", lambda k: k["hash"])
    return made.select(
        "grp", F.col("block").alias("pos"), hashes.alias("kids"), F.sha2(joined(hashes), 256).alias("hash"),
        F.ceil(F.col("size") / ARITY).alias("size"), (F.col("height") + 1).alias("height"),
    )


def node_name(tier: int, grp: Column, level: int, pos: Column) -> Column:
    return F.struct(F.lit(tier).alias("tier"), grp.alias("grp"), F.lit(level).alias("level"), pos.alias("pos"))


def forest(nodes: DataFrame, tier: int, first: int, most: int, heights: bool) -> tuple[list[DataFrame], DataFrame]:
    """Build the trees over ``nodes``, level by level.

    Returns the steps of all nodes from level ``first`` on (``id, up, at, beside, height, hash``; ``up`` is null at a
    tree's top) and the tops (``grp, level, hash, height``). Each level has an eighth of the rows before.
    """
    steps, tops, level = [], [], 0
    while True:
        tops.append(nodes.where("size = 1").select("grp", F.lit(level).alias("level"), "hash", "height"))
        if most <= 1:
            break
        made = written(runs(nodes), "runs")
        if level >= first:
            kids = made.select("grp", "pos", "kids", F.posexplode("kids").alias("at", "hash"))
            below = nodes.select("grp", "pos", "height") if heights else None
            step = kids.select(
                node_name(tier, F.col("grp"), level, F.col("pos") * ARITY + F.col("at")).alias("id"),
                node_name(tier, F.col("grp"), level + 1, F.col("pos")).alias("up"), "at",
                others(F.col("kids"), F.col("at")).alias("beside"), "hash", (F.col("pos") * ARITY + F.col("at")).alias("pos"), "grp",
            )
            step = step.join(below, ["grp", "pos"]) if heights else step.withColumn("height", F.lit(level - first))
            steps.append(step.select("id", "up", "at", "beside", "hash", "height"))
        nodes, level, most = made, level + 1, -(-most // ARITY)
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return steps, out


def jumped(active: DataFrame, rounds: int, nodes: int) -> DataFrame:
    """``id, seg, subroot, root`` of all nodes; ``seg`` lists (at, siblings) from the node up to the root.

    ``active`` holds ``id, up, seg, height, subroot, root``, ``up`` null at the root. In round r an ancestor
    stands 2**r levels above, so at most 8**(2**r) nodes name it: its row is repeated for as many
    salts as keep each join key at ``MEET`` nodes, and only nodes high enough are asked.
    """
    done, whole = [], active
    for r in range(rounds):
        reach = 2**r
        salts = max(1, -(-min(ARITY**reach, nodes) // MEET))
        done.append(active.where("up is null"))
        salt = F.pmod(F.xxhash64("id"), F.lit(salts))
        low = active.where("up is not null").withColumn("salt", salt)
        high = whole.where(F.col("height") >= reach).select(
            F.col("id").alias("up"), F.col("up").alias("next"), F.col("seg").alias("more"), F.col("subroot").alias("sub2"), F.col("root").alias("root2"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"),
        )
        moved = low.join(high, ["up", "salt"]).select(
            "id", F.col("next").alias("up"), F.concat("seg", "more").alias("seg"), "height",
            F.coalesce("subroot", "sub2").alias("subroot"), F.coalesce("root", "root2").alias("root"),
        )
        active = written(moved, "jumps")
        whole = active
        for d in done:
            whole = whole.unionByName(d)
    return whole.select("id", "seg", "subroot", "root")


def depth(most: int) -> int:
    """Levels above ``most`` nodes until one is left."""
    level = 0
    while most > 1:
        most, level = -(-most // ARITY), level + 1
    return level


def manifest(docs: DataFrame, tampered: Column, change: Column) -> DataFrame:
    """``doc_id, lang, leaf, subroot, root, proof, proof_sha256, folded_root, verified`` for every row of ``docs``.

    A leaf is the SHA-256 of the row's fields. The leaves of a ``lang`` ascend by ``doc_id`` (null
    first; rows of one id by their leaf digest), each run of eight becomes its digest until one node is left; these
    tops, ordered by ``lang`` (null first, bytewise), are joined to a root in the same way. ``proof`` lists ``at`` (place in the
    run) and ``beside`` (the run's other digests) from the leaf up. Rows where ``tampered`` holds are shown with
    ``change`` for their text; ``folded_root`` is what proof and shown row give. Null texts are shown unchanged. Equal rows
    are leaves of their own. An empty table gives no rows; columns other than the five of ``FIELDS`` are not read.
    """
    spark = docs.sparkSession
    rows = written(leaf_rows(docs, tampered, change), "leaves")
    leaves = written(ranked(rows, "grp", ["doc_id", "leaf"], rank="pos"), "placed")
    groups = leaves.groupBy("grp").agg(F.max("size").alias("n"))
    most, many = groups.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    total = leaves.count()
    nodes = leaves.select("grp", "pos", F.col("leaf").alias("hash"), "size", F.lit(0).alias("height"))
    steps, tops = forest(nodes, 0, 1, most, heights=False)
    tops = written(tops, "tops")
    order = written(ranked(tops.withColumnRenamed("grp", "name").withColumn("grp", F.lit("")), "grp", ["name"], rank="pos"), "order")
    above, root = forest(order.select("grp", "pos", "hash", "size", F.greatest(F.col("level") - 1, F.lit(0)).alias("height")), 1, 0, many, heights=True)

    # the step of a tree's top leads from its own name to the run of tops that it stands in
    entry = order.select(
        node_name(1, F.col("grp"), 0, F.col("pos")).alias("alias"), F.struct(F.lit(0).alias("tier"), F.col("name").alias("grp"), "level", F.lit(0).cast("long").alias("pos")).alias("id")
    )
    named = F.array(F.struct(F.col("at").cast("int").alias("at"), "beside"))
    nothing = F.lit(None).cast("string")
    parts = [s.select("id", "up", named.alias("seg"), "height", nothing.alias("subroot"), nothing.alias("root")) for s in steps]
    for k, s in enumerate(above):
        if k == 0:
            s = s.withColumnRenamed("id", "alias").join(entry, "alias")
        sub = F.col("hash") if k == 0 else nothing
        parts.append(s.select("id", "up", named.alias("seg"), "height", sub.alias("subroot"), nothing.alias("root")))
    last = root.select(
        node_name(1, F.col("grp"), depth(many), F.lit(0).cast("long")).alias("id"), F.lit(None).cast(node_type()).alias("up"),
        F.array().cast("array<struct<at:int,beside:string>>").alias("seg"), "height", nothing.alias("subroot"), F.col("hash").alias("root"),
    )
    if many == 1:  # the only tree's top is the root
        last = last.withColumnRenamed("id", "alias").join(entry, "alias").withColumn("subroot", F.col("root")).select("id", "up", "seg", "height", "subroot", "root")
    start = last
    for p in parts:
        start = start.unionByName(p)
    start = written(start, "steps")
    far = max(0, depth(most) - 1) + depth(many)
    paths = jumped(start, max(0, far).bit_length(), max(1, total // (ARITY - 1) + many))

    kids = leaves.groupBy("grp", F.floor(F.col("pos") / ARITY).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "doc_id", "leaf", "shown"))).alias("kids"), F.max("size").alias("n")
    )
    level = F.when(F.col("n") > 1, 1).otherwise(0)
    kids = kids.withColumn("id", F.struct(F.lit(0).alias("tier"), "grp", level.alias("level"), F.col("block").alias("pos")))
    hashes = F.transform("kids", lambda k: k["leaf"])
    met = kids.join(paths, "id").select("*", hashes.alias("hashes")).select("*", F.posexplode("kids").alias("at", "kid"))
    own = F.when(F.col("n") > 1, F.array(F.struct(F.col("at").alias("at"), others(F.col("hashes"), F.col("at")).alias("beside"))))
    proof = F.concat(F.coalesce(own, F.array().cast("array<struct<at:int,beside:string>>")), F.col("seg"))
    out = met.select(
        F.col("kid.doc_id").alias("doc_id"), F.when(F.col("grp") != "-", F.substr("grp", F.lit(2))).alias("lang"), F.col("kid.leaf").alias("leaf"),
        F.col("kid.shown").alias("shown"), "subroot", "root", proof.alias("proof"),
    )
    return out.select(
        "doc_id", "lang", "leaf", "subroot", "root", "proof", F.sha2(joined(F.transform("proof", lambda s: s["beside"])), 256).alias("proof_sha256"),
        folded(F.col("shown"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def node_type() -> str:
    return "struct<tier:int,grp:string,level:int,pos:bigint>"


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf digest and its proof give; digests are 64 letters long."""
    return F.aggregate(
        proof,
        leaf,
        lambda acc, s: F.sha2(
            F.concat(F.substring(s["beside"], F.lit(1), s["at"] * 64), acc, F.substr(s["beside"], s["at"] * 64 + 1)), 256
        ),
    )


def manifest_digest(docs: DataFrame) -> DataFrame:
    """The manifest with every row tampered whose decimal id has a CRC-32 divisible by three: its text in lower case."""
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = manifest(docs, chosen, lower)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
