"""Prefix trie of conversations by partition refinement.

All conversations start in one class. A class is split by its members' next
turn, and a node of the trie is a class at a depth; it is named by its smallest
member, which owns the nodes of its way from there on. A
class retires when its members have nothing left that differs, most often
because there is only one: its tail is a unary chain, of which every turn is
one node. Rounds take 4, 8, 16, ... and at last 256 turns at once, and as many
as the longest beginning asks for that conversations share and then leave.

Folding back needs no rounds: every node of a subtree is owned by a member of
its class, so that sums over a subtree are sums over members of what each of
them owns. Ids that end in a node are hashed in order, in runs of a bounded
size that several tasks have joined before.

Turns are exchanged as 32-byte digests and word counts, never as texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import partitions, stored, tidy

#: Turns of the first round; each next one takes twice as many, up to the second figure.
FIRST_TURNS, MOST_TURNS = 4, 256
#: Turns whose sums are taken together.
STRETCH = 1_024
#: Ids of a run that is hashed.
RUN_IDS = 50_000


def turn_keys(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Conversation, turn, digest of role and text, and words of the text; null role or text is empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    both = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"),
        F.unhex(F.sha2(both, 256)).alias("key"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def numbered(keys: DataFrame) -> DataFrame:
    """Turns with their place, from 1, in their conversation: by turn (null first), then by digest.

    Turns are dealt in ranges, so that a conversation of any length is no
    single task; what a range begins with is moved up by the turns before it.
    """
    spark = keys.sparkSession
    order = ["conv", F.asc_nulls_first("turn"), "key", "words"]
    ranges = keys.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place = None, 0
        for batch in batches:
            places = []
            for c in batch.column("conv").to_pylist():
                conv, place = c, place + 1 if c == conv else 1
                places.append(place)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("conv", "key", "words", "range")), pa.array(places, pa.int64())],
                ["conv", "key", "words", "range", "local"],
            )

    kind = "conv long, key binary, words long, range int, local long"
    rows = stored(ranges.withColumn("range", F.spark_partition_id()).drop("turn").mapInArrow(tidy(number), kind), "turns")
    sizes = rows.groupBy("conv", "range").agg(F.max("local").alias("n"))
    cut = sizes.groupBy("conv").agg(F.count("*").alias("ranges")).where("ranges > 1").select("conv")
    # At most one conversation goes on from each range to the next.
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    moved = sizes.join(F.broadcast(cut), "conv").select("conv", "range", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(F.broadcast(moved), ["conv", "range"], "left").select(
        "conv", "key", "words", (F.col("local") + F.coalesce("before", F.lit(0))).alias("at")
    )


def rebuilt(turns: DataFrame, base: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """Every conversation with its first ``head`` turns taken from ``base``: turns and lengths.

    Both are expressions over ``conv``. The turns are those that the base has
    there, all if it has fewer, none if there is no such conversation; the
    conversation's own after the first ``head`` follow.
    """
    sizes = turns.groupBy("conv").agg(F.max("at").alias("n"))
    heads = sizes.select("conv", base.alias("base"), head.cast("long").alias("head"), "n")
    of_base = sizes.select(F.col("conv").alias("base"), F.col("n").alias("has"))
    known = heads.join(of_base, "base", "left").select(
        "conv", "base", "head", "n", F.least("head", F.coalesce("has", F.lit(0))).alias("taken")
    )
    known = stored(known, "heads")
    lengths = known.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("length"))
    # Only what is moved asks for another row: most bases have as many turns as are wanted.
    short = known.where("taken < head").select("conv", (F.col("head") - F.col("taken")).alias("missing"))
    own = turns.where(F.col("at") > head).join(short, "conv", "left").select(
        "conv", (F.col("at") - F.coalesce("missing", F.lit(0))).alias("depth"), "key", "words"
    )
    first = turns.withColumnRenamed("conv", "base").withColumnRenamed("at", "depth")
    asked = known.where("taken > 0").select("conv", "base", F.explode(F.sequence(F.lit(1).cast("long"), F.col("taken"))).alias("depth"))
    most = known.agg(F.max("taken")).first()[0] or 0
    first = turns.where(F.col("at") <= most).withColumnRenamed("conv", "base").withColumnRenamed("at", "depth")
    taken = asked.join(first, ["base", "depth"]).select("conv", "depth", "key", "words")
    return own.unionByName(taken), lengths


CLASSES = "conv long, length long, owner long, members long, depth long, alike boolean"


def refine(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The classes of several members that every conversation was in, by depth.

    ``owner`` is the smallest member. A class whose members are alike to their
    ends is given up to the depth of a round's end, where ``alike`` is set.
    """
    spark = turns.sparkSession
    whole = turns.groupBy("conv").agg(
        F.bit_xor(F.xxhash64("depth", "key")).alias("one"), F.sum(F.xxhash64("key", "depth").cast("decimal(20,0)")).alias("two")
    )
    zero = F.lit(0).cast("decimal(30,0)")
    way = F.struct(F.coalesce("one", F.lit(0)).alias("one"), F.coalesce("two", zero).alias("two"))
    convs = lengths.join(whole, "conv", "left").select("conv", "length", way.alias("all"))
    top = convs.agg(F.min("conv"), F.count("*"), F.coalesce(F.min("all") == F.max("all"), F.lit(True))).first()
    if top[1] < 2:
        return spark.createDataFrame([], CLASSES)
    root = convs.withColumns({"owner": F.lit(top[0]).cast("long"), "members": F.lit(top[1]).cast("long"), "depth": F.lit(0).cast("long"), "alike": F.lit(top[2])})
    names = ["conv", "length", "owner", "members", "depth", "alike"]
    found, depth, width = [root.select(*names)], 0, FIRST_TURNS
    active = root.where(~F.col("alike")).select("conv", "length", "all", "owner")
    while not active.isEmpty():
        near = turns.where((F.col("depth") > depth) & (F.col("depth") <= depth + width)).join(active, "conv")
        next_turns = near.groupBy("conv").agg(
            F.sort_array(F.collect_list(F.struct("depth", "key"))).alias("next"),
            *(F.any_value(c).alias(c) for c in ("length", "all", "owner")),
        )

        def on(done: Column, x: Column) -> Column:
            before = F.coalesce(F.get(done, F.size(done) - 1)["way"], F.lit(b""))
            return F.concat(done, F.array(F.struct(x["depth"].alias("depth"), F.unhex(F.sha2(F.concat(before, x["key"]), 256)).alias("way"))))

        ways = F.aggregate("next", F.array().cast("array<struct<depth:bigint,way:binary>>"), on)
        split = stored(next_turns.select("conv", "length", "all", F.col("owner").alias("before"), F.inline(ways)), "ways")
        several = split.groupBy("before", "depth", "way").agg(
            F.min("conv").alias("owner"), F.count("*").alias("members"), (F.min("all") == F.max("all")).alias("same")
        ).where("members > 1")
        depth, width = depth + width, min(width * 2, MOST_TURNS)
        here = stored(
            split.join(several, ["before", "depth", "way"]).withColumn("alike", F.col("same") & (F.col("depth") == depth)).select(*names, "all"),
            "classes",
        )
        found.append(here.select(*names))
        active = here.where((F.col("depth") == depth) & ~F.col("alike")).select("conv", "length", "all", "owner")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _ends(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end in each node, in order, joined by commas.

    Ids are dealt in ranges and joined to runs there, so that only runs meet
    where one hash has to go through all of them.
    """
    spark = ends.sparkSession
    order = ["conv", "depth", "id"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, out = None, [], []

        def full() -> None:
            if ids:
                out.append((*node, ids[0], ",".join(map(str, ids)).encode()))

        for batch in batches:
            for c, d, i in zip(*(batch.column(n).to_pylist() for n in order), strict=True):
                if (c, d) != node or len(ids) >= RUN_IDS:
                    full()
                    node, ids = (c, d), []
                ids.append(i)
            if out:
                yield _batch(out, [*order, "run"])
                out = []
        full()
        if out:
            yield _batch(out, [*order, "run"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in batches:
            for c, d, run in zip(*(batch.column(n).to_pylist() for n in ("conv", "depth", "run")), strict=True):
                if (c, d) == node:
                    state.update(b"," + run)
                    continue
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (c, d), hashlib.sha256(run)
            if out:
                yield _batch(out, ["conv", "depth", "ends"])
                out = []
        if node is not None:
            yield _batch([(*node, state.hexdigest())], ["conv", "depth", "ends"])

    tasks = partitions(spark)
    dealt = ends.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    joined = dealt.mapInArrow(tidy(runs), "conv long, depth long, id long, run binary")
    by_node = joined.repartition(tasks, "conv", "depth").sortWithinPartitions(*order)
    return by_node.mapInArrow(tidy(hashes), "conv long, depth long, ends string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)))


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Nodes of the trie of all conversations; see ``conversation_trie``."""
    turns = stored(turns, "rebuilt")
    classes = stored(refine(turns, lengths), "refined")
    # What is known of a conversation: where its own nodes begin, under whom, and where it ends.
    elsewhere = F.max(F.when(F.col("owner") != F.col("conv"), F.struct("depth", "owner")))
    known = classes.groupBy("conv").agg(
        elsewhere.alias("under"),
        F.max(F.when(F.col("depth") == F.col("length"), F.col("owner"))).alias("ends"),
        F.max(F.when(F.col("alike"), F.struct("owner", "members", "depth"))).alias("tail"),
    )
    convs = lengths.join(known, "conv", "left").select(
        "conv", "length", "tail", F.col("under.owner").alias("parent"), F.coalesce("ends", "tail.owner", "conv").alias("ends"),
        F.when(F.col("tail.owner") != F.col("conv"), F.col("length") + 1).otherwise(F.coalesce(F.col("under.depth") + 1, F.lit(0))).alias("first"),
    )
    convs = stored(convs, "conversations")
    owners = convs.where("first <= length")
    root = owners.where("first = 0").select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), F.lit(None).cast("long").alias("parent"), "length", "tail")
    own = turns.join(owners, "conv").where("depth >= first").select(
        "conv", "depth", "words", F.when((F.col("depth") == F.col("first")), F.col("parent")).otherwise(F.col("conv")).alias("parent"), "length", "tail"
    )
    several = classes.where("conv = owner").select("conv", "depth", F.col("members").alias("several"))
    tail = F.when(F.col("depth") > F.col("tail.depth"), F.col("tail.members"))
    nodes = own.unionByName(root).join(several, ["conv", "depth"], "left").select(
        "conv", "depth", "words", "parent", "length", F.coalesce("several", tail, F.lit(1)).alias("members")
    )
    nodes = stored(nodes, "nodes")
    saving = nodes.where("members > 1").select(
        "conv", "depth", ((F.col("members") - 1) * F.col("words")).alias("saves"), F.floor(F.col("depth") / STRETCH).alias("stretch")
    )
    backwards = Window.partitionBy("conv", "stretch").orderBy(F.desc("depth"))
    later = Window.partitionBy("conv").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    rest = saving.groupBy("conv", "stretch").agg(F.sum("saves").alias("saves")).withColumn("later", F.sum("saves").over(later))
    saved = saving.withColumn("down", F.sum("saves").over(backwards)).join(
        rest.where("later > 0").select("conv", "stretch", "later"), ["conv", "stretch"], "left"
    ).select("conv", "depth", (F.col("down") + F.coalesce("later", F.lit(0))).alias("down"))
    totals = saving.groupBy("conv").agg(F.sum("saves").alias("saves"))
    under = owners.where("first > 0").groupBy(F.col("parent").alias("conv"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("branches"))
    bottom = under.select("conv", F.col("depth").alias("length"), F.lit(True).alias("on"))
    each = owners.join(bottom, ["conv", "length"], "left").join(totals, "conv", "left").select(
        "conv", F.when(F.col("on"), 0).otherwise(1).alias("leaf"), F.coalesce("saves", F.lit(0)).alias("saves")
    )
    folded = classes.join(each, "conv").groupBy(F.col("owner"), "depth").agg(
        F.sum("leaf").alias("leaves"), F.sum(F.when(F.col("conv") != F.col("owner"), F.col("saves")).otherwise(0)).alias("others")
    ).withColumnRenamed("owner", "conv")
    ended = _ends(convs.select(F.col("ends").alias("conv"), F.col("length").alias("depth"), F.col("conv").alias("id")))
    # All that is known of a node meets in one exchange.
    parts = [nodes, saved, under, folded, ended]
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more, allowMissingColumns=True)
    values = ["words", "parent", "length", "members", "down", "branches", "leaves", "others", "ends"]
    whole = both.groupBy("conv", "depth").agg(*(F.max(v).alias(v) for v in values))

    def number(name: str, none: int = 0) -> Column:
        return F.coalesce(name, F.lit(none).cast("long"))

    return whole.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("members").alias("n_convs"),
        (number("branches") + (F.col("depth") < F.col("length")).cast("long")).alias("n_children"),
        number("leaves", 1).alias("n_leaves"), (number("down") + number("others")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    base: Column | None = None, head: Column | None = None,
) -> DataFrame:
    """Nodes of the prefix trie of conversations, one row each.

    A node is a distinct sequence of first turns (role and text). It is named
    by ``conv_id``, its smallest member, and ``depth``; ``parent_conv_id`` is
    its parent's name. Further ``n_convs`` members, ``n_children``,
    ``n_leaves`` childless nodes and ``saved_tokens`` of its subtree (each
    node's words of the last text, once for every member but one), and the hash
    of the ids that end there. With ``base`` and ``head``, expressions over the
    id ``conv``, conversations are first rebuilt (see ``rebuilt``).

    Turns are ordered by number, null first; equal numbers by the digest of
    role and text, and a turn that occurs twice stands twice. Null role or text
    is empty; rows with a null conversation take no part. A conversation
    without turns (if its base is absent) ends in the root. An empty table has
    no node. Other columns do not matter.
    """
    places = numbered(turn_keys(turns, conv, turn, role, text))
    none = F.col("conv") if base is None else base, F.lit(0) if head is None else head
    return trie(*rebuilt(places, *none))
