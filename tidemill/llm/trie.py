"""Prefix trie of conversations with subtree totals by depth bands (operator 11).

A node is a distinct sequence of first turns.  Its key is the XOR of position-dependent 128-bit
hashes of its turns, so the keys of all prefixes are running values that no task has to build alone.
The depths are cut into bands of fixed height.  A node explodes to its ancestors inside its band
only; the totals of the bands' roots are rolled up over the bands in the same way, as a smaller
trie of band roots, and then handed to the ancestors in the band above.  So a node explodes to at
most ``height`` ancestors, and the number of rounds is the logarithm of the depth, even of a
conversation that holds a large share of all turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemill.llm.common import prepare, stored
from tidemill.llm.scans import join_heavy, scan

HEIGHT = 8
#: Ids that one row joins before their digest is taken.
ID_BLOCK = 4096
_KEY = ["depth", "a", "b"]


def number_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place, digest, chars: turns in order (null turn first, ties by digest) with a 128-bit digest of role and text.

    Null roles and texts count as empty; rows without conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"),
        F.char_length(text).cast("long").alias("chars"),
    )
    return scan(turns, "conv_id", [F.asc_nulls_first("turn"), F.col("digest")], label="numbered-turns").drop("turn")


def conversations_of(numbered: DataFrame) -> DataFrame:
    """conv_id, n_turns."""
    return stored(numbered.groupBy("conv_id").agg(F.count("*").alias("n_turns")), "conversations")


def share_openings(numbered: DataFrame, base: Column, length: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Numbered turns and conversations after each conversation's first ``length`` turns gave way to those of ``base``.

    ``base`` and ``length`` (at most ``most``) are expressions of conv_id.  A shorter base gives all
    its turns, an absent one none; a conversation may end without turns.  Only conversations that
    are their own base lend turns.
    """
    own = conversations_of(numbered).withColumns({"base": base, "given_up": length.cast("long")})
    rows = own.agg(F.sum("n_turns")).first()[0] or 0
    heads = numbered.where((F.col("place") < most) & (base == F.col("conv_id"))).groupBy(F.col("conv_id").alias("lender")).agg(
        F.array_sort(F.collect_list(F.struct("place", "digest", "chars"))).alias("head")  # at most ``most``
    )
    opening = F.slice(F.coalesce("head", F.array().cast("array<struct<place:bigint,digest:binary,chars:bigint>>")), F.lit(1), F.col("given_up").cast("int"))
    lent = own.join(heads, F.col("base") == F.col("lender"), "left").withColumn("opening", opening).withColumn(
        "borrowed", F.size("opening").cast("long")
    )
    rebuilt = stored(lent.select(
        "conv_id", "given_up", "borrowed", "opening", F.col("n_turns").alias("own_turns"),
        (F.col("borrowed") + F.greatest(F.col("n_turns") - F.col("given_up"), F.lit(0))).alias("n_turns"),
    ), "rebuilt")
    shifts = rebuilt.select(F.col("conv_id").alias("shifted"), "given_up", "borrowed", "own_turns")
    kept = join_heavy(numbered, shifts, {"conv_id": "shifted"}, "own_turns", rows).where("place >= given_up").select(
        "conv_id", (F.col("place") - F.col("given_up") + F.col("borrowed")).alias("place"), "digest", "chars"
    )
    first = rebuilt.select("conv_id", F.explode("opening").alias("turn")).select("conv_id", "turn.place", "turn.digest", "turn.chars")
    return kept.unionByName(first), rebuilt.select("conv_id", "n_turns")


def _paths(rows: DataFrame, stride: int, height: int) -> DataFrame:
    """Rows at depths that ``stride`` divides, with ``path``: the keys of their ancestors at such depths inside the band, topmost first."""
    step = (F.col("depth") / stride).cast("long")
    inside = F.when(F.col("depth") > 0, F.floor((step - 1) / height))
    heads = F.when(step % height == 0, F.floor(step / height))
    banded = rows.where(F.col("depth") % stride == 0).withColumn("band", F.explode(F.array_compact(F.array(inside, heads))))
    lines = banded.groupBy("conv_id", "band").agg(
        F.array_sort(F.collect_list(F.struct(*_KEY, "chars", "last"))).alias("line")  # at most height + 1
    ).where("size(line) > 1")
    keys = F.transform("line", lambda x: F.struct(*[x[c].alias(c) for c in _KEY]))
    return lines.select("conv_id", keys.alias("keys"), F.posexplode(F.slice("line", 2, height)).alias("at", "node")).select(
        "conv_id", "node.*", F.slice("keys", F.lit(1), F.col("at") + 1).alias("path")
    )


def _below(rows: DataFrame, nodes: DataFrame, values: list[str], deepest: int, level: int, height: int) -> DataFrame:
    """Per node the sums of ``values`` over all nodes below it.  ``nodes``: key, path, values; nodes without descendants have no row."""
    band = height ** (level + 1)
    nodes = nodes.where("size(path) > 0")
    if deepest > band:
        # what each band root has inside its own band
        own = nodes.groupBy(F.col("path")[0].alias("top")).agg(*[F.sum(v).alias(v) for v in values]).select("top.*", *values)
        paths = _paths(rows, band, height).groupBy(*_KEY).agg(F.first("path").alias("path"))
        roots = stored(paths.join(own, _KEY, "left").select(*_KEY, "path", *[F.coalesce(v, F.lit(0)).alias(v) for v in values]), f"band-roots-{level}")
        further = _below(rows, roots, values, deepest, level + 1, height).select(*_KEY, *[F.col(v).alias(f"far_{v}") for v in values])
        whole = roots.join(further, _KEY, "left").select(*_KEY, *[(F.col(v) + F.coalesce(f"far_{v}", F.lit(0))).alias(f"all_{v}") for v in values])
        # a completed band root hands its total to its ancestors in the band above
        nodes = nodes.join(whole, _KEY, "left").select(*_KEY, "path", *[(F.col(v) + F.coalesce(f"all_{v}", F.lit(0))).alias(v) for v in values])
    children = [(F.col("above.depth") == F.col("depth") - 1).cast("long").alias("child")] if level == 0 else []
    raised = nodes.withColumn("above", F.explode("path")).select("above", *values, *children)
    sums = [F.sum(c).alias(c) for c in [*values, *(["child"] if level == 0 else [])]]
    return stored(raised.groupBy("above").agg(*sums).select("above.*", *values, *(["child"] if level == 0 else [])), f"below-{level}")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined ids of each key; rows of a key follow each other in order."""
    held, digest = None, None

    def done(keys: list, found: list) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in keys], pa.int64()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string())], names=[*_KEY, "ends_sha256"])

    for batch in batches:
        keys, found = [], []
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ids"))):
            if key == held:
                digest.update(b",")
            else:
                if held is not None:
                    keys.append(held)
                    found.append(digest.hexdigest())
                held, digest = key, hashlib.sha256()
            digest.update(ids.encode())
        yield done(keys, found)
    if held is not None:
        yield done([held], [digest.hexdigest()])


def prefix_trie(turns: DataFrame, conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, place, digest, chars, numbered without gaps; ``conversations`` conv_id and
    n_turns, also of those without turns.  A node is named by its smallest member and its depth.
    ``saved_tokens`` sums over the subtree what n_convs - 1 members need not repeat of a node's last
    turn; ``ends_sha256`` digests the ids of the members that end here, joined by commas.  A digest
    needs its ids in order: they are joined in blocks first, and the blocks of a node are streamed.
    Conversations with equal turns share all nodes; without conversations there are no nodes.
    """
    spark = turns.sparkSession
    prepare(spark)
    place, digest = F.col("place"), F.col("digest")
    hashed = turns.select(
        "conv_id", place.alias("at"), "chars", F.xxhash64(place, digest).alias("a"), F.xxhash64(digest, place, F.lit(1)).alias("b")
    )
    keyed = scan(hashed, "conv_id", [F.col("at")], ["a", "b"], "prefix-keys").drop("place")
    ends = conversations.select(F.col("conv_id").alias("ended"), "n_turns")
    rows_of_turns = conversations.agg(F.sum("n_turns")).first()[0] or 0
    zero = F.lit(0).cast("long")
    every = join_heavy(keyed, ends, {"conv_id": "ended"}, "n_turns", rows_of_turns).select(
        "conv_id", (F.col("at") + 1).alias("depth"), "a", "b", "chars", (F.col("at") + 1 == F.col("n_turns")).alias("last")
    ).unionByName(conversations.select(
        "conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("chars"), (F.col("n_turns") == 0).alias("last")
    ))
    every = stored(every, "prefixes")
    deepest = every.agg(F.max("depth")).first()[0] or 0
    members = [F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("last").alias("n_ends"), F.first("chars").alias("chars")]
    top = every.where("depth = 0").groupBy(*_KEY).agg(*members).withColumn("path", F.array().cast("array<struct<depth:bigint,a:bigint,b:bigint>>"))
    nodes = stored(_paths(every, 1, height).groupBy(*_KEY).agg(*members, F.first("path").alias("path")).unionByName(top).withColumns({
        "leaf": (F.col("n_ends") == F.col("n_convs")).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars"),
    }), "nodes")
    below = _below(every, nodes.select(*_KEY, "path", "leaf", "saved"), ["leaf", "saved"], deepest, 0, height)
    below = below.select(*_KEY, F.col("leaf").alias("leaves_below"), F.col("saved").alias("saved_below"), "child")
    # ids that end at a node, in blocks and then as a digest
    blocks = every.where("last").groupBy(*_KEY, F.floor(F.col("conv_id") / ID_BLOCK).alias("block")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    digests = blocks.repartition(n, *_KEY).sortWithinPartitions(*_KEY, "block").select(*_KEY, "ids").mapInArrow(
        _digests, "depth long, a long, b long, ends_sha256 string"
    )
    up = F.element_at("path", -1)
    totals = stored(nodes.withColumn("up", F.when(F.size("path") > 0, up)).drop("path").join(below, _KEY, "left").join(digests, _KEY, "left").select(
        *_KEY, "conv_id", "n_convs", F.coalesce("child", zero).alias("n_children"), "up",
        (F.col("leaf") + F.coalesce("leaves_below", zero)).alias("n_leaves"), (F.col("saved") + F.coalesce("saved_below", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    ), "trie")
    parents = totals.where("n_children > 0").select(
        *[F.col(c).alias(f"up_{c}") for c in _KEY], F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("weight")
    )
    children = totals.select("*", *[F.col(f"up.{c}").alias(f"of_{c}") for c in _KEY]).drop("up")
    named = join_heavy(children, parents, {f"of_{c}": f"up_{c}" for c in _KEY}, "weight", totals.count())
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``prefix_trie`` of a table of conv_id, turn, role, text."""
    numbered = number_turns(conversations)
    return prefix_trie(numbered, conversations_of(numbered), height)


def opening_trie(conversations: DataFrame, group: int = 100, most: int = 5, height: int = HEIGHT) -> DataFrame:
    """``prefix_trie`` after conversations took over the first turns of their group's first id.

    How many, 0 to ``most``, follows from the crc32 of the id.
    """
    conv = F.col("conv_id")
    length = F.crc32(conv.cast("string").cast("binary")) % (most + 1)
    return prefix_trie(*share_openings(number_turns(conversations), conv - conv % group, length, most), height)
