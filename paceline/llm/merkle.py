"""A Merkle tree over the rows of a table, with multiproofs per partition of leaves.

Rows are the leaves of one tree per group; the trees' roots, in the order of the groups, are
the leaves of a top tree. A node is a coordinate ``(tree, level, pos)``; leaves have level
0, the top tree is number -1. Every 8 consecutive nodes hash to one until one is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.operators.joins import join_lookup
from paceline.operators.ordered import global_index
from paceline.sources.scratch import new_folder, pin

#: Nodes of a run, and levels that one task climbs at once: a partition of leaves is an
#: aligned subtree of at most 8 ** 4 of them.
ARITY, CLIMB = 8, 4
PARTITION = ARITY**CLIMB
TOP = -1


def node_hash(*parts: bytes) -> bytes:
    """Lowercase hex SHA-256 of the parts put together."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def record(values: Iterable[bytes | None]) -> Iterator[bytes]:
    """What a leaf hashes of its fields: ``-`` for null, else byte count, ``:`` and value."""
    for v in values:
        yield b"-" if v is None else b"%d:%b" % (len(v), v)


def width_at(leaves: int, level: int) -> int:
    """Nodes of a tree at a level."""
    return -(-leaves // ARITY**level)


def height(leaves: int) -> int:
    """Level of the root."""
    level = 0
    while width_at(leaves, level) > 1:
        level += 1
    return level


def _height(leaves: Column) -> Column:
    out = F.lit(0)
    for k in range(21):  # 8 ** 21 is no long
        out = out + (leaves > ARITY**k).cast("int")
    return out


def run_of(pos: int, width: int) -> range:
    """Positions of the nodes that hash together with one."""
    return range(pos - pos % ARITY, min(pos - pos % ARITY + ARITY, width))


def missing_nodes(positions: Iterable[int], leaves: int) -> list[tuple[int, int]]:
    """The least set of ``(level, pos)`` that a root needs besides these leaves.

    Level by level, a node is missing if it shares a run with one that is known or can be
    derived, and isn't so itself: what the proofs of all these leaves have in common is
    there once, and what one derives from another not at all.
    """
    out, known, level = [], set(positions), 0
    while known and width_at(leaves, level) > 1:
        width, parents = width_at(leaves, level), {p // ARITY for p in known}
        out += [(level, p) for q in parents for p in run_of(q * ARITY, width) if p not in known]
        known, level = parents, level + 1
    return out


def climb(known: dict[tuple[int, int], bytes], positions: Iterable[int], leaves: int) -> bytes:
    """Add the nodes above these leaves to ``known``, from it and each other; the root."""
    here, level = set(positions), 0
    while width_at(leaves, level) > 1:
        width = width_at(leaves, level)
        here = {p // ARITY for p in here}
        for q in here:
            known[level + 1, q] = node_hash(*[known[level, p] for p in run_of(q * ARITY, width)])
        level += 1
    return known[level, 0]


def leaf_hashes(
    docs: DataFrame,
    fields: list[str],
    group_col: str,
    id_col: str,
    changed: Column | None = None,
    field: str | None = None,
    change: Callable[[bytes], bytes] | None = None,
) -> DataFrame:
    """``group, id, leaf, claimed`` of each row; numbers count as decimals.

    ``claimed`` is the leaf of a row whose ``field`` is put through ``change`` (null stays
    null), where ``changed`` holds, else null.
    """
    at = fields.index(field) if field else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(i).cast(pa.binary()).to_pylist() for i in range(3, batch.num_columns)]
            leaf = [node_hash(*record(row)) for row in zip(*values)]
            claimed = [None] * batch.num_rows
            for i, flag in enumerate(batch.column(2).to_pylist()):
                if flag:
                    row = [v[i] for v in values]
                    row[at] = None if row[at] is None else change(row[at])
                    claimed[i] = node_hash(*record(row))
            columns = [batch.column(0), batch.column(1), _packed(leaf), _packed(claimed)]
            yield pa.RecordBatch.from_arrays(columns, ["group", "id", "leaf", "claimed"])

    flag = F.lit(False) if changed is None else F.coalesce(changed, F.lit(False))
    rows = docs.select(
        F.col(f"`{group_col}`").alias("group"),
        F.col(f"`{id_col}`").alias("id"),
        flag.alias("flag"),
        *[F.col(f"`{c}`").cast("string").alias(f"f{i}") for i, c in enumerate(fields)],
    )
    types = dict(rows.dtypes)
    return rows.mapInArrow(run, f"`group` {types['group']}, id {types['id']}, leaf binary, claimed binary")


def _packed(hashes: list[bytes | None]) -> pa.Array:
    """Hex digests as 32 bytes."""
    return pa.array([None if h is None else bytes.fromhex(h.decode()) for h in hashes], pa.binary())


def _hex(hashes: pa.ChunkedArray) -> list[bytes | None]:
    return [None if h is None else h.hex().encode() for h in hashes.to_pylist()]


_NODES = "tree long, width long, level int, pos long, hash binary"


def _grow(nodes: DataFrame, level: int) -> DataFrame:
    """The nodes of the next ``CLIMB`` levels above those of one level; a task gets one aligned run of them."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tree, unit = (k.as_py() for k in key)
        leaves = table["width"][0].as_py()
        hashes = _hex(table.sort_by("pos")["hash"])
        first, out = unit * PARTITION, []
        for up in range(level + 1, level + CLIMB + 1):
            if width_at(leaves, up - 1) == 1:
                break
            hashes = [node_hash(*hashes[i : i + ARITY]) for i in range(0, len(hashes), ARITY)]
            first //= ARITY
            out += [(up, first + i, h) for i, h in enumerate(hashes)]
        n = len(out)
        return pa.table(
            {
                "tree": pa.array([tree] * n, pa.int64()),
                "width": pa.array([leaves] * n, pa.int64()),
                "level": pa.array([x[0] for x in out], pa.int32()),
                "pos": pa.array([x[1] for x in out], pa.int64()),
                "hash": _packed([x[2] for x in out]),
            }
        )

    unit = F.expr(f"pos div {PARTITION}").alias("unit")
    return nodes.groupBy("tree", unit).applyInArrow(run, _NODES)


@dataclass(frozen=True)
class Manifest:
    """The tree in a folder: its leaves, the nodes above them, and its root.

    ``leaves`` has ``group, id, leaf, claimed, tree, pos, width`` (leaves of its tree),
    ``nodes`` has ``tree, level, pos, hash`` of levels above 0.
    """

    leaves: DataFrame
    nodes: DataFrame
    root: str
    trees: int


def build(leaves: DataFrame, path: str) -> Manifest | None:
    """Write the tree over the result of ``leaf_hashes`` below ``path``; none for no rows.

    Leaves ascend by id inside their group (null first), equal ids by digest, equal rows in
    any order; each is a leaf of its own. Groups ascend bytewise, null first. The rows are
    ranged and numbered in blocks of any size, and no task gets more than an aligned run of
    them, whatever the groups look like.
    """
    spark = leaves.sparkSession
    placed = global_index(leaves, ["group", "id", "leaf"], "row", unique=False)
    groups = placed.groupBy("group").agg(F.min("row").alias("start"), F.count(F.lit(1)).alias("width"))
    groups = global_index(groups, ["group"], "tree")
    trees, widest = groups.agg(F.count(F.lit(1)), F.max("width")).first()
    if not trees:
        return None
    placed = join_lookup(placed, groups, {"group": "group"}, null_safe=True)
    placed.withColumn("pos", F.col("row") - F.col("start")).drop("row", "start").write.parquet(f"{path}/leaves")
    placed = spark.read.parquet(f"{path}/leaves")
    level0 = placed.select("tree", "width", F.lit(0).alias("level"), "pos", F.col("leaf").alias("hash"))
    roots = [level0.where("width = 1"), *_climb(level0, widest, f"{path}/nodes/part=trees")]
    tops = [r.where((F.col("pos") == 0) & (F.col("level") == _height(F.col("width")))) for r in roots]
    top0 = tops[0]
    for t in tops[1:]:
        top0 = top0.unionByName(t)
    top0 = top0.select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(trees).cast("long").alias("width"), F.lit(0).alias("level"),
        F.col("tree").alias("pos"), "hash",
    )
    top0.write.parquet(f"{path}/nodes/part=top/base=-1")
    top0 = spark.read.parquet(f"{path}/nodes/part=top/base=-1")
    last = [top0, *_climb(top0, trees, f"{path}/nodes/part=top")][-1]
    root = last.where((F.col("level") == height(trees)) & (F.col("pos") == 0)).first()["hash"]
    spark.createDataFrame([(root.hex(), trees)], "root string, trees long").write.parquet(f"{path}/root")
    return open_manifest(spark, path)


def _climb(level0: DataFrame, widest: int, path: str) -> list[DataFrame]:
    """Write all levels above the leaves, ``CLIMB`` at a time; a table for each time."""
    out, nodes = [], level0
    for base in range(0, height(widest), CLIMB):
        above = f"{path}/base={base}"
        _grow(nodes.where(nodes.width > ARITY**base), base).write.parquet(above)
        out.append(level0.sparkSession.read.parquet(above))
        nodes = out[-1].where(F.col("level") == base + CLIMB)
    return out


def open_manifest(spark: SparkSession, path: str) -> Manifest:
    """The tree that ``build`` has written."""
    root, trees = spark.read.parquet(f"{path}/root").first()
    nodes = spark.read.parquet(f"{path}/nodes").select("tree", "level", "pos", "hash")
    return Manifest(spark.read.parquet(f"{path}/leaves"), nodes, root, trees)


def _requests(leaves: DataFrame, trees: int) -> DataFrame:
    """``tree, unit`` and the missing coordinates of each partition of leaves: ``of, level, at``."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tree, unit = (k.as_py() for k in key)
        need = [(tree, *n) for n in missing_nodes(table["pos"].to_pylist(), table["width"][0].as_py())]
        need += [(TOP, *n) for n in missing_nodes([tree], trees)]
        columns = list(zip(*need)) or [(), (), ()]
        return pa.table(
            {
                "tree": pa.array([tree] * len(need), pa.int64()),
                "unit": pa.array([unit] * len(need), pa.int64()),
                "of": pa.array(columns[0], pa.int64()),
                "level": pa.array(columns[1], pa.int32()),
                "at": pa.array(columns[2], pa.int64()),
            }
        )

    pos = leaves.select("tree", "width", "pos", F.expr(f"pos div {PARTITION}").alias("unit"))
    return pos.groupBy("tree", "unit").applyInArrow(run, "tree long, unit long, of long, level int, at long")


def _fetched(manifest: Manifest, leaves: DataFrame) -> DataFrame:
    """The requests with their hashes, in one join over the levels asked for."""
    need = pin(_requests(leaves, manifest.trees))
    levels = [r[0] for r in need.select("level").distinct().collect()]  # at most as many as a tree has
    nodes = manifest.nodes.where(F.col("level").isin(levels))
    if 0 in levels:
        level0 = manifest.leaves.select("tree", F.lit(0).alias("level"), "pos", F.col("leaf").alias("hash"))
        asked = need.where((F.col("level") == 0) & (F.col("of") != TOP)).limit(1).count()
        nodes = nodes.unionByName(level0) if asked else nodes
    nodes = nodes.select(F.col("tree").alias("_of"), F.col("level").alias("_level"), F.col("pos").alias("_at"), "hash")
    # The nodes near a root are asked for by every partition: hot keys are joined apart.
    return join_lookup(need, nodes, {"of": "_of", "level": "_level", "at": "_at"}, "inner")


def prove(manifest: Manifest, leaves: DataFrame | None = None) -> DataFrame:
    """Proofs of the leaves of a manifest, or of some of its rows, and what their claims fold to.

    Each partition of leaves computes the least set of coordinates that it lacks; all are
    fetched in one join; the partition derives the nodes above its leaves and expands every
    leaf's proof from them. ``id, leaf, subroot, root, proof_sha256`` (of the siblings up to
    the root), ``folded_root`` (of the claimed leaf, else of the leaf) and ``verified``.
    """
    leaves = manifest.leaves if leaves is None else leaves
    trees, root = manifest.trees, manifest.root

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        tree, _ = (k.as_py() for k in key)
        positions = left["pos"].to_pylist()
        if not positions:
            return pa.table({n: pa.array([], t) for n, t in zip(names, types(left))})
        width, leaf = left["width"][0].as_py(), _hex(left["leaf"])
        low, top = dict(zip(((0, p) for p in positions), leaf)), {}
        for of, level, at, h in zip(*(right[c].to_pylist() for c in ("of", "level", "at", "hash"))):
            (top if of == TOP else low)[level, at] = h.hex().encode()
        subroot = climb(low, positions, width)
        top[0, tree] = subroot
        derived = climb(top, [tree], trees)
        # The way up from each node: what stands before and after it in its run, level by level.
        ways: dict[tuple[int, int], list[tuple[bytes, bytes]]] = {}

        def way(known: dict, level: int, pos: int, leaves: int, rest: Callable) -> list[tuple[bytes, bytes]]:
            width = width_at(leaves, level)
            if width == 1:
                return rest()
            run = run_of(pos, width)
            before = b"".join([known[level, p] for p in run if p < pos])
            after = b"".join([known[level, p] for p in run if p > pos])
            return [(before, after), *cached(known, level + 1, pos // ARITY, leaves, rest)]

        def cached(known: dict, level: int, pos: int, leaves: int, rest: Callable) -> list[tuple[bytes, bytes]]:
            at = (level, pos) if known is low else (-1 - level, pos)
            if at not in ways:
                ways[at] = way(known, level, pos, leaves, rest)
            return ways[at]

        def to_root() -> list[tuple[bytes, bytes]]:
            return cached(top, 0, tree, trees, list)

        proofs, folded = [], []
        for p, claim in zip(positions, _hex(left["claimed"])):
            steps = way(low, 0, p, width, to_root)
            proofs.append(hashlib.sha256(b"".join([x for step in steps for x in step])).hexdigest())
            if claim is not None:
                for before, after in steps:
                    claim = node_hash(before, claim, after)
            folded.append((derived if claim is None else claim).decode())
        n = len(positions)
        columns = [
            left["id"], [h.decode() for h in leaf], [subroot.decode()] * n, [root] * n, proofs, folded, [f == root for f in folded]
        ]
        return pa.table(dict(zip(names, columns)))

    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def types(left: pa.Table) -> list[pa.DataType]:
        return [left["id"].type, *[pa.string()] * 5, pa.bool_()]

    kind = dict(leaves.dtypes)["id"]
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    mine = leaves.select("id", "tree", "width", "pos", "leaf", "claimed", F.expr(f"pos div {PARTITION}").alias("unit"))
    fetched = _fetched(manifest, leaves)
    return mine.groupBy("tree", "unit").cogroup(fetched.groupBy("tree", "unit")).applyInArrow(run, schema)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(docs: DataFrame) -> DataFrame:
    """The result of the query: every row proved, a third of them after tampering.

    Null in any column is a value of its own; rows without an id are not tampered with. An
    empty table has no tree and gives no rows. Other columns are not looked at.
    """
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = leaf_hashes(docs, FIELDS, "lang", "doc_id", changed, "text", bytes.lower)
    manifest = build(leaves, new_folder(docs.sparkSession, "merkle"))
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    if manifest is None:
        none = [F.lit(None).cast("string").alias(n) for n in names]
        return docs.select("doc_id", *none, F.lit(None).cast("boolean").alias("verified")).limit(0)
    return prove(manifest).select(F.col("id").alias("doc_id"), *names, "verified")


def _oracle(levels: int = 8, top: int = 4) -> str:
    """SQL for trees of at most 8 ** ``levels`` leaves and 8 ** ``top`` groups; a level above a root changes nothing."""
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}) || ':' || {0} END"
    record = " || ".join(field.format(f"CAST({c} AS VARCHAR)") for c in FIELDS[:4])
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END)"
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
        f"lambda x: ord(x)::BIGINT)), lambda c, b: {bits}), 4294967295::BIGINT)"
    )
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"d AS (SELECT doc_id, lang, sha256({record} || {field.format('text')}) AS leaf, "
        f"sha256({record} || {field.format(f'CASE WHEN {crc} % 3 = 0 THEN {lower} ELSE text END')}) AS claim FROM documents)",
        "t0 AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, leaf AS h, "
        "count(*) OVER (PARTITION BY lang) AS w FROM d)",
        "c0 AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, leaf, "
        "claim AS f, '' AS proof FROM d)",
    ]
    run = "OVER (PARTITION BY {lang}pos // 8 ORDER BY pos ROWS BETWEEN {rows})"

    def climb(i: int, t: str, lang: str, kept: str) -> None:
        key, same = ("lang, ", "c.lang IS NOT DISTINCT FROM r.lang AND ") if lang else ("", "")
        sides = ", ".join(
            f"CASE WHEN w > 1 THEN coalesce(string_agg(h, '') {run.format(lang=key, rows=rows)}, '') ELSE '' END AS {side}"
            for side, rows in (("b", "UNBOUNDED PRECEDING AND 1 PRECEDING"), ("a", "1 FOLLOWING AND UNBOUNDED FOLLOWING"))
        )
        ctes.append(f"r{t}{i} AS (SELECT *, {sides} FROM {t}{i})")
        ctes.append(
            f"{t}{i + 1} AS (SELECT {key}pos // 8 AS pos, CASE WHEN any_value(w) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) "
            f"ELSE any_value(h) END AS h, (any_value(w) + 7) // 8 AS w FROM {t}{i} GROUP BY {key}pos // 8)"
        )
        c = "c" if t == "t" else "e"
        ctes.append(
            f"{c}{i + 1} AS (SELECT {kept}, c.pos // 8 AS pos, CASE WHEN r.w > 1 THEN sha256(r.b || c.f || r.a) ELSE c.f END AS f, "
            f"c.proof || r.b || r.a AS proof FROM {c}{i} c JOIN r{t}{i} r ON {same}c.pos = r.pos)"
        )

    for i in range(levels):
        climb(i, "t", "lang", "c.doc_id, c.lang, c.leaf")
    ctes.append(f"s0 AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, h, count(*) OVER () AS w FROM t{levels})")
    ctes.append(
        f"e0 AS (SELECT c.doc_id, c.leaf, s0.h AS subroot, s0.pos, c.f, c.proof FROM c{levels} c "
        "JOIN s0 ON c.lang IS NOT DISTINCT FROM s0.lang)"
    )
    for i in range(top):
        climb(i, "s", "", "c.doc_id, c.leaf, c.subroot")
    return (
        f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, s{top}.h AS root, sha256(proof) AS proof_sha256, "
        f"f AS folded_root, f = s{top}.h AS verified FROM e{top}, s{top}"
    )


ORACLE = _oracle()
