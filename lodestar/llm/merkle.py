"""Merkle manifest of a dataset, kept as a persistent path-copying tree in the shared folder.

A document is a leaf of its source's tree, ordered by id; the sources' roots are the leaves of one more tree.
A node is the hash of the hex digests of up to 16 consecutive nodes below it.

1. *Places.* Leaves are hashed in the scan, range-partitioned by (source, id), numbered within their partition
   and moved by the counts of the partitions before, so a hot source is nobody's single task.
2. *Blocks.* 16^3 consecutive leaves are an aligned block: three levels that one task builds and writes as one
   row. The blocks' tops are the leaves of the next table, 4,096 times smaller, and so on up to one node.
3. *Paths.* Top down, each table's blocks hand their leaves the siblings beside and above them.
4. *Versions.* Each changed leaf makes a version of the tree. In its block only the leaf's ancestors are copied,
   all other nodes are the ones built in step 2; above the block the version goes on along the block's own path.
   A version's work is one node a level, whatever the number of versions.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, map_batches

#: Children of a node, levels of a block, leaves of a block.
FAN, LEVELS = 16, 3
SPAN = FAN**LEVELS
#: Rows of one Arrow batch that a task hands back.
OUT_ROWS = 2000

_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_BLOCKS = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("names", pa.list_(pa.string())), ("leaves", pa.binary()), ("changed", pa.list_(pa.binary())), ("top", pa.binary())])
_BLOCK_SQL = "grp string, block long, n long, ids array<long>, names array<string>, leaves binary, changed array<binary>, top binary"


def encoded(fields: dict[str, Column]) -> Column:
    """The bytes that a leaf hashes: each field ``-`` if null, else UTF-8 byte count, ``:``, value."""
    def one(c: Column) -> Column:
        c = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))

    return F.concat(*map(one, fields.values()))


def digest(parts) -> bytes:
    """The hash of raw digests, taken as their hex text."""
    return hashlib.sha256(b"".join(parts).hex().encode()).digest()


def block_levels(leaves: list[bytes], n: int) -> list[list[bytes]]:
    """The block's nodes by level, leaves first; ``n`` is the size of the whole tree that it is a block of."""
    out = [leaves]
    while len(out) <= LEVELS and (n > SPAN or len(out[-1]) > 1):
        low = out[-1]
        out.append([digest(low[i:i + FAN]) for i in range(0, len(low), FAN)])
    return out


def siblings(levels: list[list[bytes]], i: int) -> list[bytes]:
    """Left and right siblings of leaf ``i``, two entries a level, each their digests in a row."""
    out = []
    for low in levels[:-1]:
        first = i - i % FAN
        out += [b"".join(low[first:i]), b"".join(low[i + 1:first + FAN])]
        i //= FAN
    return out


def copy_path(leaf: bytes, path: list[bytes]) -> list[bytes]:
    """The version that ``leaf`` makes: its copies of the ancestors, lowest first; all siblings are shared."""
    out = [leaf]
    for left, right in zip(path[::2], path[1::2], strict=True):
        out.append(digest((left, out[-1], right)))
    return out


def _numbered(names: list[str]):
    """Adds ``part`` and ``at``: the row's place among its group's rows of this task, which come sorted."""
    def run(batches):
        part, now, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for g in batch.column(batch.schema.get_field_index("grp")).to_pylist():
                at = at + 1 if g == now else 0
                now = g
                places.append(at)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            fields = [batch.schema.field(c) for c in names] + [pa.field("part", pa.int32()), pa.field("at", pa.int64())]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], schema=pa.schema(fields))

    return run


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with pos (place in its group by ``order``, from 0) and n (the group's size)."""
    names = leaves.columns
    rows = leaves.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in leaves.schema.fields)
    rows = cut(map_batches(rows, _numbered(names), f"{schema}, part int, at long"))
    counts = cut(rows.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("k")))
    # a group has as many rows here as partitions
    sizes = counts.groupBy("grp").agg(F.sum("k").alias("n"), F.sort_array(F.collect_list(F.struct("part", "k"))).alias("parts"))
    before = F.aggregate("parts", F.struct(F.lit(0).cast("long").alias("sum"), F.expr("cast(array() as array<struct<part:int,base:long>>)").alias("out")),
                         lambda a, x: F.struct((a["sum"] + x["k"]).alias("sum"), F.concat(a["out"], F.array(F.struct(x["part"].alias("part"), a["sum"].alias("base")))).alias("out")))
    bases = sizes.select("grp", "n", F.inline(before["out"]))
    return rows.join(bases, ["grp", "part"]).select(*names, (F.col("base") + F.col("at")).alias("pos"), "n")


def _blocks(batches):
    """Rows sorted by (grp, pos) to one row a block."""
    now, held, out = None, [], []

    def close():
        (g, b, n), leaves = now, [r[2] for r in held]
        out.append((g, b, n, [r[0] for r in held], [r[1] for r in held], b"".join(leaves), [r[3] for r in held], block_levels(leaves, n)[-1][0]))

    def batch_of():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_BLOCKS)], schema=_BLOCKS)

    for batch in batches:
        columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("grp", "pos", "n", "id", "name", "leaf", "changed"))
        for g, pos, n, *row in zip(*columns, strict=True):
            key = (g, pos // SPAN, n)
            if key != now:
                if held:
                    close()
                now, held = key, []
                if sum(len(r[3]) for r in out) >= 8 * SPAN or len(out) >= OUT_ROWS:
                    yield batch_of()
                    out.clear()
            held.append(row)
    if held:
        close()
    if out:
        yield batch_of()


def in_blocks(rows: DataFrame) -> DataFrame:
    """The table of blocks of leaves (grp, pos, n, id, name, leaf, changed)."""
    rows = rows.withColumn("block", F.floor(F.col("pos") / SPAN)).repartition("grp", "block").sortWithinPartitions("grp", "pos")
    return cut(map_batches(rows.select("grp", "pos", "n", "id", "name", "leaf", "changed"), _blocks, _BLOCK_SQL))


def tower(rows: DataFrame) -> list[DataFrame]:
    """Tables of blocks, bottom up; each one's tops are the leaves of the next. A group ends where it has one block."""
    out = [in_blocks(rows)]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > SPAN:
        tops = out[-1].where(f"n > {SPAN}").select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / SPAN).alias("n"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("name"),
                                                  F.col("top").alias("leaf"), F.lit(None).cast("binary").alias("changed"))
        out.append(in_blocks(tops))
    return out


def _leaves_of(row: dict):
    raw = row["leaves"]
    return [raw[i:i + 32] for i in range(0, len(raw), 32)]


_PATHS = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("path", pa.list_(pa.binary())), ("subroot", pa.binary()), ("root", pa.binary())])
_PATH_SQL = "grp string, block long, path array<binary>, subroot binary, root binary"


def _emitted(schema: pa.Schema, rows_of):
    """mapInArrow over joined block rows; ``rows_of`` yields tuples of ``schema`` for one block."""
    def run(batches):
        out = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {f: batch.column(k)[i].as_py() for k, f in enumerate(batch.schema.names)}
                for r in rows_of(row):
                    out.append(r)
                    if len(out) >= OUT_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)], schema=schema)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return run


def _handed(row: dict):
    """Paths of a block's leaves, which are the blocks of the table below."""
    levels = block_levels(_leaves_of(row), row["n"])
    for i in range(len(levels[0])):
        yield row["grp"], row["block"] * SPAN + i, siblings(levels, i) + row["path"], row["subroot"], row["root"]


def _handed_sources(row: dict):
    """Paths of the sources' roots, which are the top blocks of their own trees."""
    levels = block_levels(_leaves_of(row), row["n"])
    for i, (g, leaf) in enumerate(zip(row["names"], levels[0], strict=True)):
        yield g, 0, siblings(levels, i) + row["path"], leaf, row["root"]


_OUT = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_()), ("copies", pa.list_(pa.string()))])
_OUT_SQL = "doc_id long, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, copies array<string>"


def _proved(row: dict):
    """Each leaf's proof and the version that its changed form makes."""
    levels = block_levels(_leaves_of(row), row["n"])
    above, root = row["path"], row["root"]
    source = row["grp"][1:] if row["grp"] else None
    sub, top = row["subroot"].hex(), root.hex()
    for i, (doc, leaf, changed) in enumerate(zip(row["ids"], levels[0], row["changed"], strict=True)):
        path = siblings(levels, i) + above
        proof = hashlib.sha256(b"".join(path).hex().encode()).hexdigest()
        version = copy_path(leaf if changed is None else changed, path)
        yield doc, source, leaf.hex(), sub, top, proof, version[-1].hex(), version[-1] == root, None if changed is None else [d.hex() for d in version]


@dataclass(frozen=True)
class Manifest:
    """A written manifest: the sources' block tables bottom up, and those of the tree over their roots."""

    sources: list[DataFrame]
    top: list[DataFrame]

    @property
    def root(self) -> str | None:
        """The digest of the whole dataset, None if it has no rows."""
        row = self.top[-1].where(f"n <= {SPAN}").select("top").first()
        return None if row is None else row["top"].hex()

    def _paths(self, tables: list[DataFrame], handed) -> DataFrame:
        """Paths of the blocks of ``tables[0]``; ``handed`` are those of the groups' last blocks."""
        paths = handed
        for table in reversed(tables[1:]):
            down = map_batches(table.drop("ids", "names", "changed", "top").join(paths, ["grp", "block"]), _emitted(_PATHS, _handed), _PATH_SQL)
            # groups that end further down keep the path they were handed
            paths = cut(down.unionByName(handed.join(table.select("grp").distinct(), "grp", "left_anti")))
        return paths

    def proofs(self) -> DataFrame:
        """One row per document: doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified, copies.

        ``folded_root`` is the root of the version that the document's changed leaf makes (of the tree itself where
        it has none), ``copies`` that version's own nodes from the leaf up, null where nothing was changed.
        """
        last = self.top[-1].where(f"n <= {SPAN}")
        none = F.expr("cast(array() as array<binary>)")
        paths = self._paths(self.top, last.select("grp", "block", none.alias("path"), F.col("top").alias("subroot"), F.col("top").alias("root")))
        handed = cut(map_batches(self.top[0].drop("ids", "changed", "top").join(paths.drop("subroot"), ["grp", "block"]), _emitted(_PATHS, _handed_sources), _PATH_SQL))
        paths = self._paths(self.sources, handed)
        return map_batches(self.sources[0].drop("names", "top").join(paths, ["grp", "block"]), _emitted(_OUT, _proved), _OUT_SQL)


def manifest(docs: DataFrame, group: str = "source", order: str = "doc_id", changes: dict[str, Column] | None = None, changed: Column | None = None, fields: tuple[str, ...] = _FIELDS) -> Manifest:
    """Build and write the manifest of ``docs``; rows where ``changed`` holds carry a leaf with ``changes`` made as well.

    Leaves of a group ascend by id, null ids first, rows of one id by their leaf's digest; equal rows are leaves of
    their own. A null group comes before all others and is not the group of the empty text. Columns beside
    ``fields`` are not read, so clashing names do no harm; a null ``changed`` changes nothing.
    """
    own = {c: F.col(f"`{c}`") for c in fields}
    leaf = F.unhex(F.sha2(encoded(own), 256))
    other = F.lit(None).cast("binary")
    if changed is not None:
        other = F.when(changed, F.unhex(F.sha2(encoded(own | (changes or {})), 256)))
    name = F.col(f"`{group}`").cast("string")
    rows = docs.select(F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), name)).alias("grp"), F.col(f"`{order}`").cast("long").alias("id"), leaf.alias("leaf"), other.alias("changed"))
    rows = placed(rows, ["id", "leaf"]).withColumn("name", F.lit(None).cast("string"))
    tables = tower(rows)
    ends = [t.where(f"n <= {SPAN}").select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("top").alias("leaf")) for t in tables]
    roots = ends[0]
    for more in ends[1:]:
        roots = roots.unionByName(more)
    roots = placed(roots, ["name"]).withColumn("id", F.lit(None).cast("long")).withColumn("changed", F.lit(None).cast("binary"))
    return Manifest(tables, tower(roots))


def lowered(c: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
